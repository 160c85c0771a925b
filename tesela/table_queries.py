"""Queries of the table engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions.geo import EARTH_KM, valid_point
from tesela.functions.values import date_text, key_prefix, price_offline, price_online, varchar
from tesela.operators import prepare, spatial
from tesela.plans import analyzer
from tesela.plans.ast import EngineError, Equal
from tesela.plans.parser import parse
from tesela.runtime import shared_folder, table
from tesela.session import Engine, Result
from tesela.sources.csv_source import infer, read_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GEO = """(SELECT *, CAST((c_custkey*7919)%36000 AS DOUBLE)/100e0 - 180e0 AS lon,
 CAST((c_custkey*104729)%18000 AS DOUBLE)/100e0 - 90e0 AS lat FROM customer)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def where(df: DataFrame, text: str) -> DataFrame:
    """A statement's predicate on a DataFrame, through parser and analyzer."""
    w = parse(text).where
    return df.filter(analyzer.equal(w, df.schema) if isinstance(w, Equal) else analyzer.between(w, df.schema))


def select(name: str, source: str, text: str, sql: str) -> None:
    query(sql, name)(lambda spark, d: where(table(spark, d, source), text))


select("eq_key", "orders", "SELECT * FROM orders WHERE o_orderkey = 4242", "SELECT * FROM orders WHERE o_orderkey = 4242")
select("eq_text", "part", 'SELECT * FROM part WHERE p_name = "cold widget"', "SELECT * FROM part WHERE trim(p_name) = 'cold widget'")
select("eq_numeric", "part", "SELECT * FROM part WHERE p_retailprice = 900.1", "SELECT * FROM part WHERE p_retailprice = 900.1e0")
select("between_float", "lineitem", "SELECT * FROM lineitem WHERE l_extendedprice BETWEEN 12900 AND 13000", "SELECT * FROM lineitem WHERE l_extendedprice BETWEEN 129e2 AND 130e2")
select("between_int", "part", "SELECT * FROM part WHERE p_size BETWEEN 10 AND 12", "SELECT * FROM part WHERE p_size BETWEEN 10 AND 12")
select("between_text", "part", 'SELECT * FROM part WHERE p_brand BETWEEN "Brand#1" AND "Brand#15"', "SELECT * FROM part WHERE p_brand BETWEEN 'Brand#1' AND 'Brand#15'")
select("between_reversed", "part", "SELECT * FROM part WHERE p_size BETWEEN 12 AND 10", "SELECT * FROM part WHERE p_size BETWEEN 12 AND 10")
select("restaurantes_by_date", "restaurantes", 'SELECT * FROM restaurantes WHERE fecha BETWEEN "2022-01-01" AND "2022-01-31"', "SELECT * FROM restaurantes WHERE fecha BETWEEN '2022-01-01' AND '2022-01-31'")
select("productos_by_price", "productos", "SELECT * FROM productos WHERE price BETWEEN 129.00 AND 130.00", "SELECT * FROM productos WHERE CAST(price AS DOUBLE) BETWEEN 129e0 AND 130e0")


@query("SELECT p_partkey, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS price FROM part WHERE CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) BETWEEN 950.1e0 AND 960.1e0")
def between_float32(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("float").alias("price"))
    return where(t, "SELECT * FROM t WHERE price BETWEEN 950.1 AND 960.1").withColumn("price", F.col("price").cast("double"))


@query("SELECT o_orderkey, substring(CAST(o_orderdate AS VARCHAR), 1, 10) AS day FROM orders WHERE substring(CAST(o_orderdate AS VARCHAR), 1, 10) BETWEEN '1997-01-01' AND '1997-01-31'")
def between_date(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", date_text(F.col("o_orderdate")).alias("day"))
    return where(t, 'SELECT * FROM t WHERE day BETWEEN "1997-01-01" AND "1997-01-31"')


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200 ORDER BY o_orderkey")
def range_by_id_sorted(spark: SparkSession, d: str) -> DataFrame:
    return prepare.range_sorted(table(spark, d, "orders"), "o_orderkey", 100, 200)


def geo(spark: SparkSession, d: str) -> DataFrame:
    lon = ((F.col("c_custkey") * 7919) % 36000).cast("double") / 100.0 - 180.0
    lat = ((F.col("c_custkey") * 104729) % 18000).cast("double") / 100.0 - 90.0
    return table(spark, d, "customer").withColumn("lon", lon).withColumn("lat", lat)


def _km(lon0: float, lat0: float) -> str:
    r = 2 * EARTH_KM
    return f"{r}e0*asin(least(1e0,sqrt(pow(sin((radians(lat)-radians({lat0}e0))/2e0),2)+cos(radians({lat0}e0))*cos(radians(lat))*pow(sin((radians(lon)-radians({lon0}e0))/2e0),2))))"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", F.round(spatial.DISTANCE, 6).alias("km"))


def _circle(lon0: float, lat0: float, r: float, extra: str = "") -> str:
    return f"SELECT c_custkey, round({_km(lon0, lat0)}, 6) AS km FROM {GEO} WHERE {_km(lon0, lat0)} <= {r} {extra}"


query(_circle(-12.5, 42.25, 1500), "spatial_range")(lambda spark, d: _shown(spatial.radius(geo(spark, d), "lon", "lat", -12.5, 42.25, 1500, ["c_custkey"], keep=True)))
query(_circle(175.0, 10.0, 2000), "spatial_range_antimeridian")(lambda spark, d: _shown(spatial.radius(geo(spark, d), "lon", "lat", 175.0, 10.0, 2000, ["c_custkey"], keep=True)))
query(_circle(31.62, 62.879511, 3000), "spatial_distance")(lambda spark, d: _shown(spatial.radius(geo(spark, d), "lon", "lat", 31.62, 62.879511, parse("SELECT * FROM t WHERE DISTANCE((0, 0), (31.62, 62.879511)) <= 3000").where.radius, ["c_custkey"], keep=True)))
query(
    _circle(10.0, 70.0, 2500, "AND lon BETWEEN 10e0-2500e0/(111.32e0*cos(radians(70e0))) AND 10e0+2500e0/(111.32e0*cos(radians(70e0))) AND lat BETWEEN 70e0-2500e0/111.32e0 AND 70e0+2500e0/111.32e0"),
    "spatial_range_strict_box",
)(lambda spark, d: _shown(spatial.radius(geo(spark, d), "lon", "lat", 10.0, 70.0, 2500, ["c_custkey"], mode="strict_box", keep=True)))
query(f"SELECT c_custkey, round({_km(1.0, 2.0)}, 6) AS km FROM {GEO} ORDER BY {_km(1.0, 2.0)}, c_custkey LIMIT 10", "spatial_knn")(lambda spark, d: _shown(spatial.nearest(geo(spark, d), "lon", "lat", 1.0, 2.0, 10, ["c_custkey"], keep=True)))
query(f"SELECT c_custkey FROM {GEO} WHERE lon + 90e0 BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90", "spatial_valid")(lambda spark, d: geo(spark, d).filter(valid_point(F.col("lat"), F.col("lon") + 90.0)).select("c_custkey"))
query("SELECT * FROM customer WHERE concat_ws('_', c_name, c_mktsegment) = 'Customer#000000042_FURNITURE'", "spatial_key_lookup")(lambda spark, d: table(spark, d, "customer").filter(spatial.place_key(F.col("c_name"), F.col("c_mktsegment")) == "Customer#000000042_FURNITURE"))
query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1", "load_first_wins")(lambda spark, d: prepare.first_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey"))
query("SELECT p_partkey AS id, p_name AS name, p_type AS category, p_retailprice AS price FROM part", "prep_select_rename")(lambda spark, d: prepare.pick(table(spark, d, "part"), (("p_partkey", "id"), ("p_name", "name"), ("p_type", "category"), ("p_retailprice", "price"))))
query("SELECT p_retailprice AS price, array_to_string(list_sort(list(p_partkey)), ',') AS ids FROM part GROUP BY 1", "price_to_ids")(
    lambda spark, d: prepare.ids_by(table(spark, d, "part").select(F.col("p_retailprice").alias("price"), "p_partkey"), "price", "p_partkey").withColumn("ids", F.concat_ws(",", F.col("ids").cast("array<string>")))
)

_PRICED = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '$' || p_size || '.50' WHEN 1 THEN '$1,2' || p_size || '.00' WHEN 2 THEN '$' || p_size || '.00 - $' || (p_size + 5) || '.00' WHEN 3 THEN '' WHEN 4 THEN 'abc' ELSE ' ' || p_size || ' ' END AS p FROM part"


def _priced(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    forms = [F.concat(F.lit("$"), s, F.lit(".50")), F.concat(F.lit("$1,2"), s, F.lit(".00")), F.concat(F.lit("$"), s, F.lit(".00 - $"), (F.col("p_size") + 5).cast("string"), F.lit(".00")), F.lit(""), F.lit("abc"), F.concat(F.lit(" "), s, F.lit(" "))]
    p = F.element_at(F.array(*forms), (F.col("p_partkey") % 6).cast("int") + 1)
    return table(spark, d, "part").select("p_partkey", p.alias("p"))


query(f"SELECT p_partkey, coalesce(try_cast(regexp_extract(trim(replace(p, '$', '')), '^\\S+') AS DOUBLE), 0e0) AS price FROM ({_PRICED})", "price_clean_online")(lambda spark, d: _priced(spark, d).select("p_partkey", price_online(F.col("p")).alias("price")))
query(f"SELECT p_partkey, coalesce(try_cast(trim(list_extract(string_split(replace(replace(p, '$', ''), ',', ''), '-'), -1)) AS DOUBLE), 0e0) AS price FROM ({_PRICED})", "price_clean_offline")(lambda spark, d: _priced(spark, d).select("p_partkey", price_offline(F.col("p")).alias("price")))


_FIRST_200 = "list_max(list_filter(range(0, 201), lambda k: strlen(left(t, k)) <= 200))"


@query(f"""SELECT doc_id, regexp_replace(CASE WHEN strlen(t) > 200 AND strlen(left(t, n)) < 200 THEN left(t, n) || chr(65533) ELSE left(t, n) END, '^\\s+|\\s+$', '', 'g') AS text
 FROM (SELECT doc_id, t, {_FIRST_200} AS n FROM (SELECT doc_id, coalesce(left(text, 201), '') AS t FROM documents))""")
def varchar_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", varchar(F.col("text"), 200).alias("text"))


_WIDTH = "CASE WHEN length({0}) > 100 THEN 200 WHEN length({0}) > 50 THEN 100 WHEN length({0}) > 30 THEN 50 ELSE 30 END"


@query(f"""WITH f AS (SELECT coalesce(name, '') AS name, coalesce(category, '') AS category, coalesce(image, '') AS image, coalesce(description, '') AS description FROM productos ORDER BY id, fila LIMIT 1)
 SELECT 0 AS position, 'id' AS name, 'VARCHAR' AS type, 32 AS width UNION ALL SELECT 1, 'name', 'VARCHAR', {_WIDTH.format('name')} FROM f UNION ALL SELECT 2, 'category', 'VARCHAR', {_WIDTH.format('category')} FROM f
 UNION ALL SELECT 3, 'price', 'FLOAT', NULL UNION ALL SELECT 4, 'image', 'VARCHAR', {_WIDTH.format('image')} FROM f UNION ALL SELECT 5, 'description', 'VARCHAR', {_WIDTH.format('description')} FROM f""")
def infer_schema(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "productos").orderBy("id", "fila").select("id", "name", "category", F.col("price").cast("string").alias("price"), "image", "description")
    rows = [(i, c.name, c.type, c.width) for i, c in enumerate(infer(t))]
    return spark.createDataFrame(rows, "position int, name string, type string, width int")


query("SELECT p_partkey, substr(lpad(bin(CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 3) AS INTEGER)), 12, '0'), 1, 10) AS bucket FROM part", "hash_bucket")(lambda spark, d: table(spark, d, "part").select("p_partkey", key_prefix(F.col("p_partkey"), 10).alias("bucket")))

# Below, statements run on tables of an engine in a folder of their own.


def _engine(spark: SparkSession, **options) -> Engine:
    return Engine(spark, shared_folder(spark, "warehouse"), **options)


def _load(engine: Engine, name: str, rows: DataFrame, index: str) -> Engine:
    """Write ``rows`` as a CSV file and create a table from it."""
    path = shared_folder(engine.spark, "export")
    prepare.write_csv(rows, path)
    _ok(engine.sql(f'CREATE TABLE {name} FROM FILE "{path}" USING INDEX {index}'))
    return engine


def _ok(r: Result, status: int = 200) -> Result:
    if r.status != status:
        raise EngineError(r.status, r.message)
    return r


def _double(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.col("price").cast("double"))


def _parts(spark: SparkSession, d: str, index: str = "bplustree(price)") -> Engine:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))
    return _load(_engine(spark), "t_part", rows, index)


_PARTS = "(SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS category, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS price FROM part)"


def _orders(spark: SparkSession, d: str, index: str = "bplustree(price)") -> Engine:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("date"))
    return _load(_engine(spark), "t_orders", rows, index)


_ORDERS = "(SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS priority, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS price, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS date FROM orders)"


def _after(engine: Engine, name: str, *statements: str, status: int = 200) -> DataFrame:
    """All rows after the statements, each of which must end with ``status``."""
    for text in statements:
        _ok(engine.sql(text), status)
    return _ok(engine.sql(f"SELECT * FROM {name}")).df


_NEW = 'INSERT INTO t_orders VALUES ("{}", "{}", {}, "1999-01-01")'
query(f"SELECT * FROM {_PARTS}", "scan_all")(lambda spark, d: _double(_after(_parts(spark, d), "t_part")))
query(f"SELECT * FROM {_PARTS} WHERE price BETWEEN 95e1 AND 96e1", "load_and_range")(lambda spark, d: _double(_ok(_parts(spark, d).sql("SELECT * FROM t_part WHERE price BETWEEN 950 AND 960")).df))
query(f"SELECT * FROM {_PARTS} WHERE name BETWEEN 'cold' AND 'hot'", "isam_range")(lambda spark, d: _double(_ok(_parts(spark, d, "isam(name)").sql('SELECT * FROM t_part WHERE name BETWEEN "cold" AND "hot"')).df))
query(f"SELECT * FROM {_PARTS} WHERE id = '77'", "hash_lookup")(lambda spark, d: _double(_ok(_parts(spark, d, "hash(id)").sql('SELECT * FROM t_part WHERE id = "77"')).df))
query(f"SELECT * FROM {_PARTS} WHERE id BETWEEN '40' AND '60'", "hash_range")(lambda spark, d: _double(_ok(_parts(spark, d, "hash(id)").sql('SELECT * FROM t_part WHERE id BETWEEN "40" AND "60"')).df))
query(f"SELECT * FROM {_ORDERS} WHERE id NOT IN ('10', '20', '30')", "scan_live")(lambda spark, d: _double(_after(_orders(spark, d), "t_orders", *[f'DELETE FROM t_orders WHERE id = "{i}"' for i in (10, 20, 30)])))
query(f"SELECT * FROM {_ORDERS} UNION ALL SELECT '-1', 'INSERTED', 130e0, '1999-01-01'", "insert_visible")(lambda spark, d: _double(_after(_orders(spark, d), "t_orders", _NEW.format(-1, "INSERTED", 130))))
query(f"SELECT * FROM {_ORDERS}", "insert_duplicate_rejected")(lambda spark, d: _double(_after(_orders(spark, d), "t_orders", _NEW.format(1, "TWICE", 1), status=400)))
query(f"SELECT * FROM {_ORDERS} WHERE id <> '1' UNION ALL SELECT '1', 'AGAIN', 2e0, '1999-01-01'", "reinsert_after_delete")(lambda spark, d: _double(_after(_orders(spark, d), "t_orders", 'DELETE FROM t_orders WHERE id = "1"', _NEW.format(1, "AGAIN", 2))))
query(f"SELECT * FROM {_ORDERS} WHERE id <> '1'", "delete_by_id")(lambda spark, d: _double(_after(_orders(spark, d), "t_orders", 'DELETE FROM t_orders WHERE id = "1"')))


@query("SELECT * FROM (VALUES ('missing row', 404), ('wrong column', 400), ('unknown table', 400), ('wrong count', 400)) t(what, status)")
def delete_missing(spark: SparkSession, d: str) -> DataFrame:
    engine = _orders(spark, d)
    said = [("missing row", 'DELETE FROM t_orders WHERE id = "-5"'), ("wrong column", 'DELETE FROM t_orders WHERE price = "5"'), ("unknown table", 'DELETE FROM nowhere WHERE id = "5"'), ("wrong count", 'INSERT INTO t_orders VALUES ("9")')]
    return spark.createDataFrame([(what, engine.sql(text).status) for what, text in said], "what string, status int")


@query(f"SELECT * FROM {_ORDERS} WHERE id NOT IN ('5', '6') UNION ALL SELECT '-2', 'LATE', 7e0, '1999-01-01'")
def compact_sorted(spark: SparkSession, d: str) -> DataFrame:
    engine = _orders(spark, d)
    _after(engine, "t_orders", 'DELETE FROM t_orders WHERE id = "5"', _NEW.format(-2, "LATE", 7), 'DELETE FROM t_orders WHERE id = "6"')
    engine.compact("t_orders")
    return _double(_after(engine, "t_orders"))


@query("SELECT count(*) - 1 AS n FROM orders")
def live_count(spark: SparkSession, d: str) -> DataFrame:
    engine = _orders(spark, d)
    _ok(engine.sql('DELETE FROM t_orders WHERE id = "3"'))
    return spark.createDataFrame([(engine.count("t_orders"),)], "n long")


@query(f"SELECT * FROM {_ORDERS} WHERE id <> '4'")
def catalog_restart(spark: SparkSession, d: str) -> DataFrame:
    """A new engine finds the tables of an earlier one, also by their names in Spark SQL."""
    before = _orders(spark, d)
    _ok(before.sql('DELETE FROM t_orders WHERE id = "4"'))
    spark.catalog.dropTempView("t_orders")
    Engine(spark, before.storage.root)
    return _double(spark.table("t_orders"))


@query("SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS name, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS price FROM customer UNION ALL SELECT -7, 'Nobody', 25e-1")
def create_columns(spark: SparkSession, d: str) -> DataFrame:
    engine = _engine(spark)
    _ok(engine.sql("CREATE TABLE t_customer (id INT, name VARCHAR[30], price FLOAT)"))
    engine.bulk_append("t_customer", table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("price")))
    return _double(_after(engine, "t_customer", 'INSERT INTO t_customer VALUES (-7, "Nobody", 2.5)'))


def _stored_places(spark: SparkSession, d: str) -> Engine:
    rows = geo(spark, d).select(F.col("c_name").alias("city"), F.col("c_mktsegment").alias("country"), F.col("lat").alias("lat"), F.col("lon").alias("lng"))
    return _load(_engine(spark), "t_places", rows, "rtree(latitude, longitude)")


def _named(df: DataFrame) -> DataFrame:
    return df.select("name", "country", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), "population")


_PLACES = f"(SELECT c_name AS name, c_mktsegment AS country, lat AS latitude, lon AS longitude, '0' AS population FROM (SELECT * FROM {GEO}))"
_NEAR = _km(10.0, 45.0).replace("lat)", "latitude)").replace("radians(lon)", "radians(longitude)")
_GONE = 'DELETE FROM t_places WHERE key = "Customer#000000042_FURNITURE"'  # not in every table: 404 is an answer too
query(f"SELECT * FROM {_PLACES}", "load_places")(lambda spark, d: _named(_after(_stored_places(spark, d), "t_places")))
query(f"SELECT * FROM {_PLACES} WHERE {_NEAR} <= 1500", "stored_range")(lambda spark, d: _named(_ok(_stored_places(spark, d).sql("SELECT * FROM t_places WHERE RANGE((10, 45), 1500)")).df))
query(f"SELECT * FROM {_PLACES} ORDER BY {_NEAR}, name LIMIT 10", "stored_knn")(lambda spark, d: _named(_ok(_stored_places(spark, d).sql("SELECT * FROM t_places WHERE KNN((10, 45), 10)")).df))
query("SELECT * FROM (VALUES ('a', 400), ('b', 200), ('b', 400), ('c', 400)) t(name, status)", "spatial_insert_rejects")(
    lambda spark, d: spark.createDataFrame([(n, e.sql(f'INSERT INTO t_places VALUES ("{n}", "x", {lat}, {lon}, 0)').status) for e in [_stored_places(spark, d)] for n, lon, lat in (("a", 181, 0), ("b", 10, 5), ("b", 11, 5), ("c", 0, -91))], "name string, status int")
)


@query(f"SELECT * FROM {_PLACES} WHERE NOT (name = 'Customer#000000042' AND country = 'FURNITURE')")
def delete_by_key(spark: SparkSession, d: str) -> DataFrame:
    engine = _stored_places(spark, d)
    engine.sql(_GONE)
    return _named(_after(engine, "t_places"))


@query(f"SELECT * FROM {_PLACES} UNION ALL SELECT name, country, latitude, longitude + 90e0, population FROM {_PLACES} WHERE longitude + 90e0 <= 180")
def spatial_bulk_append(spark: SparkSession, d: str) -> DataFrame:
    engine = _stored_places(spark, d)
    more = geo(spark, d).select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("country"), F.col("lat").alias("latitude"), (F.col("lon") + 90.0).alias("longitude"), F.lit("0").alias("population"))
    engine.bulk_append("t_places", more)
    return _named(_after(engine, "t_places"))


@query(f"SELECT *, name = 'Customer#000000042' AND country = 'FURNITURE' AS eliminado FROM {_PLACES}")
def scan_with_deleted(spark: SparkSession, d: str) -> DataFrame:
    engine = _stored_places(spark, d)
    engine.sql(_GONE)
    rows = engine.scan("t_places", include_deleted=True, include_deleted_flag=True)
    return _named(rows.withColumn("name", F.struct("name", "eliminado"))).select(F.col("name.name").alias("name"), "country", "latitude", "longitude", "population", F.col("name.eliminado").alias("eliminado"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS category, CAST(p_size + 5 AS DOUBLE) AS price FROM part")
def export_sinks(spark: SparkSession, d: str) -> DataFrame:
    """A raw export, prepared, written as CSV and from there as JSON, and read again."""
    size = F.col("p_size").cast("string")
    raw = table(spark, d, "part").select(F.col("p_partkey").alias("Uniq Id"), F.col("p_name").alias("Product Name"), F.col("p_type").alias("Category"), F.concat(F.lit("$"), size, F.lit(" - $"), (F.col("p_size") + 5).cast("string")).alias("Selling Price"), F.lit("a, b").alias("Image"), F.lit('two\n"lines"').alias("About Product"))
    csv, json = shared_folder(spark, "csv"), shared_folder(spark, "json")
    prepare.write_csv(prepare.prepare_export(raw), csv)
    prepare.write_json(read_csv(spark, csv), json)
    return spark.read.schema("id string, name string, category string, price string").json(json).withColumn("price", F.col("price").cast("double"))


__all__ = ["ORACLES", "QUERIES"]

import csv
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tesela.functions.values import key_prefix, price_offline, price_online, varchar
from tesela.operators.spatial import nearest, radius
from tesela.plans.ast import EngineError
from tesela.session import Engine

HEAD = ["id", "name", "category", "price", "image", "description"]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "w"))


@pytest.fixture
def products(engine, tmp_path):
    path = tmp_path / "p.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(HEAD)
        w.writerow(["k1", " Skate, \"best\" ", "Toys", "$129.99", "", "two\nlines"])
        w.writerow(["k2", "Cup", "Home", "$10.00 - $20.00", "", ""])
        w.writerow(["k1", "Second", "Toys", "1", "", ""])
        w.writerow(["k3", "Cup", "Home", "abc", "", ""])
    r = engine.sql(f'CREATE TABLE P FROM FILE "{path}" USING INDEX bplustree(price)')
    assert (r.status, r.rows_skipped) == (200, 1)
    return engine


def ids(result):
    return sorted(r["id"] for r in result.rows())


def test_load_and_select(products):
    assert ids(products.sql("SELECT * FROM P")) == ["k1", "k2", "k3"]
    row = products.sql('SELECT * FROM P WHERE id = "k1"').rows()[0]
    assert row["name"] == 'Skate, "best"' and row["description"] == "two\nlines"
    assert ids(products.sql("SELECT * FROM P WHERE name = Cup")) == ["k2", "k3"]
    assert ids(products.sql("SELECT * FROM P WHERE price BETWEEN 10 AND 130")) == ["k1", "k2"]
    assert ids(products.sql("SELECT * FROM P WHERE price BETWEEN 130 AND 10")) == []
    assert ids(products.sql("SELECT * FROM P WHERE price = 129.99")) == []  # stored as a 32-bit number
    assert ids(products.sql('SELECT * FROM P WHERE price = "10"')) == ["k2"]
    assert ids(products.sql('SELECT * FROM P WHERE key = "k3"')) == ["k3"]


def test_insert_and_delete(products):
    new = 'INSERT INTO P VALUES ("n1", "Skateboard", "Sports", 130.00, "", "")'
    assert products.sql(new).status == 200
    assert "n1" in ids(products.sql("SELECT * FROM P WHERE price BETWEEN 129 AND 130"))
    assert products.sql(new).status == 400
    assert products.sql('DELETE FROM P WHERE name = "Cup"').status == 400
    assert products.sql('DELETE FROM P WHERE id = "n1"').status == 200
    assert products.sql('DELETE FROM P WHERE id = "n1"').status == 404
    assert products.sql(new).status == 200
    before = ids(products.sql("SELECT * FROM P"))
    products.compact("P")
    assert ids(products.sql("SELECT * FROM P")) == before and products.count("P") == 4


def test_statuses(products, spark):
    for text in ["SELECT * FROM nope", "INSERT INTO nope VALUES (1)", "DELETE FROM nope WHERE id = 1", "INSERT INTO P VALUES (1)", "SELECT * FROM P WHERE nope = 1", "SELECT * FROM P WHERE name BETWEEN 1 AND 2", "SELECT * FROM P WHERE price BETWEEN a AND b", "SELECT * FROM P WHERE KNN((0,0),1)", "CREATE TABLE P (id INT)", "garbage"]:
        assert products.sql(text).status == 400, text
    again = Engine(spark, products.storage.root)
    assert ids(again.sql("SELECT * FROM P")) == ["k1", "k2", "k3"]


def test_declared(engine):
    assert engine.sql("CREATE TABLE R (id INT, precio FLOAT)").status == 200
    assert engine.sql("SELECT * FROM R").rows() == []
    assert engine.sql("INSERT INTO R VALUES (7.9, 2.5)").status == 200
    assert engine.sql("SELECT * FROM R WHERE id = 7").rows()[0]["precio"] == 2.5


def test_places(engine, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("Country,City,Latitude,Longitude\nes,a,0,179.99\nes,b,0,-179.99\nes,c,10,0\nes,d,91,0\nes,a,1,1\n")
    assert engine.sql(f'CREATE TABLE C FROM FILE "{path}" USING INDEX rtree(Latitude, Longitude)').rows_skipped == 1
    near = [r["City"] for r in engine.sql("SELECT * FROM C WHERE RANGE((-180, 0), 50)").rows()]
    assert sorted(near) == ["a", "b"]
    assert [r["City"] for r in engine.sql("SELECT * FROM C WHERE KNN((0, 10.1), 1)").rows()] == ["c"]
    assert engine.sql("SELECT * FROM C WHERE KNN((0, 0), 0)").rows() == []
    assert engine.sql("SELECT * FROM C WHERE KNN((0, 0), -1)").status == 400
    assert engine.sql("SELECT * FROM C WHERE KNN((500, 0), 3)").rows() == []
    assert engine.sql('INSERT INTO C VALUES (es, z, 95, 0)').status == 400
    assert engine.sql('INSERT INTO C VALUES (es, a, 5, 0)').status == 400
    assert engine.sql('DELETE FROM C WHERE key = "a_es"').status == 200
    assert engine.sql("SELECT * FROM C WHERE key = a_es").rows()[0]["Latitude"] == "1"
    assert engine.sql('DELETE FROM C WHERE id = "a_es"').status == 400


def test_values(spark):
    df = spark.createDataFrame([("$10.00",), ("$1,265.00",), ("$10.00 - $20.00",), ("",), ("abc",), ("1e3",), ("  ",), (None,)], "p string")
    got = df.select(price_online(F.col("p")), price_offline(F.col("p"))).collect()
    assert [r[0] for r in got] == [10, 0, 10, 0, 0, 1000, 0, 0]
    assert [r[1] for r in got][:5] == [10, 1265, 20, 0, 0]
    assert spark.createDataFrame([("abcñx",)], "s string").select(varchar(F.col("s"), 4)).first()[0] == "abc�"


def test_nested_searches(spark):
    df = spark.range(400).select(F.col("id"), ((F.col("id") * 37) % 360 - 180).cast("double").alias("lon"), ((F.col("id") * 53) % 180 - 90).cast("double").alias("lat"))
    def near(k): return [r["id"] for r in nearest(df, "lon", "lat", 3, 4, k, ["id"]).collect()]
    assert near(11)[:10] == near(10)
    def inside(km): return {r["id"] for r in radius(df, "lon", "lat", 3, 4, km, ["id"]).collect()}
    assert inside(1000) <= inside(3000)


def test_places_file_with_other_headers(engine, tmp_path):
    path = tmp_path / "places.csv"
    path.write_text("city,lat,lng,country\nA,1.0,2.0,X\nB,50.0,60.0,Y\n")
    r = engine.sql(f'CREATE TABLE L FROM FILE "{path}" USING INDEX rtree(latitude, longitude)')
    assert (r.status, r.rows_skipped) == (200, 0)
    got = engine.sql("SELECT * FROM L WHERE RANGE((2.0, 1.0), 10)").rows()
    assert [(x["name"], x["latitude"], x["longitude"], x["country"]) for x in got] == [("A", "1.0", "2.0", "X")]
    assert engine.sql(f'CREATE TABLE M FROM FILE "{path}" USING INDEX rtree(lat, lng)').status == 200
    assert engine.sql(f'CREATE TABLE N FROM FILE "{path}" USING INDEX rtree(x, y)').status == 400


def _numbered(engine, spark, n=40, name="T"):
    assert engine.sql(f"CREATE TABLE {name} (id INT, price FLOAT)").status == 200
    assert engine.bulk_append(name, spark.range(n).select(F.col("id").cast("int").alias("id"), F.lit(1.5).cast("float").alias("price"))) == n


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "w"))
    _numbered(engine, spark)
    def dead(s): raise RuntimeError("killed")
    with monkeypatch.context() as m:
        m.setattr(engine.storage, "swap", dead)
        with pytest.raises(RuntimeError):
            engine.bulk_append("T", spark.createDataFrame([(99, 1.0)], "id int, price float"))
    assert engine.count("T") == 40
    assert engine.sql("INSERT INTO T VALUES (100, 1)").status == 200 and engine.sql("DELETE FROM T WHERE id = 100").status == 200
    assert ids(engine.sql("SELECT * FROM T")) == list(range(40))


def test_a_stale_lock_is_taken_over_and_a_lost_one_stops_the_writer(tmp_path):
    from tesela.sources.storage import Lock

    stale = tmp_path / "l"
    stale.write_text("someone")
    os.utime(stale, (1, 1))
    with Lock(str(stale), wait=1) as mine:
        assert mine.held()
        with pytest.raises(EngineError):
            Lock(str(stale), wait=0.1).__enter__()
        stale.write_text("a thief")
        assert not mine.held()
    assert stale.exists()


def test_merges_leave_the_base_and_purges_only_touched_files(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "w"), compact_after=3)
    _numbered(engine, spark, 20_000)
    engine.compact("T")
    base = engine.storage.state("T").bases
    for i in range(5):
        assert engine.sql(f"INSERT INTO T VALUES ({100_000 + i}, 2)").status == 200
    s = engine.storage.state("T")
    assert s.bases == base and len(s.deltas) <= 3 and engine.count("T") == 20_005
    for i in range(25):
        assert engine.sql(f"DELETE FROM T WHERE id = {i}").status == 200
    s = engine.storage.state("T")
    dropped = sum(len(p.dropped) for p in (*s.bases, *s.deltas))
    files = sum(f.endswith(".parquet") for p in base for f in os.listdir(os.path.join(engine.storage.root, "T", p.folder)))
    assert s.deleted == () and 0 < dropped <= 25 and (files == 1 or dropped < files)
    assert ids(engine.sql("SELECT * FROM T")) == [*range(25, 20_000), *range(100_000, 100_005)]


def test_views_follow_changes_and_deleted_rows_are_told(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "w"))
    _numbered(engine, spark, 3, "Seen")
    engine.sql("INSERT INTO Seen VALUES (7, 1)")
    engine.sql("DELETE FROM Seen WHERE id = 1")
    assert spark.table("Seen").columns == ["id", "price"] and sorted(r["id"] for r in spark.table("Seen").collect()) == [0, 2, 7]
    told = {r["id"]: r["eliminado"] for r in engine.scan("Seen", include_deleted=True, include_deleted_flag=True).collect()}
    assert told == {0: False, 1: True, 2: False, 7: False}


def test_hash_layout_writes_bloom_filters(engine, spark, tmp_path):
    spark.range(500).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("3").alias("price")).write.option("header", True).csv(str(tmp_path / "h"))
    assert engine.sql(f'CREATE TABLE H FROM FILE "{tmp_path}/h" USING INDEX hash(id)').status == 200
    assert ids(engine.sql('SELECT * FROM H WHERE id = "k77"')) == ["k77"]
    assert engine.sql(f'CREATE TABLE I FROM FILE "{tmp_path}/h" USING INDEX hash(nope)').status == 400
    assert spark.createDataFrame([("a",), ("",)], "k string").select(key_prefix(F.col("k"), 9)).first()[0] == bin(int(hashlib.md5(b"a").hexdigest(), 16))[2:].zfill(128)[:9]


def test_a_circle_skips_most_row_groups(engine, spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from tesela.sources import storage
    monkeypatch.setattr(storage, "SPATIAL_ROW_GROUP", 64 << 10)
    n = 100_000
    lon, lat = (F.col("id") * 7919 % 36000) / 100 - 180, (F.col("id") * 104729 % 17999) / 100 - 90
    assert engine.sql("CREATE TABLE G (name TEXT, latitude FLOAT, longitude FLOAT)").status == 200
    places = spark.range(n).select(F.concat(F.lit("p"), "id").alias("name"), lat.alias("latitude"), lon.alias("longitude"))
    places.write.option("header", True).csv(str(tmp_path / "g"))
    assert engine.sql(f'CREATE TABLE W FROM FILE "{tmp_path}/g" USING INDEX rtree(latitude, longitude)').status == 200
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    r = engine.sql("SELECT * FROM W WHERE RANGE((10, 45), 200)")
    want = radius(places.withColumn("k", F.lit(1)), "longitude", "latitude", 10, 45, 200, ["name"]).count()
    assert len(r.rows()) == want > 0
    plan = r.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(__lat" in plan and "LessThanOrEqual(__lon" in plan
    s = engine.storage.state("W")
    at, groups, read = os.path.join(engine.storage.root, "W", s.bases[0].folder), 0, 0
    for f in os.listdir(at):
        if f.endswith(".parquet"):
            m = pq.ParquetFile(os.path.join(at, f)).metadata
            names = [m.schema.column(i).name for i in range(m.num_columns)]
            for g in range(m.num_row_groups):
                x, y = (m.row_group(g).column(names.index(c)).statistics for c in ("__lon", "__lat"))
                groups += 1
                read += x.min <= 13 and x.max >= 7 and y.min <= 47 and y.max >= 43
    assert groups >= 40 and read <= 0.1 * groups, (read, groups)

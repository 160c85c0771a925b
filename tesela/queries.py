"""The core queries of the driver contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela import table_queries
from tesela.functions.geo import latitude, longitude
from tesela.operators import bad_rows, nearby, packed_fields
from tesela.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"category": packed_fields.CATEGORY, "image": packed_fields.IMAGE}
    return packed_fields.unpack(table(spark, d, "productos"), kinds, ["fila"], least=2)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.errors(table(spark, d, "lineas_crudas"), "raw_line", "line_id").select("line_id").distinct()


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    found = bad_rows.errors(table(spark, d, "lineas_crudas"), "raw_line", "line_id")
    return found.select("line_id", F.concat_ws("; ", "reasons").alias("reasons"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    clean, _ = bad_rows.judge(table(spark, d, "lineas_crudas"), "raw_line", "line_id")
    return bad_rows.products(clean)


def _places(spark: SparkSession, d: str) -> DataFrame:
    cities = table(spark, d, "ciudades").withColumn("lat", latitude(F.col("latitude"))).withColumn("lon", longitude(F.col("longitude")))
    one = nearby.latest(cities, "geo_id", "loaded_at", "lat", "lon")
    return one.filter("lat is not null and lon is not null and not (lat = 0 and lon = 0)")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = nearby.pairs(_places(spark, d), 3.0, key="geo_id")
    return found.select(F.col("a").alias("geo_a"), F.col("b").alias("geo_b"))


def p6_regions(spark: SparkSession, d: str) -> DataFrame:
    """The locations in a box around the first location of each region."""
    places = _places(spark, d)
    named = table(spark, d, "ciudades").filter("region is not null and geo_id is not null").groupBy("region").agg(F.min("geo_id").alias("geo_id"))
    boxes = named.join(places, "geo_id").select("region", (F.col("lat") - 1).alias("south"), (F.col("lon") - 1.5).alias("west"), (F.col("lat") + 1).alias("north"), (F.col("lon") + 1.5).alias("east"))
    return nearby.containing(places, boxes, point_key="geo_id", box_key="region").select(F.col("box").alias("region"), F.col("point").alias("geo_id"))


_FIELD = r"""(?:"[^"]*(?:""[^"]*)*"|[^",\r\n]*)"""
_NUMBER = "([0-9]+([.,][0-9]*)?|[.,][0-9]+)"


def _degrees(column: str, letters: str, negative: str, limit: int) -> str:
    text = f"upper(trim({column}))"
    bare = f"try_cast(replace(regexp_extract({text}, '{_NUMBER}'), ',', '.') AS DOUBLE)"
    sign = f"CASE WHEN {text} LIKE '-%' OR regexp_matches({text}, '[{negative}]$') THEN -1 ELSE 1 END"
    good = f"regexp_matches({text}, '^([+-]?\\s*{_NUMBER}|{_NUMBER}\\s*[{letters}])$') AND {bare} <= {limit}"
    return f"CASE WHEN {good} THEN {bare} * {sign} END"


# A record as SQL reads it: the whole fields at its start, each with its comma, and what is left.
_RECORDS = f"""
WITH u AS (SELECT *, regexp_full_match(coalesce(raw_line, ''), '{_FIELD}(,{_FIELD})*', 's') AND raw_line IS NOT NULL AS shaped, regexp_extract(raw_line, '^(?:{_FIELD},)*') AS start FROM lineas_crudas),
 w AS (SELECT *, shaped AND len(regexp_extract_all(start, '{_FIELD},')) = 5 AS good, substr(raw_line, length(start) + 1) AS rest FROM u)"""
_STRUCTURE = r"""CASE WHEN raw_line IS NULL THEN 'null record' WHEN shaped AND NOT good THEN 'column count' WHEN shaped THEN NULL
 WHEN rest LIKE '"%' THEN CASE WHEN regexp_matches(rest, '^"[^"]*(?:""[^"]*)*"') THEN 'text after closing quote' ELSE 'quote not closed' END
 WHEN regexp_matches(rest, '^[^,"\r\n]*"') THEN 'quote in unquoted field' ELSE 'line break in unquoted field' END"""


def _cell(i: int) -> str:
    text = f"regexp_extract(raw_line, '^(?:{_FIELD},){{{i}}}({_FIELD})', 1)"
    return f"""CASE WHEN {text} LIKE '"%' THEN replace({text}[2:-2], '""', '"') ELSE {text} END"""


_PRICED = f"regexp_full_match({_cell(3)}, '\\s*({bad_rows.AMOUNT}(\\s*-\\s*{bad_rows.AMOUNT})?)?\\s*')"

_PLACES = f"""WITH c AS (SELECT geo_id, {_degrees("latitude", "NS", "S", 90)} AS lat, {_degrees("longitude", "EWO", "WO", 180)} AS lon, loaded_at FROM ciudades WHERE geo_id IS NOT NULL),
 p AS (SELECT geo_id, arg_max(lat, loaded_at) AS lat, arg_max(lon, loaded_at) AS lon FROM c WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) GROUP BY geo_id)"""

QUERIES = {**table_queries.QUERIES, **{f.__name__: f for f in (p1_found, p4_found, p4_reasons, p4_clean, p6_found, p6_regions)}}
ORACLES: dict[str, str] = {
    **table_queries.ORACLES,
    "p4_found": f"""
WITH r AS (SELECT line_id, raw_line, regexp_full_match(coalesce(raw_line, ''), '{_FIELD}(,{_FIELD}){{5}}', 's') AND raw_line IS NOT NULL AS shaped,
 regexp_extract(raw_line, '^(?:{_FIELD},){{3}}({_FIELD}),', 1) AS price, regexp_extract(raw_line, '^(?:{_FIELD},){{5}}({_FIELD})$', 1) AS description FROM lineas_crudas)
SELECT DISTINCT line_id FROM r WHERE NOT coalesce(shaped
 AND regexp_full_match(CASE WHEN price LIKE '"%' THEN replace(price[2:-2], '""', '"') ELSE price END, '\\s*({bad_rows.AMOUNT}(\\s*-\\s*{bad_rows.AMOUNT})?)?\\s*')
 AND NOT regexp_matches(description, '[\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]'), false)""",
    "p4_reasons": f"""
{_RECORDS} SELECT DISTINCT line_id, concat_ws('; ', {_STRUCTURE},
 CASE WHEN good AND regexp_matches({_cell(5)}, '[\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') THEN 'invalid characters in description' END,
 CASE WHEN good AND NOT {_PRICED} THEN 'invalid price' END) AS reasons, raw_line AS r FROM w) SELECT line_id, reasons FROM v WHERE reasons <> ''""".replace("SELECT DISTINCT", ", v AS (SELECT DISTINCT", 1),
    "p4_clean": f"""
{_RECORDS} SELECT * EXCLUDE (raw_line, shaped, good, start, rest), {", ".join(f"{_cell(i)} AS {f}" for i, f in enumerate(bad_rows.PRODUCT_FIELDS) if f != "price")}, {_cell(3)} AS price_text,
 try_cast(regexp_replace(regexp_extract({_cell(3)}, '{bad_rows.AMOUNT}'), '[$,]', '', 'g') AS DOUBLE) AS price FROM w
 WHERE good AND {_PRICED} AND NOT regexp_matches({_cell(5)}, '[\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')""",
    "p6_found": f"""
{_PLACES}
SELECT a.geo_id AS geo_a, b.geo_id AS geo_b FROM p a JOIN p b ON a.geo_id < b.geo_id AND abs(a.lat - b.lat) < 0.03
WHERE 12742e0*asin(least(1e0,sqrt(pow(sin((radians(b.lat)-radians(a.lat))/2e0),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(b.lon)-radians(a.lon))/2e0),2)))) <= 3""",
    "p6_regions": f"""
{_PLACES}, r AS (SELECT region, p.lat, p.lon FROM (SELECT region, min(geo_id) AS geo_id FROM ciudades WHERE region IS NOT NULL GROUP BY 1) JOIN p USING (geo_id))
SELECT region, geo_id FROM p JOIN r ON p.lat BETWEEN r.lat - 1 AND r.lat + 1 AND p.lon BETWEEN r.lon - 15e-1 AND r.lon + 15e-1""",
}

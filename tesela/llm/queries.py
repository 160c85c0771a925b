"""The queries of the operators for training text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm import encoding, leaks, packing, same_product, terms, truncation
from tesela.runtime import table


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for field, source, of in (("category", "productos", terms.word_terms), ("country", "ciudades", terms.whole_term)):
        df = table(spark, d, source).select(field)
        counts = terms.term_counts(df, of(field))
        parts.append(terms.marks(counts, df.count()).select(F.lit(field).alias("field"), "term", "occurrences", "rows", "mark"))
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).filter(F.col("mark").isNotNull()).select("field", "term", "mark")


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(table(spark, d, "productos"), "seller", "fila", ("name", "description"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).filter(F.col("cause").isNotNull()).select(F.col("key").alias("fila"), "field")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_cuts(spark, d)).withColumnRenamed("source", "seller")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return same_product.pairs(same_product.placed(table(spark, d, "productos")))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return same_product.groups(table(spark, d, "productos"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), "doc_id").withColumnRenamed("key", "doc_id")


def _leaks(spark: SparkSession, d: str, tolerated: int) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "evaluacion"), "doc_id", "item_id", tolerated=tolerated)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, 0).filter(F.col("run") >= leaks.SPAN).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_tolerant(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, leaks.TOLERATED).filter(F.col("overlap") >= leaks.SPAN).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "run", "overlap", "substitutions")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired(table(spark, d, "documents"), "doc_id").filter("garbled").select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired(table(spark, d, "documents"), "doc_id").filter("garbled").select("doc_id", "restored", F.concat_ws("; ", "chains").alias("chains"), "lost")


QUERIES = {f.__name__: f for f in (p2_found, p2_terms, p3_found, p3_rates, p5_found, p5_groups, p7_containers, p8_found, p8_tolerant, p9_found, p9_restored)}
_TERMS = """
WITH t AS (SELECT 'category' AS field, row_number() OVER () AS r, unnest(regexp_extract_all(lower(category), '[\\p{L}\\p{N}]+')) AS term FROM productos
 UNION ALL SELECT 'country', row_number() OVER (), lower(regexp_replace(country, '^\\s+|\\s+$', '', 'g')) FROM ciudades),
 n AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT r) AS n FROM t WHERE term <> '' GROUP BY 1, 2),
 m AS (SELECT field, term, occurrences, n AS rows, CASE WHEN n < 3 THEN 'rare' WHEN n > 0.05e0 * (CASE field WHEN 'category' THEN (SELECT count(*) FROM productos) ELSE (SELECT count(*) FROM ciudades) END) THEN 'common' END AS mark FROM n)
"""
_GRAMS = "SELECT {id} AS id, unnest([array_to_string(w[i:i+12], ' ') FOR i IN range(1, len(w) - 11)]) AS g FROM (SELECT {id}, regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table})"
ORACLES: dict[str, str] = {
    "p2_found": f"{_TERMS} SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_terms": f"{_TERMS} SELECT field, term, occurrences, rows, mark FROM m",
    "p8_found": f"SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM ({_GRAMS.format(id='doc_id', table='documents')}) d JOIN ({_GRAMS.format(id='item_id', table='evaluacion')}) e USING (g)",
}

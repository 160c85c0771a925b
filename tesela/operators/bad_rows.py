"""Rows that fail to parse: good records become typed rows, the others keep their reasons.

A record is parsed into cells, the cells are exploded into (row, column, value), joined to a rule table, and every rule is
evaluated; the errors of a row are gathered and the clean rows are what is left by an anti-join.

Defined results: a null record fails with ``null record``; an empty record is one empty field and fails with
``column count``; rows that share an id but differ in text are judged apart; extra columns of the input are kept as they
are, and are prefixed with ``in_`` where they clash with a record field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AMOUNT = r"\$?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"


@dataclass(frozen=True)
class Rule:
    """``column`` must (``expect``) or must not match ``pattern``; column ``*`` stands for the record's structure."""

    column: str
    pattern: str
    expect: bool
    reason: str


PRODUCT_FIELDS = ("id", "name", "category", "price", "image", "description")
PRODUCT_RULES = (
    Rule("price", rf"^\s*(?:{AMOUNT}(?:\s*-\s*{AMOUNT})?)?\s*$", True, "invalid price"),
    Rule("description", "[\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", False, "invalid characters in description"),
    Rule("*", "^ok$", True, "structure"),
)

_QUOTED = re.compile(r'"([^"]*(?:""[^"]*)*)"')
_BREAK = re.compile(r'["\r\n]')


def parse_record(text: str | None, delimiter: str = ",") -> tuple[list[str], str]:
    """Cells of one record and ``ok`` or what is wrong with its structure; parsing stops at the first fault."""
    if text is None:
        return [], "null record"
    cells, at, end = [], 0, len(text)
    while True:
        if at < end and text[at] == '"':
            m = _QUOTED.match(text, at)
            if m is None:
                return cells, "quote not closed"
            cells.append(m.group(1).replace('""', '"'))
            at = m.end()
            if at < end and text[at] != delimiter:
                return cells, "text after closing quote"
        else:
            stop = text.find(delimiter, at)
            stop = end if stop < 0 else stop
            bad = _BREAK.search(text, at, stop)
            if bad:
                return cells, "quote in unquoted field" if bad.group() == '"' else "line break in unquoted field"
            cells.append(text[at:stop])
            at = stop
        if at >= end:
            return cells, "ok"
        at += 1


def _parser(width: int):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse_record(x) for x in pdf["__raw"].where(pdf["__raw"].notna(), None)]
            pdf["__cells"] = [c for c, _ in got]
            pdf["__state"] = [s if s != "ok" or len(c) == width else "column count" for c, s in got]
            yield pdf

    return parse


def parse_cells(df: DataFrame, raw: str, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with ``__cells`` (array) and ``__state``; columns of ``df`` are untouched."""
    schema = df.withColumn("__raw", F.col(raw).cast("string")).withColumn("__cells", F.array(F.lit(""))).withColumn("__state", F.lit("")).schema
    return df.withColumn("__raw", F.col(raw).cast("string")).mapInPandas(_parser(len(fields)), schema)


def _errors(parsed: DataFrame, key: str, fields: tuple[str, ...], rules: tuple[Rule, ...]) -> DataFrame:
    names = F.array(*[F.lit(f) for f in (*fields, "*")])
    # the structure is the last cell of a row, under the column "*"; cells of a broken record are not judged further
    cells = F.when(F.col("__state") == "ok", F.concat("__cells", F.array("__state"))).otherwise(F.concat(F.array_repeat(F.lit(None).cast("string"), len(fields)), F.array("__state")))
    exploded = parsed.select(F.col(key).alias("__key"), "__row", "__state", F.explode(F.arrays_zip(names.alias("column"), cells.alias("value"))).alias("cell")).select("__key", "__row", "__state", "cell.column", "cell.value")
    # the rule table is a fixed literal of a few rows; the patterns are constants, so that each is compiled once
    table = F.broadcast(parsed.sparkSession.createDataFrame([(i, r.column, r.reason) for i, r in enumerate(rules)], "rule int, column string, reason string"))
    keeps = F.lit(None).cast("boolean")
    for i, r in enumerate(rules):
        keeps = F.when(F.col("rule") == i, F.col("value").rlike(r.pattern) == F.lit(r.expect)).otherwise(keeps)
    broken = exploded.filter(F.col("value").isNotNull()).join(table, "column").filter(~keeps)
    reason = F.when(F.col("column") == "*", F.col("__state")).otherwise(F.col("reason"))
    return broken.groupBy("__key", "__row").agg(F.array_sort(F.collect_set(reason)).alias("reasons"))


def errors(df: DataFrame, raw: str, key: str, fields: tuple[str, ...] = PRODUCT_FIELDS, rules: tuple[Rule, ...] = PRODUCT_RULES) -> DataFrame:
    """(key, reasons) of the failed records; records with the same key and text come once."""
    parsed = parse_cells(df.select(key, raw), raw, fields).withColumn("__row", F.xxhash64("__raw"))
    return _errors(parsed, key, fields, rules).select(F.col("__key").alias(key), "reasons")


def judge(df: DataFrame, raw: str, key: str, fields: tuple[str, ...] = PRODUCT_FIELDS, rules: tuple[Rule, ...] = PRODUCT_RULES) -> tuple[DataFrame, DataFrame]:
    """(clean rows, failed rows) of the records in column ``raw``.

    Clean rows hold the other columns of ``df`` and one column for each field; failed rows hold the columns of ``df`` and
    ``reasons``, a sorted array. A row is known by ``key`` and its text together, so no null or repeated key mixes rows up.
    """
    parsed = parse_cells(df, raw, fields).withColumn("__row", F.xxhash64("__raw"))
    found = _errors(parsed, key, fields, rules)
    same = [F.col(f"p.`{key}`").eqNullSafe(F.col("e.__key")), F.col("p.__row") == F.col("e.__row")]
    clean = parsed.alias("p").join(found.alias("e"), same, "left_anti")
    kept = [F.col(f"`{c}`").alias(f"in_{c}" if c in fields else c) for c in df.columns if c != raw]
    clean = clean.select(*kept, *[F.element_at("__cells", i + 1).alias(f) for i, f in enumerate(fields)])
    failed = parsed.alias("p").join(found.alias("e"), same, "inner").select(*[F.col(f"p.`{c}`") for c in df.columns], "reasons")
    return clean, failed


def products(clean: DataFrame) -> DataFrame:
    """Clean product records with ``price`` as a number: an empty price is null, of a range the first amount counts."""
    first = F.regexp_replace(F.regexp_extract("price", AMOUNT, 0), "[$,]", "")
    return clean.withColumn("price_text", F.col("price")).withColumn("price", F.when(first != "", first.cast("double")))

"""Predicates to column expressions. Types are settled here, so that no implicit cast decides a comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.plans.ast import Between, EngineError, Equal, Literal


def _number(value: Literal, column: str) -> float:
    try:
        return float(value.value)
    except ValueError:
        raise EngineError(400, f"{column} holds numbers, not {value.value!r}") from None


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _text(value: Literal) -> str:
    return str(value.value).strip()


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _compared(c: Column, kind: T.DataType) -> Column:
    # stored text is trimmed already (it is trimmed on write), so the bare column can be pushed to the scan
    return c if isinstance(kind, T.StringType) else c.cast("string")


def equal(p: Equal, schema: T.StructType) -> Column:
    kind = _kind(schema, p.column)
    if _numeric(kind):
        return F.col(f"`{p.column}`").cast("double") == F.lit(_number(p.value, p.column))
    return _compared(F.col(f"`{p.column}`"), kind) == F.lit(_text(p.value))


def between(p: Between, schema: T.StructType) -> Column:
    kind = _kind(schema, p.column)
    if _numeric(kind):
        return F.col(f"`{p.column}`").cast("double").between(_number(p.low, p.column), _number(p.high, p.column))
    if "number" in (p.low.kind, p.high.kind):
        raise EngineError(400, f"{p.column} holds text, a bound is a number")
    return _compared(F.col(f"`{p.column}`"), kind).between(_text(p.low), _text(p.high))


def _kind(schema: T.StructType, column: str) -> T.DataType:
    if column not in schema.fieldNames():
        raise EngineError(400, f"no column {column}")
    return schema[column].dataType

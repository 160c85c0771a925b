"""Preparation of raw product exports, and the plain operators that tables offer beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.functions.values import price_offline

#: Columns of a raw export and the names they get (fixed values of that export).
EXPORT_COLUMNS = (("Uniq Id", "id"), ("Product Name", "name"), ("Category", "category"), ("Selling Price", "price"), ("Image", "image"), ("About Product", "description"))


def pick(df: DataFrame, columns: tuple[tuple[str, str], ...] = EXPORT_COLUMNS) -> DataFrame:
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in columns])


def prepare_export(df: DataFrame) -> DataFrame:
    return pick(df).withColumn("price", price_offline(F.col("price")))


def ids_by(df: DataFrame, by: str, ident: str, name: str = "ids") -> DataFrame:
    """All ids of each value, sorted. The list of a value is the result; a hot value makes a long list."""
    return df.groupBy(by).agg(F.sort_array(F.collect_list(ident)).alias(name))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: by min_by, which combines on the map side, so a hot key costs one row a task."""
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("__first"))
    return best.select(key, *[F.col(f"__first.`{c}`").alias(c) for c in cols]).select(*df.columns)


def range_sorted(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.filter(F.col(column).between(low, high)).orderBy(column)


def compacted(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``key``, which gives disjoint minima and maxima for each file."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    return ranged.sortWithinPartitions(key)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


__all__ = ["EXPORT_COLUMNS", "compacted", "first_wins", "ids_by", "pick", "prepare_export", "range_sorted", "write_csv", "write_json"]

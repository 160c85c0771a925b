"""CSV files as tables: reading, schema inference from the first row, and typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.functions.values import date_text, price_online, strip, varchar
from tesela.plans.ast import ColumnDef, EngineError

#: Other headers under which a cities file may have a column (fixed values of that format).
ALIASES = {"name": ("city", "name"), "latitude": ("lat", "latitude"), "longitude": ("lng", "longitude")}
#: Byte widths of product files loaded with ``profile="products"`` (fixed values of that profile).
PRODUCT_WIDTHS = {"name": 50, "category": 30, "image": 100, "description": 200}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quotes, doubled quotes and line breaks in fields as in any CSV; missing fields are empty."""
    options = dict(header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return spark.read.options(**options).csv(path).na.fill("")


def infer(df: DataFrame) -> tuple[ColumnDef, ...]:
    """Types from the header and the first row."""
    row = df.first()
    if row is None:
        raise EngineError(400, "the file has no rows")
    out = []
    for c in df.columns:
        low, n = c.lower(), len(row[c] or "")
        if low == "id":
            out.append(ColumnDef(c, "VARCHAR", 32))
        elif low == "price":
            out.append(ColumnDef(c, "FLOAT"))
        elif low == "date" or "fecha" in low:
            out.append(ColumnDef(c, "DATE"))
        else:
            out.append(ColumnDef(c, "VARCHAR", 200 if n > 100 else 100 if n > 50 else 50 if n > 30 else 30))
    return tuple(out)


def field(c: ColumnDef) -> T.StructField:
    kind = {"INT": T.IntegerType(), "FLOAT": T.FloatType()}.get(c.type, T.StringType())
    return T.StructField(c.name, kind, True, {"varchar_bytes": c.width} if c.width else {})


def typed(value: Column, c: ColumnDef, width: int | None = None) -> Column:
    """A text column as the table stores it."""
    if c.type == "INT":
        return F.coalesce(value.try_cast("double").cast("long").try_cast("int"), F.lit(0))
    if c.type == "FLOAT":
        return price_online(value).cast("float")
    if c.type == "DATE":
        return date_text(value)
    if c.type == "TEXT":
        return strip(F.coalesce(value, F.lit("")))
    return varchar(value, width or c.width or 30)


def load(df: DataFrame, columns: tuple[ColumnDef, ...], profile: str | None = None) -> DataFrame:
    widths = PRODUCT_WIDTHS if profile == "products" else {}
    return df.select(*[typed(F.col(f"`{c.name}`"), c, widths.get(c.name)).alias(c.name, metadata=field(c).metadata) for c in columns])


def places(df: DataFrame) -> DataFrame:
    """A cities file with its headers renamed to name, latitude and longitude; other columns stay.

    A name or country that the file lacks is ``Unknown``, a population that it lacks or leaves empty is 0.
    """
    have = {c.lower(): c for c in df.columns}
    for to, names in ALIASES.items():
        found = [have[n] for n in names if n in have]
        if found and to not in have:
            df = df.withColumnRenamed(found[0], to)
    for c in ("name", "country"):
        if c not in map(str.lower, df.columns):
            df = df.withColumn(c, F.lit("Unknown"))
    population = F.col(have["population"]) if "population" in have else F.lit("")
    return df.withColumn(have.get("population", "population"), F.when(strip(population) == "", "0").otherwise(population))

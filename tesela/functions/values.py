"""Cleaning of values as the tables store them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def price_online(c: Column) -> Column:
    """The first word without ``$`` as a number, else 0: ``$10 - $20`` is 10, ``$1,265.00`` is 0."""
    first = F.element_at(F.split(strip(F.replace(c, F.lit("$"), F.lit(""))), r"\s+"), 1)
    return F.coalesce(first.try_cast("double"), F.lit(0.0))


def price_offline(c: Column) -> Column:
    """Without ``$`` and thousands commas, of a range the last amount, else 0: ``$1,265.00`` is 1265, ``$10 - $20`` is 20."""
    bare = F.replace(F.replace(c, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    return F.coalesce(F.trim(F.element_at(F.split(bare, "-"), -1)).try_cast("double"), F.lit(0.0))


def varchar(c: Column, width: int) -> Column:
    """At most ``width`` bytes of UTF-8, a cut character as U+FFFD, without outer blanks; null as empty."""
    return F.coalesce(strip(F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, width).cast("string"))), F.lit(""))


def key_prefix(c: Column, bits: int) -> Column:
    """The first ``bits`` bits (at most 60) of a key's md5, as text of 0 and 1: the bucket of a key in a table of that depth."""
    digits = -(-bits // 4)
    binary = F.conv(F.substring(F.md5(c.cast("string")), 1, digits), 16, 2)
    return F.substring(F.lpad(binary, 4 * digits, "0"), 1, bits)


def date_text(c: Column) -> Column:
    """The first 10 characters; dates are kept as text and compare as text."""
    return F.coalesce(F.substring(c.cast("string"), 1, 10), F.lit(""))

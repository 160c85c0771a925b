"""How often every distinct term occurs, in how many rows, and whether it is too rare or too common to use.

Terms get dense integer ids from one global dictionary, in the order of the terms. Each block of the input keeps its own
counts, is encoded by the dictionary, and fills count arrays for ranges of ids (occurrences and rows with the term); the arrays
of all blocks are added up range by range. A term reaches the shuffle once for each block that holds it, however hot it is,
and a task holds the arrays of one range of ``RANGE`` ids at a time.

Defined results: null, empty and blank texts hold no term but count as rows; repeated rows count each time; ids have no gaps;
an empty table gives no term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.runtime import cut, with_ids

#: Ids of one range: the length of the count arrays.
RANGE = 4096


def word_terms(column: str) -> Column:
    """The maximal runs of letters or digits of a column, in lower case."""
    return F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def whole_term(column: str) -> Column:
    """The whole value in lower case without outer blanks; none where it is blank."""
    v = F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return F.when(v != "", F.array(v)).otherwise(F.array().cast("array<string>"))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add the blocks' arrays of one range after the other; the rows come sorted by range."""
    now, occurrences, rows = None, None, None

    def done() -> pd.DataFrame:
        at = np.flatnonzero(rows)
        return pd.DataFrame({"id": now * RANGE + at, "occurrences": occurrences[at], "rows": rows[at]})

    for pdf in batches:
        for r, offsets, o, n in zip(pdf["range"], pdf["offsets"], pdf["occ"], pdf["pres"]):
            if r != now:
                if now is not None:
                    yield done()
                now, occurrences, rows = r, np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)
            np.add.at(occurrences, offsets, o)
            np.add.at(rows, offsets, n)
    if now is not None:
        yield done()


def term_counts(df: DataFrame, terms: Column) -> DataFrame:
    """(id, term, occurrences, rows) of the terms in the array ``terms`` of each row of ``df``."""
    spark = df.sparkSession
    once = df.select(terms.alias("terms"), F.spark_partition_id().alias("block")).filter(F.size("terms") > 0)
    # every term of a row, and once more each different one, so that one pass counts occurrences and rows
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    each = F.transform("terms", lambda t: F.struct(t.alias("term"), one.alias("occ"), none.alias("pres")))
    different = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), none.alias("occ"), one.alias("pres")))
    places = once.select("block", F.explode(F.concat(each, different)).alias("t")).select("block", "t.*")
    blocks = cut(places.groupBy("block", "term").agg(F.sum("occ").alias("occ"), F.sum("pres").alias("pres")))
    dictionary = with_ids(blocks.select("term").distinct(), ["term"])
    encoded = blocks.join(dictionary, "term").select("block", F.floor(F.col("id") / RANGE).alias("range"), (F.col("id") % RANGE).cast("int").alias("offset"), "occ", "pres")
    # arrays of one block and range: at most RANGE entries
    arrays = encoded.groupBy("range", "block").agg(F.collect_list(F.struct("offset", "occ", "pres")).alias("c")).select("range", F.col("c.offset").alias("offsets"), F.col("c.occ").alias("occ"), F.col("c.pres").alias("pres"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = arrays.repartition(n, "range").sortWithinPartitions("range").mapInPandas(_sums, "id long, occurrences long, rows long")
    return dictionary.join(summed, "id")


def marks(counts: DataFrame, total: int, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` below ``rare_below`` rows, ``common`` above ``common_share`` of all ``total`` rows, else null."""
    return counts.withColumn("mark", F.when(F.col("rows") < rare_below, "rare").when(F.col("rows") > F.lit(common_share * total), "common"))

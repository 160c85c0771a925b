"""Filling fixed-capacity containers: bulk-synchronous best fit.

Sizes are tokens of a public tokenizer. Items above the capacity are split into full parts and a rest; all others stay whole.
The items are range-sorted by size and numbered in that order, all in parallel. As a size is a whole number up to the capacity,
the sorted sequences of items and of gaps are runs of equals, and the supersteps (:func:`supersteps`) sweep the runs
instead of the rows: which item takes which gap is then a matter of ranks, and conflicts cannot arise. A superstep splits at most
one run of gaps, so there are never more than three runs a size, and no more moves than three times the square of the capacity
(some thousands in practice), whatever the number of items. The moves go to all tasks as sorted arrays, and each item finds its
container from its rank by bisection.

Defined results: null and empty texts have size 0, use no room and get container null; repeated rows are packed each; equal
sizes are taken in the order of a hash of the row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.runtime import cut, spread, with_ids

CAPACITY = 1024
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, row, tokens): the length of each text; ``row`` tells repeated keys apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for pdf in batches:
            texts = [x if isinstance(x, str) else "" for x in pdf["t"]]
            # a few at a time, as encodings are many times as large as their texts
            tokens = [len(e.ids) for i in range(0, len(texts), 200) for e in t.encode_batch(texts[i : i + 200], add_special_tokens=False)]
            yield pd.DataFrame({"key": pdf["key"], "tokens": tokens})

    d = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"))
    counted = spread(d).mapInPandas(run, d.select("key", F.lit(0).cast("long").alias("tokens")).schema)
    return cut(counted.withColumn("row", F.monotonically_increasing_id()))


def items_of(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, row, part, size): whole items, or full parts and a rest of those above the capacity."""
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0)))).alias("part")
    d = counted.filter("tokens > 0").select("key", "row", "tokens", parts)
    return d.select("key", "row", "part", F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity).cast("int").alias("size"))


def supersteps(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The moves (size, first rank, items, items a container, first container) that place all items, and the containers used.

    ``counts`` has the number of items by size. The range-sorted sequences of items and of gaps are kept by runs: items of one
    size, and containers of one gap with neighbouring numbers. One superstep places all items of a size, the largest first:
    its successor sweep walks the gaps from the smallest that holds the size; the items take the containers of a run by rank,
    as many in each as fit; taken gaps shrink and join the run list of their new width. What finds no gap opens containers.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    moves, used = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        for gap in sorted(g for g in gaps if g >= size):
            each = gap // size
            while left and gaps[gap]:
                first, n = gaps[gap].pop()
                full = min(n, left // each)
                if full:
                    moves.append((size, rank, full * each, each, first))
                    rank, left = rank + full * each, left - full * each
                    add(gap - each * size, first, full)
                if left and full < n:  # the last container of the class takes the rest
                    moves.append((size, rank, left, left, first + full))
                    add(gap - left * size, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                add(gap, first + full, n - full)
                if full < n:
                    break
            if not left:
                break
        if left:
            each = capacity // size
            full, over = divmod(left, each)
            if full:
                moves.append((size, rank, full * each, each, used))
                add(capacity - each * size, used, full)
            if over:
                moves.append((size, rank + full * each, over, over, used + full))
                add(capacity - over * size, used + full, 1)
            used += full + (over > 0)
    return moves, used


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, row, part, size, container) for the items (key, row, part, size), sizes from 1 to ``capacity``."""
    numbered = with_ids(items.withColumn("tie", F.xxhash64("row", "part")), ["size", "tie", "row", "part"], "item").drop("tie")
    counts = {r["size"]: r["count"] for r in numbered.groupBy("size").count().collect()}  # at most ``capacity`` rows
    moves, _ = supersteps(counts, capacity)
    if not moves:
        return items.withColumn("container", F.lit(None).cast("long"))
    first, at = {}, 0
    for size in sorted(counts):
        first[size], at = at, at + counts[size]
    plan = np.array(sorted((first[s] + r, each, c) for s, r, n, each, c in moves), np.int64).T
    shared = items.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin, each, start = shared.value
        for pdf in batches:
            item = pdf.pop("item").to_numpy(np.int64)
            m = np.searchsorted(begin, item, "right") - 1
            yield pdf.assign(container=start[m] + (item - begin[m]) // each[m])

    return numbered.mapInPandas(place, items.withColumn("container", F.lit(0).cast("long")).schema)


def containers(df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, part, size, container, unused) of every text; ``unused`` is the room left in the container."""
    counted = count_tokens(df, key, text, tokenizer)
    placed = cut(packed(items_of(counted, capacity), capacity))
    room = placed.groupBy("container").agg((F.lit(capacity) - F.sum("size")).cast("int").alias("unused"))
    full = placed.join(room, "container").select("key", "part", "size", "container", "unused")
    none = counted.filter("tokens = 0").select("key", F.lit(0).alias("part"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("unused"))
    return full.unionByName(none)

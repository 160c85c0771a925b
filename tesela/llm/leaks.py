"""Evaluation texts inside training text, found by spaced seeds.

Words are hashed to 64 bits. A mask picks some positions of a window of ``SPAN`` words and ignores the others; the hash of what it
picks is a seed. All windows of the test items and of all documents are hashed by each mask; equal seeds are hits. Around each
hit the aligned words are compared in both directions: the run of equal words, and the overlap that tolerates substitutions.
Every window of ``SPAN`` equal words is hit by every mask, so that one mask finds all runs of that length; with up to
``TOLERATED`` substituted words in a window, at least one of the masks ignores all of them.

The items' sorted seeds go to every task, in blocks of at most ``SEED_LIMIT`` windows (counted as they are hashed; an item is never
split): a test set of any size takes as many passes over the documents as it has blocks, and no seed of a document is
shuffled. A batch of documents is searched at once, as one array of words; windows across documents are left out.

Defined results: null, empty and short texts (below ``SPAN`` words) hold no passage; repeated rows are judged each, and a
(document, item) pair is reported once, with its longest run and overlap; items with equal texts are all reported; rows with a
null key count as one document or item with the key null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.functions.text import words
from tesela.runtime import cut, spread

SPAN, TOLERATED, SEED_LIMIT = 13, 2, 2_000_000
#: Words of documents that are searched at once.
BATCH_WORDS = 500_000
#: Bits of the table that tells most seeds apart before they are looked up.
TABLE_BITS = 22


def masks(span: int = SPAN, tolerated: int = TOLERATED, count: int = 3) -> list[tuple[int, ...]]:
    """Masks (positions kept) such that any ``tolerated`` positions are all ignored by at least one.

    Positions are dealt into ``tolerated + 1`` groups more than needed for that, and each mask ignores the groups of one choice.
    """
    groups = max(count, tolerated + 2)
    of = [p % groups for p in range(span)]
    return [tuple(p for p in range(span) if of[p] not in gone) for gone in itertools.combinations(range(groups), tolerated)]


MASKS = masks()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words(text)], np.uint64) if text else np.empty(0, np.uint64)


def seeds(h: np.ndarray, mask: tuple[int, ...], number: int, span: int = SPAN) -> np.ndarray:
    """The seed of every window of ``span`` words."""
    n = len(h) - span + 1
    if n < 1:
        return np.empty(0, np.uint64)
    acc = np.full(n, number + 1, np.uint64) * _MIX
    for p in mask:
        acc = (acc ^ h[p : p + n]) * _MIX
        acc ^= acc >> np.uint64(29)
    return acc


def overlap(a: np.ndarray, b: np.ndarray, i: int, j: int, tolerated: int = TOLERATED, span: int = SPAN) -> tuple[int, int, int, int]:
    """(run, overlap, substitutions, end in a) of the alignment a[i] ~ b[j]: the longest run of equal words, and the tolerant overlap around i.

    The overlap grows from the hit's window in both directions while no window of ``span`` words has more than ``tolerated``
    substitutions, and ends with equal words.
    """
    back = min(i, j)
    n = min(len(a) - i, len(b) - j) + back
    same = a[i - back : i - back + n] == b[j - back : j - back + n]
    bad = np.concatenate(([0], np.cumsum(~same)))
    lo, hi = back, min(back + span, n)
    while hi < n and bad[hi + 1] - bad[max(0, hi + 1 - span)] <= tolerated:
        hi += 1
    while lo > 0 and bad[min(n, lo - 1 + span)] - bad[lo - 1] <= tolerated:
        lo -= 1
    part = np.flatnonzero(same[lo:hi])
    if not len(part):
        return 0, 0, 0, i + 1
    lo, hi = lo + int(part[0]), lo + int(part[-1]) + 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same[lo:hi].view(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max()), hi - lo, int((~same[lo:hi]).sum()), i - back + hi


class Finder:
    """The test items' words, one after the other, and their sorted seeds."""

    def __init__(self, items: list[np.ndarray], tolerated: int = TOLERATED):
        self.tolerated, self.masks = tolerated, MASKS if tolerated else MASKS[:1]
        self.words = np.concatenate(items) if items else np.empty(0, np.uint64)
        self.start = np.cumsum([0, *map(len, items)])
        at = _windows(self.start)
        every = [(seeds(self.words, m, k)[at], at) for k, m in enumerate(self.masks)] if len(at) else []
        s = np.concatenate([x for x, _ in every]) if every else np.empty(0, np.uint64)
        order = np.argsort(s, kind="stable")
        self.seeds = s[order]
        self.at = np.concatenate([x for _, x in every])[order] if every else np.empty(0, np.int64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.seeds >> np.uint64(64 - TABLE_BITS)] = True

    def hits(self, h: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(document, item, place in h, place in the items' words) of windows with equal seeds that differ in at most ``tolerated`` words."""
        found = []
        inside = _windows(start)
        for k, m in enumerate(self.masks if len(self.seeds) and len(inside) else ()):
            s = seeds(h, m, k)[inside]
            some = np.flatnonzero(self.table[s >> np.uint64(64 - TABLE_BITS)])
            lo, hi = (np.searchsorted(self.seeds, s[some], side) for side in ("left", "right"))
            n = hi - lo
            w = np.repeat(inside[some], n)
            first = np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([w, self.at[np.repeat(lo, n) + np.arange(len(w)) - first]]))
        if not found:
            return np.empty((4, 0), np.int64)
        w, at = np.unique(np.concatenate(found, axis=1), axis=1)
        span = np.arange(SPAN)
        # in steps, so that only a bounded number of windows is laid out
        good = [np.count_nonzero(h[w[i : i + 100_000, None] + span] == self.words[at[i : i + 100_000, None] + span], axis=1) >= SPAN - self.tolerated for i in range(0, len(w), 100_000)]
        keep = np.concatenate(good) if good else np.empty(0, bool)
        w, at = w[keep], at[keep]
        return np.stack([np.searchsorted(start, w, "right") - 1, np.searchsorted(self.start, at, "right") - 1, w, at])

    def runs(self, hits: np.ndarray) -> pd.DataFrame:
        """(d, i, run, overlap, substitutions) of the exact windows: windows one after the other are one run."""
        d, i, w, at = hits
        order = np.lexsort((w, at - w, i, d))
        d, i, w, shift = d[order], i[order], w[order], (at - w)[order]
        new = np.ones(len(w), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (shift[1:] != shift[:-1]) | (w[1:] != w[:-1] + 1)
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(w))) + SPAN - 1
        return pd.DataFrame({"d": d[first], "i": i[first], "run": run, "overlap": run, "substitutions": 0})

    def overlaps(self, hits: np.ndarray, h: np.ndarray, start: np.ndarray) -> pd.DataFrame:
        """The same with tolerated substitutions; each alignment is followed as far as it goes, once for each part of it."""
        d, i, w, at = hits
        order = np.lexsort((w, at - w, i, d))
        out, last, seen = [], None, -1
        for k in order:
            key = d[k], i[k], at[k] - w[k]
            if key != last:
                last, seen = key, -1
            if w[k] < seen:  # inside the last overlap of this alignment, up to its last whole window
                continue
            a, b = h[start[d[k]] : start[d[k] + 1]], self.words[self.start[i[k]] : self.start[i[k] + 1]]
            run, wide, bad, end = overlap(a, b, w[k] - start[d[k]], at[k] - self.start[i[k]], self.tolerated)
            seen = max(w[k] + 1, start[d[k]] + end - SPAN + 1)
            out.append((d[k], i[k], run, wide, bad))
        return pd.DataFrame(out, columns=["d", "i", "run", "overlap", "substitutions"])

    def search(self, texts: list[str | None]) -> pd.DataFrame:
        """(d, i, run, overlap, substitutions) of the documents (by place), maybe several rows a pair."""
        got, batch, first, n = [], [], 0, 0
        for k, t in enumerate(texts):
            batch.append(word_hashes(t))
            n += len(batch[-1])
            if n >= BATCH_WORDS or k == len(texts) - 1:
                h, start = np.concatenate(batch), np.cumsum([0, *map(len, batch)])
                hits = self.hits(h, start)
                one = self.overlaps(hits, h, start) if self.tolerated else self.runs(hits)
                got.append(one.assign(d=one["d"] + first))
                batch, first, n = [], k + 1, 0
        return pd.concat(got, ignore_index=True) if got else pd.DataFrame({c: [] for c in ("d", "i", "run", "overlap", "substitutions")})


def _windows(start: np.ndarray) -> np.ndarray:
    """The places of all windows inside texts that begin at ``start`` (whose last entry is the end)."""
    n = np.maximum(np.diff(start) - SPAN + 1, 0)
    return np.repeat(start[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        h = [word_hashes(t) for t in pdf["t"]]
        yield pd.DataFrame({"item": pdf["item"], "row": [xxhash.xxh64_intdigest(f"{i} ".encode() + x.tobytes()) >> 1 for i, x in zip(pdf["item"], h)], "h": [x.tobytes() for x in h], "n": [max(0, len(x) - SPAN + 1) for x in h]})


def leaks(docs: DataFrame, tests: DataFrame, doc_key: str, test_key: str, doc_text: str = "text", test_text: str = "text", tolerated: int = TOLERATED, seed_limit: int = SEED_LIMIT) -> DataFrame:
    """(doc, item, run, overlap, substitutions) of every document that shares a window with an item, but for ``tolerated`` words in it."""
    items = tests.select(F.col(f"`{test_key}`").alias("item"), F.col(f"`{test_text}`").alias("t"))
    d = docs.select(F.col(f"`{doc_key}`").alias("doc"), F.col(f"`{doc_text}`").alias("t"))
    schema = f"doc {d.schema['doc'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, run int, overlap int, substitutions int"
    hashed = cut(items.mapInPandas(_hashed, f"item {items.schema['item'].dataType.simpleString()}, row long, h binary, n long").filter("n > 0"))
    size = (hashed.agg(F.sum("n")).first()[0] or 0) * (len(MASKS) if tolerated else 1)
    blocks = max(1, math.ceil(2 * size / seed_limit)) if size > seed_limit else 1
    rows, sc = spread(d.filter("t is not null")), docs.sparkSession.sparkContext
    found = []
    for block in range(blocks):
        # blocks by hash, of half the limit on average
        chosen = hashed.filter(F.pmod("row", F.lit(blocks)) == block).select("item", "h").collect()
        shared = sc.broadcast(([r["item"] for r in chosen], Finder([np.frombuffer(r["h"], np.uint64) for r in chosen], tolerated)))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            keys, finder = shared.value
            for pdf in batches:
                got = finder.search(list(pdf["t"]))
                yield pd.DataFrame({"doc": pdf["doc"].to_numpy()[got["d"].to_numpy(int)], "item": [keys[i] for i in got["i"].to_numpy(int)], **{c: got[c].astype("int32") for c in ("run", "overlap", "substitutions")}})

        found.append(rows.mapInPandas(search, schema))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("doc", "item").agg(F.max("run").alias("run"), F.max("overlap").alias("overlap"), F.min_by("substitutions", F.struct(-F.col("overlap"), "substitutions")).alias("substitutions"))

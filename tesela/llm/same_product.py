"""Listings of the same product, by title combination voting.

Each listing is read into tokens (:mod:`tesela.llm.listings`). What names a model or a variety is learned from the table: the
words that descriptions state under the name of the attribute. A word or words of a title count as such a name if a share of
the listings that hold them state them so; in listings without such a name, if they hardly stand in listings that name another
model. Names of a variety in different languages are the same where they stand together, for one model and size,
far more often than two varieties of a product do; where all varieties come with all sizes, nothing tells translations, and
listings stay apart by language.

The k-combinations of a listing's tokens, one of each kind that it has (k is 1 to 3), are its candidates. They vote over the
whole table: a combination scores by its length, by its frequency, and by how early its tokens stand on average. Each listing
gets its best combination, so a misspelt or misread token loses to the spelling of the other listings. Listings with one
combination form a cluster. Length weighs most, as another size or variety is another product.

Clusters are then verified and merged: one that leaves out a kind joins the only larger one of its model that agrees with what
it says; where several agree, nothing tells which, and it stays alone. Brand, material, packing and category are not compared, as
sellers leave them out, translate and misspell them.

All steps are aggregations and joins on combinations; no group is gathered. Defined results: listings without a name and
description, or without a token that may name a model, are groups of their own; repeated rows of a listing vote as one
listing and get one group; ties go to the smaller combination; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm import listings
from tesela.llm.listings import BEHIND, Tokens, read
from tesela.runtime import broadcast_if_small, cut, lookup

#: Share of the listings with a word in which it must be stated as a model, to name one; share of a stated variety's listings whose titles must hold it.
NAME_SHARE, TITLE_SHARE = 0.1, 0.2
#: A word that is stated nowhere may name a model if it stands in so many listings, of which at most this share names another model.
UNSTATED_LEAST, NAMED_SHARE = 2, 0.1
#: Share of the stated varieties that a variety must have to be looked for in titles and translated (which bounds their number), and its least count.
VARIETY_SHARE, VARIETY_LEAST = 1 / 2000, 3
#: Two names of a variety may be one if they stand together in this share of the models and sizes of the rarer one, and so many times as often as others.
TOGETHER_SHARE, TOGETHER_LEAST, TOGETHER_TIMES = 0.15, 2, 1.5
#: Weights of the score: a kind covered, a bit of frequency, a place of the average position.
LENGTH_WEIGHT, FREQUENCY_WEIGHT, POSITION_WEIGHT = 64.0, 1.0, 0.05


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, *read(*(x if isinstance(x, str) else None for x in (n, t)))) for i, n, t in zip(pdf["id"], pdf["name"], pdf["text"])]
        yield pd.DataFrame(rows, columns=["id", *Tokens._fields])


def tokens(df: DataFrame, key: str, name: str, description: str) -> DataFrame:
    """(id and the fields of ``Tokens``) of every row with a key."""
    d = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{name}`").alias("name"), F.col(f"`{description}`").alias("text")).filter(F.col("id").isNotNull())
    return cut(d.mapInPandas(_read, f"id {d.schema['id'].dataType.simpleString()}, codes array<long>, models array<long>, varieties array<long>, under array<int>, sizes array<string>, grams array<long>, `at` array<int>"))


def _longs(values: list[int]) -> Column:
    """A constant array of at least one number."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def varieties(said: DataFrame) -> dict[int, int]:
    """Every name of a variety that is looked for, and the name that stands for it and its translations; at most 1 / VARIETY_SHARE names."""
    # listings that state model and variety have words of the title only
    titled = said.filter((F.size("models") > 0) & (F.size("varieties") > 0) & (F.size("grams") > 0))
    stated = titled.select("grams", F.posexplode("varieties").alias("k", "gram"), "under").select("gram", F.get("under", F.col("k")).alias("under"), F.array_contains("grams", F.col("gram")).cast("int").alias("held"))
    stated = cut(stated.groupBy("gram", "under").agg(F.count("*").alias("n"), F.sum("held").alias("held")))
    total = stated.agg(F.sum("n")).first()[0] or 0
    least, ways = max(VARIETY_LEAST, VARIETY_SHARE * total), len(listings.VARIETY_NAMES.split())
    counts, under, held = {}, {}, {}
    for r in sorted(stated.filter(F.col("n") >= least / ways).collect(), key=lambda r: r["n"]):  # at most ways / VARIETY_SHARE
        counts[r["gram"]], held[r["gram"]] = counts.get(r["gram"], 0) + r["n"], held.get(r["gram"], 0) + r["held"]
        under[r["gram"]] = r["under"]
    counts = {g: n for g, n in counts.items() if n >= least and held[g] >= TITLE_SHARE * n}
    if not counts:
        return {}
    place = F.xxhash64(F.get(F.concat("codes", "models"), 0), F.get("sizes", 0)).alias("place")
    # each name once for a model and size: no more rows than names looked for, however many listings there are
    once = said.filter((F.size("sizes") > 0) & (F.size("codes") + F.size("models") > 0)).select(place, F.explode(F.array_intersect("varieties", _longs(list(counts)))).alias("a")).distinct()
    both = once.join(once.withColumnRenamed("a", "b"), "place").filter("a <= b").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= TOGETHER_LEAST).collect()  # pairs of the names looked for
    alone = {r["a"]: r["n"] for r in both if r["a"] == r["b"]}
    return _translated(counts, {(r["a"], r["b"]): r["n"] / min(alone[r["a"]], alone[r["b"]]) for r in both if r["a"] < r["b"]}, under)


def _translated(counts: dict[int, int], together: dict[tuple[int, int], float], under: dict[int, int]) -> dict[int, int]:
    """The name that stands for each name. Two are translations if they are stated under different names of the attribute, and each is the clear best of the other's language for it."""
    near: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for (a, b), share in together.items():
        if under[a] != under[b] and share >= TOGETHER_SHARE:
            near.setdefault((a, under[b]), []).append((share, b))
            near.setdefault((b, under[a]), []).append((share, a))
    best = {}
    for key, found in near.items():
        found.sort(reverse=True)
        if len(found) == 1 or found[0][0] >= TOGETHER_TIMES * found[1][0]:
            best[key] = found[0][1]
    top = {g: g for g in counts}
    for (a, _), b in sorted(best.items()):
        if best.get((b, under[a])) == a:
            x, y = sorted((top[a], top[b]), key=lambda g: (-counts[g], g))
            top = {g: x if t == y else t for g, t in top.items()}
    return top


def _resolved(said: DataFrame, of: dict[int, int]) -> DataFrame:
    """``said`` with ``kinds``: (variety, at) of the varieties that are stated, else of those in the title, else of those in the description."""
    none = F.array().cast("array<struct<variety:bigint,at:int>>")
    if not of:
        return said.withColumn("kinds", none)
    names = _longs(list(of))
    to = F.map_from_arrays(names, _longs(list(of.values())))
    seen = F.transform(F.array_intersect("grams", names), lambda g: F.struct(F.element_at(to, g).alias("variety"), F.element_at("at", F.array_position("grams", g).cast("int")).alias("at")))
    stated = F.transform(F.array_intersect("varieties", names), lambda g: F.struct(F.element_at(to, g).alias("variety"), F.lit(0).alias("at")))
    kinds = said.withColumn("kinds", F.when(F.size(stated) > 0, stated).otherwise(seen))
    first = F.filter("kinds", lambda v: v["at"] < 4 * BEHIND)
    return kinds.withColumn("kinds", F.when(F.size(first) > 0, first).otherwise(F.col("kinds")))


def models(said: DataFrame) -> DataFrame:
    """(id, sizes, kinds, model, at): what may name the model of each listing."""
    codes = said.select(F.explode("codes").alias("model"), F.lit(True).alias("code")).unionByName(said.select(F.explode("models").alias("model"), F.lit(False).alias("code")))
    known = codes.groupBy("model").agg(F.count("*").alias("stated"), F.max("code").alias("code"))
    known = cut(known.withColumn("weight", F.col("stated")))
    uncoded = said.filter(F.size("codes") == 0)
    words = uncoded.select("id", "at", F.posexplode("grams").alias("k", "gram")).select("id", "gram", F.get("at", F.col("k")).alias("at"))
    # all tokens meet the stated names first, as most tokens are none; what is left is counted and is small
    met = cut(lookup(words, "gram", known, "model", "weight").filter("stated is not null"))
    held = met.groupBy("gram").agg(F.count("*").alias("weight"), F.first("stated").alias("stated"), F.first("code").alias("code"))
    wrong = cut(held.filter(~F.col("code") & (F.col("stated") < NAME_SHARE * F.col("weight"))).select("gram"))
    met = met.select("id", "gram", "at").join(broadcast_if_small(wrong), "gram", "left_anti")
    named = cut(_longest(met).unionByName(uncoded.select("id", F.explode("models").alias("model"), F.lit(0).alias("at"))))
    # listings without a known name: words that stand in some listings, but hardly in those that name another model
    rest = cut(words.join(named.select("id").distinct(), "id", "left_anti"))
    asked = cut(rest.groupBy("gram").agg(F.countDistinct("id").alias("free")).filter(F.col("free") >= UNSTATED_LEAST))
    every = uncoded.select(F.explode("grams").alias("gram")).join(broadcast_if_small(asked), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("held"))
    unstated = asked.join(every, "gram").filter(F.col("held") - F.col("free") <= NAMED_SHARE * F.col("held")).select("gram")
    unnamed = _longest(rest.join(broadcast_if_small(cut(unstated)), "gram", "left_semi"))
    coded = said.filter(F.size("codes") > 0).select("id", "sizes", "kinds", F.explode("codes").alias("model"), F.lit(0).alias("at"))
    return coded.unionByName(uncoded.select("id", "sizes", "kinds").join(named.unionByName(unnamed), "id"))


def _longest(met: DataFrame) -> DataFrame:
    """(id, model, at): of the names that begin at one place of a listing the longest, as the shorter is part of it."""
    # a name has 60 bits, its length stands above them: numbers are aggregated without sorting
    long = F.max(F.shiftleft((F.col("at") % 4).cast("long"), 60) + F.col("gram")).alias("m")
    return met.groupBy("id", F.shiftright("at", 2).alias("place")).agg(long).select("id", F.col("m").bitwiseAND(F.lit((1 << 60) - 1)).alias("model"), (F.col("place") * 4).alias("at"))


def candidates(said: DataFrame) -> DataFrame:
    """(id, model, size, variety, at): the combinations of each listing."""
    m = models(_resolved(said, varieties(said)))
    of = m.select("id", "model", F.col("at").alias("mat"), F.posexplode_outer("sizes").alias("sat", "size"), "kinds").select("id", "model", "mat", "sat", "size", F.explode_outer("kinds").alias("v"))
    at = (F.col("mat") + F.coalesce("v.at", F.lit(0))) / 4 + F.coalesce("sat", F.lit(0))
    return of.groupBy("id", "model", "size", F.col("v.variety").alias("variety")).agg(F.min(at).alias("at"))


def placed(df: DataFrame, key: str = "id", name: str = "name", description: str = "description") -> DataFrame:
    """(id, product) of each listing that has a combination; ``product`` is the same for listings of one product."""
    combos = cut(candidates(tokens(df, key, name, description)).withColumn("combo", F.xxhash64("model", F.coalesce("size", F.lit("")), F.coalesce("variety", F.lit(0)))))
    votes = combos.groupBy("combo").agg(F.count("*").alias("n"))
    k = F.lit(1) + F.col("size").isNotNull().cast("int") + F.col("variety").isNotNull().cast("int")
    score = LENGTH_WEIGHT * k + FREQUENCY_WEIGHT * F.log2("n") - POSITION_WEIGHT * F.col("at") / k
    best = combos.join(broadcast_if_small(votes), "combo").groupBy("id").agg(F.max_by(F.struct("combo", "model", "size", "variety"), F.struct(score, F.col("combo"))).alias("b")).select("id", "b.*")
    best = cut(best)
    clusters = cut(best.select("combo", "model", "size", "variety").distinct())
    full = clusters.filter("size is not null and variety is not null")

    def only(by: list[str], of: DataFrame) -> DataFrame:
        """Where just one cluster agrees, which: an aggregation, as a name may have very many clusters."""
        return of.groupBy(*by).agg(F.count("*").alias("ways"), F.min("combo").alias("to"))

    steps = []
    for by, part in ((["model", "size"], clusters.filter("size is not null and variety is null")), (["model", "variety"], clusters.filter("size is null and variety is not null"))):
        steps.append(part.join(only(by, full), by, "left").select("combo", "model", "ways", "to"))
    # those that no full cluster agrees with are the largest of their model themselves
    largest = full.select("model", "combo").unionByName(steps[0].unionByName(steps[1]).filter("ways is null").select("model", "combo"))
    bare = clusters.filter("size is null and variety is null").join(only(["model"], largest), "model", "left").select("combo", "model", "ways", "to")
    merged = steps[0].unionByName(steps[1]).unionByName(bare).filter("ways = 1").select("combo", "to")
    return best.join(merged, "combo", "left").select("id", F.hex(F.coalesce("to", "combo")).alias("product"))


def groups(df: DataFrame, key: str = "id", name: str = "name", description: str = "description") -> DataFrame:
    """(id, product): one row for each listing id that is not null; a listing without a combination is a group of its own."""
    ids = df.select(F.col(f"`{key}`").alias("id")).filter(F.col("id").isNotNull()).distinct()
    return ids.join(placed(df, key, name, description), "id", "left").select("id", F.coalesce("product", F.concat(F.lit("?"), F.col("id").cast("string"))).alias("product"))


def pairs(grouped: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of listings of one product."""
    g = grouped.filter(~F.col("product").startswith("?"))
    return g.select(F.col("id").alias("id_a"), "product").join(g.select(F.col("id").alias("id_b"), "product"), "product").filter("id_a < id_b").select("id_a", "id_b")

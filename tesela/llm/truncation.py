"""Text cut off by field limits or broken transfers, and how often each source cuts.

For each source and column, the histogram of lengths, in characters and in bytes, is tested for a spike at its upper end; values
that end with a mark of omission make a histogram of their own. A value at a spike is cut unless it ends with a finished sentence.

A transfer can break anywhere, so values of other lengths are judged by how values of the column end. In a column whose values
nearly all end with terminal punctuation, one without it is cut, unless its last word is a usual end (``Contents: 4 u``). In
other columns (titles), the last word decides, with the counts of all words of the column: a word that goes on nearly always, or
a rare one that only begins a frequent word or a word of the row's other column, is no end.

All counts cover all words of all rows, and thresholds are shares and ratios, so that a table of any size is judged alike; only
a least number of cases is asked for (``SPIKE_LEAST``, ``USUAL_LEAST``). A last word is judged once, however many values end with it, and
what is found is joined to the values; the few words that end many values are spread (:func:`tesela.runtime.lookup`).

Defined results: null and blank values are no case and do not count for rates; a null source is a source of its own; repeated
rows are judged each; of two equal spikes the longer counts; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesela.runtime import broadcast_if_small, cut, lookup

#: Marks of omission at the end of a value.
OMISSION = r"\s*(?:…|\.{3,}|\[\s*(?:…|\.{2,})\s*\]|\(\s*(?:…|\.{2,})\s*\))\s*$"
FINISHED = r"[.!?。！？][\"'”’»)\]]*\s*$"
#: A spike holds at least so many values, so many times the mean of the lengths below; at most this share lies above.
SPIKE_LEAST, SPIKE_TIMES, ABOVE = 5, 4.0, 0.01
#: Bytes that a cut by bytes may leave unused (the longest UTF-8 character less one).
SLACK = 3
TERMINATED_SHARE = 0.6
#: A usual end of a value without terminal punctuation: occurrences, and share among such values of sources without a limit.
USUAL_LEAST, USUAL_SHARE = 10, 0.1
#: A word that others only begin is frequent: its occurrences by rows at least.
FREQUENT_SHARE = 1 / 5000
USUAL_END_SHARE, END_RATE, GOES_ON_RATE, BEGINS_TIMES = 0.0005, 0.02, 0.001, 10
#: Letters up to which all beginnings of a word are listed; longer ones are found by their first letters.
BEGINNING = 24
#: Characters at the end of a value that are looked at for what ends it (its lengths are those of the whole).
TAIL = 80


def _facts(df: DataFrame, source: str, key: str, columns: tuple[str, ...]) -> DataFrame:
    """One narrow row for each value that is not blank: its lengths and what its end tells; no text is kept."""
    fields = [F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("text"), F.concat_ws("\n", *[F.col(f"`{o}`").cast("string") for o in columns if o != c]).alias("others")) for c in columns]
    one = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.explode(F.array(*fields)).alias("f"))
    one = one.select("key", "source", "f.field", "f.text", "f.others").filter(F.col("text").rlike(r"\S"))
    one = one.withColumn("tail", F.expr(f"right(text, {TAIL})")).withColumn("lost", F.col("tail").endswith("\ufffd"))
    one = one.withColumn("whole", F.when(F.col("lost"), F.regexp_replace("tail", "\\x{FFFD}+$", "")).otherwise(F.col("tail")))
    one = one.withColumn("marked", F.col("whole").rlike(OMISSION) & F.col("whole").rlike(r"[\p{L}\p{N}]"))
    one = one.withColumn("end", F.when(F.col("marked"), F.regexp_replace("whole", OMISSION, "")).otherwise(F.col("whole")))
    finished = F.col("end").rlike(FINISHED) & ~F.col("lost")
    one = one.withColumn("finished", finished).withColumn("last", F.when(finished, "").otherwise(F.lower(F.regexp_extract("end", r"([\p{L}\p{N}]+)$", 1))))
    # what the row's other columns say of the last word: whether they hold it, and whether they hold a longer one that it begins
    said = F.when((F.char_length("last") >= 2), F.regexp_extract_all(F.lower("others"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    one = one.withColumn("said", said)
    return one.select(
        "key", "source", "field", "marked", "lost", "finished", "last",
        (F.char_length("text") - F.char_length("tail") + F.char_length("whole")).alias("chars"),
        (F.octet_length("text") - F.octet_length("tail") + F.octet_length("whole")).alias("bytes"),
        F.col("end").rlike(r"(?:[-|,/:;(&]|\s-)\s*$").alias("open"),
        F.array_contains("said", F.col("last")).alias("named"),
        F.exists("said", lambda w: w.startswith(F.col("last")) & (F.char_length(w) > F.char_length("last"))).alias("begun"),
    )


def spikes(long: DataFrame) -> DataFrame:
    """(source, field, marked, unit, limit): the lengths at which a source cuts, at most one a unit."""
    of = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")))).alias("u")
    by = ["source", "field", "marked", "unit"]
    lengths = long.select("source", "field", "marked", "finished", of).select("source", "field", "marked", "u.unit", F.col("u.n").alias("n"), F.col("finished").cast("int").alias("finished"))
    h = lengths.groupBy(*by, "n").agg(F.count("*").alias("c"), F.sum("finished").alias("done"))
    w = Window.partitionBy(*by)
    below = w.orderBy("n").rangeBetween(-14, -4)
    h = h.withColumn("all", F.sum("c").over(w)).withColumn("above", F.sum("c").over(w.orderBy(F.desc("n"))) - F.col("c")).withColumn("usual", F.coalesce(F.sum("c").over(below), F.lit(0)) / 11.0)
    top = h.filter((F.col("c") - F.col("done") >= SPIKE_LEAST) & (F.col("c") >= SPIKE_TIMES * F.col("usual")) & (F.col("above") <= ABOVE * F.col("all")))
    best = top.groupBy(*by).agg(F.max_by("n", F.struct("c", "n")).alias("limit"), F.max("c").alias("at"))
    # a limit in bytes shows in bytes: in characters, where fewer values share one length, it is only its shadow
    strongest = Window.partitionBy("source", "field", "marked").orderBy(F.desc("at"), F.desc("unit"))
    return best.withColumn("r", F.row_number().over(strongest)).filter("r = 1").select("source", "field", "marked", "unit", "limit")


def _words(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) of the words of a column."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(f"`{column}`").cast("string")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _last_words(texts: DataFrame, column: str, rows: DataFrame, total: int) -> DataFrame:
    """(word, ends, usual, unfit, begins) of every last word: whether it is a usual end, nearly always goes on, or only begins a frequent word."""
    ends = cut(rows.filter("last <> ''").groupBy(F.col("last").alias("word")).agg(F.count("*").alias("ends")))
    words = cut(_words(texts, column))
    frequent = words.filter((F.col("n") >= FREQUENT_SHARE * total) & (F.length("word") > 1)).select(F.col("word").alias("whole"), "n")
    starts = frequent.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("whole") - 1, F.lit(BEGINNING))), lambda k: F.substring(F.col("whole"), F.lit(1), k))).alias("word"))
    short = starts.groupBy("word").agg(F.max("n").alias("begins"))
    long = ends.filter(F.length("word") > BEGINNING).select("word", F.substring("word", 1, BEGINNING).alias("first"))
    long = long.join(frequent.filter(F.length("whole") > BEGINNING).withColumn("first", F.substring("whole", 1, BEGINNING)), "first").filter(F.col("whole").startswith(F.col("word")) & (F.length("whole") > F.length("word")))
    begins = short.unionByName(long.groupBy("word").agg(F.max("n").alias("begins")))
    n, e, b = (F.coalesce(c, F.lit(0)) for c in ("n", "ends", "begins"))
    judged_ = ends.join(words, "word", "left").join(begins, "word", "left")
    return judged_.select("word", "ends", ((e >= USUAL_END_SHARE * total) & (e >= END_RATE * n)).alias("usual"), ((n > 0) & (e < GOES_ON_RATE * n)).alias("goes_on"), (b >= BEGINS_TIMES * F.greatest(n, F.lit(1))).alias("begins"))


def judged(df: DataFrame, source: str, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, source, field, cause): ``cause`` is ``limit``, ``transfer`` or null for each value that is not blank."""
    long = cut(_facts(df, source, key, columns))
    facts = {r["field"]: r for r in long.groupBy("field").agg(F.count("*").alias("rows"), F.avg(F.col("finished").cast("int")).alias("share")).collect()}  # one row a column
    limits = broadcast_if_small(cut(spikes(long).toDF("s", "f", "m", "unit", "limit")), F.octet_length("s"))
    long = long.join(limits, F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")) & (F.col("marked") == F.col("m")), "left").drop("s", "f", "m")
    size = F.when(F.col("unit") == "chars", F.col("chars")).otherwise(F.col("bytes"))
    at = F.coalesce(size == F.col("limit"), F.lit(False))
    near = F.coalesce(size.between(F.col("limit") - SLACK, F.col("limit")), F.lit(False))
    out = []
    for field, fact in facts.items():
        rows = long.filter(F.col("field") == field)
        if fact["share"] >= TERMINATED_SHARE:
            # a usual end is frequent among the values without terminal punctuation at any length; a cut ends anywhere
            free = rows.filter(~F.col("finished") & F.col("limit").isNull() & ~F.col("marked"))
            total = free.count()
            usual = free.filter("last <> ''").groupBy(F.col("last").alias("word")).agg(F.count("*").alias("e")).filter(F.col("e") >= max(USUAL_LEAST, USUAL_SHARE * total)).select("word")
            # at most 1 / USUAL_SHARE words
            rows = rows.join(F.broadcast(usual.withColumn("usual", F.lit(True))), F.col("last") == F.col("word"), "left")
            usual_end = F.coalesce("usual", F.lit(False))
            cut_here = ~F.col("finished") & ~usual_end
            cause = F.when(F.col("marked"), F.when(near & ~F.col("finished"), "limit")).when(cut_here, F.when(near, "limit").otherwise("transfer"))
        else:
            known = cut(_last_words(df, field, rows, fact["rows"]))
            rows = lookup(rows, "last", known, "word", "ends", F.col("usual") | F.col("goes_on") | F.col("begins"))
            rows = rows.na.fill(False, ["usual", "goes_on", "begins"])
            letters = F.col("last").rlike(r"^\p{L}+$")
            unfit = letters & ~F.col("usual") & (F.col("goes_on") | (~F.col("named") & (F.col("begun") | F.col("begins"))))
            broken = ~F.col("finished") & (F.col("open") | F.coalesce(unfit, F.lit(False)))
            cause = F.when(F.col("marked"), F.when(near & ~F.col("finished"), "limit")).when(at & ~F.col("finished"), "limit").when(broken, F.when(near, "limit").otherwise("transfer"))
        cause = F.coalesce(cause, F.when(F.col("lost"), F.when(near, "limit").otherwise("transfer")))
        out.append(rows.select("key", "source", "field", cause.alias("cause")))
    if not out:
        return long.select("key", "source", "field", F.lit(None).cast("string").alias("cause"))
    return reduce(DataFrame.unionByName, out)


def rates(found: DataFrame) -> DataFrame:
    """(source, field, values, cut_by_limit, cut_in_transfer, rate) for each source and column."""
    lim, tra = (F.sum((F.col("cause").eqNullSafe(c)).cast("long")) for c in ("limit", "transfer"))
    r = found.groupBy("source", "field").agg(F.count("*").alias("values"), lim.alias("cut_by_limit"), tra.alias("cut_in_transfer"))
    return r.withColumn("rate", F.round((F.col("cut_by_limit") + F.col("cut_in_transfer")) / F.col("values"), 6))

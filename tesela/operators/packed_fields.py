"""Several values packed in one field: split by the dialect with the least description length.

A dialect is a set of delimiters with a way to quote. Every distinct field (or, for fields of near-unique values, every
distinct template of a field) is parsed by each dialect that can apply. The values of all parses are counted over the whole
table, a value's code length is the smaller of its place in the dictionary of values and its spelling by shape, and a parse
costs the codes of its values, the end of each value, and what it leaves unexplained: quotes or escapes that it reads as plain
marks. Counts start with all parses and are taken again from the cheapest ones. Each field is then parsed by its cheapest dialect.

A kind of field may declare marks that always end a value (``Kind.ends``): a parse that leaves one bare inside a value is no
parse of that kind.

Defined results: null, empty and blank fields hold no value; empty places do not count for the position; a field that is one
value gives one value; ties go to the dialect that comes first; rows may repeat and are all parsed; texts of any length are
parsed by scanning, without recursion.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.runtime import broadcast_if_small, cut

#: Bits for the end of a value, for a quote or escape that a dialect reads as a plain mark, for each letter of a spelled value.
#: and for a delimiter that a value keeps inside.
END_BITS, BARE_BITS, LETTER_BITS, KEPT_BITS = 1.0, 12.0, 4.0, 8.0
ROUNDS = 2
#: Weight, in the first counts, of fields that have more than one parse.
OPEN_WEIGHT = 0.1

PUNCTUATION = r"""!"#$%*+,./:;<=>?@\[\\\]^_`{|}~«»¡¿…·•–—""" + "\t\n\r\x0b\x0c\u0085  "


@dataclass(frozen=True)
class Dialect:
    name: str
    delimiter: str  # a pattern
    quotes: str = ""  # the quote characters
    escape: bool = False
    listed: bool = False  # the whole is a bracketed list of quoted strings


@dataclass(frozen=True)
class Kind:
    """What is known of a kind of field: its delimiters, whether values recur, and the marks that end a value in any case."""

    delimiters: tuple[str, ...]
    by_value: bool = True
    ends: str = ""
    quotes: tuple[str, ...] = ("", '"', "'", "\"'")
    escapes: tuple[bool, ...] = (False, True)

    def dialects(self) -> list[Dialect]:
        plain = [Dialect(f"{d!r} {q}{'\\' * e}", d, q, e) for q in self.quotes[::-1] for e in self.escapes[::-1] for d in self.delimiters]
        return [Dialect("list", r"\s*,\s*", '"', True, True), *plain]


#: Categories: any mark ends one; single delimiters stand beside the class of all, which mixed fields need.
CATEGORY = Kind(delimiters=(rf"[{PUNCTUATION}]|'(?![^\W_])|(?<![^\W_])'", "::", r"\|", ";", ",", ">", "/", r"\n", r"\t"), ends=rf"[{PUNCTUATION}]")
#: Pictures: a value is one URL or file name, which holds no blank, bar or quote, but may hold commas and semicolons of its own.
IMAGE = Kind(delimiters=(r"\s+", r"\s*\|+\s*", r"\s*;\s*", r"\s*,(?:\s+|$)", r"\s*,\s*", r"[\s|;]+", r"[\s|;,]+"), by_value=False, ends=r'[\s|"]|://.*://', quotes=("", '"'), escapes=(False,))

_BLANK = re.compile(r"\s*")
_RUNS = re.compile(r"[^\W_]+")
_KEPT = re.compile(r"[,;]")


class Reader:
    """Parses fields by one dialect."""

    def __init__(self, d: Dialect, ends: str = ""):
        self.d, self.delimiter = d, re.compile(d.delimiter)
        self.ends = re.compile(ends) if ends else None
        self.quoted = {q: re.compile(rf"{q}([^{q}\\]*(?:(?:{q}{q}|\\.)[^{q}\\]*)*){q}" if d.escape else rf"{q}([^{q}]*(?:{q}{q}[^{q}]*)*){q}", re.S) for q in d.quotes}
        self.stop = re.compile(rf"\\(.)|({d.delimiter})" if d.escape else rf"(\b\B)|({d.delimiter})", re.S)

    def applies(self, text: str) -> bool:
        if self.d.listed:
            return text.startswith("[") and text.endswith("]")
        return all(q in text for q in self.d.quotes) and (not self.d.escape or "\\" in text) and bool(self.delimiter.search(text) or self.d.quotes)

    def values(self, text: str) -> tuple[list[str], int] | None:
        """The values, and how many quotes and escapes were read as plain marks; None if this is no parse."""
        text = text.strip()
        if self.d.listed:
            return self._list(text)
        out, bare, at, end = [], 0, 0, len(text)
        while at <= end:
            at = _BLANK.match(text, at).end() if not self.delimiter.match(text, at) else at
            q = self.quoted.get(text[at : at + 1])
            m = q and q.match(text, at)
            if m:
                after = _BLANK.match(text, m.end()).end()
                stop = self.delimiter.match(text, m.end()) or self.delimiter.match(text, after)
                if stop or after >= end:
                    mark = m.group()[0]
                    value = m.group(1).replace(mark * 2, mark)
                    out.append(re.sub(r"\\(.)", r"\1", value, flags=re.S) if self.d.escape else value)
                    at = stop.end() if stop and stop.end() > stop.start() else end + 1
                    continue
            piece, at0 = [], at
            while True:
                s = self.stop.search(text, at)
                if s is None:
                    piece.append(text[at:])
                    nxt = end + 1
                    break
                piece.append(text[at : s.start()])
                if s.group(2) is None:
                    piece.append("\0" + s.group(1))
                    at = s.end()
                    continue
                nxt = s.end()
                bare += s.group(2) in ('"', "\\")
                break
            value = "".join(piece)
            open_part = re.sub("\0.", "", value, flags=re.S)
            if self.ends and self.ends.search(open_part):
                return None
            bare += len(re.findall(r'"|\\|^\s*\'|\'\s*$', open_part))
            out.append(value.replace("\0", ""))
            at = nxt if nxt > at0 else at0 + 1
        return [v for v in (v.strip() for v in out) if v], bare

    def _list(self, text: str) -> tuple[list[str], int] | None:
        try:
            got = json.loads(text, strict=False)
        except ValueError:
            return None
        if not isinstance(got, list) or not all(isinstance(x, str) for x in got):
            return None
        return [v for v in (x.strip() for x in got) if v], 0


def template(text: str) -> str:
    """The field with every run of letters and digits as ``w``; marks, blanks and quotes stay."""
    return _RUNS.sub("w", text)


def _candidates(kinds: dict[str, Kind]):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {f: [Reader(d, k.ends) for d in k.dialects()] for f, k in kinds.items()}
        for pdf in batches:
            rows = []
            for field, key, n in zip(pdf["field"], pdf["key"], pdf["n"]):
                seen: dict[tuple[str, ...], tuple[float, str]] = {}
                got = [(r, r.values(key)) for r in readers[field] if r.applies(key)]
                for r, v in got:
                    if v is not None and v[0] and tuple(v[0]) not in seen:
                        seen[tuple(v[0])] = (v[1] * BARE_BITS + len(v[0]) * END_BITS, r.d.name)
                seen.setdefault((key.strip(),), (END_BITS + BARE_BITS * key.count('"'), "whole"))
                whole = (key.strip(),)
                if len(seen) > 1 and seen[whole][1] == "whole" and kinds[field].ends and re.search(kinds[field].ends, whole[0]):
                    del seen[whole]
                w = float(n) if len(seen) == 1 else OPEN_WEIGHT * n / len(seen)
                for vals, (bits, name) in seen.items():
                    codes = [v.lower() if kinds[field].by_value else template(v) for v in vals]
                    shapes = [template(v) for v in vals]
                    letters = [LETTER_BITS * sum(map(len, _RUNS.findall(v))) if kinds[field].by_value else KEPT_BITS * len(_KEPT.findall(v)) for v in vals]
                    rows.append((field, key, n, w, name, bits, codes, shapes, letters))
            yield pd.DataFrame(rows, columns=["field", "key", "n", "w", "dialect", "bits", "codes", "shapes", "letters"])

    return parse


def dialects(fields: DataFrame, kinds: dict[str, Kind], rounds: int = ROUNDS) -> DataFrame:
    """(field, key, dialect) for the distinct (field, key, n) in ``fields``."""
    schema = "field string, key string, n long, w double, dialect string, bits double, codes array<string>, shapes array<string>, letters array<double>"
    parses = cut(fields.mapInPandas(_candidates(kinds), schema))
    several = parses.filter("w < n")
    chosen = None
    for _ in range(rounds):
        counted = parses if chosen is None else parses.join(chosen, ["field", "key", "dialect"], "left_semi").withColumn("w", F.col("n").cast("double"))
        v = counted.select("field", "w", F.explode(F.arrays_zip("codes", "shapes")).alias("v")).select("field", "w", "v.codes", "v.shapes")
        by = v.groupBy("field", "codes").agg(F.sum("w").alias("nv"), F.min("shapes").alias("shapes"))
        by_shape = by.groupBy("field", "shapes").agg(F.sum("nv").alias("ns"))
        total = F.broadcast(by_shape.groupBy("field").agg(F.sum("ns").alias("nf")))  # one row a kind of field
        value_bits = by.select("field", "codes", "nv")
        need = several.select("field", "key", "dialect", "bits", F.explode(F.arrays_zip("codes", "shapes", "letters")).alias("v")).select("field", "key", "dialect", "bits", "v.codes", "v.shapes", "v.letters")
        need = need.join(value_bits, ["field", "codes"], "left").join(by_shape, ["field", "shapes"], "left").join(total, "field", "left")
        half = F.lit(0.5)
        known = F.when(F.col("field").isin([f for f, k in kinds.items() if k.by_value]), -F.log2((F.coalesce("nv", F.lit(0.0)) + 1e-3) / (F.coalesce("nf", F.lit(0.0)) + 1)))
        spelled = -F.log2((F.coalesce("ns", F.lit(0.0)) + half) / (F.coalesce("nf", F.lit(0.0)) + 1)) + F.col("letters") + 1
        cost = need.groupBy("field", "key", "dialect").agg((F.sum(F.least(known, spelled)) + F.first("bits")).alias("cost"))
        best = cost.groupBy("field", "key").agg(F.min_by("dialect", F.struct("cost", "dialect")).alias("dialect"))
        chosen = best.unionByName(parses.filter("w >= n").select("field", "key", "dialect"))
        chosen = cut(chosen)
    return chosen


def unpack(df: DataFrame, kinds: dict[str, Kind], row: list[str], least: int = 1) -> DataFrame:
    """(row columns, field, pos, item): one row for each value of the fields named in ``kinds``, from fields of ``least`` values."""
    long = df.select(*[F.col(f"`{c}`") for c in row], F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("raw")) for f in kinds])).alias("__f")).select(*row, "__f.field", "__f.raw")
    long = long.filter(F.col("raw").rlike(r"\S"))
    marks = F.lit(False)
    for f, k in kinds.items():  # a field without any mark is one value, whatever the dialect
        marks = marks | ((F.col("field") == f) & F.col("raw").rlike(r"[^\p{L}\p{N}\s&()'-]|[\t\n\r]" if k.by_value else r"[\s|;,\"\[]"))
    by_template = [f for f, k in kinds.items() if not k.by_value]
    long = long.withColumn("key", F.when(F.col("field").isin(by_template), F.regexp_replace("raw", r"[\p{L}\p{N}]+", "w")).otherwise(F.col("raw")))
    # fields of one value count too: they show what values look like
    chosen = dialects(long.groupBy("field", "key").agg(F.count("*").alias("n")), kinds)
    chosen = broadcast_if_small(chosen, F.octet_length("key"))
    simple, long = long.filter(~marks), long.filter(marks)
    parsed = long.join(chosen, ["field", "key"]).select(*row, "field", "raw", "dialect")

    @F.pandas_udf("array<string>")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        readers = {(f, d.name): Reader(d, k.ends) for f, k in kinds.items() for d in k.dialects()}
        for field, raw, dialect in batches:
            yield pd.Series([[r.strip()] if d == "whole" else readers[f, d].values(r)[0] for f, r, d in zip(field, raw, dialect)], dtype=object)

    items = parsed.withColumn("items", parse("field", "raw", "dialect"))
    if least <= 1:
        items = items.select(*row, "field", "items").unionByName(simple.select(*row, "field", F.array(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("items")))
    return items.filter(F.size("items") >= least).select(*row, "field", F.posexplode("items").alias("pos", "item")).withColumn("pos", (F.col("pos") + 1).cast("int"))

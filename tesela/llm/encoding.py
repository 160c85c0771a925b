"""Garbled text from a wrong character encoding: found, and restored where the bytes survive.

A text is cut into segments (lines and sentences). Each segment with a character outside ASCII is put through chains of
wrong-decoding reversals: re-encode by the wrong codec, decode by the right one, on the words that allow it, up to
``DEPTH`` steps, as a text may have been garbled twice. Every candidate is compressed with the zstandard dictionary of each
language; its description length is this and the code of its letters in the language, in the language that makes them
shortest, and the cost of its chain. The shortest candidate is kept; a segment whose own text is the shortest stays as it is. A segment with U+FFFD has lost bytes: it is marked,
and restored only in its other parts.

The code of letters comes from counts over all documents: how many of a language hold a character outside ASCII between
neighbours of these kinds (lower case, upper case, digit, blank, ...). A context that the language does not hold costs an escape
and its code over all languages; one that no document holds, another escape and the character's own code or, where it is new, its
number in Unicode. ``c’était`` is written with frequent contexts, what
another codec would make of its bytes is not, so that a few bytes of luck in the compression decide nothing.

A mix-up of single-byte codecs, which any text allows, is only compressed if it does not make the letters longer by more than
``LETTERS_SLACK`` bits, and must also be shorter by the thorough compression (the fast one is a few bytes off on short segments).
Where all segments together, gains and losses added up, are shorter by more than its cost, it counts as found. Where a text shows
steps, its segments are judged again with these steps free, as the text has named them once.

The dictionaries come from counts over all documents, whole, too: in how many of a language each word stands, and each word outside
ASCII between its neighbours. Those that save the most bytes, count and length considered, train the language's dictionary; pieces
of which another reading is likelier by the code of letters and the counts are left out. Languages of fewer than
``LEAST_DOCUMENTS`` documents share one dictionary with the documents of no language, if these are enough together. Nothing is sampled. Texts garbled more than ``DEPTH`` times are missed.

Defined results: null, empty and ASCII texts are no case; a repeated row is judged again with the same result; where no
language is given, one dictionary over all texts is used; without any text to train on, plain compression decides.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.runtime import spread

#: The size of a dictionary and the pieces that it is trained on, several times what it holds; the documents that a language needs to have one.
DICTIONARY_BYTES, PIECES, LEAST_DOCUMENTS = 48 << 10, 8192, 50
#: The label of documents without a language or of one that has fewer documents.
UNKNOWN = "und"
#: Letters beyond which a word is counted by its parts, and the characters of a neighbour that count.
LONG, BESIDE = 24, 12
#: Without effect: nothing is sampled. The name stays for callers that set it.
SAMPLE_DOCS = 0
#: Codecs by which UTF-8 bytes are read wrongly, and pairs of single-byte codecs that are mixed up (wrong, right).
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "iso8859-15", "koi8-r")
MIXED = (("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("koi8-r", "cp1252"), ("latin-1", "cp1252"))
DEPTH = 3
#: Bytes that a step of a chain costs: reversals to UTF-8 prove themselves by being valid, mix-ups do not.
UTF8_COST, MIXED_COST = 1.0, 4.0
#: Bits of a character's number in Unicode.
NUMBER_BITS = 17.0
#: Bits by which a mix-up may lengthen the code of letters and still be compressed.
LETTERS_SLACK = 8.0
#: Words and segments whose results a task keeps.
KEPT = 50_000

_SEGMENT = re.compile(r"[^\n.!?…]*(?:[.!?…]+\S*|\n)?\s*", re.S)
_RUN = re.compile(r"[^\x00-\x20]+")
_NEAR = re.compile(r"(?=(.[^\x00-\x7f].))", re.S)
_SPACE = re.compile(r"[^\S\x00-\x7f]")
_C1 = re.compile(r"[\x80-\x9f]")


def _bytes(text: str, codec: str) -> bytes:
    """The bytes of ``text``; a C1 control, which lenient decoders give for unassigned bytes, stands for its byte."""
    if codec.startswith("cp125") and _C1.search(text):
        return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(codec) for c in text)
    return text.encode(codec)


def _pairs(codec: str) -> str:
    """A pattern of what UTF-8's first two bytes of a character look like when read by ``codec``."""
    bytes_ = {b: bytes([b]).decode(codec, "ignore") or chr(b) for b in range(0x80, 0xF5)}
    lead, then = ("".join(re.escape(bytes_[b]) for b in r) for r in (range(0xC2, 0xF5), range(0x80, 0xC0)))
    return f"[{lead}][{then}]"


#: By codec, what must occur for a reversal to find anything.
_SIGN = {c: re.compile(_pairs(c)) for c in WRONG}


def _words(text: str) -> list[str]:
    return [w for w in _RUN.findall(text) if not w.isascii()]


def _utf8(word: str, codec: str) -> str:
    """``word`` with every run that was UTF-8 read by ``codec`` decoded again."""
    if not _SIGN[codec].search(word):
        return word
    try:
        return _bytes(word, codec).decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return _parts(word, codec)


def _parts(word: str, codec: str) -> str:
    """Decode the longest runs inside a word that can be decoded, where the whole cannot."""
    raw, at, out = [], 0, []
    for c in word:
        try:
            raw.append(_bytes(c, codec))
        except UnicodeEncodeError:
            raw.append(None)
    while at < len(word):
        b = raw[at]
        if b is None or len(b) != 1 or b[0] < 0xC2 or b[0] > 0xF4:
            out.append(word[at])
            at += 1
            continue
        n = 2 if b[0] < 0xE0 else 3 if b[0] < 0xF0 else 4
        piece = raw[at : at + n]
        try:
            out.append(b"".join(piece).decode("utf-8"))
            at += n
        except (TypeError, UnicodeDecodeError):
            out.append(word[at])
            at += 1
    return "".join(out)


def _mixed(word: str, wrong: str, right: str) -> str:
    letters = [c for c in word if c.isalpha()]
    if letters and min(letters) > "\u024f":  # a word wholly in another script; garbling leaves the ASCII letters of a Latin one
        return word
    try:
        return word.encode(wrong).decode(right)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return word


#: All steps, with what they do to a word.
STEPS = {**{f"{c}>utf-8": (lambda w, c=c: _utf8(w, c)) for c in WRONG}, **{f"{a}>{b}": (lambda w, a=a, b=b: _mixed(w, a, b)) for a, b in MIXED}}
NAMES = list(STEPS)
ORDER = {step: i for i, step in enumerate(NAMES)}
MIXUPS = frozenset(f"{a}>{b}" for a, b in MIXED)


IS_MIXUP = np.array([step in MIXUPS for step in NAMES])


def _changes(others: list[str | None]) -> np.ndarray:
    return np.array([t is not None for t in others])


def _read(text: str, facts: dict[str, tuple[np.ndarray, list[str | None]]], k: int) -> str:
    """``text`` with its words as step number ``k`` reads them."""
    of = {w: t for w, (_, others) in facts.items() if (t := others[k]) is not None}
    return _RUN.sub(lambda m: of.get(m.group(), m.group()), text)


def mixups(chain: str) -> list[str]:
    return [step for step in chain.split() if step in MIXUPS]


@lru_cache(maxsize=1 << 16)
def kind(c: str) -> str:
    """What a neighbour is: lower or upper case, a letter of another script, a digit, a blank, a mark of ASCII, another mark, a combining mark, a control."""
    if c.isalpha():
        return ("a" if c.islower() else "A") if c <= "\u024f" or "\u1e00" <= c <= "\u1eff" else "x"
    if c.isspace():
        return " "
    if c.isdigit():
        return "0"
    if c < "\x80":
        return "."
    return "^" if unicodedata.combining(c) else "!" if c <= "\x9f" or c == "\ufffd" else "*"


def context(near: str) -> str:
    """The middle character of three with the kinds of its neighbours."""
    return kind(near[0]) + near[1] + kind(near[2])


class Letters:
    """How many documents of each language hold each context, and the length of its code. ``""`` stands for all documents, those without a language too."""

    def __init__(self, counts: dict[tuple[str, str], int], names: list[str]):
        self.names = names or [""]
        self.counts = counts
        self.documents = {l: n for (l, c), n in counts.items() if not c}
        self.single: dict[str, int] = {}
        for (l, c), n in counts.items():
            if not l and c:
                self.single[c[1]] = self.single.get(c[1], 0) + n
        self.all = 1 + sum(self.single.values())
        self.one, self.known = lru_cache(maxsize=1 << 16)(self._one), {}

    def bits(self, word: str) -> np.ndarray:
        """The code of a word in each language."""
        got = self.known.get(word)
        if got is None:
            got = sum((self.one(n) for n in _NEAR.findall(f" {word} ")), np.zeros(len(self.names)))
            if len(self.known) < KEPT:
                self.known[word] = got
        return got

    def _one(self, near: str) -> np.ndarray:
        c = context(near)
        n, m, every = self.counts.get(("", c), 0), self.single.get(near[1], 0), self.documents.get("", 0)
        own = math.log2(self.all / m) if m else math.log2(self.all) + NUMBER_BITS
        anywhere = math.log2((every + 2) / (n + 1)) if n else math.log2(every + 2) + own
        of = ((self.counts.get((l, c), 0), self.documents.get(l, 0)) for l in self.names)
        return np.array([math.log2((d + 2) / (k + 1)) if k else anywhere + (math.log2(d + 2) if l else 0.0) for l, (k, d) in zip(self.names, of)])

    def text(self, text: str) -> np.ndarray:
        return sum(map(self.bits, _words(text)), np.zeros(len(self.names)))


class Restored(NamedTuple):
    """The kept reading of a segment, its chain, and by step for each mix-up the bytes that it would gain alone, before its cost."""

    text: str
    chain: str
    gains: np.ndarray


_NO_GAINS = np.zeros(len(NAMES))


class Model:
    """Compressors and codes of letters by language."""

    def __init__(self, dictionaries: dict[str, bytes], counts: dict[tuple[str, str], int]):
        self.letters = Letters(counts, list(dictionaries))
        opts = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        self.by, self.thorough = ([zstandard.ZstdCompressor(level=n, dict_data=zstandard.ZstdCompressionDict(v), **opts) for v in dictionaries.values()] or [zstandard.ZstdCompressor(level=n, **opts)] for n in (3, 19))
        self.words: dict[str, tuple[np.ndarray, list[str | None]]] = {}
        self.changes: dict[str, np.ndarray] = {}
        self.known: dict[tuple[str, frozenset[str]], Restored] = {}

    def length(self, text: str, by: list[zstandard.ZstdCompressor] | None = None) -> float:
        raw = _SPACE.sub(" ", text).encode("utf-8", "surrogatepass")
        return min(len(c.compress(raw)) + bits / 8 for c, bits in zip(by or self.by, self.letters.text(text)))

    def facts(self, word: str) -> tuple[np.ndarray, list[str | None]]:
        """The bits of the word's letters by language, below them those by which each step makes them longer; and by step the other reading, if it differs."""
        got = self.words.get(word)
        if got is None:
            own = self.letters.bits(word)
            others = [t if (t := read(word)) != word else None for read in STEPS.values()]
            got = np.array([own, *(self.letters.bits(t) - own if t else own * 0 for t in others)]), others
            if len(self.words) < KEPT:
                self.words[word], self.changes[word] = got, _changes(others)
        return got

    def shifts(self, text: str) -> tuple[dict[str, tuple[np.ndarray, list[str | None]]], np.ndarray]:
        """The facts of the words, and by step the bits by which it makes the letters longer (NaN: it changes nothing)."""
        words = _words(text)
        facts = {w: self.facts(w) for w in words}
        if not words:
            return facts, np.full(len(NAMES), np.nan)
        bits = sum(facts[w][0] for w in words)
        longer = (bits[0] + bits[1:]).min(axis=1) - bits[0].min()
        longer[~np.logical_or.reduce([self.changes[w] if w in self.changes else _changes(facts[w][1]) for w in facts])] = np.nan
        return facts, longer

    def restore(self, segment: str, proven: frozenset[str] = frozenset()) -> Restored:
        """The shortest candidate and its chain (empty: unchanged); steps that are ``proven`` cost nothing."""
        got = self.known.get((segment, proven))
        if got is None:
            got = self._restore(segment, proven)
            if len(self.known) < KEPT:
                self.known[segment, proven] = got
        return got

    def _restore(self, segment: str, proven: frozenset[str]) -> Restored:
        """All chains of at most ``DEPTH`` steps with at most one mix-up, each text once."""
        queue, seen, gains = [(segment, 0.0, "")], {segment}, np.zeros(len(NAMES))
        best, at = (segment, ""), None
        for _ in range(DEPTH):
            nxt = []
            for text, cost, chain in queue:
                mixed = bool(mixups(chain))
                facts, longer = self.shifts(text)
                refused = IS_MIXUP & (np.ones(len(NAMES), bool) if mixed else longer > LETTERS_SLACK)
                if not chain:
                    gains[refused] = -longer[refused] / 8
                for k in np.flatnonzero(~np.isnan(longer)):
                    step = NAMES[k]
                    if refused[k] and step not in proven:
                        continue
                    t = _read(text, facts, k)
                    if t in seen:
                        continue
                    seen.add(t)
                    at = self.length(segment) if at is None else at
                    total = cost + (0.0 if step in proven else MIXED_COST if step in MIXUPS else UTF8_COST)
                    steps, n = f"{chain} {step}".strip(), self.length(t)
                    if not chain and step in MIXUPS:
                        gains[k] = at - n
                    if n + total < at and (not mixups(steps) or self.confirmed(t, total, segment)):
                        best, at = (t, steps), n + total
                    nxt.append((t, total, steps))
            queue = nxt
            if not queue:
                break
        return Restored(*best, gains)

    def confirmed(self, text: str, cost: float, segment: str) -> bool:
        """Whether ``text`` is shorter than ``segment`` by the thorough compressors too; the fast ones miss matches, by which right short texts can look longer than a mix-up."""
        return self.length(text, self.thorough) + cost < self.length(segment, self.thorough)

    def gain(self, segment: str, step: str) -> float:
        """The bytes by which a mix-up makes the segment shorter by both compressors."""
        k, (facts, longer) = ORDER[step], self.shifts(segment)
        if np.isnan(longer[k]):
            return 0.0
        if longer[k] > LETTERS_SLACK:
            return -float(longer[k]) / 8
        t = _read(segment, facts, k)
        return min(self.length(segment) - self.length(t), self.length(segment, self.thorough) - self.length(t, self.thorough))


def restore(text: str, model: Model) -> tuple[str, list[str], bool]:
    """(restored text, chains used, whether bytes are lost)."""
    segments = _SEGMENT.findall(text)
    got = [Restored(s, "", _NO_GAINS) if s.isascii() else model.restore(s) for s in segments]
    proven = frozenset(step for g in got for step in g.chain.split()) or agreed(segments, got, model)
    if proven:
        got = [g if s.isascii() else model.restore(s, proven) for s, g in zip(segments, got)]
    return "".join(g.text for g in got), sorted({g.chain for g in got if g.chain}), "\ufffd" in text


def agreed(segments: list[str], got: list[Restored], model: Model) -> frozenset[str]:
    """The mix-up that makes the whole text shortest, if it does so by more than its cost; equal segments tell once."""
    gains = {s: g.gains for s, g in zip(segments, got) if not s.isascii()}
    total = sum(gains.values(), np.zeros(len(NAMES)))
    best = int(np.argmax(np.where(IS_MIXUP, total, -np.inf)))
    if total[best] <= MIXED_COST:
        return frozenset()
    return frozenset([NAMES[best]]) if sum(model.gain(s, NAMES[best]) for s in gains) > MIXED_COST else frozenset()


def languages(df: DataFrame, text: str, lang: str) -> list[str]:
    """The languages of at least ``LEAST_DOCUMENTS`` documents, the most frequent first."""
    of = F.lower(F.col(f"`{lang}`"))
    counted = df.filter(F.length(f"`{text}`") > 0).groupBy(of.alias("l")).count()
    return [r["l"] for r in counted.filter(F.col("l").isNotNull() & ~F.col("l").isin("", UNKNOWN) & (F.col("count") >= LEAST_DOCUMENTS)).orderBy(F.desc("count"), "l").collect()]


def _label(lang: str, names: list[str]) -> Column:
    of = F.lower(F.col(f"`{lang}`"))
    return F.when(of.isin(names), of).otherwise(UNKNOWN)


def count_letters(df: DataFrame, text: str, lang: str, names: list[str]) -> dict[tuple[str, str], int]:
    """By (language, context), the documents with the context, once for each three characters that make it; by (language, empty), all documents.

    What reaches the driver is bounded by the languages, the characters in use and the kinds of two neighbours.
    """
    near = F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), F.col(f"`{text}`"), F.lit(" ")), F.lit(r"(?s)(?=(.[^\x00-\x7F].))"), F.lit(1)))
    # the empty string stands in every document, so that its count is their number
    rows = df.filter(F.length(f"`{text}`") > 0).select(_label(lang, names).alias("l"), F.explode(F.concat(near, F.array(F.lit("")))).alias("near"))
    counted = rows.groupBy("l", "near").agg(F.count("*").alias("n"))

    @F.pandas_udf("string")
    def contexts(near: pd.Series) -> pd.Series:
        return near.map(lambda n: context(n) if len(n) == 3 else n)

    out: dict[tuple[str, str], int] = {}
    for r in counted.groupBy("l", contexts("near").alias("c")).agg(F.sum("n").alias("n")).collect():
        out[r["l"], r["c"]] = r["n"]
        out["", r["c"]] = out.get(("", r["c"]), 0) + r["n"]
    # what one document holds says nothing of a language
    return {k: n for k, n in out.items() if n > 1 or not k[1]}


def pieces(text: str) -> set[str]:
    """What a text gives to the dictionaries: its words, and those outside ASCII also between their neighbours.

    Of a word of more than ``LONG`` letters each four outside ASCII count, of a neighbour its ``BESIDE`` nearest characters.
    """
    out = set()
    for segment in _SEGMENT.findall(text):
        words = _RUN.findall(segment)
        out.update(words)
        if segment.isascii():
            continue
        words = ["", *words, ""]
        out.update(f"{before[-BESIDE:]} {w} {after[:BESIDE]}".strip(" ") for before, w, after in zip(words, words[1:], words[2:]) if not w.isascii() and len(w) <= LONG)
    for w in [w for w in out if len(w) > LONG and " " not in w]:
        out.remove(w)
        out.update(g for i in range(len(w) - 3) if not (g := w[i : i + 4]).isascii())
    return {p for p in out if "\ufffd" not in p}


def train(df: DataFrame, text: str, lang: str, names: list[str], counts: dict[tuple[str, str], int]) -> dict[str, bytes]:
    """The dictionary of each language, from the pieces of all documents.

    Documents of no known language have one too, if they are enough. What reaches the driver is bounded by the languages and ``PIECES``.
    """
    rows = df.filter(F.length(f"`{text}`") > 0).select(_label(lang, names).alias("l"), F.col(f"`{text}`").alias("t"))

    def frame(n: Counter) -> pd.DataFrame:
        return pd.DataFrame({"l": [l for l, _ in n], "piece": [p for _, p in n], "n": list(n.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for l, t in zip(pdf["l"], pdf["t"]):
                n.update((l, p) for p in pieces(t))
                if len(n) > 4 * KEPT:
                    yield frame(n)
                    n.clear()
        yield frame(n)

    counted = spread(rows).mapInPandas(run, "l string, piece string, n long").repartition("piece").groupBy("l", "piece").agg(F.sum("n").alias("n"))
    # a match costs some three bytes; what one document holds says nothing of a language
    saved = F.col("n") * (F.octet_length("piece") - 3)
    told = counted.withColumn("everywhere", F.sum("n").over(Window.partitionBy("piece"))).filter((F.col("n") > 1) & (saved > 0))
    ranked = told.withColumn("at", F.row_number().over(Window.partitionBy("l").orderBy(saved.desc(), "piece"))).filter(F.col("at") <= PIECES)
    best: dict[str, dict[str, int]] = {}
    everywhere: dict[str, int] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["l"], r["at"])):
        best.setdefault(r["l"], {})[r["piece"]] = r["n"]
        everywhere[r["piece"]] = r["everywhere"]
    known = [*names, *([UNKNOWN] if counts.get((UNKNOWN, ""), 0) >= LEAST_DOCUMENTS else [])] if names else [""]
    model = Model(dict.fromkeys(known, b""), counts)
    return {l: _dictionary(best.get(l or UNKNOWN, {}), everywhere, model, at) for at, l in enumerate(known)}


def _dictionary(ranked: dict[str, int], everywhere: dict[str, int], model: Model, at: int) -> bytes:
    """The dictionary trained on the pieces that are not garbled, each in as many rounds as its count has bits."""
    usable = [(f" {p}".encode("utf-8", "surrogatepass"), n.bit_length()) for p, n in ranked.items() if p.isascii() or _clean(p, everywhere, model, at)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [p for k in range(max((b for _, b in usable), default=0)) for p, b in usable if b > k], k=256, d=8, level=3).as_bytes()
    except zstandard.ZstdError:  # too little text
        return b"".join(p for p, _ in reversed(usable))[-DICTIONARY_BYTES:]


def _clean(piece: str, everywhere: dict[str, int], model: Model, at: int) -> bool:
    """Whether no other reading of a piece is likelier, by its code of letters in the language and the documents that hold it.

    A reading as UTF-8 needs one of both. A mix-up of single-byte codecs makes the letters of many a clean piece shorter (``PEÇAS``), so that both are added.
    """
    own = model.letters.text(piece)[at]
    facts, longer = model.shifts(piece)
    for k in np.flatnonzero(~np.isnan(longer)):
        t = _read(piece, facts, k)
        shorter, oftener = own - model.letters.text(t)[at], math.log2((everywhere.get(t, 0) + 1) / (everywhere[piece] + 1))
        if shorter + oftener > 0 if IS_MIXUP[k] else max(shorter, oftener) > 0:
            return False
    return True


def repaired(df: DataFrame, key: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, restored, chains, lost, garbled) of every row with text; ``restored`` equals the text where nothing is garbled."""
    names = languages(df, text, lang)
    counts = count_letters(df, text, lang, names)
    shared = df.sparkSession.sparkContext.broadcast((train(df, text, lang, names, counts), counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for pdf in batches:
            got = [restore(t, model) for t in pdf["__text"]]
            yield pd.DataFrame({key: pdf[key], "restored": [g[0] for g in got], "chains": [g[1] for g in got], "lost": [g[2] for g in got]})

    rows = df.select(key, F.col(f"`{text}`").alias("__text")).filter(F.col("__text").rlike(r"[^\x00-\x7F]"))
    done = spread(rows).mapInPandas(run, rows.select(key, F.col("__text").alias("restored"), F.array(F.lit("")).alias("chains"), F.lit(True).alias("lost")).schema)
    return done.withColumn("garbled", (F.size("chains") > 0) | F.col("lost"))

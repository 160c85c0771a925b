"""Titles and descriptions of product listings, read into comparable tokens.

A token says the same thing whatever the unit, case, order or spelling of marks: a model code, a word or words that may name a
model or a variety, a size in a base unit. Which words are names is not known here: descriptions state attributes under their
names (``Modelo: ...``, ``colour ...``), and what stands there anywhere in the table is looked up elsewhere
(:mod:`tesela.llm.same_product`).
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import xxhash

# The names of attributes in Spanish, Portuguese and English, without accents.
MODEL_NAMES = "modelo model"
VARIETY_NAMES = "color colour cor variedad variedade variety"
SIZE_NAMES = "medida tamanho size"

# Units and their factor to the base unit of their kind.
UNITS = {
    **dict.fromkeys(("ml", "cc", "mililitros", "milliliters"), ("v", 1.0)),
    **dict.fromkeys(("l", "lt", "litro", "litros", "liter", "liters", "litre", "litres"), ("v", 1000.0)),
    **dict.fromkeys(("g", "gr", "gramo", "gramos", "gram", "grams", "grama", "gramas"), ("g", 1.0)),
    **dict.fromkeys(("kg", "kilo", "kilos", "quilo", "quilos", "kilogramos", "kilograms", "kilogram", "quilogramas"), ("g", 1000.0)),
    **dict.fromkeys(("mm", "milimetros", "millimeters"), ("d", 1.0)),
    **dict.fromkeys(("cm", "centimetros", "centimeters"), ("d", 10.0)),
    **dict.fromkeys(("m", "mt", "metro", "metros", "meter", "meters"), ("d", 1000.0)),
    **dict.fromkeys(("in", "inch", "inches", "pulgada", "pulgadas", "polegada", "polegadas", "''", "″", '"', "”"), ("d", 25.4)),
    **dict.fromkeys(("w", "watt", "watts", "vatio", "vatios"), ("w", 1.0)),
    **dict.fromkeys(("kw", "kilowatts"), ("w", 1000.0)),
    **dict.fromkeys(("mah",), ("a", 1.0)),
    **dict.fromkeys(("ah",), ("a", 1000.0)),
    **dict.fromkeys(("pzas", "pza", "pcs", "unidades", "un", "count", "und", "uds", "ct"), ("n", 1.0)),
}
_UNIT = "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True))
# Numbers are looked for first, as texts hold few; what stands before them is looked at then.
_NUMBER = re.compile(rf"(\d+(?:[.,]\d+)?)(?:\s?({_UNIT})(?![a-z0-9]))?")
_COUNTED = re.compile(r"(?:\b(?:set|pack|pacote|caja|caixa|box) (?:of|de|com|con) |(?<![a-z0-9])x)$")
#: A code: letters, a mark or blank, digits (some misread as letters, some parted by a mark), a short ending (apart from it one consonant, as a vowel is a word).
_HEAD = re.compile(r"(?<![a-z0-9])([a-z]{2,6})([ ./-]?)([oil]{0,2})$")
_TAIL = re.compile(r"([0-9][0-9oil]{0,4}(?:[ .-][0-9oil]{2,4}(?=(?:-?[a-z]{1,2}[0-9]?| [b-df-hj-np-tv-xz])?(?![a-z0-9])))?)(?:(-?)([a-z]{1,2}[0-9]?)|( )([b-df-hj-np-tv-xz]))?(?![a-z0-9])")
_DIGITS = str.maketrans("oil", "011", " .-")
_WORD = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*\+?")
_SAME = {"ii": "2", "iii": "3"}
_FOLD = {ord(c): unicodedata.normalize("NFD", c)[0] for c in "áéíóúàèìòùâêîôûãõäëïöüñçý"}
_LATIN = bytes(ord(_FOLD.get(b, chr(b))) for b in range(256))
_MARKS = re.compile("[̀-ͯ]")


_KIND = {n: k for k, names in (("m", MODEL_NAMES), ("v", VARIETY_NAMES), ("s", SIZE_NAMES)) for n in names.split()}
_UNDER = {n: i for i, n in enumerate(VARIETY_NAMES.split())}
#: The name of an attribute and what follows up to a mark; a stated value has some words, not more than 80 characters.
_STATED = re.compile(rf"\b({'|'.join(_KIND)})\b:?\s+(?=([^,;:\n()|]{{1,80}}))")
_DIGIT = re.compile(r"[0-9]")
_END = re.compile(r"\.(?:\s|$)| - ")


class Tokens(NamedTuple):
    """What a listing says, names by their hashes. ``codes``, ``models``, ``varieties`` and ``sizes`` are stated, varieties ``under`` a name of the attribute; ``grams`` are one or two words
    of the title, then codes whose letters and digits stand apart, then, where a kind is not stated, the same of the description; a listing
    with a code and a stated variety needs none. ``at`` tells for each its place times four and its length."""

    codes: list[int]
    models: list[int]
    varieties: list[int]
    under: list[int]
    sizes: list[str]
    grams: list[int]
    at: list[int]


#: Places by which a token of the description stands behind those of the title.
BEHIND = 1000


def hashed(name: str) -> int:
    """60 bits."""
    return xxhash.xxh64_intdigest(name) >> 4


def folded(text: str) -> str:
    """In lower case, without accents."""
    t = text.lower()
    if t.isascii():
        return t
    try:
        return t.encode("latin-1").translate(_LATIN).decode("latin-1")
    except UnicodeEncodeError:
        t = t.translate(_FOLD)
        return _MARKS.sub("", t) if _MARKS.search(t) else t


def measure(number: str, unit: str) -> str:
    """A size in its base unit; lengths, which are also given in rounded inches, to 5 mm from 100 mm on."""
    kind, factor = UNITS[unit]
    value = float(number.replace(",", ".")) * factor
    return f"{kind}{round(value / 5) * 5 if kind == 'd' and value >= 100 else round(value, 3):g}"


def sizes(t: str) -> tuple[list[str], str]:
    """The sizes of a folded text, and the text without them."""
    out: list[str] = []

    def take(m: re.Match[str]) -> str:
        at = m.start()
        before = t[at - 1] if at else " "
        if m.group(2) and not ("a" <= before <= "z" or "0" <= before <= "9" or before in ".,/-"):
            out.append(measure(m.group(1), m.group(2)))
            return " | "
        after = t[m.end(1) : m.end(1) + 1]
        if before in " x" and not ("a" <= after <= "z") and m.group(1).isdigit() and _COUNTED.search(t[max(0, at - 12) : at]):
            out.append(f"n{int(m.group(1)):d}")
            return " | " + m.group()[len(m.group(1)) :]
        return m.group()

    rest = _NUMBER.sub(take, t)
    return out, rest


def codes(t: str) -> tuple[list[str], list[str]]:
    """(codes written in one, codes whose letters and digits a blank parts) of a folded text."""
    one, loose, end_of_last = [], [], 0
    for m in _TAIL.finditer(t):
        if m.start() < end_of_last:
            continue
        head_ = _HEAD.search(t[max(0, m.start() - 10) : m.start()])
        if head_ is None:
            continue
        end_of_last = m.end()
        (head, mark, misread), (digits, _, end, space, apart) = head_.groups(), m.groups()
        digits = misread + digits
        end = end or apart
        digits = digits.translate(_DIGITS)
        if len(digits) < 2:
            continue
        # an ending apart that is a unit belongs to a size
        code = head + digits + (end if end and not (end in UNITS and (space or mark == " ")) else "")
        (loose if mark == " " else one).append(code)
    return one, loose


def joined(words: list[str]) -> str:
    """A name without the marks by which its spellings differ."""
    last = words[-1]
    if last.endswith("+"):
        last = f"{last[:-1]}plus"
    elif len(words) > 1:
        last = _SAME.get(last, last)
    return "".join([*words[:-1], last])


def _words(t: str) -> list[str]:
    return [joined(w.split("-")) if "-" in w or w[-1] == "+" else w for w in _WORD.findall(t)]


def name(value: str) -> str | None:
    """A stated name of at most four words."""
    words = _words(value)
    return joined(words) if 0 < len(words) <= 4 and len("".join(words)) > 2 else None


def _grams(t: str, loose: list[str], first: int) -> list[tuple[str, int]]:
    words, out = _words(t), []
    for at, (w, after) in enumerate(zip(words, [*words[1:], ""]), first):
        if w[0] > "9":
            if len(w) > 2:
                out.append((w, 4 * at + 1))
            if after:
                out.append((w + _SAME.get(after, after), 4 * at + 2))
    return out + [(c, 4 * (first + len(words) + i) + 3) for i, c in enumerate(loose)]


def read(title: str | None, description: str | None) -> Tokens:
    """What a title and a description say, each kind in the order of appearance and without repeats."""
    t, d = folded(title or ""), folded(description or "")
    found, rest = sizes(t)
    models, varieties, stated, (one, loose) = [], {}, [], codes(rest)
    for m in _STATED.finditer(d):
        kind, value = _KIND[m.group(1)], _END.split(m.group(2), 1)[0]
        if kind == "s":
            stated += sizes(value)[0][:1]
        elif kind == "v":
            if (got := name(value)) is not None:
                varieties.setdefault(got, _UNDER[m.group(1)])
        elif _DIGIT.search(value) and any(c := codes(value.strip())):
            one = one + [*c[0], *c[1]][:1]
        else:
            models.append(name(sizes(value)[1]))
    found = found + stated or sizes(d)[0]
    models = [n for n in models if n]
    grams = [] if one and varieties else _grams(rest, loose, 0)
    if not varieties or not (one or models):
        body = sizes(d)[1]
        in_one, in_loose = codes(body)
        grams = [] if one + in_one and varieties else grams + _grams(body, in_loose, BEHIND)
        one = one + in_one
    places: dict[str, int] = {}
    for g, at in grams:
        places.setdefault(g, at)
    keep = lambda x: [hashed(n) for n in dict.fromkeys(x)]
    return Tokens(keep(one), keep(models), keep(varieties), list(varieties.values()), list(dict.fromkeys(found)), [hashed(g) for g in places], list(places.values()))

"""Great-circle distance and coordinates read from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere in km (fixed value of the distance definition).
EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; the argument of asin is held to 1, so that antipodes give half the girth."""
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def valid_point(lat: Column, lon: Column) -> Column:
    """Whether both coordinates are numbers in range (null and NaN are not)."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


#: Bits of a cell along each axis: 2**16 cells around the globe, about 600 m wide at the equator.
CELL_BITS = 16


def _apart(c: Column) -> Column:
    """The bits of a number of ``CELL_BITS`` bits, each followed by a zero bit."""
    c = c.cast("long")
    for shift in (8, 4, 2, 1):
        keep = sum(((1 << shift) - 1) << k for k in range(0, 2 * CELL_BITS, 2 * shift))
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(keep))
    return c


def z_cell(lon: Column, lat: Column) -> Column:
    """The place on a Z-order curve of a point's cell, so that near places have near codes."""
    top = 2**CELL_BITS
    x, y = (F.greatest(F.lit(0), F.least(F.lit(top - 1), F.floor((v + half) * (top / (2 * half))))) for v, half in ((lon, 180.0), (lat, 90.0)))
    return F.shiftleft(_apart(y), 1).bitwiseOR(_apart(x))


_NUMBER = r"(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)"


def coordinate(text: Column, positive: str, negative: str, limit: float) -> Column:
    """Degrees from ``-12.5``, ``+12,5`` or ``12.5 S``; null where the text is not such a number or out of range.

    ``positive`` and ``negative`` hold the compass letters; a text has a sign or a letter, not both.
    """
    # one pattern says whether it is a coordinate; what it is then follows from its characters
    pattern = rf"(?i)^\s*(?:[+-]?\s*{_NUMBER}|{_NUMBER}\s*[{positive}{negative}])\s*$"
    blanks, marks = " \t\n\r\f\x0b", f"{positive}{negative}{positive.lower()}{negative.lower()}+-"
    digits = F.translate(F.translate(text, blanks + marks, ""), ",", ".")
    letter = F.upper(F.translate(text, blanks + "0123456789.,+-", ""))
    minus = F.contains(text, F.lit("-")) | letter.isin(*negative)
    value = F.when(text.rlike(pattern), digits.try_cast("double") * F.when(minus, -1.0).otherwise(1.0))
    return F.when(value.between(-limit, limit), value)


def latitude(text: Column) -> Column:
    return coordinate(text, "N", "S", 90.0)


def longitude(text: Column) -> Column:
    return coordinate(text, "E", "WO", 180.0)

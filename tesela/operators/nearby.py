"""Points near other points, by cells on a space-filling curve.

A place on the globe is a point of the unit sphere, so neither the poles nor the 180th meridian need special care. Space is
cut into cubes of a side chosen from the largest radius; a cube's place on the Z-order curve is its code. A disc is covered by
the code ranges of the cubes that touch both its ball and the sphere; points and ranges meet in a join on the curve's coarser
block and on ``lo <= code <= hi``, and the exact great-circle distance decides.

The join streams in the JVM and spills, its key is a block of 2 x 2 x 2 cubes, and a dense block is split by adaptive skew
handling; no group is held in one place.

Defined results: rows without a usable position take no part; two ids at one place are at distance 0; repeated rows of an id
count once, with the position of the latest row; a radius of 0 finds equal places; a negative or null radius finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions.geo import CELL_BITS, EARTH_KM, haversine_km, z_cell
from tesela.runtime import broadcast_if_small, cut

#: Finest level: 2**20 cubes along each axis, 60 bits a code; a cube is then 12 m wide.
FINEST = 20
#: Levels of quarters below the size of a box down to which it is covered, and the level of the blocks in which points and boxes meet.
BOX_LEVELS, BLOCK_LEVEL = 4, 6
#: Points of a cube from which on it is dealt to several keys.
HOT = 4000


def _spread(c: Column) -> Column:
    """Put two zero bits between the bits of a 20-bit number (fixed masks of the usual Morton encoding)."""
    c = c.cast("long")
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        c = F.shiftleft(c, shift).bitwiseOR(c).bitwiseAND(F.lit(mask))
    return c


def morton(x: Column, y: Column, z: Column) -> Column:
    return F.shiftleft(_spread(x), 2).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(_spread(z))


def _unit(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def _level(radius_km: float) -> int:
    """The finest level whose cubes are at least as wide as the chord of the radius."""
    chord = 2 * math.sin(min(radius_km / EARTH_KM, math.pi) / 2)
    return max(1, min(FINEST, int(math.floor(math.log2(2 / max(chord, 2 / 2**FINEST))))))


def _cube(v: Column, level: int) -> Column:
    side = 2 / 2**level
    return F.greatest(F.lit(0), F.least(F.lit(2**level - 1), F.floor((v + 1) / side)))


def coded(points: DataFrame, key: str, lat: str, lon: str, level: int) -> DataFrame:
    """(id, la, lo, code, block): each point with its cube's code and the code of the block of 8 cubes around it."""
    p = points.select(F.col(key).alias("id"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo"))
    p = p.filter("la between -90 and 90 and lo between -180 and 180")
    code = morton(*[_cube(v, level) for v in _unit(F.col("la"), F.col("lo"))])
    return p.withColumn("code", code).withColumn("block", F.shiftright("code", 3))


def cover(discs: DataFrame, key: str, lat: str, lon: str, radius_km: str, level: int) -> DataFrame:
    """(id, la, lo, r, block, from, to): the code ranges that cover each disc; a range is a run of codes inside one block."""
    d = discs.select(F.col(key).alias("id"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo"), F.col(radius_km).cast("double").alias("r"))
    d = d.filter("la between -90 and 90 and lo between -180 and 180 and r >= 0")
    side = 2 / 2**level
    c = 2 * F.sin(F.least(F.col("r") / EARTH_KM, F.lit(math.pi)) / 2) + 1e-9

    def facts(v: Column):
        # of a cube index: the squared gap to the centre, and the squared least and greatest distance to the sphere's centre
        def of(i: Column) -> Column:
            low = i * side - 1
            gap, least, most = F.greatest(low - v, v - low - side, F.lit(0.0)), F.greatest(low, -(low + side), F.lit(0.0)), F.greatest(F.abs(low), F.abs(low + side))
            return F.struct(i.alias("i"), (gap * gap).alias("g"), (least * least).alias("n"), (most * most).alias("m"))

        return of

    axes = [F.transform(F.sequence(_cube(v - c, level), _cube(v + c, level)), facts(v)) for v in _unit(F.col("la"), F.col("lo"))]
    d = d.withColumn("c2", c * c).withColumn("ax", axes[0]).withColumn("ay", axes[1]).withColumn("az", axes[2])

    def cube(x: Column, y: Column, z: Column) -> Column:
        touches = (x["g"] + y["g"] + z["g"] <= F.col("c2")) & (x["n"] + y["n"] + z["n"] <= 1 + 1e-9) & (x["m"] + y["m"] + z["m"] >= 1 - 1e-9)
        return F.when(touches, morton(x["i"], y["i"], z["i"]))

    codes = F.flatten(F.transform("ax", lambda x: F.flatten(F.transform("ay", lambda y: F.transform("az", lambda z: cube(x, y, z))))))
    d = d.select("id", "la", "lo", "r", F.array_sort(F.array_compact(codes)).alias("codes"))
    first = F.filter("codes", lambda k: (k % 8 == 0) | ~F.array_contains("codes", k - 1))
    last = F.filter("codes", lambda k: (k % 8 == 7) | ~F.array_contains("codes", k + 1))
    d = d.select("id", "la", "lo", "r", F.explode(F.arrays_zip(first.alias("from"), last.alias("to"))).alias("range"))
    return d.select("id", "la", "lo", "r", F.shiftright("range.from", 3).alias("block"), "range.from", "range.to")


def _meet(points: DataFrame, discs: DataFrame) -> DataFrame:
    """(disc, point, km) from coded points and covered discs."""
    p = points.select(F.col("id").alias("point"), F.col("la").alias("pla"), F.col("lo").alias("plo"), F.col("code").alias("pcode"), "block")
    met = discs.join(p, "block").filter("pcode between `from` and `to`")
    km = haversine_km(F.col("la"), F.col("lo"), F.col("pla"), F.col("plo"))
    return met.select(F.col("id").alias("disc"), "point", km.alias("km"), "r").filter("km <= r").select("disc", "point", "km")


def within(points: DataFrame, discs: DataFrame, *, point_key: str, disc_key: str, radius_km: str, max_radius_km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(disc, point, km): every point inside every disc; the discs' radius is a column, at best not above ``max_radius_km``.

    ``max_radius_km`` sets the size of the cubes; a larger radius is covered by more of them and stays exact. With discs as
    regions, this finds the regions that contain each point.
    """
    level = _level(max_radius_km)
    return _meet(coded(points, point_key, lat, lon, level), cover(discs, disc_key, lat, lon, radius_km, level))


def _steps() -> list[tuple[int, int, int]]:
    """A cube itself and the half of its neighbours that come after it, so that two neighbours meet once."""
    every = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    return [s for s in every if s >= (0, 0, 0)]


def pairs(points: DataFrame, radius_km: float, *, key: str, lat: str = "lat", lon: str = "lon", hot: int = HOT) -> DataFrame:
    """(a, b, km): all pairs of different ids a < b at most ``radius_km`` apart. Ids must be unique; null ids take no part.

    All discs are of one size, and a cube is at least as wide: a disc's ranges are its own cube and the neighbours that it
    touches, each a range of one code, by plain arithmetic. A cube of more than ``hot`` points is dealt to several keys.
    """
    if not radius_km >= 0:
        return _meet(coded(points, key, lat, lon, 1), cover(points.withColumn("__r", F.lit(None).cast("double")), key, lat, lon, "__r", 1)).toDF("a", "b", "km")
    # cubes of two to four discs: few discs leave their cube
    level = max(1, _level(radius_km) - 1)
    side, chord = 2 / 2**level, 2 * math.sin(min(radius_km / EARTH_KM, math.pi) / 2) + 1e-9
    p = points.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo")).filter("la between -90 and 90 and lo between -180 and 180")
    names = dict(zip((-1, 0, 1), ("before", "here", "after")))
    place, gap = [], []
    for axis, shift, v in zip("xyz", (2, 1, 0), _unit(F.col("la"), F.col("lo"))):
        cube = _cube(v, level)
        place += [cube.alias(f"i{axis}"), (v + 1 - cube * side).alias(f"f{axis}")]
        gap += [F.shiftleft(_spread(F.col(f"i{axis}") + s), shift).alias(f"{n}_{axis}") for s, n in names.items()]
    p = p.select("id", "la", "lo", *place).select("*", *gap)
    p = p.withColumn("code", F.col("here_x").bitwiseOR(F.col("here_y")).bitwiseOR(F.col("here_z")))

    def near(x: int, y: int, z: int) -> Column:
        gaps = [{-1: F.col(f"f{a}"), 0: F.lit(0.0), 1: side - F.col(f"f{a}")}[s] for a, s in zip("xyz", (x, y, z))]
        inside = sum((g * g for g in gaps), F.lit(0.0)) <= chord * chord
        for a, s in zip("xyz", (x, y, z)):
            inside = inside & {-1: F.col(f"i{a}") > 0, 0: F.lit(True), 1: F.col(f"i{a}") < 2**level - 1}[s]
        return F.when(inside, F.col(f"{names[x]}_x").bitwiseOR(F.col(f"{names[y]}_y")).bitwiseOR(F.col(f"{names[z]}_z")))

    p = cut(p)
    crowded = p.groupBy("code").agg(F.ceil(F.count("*") / hot).cast("int").alias("deals")).filter("deals > 1").withColumnRenamed("code", "crowd")
    # a crowded cube holds more than ``hot`` points, so there are few; without any, nothing is dealt
    dealt = None if crowded.isEmpty() else broadcast_if_small(cut(crowded))
    probes = p.select("id", "la", "lo", F.col("code").alias("own"), F.explode(F.array(*[near(*s) for s in _steps()])).alias("code")).filter("code is not null")
    stored = p.select(F.col("id").alias("to"), F.col("la").alias("tla"), F.col("lo").alias("tlo"), "code")
    on = ["code"]
    if dealt is not None:
        probes = probes.join(dealt, F.col("code") == F.col("crowd"), "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("crowd", "deals")
        stored = stored.join(dealt, F.col("code") == F.col("crowd"), "left").withColumn("deal", F.pmod(F.xxhash64("to"), F.coalesce("deals", F.lit(1))).cast("int")).drop("crowd", "deals")
        on = ["code", "deal"]
    met = probes.join(stored, on).filter((F.col("own") != F.col("code")) | (F.col("id") < F.col("to")))
    km = haversine_km(F.col("la"), F.col("lo"), F.col("tla"), F.col("tlo"))
    return met.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"), km.alias("km")).filter(F.col("km") <= radius_km)


def _quarters(box: tuple[float, float, float, float]) -> Iterator[tuple[int, int]]:
    """The code ranges of ``z_cell`` that cover a box (south, west, north, east): quarters of the plane, halved until they lie inside or are ``BOX_LEVELS`` deep."""
    south, west, north, east = box
    if west > east:  # across the 180th meridian
        yield from _quarters((south, west, north, 180.0))
        yield from _quarters((south, -180.0, north, east))
        return
    # the deepest level is as fine as the box's shorter side needs, so that a cover has a bounded number of ranges
    depth = min(CELL_BITS, BOX_LEVELS + max(0, int(math.log2(180 / max(min(north - south, (east - west) / 2), 180 / 2**CELL_BITS)))))
    todo = [(0, -90.0, -180.0, 0)]
    while todo:
        level, lat, lon, code = todo.pop()
        high, wide = 180 / 2**level, 360 / 2**level
        if lat > north or lat + high < south or lon > east or lon + wide < west:
            continue
        inside = south <= lat and lat + high <= north and west <= lon and lon + wide <= east
        # a range lies in one block: wider quarters are cut down to blocks
        if level >= BLOCK_LEVEL and (inside or level >= depth):
            first = code << 2 * (CELL_BITS - level)
            yield first, first + (1 << 2 * (CELL_BITS - level)) - 1
        else:
            todo += [(level + 1, lat + q * high / 2, lon + r * wide / 2, code << 2 | q << 1 | r) for q in (0, 1) for r in (0, 1)]


def containing(points: DataFrame, boxes: DataFrame, *, point_key: str, box_key: str, lat: str = "lat", lon: str = "lon", sides: tuple[str, str, str, str] = ("south", "west", "north", "east")) -> DataFrame:
    """(box, point): every point inside every box, borders included; a box with ``west`` above ``east`` lies across the 180th meridian.

    Boxes are covered by ranges of the points' cells, points and ranges meet in a join on the curve's blocks, and the box decides.
    Boxes with a null side or ``south`` above ``north``, and points without a position, take no part.
    """
    b = boxes.select(F.col(box_key).alias("box"), *[F.col(c).cast("double").alias(n) for c, n in zip(sides, ("south", "west", "north", "east"))]).filter("south <= north and west is not null and east is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                got = np.array(sorted(set(_quarters(tuple(row[1:])))), np.int64).reshape(-1, 2)
                yield pd.DataFrame({**{c: [v] * len(got) for c, v in zip(pdf.columns, row)}, "from": got[:, 0], "to": got[:, 1]})

    shift = 2 * (CELL_BITS - BLOCK_LEVEL)
    ranges = cut(b.mapInPandas(run, b.select("*", F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("to")).schema).withColumn("block", F.shiftright("from", shift)))
    p = points.select(F.col(point_key).alias("point"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo")).filter("la between -90 and 90 and lo between -180 and 180")
    p = p.withColumn("code", z_cell(F.col("lo"), F.col("la"))).withColumn("block", F.shiftright("code", shift))
    met = p.join(broadcast_if_small(ranges, row_bytes=96), "block").filter("code between `from` and `to`")
    return met.filter("la between south and north and case when west <= east then lo between west and east else lo >= west or lo <= east end").select("box", "point").distinct()


def latest(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """One row for each key that is not null: the values of its latest row (ties: the greatest values)."""
    best = F.max(F.struct(F.col(at).alias("__at"), *[F.col(c) for c in columns])).alias("__best")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"__best.{c}").alias(c) for c in columns])

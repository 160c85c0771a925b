import math
import random

from pyspark.sql import functions as F

from tesela.functions.geo import latitude, longitude
from tesela.operators import bad_rows, nearby, packed_fields
from tesela import runtime
from tesela.runtime import with_ids


def test_with_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = with_ids(df, ["v"], "n", 5).collect()
    assert all(r["v"] == r["n"] for r in got) and len(got) == 1000
    assert with_ids(df.limit(0), ["v"], "n").count() == 0


def test_lookup_of_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None), (998, "none")], "i long, last string")
    known = rows.filter("last is not null and last <> 'none'").groupBy(F.col("last").alias("word")).agg(F.count("*").alias("n")).withColumn("seen", F.concat("word", F.lit("!")))
    small = sorted(map(str, runtime.lookup(rows, "last", known, "word", "n").collect()))
    monkeypatch.setattr(runtime, "BROADCAST_LIMIT", 0)
    assert sorted(map(str, runtime.lookup(rows, "last", known, "word", "n").collect())) == small and len(small) == 302


def test_clean_up(spark):
    kept = runtime.cut(spark.range(5))
    assert kept.count() == 5 and runtime.clean_up(spark) > 0 and runtime.clean_up(spark) == 0


def test_record_states():
    parse = bad_rows.parse_record
    assert parse("a,b") == (["a", "b"], "ok")
    assert parse("") == ([""], "ok")
    assert parse('"a ""q"", x",b,') == (['a "q", x', "b", ""], "ok")
    assert parse('"a')[1] == "quote not closed"
    assert parse('"a"b,c')[1] == "text after closing quote"
    assert parse('a"b')[1] == "quote in unquoted field"
    assert parse("a\nb")[1] == "line break in unquoted field"
    assert parse(None)[1] == "null record"
    assert parse('"' + '""' * 50_000 + '"')[1] == "ok"


def test_bad_rows(spark):
    rows = [(1, 'i,n,c,$1.50,u,"d, e"'), (2, "i,n,c,1,2"), (3, "i,n,c,abc,u,d"), (4, "i,n,c,,u,bad\x01"), (5, "i,n,c,$1 - $2,u,d�"), (None, "i,n,c,1,u,d"), (None, "x"), (6, None), (1, "x"), (7, 'i,n,c,"1,000",u,d'), (8, "i,n,c,1,,d"), (8, "i,n,c,1,,d")]
    df = spark.createDataFrame(rows, "line_id long, raw_line string").withColumn("name", F.lit("kept"))
    clean, failed = bad_rows.judge(df, "raw_line", "line_id")
    good = bad_rows.products(clean)
    assert sorted((str(r["line_id"]), r["price"]) for r in good.collect()) == [("1", 1.5), ("7", 1000.0), ("8", 1.0), ("8", 1.0), ("None", 1.0)]
    assert {r["in_name"] for r in good.collect()} == {"kept"}
    why = {(r["line_id"], r["raw_line"]): r["reasons"] for r in failed.collect()}
    assert why[2, "i,n,c,1,2"] == ["column count"] and why[3, "i,n,c,abc,u,d"] == ["invalid price"]
    assert why[5, "i,n,c,$1 - $2,u,d�"] == ["invalid characters in description"] and why[6, None] == ["null record"]
    assert len(why) == 7
    assert bad_rows.errors(df.limit(0), "raw_line", "line_id").count() == 0


def test_packed(spark):
    cat = ["A > B > C"] * 5 + ["A | B"] * 5 + ['"A, x" > B'] * 5 + ["'A, x'; B"] * 3 + ["A\\, x | B", '["A, x", "B"]', "A > B | C", "Kid's Art/B", 'B/"P 24"" y"', "", None, "  ", "one", ";A;  ;B;"]
    df = spark.createDataFrame([(i, c, None) for i, c in enumerate(cat)], "fila long, category string, image string").withColumn("pos", F.lit(9))
    got = {}
    for r in packed_fields.unpack(df, {"category": packed_fields.CATEGORY}, ["fila"]).orderBy("fila", "pos").collect():
        got.setdefault(r["fila"], []).append(r["item"])
    assert got[0] == ["A", "B", "C"] and got[10] == ["A, x", "B"] and got[15] == ["A, x", "B"]
    assert got[18] == ["A, x", "B"] and got[19] == ["A, x", "B"] and got[20] == ["A", "B", "C"]
    assert got[21] == ["Kid's Art", "B"] and got[22] == ["B", 'P 24" y'] and got[26] == ["one"] and got[27] == ["A", "B"]
    assert not {23, 24, 25} & set(got)
    assert packed_fields.unpack(df.limit(0), {"category": packed_fields.CATEGORY}, ["fila"]).count() == 0


def test_packed_images(spark):
    u = "https://x.example/w_200,h_200/{}.jpg"
    img = [f'["{u.format(i)}", "{u.format(i + 1)}"]' for i in range(20)] + [u.format(1), f"{u.format(1)} {u.format(2)}", f"{u.format(1)};{u.format(2)};", f'"{u.format(1)}","{u.format(2)}"'] + ["a1_1.jpg"] * 9 + ["a1_1.jpg,a1_2.png"]
    df = spark.createDataFrame(list(enumerate(img)), "fila long, image string")
    got = {}
    for r in packed_fields.unpack(df, {"image": packed_fields.IMAGE}, ["fila"]).orderBy("pos").collect():
        got.setdefault(r["fila"], []).append(r["item"])
    assert got[20] == [u.format(1)] and all(got[k] == [u.format(1), u.format(2)] for k in (21, 22, 23)) and got[33] == ["a1_1.jpg", "a1_2.png"]


def _km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 12742 * math.asin(min(1, math.sqrt(h)))


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    pts = [(rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2)) for _ in range(150)] + [(rng.uniform(89.8, 90), rng.uniform(-180, 180)) for _ in range(40)] + [(rng.uniform(-0.1, 0.1), 180 - rng.uniform(0, 0.1)) for _ in range(30)] + [(rng.uniform(-0.1, 0.1), -180 + rng.uniform(0, 0.1)) for _ in range(30)] + [(10.0, 10.0)] * 3
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)] + [(None, 10.0, 10.0), (999, None, 1.0)], "k long, lat double, lon double")
    for radius in (3.0, 40.0, 0.0):
        want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if _km(pts[i], pts[j]) <= radius}
        for hot in (nearby.HOT, 3):  # crowded cubes are dealt to several keys
            got = [(r["a"], r["b"]) for r in nearby.pairs(df, radius, key="k", hot=hot).collect()]
            assert set(got) == want and len(got) == len(want)
    assert nearby.pairs(df, -1.0, key="k").count() == 0
    regions = spark.createDataFrame([("r", 0.0, 0.0, 10.0), ("n", 0.0, 0.0, None)], "id string, lat double, lon double, r double")
    inside = {r["point"] for r in nearby.within(df, regions, point_key="k", disc_key="id", radius_km="r", max_radius_km=10).collect()}
    assert inside == {i for i, p in enumerate(pts) if _km(p, (0, 0)) <= 10}
    assert nearby.pairs(df.limit(0), 3.0, key="k").count() == 0


def test_containing_equals_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(1500)] + [(9001, 0.0, 180.0), (9002, 0.0, -180.0), (9003, 90.0, 0.0), (9004, None, 1.0), (9005, 10.0, 10.0), (9005, 10.0, 10.0)]
    boxes = [("globe", -90.0, -180.0, 90.0, 180.0), ("across", -20.0, 170.0, 20.0, -170.0), ("small", 9.9, 9.9, 10.1, 10.1), ("point", 10.0, 10.0, 10.0, 10.0), ("strip", -1.0, -180.0, 1.0, 180.0), ("none", 5.0, 0.0, -5.0, 1.0), ("null", None, 0.0, 1.0, 1.0), ("pole", 80.0, -50.0, 90.0, 60.0)]
    df, regions = spark.createDataFrame(pts, "k long, lat double, lon double"), spark.createDataFrame(boxes, "name string, south double, west double, north double, east double")
    got = sorted((r["box"], r["point"]) for r in nearby.containing(df, regions, point_key="k", box_key="name").collect())
    inside = lambda la, lo, s, w, n, e: s <= la <= n and (w <= lo <= e if w <= e else lo >= w or lo <= e)
    want = sorted({(b[0], k) for b in boxes if None not in b for k, la, lo in pts if la is not None and inside(la, lo, *b[1:])})
    assert got == want
    assert nearby.containing(df.limit(0), regions, point_key="k", box_key="name").count() == 0 == nearby.containing(df, regions.limit(0), point_key="k", box_key="name").count()


def test_coordinates(spark):
    df = spark.createDataFrame([("12.5",), (" 12,5 ",), ("12.5 S",), ("12.5O",), ("-12.5",), ("+1",), ("-",), ("N/D",), ("95",), (None,), ("",), ("- 12,5",), ("-12.5 S",), ("12.5 n",), ("1 2",), ("12.",), (".5\t",)], "t string")
    got = [tuple(r) for r in df.select(latitude(F.col("t")), longitude(F.col("t"))).collect()]
    assert got == [(12.5, 12.5), (12.5, 12.5), (-12.5, None), (None, -12.5), (-12.5, -12.5), (1.0, 1.0), (None, None), (None, None), (None, 95.0), (None, None), (None, None), (-12.5, -12.5), (None, None), (12.5, None), (None, None), (12.0, 12.0), (0.5, 0.5)]

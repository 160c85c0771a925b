import math
import random

import pytest
from pyspark.sql import functions as F

from tesela.llm import encoding, leaks, listings, packing, same_product, terms, truncation


def test_terms(spark):
    rows = [("a b a",), ("B c",), (None,), ("",), ("a",), ("a",)]
    df = spark.createDataFrame(rows, "t string").repartition(3)
    got = {r["term"]: (r["occurrences"], r["rows"], r["mark"]) for r in terms.marks(terms.term_counts(df, terms.word_terms("t")), df.count(), 2, 0.4).collect()}
    assert got == {"a": (4, 3, "common"), "b": (2, 2, None), "c": (1, 1, "rare")}
    assert terms.term_counts(df.limit(0), terms.word_terms("t")).count() == 0
    ids = sorted(r["id"] for r in terms.term_counts(df, terms.whole_term("t")).collect())
    assert ids == list(range(len(ids)))


def test_truncation(spark):
    rng = random.Random(2)
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    rows = []
    for i in range(600):
        text = " ".join(rng.choices(words, k=rng.randint(6, 30))) + "."
        rows.append((i, "cutter", text[:100]) if i % 2 else (i, "free", text))
    rows += [(1000, "free", "alpha bravo cha"), (1001, "free", None), (1002, None, "alpha."), (1003, "free", "   ")]
    df = spark.createDataFrame(rows, "k long, s string, d string").withColumn("source", F.lit(1))
    got = {r["key"]: r["cause"] for r in truncation.judged(df, "s", "k", ("d",)).collect()}
    for k, s, d in rows:
        if d and d.strip():
            assert (got[k] is not None) == (not d.endswith(".")), (k, d)
    assert got[1000] == "transfer" and 1001 not in got and 1003 not in got
    assert truncation.judged(df.limit(0), "s", "k", ("d",)).count() == 0
    rates = {r["source"]: r for r in truncation.rates(truncation.judged(df, "s", "k", ("d",))).collect()}
    assert rates["cutter"]["cut_by_limit"] > 100 and None in rates


def test_truncation_is_the_same_at_every_size(spark, monkeypatch):
    rng = random.Random(6)
    nouns = [f"{a}{b}" for a in ("jarra", "mesa", "lampara", "teclado", "cuchillo", "ventilador") for b in ("", "s", "dor", "norte")]
    # rare words too, some of which begin frequent ones without being cut
    titles = [f"{rng.choice(nouns)} {rng.choice(nouns)} modelo {rng.choice(['rojo', 'azul', f'q{i}', 'lamp', 'venti'])}" for i in range(1500)]
    rows = [(i, f"s{i % 5}", t[: rng.randint(12, 22)] if i % 19 == 0 else t) for i, t in enumerate(titles)]
    one = spark.createDataFrame(rows, "k long, s string, d string")
    ten = one.crossJoin(spark.range(10)).select((F.col("k") * 10 + F.col("id")).alias("k"), "s", "d")
    got = {r["key"]: r["cause"] for r in truncation.judged(one, "s", "k", ("d",)).collect()}
    more = {r["key"]: r["cause"] for r in truncation.judged(ten, "s", "k", ("d",)).collect()}
    assert any(got.values()) and all(more[k * 10 + j] == c for k, c in got.items() for j in (0, 7))
    monkeypatch.setattr(truncation, "BEGINNING", 3)
    monkeypatch.setattr("tesela.runtime.BROADCAST_LIMIT", 0)
    assert {r["key"]: r["cause"] for r in truncation.judged(one, "s", "k", ("d",)).collect()} == got


def test_listing_tokens():
    code = lambda t: listings.codes(listings.folded(t))
    assert code("Mod. ETL/857O X jarra") == (["etl8570x"], []) and code("EKH-75-32-X y") == (["ekh7532x"], []) and code("CIJ-64 54X") == (["cij6454x"], [])
    assert code("HHZ/2232 de Vivibes") == (["hhz2232"], []) and code("syb 1381 b") == ([], ["syb1381b"]) and code("AB-12") == (["ab12"], [])
    assert listings.sizes("puzzle set of 500 24''")[0] == ["n500", "d610"]
    assert listings.sizes("mesa 23.6 in")[0] == listings.sizes("mesa 60 cm")[0]
    assert listings.name("bivo-fikaris ii") == listings.name("bivofikaris 2") and listings.name("zemo+") == listings.name("zemo-plus") == "zemoplus"
    t = listings.read("Termo Zemo 2 750 ml", "Termo modelo Zemo II, color verde claro. Medida: 0,75 l")
    assert t.models == [listings.hashed("zemo2")] and t.varieties == [listings.hashed("verdeclaro")] and t.sizes == ["v750"]
    assert listings.hashed("zemo2") in t.grams
    assert listings.read(None, None) == listings.read("", "") == ([], [], [], [], [], [], [])
    assert len(listings.read("x " * 50_000, "modelo " * 50_000).grams) < 10


_COLOURS = {"es": "negro rojo blanco amarillo".split(), "en": "black red white yellow".split(), "pt": "preto vermelho branco amarelo".split()}


def _catalogue(n):
    rng = random.Random(11)
    rows, truth, k = [], {}, 0
    for item in range(n):
        model = rng.choice([f"QX-{1000 + item // 4}", f"Velu{'abcdefghij'[item // 4 % 10]}{'klmnopqrst'[item // 40 % 10]}or"])
        litres, colour = rng.choice([1, 2, 3]), rng.randrange(4)
        item_key = (model, litres, colour)
        for _ in range(rng.randint(2, 6)):
            lang = rng.choice(list(_COLOURS))
            c, name, size = _COLOURS[lang][colour], model, (f"{litres} l", f"{litres}000 ml")[k % 2]
            if rng.random() < 0.3:
                name = model.replace("-", rng.choice(["/", ".", ""])).upper()
            stated = {"es": f"Jarra. Modelo: {name}, Color: {c}, Medida: {size}.", "en": f"Jug size {size}, colour {c}, model {name}.", "pt": f"Jarro: Cor: {c}; Modelo: {name}; Tamanho: {size}"}[lang]
            title = [name, size, c, rng.choice(["jarra", "jug", "oferta"])]
            rng.shuffle(title)
            how = rng.random()
            rows.append((f"{k:05d}", " ".join(title) if how > 0.2 else "jarra barata", stated if how < 0.8 else "buena jarra para todos"))
            truth[f"{k:05d}"] = item_key
            k += 1
    return rows, truth


def test_same_product(spark, monkeypatch):
    rows, truth = _catalogue(400)
    df = spark.createDataFrame(rows + [rows[0], ("e1", None, None), (None, "x", "y"), ("e2", "", ""), ("e3", "jarra", "jarra")], "id string, name string, description string").withColumn("product", F.lit(0)).withColumn("model", F.lit("clash"))
    got = {(r["id_a"], r["id_b"]) for r in same_product.pairs(same_product.groups(df)).collect()}
    by = {}
    for i, key in truth.items():
        by.setdefault(key, []).append(i)
    want = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got), (len(got), len(want), len(got & want))
    ids = [r["id"] for r in same_product.groups(df).collect()]
    assert sorted(ids) == sorted([*truth, "e1", "e2", "e3"])
    assert same_product.groups(df.limit(0)).count() == 0
    monkeypatch.setattr("tesela.runtime.BROADCAST_LIMIT", 0)  # shuffled joins give the same
    assert {(r["id_a"], r["id_b"]) for r in same_product.pairs(same_product.groups(df)).collect()} == got


def test_translations_are_learned(spark):
    rows, _ = _catalogue(400)
    df = spark.createDataFrame(rows, "id string, name string, description string")
    of = same_product.varieties(same_product.tokens(df, "id", "name", "description"))
    to = {c: of.get(listings.hashed(c)) for c in "negro black preto rojo red vermelho".split()}
    assert to["negro"] == to["black"] == to["preto"] != to["rojo"] == to["red"] == to["vermelho"]


def test_supersteps_are_whole_and_tight():
    rng = random.Random(3)
    for _ in range(50):
        cap = rng.choice([7, 64, 1024])
        counts = {}
        for _ in range(rng.randint(1, 800)):
            s = min(cap, max(1, int(rng.expovariate(4 / cap))))
            counts[s] = counts.get(s, 0) + 1
        moves, used = packing.supersteps(counts, cap)
        load, placed = {}, {}
        for size, rank, n, each, first in moves:
            for i in range(n):
                assert (size, rank + i) not in placed
                placed[size, rank + i] = first + i // each
                load[first + i // each] = load.get(first + i // each, 0) + size
        assert len(placed) == sum(counts.values()) and max(load.values()) <= cap and len(load) == used
        assert used <= math.ceil(11 / 9 * math.ceil(sum(s * c for s, c in counts.items()) / cap)) + 1
    assert packing.supersteps({}, 10) == ([], 0)


def test_packing(spark):
    items = spark.createDataFrame([(f"k{i}", i, 0, 1 + i % 10) for i in range(200)], "key string, row long, part int, size int")
    got = packing.packed(items, 10).groupBy("container").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert max(r["s"] for r in got) <= 10 and sum(r["n"] for r in got) == 200
    assert packing.packed(items.limit(0), 10).count() == 0
    import os

    if os.path.exists(packing.TOKENIZER):
        docs = spark.createDataFrame([(1, "word " * 3000), (2, ""), (3, None), (4, "short text"), (4, "short text")], "id long, text string")
        rows = packing.containers(docs, "id").collect()
        assert sum(r["key"] == 1 for r in rows) == 3 and sum(r["key"] == 4 for r in rows) == 2
        assert {r["key"] for r in rows if r["container"] is None} == {2, 3}


def test_masks():
    ms = leaks.masks()
    for a in range(leaks.SPAN):
        for b in range(a + 1, leaks.SPAN):
            assert any(a not in m and b not in m for m in ms)


@pytest.mark.parametrize("limit", [leaks.SEED_LIMIT, 100])
def test_leaks(spark, limit):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    item = [rng.choice(vocab) for _ in range(40)]
    noise = lambda n: [rng.choice(vocab) for _ in range(n)]
    swapped = item[5:25]
    swapped = swapped[:8] + ["zz"] + swapped[9:]
    docs = [(1, " ".join(noise(30) + item[3:20] + noise(10))), (2, " ".join(noise(60))), (3, " ".join(noise(5) + swapped + noise(5))), (4, None), (5, ""), (6, " ".join(item[:12])), (7, ", ".join(w.upper() for w in item[:13]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(item)), (12, "too short"), (13, None)], "item_id long, text string")
    got = {(r["doc"], r["item"]): (r["run"], r["overlap"], r["substitutions"]) for r in leaks.leaks(d, t, "doc_id", "item_id", seed_limit=limit).collect()}
    assert got[1, 10][0] == 17 and got[7, 10][0] == 13 and got[1, 11] == got[1, 10]
    assert got[3, 10] == (11, 20, 1)
    assert {k for k, v in got.items() if v[0] >= leaks.SPAN} == {(1, 10), (1, 11), (7, 10), (7, 11)}
    exact = {(r["doc"], r["item"]): r["run"] for r in leaks.leaks(d, t, "doc_id", "item_id", tolerated=0, seed_limit=limit).collect()}
    assert exact == {k: v[0] for k, v in got.items() if v[0] >= leaks.SPAN}
    assert leaks.leaks(d.limit(0), t, "doc_id", "item_id").count() == 0 and leaks.leaks(d, t.limit(0), "doc_id", "item_id").count() == 0


def test_leaks_equal_brute_force(spark, monkeypatch):
    """A passage in a fifth of the documents, items without blanks, null keys, several batches and blocks; and planted substitutions."""
    rng = random.Random(9)
    monkeypatch.setattr(leaks, "BATCH_WORDS", 300)
    vocab = [f"v{i}" for i in range(3000)]
    passage = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [passage(rng.randint(10, 60)) for _ in range(40)]
    hot = items[0] = passage(50)
    docs, planted = [], set()
    for k in range(300):
        text = passage(rng.randint(0, 80))
        if k % 5 == 0:
            text += hot[3:40]
        elif k % 3 == 0:
            i = rng.randrange(1, 40)
            part = items[i][:]
            at = rng.sample(range(len(part)), rng.randint(1, 2))
            for p in at:
                part[p] = "changed"
            inner = range(min(at), max(at) + 1)
            if len(part) >= 20 and inner[0] > 0 and inner[-1] < len(part) - 1:
                planted.add((k, i))
            text += part + passage(5)
        docs.append((k if k % 50 else None, " ".join(text)))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash"))
    t = spark.createDataFrame([(i, ",".join(w)) for i, w in enumerate(items)] + [(None, " ".join(hot))], "item_id long, text string").withColumn("h", F.lit(1))
    grams = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    want = {(key, i if i < 40 else None) for key, text in docs for i, w in enumerate([*items, hot]) if grams(text.split()) & grams(w)}
    for limit in (leaks.SEED_LIMIT, 200):
        assert {(r["doc"], r["item"]) for r in leaks.leaks(d, t, "doc_id", "item_id", tolerated=0, seed_limit=limit).collect()} == want
    tolerant = {(r["doc"], r["item"]): r for r in leaks.leaks(d, t, "doc_id", "item_id").collect()}
    assert want <= set(tolerant) and planted and all((k if k % 50 else None, i) in tolerant for k, i in planted)


def test_encoding(spark):
    good = ["El precio bajó de {} a {} durante la campaña de verano.", "La última versión guarda los {} registros según la guía.", "El botón de encendido quedó duro y además la tapa no cierra {} veces {}."]
    rng = random.Random(5)
    text = lambda: " ".join(g.format(rng.randint(1, 99), rng.randint(1, 99)) for g in rng.sample(good, 3))
    rows = [(i, text(), "es") for i in range(300)]
    bad = [text().encode().decode("cp1252", "ignore"), text().encode().decode("mac_roman"), text().encode("cp1252").decode("cp850"), text().replace("ó", "�")]
    rows += [(1000 + i, b, "es") for i, b in enumerate(bad)] + [(2000, None, "es"), (2001, "", None), (2002, "plain", None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {r["id"]: r for r in encoding.repaired(df, "id").filter("garbled").collect()}
    assert set(got) == {1000, 1001, 1002, 1003}
    assert "bajó" in got[1001]["restored"] and "bajó" in got[1002]["restored"] and got[1003]["lost"]
    assert encoding.repaired(df.limit(0), "id").count() == 0


_TEXTS = {
    "es": ["El precio bajó de {} a {} durante la campaña de verano. ", "¿Alguien sabe si la máquina del año {} todavía funciona? ", "LA OPINIÓN DEL PÚBLICO DURARÁ {} DÍAS… ", "La etiqueta dice «señal {}» y según la guía está bien. "],
    "pt": ["Alguém também pediu café e até agora ninguém vende uma série de {} peças? ", "A última versão guarda os {} registros do catálogo. ", "“Não há opções” — disse a irmã às {} horas. "],
    "fr": ["L’étiquette de la pièce {} n’était pas lisible. ", "C’ÉTAIT LA DERNIÈRE RÉVISION, MA SŒUR, APRÈS {} JOURS. ", "Où est le câble {} ? Déjà renvoyé, c’était trop court… ", "À l’été, l’équipe a reçu {} colis. "],
    "de": ["Der Schlüssel {} ist weiß… und größer. ", "DIE PRÜFUNG WIRD BENÖTIGT: {} STÜCK. ", "Straße {}: die Tür heißt „Ausgang“. "],
    "en": ["It’s the label {} and it’ll last… ", "The buyer didn’t answer for {} hours — “never”, they said. ", "My order {} cost 30 € in total. "],
}


def _corpus(n):
    rng = random.Random(7)
    for i in range(n):
        lang = rng.choice(list(_TEXTS))
        yield i, "".join(rng.choice(_TEXTS[lang]).format(*rng.sample(range(1, 999), 2)) for _ in range(rng.randint(2, 6))), lang if rng.random() > 0.05 else None


def _garbled(text, how, rng):
    wrong, right, times = how
    for _ in range(times):
        try:
            text = text.encode(right).decode(wrong)
        except UnicodeError:
            return None
    return text


@pytest.mark.parametrize("sample", [800, 64])
def test_encoding_found_and_restored(spark, monkeypatch, sample):
    monkeypatch.setattr(encoding, "SAMPLE_DOCS", sample)
    rng, rows, truth = random.Random(8), [], {}
    ways = [("cp1252", "utf-8", 1), ("latin-1", "utf-8", 1), ("mac_roman", "utf-8", 1), ("cp437", "utf-8", 1), ("mac_roman", "cp1252", 1), ("cp1250", "utf-8", 1), ("latin-1", "utf-8", 2), ("cp850", "cp1252", 1), ("latin-1", "cp1252", 1)]
    for i, text, lang in _corpus(1500):
        bad = _garbled(text, rng.choice(ways), rng) if i % 25 == 0 else None
        if bad and bad != text:
            truth[i] = text
        rows.append((i, bad or text, lang))
    df = spark.createDataFrame(rows, "id long, text string, lang string").withColumn("restored", F.lit("clash"))
    got = {r["id"]: r["restored"] for r in encoding.repaired(df.drop("restored"), "id").filter("garbled").collect()}
    assert len(truth) > 35
    assert not set(got) - set(truth), [(rows[i][1], got[i]) for i in set(got) - set(truth)]
    assert len(set(truth) & set(got)) >= 0.95 * len(truth), [rows[i][1] for i in set(truth) - set(got)]
    assert sum(got[i] == truth[i] for i in got) >= 0.9 * len(got)


def test_encoding_learns_from_all_documents(spark, monkeypatch):
    """Every language, every document and the whole of each count for the dictionaries."""
    made, train = {}, encoding.train
    monkeypatch.setattr(encoding, "train", lambda *a: made.update(train(*a)) or made)
    rows = [(f"l{k}", "plain words here. " * 260 + f"El señal{k:02d}x falta.") for k in range(14) for _ in range(60)]
    rows += [("many", f"El niño{i // 2:04d}x falta.") for i in range(1700)]
    rows += [("few", f"La piñata{i // 2}x falta.") for i in range(4)] + [(None, f"La piñata{i}x falta.") for i in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, lang string, text string")
    assert encoding.repaired(df, "id").filter("garbled").count() == 0
    assert set(made) == {*(f"l{k}" for k in range(14)), "many", "und"}
    assert all(f"señal{k:02d}x".encode() in made[f"l{k}"] for k in range(14))
    assert all(f"niño{i:04d}x".encode() in made["many"] for i in range(850))
    assert all(f"piñata{i}x".encode() in made["und"] for i in range(2))

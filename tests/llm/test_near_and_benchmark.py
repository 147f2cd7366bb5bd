"""Near duplicates, benchmark decontamination and licence scans against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from skein.llm.common import attach
from skein.llm.components import components
from skein.llm.decontaminate import decontaminate
from skein.llm.license_scan import TEMPLATES, anchors_of, license_report, necessary, scan_licenses, template_bigrams, template_words
from skein.llm.near_dedup import near_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def classes(texts, size=4):
    sets = {d: shingles(t, size) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if n * 100 >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in texts}


def chain(seed, n):
    """Texts each a little unlike the one before: the ends of the chain are not similar."""
    rng, words, out = random.Random(seed), [f"w{i}" for i in range(60)], []
    for _ in range(n):
        words = list(words)
        words[rng.randrange(60)] = f"x{rng.random()}"
        out.append(" ".join(words))
    return out


def test_one_id_with_several_texts(spark):
    """Each text has its own links, and what is linked with any has the id in reach."""
    p, q = (" ".join(f"{x}{i}" for i in range(60)) for x in "pq")
    rows = [(1, p), (2, p + " e"), (1, q), (3, q + " e"), (None, p), (4, None), (4, "alone"), (4, "alone")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", 1, True), ("2", 1, False), ("1", 1, True), ("3", 1, False), ("None", None, True), ("4", 4, True), ("4", 4, True), ("4", 4, True)])


def test_hot_groups_are_spread(spark):
    """Rows of the largest groups meet them by broadcast; the shuffle behind has a salt among its keys, which spreads them."""
    rows = spark.range(1000).select(F.when(F.col("id") < 600, -1).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = attach(rows, groups, ["k"], ["top"], "n", F.col("id"))
    assert {(r.k, r.id, r.top) for r in got.collect()} == {(-1, i, 599) for i in range(600)} | {(i, i, i) for i in range(600, 1000)} and got.count() == 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(k#\d+L?, _salt#\d+L?, \d+\)", plan) and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", ["odd", "documents", "chains"])
def test_near(spark, request, name):
    if name == "chains":
        texts = [t for s in range(3) for t in chain(s, 40)] + ["one two three"] * 3 + ["One  two three", None, "", "one two three four five"]
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    else:
        table = request.getfixturevalue(name)
    texts = {r.doc_id: r.text for r in table.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(table).collect()}
    assert got == classes(texts)


def test_near_edges(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = near_dedup(spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e")], "doc_id long, text string")).collect()
    assert sorted((r.component_id or 0, r.kept) for r in rows) == [(0, True), (5, True), (5, True)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def leaks(texts, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(str(i))
    out = {}
    for d, t in texts.items():
        w, hit, names = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= own
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("bound", [50_000, 0])
@pytest.mark.parametrize("name", ["odd", "documents"])
def test_benchmark(spark, request, name, bound):
    table = request.getfixturevalue(name)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, "plain TEXT of"), (901, None), (902, "..."), (903, "a"), (904, "alpha0 beta1 gamma2 delta3 epsilon4 zeta5 eta6 theta7 iota8 kappa9 lambda10 mu11 nu12 xi13"), (904, "x"), (905, "Plain text, of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = {r.doc_id: r.text for r in table.collect()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(table, bench, broadcast_windows=bound).collect()}
    assert got == leaks(texts, items)
    assert any(x[1] for x in got.values())


@pytest.mark.parametrize("bound", [50_000, 0])
def test_repeated_ids_and_broken_windows(spark, bound):
    """Rows of one id are decided apart; windows whose shingles all occur, but not side by side, are not found."""
    item = [f"item{i}" for i in range(20)]
    docs = [(1, " ".join(item)), (1, "clean words only here"), (1, " ".join(item)), (2, " ".join(item[:12] + ["gap"] + item[10:])), (3, " ".join(item[:13])), (4, "item0 item1"), (5, "item1 item0 item1 item0 item1 item2")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "item0 item1"), (9, "item0 item1 item2")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench, broadcast_windows=bound).collect())
    assert got == sorted((d, *leaks({d: t}, [(r.item_id, r.text) for r in bench.collect()])[d]) for d, t in docs)


def test_carried_columns(spark):
    docs = spark.createDataFrame([(1, "x y z", "k", "c", 5), (None, None, None, None, None)], "doc_id long, text string, key string, carry string, n_hit int")
    out = decontaminate(docs, spark.createDataFrame([(7, "y z")], "item_id long, text string"), carry=["key", "text", "carry", "n_hit"])
    assert sorted((r.key or "", r.text or "", r.carry or "", r.n_hit) for r in out.collect()) == [("", "", "", 0), ("k", "x y z", "c", 2)]


def test_benchmark_edges(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate(odd, none).filter("n_hit > 0").count()
    assert decontaminate(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


@pytest.mark.parametrize("bound", [50_000, 0])
def test_rows_without_an_id(spark, tmp_path, bound):
    """Each is decided by its own text: a copy of a benchmark item goes, others stay, in the operator and in the pipeline's stages."""
    item = " ".join(f"item{i}" for i in range(30))
    other = [" ".join(f"n{k}w{i}" for i in range(40)) for k in range(3)]
    rows = [(None, item), (None, other[0]), (None, None), (None, other[0]), (1, item), (2, other[1]), (None, item + " " + other[2])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.contaminated) for r in decontaminate(docs, bench, broadcast_windows=bound).collect())
    assert got == sorted([("None", 30, 30, True), ("None", 40, 0, False), ("None", 0, 0, False), ("None", 40, 0, False), ("1", 30, 30, True), ("2", 40, 0, False), ("None", 70, 30, True)])
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (str(r[0]), str(r[1]))
    near = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(map(key, near.collect())) == sorted(map(key, rows))
    assert sorted(map(key, corpus_pipeline.drop_contaminated(spark, near, str(tmp_path)).collect())) == sorted(map(key, [rows[1], rows[2], rows[3], rows[5]]))


def test_necessary_bigrams():
    """What lacks all necessary bigrams of a template stays under the similarity, even if it has all others and nothing else."""
    for _, text in TEMPLATES:
        every, (words, held) = set(template_bigrams(text)), necessary(text, 0.8)
        rest = every - set(held)
        assert all(set(g.split()) & set(words) for g in held) and 2 * len(rest) / (len(rest) + len(every)) < 0.8


def test_licenses(spark, odd):
    mit = TEMPLATES[5][1]
    texts = [(100, "Some prose.\n" + TEMPLATES[0][1].upper() + "\nMore of it."), (101, mit), (102, "Head\n\n" + mit.replace(", ", ",\n") + "\n\nTail"), (103, "Licensed under CC BY-NC 4.0."), (104, None), (105, "license"), (106, "The license of a work is a matter of law."), (107, "Some prose before it. " + TEMPLATES[1][1] + " And prose behind it, as long as you like."),
             (108, "\n".join(["# Head of a file", "#", *(f"# {x}" for x in mit.split(", ")), "#", "# Tail " * 40])), (109, " ".join([TEMPLATES[5][1]] * 7)), (110, "this is free software of the public domain " * 30), (111, "word " + TEMPLATES[0][1].replace("the", "an"))]
    table = odd.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))

    def dice(unit):
        own, out = set(template_bigrams("".join(c if ord(c) < 128 else " " for c in unit))), {}
        for name, t in TEMPLATES:
            g = set(template_bigrams(t))
            if own and (x := 2 * len(own & g) / (len(own) + len(g))) >= 0.8:
                out[name] = max(x, out.get(name, 0))
        return out

    want = {}
    for r in table.collect():
        t, all_ = r.text or "", {}
        for unit in [*t.split("\n"), *re.split(r"\n[ \t\r]*\n", t), t]:
            for k, v in dice(unit).items():
                all_[k] = max(v, all_.get(k, 0))
        w = template_words("".join(c if ord(c) < 128 else " " for c in t))
        for number, gram, place, n in anchors_of(TEMPLATES, 0.8):
            name, g = TEMPLATES[number][0], set(template_bigrams(TEMPLATES[number][1]))
            for i in [i for i in range(len(w) - 1) if f"{w[i]} {w[i + 1]}" == gram]:
                start = max(i - place, 0)
                own = {f"{a} {b}" for a, b in zip(w[start : start + n], w[start + 1 : start + n])}
                if (x := 2 * len(own & g) / (len(own) + len(g))) >= 0.8:
                    all_[name] = max(x, all_.get(name, 0))
        best = min(all_, key=lambda k: (-all_[k], k)) if all_ else None
        want[r.doc_id] = (best, round(all_[best], 6) if best else 0.0, sorted(all_))
    got = {r.doc_id: (r.license, r.dice, r.licenses) for r in license_report(table).collect()}
    assert got == want
    assert [got[d][0] for d in (100, 101, 102, 103, 106, 107, 108, 109, 110)] == ["Apache-2.0", "MIT", "MIT", "CC-BY-NC-4.0", None, "Apache-2.0", "MIT", "MIT", None]
    assert scan_licenses(table, templates=[]).count() == 0
    assert license_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0

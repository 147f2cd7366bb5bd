"""What a reviewer's findings came to: each of these would have failed before."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.functions import content as C
from skein.functions import text as T
from skein.operators import chunk, diagnostics, fusion, lexical, vector
from skein.plans import catalog, catalog_extra, catalog_more  # noqa: F401


SF = "/root/testdata/sf0.001"


def test_structured_redaction_reads_all_orders(spark, tmp_path):
    keys = [99999, 99998, 100000, 100001, 100002, 100003]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.content for r in catalog.QUERIES["structured_redaction"](spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(keys)
    assert '"password": "[redacted: name=password_assignment; chars=7; bytes=7]"' in got[100000] and "100000" not in got[100000]
    assert got[99998] == 'no json "password": 99998'  # under six characters nothing is a password
    assert got[100002] == 'no json "password": [redacted: name=password_assignment; chars=6; bytes=6]'
    assert got[100001] == '[{"note": "fine", "tokens": "100001"}]' and "name=bearer_token; chars=64" in got[100003]


def test_payloads_by_plain_python(spark):
    """Runs of any length, with escaped slashes and parameters: each pattern is a loop, so a long run is no deep recursion."""
    digest = lambda x: f"[Externalized payload: kind=embedded; chars={len(x)}; ref={hashlib.sha256(x.encode()).hexdigest()}]"
    long_uri, escaped = "data:image/png;charset=x;base64," + "Ab1+" * 100_000, "DATA:image\\/png;base64," + "A\\/" * 128
    run, hexes, few = "ABCDefgh0123+/zz" * 5000, "0123456789abcdef" * 300, "=-" * 3000
    cases = [
        (f"a {long_uri} b {run} c {few} d", f"a {digest(long_uri)} b {digest(run)} c {few} d", [long_uri, run]), (f"{run}\n{hexes}\n{run}", f"{digest(run)}\n{hexes}\n{digest(run)}", [run, run]),
        (f'"{escaped}"', f'"{digest(escaped)}"', [escaped]), (escaped[:-2], escaped[:-2], []), ("", "", []), (None, None, None), (run[:4095], run[:4095], []), (f"x{run[:4095]}a", f"x{run[:4095]}a", []),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = df.select("i", C.without_payloads(F.col("t")).alias("content"), C.payloads_in(F.col("t")).alias("held"), T.has_data_uri(F.col("t")).alias("uri")).orderBy("i").collect()
    assert [(r.content, r.held) for r in got] == [c[1:] for c in cases]
    assert [r.uri for r in got] == [True, False, True, False, False, None, False, False]


@pytest.mark.parametrize("run", ["abcdefgz", "abcdefg", "aabbccddeeffgz", "z" * 5000, "abcdefg" * 900 + "z", "0123456789", "gbbbbbbb", "a+/=_-Zz"])
def test_kinds_of_signs(spark, run):
    want = len(run) % 4 != 1 and len(set(run)) >= 8 and any(c not in "0123456789abcdefABCDEF" for c in run)
    assert spark.createDataFrame([(run,)], "t string").select(T.is_base64(F.col("t")).alias("b")).first().b == want


def _halved(text, most, offset):
    def tokens(t):
        share = sum(ord(c) > 127 for c in t) / max(len(t), 1)
        return int(len(t) / (1.5 if share >= 0.5 else 2.5 if share >= 0.2 else 4.0)) + 1 if t else 0

    start = min(max(offset, 0), len(text))
    rest = text[start:]
    low, high, best = 0, len(rest), 0
    while low <= high and tokens(rest) > most > 0:
        middle = (low + high) // 2
        low, high, best = (middle + 1, high, middle) if tokens(rest[:middle]) <= most else (low, middle - 1, best)
    size = min(max(len(rest) if tokens(rest) <= most else best, 1), len(rest))
    return rest[:size], start, start + size if start + size < len(text) else 0, start + size < len(text)


@pytest.mark.parametrize(("most", "offset"), [(50, 10), (1, 0), (0, 3), (7, -4), (3000, 100)])
def test_slices_by_plain_python(spark, most, offset):
    texts = ["", "a", "abc" * 5, "x" * 5000, "é" * 900, "Ción " * 400, "abcdé" * 90, "日本語" * 200 + "plain " * 90, "😀 ok " * 333]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.content_slice(F.col("t"), most, offset).alias("s")).orderBy("i")
    assert [tuple(r.s) for r in df.collect()] == [_halved(t, most, offset) for t in texts]


def test_slices_of_long_texts_read_their_head(spark):
    """Twelve texts of ten million signs: every step over the whole rest took minutes."""
    rows = spark.range(12).select(F.repeat(F.lit("a text and É "), 800_000).alias("t"))
    began = time.monotonic()
    assert {r.n for r in rows.select(F.length(C.content_slice(F.col("t"), 50, 10)["content"]).alias("n")).collect()} == {199}
    assert time.monotonic() - began < 30


def _quarantined(text):
    plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ").lower()
    words = re.findall("[a-z0-9_]+", plain)
    signs, n = len(set(plain)), len(words)
    if n < 1000:
        return len(plain) >= 65536 and signs <= 12
    parts = [re.sub(r"\s+", " ", s).strip(" ") for s in re.split(r"\n+|(?<=[.!?])\s+", text.lower())]
    parts = [s for s in parts if len(s) >= 32]
    top = lambda x: max(Counter(x).values()) / len(x)
    again = (len(parts) >= 20 and (top(parts) >= 0.1 or 1 - len(set(parts)) / len(parts) >= 0.5)) or top(words) >= 0.08
    return (len(set(words)) / n <= 0.03 and again) or (len(set(words)) / n <= 0.015 and signs <= 64)


def test_quarantine_by_plain_python(spark):
    """Either side of each bound; a tenth, an eighth and a half of the words or sentences are reached exactly."""
    rare = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    odd = "".join(chr(0x100 + i) for i in range(80))  # more kinds of signs than 64
    mixed = lambda n, kinds, top: [("the" if i % 100 < top else rare[i % kinds]) for i in range(n)]
    said = lambda n, kinds, every: " ".join(f"sentence {rare[0 if every and i % every == 0 else i % kinds]} goes on for a good long while here." for i in range(n))
    texts = [" ".join(mixed(n, kinds, top)) + " " + tail for n, kinds, top in ((20000, 500, 8), (20000, 500, 7), (20000, 590, 8), (25000, 300, 0), (20000, 400, 0), (30000, 10, 50), (40000, 599, 9)) for tail in ("", odd)]
    texts += [said(2000, 400, every) + tail for every in (0, 10, 11, 2) for tail in ("", odd)] + ["=-" * 40000, "abcdefghijkl" * 6000, "abcdefghijklm" * 6000, "z " * 999 + "=" * 66000, "日本語。" * 20000, " \n" * 40000, "a" * 65535, "x  y\n" * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.quarantine_reason(F.col("t")).isNotNull().alias("q")).orderBy("i")
    want = [len(t) >= 65536 and _quarantined(t) for t in texts]
    assert [r.q for r in df.collect()] == want and 5 < sum(want) < len(want) - 5


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quarantine_takes_words_once(spark):
    plan = _plan(spark.range(1).select(F.repeat(F.lit("said so. "), F.col("id").cast("int")).alias("t")).select(T.quarantine_reason(F.col("t")).alias("q")))
    assert plan.count("regexp_extract_all(") == 1 and plan.count("sort_array(") == 2  # words; words and segments


def test_payload_risks_are_worked_out_once(spark):
    """No order and no limit, so no single task; and no filter of rows that repeats the patterns."""
    m = spark.createDataFrame([(1, "s", "assistant", "ok"), (2, "s", "assistant", "a note"), (3, "s", "assistant", "still working..."), (4, "s", "user", "data:image/png;base64," + "A" * 256), (5, "s", "tool", None)], "store_id long, session_id string, role string, content string")
    every = diagnostics.payload_risks(m, None)
    assert sorted((r.store_id, r.chars, r.data_uri, r.base64, r.noise, r.heartbeat, r.repetitive) for r in every.collect()) == [(3, 16, False, False, False, True, False), (4, 278, True, False, False, False, False), (5, None, None, None, True, None, False)]
    assert [r.store_id for r in diagnostics.payload_risks(m, 1).collect()] == [4]
    plan = _plan(catalog.QUERIES["payload_risks"](spark, SF))
    assert "Limit" not in plan and "Sort" not in plan and plan.count(";base64,(?:") == 1


@pytest.mark.parametrize("name", ["embedded_payloads", "numeric_candidates", "payload_flags", "payload_risks"])
def test_large_by_row_goes_over_all_cores(spark, name):
    assert "RoundRobinPartitioning" in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sizes", [None, (16, 8, 3)])
def test_neighbours_by_plain_python(spark, monkeypatch, sizes):
    """Equal rows, null and odd rows, queries of one id and more of both than a block holds: the order is that of sums in order."""
    if sizes:
        for name, n in zip(("SCORES", "PAIRS", "QUERY_BLOCK"), sizes, strict=True):
            monkeypatch.setattr(vector, name, n)
    rng = random.Random(7)
    some = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(40)]
    rows = [(i, some[i % 40] if i % 7 else [x * 2 for x in some[3]], i % 11 == 0) for i in range(-20, 200)] + [(900, None, False), (901, [1.0], False), (902, [0.0] * 5, False), (903, [float("nan")] * 5, False)]
    asked = [(f"q{i % 9}", some[i]) for i in range(10)] + [("none", None)]
    v = spark.createDataFrame(rows, "row_id long, embedding array<double>, archived boolean").repartition(3)
    q = spark.createDataFrame(asked, "query_id string, embedding array<double>")

    def unit(x):
        length = math.sqrt(score(x, x)) if x and len(x) == 5 else 0.0
        return [y / length for y in x] if length > 0 else None

    def score(x, y):
        out = 0.0
        for a, b in zip(x, y, strict=True):
            out += a * b
        return out

    want = []
    for name in {a[0] for a in asked}:
        found = [(score(unit(x), unit(own)), i) for a, own in asked if a == name and own for i, x, gone in rows if not gone and unit(x)]
        want += [(name, i, s, n) for n, (s, i) in enumerate(sorted(found, reverse=True)[:6], 1)]
    assert sorted(map(tuple, vector.knn_batch(v, q, 6, 5).collect())) == sorted(want)
    assert vector.knn_batch(v, q.limit(0), 6, 5).count() == 0


def test_measures_by_class_make_no_pairs(spark):
    hits = spark.createDataFrame([("q", 1, 1), ("q", 1, 2), ("q", 2, 3), ("r", 9, 1), ("t", 1, 1), ("u", 1, 1)], "query_id string, id long, rank int")
    asked = spark.createDataFrame([("q", 5), ("r", 6), ("s", 6), ("t", None), ("u", 8)], "query_id string, class int")
    items = spark.createDataFrame([(2, 5), (3, 5), (9, 6), (9, 6), (1, None), (1, 7)], "id long, class int")
    pairs = asked.join(items, "class").select("query_id", "id")
    for measure in (diagnostics.recall_at_k, diagnostics.ndcg_at_k):
        assert sorted(measure(hits, (asked, items), 2).collect()) == sorted(measure(hits, pairs, 2).collect())
    assert {r.query_id: r.recall for r in diagnostics.recall_at_k(hits, (asked, items), 2).collect()} == {"q": 0.5, "r": 1.0, "s": 0.0}


def test_fold_streams_over_groups(spark):
    """Runs go on over batches and start anew with each group; no group is a call of its own."""
    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, 0, 5, 20, 45, 90])) for g in [f"s{n}" for n in range(40)] for i in range(rng.randrange(1, 12))]
    want = []
    for g in {r[0] for r in rows}:
        n, used = 0, None
        for _, i, cost in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            c = cost or 0
            n, used = (n + 1, c) if used is not None and used + c > 60 else (n, c + (used or 0))
            want.append((g, i, n))
    rng.shuffle(rows)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = chunk.fold_segments(spark.createDataFrame(rows, "g string, i int, cost int"), "g", "i", "cost", 60)
        assert sorted((r.g, r.i, r.segment) for r in out.collect()) == sorted(want)
        assert "FlatMapGroupsInPandas" not in _plan(out)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_later_than_now_is_no_age(spark):
    """As in the reference: a message later than now is as good as new, and no better."""
    df = spark.createDataFrame([(0, 500.0), (1, 1000.0), (2, 3_601_000.0), (3, 9_000_000.0)], "i int, at double")
    got = df.select(lexical.hybrid_rank(F.lit(-2.0), F.col("at"), 1000.0).alias("rank"), fusion.recency(F.col("at"), 1000.0).alias("boost")).collect()
    assert got[0].rank > -2.0 and got[0].boost < 1.0 and [(r.rank, r.boost) for r in got[1:]] == [(-2.0, 1.0)] * 3

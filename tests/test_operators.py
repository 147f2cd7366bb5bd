"""Folds, state and edge cases that SQL on the shipped tables doesn't reach."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from skein import schemas
from skein.functions import text as T
from skein.operators import assertions as A
from skein.operators import chunk as C
from skein.operators import compute as Q
from skein.operators import dag, diagnostics, fusion, lexical, rollup, store, trajectory, vector
from skein.sources import tables as src
from skein.streaming import events as streams
from test_planning import hostile_queries

SF = "/root/testdata/sf0.001"


def column(df, c):
    return [r[c] for r in df.collect()]


def test_chunks_tile_and_overlap():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "another ", "end. ", "really?! ", "\n", "\n\n", "x" * rng.randrange(60), "é "]) for _ in range(rng.randrange(400)))
        spans = C.sentence_spans(text)
        assert "".join(text[a:b] for a, b in spans) == text
        windows = C.window_spans(text, 60)
        assert (windows[0][0], windows[-1][1]) == (0, len(text)) if text else windows == []
        for (a, b), (c, e) in zip(windows, windows[1:], strict=False):
            assert a < c <= b <= e
    assert C.window_spans("x" * 9000) == [(0, 9000)]


def test_chunk_policies(spark):
    long = "An error of a kind. " * 200
    rows = [(1, "user", "short"), (2, "user", long), (3, "tool", long), (4, "system", "words " * 100), (5, "user", None), (6, "assistant", "  ")]
    m = spark.createDataFrame(rows, "store_id long, role string, content string")
    ids = lambda p: sorted(set(column(C.chunk(m, p), "store_id")))
    assert (ids("conversational"), ids("heads"), ids("full")) == ([2], [2, 3], [1, 2, 3, 4])
    for r in C.chunk(m, "full").collect():
        assert r.text == rows[r.store_id - 1][2][r.char_start : r.char_end] and r.token_estimate == C.estimate(r.text)


def test_folds(spark):
    rng = random.Random(5)
    rows = [(f"s{i % 3}", i, rng.choice([1, 5, 20, 90])) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i long, c int")
    got = {r.i: r.segment for r in C.fold_segments(df, "g", "i", "c", 60).collect()}
    packed = {r.i: r.request for r in C.pack(df, "g", "i", "c", 4, 60).collect()}
    for g in ("s0", "s1", "s2"):
        n = used = m = have = cost = 0
        for k, (_, i, c) in enumerate([r for r in rows if r[0] == g]):
            n, used = (n + 1, c) if k and used + c > 60 else (n, used + c)
            m, have, cost = (m + 1, 1, c) if have and (have >= 4 or cost + c > 60) else (m, have + 1, cost + c)
            assert (got[i], packed[i]) == (n, m)


def test_tail_keeps_tool_groups(spark):
    rows = [("a", i, r, t) for i, (r, t) in enumerate([("user", 10), ("assistant", 10), ("tool", 10), ("tool", 10), ("user", 500)])]
    m = spark.createDataFrame(rows, "session_id string, store_id long, role string, token_estimate int")
    assert sorted(column(C.fresh_tail(m, 2), "store_id")) == [1, 2, 3, 4]
    assert column(C.fresh_tail(m, 4, 100), "store_id") == [4]
    assert C.fresh_tail(m.limit(0), 3).count() == 0


def test_two_key_caps_are_greedy(spark):
    rows = [("q", 1, "s", "d1"), ("q", 2, "s", "d1"), ("q", 3, "t", "d1"), ("q", 4, "s", "d2"), ("q", 5, None, None), ("q", 6, None, None)]
    df = spark.createDataFrame(rows, "q string, i int, s string, d string")
    assert sorted(column(C.diverse(df, "q", "i", "s", "d", 2, 2), "i")) == [1, 2, 5, 6]


NODES = "node_id long, session_id string, depth int, summary string, token_count long, source_token_count long, source_ids array<long>, source_type string, created_at double, earliest_at double, latest_at double"


def graph(spark, rows):
    return spark.createDataFrame([(i, "s", d, f"n{i}", 10, 100, ids, t, 5.0, None, None) for i, d, ids, t in rows], NODES)


def test_canonical_frontier(spark):
    leaves = [(i, 0, [100 + i], "messages") for i in range(1, 6)]
    n = graph(spark, [*leaves, (10, 1, [1, 2], "nodes"), (11, 1, [1, 2], "nodes"), (12, 2, [10, 3], "nodes"), (13, 1, [4], "nodes")])
    assert sorted(column(dag.canonical_frontier(n, n), "node_id")) == [5, 12, 13]
    assert sorted(column(dag.canonical_frontier(n, n.filter("node_id IN (10, 11, 1)")), "node_id")) == [10]
    with pytest.raises(dag.OverlapError):
        overlap = graph(spark, [*leaves, (10, 1, [1, 2], "nodes"), (11, 1, [2, 3], "nodes")])
        dag.canonical_frontier(overlap, overlap)
    cycle = graph(spark, [(1, 1, [2], "nodes"), (2, 1, [1], "nodes")])
    assert {(r.root, r.node_id) for r in dag.lineage(cycle, cycle).collect()} == {(1, 1), (1, 2), (2, 2), (2, 1)}
    assert json.loads(dag.describe(n, 12))["children"][0]["child"] == 10


def test_secrets_and_payloads(spark):
    texts = ["api_key = 'abcdefghijkl1234'", "Authorization: Bearer abcdefghijklmnop", 'password: "hunter22"', "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----", "api_key = short", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("r", T.redact(F.col("t")))
    out = {r.i: r.r for r in df.collect()}
    mark = lambda name, x: f"[redacted: name={name}; chars={len(x)}; bytes={len(x.encode())}" + ("" if name == "password_assignment" else f"; sha256={hashlib.sha256(x.encode()).hexdigest()[:16]}") + "]"
    assert out[0] == f"api_key = '{mark('api_key', 'abcdefghijkl1234')}'" and out[1].endswith("Bearer " + mark("bearer_token", "abcdefghijklmnop")) and out[2] == f'password: "{mark("password_assignment", "hunter22")}"'
    assert out[3] == mark("private_key", texts[3]) and out[4] == texts[4] and out[5] is None
    escaped = [('{\\"api_key\\": \\"abcdefghijkl1234\\"}', '{\\"api_key\\": \\"' + mark("api_key", "abcdefghijkl1234") + '\\"}'), ("pwd=hunter22é x pwd: 'a\"bcdefg'", f"pwd={mark('password_assignment', 'hunter22é')} x pwd: '" + mark("password_assignment", 'a"bcdefg') + "'")]
    assert [r.r for r in spark.createDataFrame(escaped, "t string, want string").select(T.redact(F.col("t")).alias("r")).collect()] == [w for _, w in escaped]
    digest = df.filter("i = 0").select(T.secret_digests(F.col("t"), "api_key")[0].alias("d")).first().d
    assert (digest.chars, digest.bytes, len(digest.sha256)) == (16, 16, 16)
    alphabet = "ABCDefgh0123+/zz"
    cases = [("data:image/png;base64," + "A" * 256, True, False), ("data:image/png;base64," + "A" * 255, False, False), ("data:text/plain;charset=utf-8;base64," + "A" * 256, True, False), ("data:image\\/png;base64," + "A" * 300 + "\"", True, False), ("data:;base64," + "A" * 256 + "/x", True, False), (alphabet * 256, False, True), (alphabet * 255, False, False), ("0123456789abcdef" * 300, False, False), ("\n".join([alphabet * 4] * 70), False, True)]
    flags = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", T.has_data_uri(F.col("t")).alias("u"), T.has_base64(F.col("t")).alias("b")).collect()
    assert [(r.u, r.b) for r in sorted(flags)] == [c[1:] for c in cases]
    noise = spark.createDataFrame([(x,) for x in ("Heartbeat  ACK", "[acknowledged]", "`pong`", " ", "ok", "done", "**")], "t string").select(T.is_noise(F.col("t")).alias("n"))
    assert column(noise, "n") == [True, True, True, True, False, False, False]
    common = " ".join(w for i in range(10000) for w in (f"w{i % 200}", f"w{(i * 7) % 200}", f"w{(i * 3) % 200}", f"w{(i * 9) % 200}", "said"))
    assert spark.createDataFrame([(common,)], "t string").select(T.quarantine_reason(F.col("t")).alias("q")).first().q == "high_repetition"
    loop, varied = "the same words again. " * 4000, " ".join(f"w{i}" for i in range(20000))
    q = spark.createDataFrame([(0, loop), (1, varied), (2, "z" * 70000), (3, "short")], "i int, t string").select("i", T.quarantine_reason(F.col("t")).alias("q")).collect()
    assert [r.q for r in sorted(q)] == ["high_repetition", None, "high_repetition", None]
    notes = spark.createDataFrame([("still working…" + " " * 242,), ("still working",), ("still working on lunch",)], "t string").select(T.is_heartbeat(F.lit("assistant"), F.col("t")).alias("h"))
    assert column(notes, "h") == [True, True, False]
    think = spark.createDataFrame([("a<think>b</think>c\n\n\n\nd",), ("x <thinking>open",)], "t string").select(T.strip_reasoning(F.col("t")).alias("t"))
    assert column(think, "t") == ["ac\n\nd", "x"]


def test_directness_of_phrases(spark):
    one = lambda t, terms, phrases: spark.createDataFrame([(t,)], "t string").select(T.directness(F.col("t"), terms, phrases).alias("x")).first().x
    assert one("new york is big", ["new york"], ["new york"]) == 13.0
    assert one("new york new york new york", ["new york"], ["new york"]) == 13.0 - 1.0 - 2
    assert one("new york a b new york and so it goes on here", ["new york"], ["new york"]) == 13.0 - 0.5 - 1.5
    assert one("", ["a"], []) == 0.0 and one("a a a", ["a"], []) == 3.0


@pytest.mark.parametrize("sort", ["recency", "relevance", "hybrid", "nonsense"])
def test_search_takes_anything(spark, sort):
    m = src.messages(spark, SF)
    for q in hostile_queries(12):
        assert lexical.search(m, q, sort=sort, limit=3, now=1.0).count() <= 3


def test_vectors(spark):
    rows = [(1, [3.0, 4.0], False, 1.0), (2, [0.0, 0.0], False, 2.0), (3, [1.0, float("nan")], False, 3.0), (4, [1.0], False, 4.0), (5, [3.0, 4.0], False, 5.0), (6, [3.0, 4.0], True, 6.0), (7, [-1.0, 0.5], False, 7.0)]
    v = spark.createDataFrame(rows, "row_id long, embedding array<double>, archived boolean, timestamp double")
    assert column(vector.knn(v, [3.0, 4.0], 10), "row_id") == [5, 1, 7]
    assert column(vector.knn(v, [3.0, 4.0], 10, bound=2), "row_id") == [5, 7]
    assert vector.knn(v.limit(0), [1.0, 0.0], 3).count() == 0
    e = src.vectors(spark, SF)
    hits = 0
    for q in range(5):
        asked = e.filter(F.col("row_id") == q).first().embedding
        hits += len(set(column(vector.knn(e, asked, 10, bound=None), "row_id")) & set(column(vector.knn_two_stage(e, asked, 10, mult=12), "row_id")))
    assert hits >= 35
    profiles = spark.createDataFrame([("h1", "m", "p", True, 1.0), ("h2", "m", "p", False, 9.0), ("h3", "m", "p", True, 1.0)], "identity_hash string, model string, provider string, active boolean, registered_at double")
    assert vector.resolve_profile(profiles, "m").first().identity_hash == "h3"
    new = spark.createDataFrame([(1, [1.0, 1.0], False, 8.0)], v.schema)
    assert vector.publish(v, new, ["row_id"]).filter("row_id = 1").first().timestamp == 8.0 and vector.purge(v, new, "row_id").count() == 6


def test_fusion(spark):
    a = spark.createDataFrame([("m", 5, 1), ("m", 5, 3), ("n", 5, 2)], "id_space string, id long, rank int")
    b = spark.createDataFrame([("m", 5, 2), ("m", 7, 1)], a.schema)
    got = [(r.id_space, r.id, round(r.score, 9)) for r in fusion.rrf([a, b], [1.0, -3.0]).collect()]
    assert got == [("m", 5, round(1 / 61, 9)), ("n", 5, round(1 / 62, 9)), ("m", 7, 0.0)]
    assert fusion.weight(float("inf")) == 1.0 and fusion.weight(None) == 1.0
    rows = spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, "a")], "i int, t string")
    assert column(fusion.within_chars(rows, [F.col("i")], 40), "i") == [1, 2]
    assert column(fusion.rerank(rows, F.length("t"), [F.col("i")], 2), "i") == [2, 1, 3]


def test_assertions(spark):
    m = spark.createDataFrame([(1, "I live in Rome now"), (2, "I moved to Oslo")], "store_id long, content string")
    item = {"subject_key": "person:user", "predicate_key": "lives_in", "object": "Rome", "kind": "fact", "polarity": "+", "scope_key": "g", "span_start": 10, "span_end": 14, "quote": "Rome", "confidence": 0.9}
    payloads = spark.createDataFrame([(1, json.dumps({"assertions": [item, {**item, "quote": "Oslo"}, {**item, "subject_key": "Bad Key"}, {**item, "confidence": 3.0}]})), (2, "no json")], "store_id long, payload string")
    parsed = A.parse_candidates(payloads, m)
    assert column(parsed, "object_json") == ["Rome"]
    empty = parsed.withColumn("assertion_id", F.lit("")).limit(0)
    once = A.publish(empty, parsed)
    assert A.publish(once, parsed).count() == 1
    receipts = spark.createDataFrame([(1, "v", None), (2, "v", 3.0)], "source_store_id long, version string, invalidated_at double")
    assert column(A.pending_sources(m, receipts, "v"), "store_id") == [2]
    assert A.visible(once, A.invalidate(receipts, once, 9.0)).count() == 0
    times = spark.createDataFrame([(1, 5.0, None, None), (2, 5.0, 7.0, None), (3, 5.0, None, 6.0), (4, 9.0, None, None)], "i int, observed_at double, valid_from double, valid_to double")
    assert [sorted(column(A.as_of(times, t), "i")) for t in (4.0, 5.0, 6.0, 7.0, 9.0)] == [[], [1, 3], [1], [1, 2], [1, 2, 4]]
    rows = [("a", "s:x", "p", "g", "recommendation", "1"), ("b", "s:x", "p", "g", "recommendation", "2"), ("c", "s:y", "p", "g", "fact", "1")]
    asserted = spark.createDataFrame(rows, "assertion_id string, subject_key string, predicate_key string, scope_key string, kind string, object_json string")
    relations = spark.createDataFrame([("a", "accepts", "b"), ("c", "declines", "b"), ("b", "cancels", "c")], "from_id string, type string, to_id string")
    state = {r.assertion_id: r for r in A.state(asserted, relations).collect()}
    assert [(state[k].active, state[k].conflict, state[k].disposition) for k in "abc"] == [(True, True, "unanswered"), (True, True, "conflicting"), (False, False, None)]


def test_computation_refuses(spark):
    rows = [("a", "r1", "k1", 1.0, "hour"), ("a", "r2", "k1", 30.0, "minute"), ("b", "r1", "k", 1.0, "hour"), ("b", "r1", "k", 1.0, "hour"), ("c", "r1", "k", 1.0, "hour"), ("c", "r2", "k", 1.0, "dollar"), ("d", "r1", None, None, "day")]
    df = spark.createDataFrame(rows, "g string, ref string, key string, value double, unit string")
    sums = {r.g: (r.result, r.refused) for r in Q.sum_units(df, ["g"]).collect()}
    assert sums == {"a": (90.0, None), "b": (None, "duplicate_reference"), "c": (None, "mixed_units"), "d": (None, "missing_value")}
    assert {r.g: r.refused for r in Q.count_distinct(df, ["g"]).collect()} == {"a": "mixed_units", "b": "duplicate_reference", "c": "mixed_units", "d": "missing_key"}
    units = spark.createDataFrame([(" Hours ",), ("mins",), ("glass",), ("",)], "u string").select(Q.unit_of(F.col("u")).alias("u"))
    assert column(units, "u") == ["hour", "minute", "glas", None]
    spans = spark.createDataFrame([("a b a", "b"), ("a b a", "a"), ("x", "y")], "t string, q string").select(Q.unique_span(F.col("t"), F.col("q")).alias("s"))
    assert [x and tuple(x) for x in column(spans, "s")] == [(2, 3), None, None]


def test_rollup_lifecycle(spark):
    r = spark.createDataFrame([("s", "day", "2024-01-31", "ready", 1, 0.0), ("s", "week", "2024-01-29", "building", 1, 5.0), ("s", "month", "2024-02-01", "ready", 1, 0.0)], "scope string, period_kind string, period_start string, status string, generation int, lease_until double").withColumn("period_start", F.to_date("period_start"))
    midnight = 1706745600.0  # 2024-02-01
    events = spark.createDataFrame([("s", midnight - 5, midnight + 5)], "scope string, covered_start double, covered_end double")
    stale = rollup.invalidated(events)
    assert sorted((x.period_kind, str(x.period_start)) for x in stale.collect()) == [("day", "2024-01-31"), ("day", "2024-02-01"), ("month", "2024-01-01"), ("month", "2024-02-01"), ("week", "2024-01-29")]
    marked = rollup.mark_stale(r, stale)
    assert {(x.period_kind, x.status, x.generation) for x in marked.collect()} == {("day", "stale", 2), ("week", "stale", 2), ("month", "stale", 2)}
    assert {x.period_kind: x.status for x in rollup.reclaim(r, 6.0).collect()}["week"] == "stale"
    late = r.filter("period_kind = 'day'").withColumn("status", F.lit("late"))
    assert "late" not in column(rollup.publish(marked, late), "status")
    assert "late" in column(rollup.publish(marked, late.withColumn("generation", F.lit(2))), "status")


def test_imports_and_writes(spark, tmp_path):
    lines = [{"id": "1", "role": "user", "content": "hi"}, {"uuid": "2", "parentUuid": "1", "type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}}, {"payload": {"id": "3", "role": "tool", "content": "out", "call_id": "c9"}}]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    got = src.read_jsonl(spark, str(tmp_path / "log.jsonl")).collect()
    assert [(r.source_key, r.role, r.content) for r in got[:3]] == [("1", "user", "hi"), ("2", "assistant", "a\nb"), ("3", "tool", "out")] and got[2].tool_call_id == "c9" and got[3].malformed == "not json"
    new = spark.createDataFrame([("1",), ("2",), ("2",)], "k string")
    assert src.import_new(new, spark.createDataFrame([("1",)], "k string"), ["k"]).count() == 1
    v1 = src.write_snapshot(new, str(tmp_path / "t"), 1)
    assert src.write_snapshot(v1.distinct(), str(tmp_path / "t"), 2).count() == 2
    empty = spark.createDataFrame([], schemas.MESSAGES)
    assert store.tail(empty, 3).count() == 0 and store.cleanup_stats(empty, spark.createDataFrame([], schemas.NODES)).count() == 0
    m = src.messages(spark, SF)
    assert m.filter(store.page_filter("")).count() == 0 and m.filter(store.page_filter(None)).count() == m.count()
    pinned = store.set_pinned(m, m.limit(2), True)
    assert pinned.filter("pinned").count() == 2
    calls = spark.createDataFrame([("s", "assistant", None, ["a", "b"]), ("s", "tool", "a", None), ("s", "tool", "z", None)], "session_id string, role string, tool_call_id string, ids array<string>").withColumn("tool_calls", F.transform("ids", lambda i: F.struct(i.alias("id"))))
    assert column(C.matched_calls(calls), "call_id") == ["a"]


def test_adjacency_fill(spark):
    nuclei = spark.createDataFrame([(10, 1), (20, 2)], "id long, rank int")
    near = spark.createDataFrame([(9, 10), (11, 10), (19, 20), (11, 20)], "id long, nucleus long")
    assert column(trajectory.fill_adjacent(nuclei, near, 5), "id") == [10, 20, 9, 11, 19]


def test_metrics(spark):
    hits = spark.createDataFrame([("q", 1, 1), ("q", 1, 2), ("q", 2, 3), ("r", 9, 1)], "query_id string, id long, rank int")
    want = spark.createDataFrame([("q", 2), ("q", 3), ("r", 9), ("s", 1)], "query_id string, id long")
    assert {r.query_id: r.recall for r in diagnostics.recall_at_k(hits, want, 2).collect()} == {"q": 0.5, "r": 1.0, "s": 0.0}
    assert {r.query_id: r.ndcg for r in diagnostics.ndcg_at_k(hits, want, 2).collect()}["r"] == 1.0


def test_streams(spark, tmp_path):
    events = streams.stream(spark, f"{SF}/events.parquet*")
    last = streams.drained(streams.last_seen(events), str(tmp_path / "out"), str(tmp_path / "a"), "update")
    batch = src.rollup_events(spark, SF).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    assert sorted(map(tuple, last.select("user_id", "n", "last").collect())) == sorted(map(tuple, batch.collect()))
    seen = []
    changes = events.select(F.col("user_id").cast("string").alias("scope"), (F.unix_micros("ts") / 1e6).alias("covered_start"), (F.unix_micros("ts") / 1e6).alias("covered_end"))
    streams.invalidations(changes, lambda df, i: seen.append((i, df.filter("period_kind = 'day'").count())), str(tmp_path / "b")).awaitTermination()
    assert sum(n for _, n in seen) == src.rollup_events(spark, SF).select("user_id", F.to_date("ts")).distinct().count()

"""Registered queries over whole tables, where the shipped ones don't show a part left out."""

import datetime
import re

from skein.operators import diagnostics, store, vector
from skein.plans import catalog, catalog_extra, catalog_more  # noqa: F401
from skein.sources import tables as src

SF = "/root/testdata/sf0.001"


def test_quarantine_of_long_texts(spark, tmp_path):
    """Every document has its row, and long repetitive texts a reason, as by plain Python."""
    texts = ["the same words again. " * 4000, " ".join(f"w{i}" for i in range(20000)), "z" * 70000, "ab " * 21845, "ab " * 21846, "short", None, "One line of it.\n" * 5000, "".join(f"Word{i} is here. " for i in range(9000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def reason(t):
        if t is None or len(t) < 65536:
            return None
        plain = re.sub(r"\s+", " ", t).strip(" ").lower()
        words, signs = re.findall("[a-z0-9_]+", plain), len(set(plain))
        parts = [x for x in (re.sub(r"\s+", " ", x).strip(" ") for x in re.split(r"\n+|(?<=[.!?])\s+", t.lower())) if len(x) >= 32]
        top, repeated = (max(map(parts.count, set(parts))) / len(parts), 1 - len(set(parts)) / len(parts)) if 20 <= len(parts) and len(set(parts)) < 100 else (0, 0)
        distinct = len(set(words)) / max(len(words), 1)
        common = max(map(words.count, set(words))) / len(words) if len(set(words)) < 2000 else 0
        loop = (distinct <= 0.03 and (top >= 0.1 or repeated >= 0.5 or common >= 0.08)) or (distinct <= 0.015 and signs <= 64)
        return "high_repetition" if (len(plain) >= 65536 and signs <= 12 if len(words) < 1000 else loop) else None

    got = {r.doc_id: r.reason for r in catalog.QUERIES["quarantine_reasons"](spark, str(tmp_path)).filter("doc_id >= 0").collect()}
    assert got == {i: reason(t) for i, t in enumerate(texts)}
    assert [i for i, x in got.items() if x] and got.keys() == set(range(len(texts)))


def test_two_stage_recall(spark):
    """Recall 0.9 with the query's own parameters, for the query's own row and others."""
    v = src.vectors(spark, SF).cache()
    near = lambda df: {r.row_id for r in df.collect()}
    row = catalog._vector(spark, SF)
    assert near(catalog.QUERIES["knn_two_stage"](spark, SF)) == near(vector.knn(v, row, 10, bound=None))
    asked = [r.embedding for r in v.filter("row_id % 100 = 0").collect()]
    hits = sum(len(near(vector.knn(v, q, 10, bound=None)) & near(vector.knn_two_stage(v, q, 10))) for q in asked)
    assert hits >= 9 * len(asked)
    odd = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (4, [1.0]), (5, [-3.0, 4.0]), (6, None), (7, [-1.0, 0.5])]
    odd = spark.createDataFrame([(i, e, False, 1.0) for i, e in odd], "row_id long, embedding array<double>, archived boolean, timestamp double")
    for k in (1, 2, 3, 10):
        assert [r.row_id for r in vector.knn_two_stage(odd, [3.0, 4.0], k, mult=1).collect()] == [1, 5, 7][:k]
    v.unpersist()


def test_documents_of_hot_users(spark, tmp_path):
    """A user with a third of the events has a document too, of 64 states evenly over them."""
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i % 700), 7 if i % 3 == 0 else i % 20, f"t{i % 11}", 1.0, "{}") for i in range(2100)]
    rows += [(5000 + i, datetime.datetime(2024, 2, 1) + datetime.timedelta(minutes=i), 90 + i // 200, f"s{i}", 1.0, "{}") for i in range(401)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    users = {}
    for e, t, u, kind, *_ in rows:
        users.setdefault(u, []).append((t, e, kind))
    want = {}
    for u, own in users.items():
        own.sort()
        if len(own) > 64:
            own = [own[i] for i in sorted({round(j * (len(own) - 1) / 63) for j in range(64)})]
        want[u] = ("\n".join(x[2] for x in own), len(own))
    got = {r.user_id: (r.document, r.n_states) for r in catalog.QUERIES["trajectory_documents"](spark, str(tmp_path)).collect()}
    assert max(map(len, users.values())) > 700 and got == want


def test_whole_tables():
    """No SQL leaves rows out by a number of their id or asks for a fixed handful of them; tests/test_queries.py holds the queries against it."""
    cuts = ("node_id % 3 > 0", "event_id % 50", "p_name, '[0-9#]'", "row_id < 10", "row_id < 20", "length(text) < 65536")
    assert not [(name, cut) for name, text in catalog.ORACLE.items() for cut in cuts if cut in text]


def test_numbers_of_all_names(spark, tmp_path):
    rows = [(1, "plain name"), (2, "part 7 of 1,200"), (3, "Brand#13")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.numbers for r in catalog.QUERIES["stated_numbers"](spark, str(tmp_path)).collect()}
    assert got == {1: [12.0, 3.5, 7.0], 2: [7.0, 1200.0, 12.0, 3.5, 7.0], 3: [13.0, 12.0, 3.5, 7.0]}


def test_one_sided_sessions(spark):
    """Sessions that only messages or only nodes know are counted; summaries of every depth count."""
    m = spark.createDataFrame([("a", 5, 100.0), ("a", 6, 200.0), ("b", 7, 300.0)], "session_id string, token_estimate int, timestamp double")
    n = spark.createDataFrame([("a", 0, 3, 50.0, None, 60.0), ("a", 1, 4, None, 900.0, 70.0), ("c", 2, 9, 10.0, 20.0, 30.0)], "session_id string, depth int, token_count int, earliest_at double, latest_at double, created_at double")
    stats = store.cleanup_stats(m, n)
    got = {r.session_id: (r.n_messages, r.message_tokens, r.n_nodes, r.node_tokens) for r in stats.collect()}
    assert got == {"a": (2, 11, 2, 7), "b": (1, 7, 0, 0), "c": (0, 0, 1, 9)}
    kept = {r.session_id: (r.n_messages, r.n_nodes, r.footprint, r.first_at, r.last_at) for r in store.retention_stats(m, n, 86400.0).collect()}
    assert kept == {"a": (2, 2, 18, 50.0, 900.0), "b": (1, 0, 7, 300.0, 300.0), "c": (0, 1, 9, 10.0, 20.0)}
    assert {r.session_id: r["class"] for r in diagnostics.cleanup_candidates(stats, [], ["a"]).collect()} == {"a": "protected", "b": "kept", "c": "empty"}


def test_blocks_of_queries(spark, monkeypatch):
    """More queries than a block holds give the same as one block."""
    v = src.vectors(spark, SF)
    q = v.filter("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")
    rows = lambda: sorted(map(tuple, vector.knn_batch(v, q, 10, 64).select("query_id", "place", "row_id").collect()))
    want = rows()
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    assert len(want) == 100 and rows() == want

"""The tools by name, and passes over whole conversations against plain Python."""

import json

import pytest
from pyspark.sql import functions as F
from skein import tools
from skein.operators import compaction, store
from skein.sources import tables as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    said = [(1, "s1", "user", "I ran 3 hours on Monday and 30 minutes on Friday."), (2, "s1", "assistant", "That is a lot."), (3, "s2", "user", "Lunch with Anna Lee was $12."), (4, "s2", "tool", "see [Externalized payload: kind=x; ref=r1] there")]
    m = spark.createDataFrame([(i, s, "g", r, t, 100.0 * i, 10, None) for i, s, r, t in said], "store_id long, session_id string, conversation_id string, role string, content string, timestamp double, token_estimate int, source string")
    n = spark.createDataFrame([(50, "s1", 0, "a run on monday", 5, 20, [1, 2], "messages", 250.0, 100.0, 200.0)], "node_id long, session_id string, depth int, summary string, token_count long, source_token_count long, source_ids array<long>, source_type string, created_at double, earliest_at double, latest_at double")
    p = spark.createDataFrame([("r2", "s2", "x")], "ref string, session_id string, content string")
    path = f"{src.shared_dir(spark)}/tools-test"
    m.write.mode("overwrite").parquet(f"{path}/m")
    n.write.mode("overwrite").parquet(f"{path}/n")
    return tools.Engine(spark, spark.read.parquet(f"{path}/m"), spark.read.parquet(f"{path}/n"), payloads=p, now=300.0)


def ask(engine, name, **args):
    return json.loads(tools.call(engine, name, args))


def test_tools(engine):
    assert {(h["kind"], h["id"]) for h in ask(engine, "search", query="monday")["hits"]} == {("message", 1), ("summary", 50)}
    page = ask(engine, "load_session", session_id="s1", limit=1, max_tokens=3)
    assert page["messages"][0]["part"] == {"content": "I ran 3 hou", "content_offset": 0, "next_offset": 11, "has_more": True} and page["truncated"] and page["next_after"] == 1
    assert [s["id"] for s in ask(engine, "expand", node_id=50)["sources"]] == [1, 2]
    assert ask(engine, "describe", node_id=50)["node"]["summary"] == "a run on monday"
    assert [b["store_id"] for b in ask(engine, "expand_query", query="monday")["blocks"]] == [1, 2]
    assert [s["node_id"] for s in ask(engine, "recent", period="date:1970-01-01")["summaries"]] == [50]
    assert ask(engine, "status")["messages"] == 4 and ask(engine, "status")["compression"] == 4.0
    assert {c["check"]: c["n"] for c in ask(engine, "doctor")["checks"]}["orphan_nodes"] == 0
    assert ask(engine, "inspect")["sessions"] == [{"session_id": "s2", "n_refs": 1, "n_missing": 1, "chars": 0}]
    assert ask(engine, "query_state") == {"assertions": [], "truncated": False}
    assert ask(engine, "nothing")["error"] == "unknown_tool" and json.loads(tools.call(engine, "search", "{"))["error"] == "bad_arguments" and ask(engine, "describe")["error"] == "bad_arguments"


def test_compute_tool(engine):
    operand = lambda quote, value, unit: {"store_id": 1, "span_start": 0, "span_end": 48, "quote": "I ran 3 hours on Monday and 30 minutes on Friday.", "value": value, "unit": unit} | ({"span_start": (a := "I ran 3 hours on Monday and 30 minutes on Friday.".index(quote)), "span_end": a + len(quote), "quote": quote})
    both = [operand("3 hours", 3, "hour"), operand("30 minutes", 30, "minute")]
    assert ask(engine, "compute_answer", question="How many minutes in total?", operands=both)["result"] == 210.0
    assert ask(engine, "compute_answer", question="What is the average?", operands=both)["refused"] == "unsupported_aggregate"
    wrong = ask(engine, "compute_answer", question="How many hours in total?", operands=[both[0] | {"value": 4}])
    assert wrong["refused"] == "operands_not_grounded" and wrong["problems"] == [{"store_id": 1, "problem": "value_not_quoted"}]
    assert ask(engine, "compute_answer", question="How many hours in total?")["refused"] == "no_operands"
    dated = [both[0] | {"key": "b", "day": "2024-01-05"}, both[1] | {"key": "a", "day": "2024-01-01"}]
    assert [r["key"] for r in ask(engine, "compute_answer", question="In what order did it happen?", operands=dated)["result"]] == ["a", "b"]
    pack = ask(engine, "evidence_pack", candidates=[{"store_id": 1, "span_start": 0, "span_end": 20, "quote": "3 hours"}, {"store_id": 9, "span_start": 0, "span_end": 2}])
    assert [(i["span_start"], i["span_end"]) for i in pack["items"]] == [(6, 13)] and [r["problem"] for r in pack["rejected"]] == ["missing_source"]


def test_sweep_against_plain_python(spark):
    """Frontiers are condensed two by two, lowest depth first, until they fit or nothing can be; every message stays under one root."""
    leaf = [(s * 100 + i, f"s{s}", 0, f"node {i} of {s} " * 8, [s * 1000 + i]) for s, k in ((1, 7), (2, 1), (3, 4)) for i in range(k)]
    n = spark.createDataFrame([(i, s, d, t, len(t) // 4 + 1, 50, ids, "messages", float(i), float(i), float(i)) for i, s, d, t, ids in leaf], "node_id long, session_id string, depth int, summary string, token_count long, source_token_count long, source_ids array<long>, source_type string, created_at double, earliest_at double, latest_at double")
    short = lambda text, budget: F.substring(text, 1, 40)
    nodes, passes = compaction.sweep(n, 30, fanin=2, levels=(short,))

    depth = {i: d for i, _, d, _, _ in leaf}
    frontier = {s: [(i, len(t) // 4 + 1) for i, x, _, t, _ in leaf if x == s] for s in ("s1", "s2", "s3")}
    made, turns = 0, 0
    while True:
        added = False
        for s, own in frontier.items():
            by = {d: [x for x in own if depth[x[0]] == d] for d in sorted({depth[i] for i, _ in own})}
            d = next((d for d, xs in by.items() if len(xs) >= 2), None)
            if sum(c for _, c in own) <= 30 or d is None:
                continue
            xs, added = by[d], True
            for k in range(0, len(xs) - 1, 2):
                made += 1
                depth[f"{s}.{made}"] = d + 1
                own[:] = [x for x in own if x not in xs[k : k + 2]] + [(f"{s}.{made}", 11)]
        if not added:
            break
        turns += 1
    assert passes == turns and nodes.count() == len(leaf) + made
    left = {r.session_id: r.tokens for r in compaction.frontier_tokens(nodes).collect()}
    assert left == {s: sum(c for _, c in own) for s, own in frontier.items()}
    assert nodes.select("node_id").distinct().count() == nodes.count()
    assert compaction.sweep(nodes, 30, fanin=2)[1] == 0 and compaction.sweep(n, 30, passes=0)[1] == 0


def test_compaction_keeps_every_message_once(spark):
    m = src.messages(spark, SF)
    nodes, context = compaction.compact(m, src.nodes(spark, SF).limit(0), leaf_budget=60, tail=1, target=100, fanin=2)
    held = [r.x for r in nodes.filter("depth = 0").select(F.explode("source_ids").alias("x")).collect()]
    kept = {r.id for r in context.filter("tier = 0").collect()}
    assert len(held) == len(set(held)) and not kept & set(held)
    last = {r.session_id: r.i for r in m.groupBy("session_id").agg(F.max("store_id").alias("i")).collect()}
    assert set(held) | set(last.values()) == {r.store_id for r in m.select("store_id").collect()}
    assert {r.session_id for r in context.groupBy("session_id").agg(F.sum("tokens").alias("t")).filter("t > 100").collect()} == set()


def test_escalation(spark):
    """A level counts only if it says something within the budget; else the next does, and at last the text's two ends."""
    empty, long_, fine = (lambda t, b: F.lit(" ")), (lambda t, b: F.repeat(t, 9)), (lambda t, b: F.lit("fine"))
    df = spark.createDataFrame([("word " * 100,)], "t string")
    one = lambda *levels: df.select(compaction.escalated(F.col("t"), F.lit(20), *levels).alias("x")).first().x
    assert one(empty, fine, long_) == "fine" and one(long_) == one() and len(one()) // 4 + 1 <= 20 and one().startswith("word ") and "..." in one()


def test_append_numbers_once(spark):
    m = src.messages(spark, SF)
    new = m.limit(500).withColumn("timestamp", F.rand(3))
    got = [r.store_id for r in store.append(m, new.drop("store_id")).select("store_id").collect()]
    top = m.agg(F.max("store_id")).first()[0]
    assert sorted(got) == list(range(top + 1, top + 1 + len(got))) and len(got) == new.count()

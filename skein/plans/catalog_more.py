"""The rest of the queries: graph, rollups, folds, assertions, computation, trajectories, checks, measures, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.operators import assertions as A
from skein.operators import chunk as C
from skein.operators import compute as Q
from skein.operators import dag, diagnostics, fusion, rollup, trajectory
from skein.plans.catalog import _CARRIED, NOW, query
from skein.plans.catalog_sql import M, N, R, V, sql
from skein.sources import tables as src
from skein.streaming import events as streams

_FLAGGED = _CARRIED.replace("p_partkey % 8", "p_partkey % 10").replace("ELSE p_name", "WHEN 8 THEN ' [Acknowledged] ' WHEN 9 THEN 'Still working...' ELSE p_name")

# --- graph -----------------------------------------------------------------


@query(sql("SELECT node_id, session_id, depth, summary, token_count, source_token_count, source_ids, earliest_at, latest_at FROM n", M, N))
def build_nodes(spark, d):
    return src.nodes(spark, d).select("node_id", "session_id", "depth", "summary", F.col("token_count").cast("int").alias("token_count"), "source_token_count", "source_ids", "earliest_at", "latest_at")


@query(sql("SELECT depth, count(*) AS n, sum(token_count) AS tokens, sum(source_token_count) AS source_tokens FROM n GROUP BY depth", M, N))
def depth_stats(spark, d):
    return dag.depth_stats(src.nodes(spark, d))


@query(sql("SELECT session_id, depth, node_id, cast(row_number() OVER (PARTITION BY session_id, depth ORDER BY created_at, node_id) AS INT) AS place FROM n QUALIFY place <= 1", M, N))
def depth_samples(spark, d):
    return dag.depth_samples(src.nodes(spark, d), 1).select("session_id", "depth", "node_id", "place")


@query(sql("SELECT session_id, min(coalesce(earliest_at, created_at)) AS start_at, max(coalesce(latest_at, created_at)) AS end_at FROM n GROUP BY 1", M, N))
def node_time_windows(spark, d):
    return dag.time_window(src.nodes(spark, d), "session_id")


@query(sql("SELECT node_id FROM n LEFT JOIN (SELECT DISTINCT child FROM e WHERE child_type = 'nodes') c ON c.child = n.node_id WHERE c.child IS NULL", M, N))
def frontier(spark, d):
    return dag.unreferenced(src.nodes(spark, d)).select("node_id")


@query(sql("SELECT node_id FROM n WHERE depth = 0 AND session_id <> 'c5' AND node_id NOT IN (SELECT child FROM e WHERE child_type = 'nodes' AND parent // 1000 % 3 <> 0) UNION ALL SELECT node_id FROM n WHERE depth = 0 AND session_id = 'c5'", M, N))
def uncondensed(spark, d):
    return dag.uncondensed(src.nodes(spark, d).filter("depth = 0 OR (session_id <> 'c5' AND floor(node_id / 1000) % 3 <> 0)"), 0).select("node_id")


@query(sql("SELECT parent, child, depth FROM e JOIN n ON n.node_id = child WHERE child_type = 'nodes'", M, N))
def node_children(spark, d):
    return dag.children(src.nodes(spark, d)).select("parent", "child", "depth")


_WALK = "w(root, node_id, level) AS (SELECT node_id, node_id, 0 FROM n WHERE depth = 2 UNION ALL SELECT w.root, e.child, w.level + 1 FROM w JOIN e ON e.parent = w.node_id AND e.child_type = 'nodes')"


@query(sql("SELECT root, node_id, level FROM w", M, N, _WALK, recursive=True))
def lineage_levels(spark, d):
    n = src.nodes(spark, d)
    return dag.lineage(n, n.filter("depth = 2"))


@query(sql("SELECT root, node_id, level FROM w", M, N, _WALK, recursive=True))
def lineage_recursive(spark, d):
    n = src.nodes(spark, d)
    return dag.lineage_recursive(n, n.filter("depth = 2"))


@query(sql("SELECT w.root, e.child AS store_id FROM w JOIN e ON e.parent = w.node_id AND e.child_type = 'messages'", M, N, _WALK, recursive=True))
def lineage_messages(spark, d):
    n = src.nodes(spark, d)
    return dag.leaf_messages(n, dag.lineage(n, n.filter("depth = 2")))


@query(sql("SELECT DISTINCT w.root AS node_id FROM w JOIN e ON e.parent = w.node_id AND e.child_type = 'messages' JOIN m ON m.store_id = e.child WHERE m.source = 'src2'", M, N, "w(root, node_id) AS (SELECT node_id, node_id FROM n UNION ALL SELECT w.root, e.child FROM w JOIN e ON e.parent = w.node_id AND e.child_type = 'nodes')", recursive=True))
def nodes_of_source(spark, d):
    return dag.with_source(src.nodes(spark, d), src.messages(spark, d), F.col("source") == "src2").select("node_id")


@query(sql("SELECT max(node_id) AS node_id FROM n WHERE cast(substr(session_id, 2) AS INT) % 2 = 0 GROUP BY session_id UNION ALL SELECT node_id FROM n WHERE cast(substr(session_id, 2) AS INT) % 2 = 1 AND depth = 1", M, N))
def canonical_frontier(spark, d):
    n = src.nodes(spark, d)
    topless = F.expr("cast(substring(session_id, 2) as int) % 2 = 1 and depth = 2")
    return dag.canonical_frontier(n, n.filter(~topless)).select("node_id")


@query(sql("SELECT place, id, tokens FROM (SELECT row_number() OVER (ORDER BY store_id) - 1 AS place, store_id AS id, token_estimate AS tokens, sum(token_estimate) OVER (ORDER BY store_id) AS used FROM m WHERE session_id = 'c1' AND store_id < 1004) WHERE used <= 500 OR place = 0", M))
def expand_budget(spark, d):
    return dag.expand(src.nodes(spark, d), src.messages(spark, d), 1000, 500).select(F.col("place").cast("long").alias("place"), "id", F.col("tokens").cast("int").alias("tokens"))


@query(sql("SELECT parent AS node_id, count(*) AS missing FROM e WHERE child_type = 'messages' AND child % 5 = 2 GROUP BY 1", M, N))
def orphan_nodes(spark, d):
    return dag.orphans(src.nodes(spark, d), src.messages(spark, d).filter("store_id % 5 <> 2"))


@query(sql("SELECT count(*) AS n, count(*) FILTER (source_token_count / greatest(token_count, 1) >= 400) AS extreme, count(*) FILTER (source_token_count >= 100000 AND token_count < 500) AS tiny, round(max(source_token_count / greatest(token_count, 1)), 6) AS worst FROM n", M, N))
def summary_quality(spark, d):
    return dag.quality(src.nodes(spark, d))


@query(sql("SELECT node_id, round(source_token_count / greatest(token_count, 1), 6) AS ratio FROM n ORDER BY token_count = 0 DESC, ratio DESC, node_id LIMIT 5", M, N))
def worst_summaries(spark, d):
    return dag.worst_summaries(src.nodes(spark, d)).select("node_id", "ratio")


@query(sql("SELECT session_id, list(node_id ORDER BY created_at, node_id) AS source_ids, greatest(1000, cast(floor(sum(token_count) * 0.4) AS BIGINT)) AS budget FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY created_at, node_id) - 1) // 2 AS g FROM n WHERE depth = 0) GROUP BY session_id, g HAVING count(*) >= 2", M, N))
def condensed(spark, d):
    return dag.condense(src.nodes(spark, d).filter("depth = 0"), 0, 2).select("session_id", "source_ids", "budget")


# --- rollups ---------------------------------------------------------------


def _period(kind):
    return f"SELECT scope, cast(date_trunc('{kind}', ts) AS DATE) AS period_start, count(*) AS n, round(sum(value), 6) AS total, sum(k) AS k_total, count(DISTINCT event_type) AS kinds, count(DISTINCT cast(ts AS DATE)) AS days FROM ev GROUP BY ALL"


@query(sql(_period("day"), R))
def rollup_day(spark, d):
    return rollup.aggregate(src.rollup_events(spark, d), "day")


@query(sql(_period("week"), R))
def rollup_week(spark, d):
    return rollup.aggregate(src.rollup_events(spark, d), "week")


@query(sql(_period("month"), R))
def rollup_month(spark, d):
    return rollup.aggregate(src.rollup_events(spark, d), "month")


_DAYS = "dy AS (SELECT scope, cast(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') < 3 AS ready FROM ev GROUP BY ALL)"


def _days(spark, d):
    return src.rollup_events(spark, d).groupBy("scope", F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "error") < 3).alias("ready"))


@query(sql("SELECT scope, cast(date_trunc('week', day) AS DATE) AS period_start, bool_and(ready) AS complete, count(*) AS content_days FROM dy GROUP BY ALL", R, _DAYS))
def rollup_gate(spark, d):
    return rollup.gate(_days(spark, d), "week")


_SPANS = "sp AS (SELECT scope, epoch(min(ts)) AS a, epoch(max(ts)) AS b FROM ev WHERE event_type = 'error' GROUP BY scope), sd AS (SELECT DISTINCT scope, unnest(generate_series(cast(to_timestamp(a) AT TIME ZONE 'UTC' AS DATE)::TIMESTAMP, cast(to_timestamp(b) AT TIME ZONE 'UTC' AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM sp)"


def _spans(spark, d):
    e = src.rollup_events(spark, d).filter("event_type = 'error'").withColumn("t", F.unix_micros("ts") / 1e6)
    return e.groupBy("scope").agg(F.max("t").alias("covered_start"), F.min("t").alias("covered_end"))  # the wrong way round


@query(sql("SELECT DISTINCT scope, kind AS period_kind, cast(date_trunc(kind, day) AS DATE) AS period_start FROM sd, (VALUES ('day'), ('week'), ('month')) k(kind)", R, _SPANS))
def invalidated_periods(spark, d):
    return rollup.invalidated(_spans(spark, d))


_ROLLS = "ro AS (SELECT scope, 'day' AS period_kind, day AS period_start, CASE WHEN ready THEN 'ready' ELSE 'failed' END AS status, 1 AS generation FROM dy)"


def _rollups(spark, d):
    return _days(spark, d).select("scope", F.lit("day").alias("period_kind"), F.col("day").alias("period_start"), F.when(F.col("ready"), "ready").otherwise("failed").alias("status"), F.lit(1).alias("generation"))


@query(sql("SELECT scope, period_kind, period_start, CASE WHEN s.scope IS NULL THEN status ELSE 'stale' END AS status, CASE WHEN s.scope IS NULL THEN 1 ELSE 2 END AS generation FROM ro LEFT JOIN (SELECT DISTINCT scope, cast(day AS DATE) AS period_start FROM sd) s USING (scope, period_start)", R, _DAYS, _SPANS, _ROLLS))
def stale_rollups(spark, d):
    return rollup.mark_stale(_rollups(spark, d), rollup.invalidated(_spans(spark, d)))


@query(sql("SELECT period_kind, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'building') AS building, count(*) FILTER (status = 'failed') AS failed, min(period_start) FILTER (status = 'stale') AS oldest_stale FROM ro GROUP BY 1", R, _DAYS, _ROLLS))
def status_pivot(spark, d):
    return rollup.status_pivot(_rollups(spark, d))


@query(sql("SELECT 10 AS expected, count(DISTINCT period_start) FILTER (status = 'ready') AS ready, 0 AS pending, count(DISTINCT period_start) FILTER (status = 'ready') = 10 AS served FROM ro WHERE scope = 'u3' AND period_start BETWEEN DATE '2024-01-05' AND DATE '2024-01-14'", R, _DAYS, _ROLLS))
def recent_coverage(spark, d):
    r = _rollups(spark, d)
    return rollup.covered(r, r.limit(0), "u3", "2024-01-05", "2024-01-14")


_NODE_DAYS = "nd AS (SELECT session_id AS scope, node_id, coalesce(summary, '') AS summary, cast(unnest(generate_series(cast(to_timestamp(coalesce(earliest_at, created_at)) AT TIME ZONE 'UTC' AS DATE)::TIMESTAMP, cast(to_timestamp(coalesce(latest_at, created_at)) AT TIME ZONE 'UTC' AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM n)"


@query(sql("SELECT scope, day, count(*) AS n_sources, list(node_id ORDER BY node_id) AS source_ids, sha256(string_agg(node_id || ':' || sha256(summary), ',' ORDER BY node_id)) AS fingerprint FROM nd GROUP BY ALL", M, N, _NODE_DAYS))
def summary_days(spark, d):
    return rollup.build_days(src.nodes(spark, d)).select("scope", "day", "n_sources", "source_ids", "fingerprint")


@query(sql("SELECT node_id, start_at, end_at FROM (SELECT node_id, coalesce(earliest_at, created_at) AS start_at, coalesce(latest_at, created_at) AS end_at FROM n) WHERE start_at < 1704200000 AND end_at >= 1704090000 ORDER BY end_at DESC, node_id DESC LIMIT 20", M, N))
def recent_window(spark, d):
    return rollup.recent(src.nodes(spark, d), 1704090000.0, 1704200000.0).select("node_id", "start_at", "end_at")


@query(sql("SELECT node_id, CASE WHEN node_id % 5 = 0 THEN 'delete' WHEN node_id % 5 = 1 THEN 'insert' ELSE 'update' END AS operation, session_id AS scope, coalesce(earliest_at, created_at) + t AS covered_start FROM n, (VALUES (0), (60)) s(t) WHERE node_id % 5 < 3 AND depth = 0 AND (t = 0 OR node_id % 5 = 2)", M, N))
def node_changes(spark, d):
    n = src.nodes(spark, d).filter("depth = 0")
    moved = F.when(F.col("node_id") % 5 == 2, F.col("earliest_at") + 60).otherwise(F.col("earliest_at"))
    return rollup.changes(n.filter("node_id % 5 <> 1"), n.filter("node_id % 5 <> 0").withColumn("earliest_at", moved)).select("node_id", "operation", "scope", "covered_start")


# --- folds -----------------------------------------------------------------


@query()
def chunk_windows(spark, d):
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("store_id"), F.lit("user").alias("role"), F.col("text").alias("content"))
    return C.chunk(docs)


@query(sql("SELECT session_id, store_id, c AS token_estimate, segment FROM f", M, "p AS (SELECT session_id, store_id, token_estimate AS c, row_number() OVER (PARTITION BY session_id ORDER BY store_id) AS i FROM m)", """f(session_id, i, store_id, c, used, segment) AS (SELECT session_id, i, store_id, c, c, 0 FROM p WHERE i = 1
    UNION ALL SELECT p.session_id, p.i, p.store_id, p.c, CASE WHEN f.used + p.c > 400 THEN p.c ELSE f.used + p.c END, f.segment + CASE WHEN f.used + p.c > 400 THEN 1 ELSE 0 END FROM f JOIN p ON p.session_id = f.session_id AND p.i = f.i + 1)""", recursive=True))
def leaf_chunks(spark, d):
    return C.fold_segments(src.messages(spark, d).select("session_id", "store_id", "token_estimate"), "session_id", "store_id", "token_estimate", 400)


@query(sql("SELECT session_id, store_id FROM (SELECT *, sum(token_estimate) OVER w AS used, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY session_id ORDER BY store_id)) WHERE used <= 400 OR rn = 1", M))
def oldest_leaf_chunk(spark, d):
    return C.oldest_chunk(src.messages(spark, d), "session_id", "store_id", "token_estimate", 400).select("session_id", "store_id")


@query(sql("SELECT session_id, store_id FROM (SELECT *, sum(token_estimate) OVER w AS used, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY session_id ORDER BY store_id DESC)) WHERE rn <= 3 AND (used <= 300 OR rn = 1)", M))
def fresh_tail(spark, d):
    return C.fresh_tail(src.messages(spark, d), 3, 300).select("session_id", "store_id")


@query(sql("SELECT session_id, tier, depth, id, tokens FROM f WHERE keep", M, N, """q AS (SELECT session_id, 0 AS tier, 0 AS depth, store_id AS id, cast(token_estimate AS BIGINT) AS tokens FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY store_id DESC) <= 4 UNION ALL SELECT session_id, 1, depth, node_id, cast(token_count AS BIGINT) FROM n)""",
    "p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tier, depth DESC, id DESC) AS i FROM q)", """f(session_id, i, tier, depth, id, tokens, room, closed, keep) AS (SELECT session_id, i, tier, depth, id, tokens, 500 - CASE WHEN tokens <= 500 THEN tokens ELSE 0 END, tier = 0 AND tokens > 500, tokens <= 500 FROM p WHERE i = 1
    UNION ALL SELECT p.session_id, p.i, p.tier, p.depth, p.id, p.tokens, f.room - CASE WHEN p.tokens <= f.room AND NOT (f.closed AND p.tier = 0) THEN p.tokens ELSE 0 END, f.closed OR (p.tier = 0 AND p.tokens > f.room), p.tokens <= f.room AND NOT (f.closed AND p.tier = 0) FROM f JOIN p ON p.session_id = f.session_id AND p.i = f.i + 1)""", recursive=True))
def context_assembly(spark, d):
    return C.assemble(C.fresh_tail(src.messages(spark, d), 4), src.nodes(spark, d), 500)


@query(sql("SELECT conversation_id, store_id, c AS token_estimate, request FROM f", M, "p AS (SELECT conversation_id, store_id, token_estimate AS c, row_number() OVER (PARTITION BY conversation_id ORDER BY store_id) AS i FROM m)", """f(conversation_id, i, store_id, c, have, used, request) AS (SELECT conversation_id, i, store_id, c, 1, c, 0 FROM p WHERE i = 1
    UNION ALL SELECT p.conversation_id, p.i, p.store_id, p.c, CASE WHEN f.have >= 8 OR f.used + p.c > 600 THEN 1 ELSE f.have + 1 END, CASE WHEN f.have >= 8 OR f.used + p.c > 600 THEN p.c ELSE f.used + p.c END, f.request + CASE WHEN f.have >= 8 OR f.used + p.c > 600 THEN 1 ELSE 0 END FROM f JOIN p ON p.conversation_id = f.conversation_id AND p.i = f.i + 1)""", recursive=True))
def request_packing(spark, d):
    return C.pack(src.messages(spark, d).select("conversation_id", "store_id", "token_estimate"), "conversation_id", "store_id", "token_estimate", 8, 600)


@query(sql("SELECT conversation_id, store_id, session_id, day FROM f WHERE keep", M, "p AS (SELECT conversation_id, store_id, session_id, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY conversation_id ORDER BY store_id) AS i FROM m)", """f(conversation_id, i, store_id, session_id, day, ss, ds, keep) AS (SELECT conversation_id, i, store_id, session_id, day, [session_id], [day], true FROM p WHERE i = 1
    UNION ALL SELECT conversation_id, i, store_id, session_id, day, CASE WHEN keep THEN list_append(ss, session_id) ELSE ss END, CASE WHEN keep THEN list_append(ds, day) ELSE ds END, keep
    FROM (SELECT p.conversation_id, p.i, p.store_id, p.session_id, p.day, f.ss, f.ds, len(list_filter(f.ss, lambda x: x = p.session_id)) < 3 AND len(list_filter(f.ds, lambda x: x = p.day)) < 8 AS keep FROM f JOIN p ON p.conversation_id = f.conversation_id AND p.i = f.i + 1))""", recursive=True))
def diverse_evidence(spark, d):
    m = src.messages(spark, d).select("conversation_id", "store_id", "session_id", F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd").alias("day"))
    return C.diverse(m, "conversation_id", "store_id", "session_id", "day", 3, 8)


@query(sql("SELECT session_id, store_id FROM m WHERE store_id % 10 IN (3, 4, 5)", M))
def replay_dedup(spark, d):
    m = src.messages(spark, d)
    return trajectory.replayed(m, m.filter("store_id % 10 NOT IN (3, 4, 5)")).select("session_id", "store_id")


# --- assertions and computation --------------------------------------------

_O = "a AS (SELECT o_orderkey AS id, 'customer:' || o_custkey AS subject_key, 'status' AS predicate_key, o_orderstatus AS object_json, 'fact' AS kind, 'global' AS scope_key, epoch(o_orderdate) AS observed_at, CASE WHEN o_orderkey % 3 = 0 THEN epoch(o_orderdate) + 86400 * 200 END AS valid_to FROM orders)"


def _orders(spark, d):
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    return src.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("assertion_id"), F.concat(F.lit("customer:"), "o_custkey").alias("subject_key"), F.lit("status").alias("predicate_key"), F.col("o_orderstatus").alias("object_json"), F.lit("fact").alias("kind"), F.lit("global").alias("scope_key"),
        at.alias("observed_at"), F.lit(None).cast("double").alias("event_at"), F.lit(None).cast("double").alias("valid_from"), F.when(F.col("o_orderkey") % 3 == 0, at + 86400 * 200).alias("valid_to"),
    )


@query(sql("SELECT id FROM a WHERE observed_at <= 900000000 AND (valid_to IS NULL OR valid_to > 900000000)", _O))
def assertions_as_of(spark, d):
    return A.as_of(_orders(spark, d), 900000000.0).select("id")


_REL = "r AS (SELECT cast(o_orderkey AS VARCHAR) AS to_id, cast(o_orderkey + 7 AS VARCHAR) AS from_id, CASE o_orderkey % 6 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'cancels' WHEN 2 THEN 'contradicts' ELSE 'accepts' END AS type FROM orders WHERE o_orderkey % 2 = 0)"


def _relations(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 6 == 0, "supersedes").when(k % 6 == 1, "cancels").when(k % 6 == 2, "contradicts").otherwise("accepts")
    return src.table(spark, d, "orders").filter(k % 2 == 0).select(k.cast("string").alias("to_id"), (k + 7).cast("string").alias("from_id"), kind.alias("type"))


@query(sql("""SELECT a.id, CASE WHEN a.id % 6 = 0 THEN ['superseded'] ELSE [] END AS statuses, a.id % 6 <> 0 AS active, coalesce(g.n, 0) AS n_objects, a.id % 6 <> 0 AND (coalesce(g.n, 0) > 1 OR a.id % 6 = 2 OR h.from_id IS NOT NULL) AS conflict
    FROM a LEFT JOIN (SELECT subject_key, count(DISTINCT object_json) AS n FROM a WHERE id % 6 <> 0 GROUP BY 1) g USING (subject_key) LEFT JOIN (SELECT DISTINCT from_id FROM r WHERE type = 'contradicts') h ON h.from_id = cast(a.id AS VARCHAR)""", _O, _REL))
def assertion_state(spark, d):
    return A.state(_orders(spark, d), _relations(spark, d)).select("id", "statuses", "active", "n_objects", "conflict")


@query(sql("SELECT subject_key, max(observed_at) AS at_, CASE WHEN count(DISTINCT object_json) = 1 THEN min(object_json) END AS object_json, count(DISTINCT object_json) > 1 AS conflict FROM (SELECT *, rank() OVER (PARTITION BY subject_key ORDER BY observed_at DESC) AS n FROM a) WHERE n = 1 GROUP BY 1", _O))
def latest_fact(spark, d):
    return A.latest_fact(_orders(spark, d)).select("subject_key", F.col("at").alias("at_"), "object_json", "conflict")


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN count(DISTINCT l_partkey) END AS result, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'mixed_units' END AS refused FROM lineitem GROUP BY 1")
def compute_count_distinct(spark, d):
    rows = src.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("unit"), F.monotonically_increasing_id().alias("ref"))
    return Q.count_distinct(rows, ["l_orderkey"])


_UNIT = "CASE l_linenumber % 4 WHEN 0 THEN 'minute' WHEN 1 THEN 'hour' WHEN 2 THEN 'day' ELSE 'week' END"


@query(f"SELECT l_suppkey, round(sum(l_quantity * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 1440 ELSE 10080 END) / 60, 4) AS result, cast(NULL AS VARCHAR) AS refused FROM lineitem GROUP BY 1")
def compute_sum_units(spark, d):
    k = F.col("l_linenumber") % 4
    unit = F.when(k == 0, "minute").when(k == 1, "hour").when(k == 2, "day").otherwise("week")
    rows = src.table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("value"), unit.alias("unit"), F.monotonically_increasing_id().alias("ref"))
    return Q.sum_units(rows, ["l_suppkey"], "hour").withColumn("result", F.round("result", 4))


@query("SELECT k, CASE WHEN n = 2 AND a >= b THEN round(a - b, 6) END AS result, CASE WHEN n <> 2 THEN 'two_operands_needed' WHEN a < b THEN 'direction_contradicted' END AS refused FROM (SELECT o_custkey AS k, count(*) FILTER (o_orderkey % 2 = 0) * 10 + count(*) FILTER (o_orderkey % 2 = 1) AS c, CASE WHEN count(*) FILTER (o_orderkey % 2 = 0) = 1 AND count(*) FILTER (o_orderkey % 2 = 1) = 1 THEN 2 ELSE 0 END AS n, sum(o_totalprice) FILTER (o_orderkey % 2 = 0) AS a, sum(o_totalprice) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1)")
def compute_difference(spark, d):
    role = F.when(F.col("o_orderkey") % 2 == 0, "minuend").otherwise("subtrahend")
    rows = src.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("value"), role.alias("role"), F.lit("usd").alias("unit"))
    return Q.difference(rows, ["k"])


@query("""SELECT l_orderkey, l_linenumber, date_diff('day', a, b) AS days, date_diff('day', a, b) // 7 AS weeks, 12 * (year(b) - year(a)) + month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END AS months
    FROM (SELECT l_orderkey, l_linenumber, least(cast(l_shipdate AS DATE), cast(o_orderdate AS DATE)) AS a, greatest(cast(l_shipdate AS DATE), cast(o_orderdate AS DATE)) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")
def compute_date_interval(spark, d):
    rows = src.table(spark, d, "lineitem").join(src.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = F.to_date("l_shipdate"), F.to_date("o_orderdate")
    return rows.select("l_orderkey", "l_linenumber", *(Q.date_interval(a, b, u).cast("long").alias(f"{u}s") for u in ("day", "week", "month")))


@query("SELECT o_custkey, o_orderkey, cast(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INT) AS place FROM orders")
def compute_order(spark, d):
    return Q.order_events(src.table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN cast(o_orderdate AS DATE) WHEN 1 THEN DATE '2024-03-30' WHEN 2 THEN DATE '2024-03-17' WHEN 3 THEN DATE '2024-02-29' END AS day, CASE o_orderkey % 5 WHEN 0 THEN 'explicit' WHEN 1 THEN 'relative' WHEN 2 THEN 'relative' WHEN 3 THEN 'relative' ELSE 'several_dates' END AS basis FROM orders")
def occurrence_times(spark, d):
    k, day = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k == 0, F.concat(F.lit("on "), day, F.lit(" it came"))).when(k == 1, "it came Yesterday").when(k == 2, "2 weeks ago it came").when(k == 3, "a letter of 1 month ago").otherwise("between 2024-01-01 and 2024-01-02")
    r = Q.occurrence_day(F.col("t"), F.lit("2024-03-31").cast("date"))
    return src.table(spark, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", r["day"].alias("day"), r["basis"].alias("basis"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'quote_mismatch' WHEN 2 THEN 'bad_span' ELSE 'missing_source' END AS problem FROM part")
def grounded_operands(spark, d):
    k = F.col("p_partkey") % 4
    p = src.table(spark, d, "part").select("p_partkey", k.alias("k"), F.concat(F.lit("it took "), "p_size", F.lit(" days")).alias("content"), "p_size")
    m = p.filter("k < 3").select(F.col("p_partkey").alias("store_id"), "content")
    ops = p.select("p_partkey", F.col("p_partkey").alias("store_id"), F.lit(8).alias("span_start"), F.when(F.col("k") == 2, 999).otherwise(F.length("content")).alias("span_end"), F.when(F.col("k") == 1, "no").otherwise(F.substring("content", 9, 100)).alias("quote"), F.col("p_size").cast("string").alias("value"), F.lit("Days").alias("unit"))
    return Q.ground(ops, m).select("p_partkey", "problem")


@query("SELECT p_partkey, list_transform(regexp_extract_all(p_name || ' 12 and 3.5 or seven', '-?[0-9]+(?:\\.[0-9]+)?'), lambda x: cast(x AS DOUBLE)) || [7.0::DOUBLE] AS numbers FROM part")
def stated_numbers(spark, d):
    return src.table(spark, d, "part").select("p_partkey", Q.numbers_in(F.concat("p_name", F.lit(" 12 and 3.5 or seven"))).alias("numbers"))


# --- trajectories and lifecycle --------------------------------------------


def _states(spark, d):
    return src.rollup_events(spark, d).select("user_id", "event_id", "ts", "event_type", "value")


@query("SELECT user_id, before, event_id AS after FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL")
def transitions(spark, d):
    return trajectory.transitions(_states(spark, d), "user_id", ["ts", "event_id"], "event_id")


@query("SELECT user_id, event_id, before, after FROM (SELECT user_id, event_id, event_type, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'error'")
def adjacent_states(spark, d):
    s = _states(spark, d)
    return trajectory.adjacent(s, s.filter("event_type = 'error'"), "user_id", ["ts", "event_id"], "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 5")
def per_trajectory_cap(spark, d):
    return fusion.per_group_cap(_states(spark, d), "user_id", [F.desc("value"), F.col("event_id")], 5, "event_id").select("user_id", "event_id")


@query("WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, event_id FROM p WHERE m <= 16 OR list_contains(list_transform(range(16), lambda j: cast(round_even(j * (m - 1) / 15.0, 0) AS BIGINT)), i)")
def even_sample(spark, d):
    return fusion.even_sample(_states(spark, d), "user_id", [F.col("ts"), F.col("event_id")], 16).select("user_id", "event_id")


@query("SELECT user_id, count(*) AS n_states, sha256(string_agg(cast(event_id AS VARCHAR), ',' ORDER BY ts, event_id)) AS digest FROM events GROUP BY 1")
def trajectory_digest(spark, d):
    return trajectory.digest(_states(spark, d), "user_id", ["ts", "event_id"], "event_id")


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, string_agg(event_type, chr(10) ORDER BY ts, event_id) AS document, count(*) AS n_states FROM p WHERE m <= 64 OR list_contains(list_transform(range(64), lambda j: cast(round_even(j * (m - 1) / 63.0, 0) AS BIGINT)), i) GROUP BY 1")
def trajectory_documents(spark, d):
    return trajectory.documents(_states(spark, d), "user_id", ["ts", "event_id"], "event_type")


def _lifecycle(spark, d):
    e = src.rollup_events(spark, d)
    return e.select(F.col("scope").alias("conversation_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "finalize").otherwise("bind").alias("event"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session_id"), F.col("k").alias("frontier"))


@query(sql("SELECT scope AS conversation_id, arg_max('s' || event_id, ts) FILTER (event_type <> 'error') AS current_session, arg_max('s' || event_id, ts) FILTER (event_type = 'error') AS last_finalized, max(k) AS frontier FROM ev GROUP BY 1", R))
def lifecycle_state(spark, d):
    return trajectory.lifecycle(_lifecycle(spark, d)).select("conversation_id", "current_session", "last_finalized", "frontier")


@query(sql("SELECT scope AS conversation_id, 's' || event_id AS session_id, max(k) OVER (PARTITION BY scope ORDER BY ts, 's' || event_id ROWS UNBOUNDED PRECEDING) AS frontier FROM ev", R))
def monotone_frontier(spark, d):
    return trajectory.frontier(_lifecycle(spark, d)).select("conversation_id", "session_id", "frontier")


@query(sql("SELECT session_id AS view_id FROM (SELECT DISTINCT session_id FROM m) WHERE session_id NOT IN (SELECT session_id FROM m WHERE store_id % 13 = 0)", M))
def fresh_views(spark, d):
    m = src.messages(spark, d)
    changed = F.when(F.col("store_id") % 13 == 0, F.concat("content", F.lit("?"))).otherwise(F.col("content"))
    deps = m.select(F.col("session_id").alias("view_id"), "store_id", F.lit(0).alias("span_start"), F.least(F.length("content"), F.lit(9)).alias("span_end"), F.substring("content", 1, 9).alias("quote"), F.sha2("content", 256).alias("sha256"))
    views = m.select(F.col("session_id").alias("view_id")).distinct().withColumn("expires_at", F.lit(NOW + 1))
    return trajectory.fresh_views(views, deps, m.withColumn("content", changed), NOW).select("view_id")


# --- checks and measures ---------------------------------------------------


@query(sql("SELECT lft AS left, rgt AS right, count(*) AS n, list(k ORDER BY k)[:5] AS samples FROM (SELECT 'a' AS lft, 'b' AS rgt, k FROM sa WHERE k NOT IN (FROM sb) UNION ALL SELECT 'b', 'a', k FROM sb WHERE k NOT IN (FROM sa)) GROUP BY ALL", "sa AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0)", "sb AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 > 0)").replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def fragmentation_sets(spark, d):
    a = src.table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"))
    b = src.table(spark, d, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"))
    return diagnostics.set_differences({"a": a, "b": b}, "k")


@query(sql("""SELECT x.check_ AS "check", x.n, CASE WHEN x.check_ = 'frontier_nodes' THEN 'info' WHEN x.n = 0 THEN 'ok' ELSE 'warn' END AS status FROM (SELECT 'duplicate_ids' AS check_, 0 AS n UNION ALL SELECT 'no_session', 0 UNION ALL SELECT 'no_content', 0 UNION ALL SELECT 'inverted_spans', 0 UNION ALL SELECT 'no_sources', 0
    UNION ALL SELECT 'orphan_nodes', count(DISTINCT parent) FROM e WHERE child_type = 'messages' AND child % 11 = 3 UNION ALL SELECT 'frontier_nodes', count(*) FROM n WHERE depth = 2) x""", M, N))
def doctor(spark, d):
    return diagnostics.doctor(src.messages(spark, d).filter("store_id % 11 <> 3"), src.nodes(spark, d))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return diagnostics.latency(src.table(spark, d, "events"), "value", "event_type")


_HITS = "h AS (SELECT q.row_id AS query_id, v.row_id AS id, row_number() OVER (PARTITION BY q.row_id ORDER BY list_dot_product(v.u, q.u) DESC, v.row_id DESC) AS rank FROM v, v q WHERE q.row_id % 100 = 0 AND NOT v.archived), w AS (SELECT q.row_id AS query_id, v.row_id AS id, count(*) OVER (PARTITION BY q.row_id) AS n FROM v, v q WHERE q.row_id % 100 = 0 AND v.label = q.label)"


def _labelled(spark, d):
    v = src.vectors(spark, d)
    q = v.filter("row_id % 100 = 0").withColumnRenamed("row_id", "query_id")
    from skein.operators import vector

    hits = vector.knn_batch(v, q, 10, 64).select("query_id", F.col("row_id").alias("id"), F.col("place").alias("rank"))
    return hits, (q.select("query_id", F.col("label").alias("class")), v.select(F.col("row_id").alias("id"), F.col("label").alias("class")))


@query(sql("SELECT w.query_id, round(count(h.id) / max(w.n), 6) AS recall FROM w LEFT JOIN h ON h.query_id = w.query_id AND h.id = w.id AND h.rank <= 10 GROUP BY 1", V, _HITS))
def recall_at_k(spark, d):
    return diagnostics.recall_at_k(*_labelled(spark, d), 10)


@query(sql("SELECT w.query_id, round(coalesce(sum(1 / log2(h.rank + 1)), 0) / list_sum(list_transform(range(1, least(10, cast(max(w.n) AS INT)) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM w LEFT JOIN h ON h.query_id = w.query_id AND h.id = w.id AND h.rank <= 10 GROUP BY 1", V, _HITS))
def ndcg_at_k(spark, d):
    return diagnostics.ndcg_at_k(*_labelled(spark, d), 10)


@query("SELECT o_orderpriority AS policy, o_orderstatus AS version, round(100 * (0.7 * avg(o_totalprice / 500000) + 0.3 * avg(o_custkey % 10 / 10)) + 20 * (1 - sum(o_orderkey % 2) / count(*)) - 100 * 0 - 5 * 0, 6) AS score FROM orders GROUP BY ALL")
def policy_scores(spark, d):
    o = src.table(spark, d, "orders")
    return diagnostics.compare_policies(o.select(F.col("o_orderpriority").alias("policy"), F.col("o_orderstatus").alias("version"), (F.col("o_totalprice") / 500000).alias("retrieval"), (F.col("o_custkey") % 10 / 10).alias("active"), (F.col("o_orderkey") % 2).alias("risk"), F.lit(0).alias("failures"), F.lit(0).alias("pressure")))


@query("SELECT p_partkey AS store_id, length(x) AS chars, p_partkey % 10 IN (0, 2, 3) AS data_uri, p_partkey % 10 = 4 AS base64, p_partkey % 10 = 8 AS noise, p_partkey % 10 = 9 AS heartbeat, false AS repetitive FROM (SELECT *, " + _FLAGGED + " AS x FROM part) WHERE p_partkey % 10 IN (0, 2, 3, 4, 8, 9)")
def payload_risks(spark, d):
    m = src.spread(src.table(spark, d, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").alias("store_id"), F.lit("s").alias("session_id"), F.lit("assistant").alias("role"), F.expr(_FLAGGED.replace("\\", "\\\\")).alias("content"))
    return diagnostics.payload_risks(m, None).select("store_id", "chars", "data_uri", "base64", "noise", "heartbeat", "repetitive")


# --- streams ---------------------------------------------------------------


def _checkpoint(spark, name):
    return f"{src.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _drained(spark, d, f, mode):
    return streams.drained(f(streams.stream(spark, f"{d}/events.parquet*")), _checkpoint(spark, "drained"), _checkpoint(spark, "stream"), mode)


@query("SELECT cast(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_day_counts(spark, d):
    return _drained(spark, d, streams.day_counts, "complete").withColumn("total", F.round("total", 6))


@query("WITH s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, g")
def stream_sessions(spark, d):
    return _drained(spark, d, streams.sessions, "complete").select("user_id", "n")


@query("SELECT event_id, user_id FROM events")
def stream_deduplicated(spark, d):
    def twice(e):
        return streams.deduplicated(e.union(e)).select("event_id", "user_id")

    return _drained(spark, d, twice, "append")

"""Queries of structured content, evidence, kept answers, compaction and trajectories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein import tools
from skein.functions import content as C
from skein.operators import compaction, evidence, index, store, trajectory, vector, views
from skein.plans.catalog import _AND, _BIAS, _NODE_HITS, _NODE_ROWS, _Q, NOW, _indexed, _vector, query
from skein.plans.catalog_sql import M, N, V, bm25, estimate, sql
from skein.sources import tables as src

# --- structured content ----------------------------------------------------


@query(sql(f"SELECT doc_id, coalesce(substr(x, 11, k), '') AS content, least(10, length(x)) AS content_offset, CASE WHEN 10 + k < length(x) THEN 10 + k ELSE 0 END AS next_offset, coalesce(10 + k < length(x), false) AS has_more FROM (SELECT doc_id, x, CASE WHEN length(x) > 10 THEN list_max(list_filter(range(1, least(length(x) - 10, 400) + 1), lambda n: {estimate('substr(x, 11, n)')} <= 50)) END AS k FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))"))
def content_slices(spark, d):
    return src.table(spark, d, "documents").select("doc_id", C.content_slice(F.col("text"), 50, 10).alias("s")).select("doc_id", "s.*")


def _orders(spark, d):
    return src.table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"), (F.col("o_orderkey") % 4).cast("int").alias("i"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '{"a":[1,{"c":null,"d":"x"}],"b":' || o_orderkey || '}' WHEN 1 THEN 'plain { text' WHEN 2 THEN '[' || o_orderkey || ',"b"]' ELSE '{"open": ' END AS content FROM orders""")
def canonical_contents(spark, d):
    kinds = [F.concat(F.lit('{"b": '), "k", F.lit(', "a": [1, {"d": "x", "c": null}]}')), F.lit("plain { text"), F.concat(F.lit("[ "), "k", F.lit(', "b" ]')), F.lit('{"open": ')]
    return _orders(spark, d).select("o_orderkey", F.get(F.array(*kinds), "i").alias("x")).select("o_orderkey", C.canonical(F.col("x")).alias("content"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'see ' || o_orderkey || chr(10) || 'and this' WHEN 1 THEN 'one' || chr(10) || 'two' WHEN 2 THEN '[{"type":"image","url":"u"}]' ELSE 'plain ' || o_orderkey END AS content FROM orders""")
def pattern_texts(spark, d):
    kinds = [F.concat(F.lit('[{"type":"text","text":"see '), "k", F.lit('"},{"type":"image","text":"no"},{"type":"input_text","content":"and this"},{"type":"text","text":""}]')), F.lit('["one","two"]'), F.lit('[{"url":"u","type":"image"}]'), F.concat(F.lit("plain "), "k")]
    return _orders(spark, d).select("o_orderkey", F.get(F.array(*kinds), "i").alias("x")).select("o_orderkey", C.pattern_text(F.col("x")).alias("content"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '{"user": "u", "auth": {"Service-API-key": "[redacted: name=api_key; chars=' || length(k) || '; bytes=' || length(k) || '; sha256=' || substr(sha256(k), 1, 16) || ']"}, "password": "[redacted: name=password_assignment; chars=' || (length(k) + 1) || '; bytes=' || (length(k) + 1) || ']"}'
    WHEN 1 THEN '[{"note": "fine", "tokens": "' || k || '"}]' WHEN 2 THEN 'no json "password": ' || k WHEN 3 THEN '{"note": "Bearer [redacted: name=bearer_token; chars=64; bytes=64; sha256=' || substr(sha256(sha256(k)), 1, 16) || ']"}' END AS content FROM (SELECT o_orderkey, cast(o_orderkey AS VARCHAR) AS k FROM orders)""")
def structured_redaction(spark, d):
    kinds = [
        F.concat(F.lit('{"user": "u", "auth": {"Service-API-key": "'), "k", F.lit('"}, "password": "p'), "k", F.lit('"}')), F.concat(F.lit('[{"note": "fine", "tokens": "'), "k", F.lit('"}]')),
        F.concat(F.lit('no json "password": '), "k"), F.concat(F.lit('{"note": "Bearer '), F.sha2("k", 256), F.lit('"}')),
    ]
    return _orders(spark, d).select("o_orderkey", F.get(F.array(*kinds), "i").alias("x")).select("o_orderkey", C.redact_structured(F.col("x")).alias("content"))


_HELD = "(SELECT o_orderkey, 'data:image/png;base64,' || repeat(sha256('' || o_orderkey), 5) AS uri, repeat('Zz09+/ab' || substr(sha256('' || o_orderkey), 1, 8), 300) AS run FROM orders)"


@query(f"SELECT o_orderkey, 'a [Externalized payload: kind=embedded; chars=' || length(uri) || '; ref=' || sha256(uri) || '] b [Externalized payload: kind=embedded; chars=' || length(run) || '; ref=' || sha256(run) || '] c ' || repeat('ab', 2100) AS content, 2 AS n FROM {_HELD}")
def embedded_payloads(spark, d):
    o = src.spread(src.table(spark, d, "orders").select("o_orderkey")).select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"))
    x = F.concat(F.lit("a data:image/png;base64,"), F.repeat("h", 5), F.lit(" b "), F.repeat(F.concat(F.lit("Zz09+/ab"), F.substring("h", 1, 8)), 300), F.lit(" c "), F.repeat(F.lit("ab"), 2100))
    return o.select("o_orderkey", C.payloads_apart(x).alias("p")).select("o_orderkey", "p.content", F.size("p.payloads").alias("n"))


@query("SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS hours, p_partkey % 5 = 4 AS dollars FROM part")
def units_in_quotes(spark, d):
    n = F.col("p_size").cast("string")
    said = [F.concat(F.lit("it took "), n, F.lit(" Hrs, or 900000 days")), F.concat(F.lit("hours: "), n), F.concat(n, F.lit(" days and 900000 hours")), F.concat(F.lit("so it was "), n, F.lit(".0 hours")), F.concat(F.lit("paid $"), n)]
    rows = src.table(spark, d, "part").select("p_partkey", F.get(F.array(*said), (F.col("p_partkey") % 5).cast("int")).alias("q"), F.col("p_size").cast("double").alias("v"))
    return rows.select("p_partkey", C.value_has_unit(F.col("q"), F.col("v"), "hour").alias("hours"), C.value_has_unit(F.col("q"), F.col("v"), "usd").alias("dollars"))


@query("SELECT o_orderkey, o_orderkey % 4 < 3 AS said FROM orders")
def days_in_quotes(spark, d):
    day = F.to_date("o_orderdate")
    said = [F.concat(F.lit("on "), F.date_format(day, "yyyy/M/d")), F.concat(F.lit("it was "), F.date_format(day, "MMMM d"), F.lit("th, "), F.date_format(day, "yyyy")), F.concat(F.date_format(day, "MMM dd yyyy"), F.lit(" and 1999-99-99")), F.concat(F.lit("on "), F.date_format(F.date_add(day, 1), "yyyy-MM-dd"))]
    rows = src.table(spark, d, "orders").select("o_orderkey", day.alias("day"), F.get(F.array(*said), (F.col("o_orderkey") % 4).cast("int")).alias("q"))
    return rows.select("o_orderkey", C.quote_supports_day(F.col("q"), F.col("day")).alias("said"))


@query("SELECT doc_id, cast(list_reduce(list_transform(range(1, 17), lambda i: cast(instr('0123456789abcdef', substr(h, i, 1)) - 1 AS HUGEINT) % CASE WHEN i = 1 THEN 8 ELSE 16 END), lambda a, x: a * 16 + x) AS BIGINT) AS id FROM (SELECT doc_id, sha256('doc' || doc_id) AS h FROM documents)")
def stable_ids(spark, d):
    return src.table(spark, d, "documents").select("doc_id", C.stable_id(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("id"))


# --- evidence --------------------------------------------------------------


def _candidates(spark, d):
    """Of every message three references: a narrowed one, one that ends too late or is wrongly quoted, one of a row that is not there."""
    m = src.messages(spark, d).filter("length(content) >= 40")
    k = F.col("store_id") % 3
    span = m.select(F.col("conversation_id").alias("question"), (F.col("store_id") * 3).alias("place"), "store_id", F.lit(5).alias("span_start"), F.lit(25).alias("span_end"), F.when(k == 0, F.substring("content", 9, 12)).otherwise(F.lit(None).cast("string")).alias("quote"))
    late = m.select(F.col("conversation_id").alias("question"), (F.col("store_id") * 3 + 1).alias("place"), "store_id", F.lit(0).alias("span_start"), F.when(k == 1, F.length("content") + 1).otherwise(F.lit(30)).alias("span_end"), F.when(k == 1, F.lit(None).cast("string")).otherwise("\u0001").alias("quote"))
    none = m.select(F.col("conversation_id").alias("question"), (F.col("store_id") * 3 + 2).alias("place"), (-F.col("store_id") - 1).alias("store_id"), F.lit(0).alias("span_start"), F.lit(5).alias("span_end"), F.lit(None).cast("string").alias("quote"))
    return span.unionByName(late).unionByName(none)


_CAND = """c AS (SELECT conversation_id AS question, store_id, session_id, content, store_id % 3 AS k FROM m WHERE length(content) >= 40),
a AS (SELECT question, store_id * 3 AS place, store_id, session_id, CASE WHEN k = 0 THEN substr(content, 9, 12) ELSE substr(content, 6, 20) END AS quote, CASE WHEN k <> 0 THEN 5 ELSE 4 + instr(substr(content, 6, 20), substr(content, 9, 12)) END AS span_start,
    CASE WHEN k = 0 AND instr(substr(substr(content, 6, 20), instr(substr(content, 6, 20), substr(content, 9, 12)) + 1), substr(content, 9, 12)) > 0 THEN 'quote_ambiguous' END AS problem FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY question, session_id ORDER BY place) AS n FROM a WHERE problem IS NULL),
b2 AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY place) AS i, sum(length(quote)) OVER (PARTITION BY question ORDER BY place) AS u FROM b WHERE n <= 2)"""


@query(sql("SELECT question, place, span_start, quote, CASE WHEN i > 5 THEN 'items_full' WHEN u > 90 THEN 'chars_full' END AS problem FROM b2 UNION ALL SELECT question, place, span_start, quote, 'session_full' FROM b WHERE n > 2", M, _CAND))
def evidence_pack(spark, d):
    p = evidence.pack(_candidates(spark, d), src.messages(spark, d), "question", "place", per_session=2, max_items=5, max_chars=90)
    return p.filter("problem is null or problem in ('session_full', 'items_full', 'chars_full')").select("question", "place", "span_start", "quote", "problem")


@query(sql("SELECT problem, count(*) AS n FROM (SELECT CASE WHEN k = 1 THEN 'span_out_of_bounds' ELSE 'quote_not_in_span' END AS problem FROM c UNION ALL SELECT 'missing_source' FROM c UNION ALL SELECT problem FROM a WHERE problem IS NOT NULL) GROUP BY 1", M, _CAND))
def evidence_problems(spark, d):
    return evidence.resolved(_candidates(spark, d), src.messages(spark, d)).filter("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT question, count(*) FILTER (i <= 5 AND u <= 90) AS grounded, (SELECT count(*) FROM c WHERE c.question = b2.question) * 2 + (SELECT count(*) FROM a WHERE problem IS NOT NULL AND a.question = b2.question) AS rejected, 'partial' AS state, 'operand_grounding_incomplete' AS reason FROM b2 GROUP BY question", M, _CAND))
def evidence_completeness(spark, d):
    p = evidence.pack(_candidates(spark, d), src.messages(spark, d), "question", "place", per_session=2, max_items=5, max_chars=90)
    return evidence.completeness(p, "question", exact=2)


@query("""SELECT p_partkey, v.value, v.unit, v.clause, v.a + 100 AS value_start, v.z + 100 AS value_end FROM (SELECT p_partkey, cast(p_size AS VARCHAR) AS n, p_size FROM part), LATERAL (VALUES
    (cast(p_size AS DOUBLE), 'dollar', 'I paid $' || n, 8, 8 + length(n)), (1200.5::DOUBLE, 'mile', 'ran 1,200.5 miles', 13 + length(n) + 4, 13 + length(n) + 17), (3.0::DOUBLE, 'apple', 'ate three apples', 36 + length(n), 36 + length(n) + 12)) v(value, unit, clause, a, z)""")
def numeric_candidates(spark, d):
    text = F.concat(F.lit("I paid $"), F.col("p_size").cast("string"), F.lit(" and ran 1,200.5 miles, ate three apples. Was it 7 days?"))
    rows = src.spread(src.table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", text.alias("quote"), F.lit(100).alias("span_start"))
    return evidence.numeric_candidates(rows).select("p_partkey", "value", "unit", "clause", "value_start", "value_end")


@query(sql("SELECT store_id, cast(list_contains(w, 'that') AS INT) + cast(list_contains(w, 'for') AS INT) + CASE WHEN list_contains(w, 'of') AND list_contains(w, 'the') THEN 4 ELSE 0 END AS score FROM (SELECT store_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM m)", M))
def anchor_scores(spark, d):
    score = evidence.anchor_score(F.col("content"), F.array(F.lit("that"), F.lit("for")), F.lit("Of the"))
    return src.messages(spark, d).select("store_id", score.alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'occurred_at' ELSE 'session_day' END AS basis FROM (SELECT o_orderkey, cast(o_orderdate AS DATE) AS day FROM orders) WHERE day <= DATE '1996-06-30' AND CASE WHEN o_orderkey % 2 = 0 THEN day - 3 ELSE day END BETWEEN DATE '1996-01-01' AND DATE '1996-05-31'")
def eligible_candidates(spark, d):
    day = F.to_date("o_orderdate")
    rows = src.table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(day.cast("timestamp")).cast("double").alias("observed_at"), F.when(F.col("o_orderkey") % 2 == 0, F.date_sub(day, 3)).alias("event_day"), day.alias("session_day"))
    date = lambda x: F.lit(x).cast("date")
    return evidence.eligible(rows, date("1996-06-30"), (date("1996-01-01"), date("1996-06-01"))).select("o_orderkey", "basis")


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 7) AS n_events, list_sort(list(DISTINCT 'wedding ' || ['anna lee', 'bob', 'cy', 'dee', 'eve', 'flo', 'gus'][1 + o_orderkey % 7])) AS events, count(*) AS n_sources FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1")
def enumerated_events(spark, d):
    names = F.array(*map(F.lit, ["Anna Lee", "Bob", "Cy", "Dee", "Eve", "Flo", "Gus"]))
    who, k = F.get(names, (F.col("o_orderkey") % 7).cast("int")), F.col("o_orderkey") % 3
    said = F.when(k == 1, F.concat(F.lit("It rained. I went to the wedding of "), who, F.lit(" today! A good day."))).when(k == 2, F.concat(F.lit("My friend "), who, F.lit(" had two Weddings"))).otherwise(F.concat(F.lit("Was I at the wedding of "), who, F.lit("? The wedding was near.")))
    said = F.when(k == 2, F.concat(F.lit("At the weddings we saw "), who)).otherwise(said)
    rows = src.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("store_id"), F.lit("user").alias("role"), said.alias("content"))
    return evidence.enumerated(rows.withColumn("content", F.regexp_replace("content", "^At the weddings we saw", "then at weddings we saw")), "wedding", ["weddings?"], ["o_custkey"])


@query(sql("""SELECT question, store_id, score, cast(row_number() OVER (PARTITION BY question ORDER BY score DESC, near DESC, first DESC, store_id) AS INT) AS place FROM
    (SELECT question, store_id, unnest(max(struct_pack(score := score, near := -abs(store_id - anchor), first := -anchor))) FROM (SELECT a.conversation_id AS question, b.store_id, a.store_id AS anchor, a.store_id % 7 AS score FROM p a JOIN p b ON a.session_id = b.session_id AND b.rn BETWEEN a.rn - 1 AND a.rn + 2 WHERE a.store_id % 5 = 1 AND b.store_id % 5 <> 1) GROUP BY question, store_id) QUALIFY place <= 6""", M, "p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY store_id) AS rn FROM m)"))
def adjacent_sources(spark, d):
    m = src.messages(spark, d)
    anchors = m.filter("store_id % 5 = 1").select("store_id", F.col("conversation_id").alias("question"), (F.col("store_id") % 7).alias("score"))
    return evidence.adjacent_sources(m, anchors, 1, 2, 6)


# --- kept answers ----------------------------------------------------------


def _views(spark, d):
    """A view of each customer: ready, under way, lapsed, past its time, or of another corpus."""
    k = F.col("c_custkey") % 5
    return src.table(spark, d, "customer").select(
        views.view_id(F.lit("nation"), F.col("c_custkey")).alias("view_id"), F.when(k == 4, 1).otherwise(2).cast("long").alias("generation"), F.when(k.isin(1, 2), "building").otherwise("ready").alias("status"), F.col("c_name").alias("result"), (F.col("c_custkey") % 3).cast("int").alias("hits"),
        F.lit(NOW - 10).alias("created_at"), F.when(k == 3, NOW - 1).otherwise(NOW + 10).alias("expires_at"), F.when(k == 2, NOW - 1).otherwise(NOW + 10).alias("lease_until"), "c_custkey",
    )


_VIEW = "sha256('nation' || chr(31) || c_custkey)"


@query(f"SELECT {_VIEW} AS view_id FROM customer WHERE c_custkey % 5 >= 2 UNION ALL SELECT sha256('new')")
def view_claims(spark, d):
    wanted = _views(spark, d).select("view_id").unionByName(spark.range(1).select(views.view_id(F.lit("new")).alias("view_id")))
    return views.claim(_views(spark, d).drop("c_custkey"), wanted, 2, NOW).select("view_id")


@query(f"SELECT {_VIEW} AS view_id, CASE WHEN c_custkey % 5 = 1 THEN 'ready' WHEN c_custkey % 5 = 2 THEN 'building' ELSE 'ready' END AS status, CASE WHEN c_custkey % 5 = 1 THEN 'made' ELSE c_name END AS result FROM customer")
def view_publish(spark, d):
    own = _views(spark, d)
    return views.publish(own.drop("c_custkey"), own.select("view_id", F.lit("made").alias("result")), 2, NOW).select("view_id", "status", "result")


@query(f"SELECT {_VIEW} AS view_id, CASE WHEN hit THEN c_name END AS result, hit, hit AND c_custkey % 3 >= 1 AS promoted FROM (SELECT *, c_custkey % 5 = 0 AND c_custkey % 4 > 0 AS hit FROM customer)")
def view_lookup(spark, d):
    own, part = _views(spark, d), src.table(spark, d, "customer").select((F.col("c_custkey") * 1000).alias("store_id"), F.col("c_mktsegment").alias("content"))
    deps = own.join(part, F.col("c_custkey") * 1000 == F.col("store_id")).select("view_id", "store_id", F.lit(0).alias("span_start"), F.lit(3).alias("span_end"), F.substring("content", 1, 3).alias("quote"))
    changed = part.withColumn("content", F.when(F.col("store_id") / 1000 % 4 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return views.lookup(own.drop("c_custkey"), views.dependencies(deps, part), changed, own, 2, NOW)


@query(f"SELECT {_VIEW} AS view_id, c_custkey % 5 IN (2, 3) AS gone FROM customer")
def view_expiry(spark, d):
    kept, gone = views.expire(_views(spark, d).drop("c_custkey"), NOW)
    return kept.select("view_id", F.lit(False).alias("gone")).unionByName(gone.select("view_id", F.lit(True).alias("gone")))


# --- compaction ------------------------------------------------------------


@query(sql("SELECT session_id, list(store_id ORDER BY store_id) AS source_ids, sum(c) AS source_token_count, cast(substr(session_id, 2) AS BIGINT) * 1000 + 600 + segment + 1 AS node_id FROM f GROUP BY session_id, segment", M, "q AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY store_id DESC) AS e FROM m)", "p AS (SELECT session_id, store_id, token_estimate AS c, row_number() OVER (PARTITION BY session_id ORDER BY store_id) AS i FROM q WHERE e > 2)", """f(session_id, i, store_id, c, used, segment) AS (SELECT session_id, i, store_id, c, c, 0 FROM p WHERE i = 1
    UNION ALL SELECT p.session_id, p.i, p.store_id, p.c, CASE WHEN f.used + p.c > 120 THEN p.c ELSE f.used + p.c END, f.segment + CASE WHEN f.used + p.c > 120 THEN 1 ELSE 0 END FROM f JOIN p ON p.session_id = f.session_id AND p.i = f.i + 1)""", recursive=True))
def compaction_leaves(spark, d):
    m = src.messages(spark, d)
    old = src.nodes(spark, d).filter("depth = 2").withColumns({"source_type": F.lit("nodes")})
    return compaction.leaves(m, old, budget=120, tail=2).select("session_id", "source_ids", "source_token_count", "node_id")


@query()
def compaction_sweep(spark, d):
    """Whole conversations compacted: the nodes after leaves and sweeps; tests hold it against plain Python."""
    m = src.messages(spark, d)
    none = src.nodes(spark, d).limit(0)
    nodes, _ = compaction.compact(m, none, leaf_budget=60, tail=1, target=100, fanin=2)
    return nodes.select("session_id", "node_id", "depth", "source_ids", "token_count")


@query(sql("SELECT session_id, 'raw' AS kind, sum(token_estimate) AS size FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY store_id DESC) AS e FROM m) WHERE e > 2 AND store_id % 1000 >= 4 GROUP BY 1", M))
def compaction_debt(spark, d):
    first = src.nodes(spark, d).filter("depth = 0 and node_id % 300 = cast(substring(session_id, 2) as bigint) * 1000 % 300")
    return compaction.debt(src.messages(spark, d), first, 2, NOW).select("session_id", "kind", "size")


@query(sql("SELECT node_id, CASE WHEN depth >= 1 AND cast(substr(session_id, 2) AS INT) % 2 = 0 THEN 'c' || (cast(substr(session_id, 2) AS INT) + 1) ELSE session_id END AS session_id FROM n", M, N))
def carried_over(spark, d):
    n = src.nodes(spark, d)
    number = F.expr("cast(substring(session_id, 2) as int)")
    moves = n.select(F.col("session_id").alias("old"), F.concat(F.lit("c"), (number + 1).cast("string")).alias("new"), (number % 2 == 0).alias("even")).filter("even").distinct()
    return compaction.carried_over(n, moves, 1).select("node_id", "session_id")


@query("""WITH r AS (SELECT 'o' || o_orderkey AS scope, CASE WHEN o_orderkey % 2 = 0 THEN 'day' ELSE 'week' END AS period_kind, cast(o_orderdate AS DATE) AS period_start, ['ready', 'stale', 'failed'][1 + o_orderkey % 3] AS status, o_orderkey FROM orders),
    t AS (SELECT *, CASE WHEN status = 'stale' AND period_kind = 'day' THEN 0 WHEN status = 'failed' AND o_orderkey % 5 > 0 AND period_kind = 'day' THEN 1 WHEN status = 'stale' THEN 2 WHEN status = 'failed' AND o_orderkey % 5 > 0 THEN 3 END AS turn FROM r),
    d AS (SELECT *, CASE WHEN turn IS NULL THEN 999999999 ELSE row_number() OVER (ORDER BY turn NULLS LAST, period_start, scope, period_kind) END <= 200 AS due FROM t)
    SELECT scope, period_kind, period_start, CASE WHEN due THEN CASE WHEN o_orderkey % 4 > 0 THEN 'ready' ELSE 'failed' END ELSE status END AS status, 1 + CASE WHEN due AND o_orderkey % 4 > 0 THEN 1 ELSE 0 END AS generation, CASE WHEN due AND o_orderkey % 4 > 0 THEN 'made' END AS summary FROM d""")
def rollup_maintenance(spark, d):
    k = F.col("o_orderkey")
    r = src.table(spark, d, "orders").select(
        F.concat(F.lit("o"), k.cast("string")).alias("scope"), F.when(k % 2 == 0, "day").otherwise("week").alias("period_kind"), F.to_date("o_orderdate").alias("period_start"), F.get(F.array(F.lit("ready"), F.lit("stale"), F.lit("failed")), (k % 3).cast("int")).alias("status"),
        F.lit(1).alias("generation"), F.when(k % 5 == 0, NOW - 5).otherwise(NOW - 60).alias("failed_at"), k.alias("k"),
    )
    built = r.filter("k % 4 > 0").select("scope", "period_kind", "period_start", F.lit("made").alias("summary"))
    return compaction.maintained(r.drop("k"), built, NOW, builds=200).select("scope", "period_kind", "period_start", "status", "generation", "summary")


# --- trajectories ----------------------------------------------------------


_NEAR = f"sp AS (SELECT conversation_id, row_number() OVER (ORDER BY max(list_dot_product(u, {_Q})) DESC, conversation_id) AS position FROM v JOIN m USING (store_id) GROUP BY conversation_id QUALIFY position <= 8)"
_TRAJ = """ga AS (SELECT store_id, conversation_id, row_number() OVER (ORDER BY rank, conversation_id, store_id) AS a FROM hits QUALIFY a <= 40), gb AS (SELECT store_id, hits.conversation_id, position, row_number() OVER (ORDER BY rank, hits.conversation_id, store_id) AS b FROM hits JOIN sp ON sp.conversation_id = hits.conversation_id QUALIFY b <= 40),
gc AS (SELECT store_id, coalesce(ga.conversation_id, gb.conversation_id) AS g, coalesce(1 / (60.0 + a), 0) + coalesce(1 / (60.0 + b), 0) + coalesce(1 / (60.0 + position), 0) AS score, CASE WHEN b IS NULL THEN 'fts' ELSE 'semantic_fts' END AS kind FROM ga FULL JOIN gb USING (store_id)),
gd AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, store_id) AS n FROM gc), ge AS (SELECT *, row_number() OVER (ORDER BY score DESC, g, store_id) AS r FROM gd WHERE n <= 2 QUALIFY r <= {})"""


def _trajectories(spark, d):
    m = src.messages(spark, d)
    states = m.select(F.col("store_id").alias("state_id"), F.col("conversation_id").alias("trajectory_id"), F.row_number().over(Window.partitionBy("conversation_id").orderBy("store_id")).alias("sequence"))
    v, q = src.vectors(spark, d), F.array(*(F.lit(float(x)) for x in _vector(spark, d)))
    near = v.join(m.select("store_id", "conversation_id"), "store_id").groupBy(F.col("conversation_id").alias("trajectory_id")).agg(F.max(vector.dot(vector.normalized(F.col("embedding"), 64), vector.normalized(q, 64))).alias("s"))
    near = near.orderBy(F.desc("s"), "trajectory_id").limit(8)
    near = near.select("trajectory_id", F.row_number().over(Window.orderBy(F.desc("s"), "trajectory_id")).alias("position"))  # over eight rows
    hits = index.ranked(_indexed(spark, d), spark, ["that", "with"]).select(F.col("id").alias("state_id"), F.round("rank", 12).alias("rank"))
    return states, hits, near


@query(sql("SELECT store_id AS state_id, round(score, 9) AS score, kind FROM ge", M, V, bm25(["that", "with"]).replace("-(", "round(-(", 1).replace(") AS rank", "), 12) AS rank", 1), _NEAR, _TRAJ.format(20)))
def trajectory_hybrid(spark, d):
    rows = trajectory.hybrid(*_trajectories(spark, d), limit=20, candidates=40, per_trajectory=2, include_adjacent=False)
    return rows.select("state_id", F.round("score", 9).alias("score"), "kind")


@query(sql("SELECT count(*) AS n, count(*) FILTER (round_ = 0) AS chosen FROM (SELECT store_id, 0 AS round_ FROM ge UNION ALL (SELECT DISTINCT y.store_id, 1 FROM ge JOIN sq x USING (store_id) JOIN sq y ON y.conversation_id = x.conversation_id AND abs(y.i - x.i) = 1 WHERE y.store_id NOT IN (SELECT store_id FROM ge) LIMIT 4))", M, V, bm25(["that", "with"]).replace("-(", "round(-(", 1).replace(") AS rank", "), 12) AS rank", 1), _NEAR, _TRAJ.format(8), "sq AS (SELECT store_id, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY store_id) AS i FROM m)"))
def trajectory_hybrid_adjacent(spark, d):
    rows = trajectory.hybrid(*_trajectories(spark, d), limit=12, candidates=40, per_trajectory=2)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("round") == 0).alias("chosen"))


# --- sources, sinks and tools ----------------------------------------------


@query("SELECT o_orderkey AS store_id, CASE WHEN o_orderkey % 3 > 0 THEN 'said' END AS content, CASE WHEN o_orderkey % 3 = 0 THEN 'f' || o_orderkey END AS called, CASE WHEN o_orderkey % 3 = 1 THEN 'c' || o_orderkey END AS tool_call_id FROM orders")
def public_messages(spark, d):
    k, i = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    calls = F.concat(F.lit('[{"id":"c'), i, F.lit('","type":"function","function":{"name":"f'), i, F.lit('","arguments":"{}"}}]'))
    m = src.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("store_id"), F.lit("s").alias("session_id"), F.when(k == 0, "assistant").when(k == 1, "tool").otherwise("user").alias("role"), F.when(k > 0, "said").alias("content"),
        F.when(k == 0, calls).when(k == 2, "[broken").alias("tool_calls"), F.concat(F.lit("c"), i).alias("tool_call_id"), F.lit("").alias("tool_name"),
    )
    return store.public(m).select("store_id", "content", F.get("tool_calls", F.lit(0))["function"]["name"].alias("called"), "tool_call_id")


def _results(spark, d):
    return src.table(spark, d, "documents").select(F.col("doc_id").alias("store_id"), F.col("source").alias("session_id"), F.lit("tool").alias("role"), F.col("text").alias("content"))


@query("SELECT sha256(text) AS ref, length(text) AS chars, substr(min(text), 1, 50) AS head FROM documents WHERE length(text) > 8000 GROUP BY ALL")
def sidecar_files(spark, d):
    path = f"{src.shared_dir(spark)}/sidecars-{uuid.uuid4().hex}"
    store.payload_split(_results(spark, d), 8000)[1].write.json(path)
    return src.read_sidecars(spark, path, 50).select("ref", "chars", F.col("content").alias("head"))


@query("SELECT sha256(text) AS ref FROM documents WHERE length(text) > 8000 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE length(text) > 8000 AND doc_id % 2 = 0) GROUP BY ALL")
def sidecar_backfill(spark, d):
    r = _results(spark, d)
    return store.backfill(r, store.payload_split(r.filter("store_id % 2 = 0"), 8000)[1], 8000).select("ref")


@query(sql("SELECT (SELECT count(*) FROM m) AS messages, (SELECT count(DISTINCT session_id) FROM m) AS sessions, (SELECT sum(token_estimate) FROM m) AS message_tokens, (SELECT max(store_id) FROM m) AS max_store_id, count(*) AS nodes, max(depth) AS max_depth, sum(token_count) AS node_tokens, sum(source_token_count) AS source_tokens, round(sum(source_token_count) / sum(token_count), 6) AS compression FROM n", M, N))
def store_status(spark, d):
    return tools.counters(src.messages(spark, d), src.nodes(spark, d))


@query("SELECT source AS session_id, count(DISTINCT r) AS n_refs, count(DISTINCT r) FILTER (r % 3 = 1) AS n_missing, coalesce(sum(chars) FILTER (r % 3 <> 1), 0) AS chars FROM (SELECT source, doc_id AS r, length(text) AS chars FROM documents) GROUP BY 1")
def reference_inventory(spark, d):
    docs = src.table(spark, d, "documents")
    ref = F.concat(F.lit("r"), F.col("doc_id").cast("string"))
    m = docs.select(F.col("source").alias("session_id"), F.concat(F.lit("see [Externalized payload: kind=x; ref="), ref, F.lit("] there")).alias("content"))
    return tools.reference_inventory(m, docs.filter("doc_id % 3 <> 1").select(ref.alias("ref"), F.coalesce("text", F.lit("")).alias("content")))


@query(sql(f"""SELECT kind, id, place, store_id FROM (SELECT *, sum(token_estimate) OVER (ORDER BY place, store_id) AS used FROM (SELECT store_id, min(place) AS place, arg_min(kind, place) AS kind, arg_min(id, place) AS id FROM
    (SELECT kind, id, place, id AS store_id FROM g WHERE kind = 'message' UNION ALL SELECT kind, id, place, child FROM g JOIN e ON e.parent = id AND child_type = 'messages' WHERE kind = 'summary') GROUP BY store_id) JOIN m USING (store_id)) WHERE used <= 600""", M, N, _NODE_ROWS, bm25(["that", "for"], _AND), _NODE_HITS, f"""g AS (SELECT kind, id, cast(row_number() OVER (ORDER BY rank, kind, id) AS INT) AS place FROM (SELECT 'message' AS kind, store_id AS id, round(rank, 9) AS rank, timestamp AS t, role FROM hits UNION ALL
    SELECT 'summary', store_id, round(rank, 9), timestamp, NULL FROM nhits ORDER BY rank, {_BIAS}, t DESC, id DESC, kind LIMIT 8))"""))
def expand_query(spark, d):
    engine = tools.Engine(spark, src.messages(spark, d), src.nodes(spark, d), now=NOW)
    return tools.expansion(engine, "that for", 8, 600).select("kind", "id", "place", "store_id")

"""Every operator as a query over the shipped tables, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import assertions as A
from skein.operators import chunk as C
from skein.operators import compute as Q
from skein.operators import dag, diagnostics, fusion, grep, index, lexical, rollup, store, trajectory, vector
from skein.plans import catalog_sql as S
from skein.plans.catalog_sql import M, N, R, V, sql
from skein.sources import tables as src

NOW = 1706745600.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


# --- scans, sources, sinks -------------------------------------------------


@query(sql("SELECT store_id, session_id, role, content FROM m WHERE store_id = 5001", M))
def point_lookup(spark, d):
    return store.get(src.messages(spark, d), 5001).select("store_id", "session_id", "role", "content")


@query(sql("SELECT store_id, session_id, role FROM m WHERE store_id IN (SELECT l_orderkey * 1000 FROM lineitem)", M))
def batch_lookup(spark, d):
    ids = src.table(spark, d, "lineitem").select((F.col("l_orderkey") * 1000).alias("store_id"))
    return store.get_batch(src.messages(spark, d), ids).select("store_id", "session_id", "role")


@query(sql("SELECT store_id, role FROM m WHERE session_id = 'c7' AND store_id BETWEEN 7001 AND 7004 AND conversation_id = 'g1' ORDER BY store_id LIMIT 3", M))
def range_scan(spark, d):
    return store.get_range(src.messages(spark, d), "c7", 7001, 7004, 3, "g1").select("store_id", "role")


@query(sql("SELECT store_id, role, token_estimate, (SELECT count(*) FROM m WHERE session_id = 'c3' AND role IN ('user', 'assistant') AND timestamp >= 1704078000 AND timestamp <= 1704078600 AND store_id > 3000) > 3 AS has_more FROM m WHERE session_id = 'c3' AND role IN ('user', 'assistant') AND timestamp >= 1704078000 AND timestamp <= 1704078600 AND store_id > 3000 ORDER BY store_id LIMIT 3", M))
def session_page(spark, d):
    rows = store.session_page(src.messages(spark, d), "c3", after=3000, limit=3, roles=["user", "assistant"], time_from=1704078000.0, time_to=1704078600.0)
    return rows.select("store_id", "role", "token_estimate", "has_more")


@query(sql("SELECT session_id, count(*) AS n, coalesce(sum(token_estimate), 0) AS tokens FROM m WHERE role IN ('user') GROUP BY session_id", M))
def session_counts(spark, d):
    return src.messages(spark, d).filter(store.page_filter(roles=["user"])).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"))


@query(sql("SELECT a.store_id AS anchor_id, b.store_id, b.role FROM p a JOIN p b ON a.session_id = b.session_id AND b.rn BETWEEN a.rn - 2 AND a.rn + 1 WHERE a.store_id % 5 = 1", M, "p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY store_id) AS rn FROM m)"))
def anchor_window(spark, d):
    m = src.messages(spark, d)
    return store.anchor_windows(m, m.filter("store_id % 5 = 1"), 2, 1).select("anchor_id", "store_id", "role")


@query(sql("SELECT session_id, store_id, role, cast(row_number() OVER (PARTITION BY session_id ORDER BY store_id DESC) AS INT) AS from_end FROM m QUALIFY from_end <= 3", M))
def session_tail(spark, d):
    return store.tail(src.messages(spark, d), 3).select("session_id", "store_id", "role", "from_end")


@query(sql("SELECT store_id, (SELECT count(*) FROM m) AS total, (SELECT max(store_id) FROM m) AS max_store_id, (SELECT count(*) FROM m) AS unobserved, (SELECT count(*) FROM m) > 50 AS truncated FROM m ORDER BY store_id LIMIT 50", M))
def snapshot_scan(spark, d):
    return store.snapshot(src.messages(spark, d), 50).select("store_id", "total", "max_store_id", "unobserved", "truncated")


@query(sql("SELECT session_id, count(*) AS total, count(*) FILTER (source IS NOT NULL) AS attributed, 0 AS unknown, count(*) FILTER (source IS NULL) AS blank FROM m GROUP BY session_id", M))
def source_stats(spark, d):
    return store.source_stats(src.messages(spark, d))


_CLEAN = "a AS (SELECT session_id, count(*) AS n_messages, sum(token_estimate) AS message_tokens, min(timestamp) AS m0, max(timestamp) AS m1 FROM m GROUP BY 1), b AS (SELECT session_id, count(*) AS n_nodes, sum(token_count) AS node_tokens, min(coalesce(earliest_at, created_at)) AS n0, max(coalesce(latest_at, created_at)) AS n1 FROM n GROUP BY 1)"


@query(sql("SELECT session_id, coalesce(n_messages, 0) AS n_messages, coalesce(message_tokens, 0) AS message_tokens, coalesce(n_nodes, 0) AS n_nodes, coalesce(node_tokens, 0) AS node_tokens FROM a FULL JOIN b USING (session_id)", M, N, _CLEAN))
def cleanup_scan(spark, d):
    return store.cleanup_stats(src.messages(spark, d), src.nodes(spark, d))


@query(sql(f"SELECT session_id, coalesce(n_messages, 0) AS n_messages, coalesce(n_nodes, 0) AS n_nodes, coalesce(message_tokens, 0) + coalesce(node_tokens, 0) AS footprint, least(m0, n0) AS first_at, greatest(m1, n1) AS last_at, cast(floor(({NOW} - greatest(m1, n1)) / 86400) AS INT) AS age_days, CASE WHEN floor(({NOW} - greatest(m1, n1)) / 86400) >= 90 THEN '90d' WHEN floor(({NOW} - greatest(m1, n1)) / 86400) >= 30 THEN '30d' ELSE 'fresh' END AS bucket FROM a FULL JOIN b USING (session_id)", M, N, _CLEAN))
def retention_scan(spark, d):
    return store.retention_stats(src.messages(spark, d), src.nodes(spark, d), NOW)


@query(sql("SELECT session_id, n_messages, CASE WHEN session_id = 'c1' THEN 'protected' WHEN regexp_matches(session_id, '^c1[^:]*$') THEN 'ignored' WHEN n_messages = 0 THEN 'empty' ELSE 'kept' END AS class FROM a LEFT JOIN b USING (session_id)", M, N, _CLEAN))
def cleanup_candidates(spark, d):
    return diagnostics.cleanup_candidates(store.cleanup_stats(src.messages(spark, d), src.nodes(spark, d)), ["c1*"], ["c1"]).select("session_id", "n_messages", "class")


@query(sql("SELECT min(timestamp) AS first_at, max(timestamp) AS last_at FROM m WHERE store_id IN (SELECT o_orderkey * 1000 + 1 FROM orders)", M))
def time_bounds(spark, d):
    return store.time_bounds(src.messages(spark, d), src.table(spark, d, "orders").select((F.col("o_orderkey") * 1000 + 1).alias("store_id")))


@query(sql("SELECT session_id, role, (SELECT max(store_id) FROM m) + row_number() OVER (ORDER BY timestamp, session_id, role) AS store_id FROM m WHERE role = 'user'", M))
def append_messages(spark, d):
    m = src.messages(spark, d)
    return store.append(m, m.filter("role = 'user'").drop("store_id")).select("session_id", "role", "store_id")


@query(sql("SELECT CASE WHEN session_id = 'c2' THEN 'c1' ELSE session_id END AS session_id, count(*) AS n FROM m WHERE session_id NOT IN ('c4', 'c9') GROUP BY 1", M))
def rekey_and_delete_sessions(spark, d):
    m = store.reassign(src.messages(spark, d), "c2", "c1")
    return store.delete_sessions(m, spark.createDataFrame([("c4",), ("c9",)], "session_id string")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT store_id, CASE WHEN role = 'system' AND store_id % 2000 = 0 THEN '[gone]' ELSE content END AS content, CASE WHEN role = 'system' AND store_id % 2000 = 0 THEN 6 ELSE token_estimate END AS token_estimate FROM m", M))
def tombstone_rewrite(spark, d):
    m = src.messages(spark, d).withColumn("role", F.when(F.col("role") == "system", "tool").otherwise(F.col("role")))
    return store.tombstone(m, m.filter("store_id % 2000 = 0"), "[gone]").select("store_id", "content", "token_estimate")


@query(sql("SELECT count(*) AS n_rows, count(DISTINCT session_id) AS n_sessions FROM m WHERE source IS NULL", M))
def blank_sources(spark, d):
    return store.blank_sources(src.messages(spark, d))


@query(sql("SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM m GROUP BY 1", M))
def normalized_sources(spark, d):
    return store.normalize_sources(src.messages(spark, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS ref, length(text) AS chars, strlen(text) AS bytes FROM documents WHERE length(text) > 12000 GROUP BY ALL")
def payload_table(spark, d):
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("store_id"), F.col("source").alias("session_id"), F.lit("tool").alias("role"), F.col("text").alias("content"))
    return store.payload_split(docs)[1].select("ref", "chars", "bytes")


@query("SELECT doc_id AS store_id, CASE WHEN length(text) > 12000 THEN '[Externalized payload: kind=message; chars=' || length(text) || '; ref=' || sha256(text) || ']' ELSE text END AS content FROM documents")
def payload_placeholders(spark, d):
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("store_id"), F.col("source").alias("session_id"), F.lit("tool").alias("role"), F.col("text").alias("content"))
    return store.payload_split(docs)[0].select("store_id", "content")


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'present' WHEN doc_id % 3 = 1 THEN 'missing' ELSE 'unreferenced' END AS status, count(*) AS n FROM documents GROUP BY 1")
def payload_integrity(spark, d):
    docs = src.table(spark, d, "documents")
    m = docs.filter("doc_id % 3 < 2").select(F.concat(F.lit("see [Externalized payload: kind=x; ref=r"), F.col("doc_id"), F.lit("] there")).alias("content"))
    return diagnostics.payload_integrity(m, docs.filter("doc_id % 3 <> 1").select(F.concat(F.lit("r"), F.col("doc_id")).alias("ref")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 IN (0, 3) THEN epoch(o_orderdate) END AS observed_at FROM orders")
def observed_times(spark, d):
    o, k = src.table(spark, d, "orders"), F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    value = F.when(k == 0, F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double") / 1e6).otherwise(F.lit(None)).cast("string")
    text = F.when(k == 0, value).when(k == 1, day).when(k == 2, F.lit("soon")).otherwise(F.concat(day, F.lit("+00:00")))
    return o.select(F.col("o_orderkey").alias("id"), text.alias("t")).select("id", T.observed_at(F.col("t")).alias("observed_at"))


@query(sql("SELECT store_id, role FROM m WHERE store_id NOT IN (SELECT store_id FROM m WHERE store_id % 3 = 0) ORDER BY store_id LIMIT 100", M))
def pending_sources(spark, d):
    m = src.messages(spark, d)
    receipts = m.filter("store_id % 3 = 0").select(F.col("store_id").alias("source_store_id"), F.lit("v1").alias("version"), F.lit(None).cast("double").alias("invalidated_at"))
    old = m.filter("store_id % 3 = 1").select(F.col("store_id").alias("source_store_id"), F.lit("v1").alias("version"), F.lit(1.0).alias("invalidated_at"))
    return A.pending_sources(m, receipts.union(old), "v1", 100).select("store_id", "role")


@query(sql("SELECT 4 AS generation, store_id, CASE WHEN store_id % 7 = 0 THEN 'delete' WHEN store_id % 7 = 1 THEN 'insert' ELSE 'update' END AS operation FROM m WHERE store_id % 7 < 3", M))
def corpus_change_log(spark, d):
    m = src.messages(spark, d)
    after = m.filter("store_id % 7 <> 0").withColumn("content", F.when(F.col("store_id") % 7 == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return trajectory.corpus_events(m.filter("store_id % 7 <> 1"), after, 4)


# --- filters ---------------------------------------------------------------


@query(sql("SELECT store_id FROM m WHERE coalesce(source, 'unknown') = 'unknown'", M))
def source_unknown(spark, d):
    return src.messages(spark, d).filter(store.source_is("unknown")).select("store_id")


@query(sql("SELECT session_id, count(*) AS n FROM m WHERE regexp_matches(session_id, '^c[^:]*7$') GROUP BY 1", M))
def session_glob(spark, d):
    from skein.plans.query import session_pattern

    return src.messages(spark, d).filter(F.col("session_id").rlike(session_pattern("c*7"))).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT store_id FROM m WHERE regexp_matches(content, '(?i)\\bof the\\b') OR regexp_matches(content, 'ß')", M))
def message_patterns(spark, d):
    return src.messages(spark, d).filter(F.col("content").rlike(r"(?i)\bof the\b") | F.col("content").rlike("ß")).select("store_id")


@query(sql("SELECT node_id FROM n WHERE earliest_at < 1704100000 AND latest_at >= 1704080000", M, N))
def window_overlap(spark, d):
    return rollup.recent(src.nodes(spark, d), 1704080000.0, 1704100000.0, 1_000_000).select("node_id")


@query(sql("SELECT DISTINCT session_id FROM m WHERE conversation_id = 'g3' INTERSECT SELECT session_id FROM m WHERE source = 'src2' OR source = 'src3'", M))
def scope_sessions(spark, d):
    m = src.messages(spark, d)
    return m.filter("conversation_id = 'g3'").select("session_id").intersect(m.filter(F.col("source").isin("src2", "src3")).select("session_id"))


# --- text functions --------------------------------------------------------


@query(f"SELECT doc_id, {S.estimate('text')} AS tokens FROM documents")
def token_estimates(spark, d):
    return src.table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {S.count_of('text', 'the')} AS n_the, {S.count_of('text', 'tion')} AS n_tion FROM documents")
def occurrence_counts(spark, d):
    return src.table(spark, d, "documents").select("doc_id", T.occurrences(F.col("text"), "The").alias("n_the"), T.occurrences(F.col("text"), "tion").alias("n_tion"))


@query(f"SELECT doc_id, {S.snippet('text', 'under')} AS snippet FROM documents")
def snippets(spark, d):
    return src.table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), ["under"]).alias("snippet"))


_C = {t: S.count_of("content", t) for t in ("the", "und", "que")}


@query(sql(f"SELECT store_id, cast(CASE WHEN length(content) > 0 THEN 5.0 * ({' + '.join(f'least({c}, 1)' for c in _C.values())}) - least({' + '.join(f'greatest({c} - 1, 0)' for c in _C.values())}, 6) ELSE 0 END AS DOUBLE) AS directness FROM m", M))
def directness_scores(spark, d):
    return src.messages(spark, d).select("store_id", F.round(T.message_directness(F.col("content"), F.col("role"), ["the", "und", "que"]), 6).alias("directness"))


_KEPT = "'[redacted: name=' || name || '; chars=' || length(secret) || '; bytes=' || strlen(secret) || CASE WHEN name = 'password_assignment' THEN '' ELSE '; sha256=' || substr(sha256(secret), 1, 16) END || ']'"
#: Documents with a secret of one of five kinds put behind the text: what comes before it, the secret, what comes behind, and its name.
_PLANTED = """pl AS (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 5 WHEN 0 THEN ' api_key = "' WHEN 1 THEN ' Authorization: bearer  ' WHEN 2 THEN ' PWD: ' || chr(39) WHEN 3 THEN ' key ' ELSE ' token: ' END AS head,
    CASE doc_id % 5 WHEN 0 THEN sha256('k' || doc_id) WHEN 1 THEN 't.' || sha256('b' || doc_id) WHEN 2 THEN 'pass é' || doc_id WHEN 3 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || doc_id || chr(10) || '-----END RSA PRIVATE KEY-----' ELSE 'short' END AS secret,
    CASE doc_id % 5 WHEN 0 THEN '" end' WHEN 2 THEN chr(39) || ' end' ELSE ' end' END AS tail, CASE doc_id % 5 WHEN 0 THEN 'api_key' WHEN 1 THEN 'bearer_token' WHEN 2 THEN 'password_assignment' WHEN 3 THEN 'private_key' END AS name FROM documents)"""


def _planted(spark, d):
    k, i = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    sha = lambda x: F.sha2(F.concat(F.lit(x), i), 256)
    kinds = [
        F.concat(F.lit(' api_key = "'), sha("k"), F.lit('" end')), F.concat(F.lit(" Authorization: bearer  t."), sha("b"), F.lit(" end")), F.concat(F.lit(" PWD: 'pass é"), i, F.lit("' end")),
        F.concat(F.lit(" key -----BEGIN RSA PRIVATE KEY-----\n"), i, F.lit("\n-----END RSA PRIVATE KEY----- end")), F.lit(" token: short end"),
    ]
    return src.table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.get(F.array(*kinds), k.cast("int"))).alias("text"))


@query(sql(f"SELECT doc_id, text || head || CASE WHEN name IS NULL THEN secret ELSE {_KEPT} END || tail AS text FROM pl", _PLANTED))
def redacted_texts(spark, d):
    return _planted(spark, d).select("doc_id", T.redact(F.col("text")).alias("text"))


@query(sql("SELECT doc_id, name, length(secret) AS chars, strlen(secret) AS bytes, CASE WHEN name <> 'password_assignment' THEN substr(sha256(secret), 1, 16) END AS sha256 FROM pl WHERE name IS NOT NULL", _PLANTED))
def secret_digests(spark, d):
    found = F.flatten(F.array(*(F.transform(T.secret_digests(F.col("text"), n), _named(n)) for n in T.SECRETS)))
    return _planted(spark, d).select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.name", "s.chars", "s.bytes", "s.sha256")


def _named(name):
    return lambda s: F.struct(F.lit(name).alias("name"), s["chars"].alias("chars"), s["bytes"].alias("bytes"), s["sha256"].alias("sha256"))


#: Parts as messages that do and don't carry data: the URI's length, parameters and escaped slashes, what follows it, and bare runs.
_CARRIED = "CASE p_partkey % 8 WHEN 0 THEN 'data:image/png;base64,' || repeat('A', 256) WHEN 1 THEN 'data:image/png;base64,' || repeat('A', 255) WHEN 2 THEN 'DATA:text/plain;charset=utf-8;base64,' || repeat('Ab1+', 80) || '\"' WHEN 3 THEN '{\"u\": \"data:image\\/png;base64,' || repeat('A\\/', 128) || '\"}' WHEN 4 THEN repeat('ABCDefgh0123+/zz', 256) WHEN 5 THEN repeat('0123456789abcdef', 300) WHEN 6 THEN '=' || repeat('ABCDefgh0123+/zz', 255) ELSE p_name END"


@query(f"SELECT p_partkey, p_partkey % 8 IN (0, 2, 3) AS data_uri, p_partkey % 8 = 4 AS base64 FROM (SELECT *, {_CARRIED} AS x FROM part)")
def payload_flags(spark, d):
    x = F.expr(_CARRIED.replace("\\", "\\\\"))
    return src.spread(src.table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", x.alias("x")).select("p_partkey", T.has_data_uri(F.col("x")).alias("data_uri"), T.has_base64(F.col("x")).alias("base64"))


@query("SELECT p_partkey, p_partkey % 10 IN (1, 2, 3, 4, 5) AS noise, p_partkey % 10 IN (6, 7) AS heartbeat FROM part")
def noise_flags(spark, d):
    said = ["ok", "  **ACK** ", "Heartbeat\n ack", "[acknowledged]", "", "`keep  alive`", "Still  working...", "processing!", "done", "still working on lunch"]
    x = F.get(F.array(*map(F.lit, said)), (F.col("p_partkey") % 10).cast("int"))
    return src.table(spark, d, "part").select("p_partkey", T.is_noise(x).alias("noise"), T.is_heartbeat(F.lit("assistant"), x).alias("heartbeat"))


@query("SELECT doc_id, regexp_replace(coalesce(text, ''), '\\n{3,}', chr(10) || chr(10), 'g') || CASE WHEN doc_id % 3 = 0 THEN ' [media] end' ELSE ' data:,plain' END AS text FROM documents")
def stripped_media(spark, d):
    x = F.when(F.col("doc_id") % 3 == 0, " data:image/png;base64,iVBORw0KGgo= end").otherwise(" data:,plain")
    return src.table(spark, d, "documents").select("doc_id", T.strip_media(F.concat(F.coalesce("text", F.lit("")), x)).alias("text"))


#: All documents, and for every tenth a long one made of it: the head said over and over, the head with numbered words between, or one sign.
_LOOPS = """ld AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id - 1, CASE doc_id % 3 WHEN 0 THEN repeat(substr(text, 1, 300) || '. ', 400) WHEN 1 THEN (SELECT string_agg('said so ' || (i % 150) || ' n' || i, ' ' ORDER BY i) FROM range(7000) r(i)) ELSE repeat('=-', 40000) END FROM documents WHERE doc_id % 10 = 0 AND length(text) > 0),
lp AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS p, lower(text) AS t FROM ld WHERE length(text) >= 65536),
lw AS (SELECT doc_id, p, regexp_extract_all(p, '[a-z0-9_]+') AS w, list_filter(list_transform(string_split_regex(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 32) AS g FROM lp),
lr AS (SELECT doc_id, length(p) AS chars, len(w) AS n, len(list_distinct(w)) / greatest(len(w), 1) AS u, len(list_distinct(string_split(p, ''))) AS signs, CASE WHEN len(w) = 0 THEN 0 ELSE list_max(map_values(list_histogram(w))) / len(w) END AS top,
    CASE WHEN len(g) < 20 THEN 0 ELSE list_max(map_values(list_histogram(g))) / len(g) END AS seg, CASE WHEN len(g) < 20 THEN 0 ELSE 1 - len(list_distinct(g)) / len(g) END AS dup FROM lw)"""


@query(sql("SELECT doc_id, CASE WHEN (n < 1000 AND chars >= 65536 AND signs <= 12) OR (n >= 1000 AND ((u <= 0.03 AND (seg >= 0.1 OR dup >= 0.5 OR top >= 0.08)) OR (u <= 0.015 AND signs <= 64))) THEN 'high_repetition' END AS reason FROM ld LEFT JOIN lr USING (doc_id)", _LOOPS))
def quarantine_reasons(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", "text")
    k, numbered = F.col("doc_id") % 3, " ".join(f"said so {i % 150} n{i}" for i in range(7000))
    heads = src.spread(docs.filter((F.col("doc_id") % 10 == 0) & (F.length("text") > 0)).select("doc_id", F.substring("text", 1, 300).alias("head")))  # each makes a long text
    loop = F.when(k == 0, F.repeat(F.concat("head", F.lit(". ")), 400)).when(k == 1, F.lit(numbered)).otherwise(F.repeat(F.lit("=-"), 40000))
    every = docs.unionByName(heads.select((-F.col("doc_id") - 1).alias("doc_id"), loop.alias("text")))
    return every.select("doc_id", T.quarantine_reason(F.col("text")).alias("reason"))


@query(r"SELECT doc_id, CASE WHEN est <= 100 THEN text ELSE substr(text, 1, 195) || chr(10) || '...' || chr(10) || substr(text, length(text) - 194, 195) END AS text FROM (SELECT doc_id, text, " + S.estimate("text") + " AS est FROM documents)")
def truncated_texts(spark, d):
    return src.table(spark, d, "documents").select("doc_id", T.head_tail(F.col("text"), 100).alias("text"))


# --- search ----------------------------------------------------------------

_LIKE = f"({S.count_of('content', 'the')} + {S.count_of('content', 'und')})"
_BIAS = "CASE role WHEN 'user' THEN 0 WHEN 'tool' THEN 2 ELSE 1 END"


@query(sql(f"SELECT store_id, {_LIKE} AS score, {S.snippet('content', 'the').replace('WHEN length(content) > 80', f'WHEN instr(lower(content), {chr(39)}und{chr(39)}) > 0 THEN ' + S.snippet('content', 'und') + ' WHEN length(content) > 80')} AS snippet FROM m WHERE {_LIKE} > 0 ORDER BY -{_LIKE}, {_BIAS}, timestamp DESC, store_id DESC LIMIT 40", M))
def search_like_relevance(spark, d):
    return lexical.substring_search(src.messages(spark, d), ["the", "und"], limit=40).select("store_id", "score", "snippet")


@query(sql(f"SELECT store_id, {_LIKE} AS score FROM m WHERE {_LIKE} > 0 ORDER BY timestamp DESC, {_BIAS}, -{_LIKE}, store_id DESC LIMIT 40", M))
def search_like_recency(spark, d):
    return lexical.substring_search(src.messages(spark, d), ["the", "und"], sort="no such mode", limit=40).select("store_id", "score")


@query(sql("SELECT store_id, round(rank, 6) AS rank FROM hits", M, S.bm25(["that", "with"])))
def bm25_scores(spark, d):
    return lexical.bm25(src.messages(spark, d), "store_id", "content", ["that", "with"]).select(F.col("id").alias("store_id"), F.round("rank", 6).alias("rank"))


_AND = "list_contains(w, 'that') AND list_contains(w, 'for')"


def _indexed(spark, d):
    """The messages' word index: built at the first search over a table, read by all others."""
    return index.current(src.messages(spark, d), "store_id", "content", "messages")


def _node_indexed(spark, d):
    return index.current(src.nodes(spark, d).select("node_id", "summary"), "node_id", "summary", "nodes")


def _ranked(spark, d, query_, sort):
    return index.search(src.messages(spark, d), _indexed(spark, d), query_, sort=sort, limit=30, now=NOW)


@query(sql(f"SELECT store_id, round(round(rank, 9), 6) AS rank FROM hits ORDER BY round(rank, 9), {_BIAS}, timestamp DESC, store_id DESC LIMIT 30", M, S.bm25(["that", "for"], _AND)))
def bm25_search(spark, d):
    return _ranked(spark, d, "that for", "relevance").select("store_id", F.round("rank", 6).alias("rank"))


@query(sql(f"SELECT store_id, round(round(rank, 9) / (1 + ({NOW} - timestamp) / 3600 * 0.001), 6) AS value FROM hits ORDER BY round(rank, 9) / (1 + ({NOW} - timestamp) / 3600 * 0.001), {_BIAS}, timestamp DESC, store_id DESC LIMIT 30", M, S.bm25(["that", "for"], _AND)))
def bm25_hybrid_decay(spark, d):
    return _ranked(spark, d, "that for", "hybrid").select("store_id", F.round(lexical.hybrid_rank(F.col("rank"), F.col("timestamp"), NOW), 6).alias("value"))


@query(sql("SELECT store_id FROM (SELECT store_id, ' ' || array_to_string(" + S.WORDS.format("content") + ", ' ') || ' ' AS t FROM m) WHERE contains(t, ' of the ')", M))
def phrase_search(spark, d):
    return src.messages(spark, d).filter(lexical.phrase_match(F.col("content"), "Of  the")).select("store_id")


@query(sql("SELECT store_id FROM (SELECT store_id, " + S.WORDS.format("content") + " AS w FROM m) WHERE list_has_any(w, ['that', 'und']) AND list_contains(w, 'in') AND NOT list_contains(w, 'for')", M))
def boolean_search(spark, d):
    from skein.plans.query import parse_boolean

    return src.messages(spark, d).filter(lexical.boolean_match(F.col("content"), parse_boolean("that OR und AND in NOT for"))).select("store_id")


@query(sql("SELECT count(*) AS n_postings, count(DISTINCT term) AS n_terms, sum(tf) AS n_words FROM (SELECT store_id, term, count(*) AS tf FROM (SELECT store_id, unnest(" + S.WORDS.format("content") + ") AS term FROM m) GROUP BY ALL)", M))
def postings_index(spark, d):
    p = lexical.postings(src.messages(spark, d), "store_id", "content")
    return p.agg(F.count(F.lit(1)).alias("n_postings"), F.countDistinct("term").alias("n_terms"), F.sum("tf").alias("n_words"))


@query("SELECT page_id AS ref, (length(b) - length(replace(b, chr(10), ''))) + 1 AS line, strlen(b) AS byte FROM (SELECT page_id, substr(html, 1, instr(lower(html), 'article') - 1) AS b, instr(lower(html), 'article') AS p FROM pages) WHERE p > 0 ORDER BY ref LIMIT 50")
def payload_search(spark, d):
    p = src.table(spark, d, "pages").select(F.col("page_id").alias("ref"), F.lit("s").alias("session_id"), F.col("html").alias("content"))
    return lexical.payload_search(p, "ARTICLE", 50).select("ref", "line", "byte")


@query(sql(f"SELECT kind, id, rank FROM (SELECT 'message' AS kind, store_id AS id, timestamp AS t, -{_LIKE} AS rank, role FROM m WHERE {_LIKE} > 0 UNION ALL SELECT 'summary', node_id, coalesce(latest_at, created_at), -{_LIKE.replace('content', 'summary')}, NULL FROM n WHERE {_LIKE.replace('content', 'summary')} > 0) ORDER BY rank, {_BIAS}, t DESC, id DESC, kind LIMIT 40", M, N))
def merged_search(spark, d):
    m = lexical.substring_search(src.messages(spark, d), ["the", "und"], limit=None).withColumn("directness", F.lit(0.0))
    n = src.nodes(spark, d).withColumn("content", F.col("summary")).withColumns({"role": F.lit("assistant"), "timestamp": F.coalesce("latest_at", "created_at"), "store_id": F.col("node_id")})
    n = lexical.substring_search(n, ["the", "und"], limit=None).withColumn("directness", F.lit(0.0))
    return lexical.merge_hits(m, n, None, sort="relevance", limit=40, now=NOW).select("kind", "id", F.col("rank").cast("int").alias("rank"))


@query(sql("SELECT term, count(*) AS n_rows, sum(tf) AS n_words, sum(ps) AS places FROM (SELECT store_id, term, count(*) AS tf, sum(i) AS ps FROM (SELECT store_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM (SELECT store_id, " + S.WORDS.format("content") + " AS w FROM m)) GROUP BY ALL) WHERE term IN ('that', 'for', 'und', 'zzz') GROUP BY 1", M))
def index_postings(spark, d):
    p = _indexed(spark, d).postings(spark, ["That", "for", "und", "zzz"])
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tf").alias("n_words"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)).alias("places"))


@query(sql("SELECT store_id FROM (SELECT store_id, ' ' || array_to_string(w, ' ') || ' ' AS t, w FROM (SELECT store_id, " + S.WORDS.format("content") + " AS w FROM m)) WHERE contains(t, ' of the ') AND list_contains(w, 'of') AND list_contains(w, 'the') AND NOT list_contains(w, 'that')", M))
def index_phrases(spark, d):
    return index.matching(_indexed(spark, d), spark, '"of the" NOT that').select(F.col("id").alias("store_id"))


_NODE_ROWS = "nm AS (SELECT node_id AS store_id, session_id, summary AS content, coalesce(latest_at, created_at) AS timestamp FROM n)"


@query(sql("SELECT store_id AS node_id, round(rank, 6) AS rank FROM hits ORDER BY round(rank, 9), timestamp DESC, store_id DESC LIMIT 30", M, N, _NODE_ROWS, S.bm25(["that", "for"], _AND).replace("FROM m)", "FROM nm)")))
def node_search(spark, d):
    return grep.search_nodes(src.nodes(spark, d), _node_indexed(spark, d), "that for", sort="relevance", limit=30, now=NOW).select("node_id", F.round("rank", 6).alias("rank"))


@query(sql("SELECT count(*) AS n, min(store_id) AS first_, max(store_id) AS last_ FROM nm JOIN (SELECT DISTINCT w.root AS store_id FROM w JOIN e ON e.parent = w.node_id AND e.child_type = 'messages' JOIN m ON m.store_id = e.child WHERE m.source = 'src2') x USING (store_id) WHERE list_contains(" + S.WORDS.format("content") + ", 'the')", M, N, _NODE_ROWS, "w(root, node_id) AS (SELECT node_id, node_id FROM n UNION ALL SELECT w.root, e.child FROM w JOIN e ON e.parent = w.node_id AND e.child_type = 'nodes')", recursive=True))
def node_search_of_source(spark, d):
    found = grep.search_nodes(src.nodes(spark, d), _node_indexed(spark, d), "the", messages=src.messages(spark, d), source=F.col("source") == "src2", limit=2**31 - 1)
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_"), F.max("node_id").alias("last_"))


_NODE_HITS = S.bm25(["that", "for"], _AND).replace("FROM m)", "FROM nm)").replace("tf AS (", "ntf AS (").replace("FROM tf", "FROM ntf").replace(" st AS", " nst AS").replace(", st WHERE", ", nst WHERE").replace("hits AS", "nhits AS").replace("tf.*", "ntf.*")


@query(sql(f"SELECT kind, id, round(rank, 6) AS rank FROM (SELECT 'message' AS kind, store_id AS id, round(rank, 9) AS rank, timestamp AS t, role FROM hits UNION ALL SELECT 'summary', store_id, round(rank, 9), timestamp, NULL FROM nhits) ORDER BY round(rank, 9), {_BIAS}, t DESC, id DESC, kind LIMIT 30", M, N, _NODE_ROWS, S.bm25(["that", "for"], _AND), _NODE_HITS))
def grep_full_text(spark, d):
    hits = grep.full_text(src.messages(spark, d), src.nodes(spark, d), _indexed(spark, d), _node_indexed(spark, d), "that for", sort="relevance", limit=30, now=NOW)
    return hits.select("kind", "id", F.round("rank", 6).alias("rank"))


# --- vectors and fusion ----------------------------------------------------

_Q = "(SELECT u FROM v WHERE row_id = 3)"


def _vector(spark, d, row=3):
    return src.vectors(spark, d).filter(F.col("row_id") == row).select("embedding").first()[0]


@query(sql(f"SELECT row_id, round(list_dot_product(u, {_Q}), 6) AS score FROM v WHERE NOT archived ORDER BY list_dot_product(u, {_Q}) DESC, row_id DESC LIMIT 20", V))
def knn_exact(spark, d):
    return vector.knn(src.vectors(spark, d), _vector(spark, d), 20, bound=None).select("row_id", F.round("score", 6).alias("score"))


@query(sql(f"SELECT row_id, round(list_dot_product(u, {_Q}), 6) AS score FROM (SELECT * FROM v WHERE NOT archived AND timestamp >= 1704100000 AND label < 7 ORDER BY timestamp DESC, row_id DESC LIMIT 100) ORDER BY list_dot_product(u, {_Q}) DESC, row_id DESC LIMIT 20", V))
def knn_filtered(spark, d):
    where = (F.col("timestamp") >= 1704100000) & (F.col("label") < 7)
    return vector.knn(src.vectors(spark, d), _vector(spark, d), 20, where, 100).select("row_id", F.round("score", 6).alias("score"))


@query(sql("SELECT query_id, row_id, place FROM (SELECT q.row_id AS query_id, v.row_id, cast(row_number() OVER (PARTITION BY q.row_id ORDER BY list_dot_product(v.u, q.u) DESC, v.row_id DESC) AS INT) AS place FROM v, v q WHERE q.row_id % 100 = 0 AND NOT v.archived) WHERE place <= 10", V))
def knn_batch(spark, d):
    v = src.vectors(spark, d)
    return vector.knn_batch(v, v.filter("row_id % 100 = 0").withColumnRenamed("row_id", "query_id"), 10, 64).select("query_id", "row_id", "place")


@query(sql(f"SELECT row_id, round(list_dot_product(u, {_Q}), 6) AS score, 'full_approx' AS coverage FROM v WHERE NOT archived ORDER BY list_dot_product(u, {_Q}) DESC, row_id DESC LIMIT 10", V))
def knn_two_stage(spark, d):
    return vector.knn_two_stage(src.vectors(spark, d), _vector(spark, d), 10).withColumn("score", F.round("score", 6))


@query(sql("SELECT row_id, round(list_max(list_transform(u, lambda x: abs(x))) / 127, 9) AS scale, true AS close FROM v", V))
def int8_roundtrip(spark, d):
    v = src.vectors(spark, d).select("row_id", vector.normalized(F.col("embedding"), 64).alias("u")).select("row_id", "u", vector.int8(F.col("u")).alias("q"))
    worst = F.array_max(F.zip_with("u", vector.from_int8(F.col("q")), lambda a, b: F.abs(a - b)))
    return v.select("row_id", F.round("q.scale", 9).alias("scale"), (worst <= F.col("q.scale") / 2 + 1e-12).alias("close"))


@query(sql("SELECT a.row_id, len(list_filter(list_zip(a.u, b.u), lambda x: (x[1] >= 0) <> (x[2] >= 0))) AS distance FROM v a, v b WHERE b.row_id = 3", V))
def sign_distance(spark, d):
    q = F.array(*(F.lit(float(x)) for x in _vector(spark, d)))
    return src.vectors(spark, d).select("row_id", vector.hamming(vector.sign_words(F.col("embedding"), 64), vector.sign_words(q, 64)).alias("distance"))


@query(sql("SELECT node_id FROM n WHERE depth = 0 AND node_id % 3 <> 0 AND node_id % 5 <> 0", M, N))
def embedding_pending(spark, d):
    n = src.nodes(spark, d)
    of = lambda k: n.filter(F.col("node_id") % k == 0).select(F.col("node_id").cast("string").alias("embedded_id"), F.lit("h").alias("identity_hash"))
    return vector.pending(n, of(3), of(5), "h").select("node_id")


_ARMS = f"""f AS (SELECT 'message' AS id_space, store_id AS id, row_number() OVER (ORDER BY round(rank, 9), {_BIAS}, timestamp DESC, store_id DESC) AS rank FROM hits),
k AS (SELECT 'message' AS id_space, store_id AS id, row_number() OVER (ORDER BY list_dot_product(u, {_Q}) DESC, row_id DESC) AS rank FROM v WHERE NOT archived),
s AS (SELECT 'summary' AS id_space, row_id AS id, row_number() OVER (ORDER BY list_dot_product(u, {_Q}) DESC, row_id DESC) AS rank FROM v WHERE NOT archived AND row_id % 4 = 0)"""


def _place(df, id_col, space, *order):
    from pyspark.sql.window import Window

    return df.select(F.lit(space).alias("id_space"), F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))  # over the few rows of a top list


def _arms(spark, d):
    v, q = src.vectors(spark, d), _vector(spark, d)
    f = index.search(src.messages(spark, d), _indexed(spark, d), "that for", sort="relevance", limit=50, now=NOW)
    f = _place(f, "store_id", "message", *lexical.ordering("relevance", NOW))
    k = vector.knn(v, q, 50, bound=None).join(v.select("row_id", "store_id"), "row_id")
    s = vector.knn(v, q, 50, F.col("row_id") % 4 == 0, None)
    return f, _place(k, "store_id", "message", F.desc("score"), F.desc("row_id")), _place(s, "row_id", "summary", F.desc("score"), F.desc("row_id"))


_FUSED = "r AS (SELECT id_space, id, sum(w / (60 + rank)) AS score FROM (SELECT *, 0.5 AS w FROM f WHERE rank <= 50 UNION ALL SELECT *, 1.0 FROM k WHERE rank <= 50{}) GROUP BY ALL)"


@query(sql("SELECT id_space, id, round(score, 9) AS score FROM r", M, V, S.bm25(["that", "for"], _AND), _ARMS, _FUSED.format("")))
def rrf_two_arm(spark, d):
    f, k, _ = _arms(spark, d)
    return fusion.rrf([f, k], [0.5, 1.0]).select("id_space", "id", F.round("score", 9).alias("score"))


@query(sql("SELECT id_space, id, round(score, 9) AS score FROM r", M, V, S.bm25(["that", "for"], _AND), _ARMS, _FUSED.format(" UNION ALL SELECT *, 1.0 FROM s WHERE rank <= 50")))
def rrf_weighted_three_arm(spark, d):
    return fusion.rrf(list(_arms(spark, d)), [0.5, 1.0, float("nan")]).select("id_space", "id", F.round("score", 9).alias("score"))


@query(sql(f"SELECT v.store_id, m.role, round(score, 6) AS score, cast(place AS INT) AS place FROM (SELECT store_id, row_number() OVER (ORDER BY list_dot_product(u, {_Q}) DESC, row_id DESC) AS place, list_dot_product(u, {_Q}) AS score FROM v WHERE NOT archived) v JOIN m USING (store_id) WHERE place <= 15", M, V))
def grep_semantic(spark, d):
    return grep.semantic(src.vectors(spark, d), src.messages(spark, d), _vector(spark, d), 15).select("store_id", "role", F.round("score", 6).alias("score"), "place")


@query(sql("SELECT 'message' AS kind, id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM f WHERE rank <= 60 UNION ALL SELECT id, row_number() OVER (ORDER BY rank) AS rank FROM k JOIN m ON m.store_id = k.id WHERE rank <= 60) GROUP BY id ORDER BY sum(1 / (60 + rank)) DESC, min(rank) LIMIT 20", M, V, S.bm25(["that", "for"], _AND), _ARMS))
def grep_hybrid(spark, d):
    m = src.messages(spark, d)
    hits = grep.grep("hybrid", messages=m, nodes=src.nodes(spark, d), vectors=src.vectors(spark, d), message_index=_indexed(spark, d), node_index=_node_indexed(spark, d), query="that for", embedding=_vector(spark, d), now=NOW)
    return hits.select("kind", "id", F.round("score", 9).alias("score"))


_RECALL = f"x AS (SELECT id AS store_id, m.session_id, round(score * (1 + CASE WHEN m.session_id IN ('c1', 'c2') THEN 0.5 ELSE 0 END) * greatest(0.5, pow(2, -({NOW} - timestamp) / 2592000)), 9) AS score FROM r JOIN m ON r.id = m.store_id)"


def recall(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: words and vectors fused over all sessions, with priors for the current conversation and for what is recent."""
    f, k, _ = _arms(spark, d)
    m = src.messages(spark, d).select(F.col("store_id").alias("id"), "session_id", "timestamp")
    scored = fusion.recall_score(fusion.rrf([f, k], [fusion.WEIGHTS["fts"], fusion.WEIGHTS["chunk"]]).join(m, "id"), ["c1", "c2"], NOW)
    return scored.select(F.col("id").alias("store_id"), "session_id", F.round("score", 9).alias("score"))


@query(sql("SELECT * FROM x ORDER BY score DESC, store_id DESC LIMIT 25", M, V, S.bm25(["that", "for"], _AND), _ARMS, _FUSED.format(""), _RECALL))
def recall_final(spark, d):
    return recall(spark, d).orderBy(F.desc("score"), F.desc("store_id")).limit(25)


@query(sql("SELECT store_id, session_id, score FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, store_id DESC) AS n FROM x) WHERE n <= 1 ORDER BY score DESC, store_id DESC LIMIT 25", M, V, S.bm25(["that", "for"], _AND), _ARMS, _FUSED.format(""), _RECALL))
def diversity_per_session(spark, d):
    capped = fusion.per_group_cap(recall(spark, d), "session_id", [F.desc("score"), F.desc("store_id")], 1, "store_id")
    return capped.orderBy(F.desc("score"), F.desc("store_id")).limit(25)


@query(sql("SELECT 'msg:' || store_id || ':0-' || least(length(content), 100) AS ref FROM m WHERE store_id % 3 > 0", M))
def delta_refs(spark, d):
    m = src.messages(spark, d).select("store_id", fusion.exact_ref(F.col("store_id"), F.lit(0), F.least(F.length("content"), F.lit(100))).alias("ref"))
    return fusion.unseen(m, m.filter("store_id % 3 = 0")).select("ref")


@query("SELECT doc_id, greatest(least((p + p + 6 - 400) // 2, length(text) - 400), 0) AS offset_, substr(text, greatest(least((p + p + 6 - 400) // 2, length(text) - 400), 0) + 1, 400) AS text FROM (SELECT doc_id, text, instr(text, 'tion') - 1 AS p FROM documents) WHERE p > 300")
def content_windows(spark, d):
    docs = src.table(spark, d, "documents").withColumn("at", F.instr("text", "tion") - 1).filter("at > 300")
    return docs.select("doc_id", fusion.content_window(F.col("text"), F.col("at"), F.col("at") + 6, 400).alias("w")).select("doc_id", F.col("w.offset").cast("long").alias("offset_"), "w.text")


@query("SELECT event_id, CASE WHEN value / 100 >= 0.65 THEN 'high' WHEN value / 100 >= 0.5 THEN 'medium' WHEN value / 100 >= 0.35 THEN 'low' ELSE 'noise' END AS band FROM events")
def confidence_bands(spark, d):
    return src.table(spark, d, "events").select("event_id", fusion.confidence(F.col("value") / 100).alias("band"))

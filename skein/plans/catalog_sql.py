"""SQL that derives the same messages, nodes and vectors, for holding results against."""

from __future__ import annotations


def estimate(x: str) -> str:
    ratio = f"((length({x}) - length(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'))) / length({x}))"
    return f"(CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE cast(floor(length({x}) / CASE WHEN {ratio} >= 0.5 THEN 1.5 WHEN {ratio} >= 0.2 THEN 2.5 ELSE 4.0 END) AS INT) + 1 END)"


def count_of(x: str, term: str) -> str:
    return f"cast((length(lower({x})) - length(replace(lower({x}), '{term}', ''))) / {len(term)} AS INT)"


WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
M = f"""m AS (SELECT conv_id * 1000 + turn AS store_id, 'c' || conv_id AS session_id, CASE WHEN conv_id % 7 <> 0 THEN 'src' || (conv_id % 5) END AS source, 'g' || (conv_id // 4) AS conversation_id,
    role, text AS content, cast(1704067200 + conv_id * 3600 + turn * 60 AS DOUBLE) AS timestamp, 4 + {estimate("text")} AS token_estimate FROM conversations)"""


def _level(name: str, rows: str, depth: int, text: str, tokens: str, start: str, end: str, id_col: str, kind: str) -> str:
    group = "n // 4" if depth < 2 else "0"
    return f"""{name} AS (SELECT *, {estimate("summary")} AS token_count, latest_at + 30 AS created_at, cast(substr(session_id, 2) AS BIGINT) * 1000 + {depth} * 300 + g AS node_id, {depth} AS depth, '{kind}' AS source_type, g AS n FROM
    (SELECT session_id, {group} AS g, substr(string_agg(coalesce({text}, ''), ' ' ORDER BY {id_col}), 1, 200) AS summary, cast(sum({tokens}) AS BIGINT) AS source_token_count, list({id_col} ORDER BY {id_col}) AS source_ids, min({start}) AS earliest_at, max({end}) AS latest_at FROM {rows} GROUP BY ALL))"""


_COLUMNS = "node_id, session_id, depth, summary, token_count, source_token_count, source_ids, source_type, created_at, earliest_at, latest_at"
N = ",\n".join([
    "mn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY store_id) - 1 AS n FROM m)",
    _level("leaf", "mn", 0, "content", "token_estimate", "timestamp", "timestamp", "store_id", "messages"), _level("mid", "leaf", 1, "summary", "token_count", "earliest_at", "latest_at", "node_id", "nodes"),
    _level("top", "mid", 2, "summary", "token_count", "earliest_at", "latest_at", "node_id", "nodes"),
    f"n AS (SELECT {_COLUMNS} FROM leaf UNION ALL SELECT {_COLUMNS} FROM mid UNION ALL SELECT {_COLUMNS} FROM top)",
    "e AS (SELECT node_id AS parent, unnest(source_ids) AS child, source_type AS child_type FROM n)",
])
V = """v0 AS (SELECT vec_id AS row_id, (vec_id // 4) * 1000 + vec_id % 4 AS store_id, 'c' || (vec_id // 4) AS session_id, cast(embedding AS DOUBLE[]) AS embedding, label, cast(1704067200 + (vec_id // 4) * 3600 + (vec_id % 4) * 60 AS DOUBLE) AS timestamp, vec_id % 23 = 0 AS archived FROM embeddings),
v AS (SELECT *, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS u FROM v0)"""
R = "ev AS (SELECT event_id, ts, 'u' || user_id AS scope, user_id, event_type, value, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {body}" if ctes else body


def bm25(terms: list[str], where: str = "true") -> str:
    """CTEs `hits`: (store_id, rank) over messages."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""tf AS (SELECT *, len(w) AS dl, {tf} FROM (SELECT *, {WORDS.format("content")} AS w FROM m)), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM tf),
    hits AS (SELECT tf.*, -({part}) AS rank FROM tf, st WHERE ({some}) AND ({where}))"""


def snippet(x: str, term: str) -> str:
    at = f"instr(lower({x}), '{term}')"
    start, end = f"greatest({at} - 41, 0)", f"least({at} - 1 + {len(term)} + 40, length({x}))"
    return f"(CASE WHEN {at} > 0 THEN (CASE WHEN {start} > 0 THEN '...' ELSE '' END) || substr({x}, {start} + 1, {end} - {start}) || (CASE WHEN {end} < length({x}) THEN '...' ELSE '' END) WHEN length({x}) > 80 THEN substr({x}, 1, 80) || '...' ELSE {x} END)"

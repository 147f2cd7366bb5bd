"""Search over messages, summaries and payloads at once: by words, by meaning, or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import dag, fusion, lexical, vector
from skein.operators import index as words
from skein.operators.lexical import NODE_NUDGE
from skein.plans.query import phrases_of, sort_mode, terms_of

MODES = ("full_text", "semantic", "hybrid")


def as_rows(nodes: DataFrame) -> DataFrame:
    """Summary nodes under the names that ranking uses."""
    return nodes.select(F.col("node_id").alias("store_id"), "node_id", "session_id", F.col("summary").alias("content"), F.coalesce("latest_at", "created_at").alias("timestamp"), "latest_at", "created_at")


def search_nodes(nodes: DataFrame, index: words.Index, query: str, *, session_id: str | None = None, messages: DataFrame | None = None, source: Column | None = None, sort: str = "recency", limit: int = 20, now: float = 0.0) -> DataFrame:
    """Summaries that a query finds, of one session or all; with `source`, only those with a message of it anywhere below them."""
    rows = nodes.filter(F.col("session_id") == session_id) if session_id is not None else nodes
    if source is not None:
        rows = rows.join(dag.with_source(nodes, messages, source).select("node_id"), "node_id", "left_semi")
    return words.search(as_rows(rows), index, query, sort=sort, limit=limit, now=now, nudge=NODE_NUDGE)


def full_text(messages: DataFrame, nodes: DataFrame, message_index: words.Index, node_index: words.Index, query: str, *, payloads: DataFrame | None = None, session_id: str | None = None, roles: list[str] | None = None, time_from: float | None = None, time_to: float | None = None, sort: str = "recency", limit: int = 20, now: float = 0.0) -> DataFrame:
    """(kind, id, session_id, at, rank, directness, tier) of messages, summaries and payloads in one order.

    Filters by role or time are of messages only; with one of them there are no
    summaries and no payloads among the hits.
    """
    where = F.lit(True) if session_id is None else F.col("session_id") == session_id
    raw = bool(roles) or time_from is not None or time_to is not None
    own = where & (F.col("role").isin(roles) if roles else F.lit(True))
    own = own & (F.col("timestamp") >= time_from if time_from is not None else F.lit(True)) & (F.col("timestamp") <= time_to if time_to is not None else F.lit(True))
    m = words.search(messages, message_index, query, sort=sort, limit=limit, where=own, now=now)
    m = m if "directness" in m.columns else m.withColumn("directness", F.lit(0.0))
    n = search_nodes(nodes.limit(0) if raw else nodes, node_index, query, session_id=session_id, sort=sort, limit=limit, now=now)
    n = n if "directness" in n.columns else n.withColumn("directness", F.lit(0.0))
    hits = None
    if payloads is not None and not raw and terms_of(query):
        term = (phrases_of(query) or terms_of(query))[0]
        held = payloads.filter(where).filter(F.contains(F.lower("content"), F.lit(term.lower())))
        hits = held.select(F.xxhash64("ref").bitwiseAND(F.lit(2**63 - 1)).alias("store_id"), "session_id", F.lit(0.0).alias("timestamp")).limit(limit)
    return lexical.merge_hits(m, n, hits, sort=sort, limit=limit, now=now)


def semantic(vectors: DataFrame, base: DataFrame, query: list[float], k: int, *, where: Column | None = None, session_id: str | None = None) -> DataFrame:
    """The k nearest rows with what they stand for, in order: neighbours first, then their rows by id, and only those."""
    rows = vectors.filter(F.col("session_id") == session_id) if session_id is not None else vectors
    near = vector.knn(rows, query, k, where, None).join(rows.select("row_id", "store_id"), "row_id")
    return hydrated(near, base, "store_id", [F.desc("score"), F.desc("row_id")])


def hydrated(ranked: DataFrame, base: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of a table by a short ranked list of ids (already cut to its top), each once, with their place in it."""
    placed = ranked.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    best = placed.groupBy(key).agg(F.min("place").alias("place"), F.min_by("score", "place").alias("score"))
    return base.join(best, key).orderBy("place")


def candidate_count(limit: int) -> int:
    """Rows of each arm that fusion looks at."""
    return min(500, max(50, 3 * limit))


def hybrid(messages: DataFrame, index: words.Index, vectors: DataFrame, query: str, embedding: list[float], *, limit: int = 20, now: float = 0.0, session_id: str | None = None) -> DataFrame:
    """(id_space, id, rank_0, rank_1, score): words (arm 0) and meaning (arm 1) fused by reciprocal rank."""
    n = candidate_count(limit)
    where = None if session_id is None else F.col("session_id") == session_id
    place = lambda df, *order: df.select(F.lit("message").alias("id_space"), F.col("store_id").alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))
    f = place(words.search(messages, index, query, sort="relevance", limit=n, where=where, now=now), *lexical.ordering("relevance", now))
    s = place(semantic(vectors, messages.select("store_id"), embedding, n, session_id=session_id), F.col("place"))
    return fusion.rrf([f, s], [1.0, 1.0]).limit(limit)


def grep(mode: str, *, messages: DataFrame, nodes: DataFrame, vectors: DataFrame | None = None, message_index: words.Index, node_index: words.Index, query: str, embedding: list[float] | None = None, sort: str = "recency", limit: int = 20, now: float = 0.0, session_id: str | None = None) -> DataFrame:
    """One of the three modes as (kind, id, score), best first; without vectors or an embedding, every mode is by words."""
    mode = mode if mode in MODES and vectors is not None and embedding else "full_text"
    if mode == "full_text":
        return full_text(messages, nodes, message_index, node_index, query, session_id=session_id, sort=sort_mode(sort), limit=limit, now=now).select("kind", "id", (-F.col("rank")).alias("score"))
    if mode == "semantic":
        return semantic(vectors, messages, embedding, limit, session_id=session_id).select(F.lit("message").alias("kind"), F.col("store_id").alias("id"), "score")
    return hybrid(messages, message_index, vectors, query, embedding, limit=limit, now=now, session_id=session_id).select(F.col("id_space").alias("kind"), "id", "score")

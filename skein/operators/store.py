"""Scans, pages, windows, statistics and updates of the message store."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.sources.tables import shared_dir

UNKNOWN = "unknown"


def source_is(source: str | None, column: str = "source") -> Column:
    """Rows of a source; `unknown` is also what null and blank sources are. Null asks for nothing."""
    if source is None:
        return F.lit(True)
    name = F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.col(column), r"[ \t\n\x0b\f\r]+", " ")), F.lit("")), F.lit(UNKNOWN))
    return name == source.strip() if source.strip() else F.lit(True)


def page_filter(session_id: str | None = None, *, roles: list[str] | None = None, time_from: float | None = None, time_to: float | None = None, source: str | None = None, conversation_id: str | None = None) -> Column:
    """Both times are inclusive; an empty session id is a session like any other, null means all."""
    parts = [F.lit(True)] if session_id is None else [F.col("session_id") == session_id]
    parts += [F.col("role").isin(roles)] if roles else []
    parts += [F.col("timestamp") >= time_from] if time_from is not None else []
    parts += [F.col("timestamp") <= time_to] if time_to is not None else []
    parts += [source_is(source)] if source is not None else []
    parts += [F.col("conversation_id") == conversation_id.strip()] if conversation_id and conversation_id.strip() else []
    return reduce(and_, parts)


def get(messages: DataFrame, store_id: int) -> DataFrame:
    return messages.filter(F.col("store_id") == store_id)


def get_batch(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages of a table of ids; the planner knows the ids' size and picks the join."""
    return messages.join(ids.select("store_id").distinct(), "store_id", "left_semi")


def get_range(messages: DataFrame, session_id: str, start: int, end: int, limit: int, conversation_id: str | None = None) -> DataFrame:
    return messages.filter(page_filter(session_id, conversation_id=conversation_id) & F.col("store_id").between(start, end)).orderBy("store_id").limit(limit)


def session_page(messages: DataFrame, session_id: str, *, after: int = -1, limit: int = 50, **where) -> DataFrame:
    """The next `limit` rows behind an id, and whether more follow (one row more is read to know)."""
    rows = messages.filter(page_filter(session_id, **where) & (F.col("store_id") > after)).orderBy("store_id").limit(limit + 1)
    w = Window.orderBy("store_id")  # over limit + 1 rows
    return rows.withColumns({"n": F.row_number().over(w), "has_more": F.count(F.lit(1)).over(Window.partitionBy()) > limit}).filter(F.col("n") <= limit).drop("n")


def tail(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of every session in order; a descending rank that Spark cuts off before the shuffle."""
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("store_id")))
    return messages.withColumn("from_end", last).filter(F.col("from_end") <= n)


def anchor_windows(messages: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """(anchor_id, and the messages up to `before` ahead of it and `after` behind it in its session); both at most 12.

    Neighbours by place: an equi-join on (session, place), not a range join.
    """
    before, after = max(0, min(12, before)), max(0, min(12, after))
    ids = anchors.select(F.col("store_id").alias("anchor_id")).distinct()
    around = messages.join(ids, F.col("store_id") == F.col("anchor_id"), "left_semi").select("session_id").distinct()
    own = messages.join(around, "session_id", "left_semi")  # only sessions with an anchor are numbered
    placed = own.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("store_id")))
    wanted = placed.join(ids, F.col("store_id") == F.col("anchor_id")).select("anchor_id", "session_id", F.explode(F.sequence(F.col("place") - before, F.col("place") + after)).alias("place"))
    return wanted.join(placed, ["session_id", "place"]).drop("place")


def snapshot(messages: DataFrame, limit: int) -> DataFrame:
    """The first rows with what holds of all: count, greatest id, rows without an observed time, and whether rows are missing."""
    limit = max(1, min(4096, limit))
    seen = F.col("observed_at") if "observed_at" in messages.columns else F.lit(None).cast("double")
    facts = messages.agg(F.count(F.lit(1)).alias("total"), F.max("store_id").alias("max_store_id"), F.count_if(seen.isNull()).alias("unobserved"))
    return messages.orderBy("store_id").limit(limit).crossJoin(F.broadcast(facts)).withColumn("truncated", F.col("total") > limit)  # facts: one row


def source_stats(messages: DataFrame) -> DataFrame:
    blank = F.btrim(F.coalesce("source", F.lit(""))) == ""
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~blank & (F.col("source") != UNKNOWN)).alias("attributed"), F.count_if(F.col("source") == UNKNOWN).alias("unknown"), F.count_if(blank).alias("blank"),
    )


def cleanup_stats(messages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Messages, nodes and tokens of each session that either table knows: one full join of two aggregates."""
    m = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"), F.sum("token_estimate").alias("message_tokens"))
    n = nodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("token_count").alias("node_tokens"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_messages", "message_tokens", "n_nodes", "node_tokens")}
    return m.join(n, "session_id", "full").withColumns(zero)


def retention_stats(messages: DataFrame, nodes: DataFrame, now: float) -> DataFrame:
    """The same with first and last activity, age and the age's bucket (30 and 90 days)."""
    m = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"), F.sum("token_estimate").alias("tokens"), F.min("timestamp").alias("m0"), F.max("timestamp").alias("m1"))
    n = nodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("token_count").alias("node_tokens"), F.min(F.coalesce("earliest_at", "created_at")).alias("n0"), F.max(F.coalesce("latest_at", "created_at")).alias("n1"))
    out = m.join(n, "session_id", "full")
    last = F.greatest("m1", "n1")
    age = F.floor((F.lit(now) - last) / 86400).cast("int")
    return out.select(
        "session_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), (F.coalesce("tokens", F.lit(0)) + F.coalesce("node_tokens", F.lit(0))).alias("footprint"),
        F.least("m0", "n0").alias("first_at"), last.alias("last_at"), age.alias("age_days"), F.when(age >= 90, "90d").when(age >= 30, "30d").otherwise("fresh").alias("bucket"),
    )


def time_bounds(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return get_batch(messages, ids).agg(F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New messages with ids behind the greatest there is, in the order of (timestamp, session, role).

    Ids are dense: rows are range-partitioned, numbered within their part and
    written, so that what is counted and what is numbered is the same; then the
    parts' counts (one row each) are added up.
    """
    spark = existing.sparkSession
    top = existing.agg(F.coalesce(F.max("store_id"), F.lit(0)).alias("top"))
    keys = ["timestamp", "session_id", "role"]
    placed = new.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))})
    path = f"{shared_dir(spark)}/append-{uuid.uuid4().hex}"
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    out = placed.join(F.broadcast(starts), "_part").crossJoin(F.broadcast(top))
    return out.withColumn("store_id", F.col("top") + F.col("_start") + F.col("_i") + 1).drop("_part", "_i", "_start", "top")


def reassign(messages: DataFrame, old: str, new: str) -> DataFrame:
    return messages.withColumn("session_id", F.when(F.col("session_id") == old, new).otherwise(F.col("session_id")))


def delete_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    return rows.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def tombstone(messages: DataFrame, ids: DataFrame, placeholder: str) -> DataFrame:
    """Tool results of the given ids that aren't pinned give their text up for a placeholder; their tokens are counted anew."""
    from skein.functions.text import token_estimate

    marked = messages.join(ids.select("store_id", F.lit(True).alias("_gone")).distinct(), "store_id", "left")
    gone = F.coalesce(F.col("_gone"), F.lit(False)) & (F.col("role") == "tool") & ~F.coalesce("pinned", F.lit(False))
    out = marked.withColumn("content", F.when(gone, F.lit(placeholder)).otherwise(F.col("content")))
    return out.withColumn("token_estimate", F.when(gone, 4 + token_estimate(F.lit(placeholder))).otherwise(F.col("token_estimate"))).drop("_gone")


def set_pinned(messages: DataFrame, ids: DataFrame, value: bool) -> DataFrame:
    marked = messages.join(ids.select("store_id", F.lit(value).alias("_pin")).distinct(), "store_id", "left")
    return marked.withColumn("pinned", F.coalesce("_pin", "pinned")).drop("_pin")


def blank_sources(messages: DataFrame) -> DataFrame:
    """What `normalize_sources` would change: rows and sessions."""
    return messages.filter(F.btrim(F.coalesce("source", F.lit(""))) == "").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("session_id").alias("n_sessions"))


def normalize_sources(messages: DataFrame) -> DataFrame:
    return messages.withColumn("source", F.coalesce(F.nullif(F.btrim("source"), F.lit("")), F.lit(UNKNOWN)))


def payload_split(messages: DataFrame, threshold: int = 12_000) -> tuple[DataFrame, DataFrame]:
    """(messages with placeholders, payloads): texts longer than the threshold move to a table keyed by their SHA-256."""
    long_ = F.length("content") > threshold
    ref = F.sha2("content", 256)
    payloads = messages.filter(long_).select(ref.alias("ref"), F.lit("message").alias("kind"), "session_id", "role", "content", F.length("content").cast("long").alias("chars"), F.octet_length("content").cast("long").alias("bytes")).dropDuplicates(["ref"])
    placeholder = F.concat(F.lit("[Externalized payload: kind=message; chars="), F.length("content").cast("string"), F.lit("; ref="), ref, F.lit("]"))
    return messages.withColumn("content", F.when(long_, placeholder).otherwise(F.col("content"))), payloads


def find_payload(payloads: DataFrame, wanted: DataFrame) -> DataFrame:
    """Payloads for messages by the digest of their text and their session."""
    return wanted.select("store_id", "session_id", F.sha2("content", 256).alias("ref")).join(payloads, ["ref", "session_id"])


def metadata_upsert(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value) rows with the changes put in; equal values are left alone."""
    return metadata.join(changes.select("key"), "key", "left_anti").unionByName(changes)


CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"


def public(messages: DataFrame) -> DataFrame:
    """Messages as a chat interface takes them: role, content, calls decoded from their JSON, and of a tool's result the call it answers; fields that don't apply are null."""
    calls = F.from_json("tool_calls", CALLS)
    return messages.select(
        "store_id", "session_id", "role", F.when((F.col("role") != "assistant") | (F.coalesce(F.size(calls), F.lit(0)) <= 0) | (F.length("content") > 0), F.coalesce("content", F.lit(""))).alias("content"),
        F.when((F.col("role") == "assistant") & (F.size(calls) > 0), calls).alias("tool_calls"), F.when(F.col("role") == "tool", F.nullif("tool_call_id", F.lit(""))).alias("tool_call_id"), F.when(F.col("role") == "tool", F.nullif("tool_name", F.lit(""))).alias("name"),
    )


def backfill(messages: DataFrame, payloads: DataFrame, threshold: int = 12_000) -> DataFrame:
    """Payloads that old tool results should have and don't: long ones whose digest isn't there, each once."""
    _, wanted = payload_split(messages.filter("role = 'tool'"), threshold)
    return wanted.join(payloads.select("ref").distinct(), "ref", "left_anti")

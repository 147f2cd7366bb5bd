"""Summaries of days, weeks and months, kept right by invalidating and building anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("day", "week", "month")


def day_of(epoch: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch))


def period_start(day: Column, kind: str) -> Column:
    """The day itself, its Monday, or the first of its month."""
    return F.to_date(F.date_trunc(kind, day)) if kind != "day" else day


def daily(nodes: DataFrame, scope: str = "session_id") -> DataFrame:
    """(scope, day, node_id, summary): a node feeds every UTC day that its span meets; spans the wrong way round are turned."""
    a, b = F.coalesce("earliest_at", "created_at"), F.coalesce("latest_at", "created_at")
    days = F.sequence(day_of(F.least(a, b)), day_of(F.greatest(a, b)))
    return nodes.select(F.col(scope).alias("scope"), "node_id", "summary", F.explode(days).alias("day"))


def build_days(nodes: DataFrame, max_tokens: int = 5000, scope: str = "session_id") -> DataFrame:
    """(scope, day, n_sources, source_ids, fingerprint, summary): summaries in the order of ids, cut at both ends to the budget."""
    from skein.functions.text import head_tail

    parts = F.array_sort(F.collect_list(F.struct("node_id", F.coalesce("summary", F.lit("")).alias("summary"))))
    out = daily(nodes, scope).groupBy("scope", "day").agg(parts.alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(F.lit("[Summary node "), x["node_id"].cast("string"), F.lit("] "), x["summary"])), "\n")
    prints = F.array_join(F.transform("p", lambda x: F.concat(x["node_id"].cast("string"), F.lit(":"), F.sha2(x["summary"], 256))), ",")
    return out.select("scope", "day", F.size("p").alias("n_sources"), F.transform("p", lambda x: x["node_id"]).alias("source_ids"), F.sha2(prints, 256).alias("fingerprint"), head_tail(text, max_tokens).alias("summary"))


def aggregate(events: DataFrame, kind: str) -> DataFrame:
    """Numbers of an event table by scope and period."""
    day = F.to_date("ts")
    return events.groupBy("scope", period_start(day, kind).alias("period_start")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.sum("k").alias("k_total"), F.countDistinct("event_type").alias("kinds"), F.countDistinct(day).alias("days"),
    )


def gate(days: DataFrame, kind: str) -> DataFrame:
    """(scope, period_start, complete) of a week or month: every day with content has to be ready; days without don't count.

    days: (scope, day, ready).
    """
    return days.groupBy("scope", period_start(F.col("day"), kind).alias("period_start")).agg(F.every("ready").alias("complete"), F.count(F.lit(1)).alias("content_days"))


def invalidated(events: DataFrame) -> DataFrame:
    """(scope, period_kind, period_start) that change events (scope, covered_start, covered_end) make stale, each once."""
    days = events.select("scope", F.explode(F.sequence(day_of(F.least("covered_start", "covered_end")), day_of(F.greatest("covered_start", "covered_end")))).alias("day")).distinct()
    kinds = F.array(*(F.struct(F.lit(k).alias("period_kind"), period_start(F.col("day"), k).alias("period_start")) for k in KINDS))
    return days.select("scope", F.explode(kinds).alias("p")).select("scope", "p.period_kind", "p.period_start").distinct()


def mark_stale(rollups: DataFrame, stale: DataFrame) -> DataFrame:
    """Rollups with the stale ones marked, a generation further."""
    keys = ["scope", "period_kind", "period_start"]
    marked = rollups.join(stale.select(*keys, F.lit(True).alias("_s")).distinct(), keys, "left")
    return marked.withColumns({"status": F.when(F.col("_s"), "stale").otherwise(F.col("status")), "generation": F.col("generation") + F.when(F.col("_s"), 1).otherwise(0)}).drop("_s")


def publish(rollups: DataFrame, built: DataFrame) -> DataFrame:
    """Rollups with those built put in, where nothing changed since: a build of an older generation is dropped."""
    keys = ["scope", "period_kind", "period_start"]
    newer = rollups.select(*keys, F.col("generation").alias("_g"))
    valid = built.join(newer, keys, "left").filter(F.col("_g").isNull() | (F.col("_g") <= F.col("generation"))).drop("_g")
    return rollups.join(valid.select(*keys), keys, "left_anti").unionByName(valid)


def reclaim(rollups: DataFrame, now: float) -> DataFrame:
    """Builds whose lease ran out are stale again."""
    lost = (F.col("status") == "building") & (F.col("lease_until") < now)
    return rollups.withColumn("status", F.when(lost, "stale").otherwise(F.col("status")))


def purge(rollups: DataFrame, sources: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rollups without those that a deleted node went into."""
    gone = sources.join(deleted.select("node_id").distinct(), "node_id", "left_semi").select("rollup_id").distinct()
    return rollups.join(gone, "rollup_id", "left_anti")


def ready_in_window(rollups: DataFrame, kind: str, start: str, end: str, scope: str) -> DataFrame:
    rows = rollups.filter((F.col("status") == "ready") & (F.col("period_kind") == kind) & (F.col("scope") == scope))
    return rows.filter(F.col("period_start").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("period_start")


def recent(nodes: DataFrame, start: float, end: float, limit: int = 20) -> DataFrame:
    """Nodes that meet [start, end), newest first: starts before its end, ends at its start or later."""
    a, b = F.coalesce("earliest_at", "created_at"), F.coalesce("latest_at", "created_at")
    return nodes.filter((a < end) & (b >= start)).withColumns({"start_at": a, "end_at": b}).orderBy(F.desc("end_at"), F.desc("node_id")).limit(limit)


def covered(rollups: DataFrame, pending: DataFrame, scope: str, start: str, end: str) -> DataFrame:
    """Whether ready day rollups answer for all days of [start, end] (one row: expected, ready, pending, served)."""
    expected = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    ready = ready_in_window(rollups, "day", start, end, scope).agg(F.countDistinct("period_start").alias("ready"))
    waiting = pending.filter((F.col("scope") == scope) & F.col("period_start").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).agg(F.count(F.lit(1)).alias("pending"))
    return ready.crossJoin(waiting).select(expected.alias("expected"), "ready", "pending", ((F.col("ready") == expected) & (F.col("pending") == 0)).alias("served"))


def status_pivot(rollups: DataFrame) -> DataFrame:
    counts = {s: F.count_if(F.col("status") == s) for s in ("ready", "stale", "building", "failed")}
    return rollups.groupBy("period_kind").agg(*(c.alias(s) for s, c in counts.items()), F.min(F.when(F.col("status") == "stale", F.col("period_start"))).alias("oldest_stale"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change events of two snapshots of nodes: insert, delete, and for an update both the old and the new span."""
    span = lambda d, p: d.select("node_id", F.col("session_id").alias(f"{p}_scope"), F.coalesce("earliest_at", "created_at").alias(f"{p}_start"), F.coalesce("latest_at", "created_at").alias(f"{p}_end"), F.sha2(F.coalesce("summary", F.lit("")), 256).alias(f"{p}_h"))
    both = span(before, "a").join(span(after, "b"), "node_id", "full")
    changed = ~F.struct("a_scope", "a_start", "a_end", "a_h").eqNullSafe(F.struct(F.col("b_scope").alias("a_scope"), F.col("b_start").alias("a_start"), F.col("b_end").alias("a_end"), F.col("b_h").alias("a_h")))
    kind = F.when(F.col("a_scope").isNull(), "insert").when(F.col("b_scope").isNull(), "delete").otherwise("update")
    events = F.array_compact(F.array(*(F.when(F.col(f"{p}_scope").isNotNull(), F.struct(F.col(f"{p}_scope").alias("scope"), F.col(f"{p}_start").alias("covered_start"), F.col(f"{p}_end").alias("covered_end"))) for p in "ab")))
    return both.filter(changed).select("node_id", kind.alias("operation"), F.explode(events).alias("e")).select("node_id", "operation", "e.*").distinct()

"""Kept answers of queries: claimed while they are made, served only while every quote they rest on still holds, gone after their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL, LEASE, PROMOTED = 7 * 86400.0, 300.0, 2
VIEWS = "view_id string, generation long, status string, result string, hits int, created_at double, expires_at double, lease_until double"


def view_id(*parts: Column) -> Column:
    """The identity of a typed intent."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def claim(views: DataFrame, wanted: DataFrame, generation: int, now: float) -> DataFrame:
    """(view_id, token) of the builds that may begin: views that are not there, are of another corpus, ran out, or whose builder let its lease lapse."""
    held = views.select("view_id", "status", F.col("generation").alias("_g"), "expires_at", "lease_until")
    rows = wanted.select("view_id").distinct().join(held, "view_id", "left")
    busy = (F.col("status") == "building") & (F.col("lease_until") > now)
    served = (F.col("status") == "ready") & (F.col("_g") == generation) & (F.col("expires_at") > now)
    return rows.filter(~F.coalesce(busy | served, F.lit(False))).select("view_id", F.sha2(F.concat_ws(":", "view_id", F.lit(str(generation)), F.lit(repr(now))), 256).alias("token"))


def building(views: DataFrame, claimed: DataFrame, generation: int, now: float) -> DataFrame:
    """The views with the claimed ones under way."""
    new = claimed.select("view_id", F.lit(generation).cast("long").alias("generation"), F.lit("building").alias("status"), F.lit(None).cast("string").alias("result"), F.lit(0).alias("hits"), F.lit(now).alias("created_at"), F.lit(now + TTL).alias("expires_at"), F.lit(now + LEASE).alias("lease_until"))
    return views.join(claimed.select("view_id"), "view_id", "left_anti").select(*new.columns).unionByName(new)


def publish(views: DataFrame, built: DataFrame, generation: int, now: float) -> DataFrame:
    """The views with results (view_id, result) put in; a result whose claim has lapsed, or of another corpus, is dropped."""
    valid = F.col("status").eqNullSafe(F.lit("building")) & (F.col("generation") == generation) & (F.col("lease_until") > now) & F.col("_r").isNotNull()
    rows = views.join(built.select("view_id", F.col("result").alias("_r")), "view_id", "left")
    return rows.select("view_id", "generation", F.when(valid, "ready").otherwise(F.col("status")).alias("status"), F.when(valid, F.col("_r")).otherwise(F.col("result")).alias("result"), "hits", "created_at", "expires_at", "lease_until")


def dependencies(candidates: DataFrame, messages: DataFrame) -> DataFrame:
    """Snapshots of the quotes that views rest on (view_id, store_id, span_start, span_end, quote) with the source's digest; quotes that are not what the span says are left out."""
    rows = candidates.join(messages.select("store_id", "content"), "store_id")
    inside = (F.col("span_start") >= 0) & (F.col("span_end") > F.col("span_start")) & (F.col("span_end") <= F.length("content"))
    same = F.substring(F.col("content"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) == F.col("quote")
    return rows.filter(inside & same).select("view_id", "store_id", "span_start", "span_end", "quote", F.sha2("content", 256).alias("sha256"))


def lookup(views: DataFrame, deps: DataFrame, messages: DataFrame, wanted: DataFrame, generation: int, now: float) -> DataFrame:
    """(view_id, result, hit, promoted) of every view asked for: a hit is ready, in time, of this corpus, and all its quotes hold. The second hit promotes it."""
    from skein.operators.trajectory import fresh_views

    asked = wanted.groupBy("view_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    own = views.filter((F.col("status") == "ready") & (F.col("generation") == generation)).join(asked.select("view_id"), "view_id", "left_semi")
    fresh = fresh_views(own, deps.join(asked.select("view_id"), "view_id", "left_semi"), messages, now)
    rows = asked.join(fresh.select("view_id", "result", "hits"), "view_id", "left")
    hit = F.col("hits").isNotNull()
    return rows.select("view_id", "result", hit.alias("hit"), F.coalesce(F.col("hits") + F.col("n") >= PROMOTED, F.lit(False)).alias("promoted"))


def counted(views: DataFrame, looked_up: DataFrame) -> DataFrame:
    """The views with this round's hits added."""
    rows = views.join(looked_up.filter("hit").select("view_id", F.lit(1).alias("_h")), "view_id", "left")
    return rows.withColumn("hits", F.col("hits") + F.coalesce("_h", F.lit(0))).drop("_h")


def expire(views: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(the views that stay, the ids that go): past their time, or under way with a lapsed lease."""
    gone = (F.col("expires_at") <= now) | ((F.col("status") == "building") & (F.col("lease_until") <= now))
    return views.filter(~gone), views.filter(gone).select("view_id")

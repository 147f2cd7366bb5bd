"""Fusing ranked lists, and the priors and caps put on the result."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 60
HALF_LIFE, FLOOR, SCOPE_BIAS = 30 * 86400, 0.5, 0.5
WEIGHTS = {"fts": 0.5, "summary": 1.0, "chunk": 1.0}


def weight(w: float) -> float:
    """Negative weights count nothing, those that aren't finite one."""
    return 1.0 if w is None or not math.isfinite(w) else max(0.0, w)


def rrf(arms: list[DataFrame], weights: list[float], keys: tuple[str, ...] = ("id_space", "id"), k: int = K) -> DataFrame:
    """Reciprocal-rank fusion of arms (id_space, id, rank): score, rank_0..., in order.

    An identity counts once in an arm, at its best rank; ids of different spaces
    differ. One aggregation does it: each arm's rank is a conditional minimum.
    """
    rows = reduce(DataFrame.unionByName, (a.select(*keys, F.col("rank").cast("int").alias("rank"), F.lit(i).alias("arm")) for i, a in enumerate(arms)))
    ranks = rows.groupBy(*keys).agg(*(F.min(F.when(F.col("arm") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(arms))))
    score = sum((F.coalesce(F.lit(weight(w)) / (k + F.col(f"rank_{i}")), F.lit(0.0)) for i, w in enumerate(weights)), F.lit(0.0))
    return ranks.withColumn("score", score).orderBy(F.desc("score"), *(F.coalesce(f"rank_{i}", F.lit(10**9)) for i in range(len(arms))), *keys)


def recency(at: Column, now: float) -> Column:
    """Halves every 30 days down to a half; times not after the epoch get the floor."""
    return F.when(at > 0, F.greatest(F.lit(FLOOR), F.pow(F.lit(2.0), -F.greatest(F.lit(now) - at, F.lit(0.0)) / HALF_LIFE))).otherwise(F.lit(FLOOR))


def recall_score(fused: DataFrame, family: list[str] | DataFrame, now: float, bias: float = SCOPE_BIAS) -> DataFrame:
    """score * (1 + bias for sessions of the current conversation's family) * recency."""
    if isinstance(family, DataFrame):
        fused = fused.join(family.select("session_id", F.lit(True).alias("_own")).distinct(), "session_id", "left")
        own = F.coalesce("_own", F.lit(False))
    else:
        own = F.col("session_id").isin(family) if family else F.lit(False)
    return fused.withColumn("score", F.col("score") * (1 + F.when(own, bias).otherwise(0.0)) * recency(F.col("timestamp"), now)).drop("_own")


def per_group_cap(rows: DataFrame, group: str, order: list[Column], most: int, identity: str) -> DataFrame:
    """At most `most` rows of each group in order; rows without a group are their own."""
    own = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("missing:"), F.col(identity).cast("string")))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(own).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def confidence(score: Column) -> Column:
    return F.when(score >= 0.65, "high").when(score >= 0.5, "medium").when(score >= 0.35, "low").otherwise("noise")


def content_window(text: Column, start: Column, end: Column, cap: int = 2400) -> Column:
    """(offset, text) of at most `cap` characters around a span."""
    n = F.length(text)
    offset = F.greatest(F.least(F.floor((start + end - cap) / 2), n - cap), F.lit(0)).cast("int")
    return F.struct(offset.alias("offset"), F.substring(text, offset + 1, F.lit(cap)).alias("text"))


def exact_ref(store_id: Column, start: Column, end: Column) -> Column:
    return F.format_string("msg:%d:%d-%d", store_id, start, end)


def unseen(hits: DataFrame, seen: DataFrame) -> DataFrame:
    """Hits whose exact ref hasn't been handed out."""
    return hits.join(seen.select("ref").distinct(), "ref", "left_anti")


def within_chars(rows: DataFrame, order: list[Column], cap: int, group: str | None = None) -> DataFrame:
    """Rows from the first on while their JSON fits in `cap` characters (of a group, or of a result already cut to its top)."""
    size = F.length(F.to_json(F.struct(*rows.columns)))
    w = Window.partitionBy(group) if group else Window.partitionBy()
    return rows.withColumn("_used", F.sum(size).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_used") <= cap).drop("_used")


def even_sample(rows: DataFrame, group: str, order: list[Column], n: int = 64) -> DataFrame:
    """n rows of each group evenly over its order, the first and last among them; all of smaller groups."""
    w = Window.partitionBy(group)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_m": F.count(F.lit(1)).over(w)})
    wanted = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.bround(j * (F.col("_m") - 1) / F.lit(float(n - 1))).cast("long") == F.col("_i"))
    return placed.filter((F.col("_m") <= n) | wanted).drop("_i", "_m")


def rerank(rows: DataFrame, scorer: Column, order: list[Column], window: int) -> DataFrame:
    """The first `window` rows anew by a scorer (a column, or a vectorised function's result); the rest keep their places."""
    placed = rows.withColumn("_p", F.row_number().over(Window.orderBy(*order)))  # rows: a result already cut to its top
    return placed.orderBy(F.when(F.col("_p") <= window, 0).otherwise(1), F.when(F.col("_p") <= window, -scorer), "_p").drop("_p")

"""Ordered states of agents: transitions, neighbours, samples, documents; and the state of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.fusion import even_sample


def transitions(states: DataFrame, group: str, order: list[str], state: str) -> DataFrame:
    """(group, before, after) of neighbouring states."""
    w = Window.partitionBy(group).orderBy(*order)
    return states.select(group, F.lag(state).over(w).alias("before"), F.col(state).alias("after")).filter(F.col("before").isNotNull())


def adjacent(states: DataFrame, hits: DataFrame, group: str, order: list[str], state: str) -> DataFrame:
    """Each hit with the states just before and after it."""
    w = Window.partitionBy(group).orderBy(*order)
    return states.select(group, F.col(state), F.lag(state).over(w).alias("before"), F.lead(state).over(w).alias("after")).join(hits.select(state).distinct(), state, "left_semi")


def fill_adjacent(nuclei: DataFrame, neighbours: DataFrame, limit: int) -> DataFrame:
    """Nuclei (id, rank), then neighbours (id, nucleus) a round at a time in the order of their nuclei, each once, `limit` in all."""
    keep = nuclei.select("id", F.lit(0).alias("round"), F.col("rank"))
    around = neighbours.join(nuclei.select(F.col("id").alias("nucleus"), "rank"), "nucleus").withColumn("round", F.row_number().over(Window.partitionBy("nucleus").orderBy("id")))
    each = keep.unionByName(around.select("id", "round", "rank")).groupBy("id").agg(F.min(F.struct("round", "rank")).alias("x"))
    return each.orderBy("x.round", "x.rank", "id").limit(limit).select("id", F.col("x.round").alias("round"), F.col("x.rank").alias("rank"))


def documents(states: DataFrame, group: str, order: list[str], text: str, most: int = 64, chars: int = 900) -> DataFrame:
    """One text a trajectory from states evenly over it, each cut to `chars`; with a digest of the whole sequence."""
    sampled = even_sample(states, group, [F.col(c) for c in order], most)
    parts = F.array_sort(F.collect_list(F.struct(*order, F.substring(F.coalesce(text, F.lit("")), 1, chars).alias("t"))))
    return sampled.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("document"), F.count(F.lit(1)).alias("n_states"))


def digest(states: DataFrame, group: str, order: list[str], state: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(state).cast("string").alias("s"))))
    return states.groupBy(group).agg(F.count(F.lit(1)).alias("n_states"), F.sha2(F.array_join(F.transform(parts, lambda x: x["s"]), ","), 256).alias("digest"))


def lifecycle(events: DataFrame) -> DataFrame:
    """State of each conversation from its events (conversation_id, at, event, session_id, frontier): the current session, the last finalised, the greatest frontier."""
    at = F.struct("at", "session_id")
    bound = F.max_by("session_id", F.when(F.col("event") == "bind", at))
    done = F.max_by("session_id", F.when(F.col("event") == "finalize", at))
    return events.groupBy("conversation_id").agg(bound.alias("current_session"), done.alias("last_finalized"), F.max("frontier").alias("frontier"), F.max("at").alias("updated_at"))


def frontier(events: DataFrame) -> DataFrame:
    """The frontier after every event; it never goes back."""
    return events.withColumn("frontier", F.max("frontier").over(Window.partitionBy("conversation_id").orderBy("at", "session_id").rowsBetween(Window.unboundedPreceding, 0)))


def prune(state: DataFrame, messages: DataFrame, nodes: DataFrame, protected: list[str], before: float) -> DataFrame:
    """State rows without those whose session has no data, is old enough and isn't protected."""
    used = messages.select("session_id").union(nodes.select("session_id")).distinct().withColumn("_u", F.lit(True))
    marked = state.join(used, state["current_session"] == used["session_id"], "left").drop("session_id")
    return marked.filter(F.col("_u").isNotNull() | F.col("current_session").isin(protected) | (F.col("updated_at") >= before)).drop("_u")


def replayed(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming messages that aren't stored yet: the n-th message of an identity (role, text, call) is there if n of it are stored."""
    key: list[Column] = [F.col("session_id"), F.sha2(F.concat_ws("\x1f", F.coalesce("role", F.lit("")), F.coalesce("content", F.lit(""))), 256).alias("identity")]
    count = stored.select(*key).groupBy("session_id", "identity").agg(F.count(F.lit(1)).alias("_have"))
    n = F.row_number().over(Window.partitionBy("session_id", "identity").orderBy("store_id"))
    return incoming.select("*", key[1]).withColumn("_n", n).join(count, ["session_id", "identity"], "left").filter(F.col("_n") > F.coalesce("_have", F.lit(0))).drop("identity", "_n", "_have")


def corpus_events(before: DataFrame, after: DataFrame, generation: int) -> DataFrame:
    """(generation, store_id, operation) of two snapshots of messages."""
    h = lambda d, c: d.select("store_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias(c))
    both = h(before, "a").join(h(after, "b"), "store_id", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(F.lit(generation).cast("long").alias("generation"), "store_id", F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").otherwise("update").alias("operation"))


def fresh_views(views: DataFrame, dependencies: DataFrame, messages: DataFrame, now: float) -> DataFrame:
    """Cached results (view_id, expires_at) that aren't expired and whose quotes (view_id, store_id, span, quote, sha256) all still hold."""
    deps = dependencies.join(messages.select("store_id", "content"), "store_id", "left")
    holds = (F.sha2("content", 256) == F.col("sha256")) & (F.substring(F.col("content"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) == F.col("quote"))
    broken = deps.filter(~F.coalesce(holds, F.lit(False))).select("view_id").distinct()
    return views.filter(F.col("expires_at") > now).join(broken, "view_id", "left_anti")


def hybrid(states: DataFrame, hits: DataFrame, semantic: DataFrame, *, limit: int, candidates: int = 100, per_trajectory: int = 3, include_adjacent: bool = True) -> DataFrame:
    """(state_id, score, kind, round): states found by words over all trajectories, and by words within those nearest in meaning, fused by reciprocal rank.

    states: (state_id, trajectory_id, sequence); hits: (state_id, rank), all that
    words find, smaller is better; semantic: (trajectory_id, position), the
    nearest, few. A state found in both ways has three terms: its place among
    all, its place within, its trajectory's position. Without near trajectories
    words alone decide. A third of the places, six at most, is kept for
    neighbours of what was chosen; round 0 is what was chosen itself.
    """
    found = hits.join(states, "state_id")
    order = [F.col("rank"), F.col("trajectory_id"), F.col("sequence")]
    first = found.orderBy(*order).limit(candidates).withColumn("all_", F.row_number().over(Window.orderBy(*order)))  # over a top list
    near = found.join(F.broadcast(semantic), "trajectory_id").orderBy(*order).limit(candidates).withColumn("near_", F.row_number().over(Window.orderBy(*order)))
    both = first.join(near.select("state_id", "near_", "position"), "state_id", "full")
    both = both.select("state_id", "all_", "near_", "position").join(states, "state_id")
    score = sum((F.coalesce(1 / (F.lit(60.0) + F.col(c)), F.lit(0.0)) for c in ("all_", "near_", "position")), F.lit(0.0))
    both = both.withColumns({"score": score, "kind": F.when(F.col("near_").isNotNull(), "semantic_fts").otherwise("fts")})
    best = [F.desc("score"), F.col("trajectory_id"), F.col("sequence")]
    reserve = min(6, limit // 3) if include_adjacent else 0
    capped = both.withColumn("_n", F.row_number().over(Window.partitionBy("trajectory_id").orderBy(*best))).filter(F.col("_n") <= per_trajectory).orderBy(*best).limit(max(1, limit - reserve))
    nuclei = capped.select("state_id", "trajectory_id", "sequence", "score", "kind", F.row_number().over(Window.orderBy(*best)).alias("rank"))
    if not include_adjacent:
        return nuclei.select("state_id", "score", "kind", F.lit(0).alias("round"))
    beside = nuclei.select("trajectory_id", F.col("state_id").alias("nucleus"), F.explode(F.array(F.col("sequence") - 1, F.col("sequence") + 1)).alias("sequence"))
    beside = states.join(F.broadcast(beside), ["trajectory_id", "sequence"]).select(F.col("state_id").alias("id"), "nucleus")
    filled = fill_adjacent(nuclei.select(F.col("state_id").alias("id"), "rank"), beside, limit)
    rows = filled.join(nuclei.select(F.col("state_id").alias("id"), "score", "kind"), "id", "left")
    return rows.select(F.col("id").alias("state_id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("kind", F.lit("adjacent")).alias("kind"), "round")

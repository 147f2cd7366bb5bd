"""Compaction of conversations as repeated passes over whole tables: leaves, condensation, sweeps, and what follows a session."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import token_estimate
from skein.operators import chunk, dag
from skein.sources.tables import shared_dir

NODE_COLUMNS = ["node_id", "session_id", "depth", "summary", "token_count", "source_token_count", "source_ids", "source_type", "created_at", "earliest_at", "latest_at"]
#: Makes a summary of a text under a budget of tokens: a column, which may be a vectorised function's; the default cuts the middle out.
Summariser = Callable[[Column, Column], Column]


def cut_middle(text: Column, budget: Column) -> Column:
    """The last resort of summarising, and the only one without a model: head and tail of the text, within `budget` tokens."""
    room = F.greatest((budget - 1) * 4 - 5, F.lit(2))
    half = F.floor(room / 2).cast("int")
    return F.when(token_estimate(text) <= budget, text).otherwise(F.concat(F.substring(text, F.lit(1), half), F.lit("\n...\n"), F.substring(text, F.length(text) - half + 1, half)))


def escalated(text: Column, budget: Column, *levels: Summariser) -> Column:
    """The first level's summary that isn't empty and fits the budget; `cut_middle` if none does."""
    made = [F.when((F.length(F.btrim(level(text, budget))) > 0) & (token_estimate(level(text, budget)) <= budget), level(text, budget)) for level in levels]
    return F.coalesce(*made, cut_middle(text, budget))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(made: DataFrame, nodes: DataFrame) -> DataFrame:
    """New nodes with ids behind the greatest of their session: no session waits for another."""
    top = nodes.groupBy("session_id").agg(F.max("node_id").alias("_top"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("earliest_at", F.element_at("source_ids", 1)))
    return made.withColumn("_n", n).join(top, "session_id", "left").withColumn("node_id", F.coalesce("_top", F.lit(0)) + F.col("_n")).select(*NODE_COLUMNS)


def leaves(messages: DataFrame, nodes: DataFrame, *, budget: int, tail: int, summary_tokens: int = 200, levels: tuple[Summariser, ...] = ()) -> DataFrame:
    """Leaf nodes of all messages that no node holds and the fresh tail doesn't keep, a greedy run of `budget` tokens each."""
    used = dag.edges(nodes).filter("child_type = 'messages'").select(F.col("child").alias("store_id")).distinct()
    fresh = chunk.fresh_tail(messages, tail).select("store_id")
    rows = messages.join(used, "store_id", "left_anti").join(fresh, "store_id", "left_anti")
    runs = chunk.fold_segments(rows.select("session_id", "store_id", "content", "timestamp", "token_estimate"), "session_id", "store_id", "token_estimate", budget)
    parts = F.array_sort(F.collect_list(F.struct("store_id", F.coalesce("content", F.lit("")).alias("t"))))
    made = runs.groupBy("session_id", "segment").agg(parts.alias("p"), F.sum("token_estimate").cast("long").alias("source_token_count"), F.min("timestamp").alias("earliest_at"), F.max("timestamp").alias("latest_at"))
    text = F.array_join(F.transform("p", lambda x: x["t"]), "\n")
    made = made.withColumns({"summary": escalated(text, F.lit(summary_tokens), *levels), "source_ids": F.transform("p", lambda x: x["store_id"])})
    made = made.withColumns({"depth": F.lit(0), "token_count": token_estimate(F.col("summary")).cast("long"), "source_type": F.lit("messages"), "created_at": F.col("latest_at")})
    return _numbered(made, nodes)


def condensed(nodes: DataFrame, depth: int, fanin: int, levels: tuple[Summariser, ...] = ()) -> DataFrame:
    """Parents of the nodes of a depth, `fanin` each, of those not yet condensed."""
    made = dag.condense(nodes, depth, fanin)
    made = made.withColumns({"summary": escalated(F.col("text"), F.col("budget"), *levels), "source_type": F.lit("nodes"), "created_at": F.col("latest_at")})
    return _numbered(made.withColumn("token_count", token_estimate(F.col("summary")).cast("long")), nodes)


def frontier_tokens(nodes: DataFrame) -> DataFrame:
    """(session_id, tokens) of what no node holds."""
    return dag.unreferenced(nodes).groupBy("session_id").agg(F.sum("token_count").alias("tokens"))


def sweep(nodes: DataFrame, target: int, *, passes: int = 8, fanin: int = 4, levels: tuple[Summariser, ...] = ()) -> tuple[DataFrame, int]:
    """(nodes, passes made): sessions whose frontier holds over `target` tokens are condensed, the lowest depth that can be first, until none is left that can be or the passes are used up.

    Every pass is one plan over all sessions; what it adds is written, so plans
    don't grow. Only whether anything was added reaches the driver.
    """
    done = 0
    while done < passes:
        heavy = frontier_tokens(nodes).filter(F.col("tokens") > target).select("session_id")
        free = dag.unreferenced(nodes).join(heavy, "session_id", "left_semi").groupBy("session_id", "depth").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fanin)
        turn = free.groupBy("session_id").agg(F.min("depth").alias("depth"))
        depths = sorted(r[0] for r in turn.select("depth").distinct().collect())  # one row a depth
        if not depths:
            break
        added = None
        for d in depths:
            own = nodes.join(turn.filter(F.col("depth") == d).select("session_id"), "session_id", "left_semi")
            made = condensed(own, d, fanin, levels)
            added = made if added is None else added.unionByName(made)
        nodes = _written(nodes.select(*NODE_COLUMNS).unionByName(added), "sweep")
        done += 1
    return nodes, done


def compact(messages: DataFrame, nodes: DataFrame, *, leaf_budget: int, tail: int, target: int, passes: int = 8, fanin: int = 4, levels: tuple[Summariser, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, context): leaves of what is old, condensed to the target; then what each session's context holds: its fresh tail and its frontier."""
    made = _written(nodes.select(*NODE_COLUMNS).unionByName(leaves(messages, nodes, budget=leaf_budget, tail=tail, levels=levels)), "compact")
    made, _ = sweep(made, target, passes=passes, fanin=fanin, levels=levels)
    return made, chunk.assemble(chunk.fresh_tail(messages, tail), dag.unreferenced(made), target)


def debt(messages: DataFrame, nodes: DataFrame, tail: int, now: float) -> DataFrame:
    """(session_id, kind, size, recorded_at): what waits for compaction, `raw` messages that no node holds behind the tail; sessions without are cleared by not being there."""
    used = dag.edges(nodes).filter("child_type = 'messages'").select(F.col("child").alias("store_id")).distinct()
    rows = messages.join(used, "store_id", "left_anti").join(chunk.fresh_tail(messages, tail).select("store_id"), "store_id", "left_anti")
    return rows.groupBy("session_id").agg(F.sum("token_estimate").cast("long").alias("size")).select("session_id", F.lit("raw").alias("kind"), "size", F.lit(now).alias("recorded_at"))


def carried_over(nodes: DataFrame, moves: DataFrame, least_depth: int) -> DataFrame:
    """Nodes with those of `least_depth` and deeper moved from an old session to the new one (moves: old, new); a session moves to one other at most."""
    to = moves.groupBy(F.col("old").alias("session_id")).agg(F.min("new").alias("_new"))
    rows = nodes.join(to, "session_id", "left")
    return rows.withColumn("session_id", F.when(F.col("depth") >= least_depth, F.coalesce("_new", "session_id")).otherwise(F.col("session_id"))).select(*nodes.columns)


def maintained(rollups: DataFrame, built: DataFrame, now: float, *, builds: int, backoff: float = 30.0) -> DataFrame:
    """Rollups after a pass of at most `builds`: stale days first, then days that failed `backoff` seconds ago or earlier, then stale and failed weeks and months; each takes the summary built for it or fails.

    rollups: (scope, period_kind, period_start, status, generation, failed_at);
    built: (scope, period_kind, period_start, summary), those that could be made.
    """
    keys = ["scope", "period_kind", "period_start"]
    day, again = F.col("period_kind") == "day", (F.col("status") == "failed") & (F.coalesce("failed_at", F.lit(0.0)) <= now - backoff)
    turn = F.when((F.col("status") == "stale") & day, 0).when(again & day, 1).when(F.col("status") == "stale", 2).when(again, 3)
    due = rollups.withColumn("_turn", turn).filter(F.col("_turn").isNotNull()).orderBy("_turn", "period_start", "scope", "period_kind").limit(builds).select(*keys)  # a bound asked for, so a top list
    rows = rollups.join(due.withColumn("_due", F.lit(True)), keys, "left").join(built.select(*keys, F.col("summary").alias("_made")), keys, "left")
    due_, made = F.coalesce("_due", F.lit(False)), F.col("_made").isNotNull()
    return rows.select(
        *keys, F.when(due_, F.when(made, "ready").otherwise("failed")).otherwise(F.col("status")).alias("status"), (F.col("generation") + F.when(due_ & made, 1).otherwise(0)).alias("generation"),
        F.when(due_, F.when(~made, F.lit(now))).otherwise(F.col("failed_at")).alias("failed_at"), F.when(due_ & made, F.col("_made")).alias("summary"),
    )

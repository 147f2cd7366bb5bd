"""Checks of a store, and the measures that retrieval is judged by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import text as T


def payload_risks(messages: DataFrame, limit: int | None = 50) -> DataFrame:
    """The longest messages with what is wrong with them; only flagged ones, metadata only. Without a limit, all of them in no order."""
    c = F.col("content")
    found = {"data_uri": T.has_data_uri(c), "base64": T.has_base64(c), "noise": T.is_noise(c), "heartbeat": T.is_heartbeat(F.col("role"), c), "repetitive": T.quarantine_reason(c).isNotNull()}
    flags = F.array(F.struct(F.length(c).alias("chars"), *(v.alias(k) for k, v in found.items())))
    flagged = F.filter(flags, lambda x: reduce(lambda a, b: a | b, (x[k] for k in found)))  # a filter of rows would work them out a second time
    rows = messages.select("store_id", "session_id", "role", F.inline(flagged))
    return rows if limit is None else rows.orderBy(F.desc("chars"), "store_id").limit(limit)


def payload_integrity(messages: DataFrame, payloads: DataFrame) -> DataFrame:
    """(status, n) of references: present, missing, and payloads that nothing refers to."""
    used = messages.select(F.explode(T.refs(F.col("content"))).alias("ref")).distinct()
    have = payloads.select("ref").distinct()
    both = used.withColumn("u", F.lit(1)).join(have.withColumn("h", F.lit(1)), "ref", "full")
    status = F.when(F.col("h").isNull(), "missing").when(F.col("u").isNull(), "unreferenced").otherwise("present")
    return both.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def set_differences(sets: dict[str, DataFrame], key: str, samples: int = 5) -> DataFrame:
    """(left, right, n, samples) of keys in one set and not in another, for all pairs of sets: one aggregation of a membership mask."""
    names = list(sets)
    rows = reduce(DataFrame.unionByName, (sets[n].select(key).distinct().withColumn("bit", F.lit(1 << i)) for i, n in enumerate(names)))
    masks = rows.groupBy(key).agg(F.bit_or("bit").alias("mask"))
    pairs = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit(1 << i).alias("l"), F.lit(1 << j).alias("r")) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
    each = masks.select(key, "mask", F.explode(F.array(*pairs)).alias("p")).filter((F.col("mask").bitwiseAND(F.col("p.l")) != 0) & (F.col("mask").bitwiseAND(F.col("p.r")) == 0))
    placed = each.select("p.left", "p.right", key).withColumn("_n", F.row_number().over(Window.partitionBy("left", "right").orderBy(key)))
    return placed.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= samples, F.col(key)))).alias("samples"))


def cleanup_candidates(stats: DataFrame, ignore: list[str], protected: list[str]) -> DataFrame:
    """Sessions by what their name's patterns say, `protected` ones apart; patterns are session globs."""
    from skein.plans.query import session_pattern

    hit = reduce(lambda a, b: a | b, (F.col("session_id").rlike(session_pattern(p)) for p in ignore), F.lit(False))
    kind = F.when(F.col("session_id").isin(protected), "protected").when(hit, "ignored").when(F.col("n_messages") == 0, "empty").otherwise("kept")
    return stats.withColumn("class", kind)


def doctor(messages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(check, n, status) of integrity checks, in one pass a table and one join."""
    from skein.operators.dag import orphans, unreferenced

    m = messages.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("store_id").alias("ids"), F.count_if(F.col("session_id").isNull()).alias("homeless"), F.count_if(F.col("content").isNull()).alias("empty"))
    n = nodes.agg(F.count_if(F.col("latest_at") < F.col("earliest_at")).alias("inverted"), F.count_if(F.size("source_ids") <= 0).alias("sourceless"))
    counts = m.crossJoin(n).crossJoin(orphans(nodes, messages).agg(F.count(F.lit(1)).alias("orphans"))).crossJoin(unreferenced(nodes).agg(F.count(F.lit(1)).alias("frontier")))  # one row each
    checks = {"duplicate_ids": F.col("n") - F.col("ids"), "no_session": F.col("homeless"), "no_content": F.col("empty"), "inverted_spans": F.col("inverted"), "no_sources": F.col("sourceless"), "orphan_nodes": F.col("orphans"), "frontier_nodes": F.col("frontier")}
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("n")) for k, v in checks.items()))).alias("x")).select("x.*")
    return rows.withColumn("status", F.when(F.col("check") == "frontier_nodes", "info").when(F.col("n") == 0, "ok").otherwise("warn"))


def _judged(hits: DataFrame, relevant: DataFrame | tuple[DataFrame, DataFrame], k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, n) relevant ids of each query, and those of its first k hits that are relevant, with their place p; hits count once at their best rank."""
    best = hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    top = best.withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).filter(F.col("p") <= k)
    if isinstance(relevant, tuple):
        asked, items = relevant[0].select("query_id", "class").distinct(), relevant[1].select("id", "class").distinct()
        sizes = asked.join(items.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class").groupBy("query_id").agg(F.sum("n").alias("n"))
        return sizes, top.join(asked, "query_id").join(items, ["id", "class"], "left_semi")
    want = relevant.select("query_id", "id").distinct()
    return want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), top.join(want, ["query_id", "id"], "left_semi")


def recall_at_k(hits: DataFrame, relevant: DataFrame | tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """(query_id, recall) over relevant (query_id, id); hits (query_id, id, rank) count once at their best rank.

    Where what is relevant is what is of a query's class, (query_id, class) and
    (id, class), an id of one class, stand for the pairs: these are never made.
    """
    sizes, held = _judged(hits, relevant, k)
    found = held.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    return sizes.join(found, "query_id", "left").select("query_id", F.round(F.coalesce("found", F.lit(0)) / F.col("n"), 6).alias("recall"))


def ndcg_at_k(hits: DataFrame, relevant: DataFrame | tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """(query_id, ndcg) with binary relevance, as pairs or by classes as `recall_at_k`, and discount log2(place + 1)."""
    sizes, held = _judged(hits, relevant, k)
    gain = held.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("p") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return sizes.join(gain, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def latency(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.round(F.percentile(value, p / 100), 6).alias(f"p{p}") for p in (50, 90, 99)))


def compare_policies(runs: DataFrame) -> DataFrame:
    """(policy, version, score) of runs (policy, version, retrieval, active, risk, failures, pressure), best first."""
    out = runs.groupBy("policy", "version").agg(F.count(F.lit(1)).alias("runs"), F.avg("retrieval").alias("r"), F.avg("active").alias("a"), F.sum("risk").alias("risk"), F.sum("failures").alias("f"), F.sum("pressure").alias("p"))
    score: Column = 100 * (0.7 * F.col("r") + 0.3 * F.col("a")) + 20 * (1 - F.col("risk") / F.col("runs")) - 100 * F.col("f") - 5 * F.col("p")
    return out.select("policy", "version", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "policy", "version")

"""The graph of summaries: lineage, frontiers, sources, statistics, budgets."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.sources.tables import edges, shared_dir


def depth_stats(nodes: DataFrame, *by: str) -> DataFrame:
    return nodes.groupBy(*by, "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"), F.sum("source_token_count").alias("source_tokens"))


def depth_samples(nodes: DataFrame, n: int) -> DataFrame:
    """The first n nodes of each session and depth."""
    place = F.row_number().over(Window.partitionBy("session_id", "depth").orderBy("created_at", "node_id"))
    return nodes.withColumn("place", place).filter(F.col("place") <= n)


def unreferenced(nodes: DataFrame) -> DataFrame:
    """The summary frontier: nodes that no node has among its sources."""
    used = edges(nodes).filter("child_type = 'nodes'").select(F.col("child").alias("node_id")).distinct()
    return nodes.join(used, "node_id", "left_anti")


def uncondensed(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of a depth that no deeper node of their session has among its sources."""
    used = nodes.filter(F.col("depth") > depth).select("session_id", F.explode("source_ids").alias("node_id")).distinct()
    return nodes.filter(F.col("depth") == depth).join(used, ["session_id", "node_id"], "left_anti")


def time_window(nodes: DataFrame, *by: str) -> DataFrame:
    return nodes.groupBy(*by).agg(F.min(F.coalesce("earliest_at", "created_at")).alias("start_at"), F.max(F.coalesce("latest_at", "created_at")).alias("end_at"))


def children(nodes: DataFrame) -> DataFrame:
    """(parent, place, child node) of nodes made of nodes."""
    pairs = nodes.filter("source_type = 'nodes'").select(F.col("node_id").alias("parent"), F.posexplode("source_ids").alias("place", "child"))
    return pairs.join(nodes.withColumnRenamed("node_id", "child"), "child")


def lineage(nodes: DataFrame, roots: DataFrame, max_levels: int = 64) -> DataFrame:
    """(root, node_id, level): every node below each root, the root among them, each once.

    Level by level, one join with the edges each; a level that adds nothing ends
    it. What a level adds is written, so the plan does not grow with the depth.
    A cycle ends too, as nodes that were reached are not added again.
    """

    spark = nodes.sparkSession
    step = edges(nodes).filter("child_type = 'nodes'").select(F.col("parent").alias("node_id"), "child")
    base = f"{shared_dir(spark)}/lineage-{uuid.uuid4().hex}"
    roots.select(F.col("node_id").alias("root"), "node_id", F.lit(0).alias("level")).distinct().write.parquet(f"{base}/level=0")
    schema = "root long, node_id long, level int"
    for level in range(1, max_levels + 1):
        seen = spark.read.schema(schema).parquet(*(f"{base}/level={i}" for i in range(level)))
        last = spark.read.schema(schema).parquet(f"{base}/level={level - 1}")
        new = last.join(step, "node_id").select("root", F.col("child").alias("node_id")).distinct().join(seen.select("root", "node_id"), ["root", "node_id"], "left_anti").withColumn("level", F.lit(level))
        new.write.parquet(f"{base}/level={level}")
        if spark.read.schema(schema).parquet(f"{base}/level={level}").isEmpty():
            return seen
    raise ValueError("the lineage is deeper than max_levels")


def lineage_recursive(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The same as one recursive query, for graphs without cycles and within the session's recursion limits."""
    spark = nodes.sparkSession
    nodes.createOrReplaceTempView("_skein_nodes")
    roots.select("node_id").distinct().createOrReplaceTempView("_skein_roots")
    return spark.sql("""
        WITH RECURSIVE e AS (SELECT node_id AS parent, explode(source_ids) AS child FROM _skein_nodes WHERE source_type = 'nodes'),
        walk(root, node_id, level) AS (SELECT node_id, node_id, 0 FROM _skein_roots UNION ALL SELECT w.root, e.child, w.level + 1 FROM walk w JOIN e ON e.parent = w.node_id)
        SELECT root, node_id, min(level) AS level FROM walk GROUP BY root, node_id""")


def leaf_messages(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """(root, store_id): the messages below each root."""
    own = edges(nodes).filter("child_type = 'messages'").select(F.col("parent").alias("node_id"), F.col("child").alias("store_id"))
    return reach.join(own, "node_id").select("root", "store_id").distinct()


def with_source(nodes: DataFrame, messages: DataFrame, source: Column) -> DataFrame:
    """Nodes with at least one message of a source anywhere below them."""
    hits = leaf_messages(nodes, lineage(nodes, nodes)).join(messages.filter(source).select("store_id"), "store_id", "left_semi").select(F.col("root").alias("node_id")).distinct()
    return nodes.join(hits, "node_id", "left_semi")


class OverlapError(ValueError):
    """Two lineages share leaves and neither holds the other."""


def canonical_frontier(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that cover all leaves once: of equal leaf sets the deepest, then the lowest id; no set within another.

    A node without sources is its own leaf. Only pairs that share a leaf are
    compared. Partial overlap is an error: keeping both would read the shared
    part twice, dropping one would lose the rest.
    """
    reach = lineage(nodes, candidates)
    leaf = nodes.select("node_id", F.col("source_type").alias("t"), F.size("source_ids").alias("k"))
    below = reach.join(leaf, "node_id", "left")
    is_leaf = F.col("t").isNull() | (F.col("t") == "messages") | (F.col("k") <= 0)
    path = f"{shared_dir(nodes.sparkSession)}/leaves-{uuid.uuid4().hex}"
    below.filter(is_leaf).select("root", F.col("node_id").alias("leaf")).distinct().write.parquet(path)  # used three times
    pairs = nodes.sparkSession.read.schema("root long, leaf long").parquet(path)
    sets = pairs.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("leaf")).alias("h"), F.sum(F.xxhash64("leaf").cast("decimal(38,0)")).alias("s"))
    picked = sets.join(candidates.select(F.col("node_id").alias("root"), "depth"), "root").groupBy("n", "h", "s").agg(F.min(F.struct(-F.col("depth"), F.col("root").alias("root"))).getField("root").alias("root")).select("root", "n")
    own = pairs.join(picked, "root")
    both = own.join(own.select(F.col("root").alias("other"), F.col("n").alias("m"), "leaf"), "leaf").filter("root <> other").groupBy("root", "other", "n", "m").agg(F.count(F.lit(1)).alias("shared"))
    if not both.filter("shared < n AND shared < m").isEmpty():
        raise OverlapError("summary lineages overlap in part")
    inside = both.filter("shared = n AND n < m").select("root").distinct()
    chosen = picked.join(inside, "root", "left_anti").select(F.col("root").alias("node_id"))
    return candidates.join(chosen, "node_id", "left_semi")


def expand(nodes: DataFrame, messages: DataFrame, node_id: int, budget: int) -> DataFrame:
    """The sources of a node in their order while their tokens fit the budget, the first in any case."""
    wanted = nodes.filter(F.col("node_id") == node_id).select("source_type", F.posexplode("source_ids").alias("place", "id"))
    m = wanted.filter("source_type = 'messages'").join(messages.select(F.col("store_id").alias("id"), F.col("content").alias("text"), F.col("token_estimate").cast("long").alias("tokens")), "id")
    n = wanted.filter("source_type = 'nodes'").join(nodes.select(F.col("node_id").alias("id"), F.col("summary").alias("text"), F.col("token_count").alias("tokens")), "id")
    used = F.sum("tokens").over(Window.partitionBy("source_type").orderBy("place"))
    return m.unionByName(n).withColumn("used", used).filter((F.col("used") <= budget) | (F.col("place") == 0)).select("place", "source_type", "id", "tokens", "used")


def orphans(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """(node_id, missing) of nodes made of messages of which some are gone."""
    own = edges(nodes).filter("child_type = 'messages'").select(F.col("parent").alias("node_id"), F.col("child").alias("store_id"))
    return own.join(messages.select("store_id"), "store_id", "left_anti").groupBy("node_id").agg(F.count(F.lit(1)).alias("missing"))


def quality(nodes: DataFrame) -> DataFrame:
    """Counts of summaries 400 times shorter than their source, and of those under 500 tokens made from 100,000."""
    ratio = F.col("source_token_count") / F.greatest("token_count", F.lit(1))
    return nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if(ratio >= 400).alias("extreme"), F.count_if((F.col("source_token_count") >= 100_000) & (F.col("token_count") < 500)).alias("tiny"), F.round(F.max(ratio), 6).alias("worst"))


def worst_summaries(nodes: DataFrame, n: int = 5) -> DataFrame:
    ratio = F.col("source_token_count") / F.greatest("token_count", F.lit(1))
    return nodes.select("node_id", F.round(ratio, 6).alias("ratio"), (F.col("token_count") == 0).alias("empty")).orderBy(F.desc("empty"), F.desc("ratio"), "node_id").limit(n)


def condense(nodes: DataFrame, depth: int, fanin: int = 4) -> DataFrame:
    """Parents for every `fanin` uncondensed nodes of a depth in a session; the budget is 40 % of their tokens, 1,000 at least."""
    free = uncondensed(nodes, depth).withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "node_id")) - 1)
    parts = F.array_sort(F.collect_list(F.struct("place", "node_id", "summary")))
    out = free.groupBy("session_id", F.floor(F.col("place") / fanin).alias("g")).agg(parts.alias("p"), F.sum("token_count").alias("source_token_count"), F.min("earliest_at").alias("earliest_at"), F.max("latest_at").alias("latest_at"))
    return out.filter(F.size("p") >= fanin).select(
        "session_id", F.lit(depth + 1).alias("depth"), F.array_join(F.transform("p", lambda x: F.coalesce(x["summary"], F.lit(""))), "\n\n---\n\n").alias("text"), F.transform("p", lambda x: x["node_id"]).alias("source_ids"), "source_token_count",
        F.greatest(F.lit(1000), F.floor(F.col("source_token_count") * 0.4)).cast("long").alias("budget"), "earliest_at", "latest_at",
    )


def describe(nodes: DataFrame, node_id: int) -> str:
    """A node and its immediate children as JSON."""
    node = nodes.filter(F.col("node_id") == node_id).limit(1).toJSON().collect()
    below = children(nodes.filter(F.col("node_id") == node_id).unionByName(nodes.filter(F.col("node_id") != node_id))).filter(F.col("parent") == node_id).orderBy("place").limit(256).toJSON().collect()
    return json.dumps({"node": json.loads(node[0]) if node else None, "children": [json.loads(x) for x in below]})

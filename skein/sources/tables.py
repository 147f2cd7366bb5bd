"""Reading the shipped tables and deriving the engine's model from them."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import token_estimate

EPOCH = 1704067200
#: Turns of a conversation are numbered below this, so ids keep the order of (conversation, turn) without a global sort.
TURNS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, there is a local one on a local master only, where there are no other machines."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given or f"file://{tempfile.gettempdir()}/skein-{os.getpid()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows that much is made of, over all cores: a file holds many of them in one row group, which is one task's."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message table from `conversations`: one narrow projection, no shuffle."""
    c, t = F.col("conv_id"), F.col("turn")
    source = F.when(c % 7 != 0, F.concat(F.lit("src"), (c % 5).cast("string")))
    return table(spark, sf_dir, "conversations").select(
        (c * TURNS + t).alias("store_id"), F.concat(F.lit("c"), c.cast("string")).alias("session_id"), source.alias("source"), F.concat(F.lit("g"), F.floor(c / 4).cast("string")).alias("conversation_id"),
        "role", F.col("text").alias("content"), (F.lit(EPOCH) + c * 3600 + t * 60).cast("double").alias("timestamp"), (4 + token_estimate(F.col("text"))).alias("token_estimate"),
        (c * TURNS + t).isNull().alias("pinned"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary nodes: of every four messages of a session in order (depth 0), of every four leaves (1), of all those (2).

    Ids are session * 1000 + depth * 300 + place, so they too keep an order.
    """
    m = messages(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("store_id")) - 1)
    number = F.expr("cast(substring(session_id, 2) as bigint)")

    def summarise(rows: DataFrame, depth: int, text: str, tokens: Column, start: str, end: str, id_col: str, kind: str) -> DataFrame:
        group = F.floor(F.col("n") / 4) if depth < 2 else F.lit(0).cast("long")
        parts = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(text).alias("t"))))
        out = rows.groupBy("session_id", group.alias("g")).agg(
            F.substring(F.array_join(F.transform(parts, lambda x: F.coalesce(x["t"], F.lit(""))), " "), 1, 200).alias("summary"), F.sum(tokens).cast("long").alias("source_token_count"),
            F.transform(parts, lambda x: x["i"]).alias("source_ids"), F.min(start).alias("earliest_at"), F.max(end).alias("latest_at"),
        )
        return out.select(
            (number * 1000 + depth * 300 + F.col("g")).alias("node_id"), "session_id", F.lit(depth).alias("depth"), "summary", token_estimate(F.col("summary")).cast("long").alias("token_count"), "source_token_count",
            "source_ids", F.lit(kind).alias("source_type"), (F.col("latest_at") + 30).alias("created_at"), "earliest_at", "latest_at", F.col("g").alias("n"),
        )

    leaf = summarise(m, 0, "content", F.col("token_estimate"), "timestamp", "timestamp", "store_id", "messages")
    mid = summarise(leaf, 1, "summary", F.col("token_count"), "earliest_at", "latest_at", "node_id", "nodes")
    top = summarise(mid, 2, "summary", F.col("token_count"), "earliest_at", "latest_at", "node_id", "nodes")
    return leaf.unionByName(mid).unionByName(top).drop("n")


def edges(nodes_: DataFrame) -> DataFrame:
    """(parent, child, child_type) of every source id."""
    return nodes_.select(F.col("node_id").alias("parent"), F.explode("source_ids").alias("child"), F.col("source_type").alias("child_type"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as rows of the vector table; vector v is of turn v % 4 of conversation v div 4."""
    v = F.col("vec_id")
    store_id = F.floor(v / 4) * TURNS + v % 4
    return table(spark, sf_dir, "embeddings").select(
        v.alias("row_id"), store_id.alias("store_id"), F.concat(F.lit("c"), F.floor(v / 4).cast("string")).alias("session_id"), F.expr("cast(embedding as array<double>)").alias("embedding"), "label",
        (F.lit(EPOCH) + F.floor(v / 4) * 3600 + (v % 4) * 60).cast("double").alias("timestamp"), (v % 23 == 0).alias("archived"),
    )


def rollup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with a UTC timestamp and the number in props."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scope"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Messages of session logs in JSON lines, whatever dialect names their fields.

    A row may hold its message at the top or under `message`/`payload`; content
    is a string or a list of parts; calls stand in `tool_calls` or among the
    parts. Lines that are no JSON object keep only their raw text.
    """
    raw = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    v = F.expr("try_parse_json(value)")

    def first(*paths: str) -> Column:
        return F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths))

    roots = ("$", "$.message", "$.payload")
    parts = F.coalesce(*(F.try_variant_get(v, f"{r}.content", "array<struct<type string, text string>>") for r in roots))
    text = F.coalesce(F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n"), first(*(f"{r}.{k}" for r in roots for k in ("content", "text"))))
    return raw.select(
        first(*(f"{r}.{k}" for r in roots for k in ("id", "uuid", "message_id"))).alias("source_key"), first("$.parent_id", "$.parentUuid", "$.parent").alias("parent_key"), first(*(f"{r}.role" for r in roots), "$.type").alias("role"),
        text.alias("content"), first("$.session_id", "$.sessionId", "$.payload.session_id").alias("session_id"), first(*(f"{r}.{k}" for r in roots for k in ("tool_call_id", "call_id"))).alias("tool_call_id"),
        first("$.timestamp", "$.created_at", "$.message.timestamp").alias("timestamp"), F.when(v.isNull(), F.col("value")).alias("malformed"),
    )


def read_archive(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """Messages of a foreign archive over JDBC, in the order of (conversation, seq); needs the database's driver on the class path."""
    query = "SELECT c.session_id, c.session_key, m.message_id, m.conversation_id, m.seq, m.role, m.content, m.token_count, m.created_at FROM messages m JOIN conversations c ON c.conversation_id = m.conversation_id"
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def import_new(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of an import that are not there yet; running it twice adds nothing."""
    return candidates.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def write_snapshot(df: DataFrame, base: str, version: int, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table's next version beside the others and read it; a version being read is never overwritten."""
    path = f"{base}/v{version:08d}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_sidecars(spark: SparkSession, path: str, most_chars: int | None = None) -> DataFrame:
    """Payloads kept as JSON files, one object each; of the content only the first characters where that is enough."""
    schema = "ref string, kind string, session_id string, tool_call_id string, role string, content string, chars long, bytes long"
    rows = spark.read.schema(schema).json(path)
    return rows if most_chars is None else rows.withColumn("content", F.substring("content", 1, most_chars))

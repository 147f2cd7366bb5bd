"""The incremental work as Structured Streaming: counts, sessions, deduplication, invalidation, conversation state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from skein.operators.rollup import invalidated

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Event files as they arrive; the time has a zone, as watermarks need."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def day_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Numbers of each UTC day and kind; a day is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Runs of each user's events without a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once, though sent again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def invalidations(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Stale periods of each batch of change events to `apply`, which must be idempotent for a batch id."""
    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: apply(invalidated(df), i)).start()


class LastSeen(StatefulProcessor):
    """Keeps each user's count of events and greatest event id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "n long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, -1)
        for f in rows:
            n, last = n + len(f), max(last, int(f["event_id"].max()))
        self.state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [last]})

    def close(self) -> None:
        pass


def last_seen(events: DataFrame) -> DataFrame:
    """Frontier of each user after every batch; needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(LastSeen(), "user_id long, n long, last long", "Update", "None")


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its result, a table under `path`; in complete mode that of the last batch, in update mode all updates."""
    spark, last = df.sparkSession, []
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", f"{path}/all")
    else:
        writer = df.writeStream.outputMode(mode).foreachBatch(lambda out, i: (out.write.mode("overwrite").parquet(f"{path}/{i}"), last.append(i)))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    folders = ["all"] if mode == "append" else [str(i) for i in (last[-1:] if mode == "complete" else last)]
    return spark.read.schema(df.schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], df.schema)

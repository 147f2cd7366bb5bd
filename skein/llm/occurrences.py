"""First and later occurrences of hashes, streamed over a range partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import written

LATER, OPEN, EDGE = 0, 1, 2


def _stream(batches: Iterator[pa.RecordBatch], least: int, by_doc: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h1, h2, ord, pos): those beyond the first unit of a key of `least` units.

    A unit is a document or, without `by_doc`, a single row. Memory holds a
    batch and, of the key at its end, the rows of units 2 to `least - 1`. The
    keys at a part's two ends may go on in the parts beside it: of the first key
    the rows of its first unit here, of both those undecided are passed on as
    OPEN, with an EDGE row of what this part has of the key (pos: the part;
    size: its first pos).
    """
    names = ["h1", "h2", "ord", "pos", "size"]

    def rows(columns: list[np.ndarray], kind: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(kind), pa.array(np.zeros(len(kind), np.int64)), pa.array(columns[2])], names=[*names, "kind", "units", "last"])

    def edge() -> pa.RecordBatch:
        values = [np.array([x], t) for x, t in ((key[0], np.int64), (key[1], np.int64), (head[0], np.int64), (part, np.int32), (head[1], np.int32), (EDGE, np.int8), (units, np.int64), (last, np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=[*names, "kind", "units", "last"])

    key = first_key = held = part = None
    units, last, head = 0, 0, (0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, order, pos, size = columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        n, now = len(h1), (int(h1[0]), int(h2[0]))
        new_key = np.ones(n, bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_unit = np.ones(n, bool)
        if by_doc:
            new_unit[1:] = new_key[1:] | (order[1:] != order[:-1])
        starts = np.flatnonzero(new_key)
        lengths = np.diff(np.append(starts, n))
        ends, run = starts + lengths - 1, np.repeat(np.arange(len(starts)), lengths)
        unit = np.cumsum(new_unit)
        rank = unit - unit[starts][run] + 1  # 1: the key's first unit
        if part is None:
            part, first_key = batch.column(batch.schema.get_field_index("part"))[0].as_py(), now
        if now == key:
            rank[: ends[0] + 1] += units - int(by_doc and int(order[0]) == last)
            if held is not None and rank[ends[0]] >= least:
                yield from (rows(h, np.full(len(h[0]), LATER, np.int8)) for h in held)
                held = None
        elif key is not None and key == first_key:
            yield from (rows(h, np.full(len(h[0]), OPEN, np.int8)) for h in held or [])
            yield edge()
        if now != key:
            head = (int(order[0]), int(pos[0]))
            held = None
        first = now == first_key
        kind = np.where((rank > 1) & (rank[ends] >= least)[run], LATER, -1).astype(np.int8)
        if first:
            ended = len(starts) > 1 and rank[ends[0]] < least
            kind[: ends[0] + 1][(rank[: ends[0] + 1] == 1) | ended] = OPEN
            if ended:
                yield from (rows(h, np.full(len(h[0]), OPEN, np.int8)) for h in held or [])
        if (kind >= 0).any():
            yield rows([c[kind >= 0] for c in columns], kind[kind >= 0])
        if len(starts) > 1:
            if first:
                key, units, last = now, int(rank[ends[0]]), int(order[ends[0]])
                yield edge()
            held, head = None, (int(order[starts[-1]]), int(pos[starts[-1]]))
        if rank[-1] < least:
            wait = (run == len(starts) - 1) & (rank > 1)
            held = [*(held or []), [c[wait] for c in columns]] if wait.any() else held
        key, units, last = (int(h1[-1]), int(h2[-1])), int(rank[-1]), int(order[-1])
    if key is not None:
        yield from (rows(h, np.full(len(h[0]), OPEN, np.int8)) for h in held or [])
        yield edge()


def later_occurrences(rows: DataFrame, *, least: int, by_doc: bool) -> DataFrame:
    """Of rows (h1, h2, ord, pos, size): (ord, pos, size) of all rows beyond the first unit of keys with `least` units or more.

    Rows are range-partitioned by (h1, h2, ord, pos) and sorted within the
    parts, so the rows of one frequent key may fill many parts and no task holds
    a key. What the parts know of the keys at their ends (two rows each at most)
    settles the rows passed on as open; that table alone is broadcast.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["h1", "h2", "ord", "pos"]
    dealt = rows.select("h1", "h2", F.col("ord").cast("long"), F.col("pos").cast("int"), F.col("size").cast("int")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("part", F.spark_partition_id())
    out = dealt.mapInArrow(lambda b: _stream(b, least, by_doc), "h1 long, h2 long, ord long, pos int, size int, kind byte, units long, last long")
    out = written(out, "later")
    edges = out.filter(F.col("kind") == EDGE)  # pos: the part; size: the first pos there
    w = Window.partitionBy("h1", "h2").orderBy("pos")
    again = F.when(F.lag("last").over(w) == F.col("ord"), 1).otherwise(0) if by_doc else F.lit(0)
    known = edges.withColumn("again", again).groupBy("h1", "h2").agg((F.sum("units") - F.sum("again")).alias("n"), F.min_by(F.struct("ord", "size"), "pos").alias("head"))
    opened = out.filter(F.col("kind") == OPEN).join(F.broadcast(known.filter(F.col("n") >= least)), ["h1", "h2"])
    first = F.col("ord") == F.col("head.ord")
    opened = opened.filter(~first if by_doc else ~(first & (F.col("pos") == F.col("head.size"))))
    return out.filter(F.col("kind") == LATER).select("ord", "pos", "size").unionByName(opened.select("ord", "pos", "size"))

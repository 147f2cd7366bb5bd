"""Shards of near equal bytes by histogram sort: probe, count, refine, exchange once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import written

#: Candidate boundaries counted in a round for each splitter that is still open.
PROBES = 256
#: A splitter between two groups is taken when it misses its target by at most this share of a shard.
TOLERANCE = 0.01
LOW, HIGH = -(2**63), 2**63 - 1


def _histogram(thin: DataFrame, key: str, within: list[Column], ranges: list[tuple[int, int]]) -> list[dict[int, tuple[int, int, int]]]:
    """For each open range [lo, hi] of a 64-bit key: bin -> (bytes, least and greatest key in it).

    The driver receives at most PROBES rows for each range; ranges that are the
    same (in the first round all are) are counted once.
    """
    distinct = list(dict.fromkeys((str(w), r) for w, r in zip(within, ranges, strict=True)))
    columns = {str(w): w for w in within}
    tags = [F.when(columns[w] & F.col(key).between(lo, hi), F.struct(F.lit(i).alias("i"), _bin(F.col(key), lo, hi).alias("b"))) for i, (w, (lo, hi)) in enumerate(distinct)]
    bins = thin.select(key, "size", F.explode(F.array_compact(F.array(*tags))).alias("t")).groupBy("t.i", "t.b").agg(F.sum("size").alias("s"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    out: list[dict[int, tuple[int, int, int]]] = [{} for _ in distinct]
    for r in bins.collect():
        out[r["i"]][r["b"]] = (int(r["s"]), r["lo"], r["hi"])
    return [out[distinct.index((str(w), r))] for w, r in zip(within, ranges, strict=True)]


def _bin(key: Column, lo: int, hi: int) -> Column:
    """Equal-width bin of a key in [lo, hi]; never falls as the key grows, which is all that the counts need."""
    width = max(1, -(-(hi - lo + 1) // PROBES))
    ahead = key.cast("double") - float(lo) if hi - lo >= 2**62 else (key - F.lit(lo)).cast("double")
    return F.floor(ahead / float(width)).cast("int")


def _refine(thin: DataFrame, key: str, within: list[Column], targets: list[int], below: list[int], slack: int, last: bool) -> list[tuple[int, int, bool]]:
    """For each target: (greatest key that goes left, bytes up to it, met); unmet: the key whose rows straddle the target, and the bytes before it."""
    n = len(targets)
    ranges, base, lower, done = [(LOW, HIGH)] * n, list(below), [None] * n, [None] * n
    while any(x is None for x in done):
        todo = [i for i in range(n) if done[i] is None]
        counts = _histogram(thin, key, [within[i] for i in todo], [ranges[i] for i in todo])
        for j, i in enumerate(todo):
            at, prev = base[i], lower[i]
            for b in sorted(counts[j]):
                s, lo, hi = counts[j][b]
                if at + s >= targets[i]:
                    break
                at, prev = at + s, hi
            else:
                done[i] = (HIGH, at, True)
                continue
            before, after = targets[i] - at, at + s - targets[i]
            if min(before, after) <= slack and (after <= before or prev is not None):
                done[i] = (hi, at + s, True) if after <= before else (prev, at, True)
            elif lo == hi:
                nearer = (LOW if prev is None else prev, at, True) if before < after else (hi, at + s, True)
                done[i] = nearer if last else (lo, at, False)
            else:
                ranges[i], base[i], lower[i] = (lo, hi), at, prev
    return done


def histogram_shards(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Every document with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`. A size is the text's bytes in UTF-8 (null: none) plus 1.
    Rows are put in the order of (hash of the text, id); equal texts lie side by
    side and share a shard, unless a group is so large that the law needs a cut
    within it. Splitters are found by rounds of exact byte counts below PROBES
    candidate boundaries, narrowed around each target; where the rows of one
    hash straddle a target, the same is done on their ids. Then one exchange
    orders the rows, and a slot is the row's place in its part plus the rows of
    the shard in earlier parts (a table of one row per part and shard).

    The ids are taken as integers. Null ids come first, a null text hashes by
    itself; repeated rows each get their own slot; an empty table gives an empty
    result. Other columns are not read.
    """
    thin = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text_col).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW + 1)).alias("k"),
        ), "shards",
    )
    total = thin.agg(F.sum("size")).first()[0] or 0
    targets = [total * i // shards for i in range(1, shards)]
    slack = int(tolerance * total / shards)
    cuts = _refine(thin, "h", [F.lit(True)] * len(targets), targets, [0] * len(targets), slack, False) if total else []
    open_ = [i for i, c in enumerate(cuts) if not c[2]]
    ends: list[tuple[int, int]] = [(c[0], HIGH) for c in cuts]
    if open_:
        inner = _refine(thin, "k", [F.col("h") == cuts[i][0] for i in open_], [targets[i] for i in open_], [cuts[i][1] for i in open_], 0, True)
        for i, c in zip(open_, inner, strict=True):
            ends[i] = (cuts[i][0], c[0])
    shard = F.lit(0)
    for h, k in ends:
        shard = shard + F.when((F.col("h") > h) | ((F.col("h") == h) & (F.col("k") > k)), 1).otherwise(0)
    parts = max(1, int(thin.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = thin.repartitionByRange(parts, "h", "k").sortWithinPartitions("h", "k")
    dealt = written(dealt.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.monotonically_increasing_id().alias("at")), "dealt")
    part = F.shiftright("at", 33)
    parts_of = dealt.groupBy(part.alias("part"), "shard").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts_of.select("part", "shard", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    out = dealt.withColumn("part", part).join(F.broadcast(starts), ["part", "shard"])  # parts + shards - 1 rows at most
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first") + F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

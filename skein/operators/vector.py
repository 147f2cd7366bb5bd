"""Vectors: normalisation, quantisation, sign bits, exact and two-stage nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import let

#: Query vectors that one pass is broadcast for, at most; more go in blocks. Scores a worker holds at once, and pairs it works out exactly at once.
QUERY_BLOCK = 8192
SCORES, PAIRS = 1 << 20, 1 << 16
#: What the scores of a matrix product may be off, many times over; unit vectors of 64 numbers differ by 1e-14.
OFF = 1e-9
CANDIDATES, PRESCREEN = 2000, 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column, dim: int) -> Column:
    """The unit vector; null for another dimension, a number that isn't finite, or length zero."""

    def of(length: Column) -> Column:
        fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)) & (length > 0)
        return F.when(fine, F.transform(v, lambda x: x.cast("double") / length))

    return let(F.sqrt(dot(v, v)), of)


def int8(v: Column) -> Column:
    """(q, scale): symmetric quantisation to +-127, rounding half to even."""
    scale = F.array_max(F.transform(v, lambda x: F.abs(x))) / 127
    return F.when(scale > 0, F.struct(F.transform(v, lambda x: F.greatest(F.least(F.bround(x / scale), F.lit(127)), F.lit(-127)).cast("byte")).alias("q"), scale.alias("scale")))


def from_int8(q: Column) -> Column:
    return F.transform(q["q"], lambda x: x.cast("double") * q["scale"])


def sign_words(v: Column, dim: int) -> Column:
    """Signs (1: not negative) in words of 64 bits, the first sign highest."""
    words = []
    for w in range(0, dim, 64):
        part = F.slice(v, w + 1, 64)
        words.append(F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x >= 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def candidates(vectors: DataFrame, where: Column | None = None, bound: int | None = CANDIDATES) -> DataFrame:
    """Rows that aren't archived and pass the filter, the newest `bound` of them (null: all)."""
    rows = vectors.filter(~F.coalesce("archived", F.lit(False)))
    rows = rows.filter(where) if where is not None else rows
    return rows.orderBy(F.desc("timestamp"), F.desc("row_id")).limit(bound) if bound else rows


def knn(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, bound: int | None = CANDIDATES) -> DataFrame:
    """The k nearest by cosine (row_id, score, coverage), ties by the newer row; coverage is `bounded` only if rows were left out."""
    dim, q = len(query), F.array(*(F.lit(float(x)) for x in query))
    rows = candidates(vectors, where, bound)
    cut = bool(bound) and candidates(vectors, where, None).limit(bound + 1).count() > bound
    scored = rows.select("row_id", dot(normalized(F.col("embedding"), dim), normalized(q, dim)).alias("score")).filter(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), F.desc("row_id")).limit(k).withColumn("coverage", F.lit("bounded" if cut else "full"))


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """(query_id, row_id, score, place) of the k nearest of every query vector against all rows that aren't archived.

    Row ids are whole numbers. Queries go to all executors in blocks of
    QUERY_BLOCK; a task scores its rows in matrices of SCORES at most, keeps k
    rows of each query and shuffles these. Products of matrices only choose who
    may be among the k: their scores are then summed in order of the dimensions.
    """
    unit = candidates(vectors, None, None).select("row_id", normalized(F.col("embedding"), dim).alias("v")).filter(F.col("v").isNotNull())
    asked = queries.select("query_id", normalized(F.col("embedding"), dim).alias("q")).filter(F.col("q").isNotNull())
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, row_id long, score double"
    n = asked.count()
    blocks = -(-n // QUERY_BLOCK) if n else 1
    out = None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        held = own.toArrow().combine_chunks()  # a block
        matrix = _matrix(held["q"].combine_chunks(), dim)
        sent = vectors.sparkSession.sparkContext.broadcast((held["query_id"].to_pylist(), matrix))
        best = unit.mapInArrow(_scan(sent, k, dim), schema)
        out = best if out is None else out.unionByName(best)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("row_id")))
    return out.withColumn("place", place).filter(F.col("place") <= k)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(-1, dim)


def _scan(sent, k: int, dim: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        if not ids:
            return
        held = _Nearest(asked, k)
        for batch in batches:
            rows, unit = np.asarray(batch["row_id"]), _matrix(batch["v"], dim)
            step = max(k + 1, SCORES // len(ids))
            for a in range(0, len(rows), step):
                held.add(rows[a : a + step], unit[a : a + step])
        held.settle()
        for a in range(0, len(held.q), PAIRS):
            part = slice(a, a + PAIRS)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in held.q[part]]), pa.array(held.row[part]), pa.array(held.score[part])], names=["query_id", "row_id", "score"])

    return scan


class _Nearest:
    """The k nearest rows of each query among those added, ties by the greater row id."""

    def __init__(self, asked: np.ndarray, k: int) -> None:
        self.asked, self.k = asked, k
        self.least = np.full(len(asked), -np.inf)  # what the k-th of each query reaches, at least
        self.q, self.row, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.new, self.waiting = [], 0

    def add(self, rows: np.ndarray, unit: np.ndarray) -> None:
        near = unit @ self.asked.T
        may = near >= self.least - OFF
        if len(rows) > self.k and np.count_nonzero(may) > 2 * self.k * len(self.asked):
            may &= near >= np.partition(near, len(rows) - self.k, axis=0)[len(rows) - self.k] - OFF
        i, j = np.nonzero(may)
        for a in range(0, len(i), PAIRS):
            r, q = i[a : a + PAIRS], j[a : a + PAIRS]
            score = np.zeros(len(r))
            for x in range(unit.shape[1]):
                score += unit[r, x] * self.asked[q, x]
            self.new.append((q, rows[r], score))
            self.waiting += len(r)
            if self.waiting >= max(PAIRS, self.k * len(self.asked)):
                self.settle()

    def settle(self) -> None:
        q, row, score = (np.concatenate(x) for x in zip((self.q, self.row, self.score), *self.new, strict=True))
        order = np.lexsort((~row, -score, q))
        q, row, score = q[order], row[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.q, self.row, self.score = (x[place < self.k] for x in (q, row, score))
        last = place == self.k - 1
        self.least[q[last]] = score[last]
        self.new, self.waiting = [], 0


def knn_two_stage(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, mult: int = PRESCREEN) -> DataFrame:
    """The k nearest by signs first: coverage is full_approx, as of a path by signs, but no neighbour is missed.

    The mult * k rows of least Hamming distance are ranked exactly; their k-th
    score is reached by all of the k nearest. A unit row's cosine is at most the
    length of the unit query over the signs they share, so the rows whose bound
    reaches that score are all that can be among the k, and are ranked exactly.
    How many they are is left to the data; fewer than k scores bound nothing.
    """
    dim, q = len(query), F.array(*(F.lit(float(x)) for x in query))
    rows = candidates(vectors, where, None)
    score = dot(normalized(F.col("embedding"), dim), normalized(q, dim)).alias("score")
    near = rows.select("row_id", "embedding", hamming(sign_words(F.col("embedding"), dim), sign_words(q, dim)).alias("distance")).orderBy("distance", F.desc("row_id")).limit(max(k, mult * k))
    best = near.select(score).filter(F.col("score").isNotNull()).orderBy(F.desc("score")).limit(k)
    least = best.agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    shared = F.aggregate(F.zip_with("embedding", normalized(q, dim), lambda x, y: F.when((x >= 0) == (y >= 0), y * y).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    reach = rows.crossJoin(F.broadcast(least)).filter(F.col("least").isNull() | (F.sqrt(shared) >= F.col("least") - 1e-9))
    scored = reach.select("row_id", score).filter(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), F.desc("row_id")).limit(k).withColumn("coverage", F.lit("full_approx"))


def identity_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def resolve_profile(profiles: DataFrame, model: str, provider: str | None = None) -> DataFrame:
    """The profile to use for a model: active first, then the latest registered, then by hash."""
    rows = profiles.filter(F.col("model") == model)
    rows = rows.filter(F.col("provider") == provider) if provider else rows
    return rows.orderBy(F.desc("active"), F.desc("registered_at"), F.desc("identity_hash")).limit(1)


def pending(nodes: DataFrame, embedded: DataFrame, inflight: DataFrame, identity: str) -> DataFrame:
    """Leaf summaries without a vector and not under way, newest first."""
    own = lambda t: t.filter(F.col("identity_hash") == identity).select(F.col("embedded_id").cast("long").alias("node_id"))
    rest = nodes.filter("depth = 0").join(own(embedded), "node_id", "left_anti").join(own(inflight), "node_id", "left_anti")
    return rest.orderBy(F.desc("created_at"), F.desc("node_id"))


def publish(vectors: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The vector table with a batch in it; rows of the same key are replaced."""
    return vectors.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def purge(vectors: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return vectors.join(deleted.select(key).distinct(), key, "left_anti")

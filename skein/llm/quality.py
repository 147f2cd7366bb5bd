"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.textops import SPACE, TO_LOWER, Hasher, blocks, group_bounds, spans, text_bytes

#: Labelled documents that the field is fitted on, and lines of them, at most.
SAMPLE, SAMPLE_LINES = 6000, 200_000
THRESHOLD = 0.3
BASE_FEATURES = 14


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


UPPER, LOWER, DIGIT, HIGH = _class((65, 90)), _class((97, 122)), _class((48, 57)), _class((128, 255))
PLAIN = _class(*((ord(c), ord(c)) for c in ".,;:?'\"-()"))
SYMBOL = ~(UPPER | LOWER | DIGIT | HIGH | PLAIN | SPACE)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (rows), the lines' lengths, and where each text's lines begin."""
    n = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    owner = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, feeds, "right") - 1]), kind="stable")
    first = group_bounds(owner, n)
    ends = np.append(begins[1:], offsets[-1])
    length = (ends - begins).astype(np.float64)

    def share(mark: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mark)])
        return (sums[ends] - sums[begins]) / np.maximum(length, 1)

    accented = np.zeros(len(data), bool)  # capital letters of two bytes, C3 80 to C3 9E
    if len(data) > 1:
        accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    starts, stops, _ = spans(~SPACE[data], offsets)
    words = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    at = np.searchsorted(starts, begins)
    line = np.repeat(np.arange(len(begins)), words)
    h = Hasher(TO_LOWER[data])(starts, stops) if len(starts) else np.zeros(0, np.uint64)
    doc = owner[line]
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    seen = np.zeros(len(h))
    if len(h):
        again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        seen[order[1:]] = again
    total = np.maximum(words, 1)

    def per_word(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(x)])
        return (sums[at + words] - sums[at]) / total

    symbols, upper = SYMBOL[data], UPPER[data] | accented
    ends_odd = SYMBOL[data[stops - 1]].astype(float) if len(stops) else np.zeros(0)
    lone = ((stops - starts) == 1) & symbols[starts] if len(starts) else np.zeros(0)
    doc_words = np.maximum(np.bincount(owner, words, n), 1)
    doc_seen = np.bincount(doc, seen, n) / doc_words if len(h) else np.zeros(n)
    base = np.stack([
        np.log1p(length) / 10, share(upper), share(symbols), np.sqrt(share(symbols)), share(DIGIT[data]), share(data == 33), np.sqrt(share(data == 124)), per_word(same), per_word(seen),
        doc_seen[owner], per_word(ends_odd), per_word(lone.astype(float)), np.minimum((length - words) / total / 20, 2), (words == 0).astype(float),
    ], axis=1)
    return base, length + 1, first


def with_neighbours(base: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's own features, those of the lines before and after it (none at a text's ends), and a constant."""
    before, after = np.zeros_like(base), np.zeros_like(base)
    if len(base):
        before[1:], after[:-1] = base[:-1], base[1:]
        before[first[:-1]] = 0
        after[first[1:] - 1] = 0
    return np.concatenate([base, before, after, np.ones((len(base), 1))], axis=1)


def marginals(score: np.ndarray, transition: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(line is good) by forward-backward, expected transitions (2 x 2) summed over all chains, and log Z of each chain.

    Chains are taken longest first, so one step covers all that reach so far.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    emit = np.stack([np.zeros(len(score)), score], axis=1)
    reach = [int(k) for k in np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")]
    for t, k in enumerate(reach):
        i = start[:k] + t
        if t:
            a = alpha[i - 1]
            alpha[i] = np.stack([np.logaddexp(a[:, 0] + transition[0, j], a[:, 1] + transition[1, j]) for j in (0, 1)], axis=1) + emit[i]
        else:
            alpha[i] = emit[i]
    pairs = np.zeros((2, 2))
    tail = start + length - 1
    log_z = np.logaddexp(alpha[tail, 0], alpha[tail, 1])
    for t in range(len(reach) - 2, -1, -1):
        k = reach[t + 1]
        i = start[:k] + t
        nxt = beta[i + 1] + emit[i + 1]
        beta[i] = np.stack([np.logaddexp(transition[j, 0] + nxt[:, 0], transition[j, 1] + nxt[:, 1]) for j in (0, 1)], axis=1)
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] += np.exp(alpha[i, a] + transition[a, b] + nxt[:, b] - log_z[:k]).sum()
    good = alpha[:, 1] + beta[:, 1]
    p = 1 / (1 + np.exp(np.clip(alpha[:, 0] + beta[:, 0] - good, -700, 700)))
    z = np.zeros(len(first) - 1)
    z[order] = log_z
    return p, pairs, z


@dataclass
class LineField:
    """Weights of the line features, of neighbouring labels, and the document calibration (slope, offset)."""

    weights: np.ndarray
    transition: np.ndarray
    calibration: tuple[float, float]

    def share_good(self, base: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        p, _, _ = marginals(with_neighbours(base, first) @ self.weights, self.transition, first)
        at = first[:-1]
        return np.add.reduceat(p * length, at) / np.add.reduceat(length, at) if len(at) else np.zeros(0)

    def score(self, share: np.ndarray) -> np.ndarray:
        share = np.clip(share, 1e-6, 1 - 1e-6)
        x = self.calibration[0] * np.log(share / (1 - share)) + self.calibration[1]
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _adam(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def fit_field(base: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray, *, steps: int = 150, l2: float = 1e-4) -> LineField:
    """Maximum likelihood with the document's label on each of its lines; chains weigh alike whatever their length."""
    x = with_neighbours(base, first)
    n, k = len(label), x.shape[1]
    line_label = np.repeat(label, np.diff(first)).astype(float)
    prior = (label.sum() + 1) / (n + 2) if n else 0.5
    if not n or len(set(label.tolist())) < 2:
        return LineField(np.zeros(k), np.zeros((2, 2)), (0.0, float(np.log(prior / (1 - prior)))))
    same = np.ones(len(line_label), bool)
    same[first[:-1]] = False
    seen = np.zeros((2, 2))
    for j in (0, 1):
        seen[j, j] = float((line_label[same] == j).sum())

    def grad(theta: np.ndarray) -> np.ndarray:
        p, pairs, _ = marginals(x @ theta[:k], theta[k:].reshape(2, 2), first)
        return np.concatenate([x.T @ (p - line_label) / len(x) + l2 * theta[:k], ((pairs - seen) / len(x) + l2 * theta[k:].reshape(2, 2)).reshape(-1)])

    theta = _adam(grad, np.zeros(k + 4), steps, 0.1)
    field = LineField(theta[:k], theta[k:].reshape(2, 2), (1.0, 0.0))
    share = np.clip(field.share_good(base, length, first), 1e-6, 1 - 1e-6)
    z = np.log(share / (1 - share))

    def slope(c: np.ndarray) -> np.ndarray:
        d = 1 / (1 + np.exp(-np.clip(c[0] * z + c[1], -60, 60))) - label
        return np.array([(d * z).mean() + 1e-3 * c[0], d.mean()])

    c = _adam(slope, np.array([0.5, 0.0]), 400, 0.05)
    field.calibration = (float(c[0]), float(c[1]))
    return field


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j, part, at in blocks(data, offsets, 1 << 18):
            base, length, first = line_features(part, at)
            lists = [pa.ListArray.from_arrays(pa.array((first * k).astype(np.int32)), pa.array(v.reshape(-1).astype(np.float32))) for k, v in ((BASE_FEATURES, base), (1, length))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists], names=["quality", "base", "length"])


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", usable: Column | None = None, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> LineField:
    """Fit on `sample` labelled documents at most, those of least hash of the id; one scan, the sampled labels are broadcast.

    The driver gets the features of their lines, whole documents in the same
    order until the next would bring more than `sample_lines` lines in all. Rows
    repeated with one id each count as a document of its label, of several
    labels the least. Without a label, or with labels of one kind, the field
    scores all texts alike.
    """
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    chosen = chosen.filter(usable) if usable is not None else chosen
    chosen = chosen.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    thin = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    lines = F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    counts = thin.select(F.xxhash64("_id").alias("_h"), "_id", F.coalesce(lines, F.lit(1)).cast("long").alias("_n"))
    sizes = sorted((r._h, str(r._id), r._n) for r in counts.orderBy("_h", "_id", "_n").limit(2 * sample).collect())  # a row a document of the sample
    total = np.cumsum([n for _, _, n in sizes])
    within = min(int(np.searchsorted(total, sample_lines, "right")), 2 * sample - 1)
    if within < len(sizes):  # the documents from this one on would be too many, or too long
        thin = thin.filter(F.xxhash64("_id") < sizes[within][0])
    got = thin.select("_label", "_text").mapInArrow(_features, "quality int, base array<float>, length array<float>").toArrow()
    if not got.num_rows:
        return fit_field(np.zeros((0, BASE_FEATURES)), np.zeros(0), np.zeros(1, int), np.zeros(0))
    length = got.column("length").combine_chunks()
    first = np.append(0, np.cumsum(pa.compute.list_value_length(length).to_numpy(zero_copy_only=False)))
    base = got.column("base").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BASE_FEATURES).astype(float)
    return fit_field(base, length.flatten().to_numpy(zero_copy_only=False).astype(float), first, got.column("quality").to_numpy())


def score_quality(docs: DataFrame, field: LineField, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of docs, then score (0 to 1, higher: better) and predicted (1 if score >= threshold).

    Every line of the whole text is labelled in its chain; a document's quality
    is the mean of its lines' marginals by length, calibrated. A null or empty
    text is one empty line and gets that line's score. Columns of these names are
    replaced.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(names.index(text_col)))
            scores = [np.zeros(0)]
            for _, _, part, at in blocks(data, offsets, 1 << 18):
                scores.append(field.score(field.share_good(*line_features(part, at))))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, f"{schema}, score double, predicted int")

"""Language of a text from averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.textops import SPACE, TO_LOWER, blocks, text_bytes

#: Documents that the model is fitted on, at most; hash buckets; width of an embedding; lengths of subwords in bytes.
SAMPLE, BUCKETS, WIDTH, ORDERS = 3000, 1 << 14, 16, (2, 3, 4)
UNDETERMINED = "und"
_letters = np.zeros(256, bool)
_letters[[*range(65, 91), *range(97, 123)]] = True
#: Letters keep their byte (A-Z lowered), white space is one sign, all else another: digits and signs say little.
_symbol = np.where(_letters | (np.arange(256) >= 128), TO_LOWER, np.where(SPACE, 32, 35)).astype(np.uint32)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket of the subword at each byte, and which of them lie within one text."""
    code = _symbol[data]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    for n in ORDERS:
        h = np.full(len(code), n, np.uint32)
        for k in range(n):
            h[: len(code) - k] = (h[: len(code) - k] ^ code[k:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x85EBCA6B) >> np.uint32(18)).astype(np.int32) & (BUCKETS - 1), left >= n


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_letters[data])])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class LanguageModel:
    """Languages, bucket scores (embedding times output weights), offsets, temperature, and the score below which a text is rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each language for each text; a text without subwords gets the offsets alone."""
        n, total, count = len(offsets) - 1, 0.0, 0.0
        cut = np.append(0, np.cumsum(np.diff(offsets)))
        for bucket, within in subwords(data, offsets):
            values = self.table[bucket] * within[:, None]
            sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
            total = total + sums[cut[1:]] - sums[cut[:-1]]
            inside = np.concatenate([[0], np.cumsum(within)])
            count = count + inside[cut[1:]] - inside[cut[:-1]]
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature if n else np.zeros((0, len(self.languages)))
        return _softmax(logits)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True) if len(x) else x


def fit_language(rows: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, languages: list[str], *, epochs: int = 6, rate: float = 0.5, seed: int = 0) -> LanguageModel:
    """Stochastic gradient descent over documents given as buckets and their shares; a fifth is kept to calibrate on."""
    rng = np.random.default_rng(seed)
    k, n = len(languages), len(rows)
    embed, out, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, k)), np.zeros(k)
    kept = np.arange(n) % 5 == 4 if n >= 50 else np.zeros(n, bool)
    train = np.flatnonzero(~kept)
    for epoch in range(epochs if k > 1 else 0):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            x = weights[i] @ embed[rows[i]]
            d = _softmax((x @ out + bias)[None])[0]
            d[labels[i]] -= 1
            back = out @ d
            out -= step * np.outer(x, d)
            bias -= step * 0.1 * d
            embed[rows[i]] -= step * 20 * weights[i][:, None] * back
    table = embed @ out
    held = np.flatnonzero(kept) if kept.any() else train
    logits = np.stack([weights[i] @ table[rows[i]] + bias for i in held]) if len(held) else np.zeros((0, k))
    own = labels[held]

    def loss(t: float) -> float:
        return float(-np.log(_softmax(logits / t)[np.arange(len(held)), own] + 1e-12).mean()) if len(held) else 0.0

    temperature = min((2.0**e for e in np.arange(-5, 5.25, 0.25)), key=loss)
    p = _softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == own] if len(held) else np.zeros(0)
    return LanguageModel(languages, table.astype(np.float32), bias, temperature, float(np.quantile(right, 0.01)) if len(right) else 0.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j, part, at in blocks(data, offsets, 1 << 18):
            both = list(subwords(part, at))
            rows, shares = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                c = np.bincount(np.concatenate([x[a:b][w[a:b]] for x, w in both]), minlength=BUCKETS)
                rows.append(np.flatnonzero(c).astype(np.int32))
                shares.append((c[rows[-1]] / max(1, c.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["lang", "rows", "shares"])


def train_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None, sample: int = SAMPLE) -> LanguageModel:
    """Fit on at most `sample` documents with a language and a text, a like number for each language, those of least hash of the id.

    The languages seen are counted over all usable rows; the driver gets one
    row for each, and the sample's bucket counts. One more scan picks the sample
    of all languages: each task keeps its own first rows of a language before
    the shuffle. Rows repeated with one id and language count once. Without a
    usable row the model knows `und` alone.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    known = known.filter(usable) if usable is not None else known
    languages = sorted(r[0] for r in known.groupBy(F.col(lang_col)).agg(F.count(F.lit(1))).collect())
    if not languages:
        return LanguageModel([UNDETERMINED], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    each = -(-sample // len(languages))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    picked = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).withColumn("_n", place).filter(F.col("_n") <= each).select("_id", "_lang")
    thin = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).join(F.broadcast(picked.distinct()), ["_id", "_lang"]).select("_lang", "_text")
    got = thin.mapInArrow(_counted, "lang string, rows array<int>, shares array<float>").toArrow()
    labels = np.array([languages.index(x) for x in got.column("lang").to_pylist()], int)
    rows, shares = ([np.asarray(x) for x in got.column(c).to_numpy()] for c in ("rows", "shares"))
    order = np.argsort([hash((int(r.sum()), len(r))) for r in rows], kind="stable")  # not in the order of files
    return fit_language([rows[i] for i in order], [shares[i].astype(np.float64) for i in order], labels[order], languages)


def identify_language(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, then lang_pred, score (0 to 1) and rejected.

    Subwords of the whole text are averaged. lang_pred is `und` with score 0
    for texts that are null, empty or without a letter; `rejected` marks these
    and texts whose score lies below that of 99 in 100 texts of the calibration
    set that were right. Columns of these names are replaced.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            data, offsets = text_bytes(batch.column(names.index(text_col)))
            best, score = [np.zeros(0, int)], [np.zeros(0)]
            for _, _, part, at in blocks(data, offsets, 1 << 18):
                p = model.probabilities(part, at)
                letters = has_letter(part, at)
                best.append(np.where(letters, p.argmax(axis=1), len(model.languages)))
                score.append(np.where(letters, p.max(axis=1), 0.0))
            best, score = np.concatenate(best), np.concatenate(score)
            columns = [pa.array(known[best], pa.string()), pa.array(score), pa.array((best == len(model.languages)) | (score < model.reject_below))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")

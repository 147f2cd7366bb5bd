"""Passages that repeat: hashes of sliding spans of sentences, joined over all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import written
from skein.llm.occurrences import later_occurrences
from skein.llm.textops import BASE, BASE_INVERSE, SPACE, TO_LOWER, Hasher, U, blocks, mix, powers, spans, text_bytes

#: A span is the shortest run of at least SENTENCES sentences that has at least WORDS words.
SENTENCES, WORDS = 2, 20
ENDS = np.zeros(256, bool)
ENDS[[0x2E, 0x21, 0x3F]] = True  # . ! ?
#: What ends a sentence with `whole`, and what may stand behind it in the word: ASCII signs but , : ; and these.
STOPS = [x.encode() for x in "\u3002\uff01\uff1f\uff0e\uff61\u2026\u203c\u2047\u2048\u2049\u061f\u06d4\u0964\u0965\u0589\u1362"]
CLOSING = [x.encode() for x in "\u201d\u2019\u201c\u2018\u00bb\u203a\u00ab\u2039\u300d\u300f\uff09\u300b\u3009\u3011"]
SIGN = np.zeros(256, np.int8)  # 1: closing, 2: a stop
SIGN[[i for i in range(0x21, 0x7F) if not chr(i).isalnum() and chr(i) not in ",:;"]] = 1
SIGN[ENDS] = 2


def stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word whether its last sign, closing ones left out, is a stop."""
    sign = SIGN[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        more = np.append(data, np.zeros(2, np.uint8)).astype(np.int32)
        two = more[lead] << 8 | more[lead + 1]
        code = {2: two, 3: two << 8 | more[lead + 2]}
        for n, codes in code.items():
            closing = lead[np.isin(codes, [int.from_bytes(x, "big") for x in CLOSING if len(x) == n])]
            for i in range(n):
                sign[closing + i] = 1
            sign[lead[np.isin(codes, [int.from_bytes(x, "big") for x in STOPS if len(x) == n])] + n - 1] = 2
    last = np.maximum.accumulate(np.where(sign != 1, np.arange(len(sign)), -1))[ends - 1]
    return (last >= starts) & (sign[last] == 2)


def word_spans(word: np.ndarray, text: np.ndarray, stop: np.ndarray, n_sentences: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans (first word, end) that follow from the words alone, wherever a text or a line begins.

    They begin behind a stop and, in every `n_words` words of which none is
    behind a stop, at the word of least hash (the last such). They end at the
    end of a sentence like other spans if that is within half as many words
    again, else after `n_words` words.
    """
    n = len(word)
    behind = np.zeros(n, bool)
    behind[1:] = stop[:-1] & (text[1:] == text[:-1])
    begins = behind.copy()
    if n >= n_words:
        run = np.append(0, np.cumsum(behind))
        j = np.arange(n - n_words + 1)
        j = j[(text[j] == text[j + n_words - 1]) & (run[j + n_words] == run[j])]
        windows = np.lib.stride_tricks.sliding_window_view(word, n_words)
        for k in range(0, len(j), 65536):
            own = j[k : k + 65536]
            begins[own + n_words - 1 - windows[own][:, ::-1].argmin(1)] = True
    a = np.flatnonzero(begins)
    close = np.flatnonzero(stop) + 1
    j = np.maximum(np.searchsorted(close, a, "right") + n_sentences - 1, np.searchsorted(close, a + n_words))
    b = np.append(close, 2 * n + n_words * 2)[np.minimum(j, len(close))]
    end = np.searchsorted(text, text[a], "right")
    b = np.where(behind[a] & (b <= np.minimum(a + n_words + n_words // 2, end)), b, a + n_words)
    return a[b <= end], b[b <= end]


def layout(data: np.ndarray, offsets: np.ndarray, n_sentences: int, n_words: int, whole: bool) -> tuple[np.ndarray, ...]:
    """Words (starts, hash of each), pieces (text, first word of each) and spans (first word, end).

    A sentence ends after a word that ends in . ! or ?, before a line feed, and
    at the end of a text. Pieces are the sentences; with `whole` they are also
    cut where a span of `word_spans` begins or ends.
    """
    starts, ends, text = spans(~SPACE[data], offsets)
    if not len(starts):
        return starts, np.zeros(0, U), text, starts, starts, starts
    stop = stops(data, starts, ends) if whole else ENDS[data[ends - 1]]
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    first = np.ones(len(starts), bool)
    first[1:] = stop[:-1] | (feeds[starts[1:]] > feeds[ends[:-1]]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    of = text[at]
    word = Hasher(TO_LOWER[data])(starts, ends)
    bound = np.append(at, len(starts))  # words before each sentence
    limit = np.searchsorted(of, np.arange(len(offsets) - 1), "right")[of]  # behind the last sentence of its text
    i = np.arange(len(at))
    j = np.maximum(np.searchsorted(bound, bound[:-1] + n_words), i + n_sentences)
    ok = j <= limit
    a, b = bound[i[ok]], bound[j[ok]]
    if whole:
        c, d = word_spans(word, text, stop, n_sentences, n_words)
        have = np.full(len(starts), -1)
        have[a] = b
        new = have[c] != d
        a, b = np.append(a, c[new]), np.append(b, d[new])
        first[a] = True
        first[b[b < len(first)]] = True
        at = np.flatnonzero(first)
    return starts, word, text[at], at, a, b


def span_rows(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, n_sentences: int, n_words: int, whole: bool = False) -> tuple[np.ndarray, ...]:
    """(h1, h2, doc, first piece, pieces) of every span; words are compared with A-Z lowered."""
    starts, word, of, at, a, b = layout(data, offsets, n_sentences, n_words, whole)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32))
    run = np.zeros(len(word) + 1, U)
    np.cumsum(word * powers(BASE, len(word))[: len(word)], out=run[1:])
    inverse = powers(BASE_INVERSE, len(word) + 1)
    begin = np.searchsorted(of, np.arange(len(offsets) - 1))[of]  # the first piece of its text
    i, j = np.searchsorted(at, a), np.searchsorted(at, b)
    h = (run[b] - run[a]) * inverse[a]
    length = (b - a).astype(U)
    h1, h2 = mix(h + length), mix(h * U(0xC2B2AE3D27D4EB4F) + length * U(0x165667B19E3779F9))
    return h1.view(np.int64), h2.view(np.int64), ids[of[i]], (i - begin[i]).astype(np.int32), (j - i).astype(np.int32)


def _spans(batches: Iterator[pa.RecordBatch], n_sentences: int, n_words: int, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(batch.column(1))
        for i, j, part, at in blocks(data, offsets):
            columns = span_rows(ids[i:j], part, at, n_sentences, n_words, whole)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "ord", "pos", "size"])


def _cut(batches: Iterator[pa.RecordBatch], n_sentences: int, n_words: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Texts without the pieces that the given runs cover."""
    for batch in batches:
        texts, runs = batch.column(1), batch.column(2)
        data, offsets = text_bytes(texts)
        counts, gone, kept = [], [], []
        for i, j, part, at in blocks(data, offsets):
            starts, _, of, first, _, _ = layout(part, at, n_sentences, n_words, whole)
            bounds = np.searchsorted(of, np.arange(j - i + 1))
            for k in range(i, j):
                lo, hi = bounds[k - i], bounds[k - i + 1]
                n, own = int(hi - lo), runs[k].as_py()
                counts.append(n)
                if not own or not n:
                    gone.append(0)
                    kept.append(texts[k].as_py() or "")
                    continue
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, [min(g["pos"], n) for g in own], 1)
                np.add.at(edge, [min(g["pos"] + g["size"], n) for g in own], -1)
                stay = np.cumsum(edge[:-1]) == 0
                begin = np.append(starts[first[lo:hi]], at[k - i + 1])  # a piece reaches to the next one's start
                begin[0] = at[k - i]
                gone.append(n - int(stay.sum()))
                kept.append(part[at[k - i] : at[k - i + 1]][np.repeat(stay, np.diff(begin))].tobytes().decode("utf-8", "replace"))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), runs, pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_sentences", "n_removed", "runs", "kept_text"])


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_sentences: int = SENTENCES, n_words: int = WORDS, whole: bool = False) -> DataFrame:
    """(doc_id, runs): for each document with a repeated span that is not its first occurrence, all (pos, size) of those, in pieces."""
    thin = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = thin.mapInArrow(lambda b: _spans(b, n_sentences, n_words, whole), "h1 long, h2 long, ord long, pos int, size int")
    later = later_occurrences(rows, least=2, by_doc=False)
    return later.groupBy(F.col("ord").alias("doc_id")).agg(F.sort_array(F.collect_set(F.struct("pos", "size"))).alias("runs"))


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_sentences: int = SENTENCES, n_words: int = WORDS, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, runs, kept_text.

    From every sentence on, the shortest run of at least `n_sentences` sentences
    and `n_words` words is a span (none where the text ends before). Of spans
    with the same words (A-Z lowered) the first by (id, sentence) stays; the
    sentences that any later one covers go, with the white space behind them.

    With `whole` a stop may be non-ASCII or have closing signs behind it, and
    spans of `n_words` words or a few more that follow from the words alone are
    added: whatever its sentences, every passage of 2.5 * `n_words` words holds
    a whole one, at the same place in each copy. n_sentences, n_removed and runs
    then count pieces: sentences, cut where such a span begins or ends. Words
    are parted by white space, so text written without it has no such passages.

    A null or empty text has no sentence and gives an empty kept_text. Rows
    without an id are returned whole. Rows repeated with one id are compared as
    one text after another of the same id. An empty table gives an empty result;
    other columns are not read.
    """
    found = written(repeated_spans(docs, id_col=id_col, text_col=text_col, n_sentences=n_sentences, n_words=n_words, whole=whole), "runs")
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = thin.join(found.hint("merge"), "doc_id", "left")  # no bound is known, so no broadcast
    return joined.select("doc_id", "text", "runs").mapInArrow(lambda b: _cut(b, n_sentences, n_words, whole), "doc_id long, n_sentences long, n_removed long, runs array<struct<pos:int,size:int>>, kept_text string")

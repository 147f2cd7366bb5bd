"""SentencePiece models rebuilt from their protobuf for the tokenizers library."""

from __future__ import annotations

import ctypes
import hashlib
import os
import struct
from array import array
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.textops import blocks, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
#: Threads of one task for encoding and decoding.
THREADS = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message on the wire."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What encoding needs of a model file."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    remove_extra_spaces: bool
    escape_spaces: bool

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse_model(data: bytes) -> Model:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    model = Model(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)))
    if model.kind not in (UNIGRAM, BPE) or any(p[2] == USER_DEFINED for p in pieces) or not model.escape_spaces:
        raise ValueError("only unigram and BPE models with escaped spaces and without user-defined pieces can be rebuilt")
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Merges that make every normal piece from two others, the highest score first; of equal scores the longer left part, as a run grows from the left."""
    known = {p for p, _, kind in model.pieces if kind == NORMAL}
    found = [(-score, -i, p[:i], p[i:]) for p, score, kind in model.pieces if kind == NORMAL for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
    return [(a, b) for _, _, a, b in sorted(found, key=lambda x: (x[0], x[1], len(x[3])))]


def build_tokenizer(model: Model):
    """The same normaliser, space marker, scores or merges, byte fallback and decoder in the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        never = min(p[1] for p in model.pieces) - 1e6  # control pieces and the like are no text
        core = models.Unigram([(p, score if kind == NORMAL else never) for p, score, kind in model.pieces], model.unknown, model.byte_fallback)
    else:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges_of(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(SPACE)] if model.dummy_prefix else []
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    if not any(SPACE in p.lstrip(SPACE) for p, _, kind in model.pieces if kind == NORMAL):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"[^{SPACE}]+|{SPACE}+[^{SPACE}]*"), "isolated")  # no piece reaches over the start of a word
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    out.encode_special_tokens = True
    return out


#: Words whose ids a worker remembers; bytes of text whose words are looked up together.
REMEMBERED, BATCH = 200_000, 2 << 20
#: Words that are one input of the tokenizer, and inputs of one call: their pieces are held as strings until it ends.
GROUP, GROUPS = 500, 16
MARK = SPACE.encode()


def words_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All words of texts end to end, each with the spaces before it, and where each text's begin; a text that isn't empty has one space put first."""
    data, offsets = text_bytes(texts)
    if MARK in data.tobytes():  # the marker itself stands for a space
        texts = pa.array([t.replace(SPACE, " ") for t in texts.to_pylist()], pa.string())
        data, offsets = text_bytes(texts)
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 0x20)
    offsets = offsets + np.append(0, np.cumsum(full))
    begins = data == 0x20
    begins[1:] &= ~begins[:-1]
    begins[offsets[:-1][full]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return words, np.searchsorted(starts, offsets)


class Codec:
    """Encodes and decodes arrays of texts with a rebuilt tokenizer; ids go end to end, with the place where each text's begin.

    Where no normaliser but the space marker is at work, no piece reaches over
    the start of a word and bytes stand in for unknown signs, a text's ids are
    those of its words end to end. Then only the distinct words of a batch go
    through the tokenizer, many in one call on its threads, and the ids are
    gathered by word number.
    """

    def __init__(self, model: Model) -> None:
        self.tokenizer = build_tokenizer(model)
        self.dummy_prefix = model.dummy_prefix
        self.pieces = pa.array([bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in model.pieces], pa.large_binary())
        self.by_word = not model.charsmap and model.dummy_prefix and not model.remove_extra_spaces and model.byte_fallback and self.tokenizer.pre_tokenizer is not None
        if self.by_word:
            self.marked = build_tokenizer(model)
            self.marked.normalizer = self.marked.pre_tokenizer = None
            self.length = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in model.pieces])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # number of a word
        self.ids, self.bounds = np.zeros(0, "<i4"), np.zeros(1, np.int64)  # ids by number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the bounds of each text's; null is empty."""
        if not self.by_word:
            own = [np.array(e.ids, "<i4") for e in self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<i4"), *own]), np.append(0, np.cumsum([len(x) for x in own])).astype(np.int64)
        words, first = words_of(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        self._learn([w for w in distinct if w not in self.known])
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        lists = pa.ListArray.from_arrays(pa.array(self.bounds.astype(np.int32)), pa.array(self.ids)).take(pa.array(number))
        ends = np.append(0, np.cumsum(np.diff(self.bounds)[number]))
        if len(self.known) > REMEMBERED:
            self._forget()
        return lists.flatten().to_numpy(), ends[first]

    def _learn(self, words: list[str]) -> None:
        """Number words and keep their ids; groups of words are one input each, so that few objects are made, and a bounded number of groups one call."""
        ids, sizes = [self.ids], [np.diff(self.bounds)]
        for first in range(0, len(words), GROUP * GROUPS):
            call = words[first : first + GROUP * GROUPS]
            groups = [[w.replace(" ", SPACE) for w in call[i : i + GROUP]] for i in range(0, len(call), GROUP)]
            for group, encoding in zip(groups, self.marked.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
                own = np.array(encoding.ids, "<i4")
                ends = np.searchsorted(np.cumsum(self.length[own]), np.cumsum([len(w.encode()) for w in group])) + 1
                ids.append(own)
                sizes.append(np.diff(ends, prepend=0))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ids, self.bounds = np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(sizes)))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids end to end.

        Pieces are put end to end; what is then no UTF-8, and ids the model
        doesn't have, are left to the library's decoder. Other pieces begin and
        end with whole signs, so the text is UTF-8 just if every run of byte
        pieces is, and then both ways give the same.
        """
        data, at = self.joined(ids, ends)
        return [self._text(data[at[k] : at[k + 1]], ids[ends[k] : ends[k + 1]]) for k in range(len(ends) - 1)]

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all pieces end to end (of ids the model doesn't have, an invalid one), and where each text's begin."""
        inside = (ids >= 0) & (ids < len(self.pieces))
        pieces = self.pieces.take(pa.array(np.where(inside, ids, 0)))
        if not inside.all():
            pieces = pa.array([p if ok else b"\xff" for p, ok in zip(pieces.to_pylist(), inside.tolist(), strict=True)], pa.large_binary())
        at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
        return (pieces.buffers()[2].to_pybytes() if len(pieces) and pieces.buffers()[2] else b""), at[ends]

    def _text(self, data: bytes, ids: np.ndarray) -> str:
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def round_trips(self, texts: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bool]:
        """Whether each text comes back; bytes are compared, and only what differs is made a text."""
        data, at = self.joined(ids, ends)
        own, offsets = text_bytes(texts)
        whole, skip = own.tobytes(), int(self.dummy_prefix)
        out = []
        for k in range(len(ends) - 1):
            a, b = at[k], at[k + 1]
            want = whole[offsets[k] : offsets[k + 1]]
            same = (data[a + (b > a) * skip : b] == want) and (not skip or b == a or data[a] == 0x20)
            out.append(same or self._text(data[a:b], ids[ends[k] : ends[k + 1]]).encode("utf-8", "surrogatepass") == want)
        return out


#: Texts on which every worker compares the rebuilt tokenizer with the model's own library before its first batch.
PROBES = ["", " ", "a", "Hello world.", "  two  spaces   and    more", "▁ mark", "tabs\tand\nlines\r\n", "É à ñ ß 中文 日本語 🙂‍🙂", "aaaaaaa aaa 111111 <s> </s> <unk> <0x41>", "x" * 300, " " * 40 + "end", "\x00\x01"]


def read_model(path: str) -> bytes:
    """A model file; a bare name is one that SparkContext.addFile has sent to every worker."""
    with open(path if os.sep in path else SparkFiles.get(path), "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def load(path: str, threads: int = THREADS) -> Codec:
    """The rebuilt codec; raises if it differs from the model's own library on a probe."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    out = Codec(parse_model(read_model(path)))
    whole = [e.ids for e in out.tokenizer.encode_batch(PROBES, add_special_tokens=False)]
    fast, ends = out.encode(pa.array(PROBES))
    for k, (text, own, ids) in enumerate(zip(PROBES, whole, own_library(path).encode(PROBES, num_threads=1), strict=True)):
        if own != ids or fast[ends[k] : ends[k + 1]].tolist() != ids:
            raise ValueError(f"the rebuilt tokenizer differs from the model on {text!r}")
    return out


@lru_cache(maxsize=4)
def own_library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=read_model(path))


def _parity(path: str, texts: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bool]:
    """Whether the model's own library gives the same ids for each whole text."""
    out, at = [], ends.tolist()
    for k, text in enumerate(texts.to_pylist()):
        out.append(array("i", own_library(path).encode(text)).tobytes() == ids[at[k] : at[k + 1]].tobytes())
    return out


def lean(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The same batches; once they end, memory that Arrow's pool and the C library keep for later goes back to the system, as a worker waits for its next task with all it has."""

    @wraps(work)
    def run(*args) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(*args)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError):  # of the GNU library only
                ctypes.CDLL(None).malloc_trim(0)

    return run


@lean
def _encode(batches: Iterator[pa.RecordBatch], path: str, at: int, names: list[str], parity: bool, round_trip: bool) -> Iterator[pa.RecordBatch]:
    codec = load(path)
    for batch in batches:
        _, offsets = text_bytes(batch.column(at))
        for i, j, _, _ in blocks(np.zeros(0, np.uint8), offsets, BATCH):
            part = batch.slice(i, j - i)
            texts = part.column(at).fill_null("")
            ids, ends = codec.encode(texts)
            columns = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
            columns += [pa.array(_parity(path, texts, ids, ends), pa.bool_())] if parity else []
            columns += [pa.array(codec.round_trips(texts, ids, ends), pa.bool_())] if round_trip else []
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*names, "ids", *["parity"] * parity, *["round_trip"] * round_trip])


def encode(docs: DataFrame, *, text_col: str = "text", model: str = MODEL, parity: bool = False, round_trip: bool = False) -> DataFrame:
    """All rows and columns of docs, then ids (array of int); with `parity` also whether the model's own library gives the same, with `round_trip` whether the ids decode to the text.

    Texts are encoded whole; null and empty texts have no ids. Rows repeated or
    without an id are encoded like any other, and no row's result depends on
    another. Columns of these names are replaced. An empty table gives an empty
    result. `model` is a path that every worker can read, or the name of a file
    that SparkContext.addFile has sent to them.
    """
    new = ["ids", *["parity"] * parity, *["round_trip"] * round_trip]
    fields = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>" + ", parity boolean" * parity + ", round_trip boolean" * round_trip
    at = names.index(text_col)
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(lambda b: _encode(b, model, at, names, parity, round_trip), schema)


@lean
def _decode(batches: Iterator[pa.RecordBatch], path: str, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    codec = load(path)
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            lists = part.column(at)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype("<i4")
            ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode(ids, ends), pa.string())], names=[*names, "decoded"])


def decode(encoded: DataFrame, *, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """All rows and columns, then decoded: the text of the ids; null and empty lists give an empty text."""
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", decoded string"
    at = names.index(ids_col)
    return encoded.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(lambda b: _decode(b, model, at, names), schema)


@lean
def _digest(batches: Iterator[pa.RecordBatch], path: str, first_byte: int, n_bytes: int) -> Iterator[pa.RecordBatch]:
    codec = load(path)
    for batch in batches:
        _, offsets = text_bytes(batch.column(1))
        for i, j, _, _ in blocks(np.zeros(0, np.uint8), offsets, BATCH):
            texts = batch.column(1).slice(i, j - i).fill_null("")
            ids, ends = codec.encode(texts)
            fallen = np.append(0, np.cumsum((ids >= first_byte) & (ids < first_byte + n_bytes)))
            digests = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = [pa.array(np.diff(ends)), pa.array(fallen[ends[1:]] - fallen[ends[:-1]]), pa.array(digests, pa.string()), pa.array(_parity(path, texts, ids, ends), pa.bool_()), pa.array(codec.round_trips(texts, ids, ends), pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "parity", "round_trip"])


def codec_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), parity, round_trip.

    Every whole text is encoded, compared with the model's own library, and
    decoded again in one pass; ids are not written. Null counts as empty. Rows
    repeated or without an id are reported like any other. An empty table gives
    an empty result; other columns are not read.
    """
    pieces = parse_model(read_model(model)).pieces
    at = [i for i, p in enumerate(pieces) if p[2] == BYTE]
    first, n = (at[0], len(at)) if at else (0, 0)
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(lambda b: _digest(b, model, first, n), f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, parity boolean, round_trip boolean")

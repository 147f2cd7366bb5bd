"""Classifiers by held-out accuracy, the codec by parity and round trip, the pipeline's stages against plain Python."""

import itertools
import subprocess
import sys

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from skein.llm import quality, queries
from skein.llm.lang_id import identify_language, train_language
from skein.llm.near_dedup import near_dedup
from skein.llm.quality import LineField, line_features, marginals, score_quality, train_quality
from skein.llm.sentencepiece_codec import MODEL, Codec, Model, build_tokenizer, codec_report, decode, encode, load, merges_of, own_library, parse_model, read_model
from test_near_and_benchmark import classes, leaks

SF = "/root/testdata/sf0.01"


def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(0)
    first = np.array([0, 1, 4, 9, 11])
    score, t = rng.normal(size=11), rng.normal(size=(2, 2))
    p, pairs, z = marginals(score, t, first)
    want, total = np.zeros(11), np.zeros((2, 2))
    for c, (a, b) in enumerate(itertools.pairwise(first)):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = np.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(t[u, v] for u, v in itertools.pairwise(y)))
        s = sum(weights.values())
        assert np.isclose(z[c], np.log(s))
        for y, w in weights.items():
            want[a:b] += np.array(y) * w / s
            for u, v in itertools.pairwise(y):
                total[u, v] += w / s
    assert np.allclose(p, want) and np.allclose(pairs, total)


def test_quality_held_out(spark):
    rows = queries.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_samples_are_bounded(spark):
    """Long documents, and an id that very many rows repeat, bring no more than the sample's lines to the driver; languages share one sample."""
    docs = spark.range(300).selectExpr("if(id < 200, 7, id) as doc_id", "repeat(concat('good words here', char(10)), if(id = 250, 5000, 1 + cast(id % 3 as int))) as text", "if(id % 4 = 0, 'aa', concat('b', id % 3)) as lang")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    original = quality.fit_field
    try:
        quality.fit_field = lambda base, length, first, label, **k: seen.append((len(base), len(label))) or original(base, length, first, label, **k)
        train_quality(docs, labels, sample=30, sample_lines=60)
        train_quality(docs, labels)
    finally:
        quality.fit_field = original
    assert 0 < seen[0][0] <= 60 and seen[0][1] <= 60 and seen[1][1] == 300
    assert train_language(docs, sample=20).languages == ["aa", "b0", "b1", "b2"]


def test_quality_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = score_quality(odd.withColumn("score", F.lit("old")), train_quality(odd, none)).collect()
    assert len(out) == odd.count() and {r.score for r in out} == {0.5}
    lone = train_quality(odd, spark.createDataFrame([(5, 1), (None, 0), (6, None), (5, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.5 for r in score_quality(odd, lone).collect())
    assert score_quality(odd.limit(0), lone).count() == 0
    base, length, first = line_features(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert base.shape[0] == 2 and length.tolist() == [1, 1] and first.tolist() == [0, 1, 2]
    assert isinstance(lone, LineField)


def test_language_held_out(spark):
    rows = queries.op7_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_language_edges(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_language(docs, sample=200)
    got = {r.doc_id: r for r in identify_language(odd.withColumn("lang_pred", F.lit(1)), model).collect()}
    for d in (1, 2, 3, 4, 18, 19):
        assert (got[d].lang_pred, got[d].score, got[d].rejected) == ("und", 0.0, True)
    assert got[5].lang_pred in model.languages and 0 < got[5].score <= 1 and got[11].lang_pred in model.languages
    nothing = train_language(docs.limit(0))
    assert {r.lang_pred for r in identify_language(odd, nothing).collect()} == {"und"}


def test_codec(spark, odd):
    for table in (odd, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        ids = encode(table.withColumn("ids", F.lit(0)), parity=True)
        rows = decode(ids).collect()
        assert all(r.parity and r.decoded == (r.text or "") for r in rows)
        assert all(r.ids == own_library(MODEL).encode(r.text or "") for r in rows)
    spark.sparkContext.addFile(MODEL)  # a bare name is a file sent along with the job
    assert encode(odd.select("doc_id", "text"), model=MODEL.rsplit("/", 1)[1]).filter("size(ids) > 0").count() == encode(odd.select("doc_id", "text")).filter("size(ids) > 0").count()
    hard = ["a▁b", "  ", " x  y   ", "\n\n \t", "🙂" * 20, "<s>", " " * 33 + "z" + " " * 7, "ÀÀÀ ßß", "1" * 50, "\u0000�"]
    table = spark.createDataFrame(list(enumerate(hard * 3)), "doc_id long, text string")
    got = encode(table, parity=True, round_trip=True).collect()
    assert all(r.parity for r in got)
    assert {r.doc_id: r.round_trip for r in got} == {r.doc_id: r.decoded == r.text for r in decode(encode(table)).collect()}
    assert {r.text for r in got if not r.round_trip} == {"a▁b"}  # the marker comes back as a space
    unnamed = spark.createDataFrame([(None, "a b", 7), (None, "a b", 7), (1, None, 7)], "doc_id long, text string, parity int")
    assert [(r.n_tokens, r.parity, r.round_trip) for r in codec_report(unnamed).collect()] == [(2, True, True), (2, True, True), (0, True, True)]
    assert codec_report(unnamed.limit(0)).count() == encode(unnamed.limit(0)).count() == decode(encode(unnamed.limit(0))).count() == 0
    assert decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).select("decoded").distinct().collect() == [("",)]


def test_unigram_models():
    pieces = [("<unk>", 0.0, 2), *((f"<0x{i:02X}>", -20.0, 6) for i in range(256)), ("▁", -3.0, 1), ("a", -2.0, 1), ("ab", -2.5, 1), ("b", -4.0, 1), ("▁ab", -3.5, 1)]
    model = Model(pieces, 1, True, b"", True, False, True)
    tokenizer = build_tokenizer(model)
    assert tokenizer.encode("abb", add_special_tokens=False).tokens == ["▁ab", "b"]
    assert tokenizer.decode(tokenizer.encode("ab c", add_special_tokens=False).ids) == "ab c"
    with pytest.raises(ValueError):
        parse_model(b"\x0a\x05\x0a\x01a\x18\x04")
    assert merges_of(Model([("a", 0, 1), ("b", -1, 1), ("ab", -2, 1)], 2, True, b"", True, False, True)) == [("a", "b")]


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("extra", F.lit(1))
    names = [f for _, f in corpus_pipeline.STAGES]
    texts = {r.doc_id: r for r in docs.collect()}
    lines = names[1](spark, docs, SF)
    assert lines.columns == corpus_pipeline.COLUMNS
    cut = {r.doc_id: r.text for r in lines.collect()}
    holders = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for d, r in texts.items():
        for x in r.text.split("\n"):
            holders.setdefault(key(x), set()).add(d)
    for d, r in texts.items():
        kept = "\n".join(x for x in r.text.split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == d)
        assert cut.get(d) == (kept if kept.strip() or kept == r.text else None)
    near = {r.doc_id for r in names[2](spark, docs, SF).collect()}
    assert near == {d for d, (_, _, kept) in classes({d: r.text for d, r in texts.items()}, 5).items() if kept}
    assert near == {r.doc_id for r in near_dedup(docs, shingle=5).filter("kept").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in names[3](spark, docs, SF).collect()}
    assert clean == {d for d, x in leaks({d: r.text for d, r in texts.items()}, items).items() if not x[4]}
    good = names[0](spark, docs, "/root/testdata/sf0.001")
    assert good.columns == corpus_pipeline.COLUMNS and 0 < good.count() < docs.count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    bad = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0)], lines.schema)
    for f in names[1:]:
        assert f(spark, bad, SF).count() == 2


def test_any_ids_decode_as_in_the_library():
    codec, rng = load(MODEL), np.random.default_rng(4)
    n = len(codec.pieces)
    for _ in range(3000):
        size = int(rng.integers(0, 12))
        ids = np.where(rng.random(size) < 0.5, rng.integers(3, 259, size), rng.integers(0, n, size)).astype(np.int32)
        assert codec.decode(ids, np.array([0, size])) == [codec.tokenizer.decode(ids.tolist(), skip_special_tokens=False)]


HELD = """
import re, sys
import pyarrow as pa
from skein.llm.sentencepiece_codec import MODEL, _encode, load

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches():
    for k in range(3):
        yield pa.record_batch([pa.array([" ".join(f"w{k}x{i * 7919 % 60000}q{j}" for j in range(300)) for i in range(200)])], names=["text"])

load(MODEL)
before, rows = held(), sum(b.num_rows for b in _encode(batches(), MODEL, 0, ["text"], False, True))
print(rows, held() - before)
"""


def test_codec_memory_is_bounded():
    """One call of the tokenizer holds a bounded number of words, and between tasks a worker holds little more than the words it remembers."""
    codec, calls = Codec(parse_model(read_model(MODEL))), []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, groups, **k):
            calls.append(sum(map(len, groups)))
            return self.inner.encode_batch_fast(groups, **k)

    codec.marked = Counting(codec.marked)
    texts = [" ".join(f"word{i}é{j}" for j in range(700)) for i in range(30)]
    ids, ends = codec.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(ends)] == own_library(MODEL).encode(texts)
    assert sum(calls) == 21_000 and max(calls) <= 8_000
    rows, mb = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(rows) == 600 and float(mb) < 75

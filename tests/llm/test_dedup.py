"""Exact, line and passage duplicates and sharding against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from skein.llm.exact_dedup import exact_dedup
from skein.llm.line_dedup import line_dedup
from skein.llm.occurrences import later_occurrences
from skein.llm.sharding import histogram_shards
from skein.llm.substring_dedup import substring_dedup

WS = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["odd", "documents"])
def table(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact(table, digest_all):
    norm = {d: (re.sub(r"[\x20\x09-\x0D]", "", t or ""), len(t or "")) for d, t in pairs(table)}
    groups = defaultdict(list)
    for d, (x, n) in norm.items():
        groups[x].append((-n, d))
    got = {r.doc_id: r for r in exact_dedup(table, digest_all=digest_all).collect()}
    assert got.keys() == norm.keys()
    for d, (x, _) in norm.items():
        r = got[d]
        assert (r.keep_id, r.group_size, r.kept) == (min(groups[x])[1], len(groups[x]), min(groups[x])[1] == d)
        assert r.text_sha256 == sha(x) or (not digest_all and r.text_sha256 is None and len(groups[x]) == 1)


@pytest.mark.parametrize("digest_all", [True, False])
def test_one_id_with_several_texts(spark, digest_all):
    """Every row stays one row, also where texts of one id share length and prefix."""
    texts = ["x" * 300 + "a", "x" * 300 + "b", "x" * 300 + "a", None, "", "short", "other"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[0]), (1, texts[3]), (3, texts[4]), (None, texts[5]), (4, texts[6])]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest_all=digest_all).collect())
    assert got == sorted([("1", "1", 3, True), ("1", "1", 1, True), ("2", "1", 3, False), ("None", "1", 3, False), ("1", "1", 2, True), ("3", "1", 2, False), ("None", "None", 1, True), ("4", "4", 1, True)])


def test_lines(table):
    rows = dict(pairs(table))
    lines = {d: (t or "").split("\n") for d, t in rows.items()}
    key = lambda x: x.strip(WS).translate(LOWER)
    holders = defaultdict(set)
    for d, ls in lines.items():
        for x in ls:
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    out = line_dedup(table)
    assert out.columns[-3:] == ["n_lines", "n_dropped", "kept_text"] and len(set(out.columns)) == len(out.columns)
    for r in out.collect():
        kept = [x for x in lines[r.doc_id] if len(holders[key(x)]) < 3 or max(holders[key(x)]) == r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(lines[r.doc_id]), len(lines[r.doc_id]) - len(kept), "\n".join(kept))


def test_lines_beside_clashing_columns(spark):
    rows = [(i, "a line that is long enough\nown %d" % i, "x", i + 0.5, 7) for i in range(4)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, _id string, _dropped double, n_lines int"))
    assert out.columns == ["doc_id", "text", "_id", "_dropped", "n_lines", "n_dropped", "kept_text"]
    assert sorted((r.doc_id, r._id, r._dropped, r.n_lines, r.n_dropped) for r in out.collect()) == [(i, "x", i + 0.5, 2, int(i < 3)) for i in range(4)]


@pytest.mark.parametrize("least,by_doc", [(2, False), (3, True), (2, True), (4, True)])
def test_hot_keys_over_many_parts(spark, least, by_doc):
    """A key with most rows fills several parts; others begin and end at the parts' edges."""
    rows = [(0 if i % 3 else 7 * (i % 40), 0, i // (1 + i % 4), i, i % 5) for i in range(3000)] + [(5, 5, 1, 1, 1), (5, 5, 1, 2, 1), (6, 6, 1, 1, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    got = sorted(map(tuple, later_occurrences(spark.createDataFrame(rows, "h1 long, h2 long, ord long, pos int, size int"), least=least, by_doc=by_doc).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = defaultdict(list)
    for h1, h2, *x in rows:
        keys[h1, h2].append(tuple(x))
    want = []
    for v in keys.values():
        v.sort()
        units = {x[0] for x in v} if by_doc else v
        if len(units) >= least:
            want += [x for i, x in enumerate(v) if (x[0] != v[0][0] if by_doc else i)]
    assert got == sorted(want)


def cut(texts, n_sentences=2, n_words=20):
    """Text of each document and what stays of it."""
    split = {}
    for d, t in texts.items():
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        firsts = [i for i, (a, _) in enumerate(words) if i == 0 or t[words[i - 1][1] - 1] in ".!?" or "\n" in t[words[i - 1][1] : a]]
        split[d] = (words, firsts)
    seen, gone = set(), defaultdict(set)
    for d in sorted(texts):
        words, firsts = split[d]
        bound = [*firsts, len(words)]
        for i in range(len(firsts)):
            j = next((j for j in range(i + n_sentences, len(bound)) if bound[j] - bound[i] >= n_words), None)
            if j is None:
                continue
            span = tuple(texts[d][a:b].translate(LOWER) for a, b in words[bound[i] : bound[j]])
            if span in seen:
                gone[d].update(range(i, j))
            seen.add(span)
    out = {}
    for d, t in texts.items():
        words, firsts = split[d]
        begin = [0, *(words[i][0] for i in firsts[1:]), len(t or "")] if firsts else [0, len(t or "")]
        out[d] = (len(firsts), len(gone[d]), "".join((t or "")[begin[i] : begin[i + 1]] for i in range(len(begin) - 1) if i not in gone[d]))
    return out


def test_passages(table):
    want = cut(dict(pairs(table)))
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.kept_text) for r in substring_dedup(table).collect()}
    assert got == want
    assert any(x[1] for x in got.values())


def test_passages_within_sentences(spark):
    """Copies of 50 words without a stop, with stops behind signs or non-ASCII ones, and wrapped anew, within other words."""
    rng = random.Random(3)
    rows = []
    for k, stop in enumerate(["", "&&&", '."', "\u3002", ".", "!)"] * 5):
        words = [f"w{k}x{rng.randrange(10**6)}" + (stop if i % (7 + k) == 6 and stop else "") for i in range(50)]
        other = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]  # noqa: E731, B023
        rows.append((3 * k, " ".join([*other(rng.randrange(30)), *words, *other(rng.randrange(30))])))
        rows.append((3 * k + 1, " ".join([*other(rng.randrange(30)), *words, *other(rng.randrange(30))])))
        rows.append((3 * k + 2, "\n".join([*other(rng.randrange(30)), *words, *other(rng.randrange(30))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    for r in substring_dedup(docs, whole=True).collect():
        assert (r.n_removed > 0) == (r.doc_id % 3 > 0), r
        lost = len(text[r.doc_id].split()) - len(r.kept_text.split())
        assert lost >= 20 if r.doc_id % 3 else r.kept_text == text[r.doc_id]


def test_shards(table):
    rows = dict(pairs(table))
    got = histogram_shards(table).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    size = {d: len((t or "").encode()) + 1 for d, t in rows.items()}
    by_shard = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size[r.doc_id], zlib.crc32((rows[r.doc_id] or "").encode()), "bytes", None)
        by_shard[r.shard].append(r)
    for v in by_shard.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    ideal, most = sum(size.values()) / 8, max(size.values())
    assert all(abs(sum(r.size for r in by_shard[i]) - ideal) <= most + 0.02 * ideal for i in range(8))


def test_shards_cut_a_hot_group(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("the same text")).otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    sizes = [r["s"] for r in histogram_shards(rows).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    for f in (exact_dedup, line_dedup, substring_dedup, histogram_shards):
        assert f(empty).count() == 0
    lone = spark.createDataFrame([(None, None), (None, "a"), (3, "a"), (3, "a")], "doc_id long, text string")
    for f in (exact_dedup, line_dedup, substring_dedup, histogram_shards):
        assert f(lone).count() == 4

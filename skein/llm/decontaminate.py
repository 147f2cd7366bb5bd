"""Benchmark decontamination by a prefix-filtered set join over word shingles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import ascii_lower, attach, removed, written

WINDOW = 13
#: Words of a shingle, the token of the set join; an item of fewer words is one shingle.
SHINGLE = 3
#: Windows of the benchmark up to which their shingles are sent to every executor: about 16 MB.
BROADCAST_WINDOWS = 50_000
REPORT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lowered, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), lambda w: w != "")


def item_windows(benchmark: DataFrame, item_id: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows of all items: number, words, length, items that have it."""
    words = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.least(F.size("w"), F.lit(window))))).alias("window"))
    out = each.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    return out.select(F.monotonically_increasing_id().alias("wid"), "window", F.size("window").alias("len"), "items")  # to be written at once


def shingles_of(words: Column, size: int) -> Column:
    """(pos from 0, size, hash) of every run of `size` words; none where there are fewer."""
    runs = F.sequence(F.lit(1), F.size(words) - size + 1)
    each = F.transform(runs, lambda i: F.struct((i - 1).alias("pos"), F.lit(size).alias("size"), F.xxhash64(*(F.get(words, i + (k - 1)) for k in range(size))).alias("h")))
    return F.when(F.size(words) >= size, each).otherwise(F.array().cast("array<struct<pos:int,size:int,h:bigint>>"))


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """An inner join: by broadcast of a counted table, or by two plain shuffles, of which AQE splits a common key's."""
    return rows.join(F.broadcast(table) if small else table.hint("merge"), keys)


def shingle_places(docs: DataFrame, vocabulary: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """(key, n_words, pos, shingle): every place of documents (key, w) that holds a shingle of the vocabulary (h, shingle)."""
    each = docs.select("key", F.size("w").alias("n_words"), "w", F.explode(F.concat(*(shingles_of(F.col("w"), n) for n in sizes))).alias("s"))
    own = F.array_join(F.slice("w", F.col("s.pos") + 1, F.col("s.size")), " ")
    each = each.select("key", "n_words", F.col("s.pos").alias("pos"), F.col("s.h").alias("h"), *([F.col("w"), F.col("s")] if small else [own.alias("own")]))
    met = _joined(each, vocabulary, ["h"], small)  # the hash finds, the words decide; beside a broadcast they are only looked at where the hash is met
    return met.filter((own if small else F.col("own")) == F.col("shingle")).select("key", "n_words", "pos", "shingle")


def anchored(tokens: DataFrame, places: DataFrame) -> DataFrame:
    """(wid, shingle, offset, len): each window's prefix token, that of its shingles which the fewest places of all documents hold.

    A window counts only if it is found whole, so of its k shingles in the order
    of rarity the prefix that no match can do without has k - k + 1: the rarest.
    Windows with a shingle that no document holds are left out.
    """
    both = places.select("shingle", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("m")).unionAll(tokens.select("shingle", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("m")))
    counts = both.groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).filter("m > 0")
    rare = attach(tokens, counts, ["shingle"], ["n"], "m", F.col("wid")).groupBy("wid").agg(F.min(F.struct("n", "shingle", "offset", "len")).alias("r")).filter("r.n > 0")
    return rare.select("wid", F.col("r.shingle").alias("shingle"), F.col("r.offset").alias("offset"), F.col("r.len").alias("len"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: tuple[int, int] = (1, 20), broadcast_windows: int = BROADCAST_WINDOWS, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    An item's windows are all runs of `window` of its words (an item of fewer
    words, but not none, is one window); a document's word inside a place that
    holds a window whole is hit. A document is contaminated when it has hits
    and their share of its words reaches `share`.

    The tokens of the join are shingles of SHINGLE words. One scan of all
    documents keeps the places of shingles that windows have, which gives each
    shingle's count over all documents; a window's rarest is its prefix token.
    Places of prefix tokens, with their offset, give a start, and the length and
    position bounds drop those that stick out. A start is verified on the places
    kept: the window is there just if each of its shingles, word for word, is at
    its own place. The shingles of up to `broadcast_windows` windows (counted)
    are sent to all executors; more are joined by shuffle, with the same result.

    Null and empty texts have no words and no hits; items without words match
    nothing; equal windows of several items count for each. Every row is decided
    by its own text, whether its id is null, repeated or neither. Columns named
    in `carry` are returned as well, but for those named as the report's. Empty tables are allowed on either side;
    other columns are not read.
    """
    carry = [c for c in carry if c not in REPORT]
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.when(F.col(id_col).isNull(), F.sha2(text, 256)).otherwise(F.xxhash64(text).cast("string")))
    windows = written(item_windows(benchmark, item_id, item_text, window), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("len", F.lit(SHINGLE))).distinct().collect())  # SHINGLE rows at most
    small = windows.count() <= broadcast_windows
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.size(words_of(F.col(text_col))).alias("n_words"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carry")] if carry else []))
    if not sizes:
        return _report(rows.withColumns({"n_hit": F.lit(None).cast("int"), "items": F.lit(None).cast("array<string>")}), share, carry)
    parts = [windows.filter(F.least("len", F.lit(SHINGLE)) == n).select("wid", "len", "window", F.explode(shingles_of(F.col("window"), n)).alias("s")) for n in sizes]
    tokens = reduce(DataFrame.unionAll, parts).select("wid", "len", F.col("s.pos").alias("offset"), F.col("s.h").alias("h"), F.array_join(F.slice("window", F.col("s.pos") + 1, F.col("s.size")), " ").alias("shingle"))
    tokens = written(tokens, "tokens")
    split = docs.select(key.alias("key"), words_of(F.col(text_col)).alias("w"))
    vocabulary = written(tokens.select("h", "shingle").distinct(), "vocabulary")
    places = written(shingle_places(split, vocabulary, sizes, small), "places")
    anchors = written(anchored(tokens, places), "anchors")
    start = F.col("pos") - F.col("offset")
    found = _joined(places, anchors, ["shingle"], small).filter((start >= 0) & (start + F.col("len") <= F.col("n_words"))).select("key", "wid", start.alias("start"), "len").distinct()
    each = _joined(found, tokens.select("wid", "offset", "shingle"), ["wid"], small).select("key", "wid", "start", "len", (F.col("start") + F.col("offset")).alias("pos"), "shingle")
    met = each.join(places.select("key", "pos", "shingle").distinct().hint("merge"), ["key", "pos", "shingle"]).groupBy("key", "wid", "start", "len").agg(F.count(F.lit(1)).alias("k"))
    whole = met.filter(F.col("k") == F.col("len") - F.least("len", F.lit(SHINGLE)) + 1)
    hits = _joined(whole, windows.select("wid", "items"), ["wid"], small).select("key", "start", "len", "items")
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "len")), lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    by_doc = written(hits.groupBy("key").agg(F.size(covered).alias("n_hit"), items.alias("items")), "hits")
    for t in (windows, tokens, vocabulary, places, anchors):
        removed(t)
    return _report(rows.join(by_doc.hint("merge"), "key", "left"), share, carry)


def _report(out: DataFrame, share: tuple[int, int], carry: Sequence[str]) -> DataFrame:
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share[1] >= F.col("n_words") * share[0])).alias("contaminated"), *(F.col(f"carry.`{c}`") for c in carry),
    )

"""Near duplicates by min-max hashing, with every link confirmed on the full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import attach, removed, written
from skein.llm.components import components
from skein.llm.textops import SPACE, TO_LOWER, Hasher, U, blocks, group_bounds, mix, spans, text_bytes

SHINGLE, BANDS = 4, 24
#: Permutations in a band; each gives a minimum and a maximum, so a band holds four values for two hash evaluations.
PER_BAND = 2
SIMILARITY = (80, 100)
#: Rounds of new pivots go on while one in so many of their pairs is a link; the prefix filter then settles the rest whatever is left.
MANY = 50
_rng = np.random.default_rng(7)
_multipliers = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_offsets = _rng.integers(0, 2**63, 256, dtype=U)
_word_factor = _rng.integers(1, 2**63, 64, dtype=U) * U(2) + U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each text's shingles, text after text, and where each set begins.

    A text of fewer words than `size` has its whole sequence as one shingle; one
    without words has none.
    """
    data = TO_LOWER[data]
    starts, ends, text = spans(~SPACE[data], offsets)
    n = len(offsets) - 1
    word = Hasher(data)(starts, ends) if len(starts) else np.zeros(0, U)
    first = group_bounds(text, n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    padded = np.concatenate([word, np.zeros(size, U)])
    h = np.zeros(len(word), U)
    for k in range(size):
        h += padded[k : k + len(word)] * _word_factor[k]
    whole = text[: len(word)] == np.append(text, np.full(size, -1))[size - 1 : size - 1 + len(word)] if size > 1 else np.ones(len(word), bool)
    for t in short:  # at most size - 1 words each
        h[first[t]] = (word[first[t] : first[t + 1]] * _word_factor[: count[t]]).sum(dtype=U) + U(count[t])
        whole[first[t]] = True
    h, text = mix(h[whole]), text[whole]
    bounds = group_bounds(text, n)
    for t in range(n):
        h[bounds[t] : bounds[t + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], group_bounds(text[keep], n)


def set_names(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set that isn't empty."""
    at = bounds[:-1][np.diff(bounds) > 0]
    if not len(at):
        return np.zeros(0, U), np.zeros(0, U)
    return np.add.reduceat(mix(sets + U(1)), at), np.add.reduceat(mix(sets ^ U(0x5851F42D4C957F2D)), at)


def signatures(sets: np.ndarray, bounds: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """For each set that isn't empty and each band one hash of the band's minima and maxima."""
    at = bounds[:-1][np.diff(bounds) > 0]
    if not len(at):
        return np.zeros((0, bands), U)
    keys = np.zeros((len(at), bands), U)
    for b in range(bands):
        key = np.full(len(at), b + 1, U)
        for p in range(b * per_band, (b + 1) * per_band):
            y = sets * _multipliers[p] + _offsets[p]
            key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, at))
            key = mix(key * U(0x9E3779B97F4A7C15) + np.maximum.reduceat(y, at))
        keys[:, b] = key
    return keys


def _sign(batches: Iterator[pa.RecordBatch], size: int, bands: int, per_band: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        data, offsets = text_bytes(batch.column(1))
        for i, j, part, at in blocks(data, offsets):
            sets, bounds = shingle_sets(part, at, size)
            n = np.diff(bounds)
            (c1, c2), keys = set_names(sets, bounds), signatures(sets, bounds, bands, per_band)
            full = n > 0
            one, two = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
            one[full], two[full] = c1.view(np.int64), c2.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append([0], np.cumsum(full * bands)).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(one), pa.array(two), lists], names=["doc_id", "n_shingles", "c1", "c2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Nodes with their shingles, from rows (node, c1, c2, text) of an id of the node: those whose text is the node's own."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(3))
        for i, j, part, at in blocks(data, offsets):
            sets, bounds = shingle_sets(part, at, size)
            full = np.diff(bounds) > 0
            names = np.zeros((2, j - i), np.int64)
            names[0, full], names[1, full] = (x.view(np.int64) for x in set_names(sets, bounds))
            own = full & (names[0] == batch.column(1).slice(i, j - i).to_numpy()) & (names[1] == batch.column(2).slice(i, j - i).to_numpy())
            rows = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["node", "shingles"])
            yield rows if own.all() else rows.filter(pa.array(own))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) whose full sets are as similar as asked: part * |intersection| >= whole * |union|.

    `sets` is a written table of one row a node, so both joins are of plain
    shuffles, and AQE splits the one that many pairs have in common.
    """
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    return pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").filter(shared * similarity[1] >= (F.size("su") + F.size("sv") - shared) * similarity[0]).select("u", "v")


def _fits(a: str, b: str, similarity: tuple[int, int]) -> Column:
    """Sets so similar have sizes no further apart than that."""
    return (F.least(a, b) * similarity[1]) >= (F.greatest(a, b) * similarity[0])


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of bands that hold several components so far, with their root."""
    labelled = members.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")).select("band", "node", "n_shingles", "root")
    mixed = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi")
    return written(attach(labelled, mixed, ["band"], ["lo"], "m", F.col("node")).filter("lo is not null").drop("lo"), "mixed")


def _next_star(mixed: DataFrame, turn: int, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of each member outside its band's largest component with one member of that component, another in each turn."""
    by_root = mixed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("o"), "node", "n_shingles")).alias("p"))
    largest = by_root.groupBy("band").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root", "p")).alias("x")).select("band", "m", F.col("x.root").alias("root_p"), F.col("x.p.node").alias("pivot"), F.col("x.p.n_shingles").alias("n_pivot"))
    pairs = attach(mixed, largest, ["band"], ["root_p", "pivot", "n_pivot"], "m", F.col("node")).filter((F.col("root") != F.col("root_p")) & _fits("n_shingles", "n_pivot", similarity))
    return pairs.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()


def _rest(mixed: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of different components that share a band and may be similar, by prefix filter.

    With part / whole the similarity asked: of a set's shingles in order of
    rarity among the members given, two sets as similar share one of the first
    n - ceil(n * part / whole) + 1; and from the first that they share on, both
    have as many left as the intersection needs.
    """
    part, whole = similarity
    labelled = mixed.select("node", "root").distinct()
    tokens = written(labelled.join(sets.hint("merge"), "node").select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("token")), "tokens")
    rare = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    need = (F.col("n") - F.ceil(F.col("n") * part / whole) + 1).cast("int")
    ordered = attach(tokens, rare, ["token"], ["df", "lo", "hi"], "df", F.col("node")).groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token", (F.col("lo") < F.col("hi")).alias("shared")))).alias("p"))
    prefix = ordered.select("node", "root", "n", F.posexplode(F.slice("p", F.lit(1), need)).alias("i", "p")).filter("p.shared").select("node", "root", "n", (F.col("n") - F.col("i")).alias("left"), F.col("p.token").alias("token"))
    prefix = written(prefix, "prefix")
    removed(tokens)
    other = prefix.withColumnsRenamed({"node": "v", "root": "root_v", "n": "n_v", "left": "left_v"})
    enough = F.least("left", "left_v") * (part + whole) >= (F.col("n") + F.col("n_v")) * part
    pairs = prefix.withColumnRenamed("node", "u").join(other, "token").filter((F.col("root") < F.col("root_v")) & _fits("n", "n_v", similarity) & enough)
    return pairs.select("u", "v").distinct()


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, per_band: int = PER_BAND, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words `[^\\x20\\x09-\\x0D]+` with A-Z lowered; a document's set holds its
    distinct shingles (its whole sequence as one if it has fewer words). Two
    documents are linked when the Jaccard similarity of their sets reaches
    `similarity`; component_id is the least id reachable.

    Each permutation's minimum and maximum both enter the signature, and
    `per_band` permutations (so twice as many values) make a band. A pair of
    similarity 0.8 shares none of 24 bands with probability 3e-6 where sets are
    large and, as minimum and maximum are drawn without replacement, 2e-5 for 4
    of 5 shingles; that is the only way to lose a link. Documents of equal sets
    are one class, and so one node, from the first shuffle on. In each band all
    classes are compared with one of them, another in each band (as many pairs
    as rows), on the full sets; in bands that still hold several components the
    members outside the largest are compared with one of its members, again and
    again while that links many; the rest is compared by prefix filter, so that
    no similar pair that shares a band stays apart. Pairs within a component are
    not listed again.

    Null and empty texts, and those without words, have no shingles and are
    linked with nothing. Rows without an id are their own component. Rows
    repeated with one id and text are one node; rows of one id and several texts
    each have their own links, and what is linked with any of them has that id
    in reach. Ids are whole numbers, as component_id is the least. An empty
    table gives an empty result.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = thin.mapInArrow(lambda b: _sign(b, shingle, bands, per_band), "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>")
    signed = written(signed, "signed")
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    name = ["n_shingles", "c1", "c2"]
    classes = named.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written at once, so numbered once
    members = classes.select("node", "n_shingles", F.posexplode("bands").alias("b", "key")).select("node", "n_shingles", F.xxhash64("b", "key").alias("band"))
    order = F.xxhash64("node", "band")  # another pivot in each band
    pivots = members.groupBy("band").agg(F.min(F.struct(order.alias("o"), "node", "n_shingles")).alias("p"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("band", "m", F.col("p.node").alias("pivot"), F.col("p.n_shingles").alias("n_pivot"))
    pivots = written(pivots, "pivots")
    members = written(attach(members, pivots, ["band"], ["pivot", "n_pivot"], "m", F.col("node")).filter(F.col("pivot").isNotNull()), "members")
    wanted = members.select("node").distinct().join(classes.select("node", F.col("rep").alias("doc_id"), "c1", "c2").hint("merge"), "node")
    texts = thin.join(wanted.hint("merge"), "doc_id").select("node", "c1", "c2", "text")  # no bound is known, so no broadcast
    sets = written(texts.mapInArrow(lambda b: _sets(b, shingle), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")
    star = members.filter((F.col("node") != F.col("pivot")) & _fits("n_shingles", "n_pivot", similarity)).select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
    links = written(_confirmed(star, sets, similarity), "links")
    roots = components(links)
    removed(links)
    members = members.select("band", "node", "n_shingles")
    turn = 0
    while True:  # a few more pivots for those left outside, as long as that links many of them
        mixed = _mixed(members, roots)
        if mixed.isEmpty():  # no band holds several components: nothing is left to compare
            linked = 0
            break
        star = written(_next_star(mixed, turn, similarity), "star")
        links = written(_confirmed(star, sets, similarity), "links")
        tried, linked = star.count(), links.count()
        if linked:
            before, roots = roots, components(links.union(roots.select("node", "root")))
            removed(before)
            removed(mixed)
        removed(star)
        removed(links)
        turn += 1
        if linked * MANY < tried or not linked:
            break
    mixed = _mixed(members, roots) if linked else mixed
    if not mixed.isEmpty():
        links = written(_confirmed(_rest(mixed, sets, similarity), sets, similarity), "links")
        roots = components(links.union(roots.select("node", "root"))) if not links.isEmpty() else roots
        removed(links)
    linked = classes.drop("bands").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("n_classes"))
    joined = written(attach(linked, least, ["root"], ["component"], "n_classes", F.col("node")).select(*name, "n_docs", "component"), "components")
    for t in (pivots, members, sets, mixed, classes):
        removed(t)
    out = attach(signed.drop("bands"), joined, name, ["component"], "n_docs", F.col("doc_id"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SPACES, attach, written

PREFIX_CHARS = 256


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after all of `[\\x20\\x09-\\x0D]` is deleted.
    Of equal texts the row of most code points, then of the smallest id stays.

    Refinement works on thin rows: those of a length that no other row has are
    settled first; of the others, those whose prefix hash no other row of that
    length has; only what is left is grouped by the full hash. With `digest_all`
    the full hash is wanted for every row anyway, so the first scan makes it and
    no text is read again; otherwise the texts of what is left alone are read in
    full (a second scan) and text_sha256 is null for rows settled earlier.

    Null and empty texts form one group. A null id loses ties against any other
    id. Rows repeated with one id are members like any other. An empty table
    gives an empty result; columns other than id and text are not read.
    """
    norm = squeezed(F.col(text_col))
    thin = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_code"), norm.alias("norm"))
    thin = thin.select(
        "doc_id", "n_code", F.length("norm").alias("norm_len"),
        F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"),
        (F.sha2("norm", 256) if digest_all else F.lit(None).cast("string")).alias("text_sha256"),
    )
    thin = written(thin, "exact")
    by_length = thin.groupBy("norm_len").agg(F.count(F.lit(1)).alias("n_length"))
    same_length = written(attach(thin, by_length.filter("n_length > 1"), ["norm_len"], ["n_length"], "n_length", F.col("doc_id")), "exact-length")
    alone = same_length.filter("n_length is null").drop("n_length")
    same_length = same_length.filter("n_length > 1").drop("n_length")
    by_prefix = same_length.groupBy("norm_len", "prefix").agg(F.count(F.lit(1)).alias("n_prefix"))
    same_prefix = written(attach(same_length, by_prefix.filter("n_prefix > 1"), ["norm_len", "prefix"], ["n_prefix"], "n_prefix", F.col("doc_id")), "exact-prefix")
    alone = alone.unionByName(same_prefix.filter("n_prefix is null").drop("n_prefix"))
    survivors = same_prefix.filter("n_prefix > 1").drop("n_prefix")
    if not digest_all:  # each row left brings its own text, so rows of one id stay as many as they were
        left = survivors.select(F.col("doc_id").alias("_id"), F.col("norm_len").alias("_len"), F.col("prefix").alias("_prefix")).distinct()
        again = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_code"), norm.alias("norm"))
        again = again.select("doc_id", "n_code", F.length("norm").alias("norm_len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"), "norm")
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("norm_len") == F.col("_len")) & (F.col("prefix") == F.col("_prefix"))
        survivors = written(again.join(left, same, "left_semi").select("doc_id", "n_code", "norm_len", "prefix", F.sha2("norm", 256).alias("text_sha256")), "exact-full")
    best = F.struct(-F.col("n_code"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = survivors.groupBy("norm_len", "text_sha256").agg(F.min(best).getField("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = attach(survivors, groups, ["norm_len", "text_sha256"], ["keep_id", "group_size"], "group_size", F.col("doc_id"))
    out = grouped.unionByName(alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

"""Repeated lines: hashes in range order, first occurrences streamed, bitmaps returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SPACES, ascii_lower, unused, written
from skein.llm.occurrences import later_occurrences

LEAST_CHARS, LEAST_DOCS = 20, 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, dropped): for documents that lose lines, a map from word number to the 64 bits of lines 64 * word on that go.

    Lines that stay are zero bits and words without a one are left out: a
    compressed keep bitmap, whose size follows the lines that go. A line's key
    has `[\\x20\\x09-\\x0D]` stripped and A-Z lowered; keys of `least_chars` code
    points in `least_docs` documents or more stay in the largest id only.
    """
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    keys = lines.filter(F.length("line") >= least_chars).select("doc_id", "pos", key.alias("key")).filter(F.length("key") >= least_chars)
    rows = keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), F.bitwise_not("doc_id").alias("ord"), "pos", F.lit(0).alias("size"))
    gone = later_occurrences(rows, least=least_docs, by_doc=True).select(F.bitwise_not("ord").alias("doc_id"), "pos")
    words = gone.groupBy("doc_id", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All rows and columns of docs, then n_lines, n_dropped, kept_text.

    Hashes of 128 bits stand for lines; the lines' text is not moved. The
    bitmaps meet the texts in one join by id.

    A null or empty text is one empty line, which stays. Rows without an id, and
    lines shorter than the bound, lose nothing and count nowhere. Rows of one id
    count as one document and lose the same line numbers; ids are whole numbers.
    Columns named as the new ones are replaced, others kept whatever their name. An empty table gives an empty result.
    """
    bitmaps = written(drop_bitmaps(docs, id_col=id_col, text_col=text_col, least_chars=least_chars, least_docs=least_docs), "bitmaps")
    own, gone = unused(docs, "_id"), unused(docs, "_dropped")
    joined = docs.withColumn(own, F.col(id_col).cast("long")).join(bitmaps.withColumnsRenamed({"doc_id": own, "dropped": gone}).hint("merge"), own, "left")  # no bound is known, so no broadcast
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.when(F.col(gone).isNull(), F.array(text)).otherwise(F.filter(lines_of(F.col(text_col)), lambda x, i: F.coalesce(F.try_element_at(gone, F.shiftright(i, 6)).bitwiseAND(_bit(i)), F.lit(0)) == 0))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.coalesce(F.aggregate(F.map_values(gone), F.lit(0), lambda a, x: a + F.bit_count(x)), F.lit(0))
    keep = [f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    return joined.select(*keep, n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), F.array_join(lines, "\n").alias("kept_text"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63)))

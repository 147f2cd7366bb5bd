"""A corpus prepared for training: quality, lines, near duplicates, benchmark leaks, token ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import removed, shared_dir
from skein.llm.decontaminate import decontaminate
from skein.llm.line_dedup import line_dedup
from skein.llm.near_dedup import near_dedup
from skein.llm.quality import score_quality, train_quality
from skein.llm.sentencepiece_codec import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates in a pipeline stage take five words.
SHINGLE = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts good; the field learns from labels of the corpus's documents, a bounded sample.

    Every row is judged by its own text: rows without an id, repeated rows, very
    long texts like any other; a null or empty text is one empty line.
    """
    corpus, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = train_quality(corpus.select("doc_id", "text"), labels)
    return score_quality(docs.select(*COLUMNS), field).filter("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document left without text by that goes too, one that lost none stays as it is, null or empty texts and rows without an id among them."""
    cut = line_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = cut.filter((F.col("n_dropped") == 0) | (F.length(F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r"))) > 0)).withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least id; rows without an id are linked with nothing and stay, rows repeated with a kept id all stay."""
    kept = near_dedup(docs, shingle=SHINGLE).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*COLUMNS)
    return named.unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too many words of benchmark items go, each by its own text, also where its id is null or repeated."""
    marked = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=[c for c in COLUMNS if c != "doc_id"])
    return marked.filter("not contaminated").select(*COLUMNS)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every text, and whether they decode to it again; null and empty texts have none, rows repeated or without an id are encoded like any other."""
    return encode(docs.select("doc_id", "text"), round_trip=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", to_ids),
]

#: A trained classifier and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written in the shared folder and read again; what no later stage reads is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        if k:
            removed(docs)
        docs = spark.read.parquet(f"{base}/{k}")
    return docs

"""Queries of the text operators and, where SQL can say it, what they must return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.decontaminate import decontaminate
from skein.llm.exact_dedup import exact_dedup
from skein.llm.lang_id import identify_language, train_language
from skein.llm.license_scan import license_report
from skein.llm.license_scan import oracle_sql as license_sql
from skein.llm.line_dedup import line_dedup
from skein.llm.near_dedup import near_dedup
from skein.llm.quality import score_quality, train_quality
from skein.llm.sentencepiece_codec import codec_report
from skein.llm.sharding import histogram_shards
from skein.llm.substring_dedup import substring_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    field = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=_remainder(5) != 0)
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    return score_quality(docs, field).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(_documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train_language(docs, usable=_remainder(3) != 1)
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    return identify_language(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), digest_all=True)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(_documents(spark, sf_dir), whole=True)
    return cut.select("doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("repeats"), "runs", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_report(_documents(spark, sf_dir))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE: dict[str, str] = {
    "op5_license_scan": license_sql(),
    "op3_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        d AS (SELECT k.*, coalesce(keeper <> doc_id, false) AS gone FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM d GROUP BY doc_id""",
    "op4_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i : i + 3], ' ') for i in range(1, greatest(len(w) - 3, 1) + 1)]) END AS s FROM w),
        e AS (SELECT DISTINCT s, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS doc_id FROM s WHERE len(s) > 0),
        x AS (SELECT doc_id, n, unnest(s) AS t FROM e),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        g AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
        r(a, b) AS (SELECT doc_id, doc_id FROM e UNION SELECT r.a, g.v FROM r JOIN g ON g.u = r.b),
        c AS (SELECT a, min(b) AS root FROM r GROUP BY a)
        SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id, coalesce(c.root, s.doc_id) = s.doc_id AS kept
        FROM s LEFT JOIN e ON e.s = s.s LEFT JOIN c ON c.a = e.doc_id""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept, sha256(norm) AS text_sha256 FROM t""",
    "op6_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        s AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest([array_to_string(w[i : i + least(len(w), 13) - 1], ' ') for i in range(1, greatest(len(w) - 13 + 1, 1) + 1)]) AS x FROM b WHERE len(w) > 0),
        p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n),
        m AS (SELECT doc_id, i, p.n, item_id FROM p JOIN s ON s.n = p.n AND s.x = array_to_string(w[i : i + p.n - 1], ' ')),
        h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
        k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
        SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""",
}

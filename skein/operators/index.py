"""The word index: postings written by term with their statistics, and ranked search that reads only a query's terms."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import message_directness, snippet
from skein.operators.lexical import MESSAGE_NUDGE, B, K1, ordering, postings, substring_search
from skein.plans.query import is_precise, needs_substring, parse_boolean, phrases_of, terms_of
from skein.sources.tables import shared_dir

#: Folders that terms are spread over by their hash; a query opens one for each of its terms.
BUCKETS = 64


@dataclass(frozen=True)
class Index:
    """Where an index lies: postings (id, tf, positions, length) by bucket and term, and one row of statistics."""

    path: str

    def postings(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """Postings of the terms: of the folders only theirs are listed, of these only row groups that may hold them are read."""
        wanted = [t.lower() for t in terms]
        buckets = F.array(*(_bucket(F.lit(t)) for t in wanted))
        numbers = spark.range(1).select(buckets.alias("b")).first().b if wanted else []
        schema = "id long, term string, tf int, positions array<int>, length int, bucket int"
        return spark.read.schema(schema).parquet(f"{self.path}/postings").filter(F.col("bucket").isin(*numbers) & F.col("term").isin(*wanted))

    def statistics(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("n long, avg_length double").parquet(f"{self.path}/statistics")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(rows: DataFrame, id_col: str, text_col: str, path: str) -> Index:
    """Write the index of a table. One shuffle by (id, term) makes the postings, one by bucket and range of term lays them out.

    A term's postings lie in the order of ids within a file and may fill many
    files, so a word that most rows hold is no task's burden.
    """
    spark = rows.sparkSession
    made = postings(rows, id_col, text_col).withColumn("bucket", _bucket(F.col("term")))
    made.write.mode("errorifexists").parquet(f"{path}/made")  # written first: the range shuffle reads its input twice
    laid = spark.read.schema(made.schema).parquet(f"{path}/made").repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
    laid.write.partitionBy("bucket").parquet(f"{path}/postings")
    every = rows.select(F.size(F.regexp_extract_all(F.lower(text_col), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("length"))
    every.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length")).write.parquet(f"{path}/statistics")
    _delete(spark, f"{path}/made")
    return Index(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _state(df: DataFrame) -> str:
    """A digest of the files a table is read from: names, sizes and times."""
    spark = df.sparkSession
    out = hashlib.sha256()
    for f in sorted(df.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        out.update(f"{f} {s.getLen()} {s.getModificationTime()}\n".encode())
    return out.hexdigest()


@lru_cache(maxsize=64)
def _built(application: str, name: str, state: str) -> list[Index]:
    return []


def current(rows: DataFrame, id_col: str, text_col: str, name: str) -> Index:
    """The index of a table read from files: built on first use, and anew once the files have changed."""
    spark = rows.sparkSession
    held = _built(spark.sparkContext.applicationId, name, _state(rows))
    if not held:
        held.append(build(rows, id_col, text_col, f"{shared_dir(spark)}/index-{name}-{uuid.uuid4().hex}"))
    return held[0]


def ranked(index: Index, spark: SparkSession, terms: list[str]) -> DataFrame:
    """(id, rank): BM25 of any of the terms over the whole indexed table, negated; only the terms' postings are read."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    own = index.postings(spark, terms)
    counts = own.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(index.statistics(spark)))  # a row a term, and one row
    weight = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return own.join(F.broadcast(counts), "term").groupBy("id").agg((-F.sum(part)).alias("rank"))


def matching(index: Index, spark: SparkSession, query: str) -> DataFrame:
    """(id): rows that a query of words finds, from the postings alone: all required groups, none of the excluded, phrases by position."""
    asked, phrases = parse_boolean(query), [p.lower().split() for p in phrases_of(query)]
    words = list(dict.fromkeys([w for g in asked.required for w in g] + asked.excluded + [w for p in phrases for w in p]))
    rows = index.postings(spark, words).groupBy("id").agg(F.collect_set("term").alias("held"), *(F.first(F.when(F.col("term") == w, F.col("positions")), True).alias(f"p{i}") for i, w in enumerate(words)))
    keep = F.lit(True)
    for group in asked.required:
        keep = keep & F.arrays_overlap("held", F.array(*map(F.lit, group)))
    if asked.excluded:
        keep = keep & ~F.arrays_overlap("held", F.array(*map(F.lit, asked.excluded)))
    for p in phrases:
        places = F.col(f"p{words.index(p[0])}")
        for k, w in enumerate(p[1:], 1):
            places = F.array_intersect(places, F.transform(f"p{words.index(w)}", _back(k)))
        keep = keep & (F.coalesce(F.size(places), F.lit(0)) > 0)
    return rows.filter(keep).select("id")


def _back(k: int):
    return lambda x: x - k


def search(rows: DataFrame, index: Index, query: str, *, id_col: str = "store_id", text_col: str = "content", sort: str = "recency", limit: int = 20, where: Column | None = None, now: float = 0.0, nudge: float = MESSAGE_NUDGE) -> DataFrame:
    """What `lexical.search` finds, by the index: only the query's postings and the rows they name are read.

    Statistics are those of the whole indexed table, whatever `where` leaves.
    Queries that words can't answer are searched as substrings, over all rows.
    """
    spark, terms, phrases = rows.sparkSession, terms_of(query), phrases_of(query)
    base = rows.filter(where) if where is not None else rows
    asked = parse_boolean(query)
    single = [w for g in asked.required for w in g]
    if not terms or needs_substring(query) or not single:
        found = substring_search(base, terms, sort=sort, limit=limit, now=now, binary=True)
        return found if terms else found.limit(0)
    hits = ranked(index, spark, single).join(matching(index, spark, query), "id").withColumnRenamed("id", id_col)
    out = base.join(hits, id_col)
    role = F.col("role") if "role" in rows.columns else F.lit(None).cast("string")
    out = out.withColumn("directness", message_directness(F.col(text_col), F.coalesce(role, F.lit("")), terms, phrases))
    if is_precise(terms, phrases):
        out = out.withColumn("rank", F.col("rank") - F.greatest("directness", F.lit(0.0)) * nudge)
    order = ordering(sort, now, role="role" if "role" in rows.columns else None, id_col=id_col)
    return out.withColumns({"rank": F.round("rank", 9), "snippet": snippet(F.col(text_col), terms)}).orderBy(*order).limit(limit)



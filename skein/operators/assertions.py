"""Bitemporal assertions: publishing, validity as of a time, state from relations, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Relations that end what they point at.
ENDING = {"supersedes": "superseded", "cancels": "cancelled", "fulfills": "fulfilled", "reverses": "reversed"}
GROUP = ["subject_key", "predicate_key", "scope_key", "kind"]
IDENTITY = ["source_store_id", "subject_key", "predicate_key", "object_json", "kind", "polarity", "scope_key", "span_start", "span_end"]


def assertion_id() -> Column:
    """An id made of what the assertion says and where."""
    return F.sha2(F.to_json(F.struct(*IDENTITY)), 256)


def well_formed() -> Column:
    """Subjects `namespace:value` in lower case with single spaces, predicates of the known form, probabilities in [0, 1]."""
    s, p = F.col("subject_key"), F.col("predicate_key")
    return (s == F.lower(F.btrim(F.regexp_replace(s, r"\s+", " ")))) & s.rlike(r"^[a-z][a-z0-9_-]*:\S") & p.rlike(r"^[a-z][a-z0-9_.-]{0,127}$") & F.coalesce(F.col("confidence").between(0, 1), F.lit(True))


def grounded(assertions: DataFrame, messages: DataFrame) -> DataFrame:
    """Assertions whose quote is still what their message says at their span."""
    text = messages.select(F.col("store_id").alias("source_store_id"), "content")
    same = F.substring(F.col("content"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) == F.col("quote")
    return assertions.join(text, "source_store_id").filter((F.col("span_end") > F.col("span_start")) & same).drop("content")


def publish(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new assertions in it; the same said of the same place is there once."""
    fresh = new.filter(well_formed()).withColumn("assertion_id", assertion_id()).dropDuplicates(["assertion_id"])
    return store.unionByName(fresh.join(store.select("assertion_id"), "assertion_id", "left_anti").select(*store.columns))


def pending_sources(messages: DataFrame, receipts: DataFrame, version: str, limit: int = 500) -> DataFrame:
    """Messages without a live receipt of an extraction version, in order."""
    live = receipts.filter((F.col("version") == version) & F.col("invalidated_at").isNull()).select(F.col("source_store_id").alias("store_id"))
    return messages.join(live, "store_id", "left_anti").orderBy("store_id").limit(limit)


def invalidate(receipts: DataFrame, sources: DataFrame, at: float) -> DataFrame:
    marked = receipts.join(sources.select("source_store_id", F.lit(True).alias("_x")).distinct(), "source_store_id", "left")
    return marked.withColumn("invalidated_at", F.when(F.col("_x") & F.col("invalidated_at").isNull(), F.lit(at)).otherwise(F.col("invalidated_at"))).drop("_x")


def visible(assertions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Assertions of sources whose receipt isn't invalidated."""
    return assertions.join(receipts.filter(F.col("invalidated_at").isNull()).select("source_store_id").distinct(), "source_store_id", "left_semi")


def as_of(assertions: DataFrame, at: float) -> DataFrame:
    """Known and valid at a time; an open bound holds for ever."""
    t = F.lit(float(at))
    return assertions.filter((F.col("observed_at") <= t) & (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def state(assertions: DataFrame, relations: DataFrame) -> DataFrame:
    """Each assertion with `statuses` (how others ended it), `active`, `contradicted`, `n_objects` of its group, `conflict` and, for recommendations, `disposition`.

    Objects of a group that are still active and differ conflict; all are kept.
    """
    names = F.create_map(*(F.lit(x) for kv in ENDING.items() for x in kv))
    inbound = relations.groupBy(F.col("to_id").alias("assertion_id")).agg(
        F.array_sort(F.array_compact(F.collect_set(F.try_element_at(names, F.col("type"))))).alias("statuses"), F.bool_or(F.col("type") == "contradicts").alias("hit"), F.bool_or(F.col("type") == "accepts").alias("yes"), F.bool_or(F.col("type") == "declines").alias("no"),
    )
    outbound = relations.filter("type = 'contradicts'").select(F.col("from_id").alias("assertion_id"), F.lit(True).alias("hits")).distinct()
    rows = assertions.join(inbound, "assertion_id", "left").join(outbound, "assertion_id", "left")
    rows = rows.withColumn("statuses", F.coalesce("statuses", F.array().cast("array<string>"))).withColumns({"active": F.size("statuses") == 0, "contradicted": F.coalesce("hit", F.lit(False)) | F.coalesce("hits", F.lit(False))})
    counts = rows.filter("active").groupBy(*GROUP).agg(F.countDistinct("object_json").alias("n_objects"))
    rows = rows.join(counts, GROUP, "left").withColumn("n_objects", F.coalesce("n_objects", F.lit(0)))
    answer = F.when(F.col("yes") & F.col("no"), "conflicting").when(F.col("yes"), "accepted").when(F.col("no"), "declined").otherwise("unanswered")
    return rows.withColumns({"conflict": F.col("active") & (F.col("contradicted") | (F.col("n_objects") > 1)), "disposition": F.when(F.col("kind") == "recommendation", answer)}).drop("hit", "hits", "yes", "no")


def latest_fact(assertions: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Of each group the object of the newest time; several objects at that time are a conflict, and none is chosen."""
    at = F.coalesce("event_at", "observed_at")
    top = assertions.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(at.desc()))).filter("_r = 1")
    return top.groupBy(*by).agg(F.max(at).alias("at"), F.countDistinct("object_json").alias("n"), F.min("object_json").alias("object_json")).select(*by, "at", F.when(F.col("n") == 1, F.col("object_json")).alias("object_json"), (F.col("n") > 1).alias("conflict"))


def related(assertions: DataFrame, relations: DataFrame, receipts: DataFrame) -> DataFrame:
    """Relations whose own source and both ends are visible, with what the ends say."""
    live = visible(assertions, receipts).select("assertion_id", "subject_key", "object_json", "observed_at")
    ends = {p: live.select(*(F.col(c).alias(f"{p}_{c.removeprefix('assertion_')}") for c in live.columns)) for p in ("from", "to")}
    sources = receipts.filter(F.col("invalidated_at").isNull()).select("source_store_id").distinct()
    return relations.join(sources, "source_store_id", "left_semi").join(ends["from"], "from_id").join(ends["to"], "to_id")


def attribution(speaker: Column, subject: Column) -> Column:
    return F.when(subject == F.concat(F.lit("person:"), speaker), "first_person").when(subject.startswith("person:") & subject.isin("person:user", "person:assistant"), "addressee").otherwise("third_party")


def parse_candidates(payloads: DataFrame, messages: DataFrame) -> DataFrame:
    """Assertions in a model's JSON (store_id, payload) with exact spans in their message; rows that don't fit the schema are dropped."""
    item = "struct<subject_key:string,predicate_key:string,object:string,kind:string,polarity:string,scope_key:string,span_start:int,span_end:int,quote:string,confidence:double>"
    each = payloads.select(F.col("store_id").alias("source_store_id"), F.explode(F.from_json("payload", f"struct<assertions:array<{item}>>")["assertions"]).alias("a")).select("source_store_id", "a.*").withColumnRenamed("object", "object_json")
    return grounded(each.filter(well_formed()), messages)

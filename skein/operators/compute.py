"""Computation over cited evidence that refuses rather than guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MINUTES = {"minute": 1.0, "hour": 60.0, "day": 1440.0, "week": 10080.0}
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ALIASES = {"hr": "hour", "hrs": "hour", "min": "minute", "mins": "minute", "wk": "week", "usd": "dollar", "$": "dollar", "people": "person", "kg": "kilogram", "km": "kilometre", "mi": "mile"}


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def unit_of(unit: Column) -> Column:
    """Lower case, singular, aliases resolved."""
    low = F.lower(F.btrim(unit))
    return F.nullif(F.coalesce(F.try_element_at(_map(ALIASES), low), F.regexp_replace(low, "(?<=[a-z]{2})s$", "")), F.lit(""))


def numbers_in(text: Column) -> Column:
    """Numbers that a text states, in digits or in words up to twenty."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w.])(-?\d[\d,]*(?:\.\d+)?)(?![\w])"), 1), lambda x: F.expr("try_cast('0' as double)") * 0 + F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({'|'.join(NUMBERS)})\b"), 1), lambda w: F.try_element_at(_map({w: float(i) for i, w in enumerate(NUMBERS)}), w))
    return F.concat(digits, words)


def ground(operands: DataFrame, messages: DataFrame) -> DataFrame:
    """Operands with `problem`: why their reference, quote, value or unit isn't what the message says; null if it is."""
    text = messages.select("store_id", "content")
    slice_ = F.substring(F.col("content"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    value = F.col("value").try_cast("double")
    unit = unit_of(F.col("unit"))
    problem = (
        F.when(F.col("content").isNull(), "missing_source").when((F.col("span_start") < 0) | (F.col("span_end") <= F.col("span_start")) | (F.col("span_end") > F.length("content")), "bad_span").when(slice_ != F.col("quote"), "quote_mismatch")
        .when(F.col("value").isNotNull() & ~F.coalesce(F.exists(numbers_in(F.col("quote")), lambda x: x == value), F.lit(False)), "value_not_quoted").when(unit.isNotNull() & ~F.contains(F.lower("quote"), unit), "unit_not_quoted")
    )
    return operands.join(text, "store_id", "left").withColumns({"problem": problem, "unit": unit}).drop("content")


def _checked(rows: DataFrame, by: list[str], result: Column, *rules: tuple[Column, str]) -> DataFrame:
    out = F.lit(None).cast("string")
    for bad, reason in reversed(rules):
        out = F.when(bad, reason).otherwise(out)
    return rows.groupBy(*by).agg(result.alias("result"), out.alias("refused")).withColumn("result", F.when(F.col("refused").isNull(), F.col("result")))


def _unique(ref: str) -> tuple[Column, str]:
    return F.count(F.lit(1)) != F.countDistinct(ref), "duplicate_reference"


def count_distinct(rows: DataFrame, by: list[str], key: str = "key", unit: str = "unit", ref: str = "ref") -> DataFrame:
    return _checked(rows, by, F.countDistinct(key), _unique(ref), (F.count_if(F.col(key).isNull()) > 0, "missing_key"), (F.countDistinct(unit) > 1, "mixed_units"))


def in_minutes(unit: Column) -> Column:
    return F.try_element_at(_map(MINUTES), unit)


def sum_units(rows: DataFrame, by: list[str], to: str | None = None, value: str = "value", unit: str = "unit", ref: str = "ref") -> DataFrame:
    """Sum in the unit asked for or the smallest present; units convert among times only."""
    factor = in_minutes(F.col(unit))
    target = F.lit(MINUTES[to]) if to in MINUTES else F.min(factor)
    mixed = (F.countDistinct(unit) > 1) & (F.count_if(factor.isNull()) > 0)
    total = F.when(F.count_if(factor.isNull()) == 0, F.sum(F.col(value) * factor) / target).otherwise(F.sum(value))
    return _checked(rows, by, F.round(total, 6), _unique(ref), (F.count_if(F.col(value).isNull()) > 0, "missing_value"), (mixed, "mixed_units"))


def difference(rows: DataFrame, by: list[str], value: str = "value", role: str = "role", unit: str = "unit") -> DataFrame:
    """Minuend less subtrahend; a directed difference below zero contradicts the question and is refused."""
    a, b = F.sum(F.when(F.col(role) == "minuend", F.col(value))), F.sum(F.when(F.col(role) == "subtrahend", F.col(value)))
    return _checked(rows, by, F.round(a - b, 6), ((F.count_if(F.col(role) == "minuend") != 1) | (F.count_if(F.col(role) == "subtrahend") != 1), "two_operands_needed"), (F.countDistinct(unit) > 1, "mixed_units"), (a < b, "direction_contradicted"))


def months_between(a: Column, b: Column) -> Column:
    """Whole months from a to b: months apart, one less while the later day of the month isn't reached."""
    return 12 * (F.year(b) - F.year(a)) + F.month(b) - F.month(a) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)


def date_interval(a: Column, b: Column, unit: str) -> Column:
    lo, hi = F.least(a, b), F.greatest(a, b)
    return {"day": F.datediff(hi, lo), "week": F.floor(F.datediff(hi, lo) / 7).cast("int"), "month": months_between(lo, hi)}[unit]


def order_events(rows: DataFrame, by: list[str], at: str, ref: str) -> DataFrame:
    """Places of dated rows in time; rows of one date share a place."""
    return rows.filter(F.col(at).isNotNull()).withColumn("place", F.dense_rank().over(Window.partitionBy(*by).orderBy(at))).orderBy(*by, "place", ref)


def occurrence_day(text: Column, session_day: Column) -> Column:
    """(day, basis): the one ISO date of a text, else the one relative phrase counted from the session's day, else null and why."""
    iso = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1))
    phrase = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(yesterday|today|tomorrow|\d+ days? ago|\d+ weeks? ago|\d+ months? ago)\b"), 1))
    p = phrase[0]
    n = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    day = F.when(p == "today", session_day).when(p == "yesterday", F.date_sub(session_day, 1)).when(p == "tomorrow", F.date_add(session_day, 1)).when(p.contains("day"), F.date_sub(session_day, n)).when(p.contains("week"), F.date_sub(session_day, n * 7)).when(p.contains("month"), F.add_months(session_day, -n))
    one = F.when(F.size(iso) == 1, iso[0].try_cast("date"))
    basis = F.when(F.size(iso) > 1, "several_dates").when(one.isNotNull(), "explicit").when(F.size(iso) == 1, "invalid_date").when(F.size(phrase) > 1, "several_phrases").when(F.size(phrase) == 1, "relative").otherwise("none")
    return F.struct(F.when(basis == "explicit", one).when(basis == "relative", day).alias("day"), basis.alias("basis"))


def observation_day(session_day: Column, observed: Column, ingested: Column) -> Column:
    """(day, label): the session's day before the observed time before the time of writing."""
    of = lambda e: F.to_date(F.timestamp_seconds(e))
    return F.struct(F.coalesce(session_day, of(observed), of(ingested)).alias("day"), F.when(session_day.isNotNull(), "session").when(observed.isNotNull(), "observed").when(ingested.isNotNull(), "ingested").alias("label"))


def candidates_in(rows: DataFrame, text: str = "content") -> DataFrame:
    """(…, place, clause, number): each number in each clause that is no question."""
    clauses = rows.select("*", F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+|\n+")).alias("place", "clause")).filter(~F.rtrim("clause").endswith("?"))
    return clauses.select("*", F.explode(numbers_in(F.col("clause"))).alias("number"))


def anchor_score(tokens: Column, anchors: Column, slot: Column) -> Column:
    """Anchor words met, and four more where the slot's anchor is met whole."""
    return F.size(F.array_intersect(tokens, anchors)) + F.when((F.size(slot) > 0) & (F.size(F.array_except(slot, tokens)) == 0), 4).otherwise(0)


def unique_span(text: Column, quote: Column) -> Column:
    """(start, end) of a quote that a text holds once; else null."""
    once = (F.length(text) - F.length(F.replace(text, quote, F.lit("")))) == F.length(quote)
    at = F.instr(text, quote) - 1
    return F.when((F.length(quote) > 0) & once & (at >= 0), F.struct(at.alias("start"), (at + F.length(quote)).alias("end")))

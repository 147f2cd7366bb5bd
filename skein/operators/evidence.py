"""Evidence for an answer: references resolved to exact quotes, values and clauses found in them, what is eligible, what is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.compute import NUMBERS, unit_of

#: A clause ends at one of these; a point or comma between digits ends none.
CLAUSE_END = r"(?i)(?:(?<!\d)[.,]|[.,](?!\d)|[!?;\n]|\band\b|\bplus\b)"
NUMBER = rf"(?i)(-?(?<![\w.,])\d[\d,]*(?:\.\d+)?(?![\w])|\b(?:{'|'.join(NUMBERS)})\b)"
UNIT_BEHIND = r"^\s{0,20}([A-Za-z][A-Za-z-]{2,})\b"
NAME = r"(\b[A-Z][A-Za-z'-]*(?:\s+[A-Z][A-Za-z'-]*){0,2}\b)"
# Names that are no names of an event.
NO_NAMES = ("A", "An", "During", "I", "In", "My", "On", "The", "This", "We")


def resolved(candidates: DataFrame, messages: DataFrame, max_quote: int = 4000) -> DataFrame:
    """Candidates (store_id, span_start, span_end, quote or null) with exact span, quote and session, or `problem`.

    A quote given must stand in the span just once; the span is then narrowed to
    it. Without one the whole span is quoted. One join by id, text read once.
    """
    rows = candidates.join(messages.select("store_id", "session_id", "content"), "store_id", "left")
    window = F.substring(F.col("content"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    asked = F.nullif("quote", F.lit(""))
    first = F.instr(F.col("_w"), asked)
    again = F.instr(F.substring(F.col("_w"), first + 1, F.length("_w")), asked) > 0
    problem = (
        F.when(F.col("content").isNull(), "missing_source").when((F.col("span_start") < 0) | (F.col("span_end") <= F.col("span_start")) | (F.col("span_end") > F.length("content")), "span_out_of_bounds")
        .when(F.length(F.coalesce(asked, "_w")) > max_quote, "quote_too_long").when(asked.isNotNull() & (first == 0), "quote_not_in_span").when(asked.isNotNull() & again, "quote_ambiguous")
    )
    rows = rows.withColumn("_w", window).withColumns({"problem": problem, "_s": F.when(asked.isNull(), F.col("span_start")).otherwise(F.col("span_start") + first - 1)})
    rows = rows.withColumns({"quote": F.when(F.col("problem").isNull(), F.coalesce(asked, "_w")), "span_start": F.when(F.col("problem").isNull(), F.col("_s")).otherwise(F.col("span_start"))})
    return rows.withColumn("span_end", F.when(F.col("problem").isNull(), F.col("span_start") + F.length("quote")).otherwise(F.col("span_end"))).drop("_w", "_s", "content")


def pack(candidates: DataFrame, messages: DataFrame, group: str, order: str, *, per_session: int = 3, max_items: int = 12, max_chars: int = 6000) -> DataFrame:
    """The evidence pack of each question: resolved candidates in order, few of a session, while items and characters fit; the rest with why they are out.

    Ranks and running sums in one window each; candidates of one question are a
    result already cut to its top.
    """
    rows = resolved(candidates, messages)
    fine = F.col("problem").isNull()
    once = F.row_number().over(Window.partitionBy(group, "store_id", "span_start", "span_end").orderBy(order))
    rows = rows.withColumn("problem", F.when(fine & (once > 1), "repeated").otherwise(F.col("problem")))
    n = F.sum(F.when(fine, 1).otherwise(0)).over(Window.partitionBy(group, "session_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("problem", F.when(fine & (n > per_session), "session_full").otherwise(F.col("problem")))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    used, items = F.sum(F.when(fine, F.length("quote")).otherwise(0)).over(w), F.sum(F.when(fine, 1).otherwise(0)).over(w)
    rows = rows.withColumns({"_u": used, "_i": items})
    return rows.withColumn("problem", F.when(fine & (F.col("_i") > max_items), "items_full").when(fine & (F.col("_u") > max_chars), "chars_full").otherwise(F.col("problem"))).drop("_u", "_i")


def completeness(packed: DataFrame, group: str, *, exact: int | None = None, least: int = 1, needs_all: bool = False) -> DataFrame:
    """(group, grounded, rejected, state, reason) of packs: closed only where the operation's number of operands is met and none was rejected."""
    full = F.col("problem").isin("repeated", "session_full", "items_full", "chars_full")
    rows = packed.groupBy(group).agg(F.count_if(F.col("problem").isNull()).alias("grounded"), F.count_if(F.col("problem").isNotNull() & ~full).alias("rejected"))
    fixed = F.lit(False) if exact is None else F.col("grounded") == exact
    enough = F.lit(not needs_all) & (F.col("grounded") >= least)
    reason = F.when(F.col("rejected") > 0, "operand_grounding_incomplete").when(fixed, "fixed_cardinality_satisfied").when(enough, "minimum_cardinality_satisfied").otherwise("open_cardinality_not_closed")
    return rows.withColumn("reason", reason).withColumn("state", F.when(F.col("reason").isin("fixed_cardinality_satisfied", "minimum_cardinality_satisfied"), "closed").otherwise("partial"))


def _pieces(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, piece, found): the text between matches of a pattern with the place of each and the match that ends it."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), group)
    each = F.zip_with(parts, found, lambda p, m: F.struct(p.alias("p"), F.coalesce(m, F.lit("")).alias("m")))
    empty = F.array().cast("array<struct<start:int,piece:string,found:string>>")
    return F.aggregate(
        each, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), x["p"].alias("piece"), x["m"].alias("found")))).alias("out")),
        lambda a: a["out"],
    )


def clauses(sources: DataFrame, text: str = "quote", start: str = "span_start") -> DataFrame:
    """Sources with every clause of their text: clause, its place in the message, and whether it ends as a question."""
    out = sources.select("*", F.explode(_pieces(F.col(text), CLAUSE_END)).alias("_c"))
    lead = F.length("_c.piece") - F.length(F.ltrim(F.col("_c.piece")))
    out = out.withColumns({"clause": F.btrim("_c.piece"), "clause_start": F.col(start) + F.col("_c.start") + lead, "question": F.col("_c.found") == "?"})
    return out.filter(F.col("clause") != "").drop("_c")


def numeric_candidates(sources: DataFrame) -> DataFrame:
    """Every number that sources (store_id, span_start, quote, ...) state outside of questions: value, unit, its clause and the exact span of number and unit."""
    rows = clauses(sources).filter(~F.col("question")).select("*", F.explode(_pieces(F.col("clause"), NUMBER, 1)).alias("_n"))
    rows = rows.filter(F.col("_n.found") != "").withColumn("_from", F.col("_n.start") + F.length("_n.piece"))
    behind = F.substring(F.col("clause"), F.col("_from") + F.length("_n.found") + 1, F.lit(40))
    dollar = F.col("_n.piece").rlike(r"\$\s{0,2}$")
    phrase = F.regexp_extract(behind, UNIT_BEHIND, 0)
    words = F.create_map(*(F.lit(x) for i, w in enumerate(NUMBERS) for x in (w, float(i))))
    value = F.coalesce(F.replace(F.col("_n.found"), F.lit(","), F.lit("")).try_cast("double"), F.try_element_at(words, F.lower("_n.found")))
    unit = F.when(dollar, "dollar").otherwise(unit_of(F.nullif(F.regexp_extract(behind, UNIT_BEHIND, 1), F.lit(""))))
    first = F.col("clause_start") + F.col("_from")
    return rows.withColumns({"value": value, "unit": unit, "value_start": first, "value_end": first + F.length("_n.found") + F.when(dollar, 0).otherwise(F.length(phrase))}).drop("_n", "_from")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def anchor_score(text: Column, anchors: Column, slot: Column | None = None) -> Column:
    """Anchors that a text holds, and four more if it holds all words of the slot's anchor."""
    held = F.size(F.array_intersect(tokens(text), anchors))
    if slot is None:
        return held
    own = tokens(slot)
    return held + F.when((F.size(own) > 0) & (F.size(F.array_except(own, tokens(text))) == 0), 4).otherwise(0)


def eligible(candidates: DataFrame, as_of: Column, window: tuple[Column, Column] | None = None) -> DataFrame:
    """Candidates (observed_at, event_day, session_day) known by the end of a day, and within [start, end) where a window is asked for, with the day's basis."""
    known = F.col("observed_at").isNotNull() & (F.col("observed_at") < F.unix_timestamp(F.date_add(as_of, 1).cast("timestamp")))
    rows = candidates.filter(known & (F.col("event_day").isNull() | (F.col("event_day") <= as_of)))
    if window is None:
        return rows.withColumn("basis", F.lit(None).cast("string"))
    day = F.coalesce("event_day", "session_day")
    return rows.filter((day >= window[0]) & (day < window[1])).withColumn("basis", F.when(F.col("event_day").isNotNull(), "occurred_at").otherwise("session_day"))


def enumerated(messages: DataFrame, unit: str, forms: list[str], by: list[str]) -> DataFrame:
    """Events of a kind that users state, told apart by the names in their clause: (by..., n_events, events, n_sources).

    All messages are read, so the count is of all there is; no bound on rows.
    """
    said = F.lower("content").rlike(rf"\b(?:{'|'.join(forms)})\b")
    own = messages.filter((F.col("role") == "user") & said).select(*by, "store_id", F.col("content").alias("quote"), F.lit(0).alias("span_start"))
    rows = own.select("*", F.explode(F.regexp_extract_all("quote", F.lit(r"([^.!?\n]+[.!?\n]?)"), 1)).alias("clause"))
    rows = rows.filter(F.lower("clause").rlike(rf"\b(?:{'|'.join(forms)})\b") & ~F.rtrim(F.col("clause")).endswith("?") & F.col("clause").rlike(r"\b(?:I|we|We|my|My|our|Our)\b"))
    names = F.array_distinct(F.transform(F.filter(F.regexp_extract_all("clause", F.lit(NAME), 1), lambda x: ~x.isin(*NO_NAMES)), F.lower))
    rows = rows.withColumn("key", F.when(F.size(names) > 0, F.concat(F.lit(f"{unit} "), F.array_join(names, " ")))).filter(F.col("key").isNotNull())
    return rows.groupBy(*by).agg(F.countDistinct("key").alias("n_events"), F.array_sort(F.collect_set("key")).alias("events"), F.countDistinct("store_id").alias("n_sources"))


def adjacent_sources(messages: DataFrame, anchors: DataFrame, before: int, after: int, capacity: int) -> DataFrame:
    """(question, store_id, score, place): messages around scored anchors, the best anchors' first, each once, up to `capacity` a question; the anchors themselves are out."""
    from skein.operators.store import anchor_windows

    around = anchor_windows(messages, anchors, before, after).select("anchor_id", "store_id")
    rows = anchors.select(F.col("store_id").alias("anchor_id"), "question", "score").join(around, "anchor_id")
    best = rows.groupBy("question", "store_id").agg(F.max(F.struct("score", (-F.abs(F.col("store_id") - F.col("anchor_id"))).alias("near"), (-F.col("anchor_id")).alias("first"))).alias("b"))
    best = best.join(anchors.select("question", "store_id"), ["question", "store_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("b"), "store_id"))
    return best.withColumn("place", place).filter(F.col("place") <= capacity).select("question", "store_id", F.col("b.score").alias("score"), "place")

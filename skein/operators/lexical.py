"""Ranked word search over postings, substring search, and how results are ordered and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import WORD, message_directness, occurrences, snippet
from skein.plans.query import DECAY_PER_HOUR, Boolean, is_precise, needs_substring, parse_boolean, phrases_of, sort_mode, terms_of

K1, B = 1.2, 0.75
#: What a unit of directness is worth in rank, for messages and for summary nodes.
MESSAGE_NUDGE, NODE_NUDGE = 3e-7, 2e-7


def postings(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, positions, length): the index; build it once and write it bucketed by term for repeated use."""
    words = rows.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(text_col), F.lit(f"({WORD})"), 1).alias("w")).filter(F.size("w") > 0)
    each = words.select("id", F.size("w").alias("length"), F.posexplode("w").alias("position", "term"))
    return each.groupBy("id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"), F.first("length").alias("length"))


def bm25(rows: DataFrame, id_col: str, text_col: str, terms: list[str], corpus: DataFrame | None = None) -> DataFrame:
    """(id, rank): BM25 of any of the terms, negated, so that smaller is better.

    Only words that are query terms survive the scan; document counts are one
    row a term and broadcast. `corpus` is what statistics are taken over.
    """
    terms = [t.lower() for t in terms]

    def counted(df: DataFrame) -> DataFrame:
        w = df.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(text_col), F.lit(f"({WORD})"), 1).alias("w"))
        return w.select("id", F.size("w").alias("length"), F.transform(F.array(*map(F.lit, terms)), lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda x: x == t)).alias("tf"))).alias("hits"))

    every = counted(corpus if corpus is not None else rows)
    stats = every.select("length", *(F.col("hits")[i]["tf"].alias(f"f{i}") for i in range(len(terms)))).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    own = counted(rows) if corpus is not None else every
    scored = own.filter(F.exists("hits", lambda h: h["tf"] > 0)).crossJoin(F.broadcast(stats))  # stats: one row

    def part(i: int) -> Column:
        tf, df = F.col("hits")[i]["tf"], F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))

    return scored.select("id", (-sum((part(i) for i in range(len(terms))), F.lit(0.0))).alias("rank"))


def boolean_match(text: Column, query: Boolean) -> Column:
    """Whole-word test of a boolean query."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)
    out = F.lit(True)
    for group in query.required:
        out = out & F.arrays_overlap(words, F.array(*map(F.lit, group)))
    if query.excluded:
        out = out & ~F.arrays_overlap(words, F.array(*map(F.lit, query.excluded)))
    return out


def phrase_match(text: Column, phrase: str) -> Column:
    """Whether the phrase's words stand side by side as whole words."""
    words = F.array_join(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1), " ")
    return F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.lit(f" {' '.join(phrase.lower().split())} "))


def role_bias(role: Column) -> Column:
    return F.when(role == "user", 0).when(role == "tool", 2).otherwise(1)


def hybrid_rank(rank: Column, at: Column, now: float) -> Column:
    """A rank (negative) faded with age: older comes nearer to zero, which is worse."""
    return rank / (1 + F.greatest(F.lit(now) - at, F.lit(0.0)) / 3600 * DECAY_PER_HOUR)


def ordering(sort: str, now: float, rank: str = "rank", at: str = "timestamp", role: str | None = "role", id_col: str = "store_id") -> list[Column]:
    """A total order for one of the three sort modes, ending in the id."""
    bias = [role_bias(F.col(role))] if role else []
    recent, best = F.col(at).desc_nulls_last(), F.col(rank).asc()
    return {"recency": [recent, *bias, best], "relevance": [best, *bias, recent], "hybrid": [hybrid_rank(F.col(rank), F.col(at), now).asc(), *bias, recent]}[sort_mode(sort)] + [F.desc(id_col)]


def search(messages: DataFrame, query: str, *, sort: str = "recency", limit: int = 20, where: Column | None = None, now: float = 0.0, corpus: DataFrame | None = None) -> DataFrame:
    """Messages that a query finds with rank, directness and snippet: words by BM25, or substrings where words can't answer."""
    terms, phrases = terms_of(query), phrases_of(query)
    rows = messages.filter(where) if where is not None else messages
    if not terms:
        return substring_search(rows, terms, sort=sort, limit=limit, now=now).limit(0)
    if needs_substring(query):
        return substring_search(rows, terms, sort=sort, limit=limit, now=now, binary=True)
    asked = parse_boolean(query)
    single = [w for g in asked.required for w in g]
    match = boolean_match(F.col("content"), asked)
    for p in phrases:
        match = match & phrase_match(F.col("content"), p)
    ranked = bm25(rows.filter(match), "store_id", "content", single or terms, corpus if corpus is not None else messages).withColumnRenamed("id", "store_id")
    out = rows.join(ranked, "store_id").withColumn("directness", message_directness(F.col("content"), F.col("role"), terms, phrases))
    if is_precise(terms, phrases):
        out = out.withColumn("rank", F.col("rank") - F.greatest("directness", F.lit(0.0)) * MESSAGE_NUDGE)
    return out.withColumns({"rank": F.round("rank", 9), "snippet": snippet(F.col("content"), terms)}).orderBy(*ordering(sort, now)).limit(limit)


def substring_search(messages: DataFrame, terms: list[str], *, sort: str = "relevance", limit: int | None = 20, now: float = 0.0, binary: bool = False) -> DataFrame:
    """Messages that hold any term as a substring; the score counts occurrences, or terms held if `binary`; rank is its negative. Without a limit, all of them in no order."""
    counts = [occurrences(F.col("content"), t) for t in terms]
    score = sum(((F.least(c, F.lit(1)) if binary else c) for c in counts), F.lit(0))
    rows = messages.withColumn("score", score).filter(F.col("score") > 0)
    rows = rows.withColumns({"rank": -F.col("score").cast("double"), "snippet": snippet(F.col("content"), terms)})
    return rows if limit is None else rows.orderBy(*ordering(sort, now)).limit(limit)


def merge_hits(messages: DataFrame, nodes: DataFrame, payloads: DataFrame | None, *, sort: str, limit: int, now: float) -> DataFrame:
    """(kind, id, session_id, at, rank, directness) of message, summary and payload hits in one order.

    Payload hits come last; a summary's directness counts 0.8; in hybrid order a
    summary at least as direct as the best message precedes messages of its rank.
    """
    columns = ["kind", "id", "session_id", "at", "rank", "directness", "tier"]
    m = messages.select(F.lit("message").alias("kind"), F.col("store_id").alias("id"), "session_id", F.col("timestamp").alias("at"), "rank", "directness", F.lit(0).alias("tier"), "role")
    n = nodes.select(F.lit("summary").alias("kind"), F.col("node_id").alias("id"), "session_id", F.coalesce("latest_at", "created_at").alias("at"), "rank", (F.col("directness") * 0.8).alias("directness"), F.lit(0).alias("tier"), F.lit(None).cast("string").alias("role"))
    both = m.unionByName(n)
    if payloads is not None:
        both = both.unionByName(payloads.select(F.lit("payload").alias("kind"), F.col("store_id").alias("id"), "session_id", F.col("timestamp").alias("at"), F.lit(0.0).alias("rank"), F.lit(0.0).alias("directness"), F.lit(1).alias("tier"), F.lit(None).cast("string").alias("role")))
    best = m.agg(F.max("directness").alias("best"))
    ahead = F.when((F.col("kind") == "summary") & (F.col("directness") >= F.coalesce("best", F.lit(0.0))) & F.lit(sort_mode(sort) == "hybrid"), 0).otherwise(1)
    return both.crossJoin(F.broadcast(best)).orderBy("tier", ahead, *ordering(sort, now, at="at", id_col="id"), "kind").limit(limit).select(*columns)


def payload_search(payloads: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """Payloads that hold a literal in any case: its line, its place in bytes, and the text around it."""
    at = F.instr(F.lower("content"), term.lower())
    before = F.substring(F.col("content"), F.lit(1), at - 1)
    start = F.greatest(at - 120, F.lit(1))
    return payloads.withColumn("at", at).filter(F.col("at") > 0).select(
        "ref", "session_id", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), F.octet_length(before).alias("byte"), F.substring(F.col("content"), start, at + len(term) + 180 - start).alias("snippet"),
    ).orderBy("ref").limit(limit)


def exact_excerpt(text: Column, terms: list[str], size: int) -> Column:
    """`size` characters that begin a third of them ahead of the first place of any term."""
    places = F.filter(F.array(*(F.instr(F.lower(text), t.lower()) for t in terms)), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - size // 3, F.lit(1))
    return F.substring(text, start, F.lit(size))

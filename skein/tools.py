"""The engine's tools by name: arguments in, bounded JSON out. Plain facades over the operators; no data stays on the driver but what is returned."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.content import content_slice
from skein.operators import assertions as A
from skein.operators import compute, dag, diagnostics, evidence, grep, index, rollup, store
from skein.plans.query import EvidencePlan, clamp, parse_period, plan_evidence, sort_mode

#: Rows and characters that a tool returns at most.
ROWS, CHARS = 50, 64_000


@dataclass
class Engine:
    """The tables that the tools read; those left out are empty to them."""

    spark: SparkSession
    messages: DataFrame
    nodes: DataFrame
    vectors: DataFrame | None = None
    assertions: DataFrame | None = None
    relations: DataFrame | None = None
    payloads: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    now: float = field(default_factory=lambda: datetime.now(UTC).timestamp())

    def message_index(self) -> index.Index:
        return index.current(self.messages, "store_id", "content", "messages")

    def node_index(self) -> index.Index:
        return index.current(self.nodes.select("node_id", "summary"), "node_id", "summary", "nodes")


TOOLS: dict[str, tuple[Callable[[Engine, dict], dict], str]] = {}


def tool(description: str):
    def add(f: Callable[[Engine, dict], dict]) -> Callable[[Engine, dict], dict]:
        TOOLS[f.__name__] = (f, description)
        return f

    return add


def call(engine: Engine, name: str, arguments: dict | str | None = None) -> str:
    """Run a tool; what is wrong with the call comes back as JSON too."""
    if name not in TOOLS:
        return json.dumps({"error": "unknown_tool", "tools": sorted(TOOLS)})
    try:
        args = json.loads(arguments) if isinstance(arguments, str) else dict(arguments or {})
        if not isinstance(args, dict):
            raise ValueError("arguments are an object")
        return json.dumps(TOOLS[name][0](engine, args), ensure_ascii=False)
    except (ValueError, TypeError, KeyError) as e:
        return json.dumps({"error": "bad_arguments", "detail": str(e)})


def bounded(df: DataFrame, limit: int, chars: int = CHARS) -> tuple[list[dict], bool]:
    """The first rows of a result as long as they fit, and whether any were left out."""
    rows = [json.loads(x) for x in df.limit(limit + 1).toJSON().collect()]
    out, used = [], 0
    for row in rows[:limit]:
        used += len(json.dumps(row, ensure_ascii=False))
        if used > chars and out:
            break
        out.append(row)
    return out, len(out) < len(rows)


def _limit(args: dict, default: int = 20) -> int:
    return clamp(args.get("limit"), 1, ROWS, default)


@tool("search messages, summaries and payloads: query, mode (full_text, semantic, hybrid), sort, session_id, limit")
def search(engine: Engine, args: dict) -> dict:
    query = str(args["query"])
    hits = grep.grep(
        str(args.get("mode") or "full_text"), messages=engine.messages, nodes=engine.nodes, vectors=engine.vectors, message_index=engine.message_index(), node_index=engine.node_index(), query=query,
        embedding=engine.embed(query) if engine.embed else None, sort=sort_mode(args.get("sort")), limit=_limit(args), now=engine.now, session_id=args.get("session_id"),
    )
    rows, more = bounded(hits, _limit(args))
    return {"hits": rows, "truncated": more}


@tool("a page of a session in order: session_id, after, limit, max_tokens of each message")
def load_session(engine: Engine, args: dict) -> dict:
    page = store.session_page(engine.messages, str(args["session_id"]), after=int(args.get("after", -1)), limit=_limit(args))
    cut = content_slice(F.col("content"), clamp(args.get("max_tokens"), 1, 8000, 500))
    rows, more = bounded(page.select("store_id", "role", cut.alias("part"), "has_more").orderBy("store_id"), _limit(args))
    return {"messages": rows, "truncated": more or any(r.get("has_more") for r in rows), "next_after": rows[-1]["store_id"] if rows else None}


@tool("a summary node and its children: node_id")
def describe(engine: Engine, args: dict) -> dict:
    return json.loads(dag.describe(engine.nodes, int(args["node_id"])))


@tool("the sources of a summary node within a budget: node_id, max_tokens")
def expand(engine: Engine, args: dict) -> dict:
    rows, more = bounded(dag.expand(engine.nodes, engine.messages, int(args["node_id"]), clamp(args.get("max_tokens"), 1, 100_000, 4000)).orderBy("source_type", "place"), ROWS)
    return {"sources": rows, "truncated": more}


def expansion(engine: Engine, query: str, limit: int, max_tokens: int) -> DataFrame:
    """(kind, id, place, store_id, content) of what a query finds: messages found, and the messages right below the summaries found, best hits first, while they fit."""
    hits = grep.full_text(engine.messages, engine.nodes, engine.message_index(), engine.node_index(), query, sort="relevance", limit=limit, now=engine.now)
    hits = F.broadcast(hits.select("kind", "id", F.row_number().over(_by("rank", "kind", "id")).alias("place")))  # a top list
    own = dag.edges(engine.nodes).filter("child_type = 'messages'").join(hits.filter("kind = 'summary'"), F.col("parent") == F.col("id")).select("kind", "id", "place", F.col("child").alias("store_id"))
    wanted = hits.filter("kind = 'message'").select("kind", "id", "place", F.col("id").alias("store_id")).unionByName(own)
    first = wanted.groupBy("store_id").agg(F.min(F.struct("place", "kind", "id")).alias("h")).select("store_id", "h.place", "h.kind", "h.id")
    rows = engine.messages.select("store_id", "content", "token_estimate").join(first, "store_id")
    used = F.sum("token_estimate").over(_by("place", "store_id"))  # over the few messages of a top list
    return rows.withColumn("used", used).filter(F.col("used") <= max_tokens).select("kind", "id", "place", "store_id", "content").orderBy("place", "store_id")


def _by(*columns: str):
    from pyspark.sql.window import Window

    return Window.orderBy(*columns)


@tool("search and expand what is found into one context: query, limit, max_tokens")
def expand_query(engine: Engine, args: dict) -> dict:
    rows, more = bounded(expansion(engine, str(args["query"]), _limit(args, 8), clamp(args.get("max_tokens"), 1, 100_000, 4000)), ROWS)
    return {"blocks": rows, "truncated": more}


@tool("summaries of a recent period: period (today, yesterday, 7d, week, month, date:..., last 3h), limit")
def recent(engine: Engine, args: dict) -> dict:
    p = parse_period(str(args.get("period") or "today"), datetime.fromtimestamp(engine.now, UTC))
    rows, more = bounded(rollup.recent(engine.nodes, p.start.timestamp(), p.end.timestamp(), _limit(args)).select("node_id", "session_id", "depth", "summary", "start_at", "end_at"), _limit(args))
    return {"period": {"start": p.start.isoformat(), "end": p.end.isoformat()}, "summaries": rows, "truncated": more}


@tool("assertions and their state: subject, predicate, as_of, limit")
def query_state(engine: Engine, args: dict) -> dict:
    if engine.assertions is None:
        return {"assertions": [], "truncated": False}
    rows = A.as_of(engine.assertions, float(args["as_of"])) if args.get("as_of") is not None else engine.assertions
    for key in ("subject", "predicate"):
        rows = rows.filter(F.col(f"{key}_key") == args[key]) if args.get(key) else rows
    out, more = bounded(A.state(rows, engine.relations).orderBy(F.desc("observed_at"), "assertion_id"), _limit(args))
    return {"assertions": out, "truncated": more}


OPERANDS = "store_id long, span_start int, span_end int, quote string, value string, unit string, key string, role string, day string"


@tool("compute over cited evidence or refuse: question, operands [{store_id, span_start, span_end, quote, value, unit, key, role, day}]")
def compute_answer(engine: Engine, args: dict) -> dict:
    plan = plan_evidence(str(args["question"]))
    names = [x.split()[0] for x in OPERANDS.split(", ")]
    given = [tuple((str(o[n]) if o.get(n) is not None and n not in ("store_id", "span_start", "span_end") else o.get(n)) for n in names) for o in args.get("operands") or []]
    if plan.refused or not given or len(given) > ROWS:
        return {"operation": plan.operation, "result": None, "refused": plan.refused or ("no_operands" if not given else "too_many_operands")}
    rows = compute.ground(engine.spark.createDataFrame(given, OPERANDS), engine.messages)
    problems = [json.loads(x) for x in rows.filter("problem is not null").select("store_id", "problem").orderBy("store_id", "problem").toJSON().collect()]
    if problems:
        return {"operation": plan.operation, "result": None, "refused": "operands_not_grounded", "problems": problems}
    return executed(rows, plan)


def executed(rows: DataFrame, plan: EvidencePlan) -> dict:
    """An operation over grounded operands, at most ROWS of them."""
    rows = rows.withColumns({"one": F.lit(1), "number": F.col("value").try_cast("double"), "ref": F.concat_ws(":", "store_id", "span_start", "span_end"), "date": F.col("day").try_cast("date")})
    if plan.operation == "count_distinct":
        out = compute.count_distinct(rows, ["one"])
    elif plan.operation == "sum":
        out = compute.sum_units(rows, ["one"], plan.unit, value="number")
    elif plan.operation == "difference":
        out = compute.difference(rows, ["one"], value="number")
    elif plan.operation == "date_interval":
        ends = rows.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("date").alias("n"))
        out = ends.select(F.when(F.col("n") == 2, compute.date_interval(F.col("a"), F.col("b"), plan.unit if plan.unit in ("day", "week", "month") else "day")).alias("result"), F.when(F.col("n") != 2, "two_dates_needed").alias("refused"))
    else:  # order, latest_fact, date_filter: the operands in time
        placed = compute.order_events(rows, ["one"], "date", "ref").select("place", "key", F.col("date").cast("string").alias("date"))
        found, _ = bounded(placed, ROWS)
        found = found if plan.operation == "order" else found[-1:]
        return {"operation": plan.operation, "result": found or None, "refused": None if found else "no_dates"}
    row = out.select("result", "refused").first()
    return {"operation": plan.operation, "unit": plan.unit, "result": row.result if row else None, "refused": row.refused if row else "no_operands"}


@tool("resolve references to exact quotes: candidates [{store_id, span_start, span_end, quote}], limit")
def evidence_pack(engine: Engine, args: dict) -> dict:
    given = [(0, i, int(c["store_id"]), int(c["span_start"]), int(c["span_end"]), c.get("quote")) for i, c in enumerate(args.get("candidates") or [])][:ROWS]
    if not given:
        return {"items": [], "rejected": []}
    rows = evidence.pack(engine.spark.createDataFrame(given, "question int, place int, store_id long, span_start int, span_end int, quote string"), engine.messages, "question", "place").drop("question").orderBy("place")
    found = [json.loads(x) for x in rows.toJSON().collect()]  # ROWS at most
    return {"items": [r for r in found if "problem" not in r], "rejected": [r for r in found if "problem" in r]}


def counters(messages: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of what a store holds."""
    m = messages.agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("session_id").alias("sessions"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("message_tokens"), F.max("store_id").alias("max_store_id"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("max_depth"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("node_tokens"), F.coalesce(F.sum("source_token_count"), F.lit(0)).alias("source_tokens"))
    return m.crossJoin(n).withColumn("compression", F.round(F.col("source_tokens") / F.greatest("node_tokens", F.lit(1)), 6))  # one row each


@tool("counters of the store")
def status(engine: Engine, args: dict) -> dict:
    return json.loads(counters(engine.messages, engine.nodes).toJSON().first())


@tool("integrity checks of the store")
def doctor(engine: Engine, args: dict) -> dict:
    return {"checks": [json.loads(x) for x in diagnostics.doctor(engine.messages, engine.nodes).orderBy("check").toJSON().collect()]}


def reference_inventory(messages: DataFrame, payloads: DataFrame) -> DataFrame:
    """(session_id, n_refs, n_missing, chars) of the payloads that messages refer to, metadata only."""
    from skein.functions.text import refs

    used = messages.select("session_id", F.explode(refs(F.col("content"))).alias("ref")).distinct()
    have = payloads.groupBy("ref").agg(F.max(F.length("content")).cast("long").alias("chars"))
    return used.join(have, "ref", "left").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("chars").isNull()).alias("n_missing"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


@tool("what payloads messages refer to, by session: session_id, limit")
def inspect(engine: Engine, args: dict) -> dict:
    if engine.payloads is None:
        return {"sessions": [], "truncated": False}
    m = engine.messages.filter(F.col("session_id") == args["session_id"]) if args.get("session_id") else engine.messages
    rows, more = bounded(reference_inventory(m, engine.payloads).orderBy("session_id"), _limit(args))
    return {"sessions": rows, "truncated": more}

"""Folds over ordered rows that no window expresses: chunks of texts, compaction segments, tails, packing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TARGET, LEAST, MESSAGE_CAP, ERRORS = 600, 40, 32_000, 3
CHUNKS = "store_id long, chunk_index int, char_start int, char_end int, text string, token_estimate int"
_error = re.compile(r"(?im)^.*\b(error|exception|traceback|fatal|failed)\b.*$")
_end = re.compile(r"[.!?]+(?=\s|$)\s*|\n+")


def estimate(text: str) -> int:
    if not text:
        return 0
    share = sum(ord(c) > 127 for c in text) / len(text) if not text.isascii() else 0
    return int(len(text) / (1.5 if share >= 0.5 else 2.5 if share >= 0.2 else 4)) + 1


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans that tile a text, cut behind sentence ends and line feeds."""
    cuts = [0, *(m.end() for m in _end.finditer(text))]
    cuts += [len(text)] if cuts[-1] < len(text) else []
    return list(zip(cuts, cuts[1:], strict=False))


def window_spans(text: str, target: int = TARGET) -> list[tuple[int, int]]:
    """Runs of whole sentences of about `target` tokens, each beginning with the last sentence of the one before."""
    if estimate(text) <= target:
        return [(0, len(text))] if text else []
    spans, out, i = sentence_spans(text), [], 0
    costs = [estimate(text[a:b]) for a, b in spans]
    while True:
        j, used = i + 1, costs[i]
        while j < len(spans) and used + costs[j] <= target:
            used, j = used + costs[j], j + 1
        out.append((spans[i][0], spans[j - 1][1]))
        if j == len(spans):
            return out
        i = j - 1 if j - i > 1 else j


def message_chunks(role: str | None, text: str | None, policy: str = "conversational") -> list[tuple[int, int, int]]:
    """(index, start, end) of a message's chunks: users' and assistants' of 40 tokens and more; `heads` adds the head and error parts of tool results; `full` takes all, giants by head and errors."""
    role, text = (role or "").strip().lower(), text or ""
    if not text.strip():
        return []
    tokens, speaks = estimate(text), role in ("user", "assistant")
    if speaks and policy in ("conversational", "heads") and tokens < LEAST:
        return []
    windows = window_spans(text)
    if (policy == "heads" and role == "tool") or (policy == "full" and tokens > MESSAGE_CAP):
        errors = [i for i, (a, b) in enumerate(windows) if i and _error.search(text[a:b])][:ERRORS]
        return [(i, *windows[i]) for i in [0, *errors]]
    if policy == "full" or speaks:
        return [(i, a, b) for i, (a, b) in enumerate(windows)]
    return []


def chunk(messages: DataFrame, policy: str = "conversational") -> DataFrame:
    """Chunks of all messages, in Arrow batches and without a shuffle; offsets count code points."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, i, a, b, t[a:b], estimate(t[a:b])) for s, r, t in zip(f["store_id"], f["role"], f["content"], strict=True) for i, a, b in message_chunks(r, t, policy)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNKS.split(", ")])

    return messages.select("store_id", "role", "content").mapInPandas(run, CHUNKS)


def pending_chunks(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    return chunks.join(embedded.select("store_id", "chunk_index").distinct(), ["store_id", "chunk_index"], "left_anti")


def fold_segments(rows: DataFrame, group: str, order: str, cost: str, budget: int, out: str = "segment") -> DataFrame:
    """Number greedy runs of each group: a run takes rows in order while they fit the budget, and one row at least.

    Only (group, order, cost) goes through the fold; the numbers are joined back.
    A task folds its sorted rows as they stream by, whatever groups they are of.
    """
    thin = rows.select(group, order, F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("_cost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, used = object(), 0, 0
        for b in batches:
            numbers = []
            for g, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if g != last:
                    last, n, used = g, 0, c
                elif used + c > budget:
                    n, used = n + 1, c
                else:
                    used += c
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(numbers, pa.int32())], names=[group, order, out])

    kinds = {f.name: f.dataType.simpleString() for f in thin.schema.fields}
    ordered = thin.repartition(group).sortWithinPartitions(group, F.col(order).asc_nulls_last())
    numbered = ordered.mapInArrow(run, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, `{out}` int")
    return rows.join(numbered, [group, order])


def oldest_chunk(rows: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """The first greedy run of each group: a running sum."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumns({"_used": F.sum(cost).over(w), "_n": F.row_number().over(w)}).filter((F.col("_used") <= budget) | (F.col("_n") == 1)).drop("_used", "_n")


def fresh_tail(messages: DataFrame, count: int = 32, max_tokens: int = 0) -> DataFrame:
    """Each session's last `count` messages (if `max_tokens`: as many as fit, the newest in any case), from the opening assistant on if the first is its tool's result."""
    w = Window.partitionBy("session_id").orderBy(F.desc("store_id"))
    rows = messages.withColumns({"_n": F.row_number().over(w), "_t": F.sum("token_estimate").over(w)})
    kept = F.col("_n") <= max(count, 1 if max_tokens else 0)
    kept = kept & ((F.col("_t") <= max_tokens) | (F.col("_n") == 1)) if max_tokens else kept
    last_speaker = F.max(F.when(F.col("role") != "tool", F.col("store_id"))).over(Window.partitionBy("session_id").orderBy("store_id"))
    rows = rows.withColumns({"_kept": kept, "_opens": F.coalesce(last_speaker, "store_id")})
    rows = rows.withColumn("_start", F.min(F.when(F.col("_kept"), F.col("_opens"))).over(Window.partitionBy("session_id")))
    return rows.filter(F.col("store_id") >= F.col("_start")).drop("_n", "_t", "_kept", "_opens", "_start")


def diverse(rows: DataFrame, group: str, order: str, session: str, day: str, per_session: int, per_day: int) -> DataFrame:
    """Rows of each group taken in order while neither their session nor their day is full; rows without one count for none."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f, sessions, days, keep = f.sort_values(order, kind="stable"), {}, {}, []
        for i, (s, d) in enumerate(zip(f[session], f[day], strict=True)):
            s, d = s if pd.notna(s) else f"missing:{i}", d if pd.notna(d) else f"unknown:{i}"
            fits = sessions.get(s, 0) < per_session and days.get(d, 0) < per_day
            keep.append(fits)
            if fits:
                sessions[s], days[d] = sessions.get(s, 0) + 1, days.get(d, 0) + 1
        return f[keep]

    return rows.groupBy(group).applyInPandas(run, rows.schema)


def pack(rows: DataFrame, group: str, order: str, cost: str, items: int, tokens: int) -> DataFrame:
    """Number the requests that rows of a group go into, in order, under a budget of items and one of tokens."""
    fields = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, request int"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f, n, have, used, out = f.sort_values(order, kind="stable"), 0, 0, 0, []
        for c in f[cost]:
            if have and (have >= items or used + c > tokens):
                n, have, used = n + 1, 0, 0
            have, used = have + 1, used + c
            out.append(n)
        return f.assign(request=out)

    return rows.groupBy(group).applyInPandas(run, fields)


def assemble(tail: DataFrame, summaries: DataFrame, cap: int) -> DataFrame:
    """What goes into a session's context: the newest messages while they fit, then summaries from the deepest on, each if it still fits."""
    parts = tail.select("session_id", F.lit(0).alias("tier"), F.lit(0).alias("depth"), F.col("store_id").alias("id"), F.col("token_estimate").cast("long").alias("tokens")).unionByName(
        summaries.select("session_id", F.lit(1).alias("tier"), "depth", F.col("node_id").alias("id"), F.col("token_count").alias("tokens"))
    )

    def run(f: pd.DataFrame) -> pd.DataFrame:
        left, keep, closed = cap, [], False
        f = f.sort_values(["tier", "depth", "id"], ascending=[True, False, False], kind="stable")
        for tier, tokens in zip(f["tier"], f["tokens"], strict=True):
            fits = tokens <= left and not (closed and tier == 0)
            closed = closed or (tier == 0 and not fits)
            left -= tokens if fits else 0
            keep.append(fits)
        return f[keep]

    return parts.groupBy("session_id").applyInPandas(run, parts.schema)


def matched_calls(messages: DataFrame) -> DataFrame:
    """(session_id, call_id) that both an assistant's calls and a tool's result have."""
    asked = messages.filter("role = 'assistant'").select("session_id", F.explode(F.transform("tool_calls", lambda c: c["id"])).alias("call_id"))
    got = messages.filter("role = 'tool'").select("session_id", F.col("tool_call_id").alias("call_id"))
    return asked.filter(F.btrim("call_id") != "").join(got, ["session_id", "call_id"], "left_semi").distinct()

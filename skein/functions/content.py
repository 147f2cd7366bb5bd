"""Structured content, slices, embedded payloads, and what a quote says of a value or a day; all in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import BASE64_RUN, DATA_URI, is_base64, let, mark, redact, token_estimate

# Results depend on these words and forms as they stand.
TEXT_PARTS = ("text", "input_text", "output_text")
UNIT_FORMS = {"page": "pages?", "hour": "(?:hours?|hrs?)", "minute": "(?:minutes?|mins?)", "day": "days?", "week": "weeks?", "month": "months?", "point": "points?", "item": "items?", "event": "events?"}
NUMBER_WORDS = "one two three four five six seven eight nine ten".split()
MONTHS = "january february march april may june july august september october november december".split()
#: Keys whose string value is a secret whatever it looks like.
SECRET_KEYS = {
    "api_key": r"[^\"\\]*(?:api[^\"\\]*key|access[^\"\\]*token|secret[^\"\\]*key)[^\"\\]*|api[_-]?token|client[_-]?secret",
    "bearer_token": r"authorization|auth[_-]?token|bearer[_-]?token|token",
    "password_assignment": r"password|passwd|pwd|passphrase",
}


def content_slice(text: Column, max_tokens: int, offset: Column | int = 0) -> Column:
    """(content, content_offset, next_offset, has_more): the longest prefix from an offset on, by halving, that fits the tokens; one character in any case, so that a reader gets on."""
    most = max(4 * max_tokens, 1)  # characters: as many are a token more, however they count

    def of(text: Column) -> Column:
        start = F.least(F.greatest(F.lit(offset) if isinstance(offset, int) else offset, F.lit(0)), F.length(text)).cast("int")
        return let(F.struct(text.alias("text"), start.alias("start"), (F.length(text) - start).alias("left"), F.substring(text, start + 1, F.lit(most)).alias("head")), cut)

    def cut(x: Column) -> Column:
        fits = lambda n: (n < most) & (token_estimate(F.substring(x["head"], F.lit(1), n)) <= max_tokens)

        def halve(a: Column, _: Column) -> Column:
            middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
            longer = F.struct((middle + 1).alias("low"), a["high"].alias("high"), middle.alias("best"))
            shorter = F.struct(a["low"].alias("low"), (middle - 1).alias("high"), a["best"].alias("best"))
            return F.when(a["low"] > a["high"], a).when(fits(middle), longer).otherwise(shorter)

        halved = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.struct(F.lit(0).alias("low"), x["left"].alias("high"), F.lit(0).alias("best")), halve, lambda a: a["best"])
        size = F.when(fits(x["left"]), x["left"]).when(F.lit(max_tokens <= 0), 0).otherwise(halved)
        return let(F.least(F.greatest(size, F.lit(1)), x["left"]).cast("int"), lambda n: sliced(x, n))

    def sliced(x: Column, n: Column) -> Column:
        more = n < x["left"]
        return F.struct(F.substring(x["head"], F.lit(1), n).alias("content"), x["start"].alias("content_offset"), F.when(more, x["start"] + n).otherwise(0).cast("int").alias("next_offset"), more.alias("has_more"))

    return let(F.coalesce(text, F.lit("")), of)


def canonical(text: Column) -> Column:
    """JSON with its keys in order and no white space between; text that is no JSON object or list stays as it is."""
    parsed = F.try_parse_json(text)
    return F.when(F.ltrim(text).rlike(r"^[\[{]") & parsed.isNotNull(), F.to_json(parsed)).otherwise(text)


def pattern_text(content: Column) -> Column:
    """What patterns of messages are matched with: the text parts of structured content by lines, else the content in canonical form."""
    parts = F.from_json(content, "array<struct<type:string,text:string,content:string>>")
    said = F.transform(F.filter(parts, lambda p: p["type"].isin(*TEXT_PARTS)), lambda p: F.coalesce(p["text"], p["content"]))
    said = F.filter(said, lambda t: t != "")
    strings = F.filter(F.from_json(content, "array<string>"), lambda t: ~t.rlike(r"^\s*[\[{]"))
    both = F.when(F.size(said) > 0, said).otherwise(strings)
    structured = F.ltrim(content).startswith("[") & F.try_parse_json(content).isNotNull()
    return F.when(structured & (F.size(both) > 0), F.array_join(both, "\n")).otherwise(canonical(content))


def redact_structured(text: Column) -> Column:
    """JSON text with secrets marked, both what looks like one and the whole string under a key that names one; other text as by `redact`."""
    out = redact(text)
    for name, keys in SECRET_KEYS.items():
        pattern = rf'(?i)("(?:{keys})"\s*:\s*")(?![^"]*\[redacted: )((?:[^"\\]|\\.)+)'
        out = replaced(out, pattern, 2, _whole(name))
    return F.when(F.ltrim(text).rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull(), out).otherwise(redact(text))


def _whole(name: str) -> Callable[[Column, Column], Column]:
    return lambda before, secret: F.concat(before, mark(secret, name))


def replaced(text: Column, pattern: str, group: int, by: Callable[[Column, Column], Column]) -> Column:
    """Every match of a pattern as `by` says, given what stands before the group within the match (group 1, or nothing) and the group."""

    def f(x: Column) -> Column:
        held = F.regexp_extract_all(x, F.lit(pattern), group)
        before = F.regexp_extract_all(x, F.lit(pattern), 1) if group > 1 else F.transform(held, lambda y: F.lit(""))
        parts = F.zip_with(F.split(x, pattern, -1), F.zip_with(before, held, by), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(x.rlike(pattern), F.array_join(parts, "")).otherwise(x)

    return let(text, f)


def payload_mark(payload: Column, kind: str = "embedded") -> Column:
    return F.concat(F.lit(f"[Externalized payload: kind={kind}; chars="), F.length(payload).cast("string"), F.lit("; ref="), F.sha2(payload, 256), F.lit("]"))


_URI = rf"({DATA_URI.replace('(?i)', '(?i:', 1)}))"


def _woven(parts: Column, between: Column) -> Column:
    return F.array_join(F.zip_with(parts, between, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def payloads_apart(text: Column) -> Column:
    """(content, payloads): a text with each data URI and long base64 run replaced by its placeholder, whose ref is its SHA-256, and these, URIs first.

    Each pattern goes over the text once, and only over texts that can hold a match.
    """
    none = F.array().cast("array<string>")

    def uris(x: Column) -> Column:
        found = F.when(F.contains(F.lower(x), F.lit(";base64,")), F.regexp_extract_all(x, F.lit(_URI), 1)).otherwise(none)
        return let(found, lambda u: let(F.when(F.size(u) > 0, _woven(F.split(x, _URI, -1), F.transform(u, lambda p: payload_mark(p)))).otherwise(x), lambda y: runs(y, u)))

    def runs(y: Column, u: Column) -> Column:
        found = F.when(F.length(y) >= 4096, F.regexp_extract_all(y, F.lit(BASE64_RUN), 1)).otherwise(none)
        marked = lambda r: F.transform(r, lambda x: F.when(is_base64(x), payload_mark(x)).otherwise(x))
        return let(found, lambda r: F.struct(F.when(F.size(r) > 0, _woven(F.split(y, BASE64_RUN, -1), marked(r))).otherwise(y).alias("content"), F.concat(u, F.filter(r, is_base64)).alias("payloads")))

    return let(text, lambda x: F.when(x.isNotNull(), uris(x)))


def payloads_in(text: Column) -> Column:
    """The data URIs and long base64 runs of a text."""
    return payloads_apart(text)["payloads"]


def without_payloads(text: Column) -> Column:
    """A text with each of `payloads_in` replaced by its placeholder, whose ref is its SHA-256."""
    return payloads_apart(text)["content"]


def _number(x: Column) -> Column:
    words = F.create_map(*(F.lit(v) for i, w in enumerate(NUMBER_WORDS, 1) for v in (w, float(i))))
    return F.coalesce(F.replace(x, F.lit(","), F.lit("")).try_cast("double"), F.try_element_at(words, F.lower(x)))


def value_has_unit(quote: Column, value: Column, unit: str) -> Column:
    """Whether a quote names a value with its unit right behind it or before it."""
    number = rf"(-?(?<![\w.])\d[\d,]*(?:\.\d+)?|\b(?:{'|'.join(NUMBER_WORDS)})\b)"
    form = UNIT_FORMS.get(unit, f"{unit.replace('_', '[ _]')}s?")
    patterns = [rf"(?i){number}(?=\s{{0,20}}{form}\b)", rf"(?i)\b{form}\s{{0,20}}[:=~-]?\s{{0,20}}{number}"]
    patterns += [rf"(?i){number}(?=\s{{0,20}}(?:usd\b|dollars?\b))", rf"(?i)(?:\$|\busd)\s{{0,20}}{number}"] if unit == "usd" else []
    found = F.concat(*(F.regexp_extract_all(quote, F.lit(p), 1) for p in patterns))
    return F.coalesce(F.exists(found, lambda x: F.abs(_number(x) - value) <= 1e-9), F.lit(False))


def quote_supports_day(quote: Column, day: Column) -> Column:
    """Whether a quote names a day as YYYY-MM-DD, with slashes, or as a month's name, the day and the year."""
    numbers = [F.regexp_extract_all(quote, F.lit(r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"), g) for g in (1, 2, 3)]
    named = [F.regexp_extract_all(quote, F.lit(r"(?i)\b([a-z]{3,9})\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"), g) for g in (3, 1, 2)]
    month = F.create_map(*(F.lit(v) for i, m in enumerate(MONTHS, 1) for k in dict.fromkeys((m, m[:3])) for v in (k, str(i))), F.lit("sept"), F.lit("9"))
    text = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    days = F.concat(
        F.transform(F.arrays_zip(*(x.alias(n) for x, n in zip(numbers, "ymd", strict=True))), lambda p: text(p["y"], p["m"], p["d"])),
        F.transform(F.arrays_zip(*(x.alias(n) for x, n in zip(named, "ymd", strict=True))), lambda p: text(p["y"], F.try_element_at(month, F.lower(p["m"])), p["d"])),
    )
    return F.coalesce(F.array_contains(days, F.date_format(day, "yyyy-MM-dd")), F.lit(False))


def stable_id(value: Column) -> Column:
    """A positive 64-bit number of a text: the head of its SHA-256."""
    digest = F.sha2(value, 256)
    first = F.conv((F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") % 8).cast("string"), 10, 16)
    return F.conv(F.concat(first, F.substring(digest, 2, 15)), 16, 10).cast("long")

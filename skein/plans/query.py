"""What is settled before a plan exists: query text, periods, dates, patterns, limits. Plain Python, no data."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta
from itertools import zip_longest

# Results depend on these words and signs as they stand.
BOOLEAN = {"and", "or", "not", "near"}
STOP = set(
    "a an and are as at be before did do does for from happen happened how i in is it of on or should the then to was were what when where which who why with would".split()
)
EDGES = "\"'()[]{}.,;"
NUMBERS = "one two three four five six seven eight nine ten".split()
WIDE = ((0x2600, 0x27BF), (0x3000, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xFF00, 0xFFEF), (0x1F300, 0x1FAFF))
SORTS = ("recency", "relevance", "hybrid")
DECAY_PER_HOUR = 0.001


def sort_mode(value: object) -> str:
    """A known sort mode; anything else is recency."""
    text = str(value or "").strip().lower()
    return text if text in SORTS else "recency"


def sanitize(query: str) -> str:
    """Without the signs that full-text syntax would read; phrases in a pair of quotes stay as they are, a quote without its pair goes."""
    parts = re.split(r'("[^"]*")', query)  # phrases stand at the odd places
    plain = (re.sub(r"\s+", " ", re.sub(r'["()*^:{}.-]', " ", x)).strip() for x in parts[::2])
    return " ".join(x for pair in zip_longest(plain, parts[1::2], fillvalue="") for x in pair if x)


def needs_substring(query: str) -> bool:
    """Whether words as indexed can't answer a query: scripts without spaces, pictographs, joined words outside of phrases, an odd quote."""
    wide = any(a <= ord(c) <= b for c in query for a, b in WIDE)
    return wide or query.count('"') % 2 == 1 or bool(re.search(r"[A-Za-z0-9][-:/][A-Za-z0-9]", re.sub(r'"[^"]+"', " ", query)))


def phrases_of(query: str) -> list[str]:
    return [p.strip() for p in re.findall(r'"([^"]+)"', query) if p.strip()]


def terms_of(query: str) -> list[str]:
    """Quoted phrases, then words and the parts of joined words, without boolean words, each once; if that leaves none, the query itself."""
    found = phrases_of(query)
    for token in re.sub(r'"[^"]+"', " ", query).split():
        word = token.strip(EDGES)
        if word and word.lower() not in BOOLEAN:
            parts = [x for x in re.split(r"[-:/]+", word) if x]
            found += [word, *(parts if len(parts) > 1 else [])]
    return list(dict.fromkeys(found or [x for x in [query.strip().strip(EDGES)] if x]))


def is_precise(terms: list[str], phrases: list[str]) -> bool:
    """One term, or one phrase and two terms at most: queries whose directness may tip a tie."""
    return len(terms) == 1 or (len(phrases) == 1 and len(terms) <= 2)


def any_terms(query: str, most: int = 16) -> list[str]:
    """Folded phrases and words of two signs and more, with a letter or digit, that are no stop words, each once; to be joined by OR."""
    terms = (t.casefold().strip() for t in terms_of(query))
    return list(dict.fromkeys(t for t in terms if len(t) > 1 and t not in STOP and any(c.isalnum() for c in t)))[:most]


@dataclass(frozen=True)
class Boolean:
    """A query as groups of words: all of `required` (each a list of alternatives), none of `excluded`."""

    required: list[list[str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)


def parse_boolean(query: str) -> Boolean:
    """`a b` and `a AND b` ask for both, `a OR b` for one, `a NOT b` for the absence of b; NEAR is AND."""
    required: list[list[str]] = []
    excluded: list[str] = []
    joined = negative = False
    for token in sanitize(query.replace('"', " ")).split():
        word = token.upper()
        if word == "OR":
            joined = bool(required)
        elif word == "NOT":
            negative = True
        elif word in ("AND", "NEAR"):
            joined = negative = False
        else:
            low = token.lower()
            if negative:
                excluded.append(low)
            elif joined:
                required[-1].append(low)
            else:
                required.append([low])
            joined = negative = False
    return Boolean(required, excluded)


def fetch_limit(limit: int, terms: list[str], phrases: list[str]) -> int:
    """Rows to look at before ranking, where an exact top-k isn't wanted."""
    return max(10 * limit, 50) if is_precise(terms, phrases) else max(5 * limit, 20)


def session_pattern(pattern: str) -> str:
    """A session glob as a Java expression: `*` stops at colons, `**` doesn't."""
    out = []
    for part in re.split(r"(\*\*|\*)", pattern):
        out.append({"**": ".*", "*": "[^:]*"}.get(part, re.escape(part) if part else ""))
    return "^" + "".join(out) + "$"


@dataclass(frozen=True)
class Period:
    start: datetime
    end: datetime
    kind: str
    within_day: bool = False


def parse_period(text: str, now: datetime) -> Period:
    """today, yesterday, Nd, week, month, date:YYYY-MM-DD or last Nh as [start, end) in UTC; else ValueError."""
    value, now = (text or "").strip().lower(), now.astimezone(UTC)
    day = datetime(now.year, now.month, now.day, tzinfo=UTC)
    after = day + timedelta(days=1)
    if value == "today":
        return Period(day, after, "day")
    if value == "yesterday":
        return Period(day - timedelta(days=1), day, "day")
    if value == "week":
        start = day - timedelta(days=day.weekday())
        return Period(start, start + timedelta(days=7), "week")
    if value == "month":
        start = day.replace(day=1)
        return Period(start, (start + timedelta(days=32)).replace(day=1), "month")
    if m := re.fullmatch(r"(\d+)d", value):
        if int(m[1]) > 0:
            return Period(after - timedelta(days=int(m[1])), after, "day")
    elif m := re.fullmatch(r"last (\d+)h", value):
        if int(m[1]) > 0:
            return Period(now - timedelta(hours=int(m[1])), now, "hour", True)
    elif m := re.fullmatch(r"date:(\d{4}-\d{2}-\d{2})", value):
        start = datetime.combine(date.fromisoformat(m[1]), datetime.min.time(), UTC)
        return Period(start, start + timedelta(days=1), "day")
    raise ValueError(f"no period: {text!r}")


def months_before(day: date, n: int) -> date:
    """The same day n months earlier, or that month's last."""
    index = day.year * 12 + day.month - 1 - n
    year, month = divmod(index, 12)
    last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(year, month + 1, min(day.day, last))


def whole_months(a: date, b: date) -> int:
    a, b = min(a, b), max(a, b)
    return 12 * (b.year - a.year) + b.month - a.month - (b.day < a.day)


def relative_window(question: str, today: date) -> tuple[date, date] | None:
    """[start, end) of `N days/weeks/months ago` (N in digits or up to ten in words), yesterday, last weekday, last week or last month; null without one of them."""
    q = question.casefold()
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    if m := re.search(rf"\b(\d+|{'|'.join(NUMBERS)})\s+(day|week|month)s?\s+ago\b", q):
        n = NUMBERS.index(m[1]) + 1 if m[1] in NUMBERS else int(m[1])
        try:
            day = months_before(today, n) if m[2] == "month" else today - timedelta(days=n * (7 if m[2] == "week" else 1))
            return day, day + timedelta(days=1)
        except (OverflowError, ValueError):
            return None
    if re.search(r"\byesterday\b", q):
        return today - timedelta(days=1), today
    if m := re.search(rf"\blast\s+({'|'.join(days)})\b", q):
        day = today - timedelta(days=(today.weekday() - days.index(m[1])) % 7 or 7)
        return day, day + timedelta(days=1)
    if re.search(r"\blast\s+week\b", q):
        return today - timedelta(days=7), today
    if re.search(r"\blast\s+month\b", q):
        first = today.replace(day=1)
        return months_before(first, 1), first
    return None


def question_day(value: str) -> date | None:
    """The day of `2024-03-05`, `2024/03/05 (Tue) 10:00` and the like; null if the weekday named is another."""
    m = re.match(r"\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:\s*\((\w{3})\w*\))?", value or "")
    if not m:
        return None
    try:
        day = date(int(m[1]), int(m[2]), int(m[3]))
    except ValueError:
        return None
    return None if m[4] and day.strftime("%a").lower() != m[4].lower() else day


def as_of_epoch(day: date) -> float:
    """The last microsecond of a UTC day."""
    return datetime.combine(day + timedelta(days=1), datetime.min.time(), UTC).timestamp() - 1e-6


@dataclass(frozen=True)
class EvidencePlan:
    """What a question asks to be computed; `refused` says why nothing is."""

    operation: str | None
    unit: str | None = None
    refused: str | None = None


def plan_evidence(question: str) -> EvidencePlan:
    """One of seven operations from the question's words; averages, medians, shares, rates and products are refused."""
    q = question.lower()
    if re.search(r"\b(average|mean|median|percent(age)?|ratio|rate|product)\b|%", q):
        return EvidencePlan(None, refused="unsupported_aggregate")
    unit = next((u for u in ("minute", "hour", "day", "week", "month") if re.search(rf"\b{u}s?\b", q)), None)
    rules = (
        ("date_interval", r"\bhow (many|much) (days|weeks|months)\b.*\b(between|from|passed|since|after|before)\b"), ("difference", r"\b(difference|how much (more|less|longer|older|younger)|how many (more|fewer))\b"),
        ("order", r"\b(order|first|earliest to|chronolog|sequence)\b"), ("sum", r"\b(total|sum|altogether|in all|combined)\b"), ("count_distinct", r"\bhow many (different|distinct|unique)?\b"),
        ("latest_fact", r"\b(latest|current(ly)?|most recent|now)\b"), ("date_filter", r"\b(when|on what (day|date)|which date)\b"),
    )
    for operation, pattern in rules:
        if re.search(pattern, q):
            return EvidencePlan(operation, unit)
    return EvidencePlan(None, refused="no_operation")


def exact_ref(text: str) -> tuple[int, int, int] | None:
    """(id, start, end) of `msg:id:start-end`."""
    m = re.fullmatch(r"msg:(\d+):(\d+)-(\d+)", (text or "").strip())
    return (int(m[1]), int(m[2]), int(m[3])) if m and int(m[2]) < int(m[3]) else None


def clamp(value: object, least: int, most: int, default: int) -> int:
    """An integer argument within bounds; what is no number is the default."""
    try:
        return max(least, min(most, int(value)))
    except (TypeError, ValueError, OverflowError):
        return default


def parse_time(value: object) -> float | None:
    """Epoch seconds of a number or an ISO time with a zone; ValueError for anything else that isn't empty."""
    if value is None or value == "":
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value):
        return float(value)
    moment = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    if moment.tzinfo is None:
        raise ValueError("a time needs a zone")
    return moment.timestamp()

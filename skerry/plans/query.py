"""Query compilation: mode dispatch, metadata filters, globs and phrase segments. Runs on the driver, on one query."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER = re.compile(r"""(\w+):(>=|<=|>|<|~|-)?("[^"]+"|'[^']+'|\S+)""")
OPERATORS = {None: "eq", "": "eq", ">": "gt", "<": "lt", ">=": "gte", "<=": "lte", "~": "contains", "-": "neq"}
LEADING_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
ISO_DATE = re.compile(r"\d{4}-\d{2}(-\d{2})?$")
PREFIXES = (("?", "hybrid"), ("/", "files"), ("#", "tags"))


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: str | float
    raw: str


@dataclass(frozen=True)
class ParsedQuery:
    text: str
    filters: tuple[Filter, ...]


def leading_number(text: str) -> float | None:
    m = LEADING_NUMBER.match(text)
    return float(m[1]) if m else None


def parse(query: str, legacy_numeric: bool = False) -> ParsedQuery:
    """Filters anywhere in the query, and the text that is left. A value that starts with // is no filter."""
    filters, rest, at = [], [], 0
    for m in FILTER.finditer(query):
        if m[3].startswith("//") and not legacy_numeric:
            continue
        rest.append(query[at : m.start()])
        at = m.end()
        value = m[3][1:-1] if len(m[3]) > 1 and m[3][0] == m[3][-1] and m[3][0] in "\"'" else m[3]
        number = None if ISO_DATE.match(value) and not legacy_numeric else leading_number(value)
        filters.append(Filter(m[1].lower(), OPERATORS[m[2]], value if number is None or math.isinf(number) else number, m[3]))
    rest.append(query[at:])
    return ParsedQuery(re.sub(r"\s+", " ", " ".join(rest)).strip(), tuple(filters))


NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def as_date(text: Column) -> Column:
    """Milliseconds of YYYY[-MM[-DD]] or another date string; null for anything else."""
    full = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).otherwise(text)
    return F.unix_millis(F.try_to_timestamp(full))


def _equal(item: Column, value: str | float) -> Column:
    shown = f"{value:g}" if isinstance(value, float) else value
    plain = F.lower(item) == shown.lower()
    if isinstance(value, float):
        return plain | F.coalesce(item.try_cast("double") == value, F.lit(False)) | (((F.lower(item) == "true") & (shown == "1")) | ((F.lower(item) == "false") & (shown == "0")))
    return plain


def _ordered(item: Column, value: str | float, op: str) -> Column:
    test = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b}[op]
    if isinstance(value, float):
        number = F.nullif(F.regexp_extract(item, NUMBER_PREFIX, 1), F.lit("")).try_cast("double")
        as_text = test(F.lower(item), F.lit(f"{value:g}"))
        # A year, or milliseconds, is a date to compare with dates that aren't numbers themselves.
        when = as_date(F.lit(f"{value:.0f}")) if 1900 <= value <= 2100 and value == int(value) else F.lit(value) if value > 1e10 else F.lit(None).cast("double")
        return F.coalesce(test(number, F.lit(value)), test(as_date(item), when), as_text)
    return F.coalesce(test(as_date(item), as_date(F.lit(value))), test(F.lower(item), F.lit(value.lower())))


def predicate(f: Filter, metadata: Column) -> Column:
    """One filter over a map of strings to arrays of strings. No metadata fails everything; a missing field
    passes only "not equal"; keys are compared without case; any element of an array is enough."""
    keys = F.map_filter(metadata, lambda k, v: (F.lower(k) == f.field) & v.isNotNull())
    values = F.get(F.map_values(keys), F.lit(0))
    if f.operator in ("eq", "neq"):
        hit = F.exists(values, lambda x: _equal(x, f.value))
        found = ~hit if f.operator == "neq" else hit
    elif f.operator == "contains":
        shown = (f"{f.value:g}" if isinstance(f.value, float) else f.value).lower()
        found = F.exists(values, lambda x: F.lower(x).contains(shown))
    else:
        found = F.exists(values, lambda x: _ordered(x, f.value, f.operator))
    return F.when(metadata.isNull(), False).when(values.isNull(), f.operator == "neq").otherwise(F.coalesce(found, F.lit(False)))


def all_filters(filters: tuple[Filter, ...], metadata: Column) -> Column:
    out = F.lit(True)
    for f in filters:
        out = out & predicate(f, metadata)
    return out


def glob_regex(pattern: str, legacy: bool = False) -> str:
    """A path glob as a regular expression over the whole path.

    legacy: the loose reading, in which a double star takes in separators only before a slash, a pattern
    counts from any separator on unless it begins with one or with a double star and a slash, and a final
    double star leaves the end open.
    """
    anything, segments = (".*", "[^/]*") if legacy else ("(?:[^/]+/)*", ".*")
    out, i = [], 0
    while i < len(pattern):
        step, part = next(((n, p) for n, head, p in ((3, "**/", anything), (2, "**", segments), (1, "*", "[^/]*"), (1, "?", "[^/]")) if pattern.startswith(head, i)), (1, re.escape(pattern[i])))
        out.append(part)
        i += step
    start = "^" if not legacy or pattern.startswith(("**/", "/")) else "(?:^|/)"
    return start + "".join(out) + ("" if legacy and pattern.endswith("**") else "$")


def excluded(path: Column, patterns: list[str], legacy: bool = False) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p, legacy))
    return out


def mode_of(query: str, initial: str = "commands") -> tuple[str, str]:
    """The palette's mode and the cleaned query. Files and tags lose the first prefix wherever it stands."""
    for prefix, mode in PREFIXES:
        if query.startswith(prefix):
            return mode, query[1:].strip() if mode == "hybrid" else query.replace(prefix, "", 1)
    return initial, query


def split_tags(query: str) -> tuple[str, list[str]]:
    head, *tags = query.split("@")
    return head.strip(), [t.strip() for t in tags if t.strip()]


def tag_choice(tag: str) -> str:
    return f"/@{tag}"


def engine(available: list[str]) -> str:
    """Semantic, else hybrid, else keyword search, as far as they are there."""
    return next((e for e in ("semantic", "hybrid", "enhanced") if e in available), "substring")


def normal_phrase(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower())).strip()


def phrase_lexicon(notes: DataFrame) -> DataFrame:
    """Distinct phrases of two words or more from base names, aliases, link targets and texts, and headings."""
    from skerry.functions.text import basename

    arrays = F.concat(F.array(basename(F.col("path"))), F.coalesce("aliases", F.array()), F.coalesce("links", F.array()), F.coalesce("link_texts", F.array()), F.coalesce("headings", F.array()))
    each = notes.select(F.explode(arrays).alias("raw"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower("raw"), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return each.select(clean.alias("phrase")).where(F.size(F.split("phrase", " ")) >= 2).distinct()


def candidate_phrases(lexicon: DataFrame, query: str) -> list[str]:
    """Phrases that begin with a word of the query and have no word outside it; their number is bounded by the query."""
    words = normal_phrase(query).split()
    if not words:
        return []
    own = F.split("phrase", " ")
    return [r.phrase for r in lexicon.where(F.get(own, F.lit(0)).isin(words) & F.forall(own, lambda w: w.isin(words))).collect()]


@dataclass(frozen=True)
class Segment:
    text: str
    is_phrase: bool
    start: int
    end: int


def segments(query: str, phrases: list[str]) -> list[Segment]:
    """Left to right, the longest phrase that starts at the word, else the word. Offsets are of the normal form."""
    words, out, i, at = normal_phrase(query).split(), [], 0, 0
    known = sorted({tuple(p.split()) for p in phrases}, key=lambda p: -len(" ".join(p)))
    while i < len(words):
        hit = next((p for p in known if tuple(words[i : i + len(p)]) == p), None)
        text = " ".join(hit or (words[i],))
        out.append(Segment(text, hit is not None, at, at + len(text)))
        at += len(text) + 1
        i += len(hit) if hit else 1
    return out

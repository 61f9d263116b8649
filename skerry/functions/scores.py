"""Closed-form scores as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.session import HybridSettings, ScoreWeights

DAY = 86400.0


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def squash(score: Column) -> Column:
    return F.when(score > 0, score / (score + 1)).otherwise(0.0)


def recency(last: Column, now: Column, days: float = 7.0) -> Column:
    """exp(-age / days); 0 for what was never opened."""
    return F.when(last.isNull(), 0.0).otherwise(F.exp(-seconds_between(last, now) / (days * DAY)))


def recency_floor(score: Column, floor: float = 0.1) -> Column:
    return F.when(score >= floor, score).otherwise(0.0)


def frequency(usage: Column, top: float = 100.0) -> Column:
    return F.when(usage > 0, F.least(F.lit(1.0), F.log1p(usage) / F.log1p(F.lit(top)))).otherwise(0.0)


def usage_score(count: Column, most: Column) -> Column:
    return F.log1p(zero(count)) / F.log1p(F.greatest(most, F.lit(1)))


def bounce_score(bounces: Column, opens: Column, last: Column, now: Column) -> Column:
    rate = F.least(bounces / opens, F.lit(1.0)) * F.exp(-seconds_between(last, now) / (14 * DAY))
    return F.when((opens > 0) & (bounces > 0), rate).otherwise(0.0)


def combined(content: Column, last: Column, usage: Column, link: Column, bounce: Column, now: Column, weights: ScoreWeights = ScoreWeights(), days: float = 7.0, top: float = 100.0) -> Column:
    total = weights.relevance * squash(content) + weights.recency * recency(last, now, days) + weights.frequency * frequency(usage, top)
    return clamp(total + weights.link_importance * zero(link) - 0.1 * zero(bounce))


def breakdown(content: Column, last: Column, usage: Column, link: Column, bounce: Column, now: Column) -> Column:
    """The parts of the combined score."""
    parts = {"relevance": squash(content), "recency": recency(last, now), "frequency": frequency(usage), "link": zero(link), "bounce_penalty": 0.1 * zero(bounce)}
    return F.struct(*[F.round(v, 6).alias(k) for k, v in parts.items()])


def idf(df: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n + 1) / (F.coalesce(df, F.lit(0)) + 1)))


def min_max(score: Column, low: Column, high: Column) -> Column:
    span = high - low
    return (score - low) / F.when(span == 0, 1.0).otherwise(span)


def rrf(rank: Column, k: int, weight: float) -> Column:
    return F.when(rank.isNull(), 0.0).otherwise(F.lit(weight) / (k + rank))


def plain_final(fusion: Column) -> Column:
    return F.least(F.lit(1.0), fusion * 30)


def blended(fusion: Column, keyword: Column, semantic: Column, kw: float = 0.5, sw: float = 0.5) -> Column:
    """0.7 fusion and 0.3 of the weighted normalized scores of the lists that have the row."""
    weight = F.when(keyword.isNotNull(), kw).otherwise(0.0) + F.when(semantic.isNotNull(), sw).otherwise(0.0)
    score = zero(keyword) * kw + zero(semantic) * sw
    return 0.7 * fusion + 0.3 * F.when(weight > 0, score / weight).otherwise(0.0)


def title_score(title: Column, query: str) -> Column:
    from skerry.functions.text import query_words

    low, q, words = F.lower(title), query.lower(), query_words(query)
    share = sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0)) * 0.4 / max(1, len(words))
    return F.when(low == q, 1.0).when(low.startswith(q), 0.8).when(low.contains(q), 0.6).otherwise(share.cast("double"))


def density(content: Column, weights: dict[str, float]) -> Column:
    """Occurrences of each word, five at most, weighted; words are taken as they are, not as patterns."""
    total = sum(weights.values())
    if not total:
        return F.lit(0.0)
    low = F.lower(content)
    count = lambda w: (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    return sum((F.least(count(w) / 5, F.lit(1.0)) * x for w, x in weights.items()), F.lit(0.0)) / total


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it; a lambda's own captures are computed
    again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column, chunk: int = 256) -> Column:
    """Sums of the values up to each one. Summed in chunks, since a fold that appends copies what it has."""
    none = F.array().cast("array<int>")
    inner = lambda v: F.aggregate(v, F.struct(none.alias("s"), F.lit(0).alias("t")), lambda a, x: F.struct(F.concat(a["s"], F.array(a["t"] + x)).alias("s"), (a["t"] + x).alias("t")))
    empty = F.struct(F.array().cast("array<array<int>>").alias("out"), F.lit(0).alias("t"))
    shifted = lambda a, c: F.struct(F.concat(a["out"], F.array(F.transform(c["s"], lambda x: x + a["t"]))).alias("out"), (a["t"] + c["t"]).alias("t"))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda c: F.slice(v, c * chunk + 1, F.lit(chunk)))
    whole = lambda v: F.flatten(F.aggregate(F.transform(cut(v), inner), empty, shifted)["out"])
    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def positions(content: Column, word: str) -> Column:
    """0-based places of a word, overlaps included. A word that can't overlap itself is found by splitting;
    any other by cutting the text before each of its places."""
    low, quoted = F.lower(content), "\\Q" + word + "\\E"
    if any(word.startswith(word[i:]) for i in range(1, len(word))):
        lengths = F.transform(F.regexp_extract_all(low, F.lit(f"(?s).(?:(?!{quoted}).)*+"), 0), F.length)
        starts = let(running_sums(lengths), lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
        return F.when(low.startswith(word), F.concat(F.array(F.lit(0)), starts)).otherwise(starts)
    gaps = let(F.split(low, quoted), lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: F.length(x) + len(word)))
    return F.transform(running_sums(gaps), lambda x: x - len(word))


def covering_span(places: list[tuple[str, Column]]) -> Column:
    """The shortest stretch that holds one of each word; null if a word is missing.

    One pass over all places in order, with the latest place of each word at hand: at each place, the stretch
    from the earliest of those to the end of the word here. Of words at one place the longest comes first, so
    the shortest sees all of them.
    """
    longest = sorted(range(len(places)), key=lambda i: -len(places[i][0]))
    rank = {i: r for r, i in enumerate(longest)}
    marked = lambda r: lambda x: F.struct(x.alias("p"), F.lit(r).alias("k"))
    marks = F.concat(*[F.transform(p, marked(rank[i])) for i, (_, p) in enumerate(places)])
    sizes = [len(places[i][0]) for i in longest]
    names = [f"l{r}" for r in range(len(places))]
    start = F.struct(*[F.lit(None).cast("int").alias(n) for n in names], F.lit(None).cast("int").alias("best"))

    def step(acc: Column, x: Column) -> Column:
        latest = [F.when(x["k"] == r, x["p"]).otherwise(acc[n]) for r, n in enumerate(names)]
        whole = F.lit(True)
        for c in latest:
            whole = whole & c.isNotNull()
        size = F.element_at(F.array(*map(F.lit, sizes)), x["k"] + 1)
        span = x["p"] + size - (F.least(*latest) if len(latest) > 1 else latest[0])
        return F.struct(*[c.alias(n) for c, n in zip(latest, names, strict=True)], F.least(acc["best"], F.when(whole, span)).alias("best"))

    return F.aggregate(F.array_sort(marks), start, step)["best"]


def span_score(span: Column, expected: int) -> Column:
    return F.when(span.isNull(), 0.0).otherwise(clamp(1 / (1 + F.log(F.greatest(F.lit(1.0), span / expected)))))


def proximity(content: Column, query: str, segments: list[tuple[str, bool]] | None = None) -> Column:
    """How near the query words stand; 0.5 for one word, up to 0.3 while some are missing."""
    from skerry.functions.text import query_words

    words = query_words(query)
    if len(words) <= 1:
        return F.lit(0.5)
    low = F.lower(content)
    found = sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    if segments and any(phrase for _, phrase in segments):
        whole = segment_proximity(content, segments, words)
    else:
        whole = span_score(covering_span([(w, positions(content, w)) for w in words]), sum(map(len, words)) + len(words) - 1)
    return F.when(found < len(words), found * 0.3 / len(words)).otherwise(whole)


def segment_proximity(content: Column, segments: list[tuple[str, bool]], words: list[str]) -> Column:
    low, parts = F.lower(content), []
    for text, phrase in segments:
        own = [w for w in dict.fromkeys(text.split()) if len(w) > 2]
        if not phrase:
            if text in words:
                parts.append(F.lit(1.0))
            continue
        rest = span_score(covering_span([(w, positions(content, w)) for w in own]), sum(map(len, own)) + len(own) - 1) if len(own) > 1 else F.lit(0.0)
        parts.append(F.when(low.contains(text), 1.0).otherwise(rest))
    return clamp(sum(parts, F.lit(0.0)) / len(parts)) if parts else F.lit(0.5)


def rerank_boost(title: Column, recent: Column, usage: Column, content: Column, page_rank: Column, near: Column, bounce: Column, settings: HybridSettings = HybridSettings()) -> Column:
    w = settings.rerank_weights()
    return w["title"] * title + w["recency"] * recent + w["usage"] * usage + w["content"] * content + w["page_rank"] * page_rank + w["proximity"] * near - 0.1 * bounce


def reranked_final(fusion: Column, boost: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.6 * plain_final(fusion) + 0.4 * boost)


def semantic_relevance(similarity: Column, title: Column, tags: Column, headings: Column, modified: Column, size: Column, query: str, now: Column) -> Column:
    q = query.lower()
    low, days = F.lower(title), seconds_between(modified, now) / DAY
    bonus = F.when(low == q, 0.25).when(low.contains(q), 0.15).otherwise(0.0)
    fresh = F.when(days < 30, 0.1 * F.greatest(F.lit(0.0), (30 - days) / 30)).otherwise(0.0)
    named = lambda items, x: F.when(F.exists(items, lambda t: F.lower(t).contains(q)), x).otherwise(0.0)
    medium = F.when((size > 1000) & (size < 50000), 0.02).otherwise(0.0)
    return F.least(F.lit(1.0), 0.6 * similarity + bonus + fresh + named(tags, 0.1) + named(headings, 0.08) + medium)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for vectors of different lengths or without length."""
    da, db = F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(da, da)) * F.sqrt(dot(db, db))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(da, db) / norm).otherwise(0.0)

"""Palette items: sorting, pins, fuzzy and OR matching, tags, aliases, hidden items, macros."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def commands(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc("text"), F.desc("id"))


def pinned(pins: DataFrame, items: DataFrame) -> DataFrame:
    """Pins in reverse order of their place; pins of what is gone are dropped."""
    return pins.join(items, "id").orderBy(F.desc("pos"))


def keep_last(rows: DataFrame, seq: str = "seq", key: str = "id") -> DataFrame:
    """An ordered set: a key added again moves to the end."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return rows.withColumn("n", n).where("n = 1").drop("n")


def sorted_items(items: DataFrame, order: tuple[str, ...] = ("pinned", "recent"), slots: int = 64) -> DataFrame:
    """Reverse insertion order, with pinned and recent items on top: every item with its 1-based place.

    Places are counted in slots and shifted by the slots before, so no task sorts the whole table. A time
    that is itself a quantile may be that of many items, as may be none; those are cut by ``seq`` as well.
    """
    group = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        group = F.when(F.col("is_pinned") if name == "pinned" else F.col("last_used").isNotNull(), i).otherwise(group)
    used, at = -F.unix_micros(F.col("last_used").cast("timestamp")), -F.col("seq")
    steps = [i / slots for i in range(1, slots)]
    q = items.agg(F.percentile_approx(used, steps, 1000).alias("used"), F.percentile_approx(at, steps, 1000).alias("at")).first()
    times, seqs = (F.array_distinct(F.lit(list(x)) if x else F.array().cast("array<bigint>")) for x in (q.used, q["at"]))
    below = lambda c, cuts: F.size(F.filter(cuts, lambda x: x < c))
    time = F.when(used.isNull(), 2 * F.size(times) + 1).otherwise(below(used, times) + F.size(F.filter(times, lambda x: x <= used)))
    seq = F.when(at.isNull(), F.size(seqs) + 1).otherwise(below(at, seqs))
    cut = items.withColumn("group", group).withColumn("time_slot", time).withColumn("seq_slot", F.when(F.col("time_slot") % 2 == 1, seq).otherwise(0))
    slot = ["group", "time_slot", "seq_slot"]
    sums = cut.groupBy(*slot).agg(F.count("*").alias("c"))
    before = sums.select(*slot, F.coalesce(F.sum("c").over(Window.orderBy(*slot).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*slot).orderBy(F.desc_nulls_last("last_used"), F.desc_nulls_last("seq")))
    out = cut.withColumn("n", inside).join(F.broadcast(before), slot).withColumn("place", F.col("before") + F.col("n"))  # a number of slots fixed by ``slots``
    return out.drop("time_slot", "seq_slot", "n", "before")


def limited(rows: DataFrame, hidden: DataFrame, limit: int = 50) -> DataFrame:
    """(id, pos, is_previous): the limit counts visible rows, previous ones come first in their order."""
    kept = rows.join(hidden.select("id"), "id", "left_anti").orderBy("pos").limit(limit)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("is_previous"), "pos")))


def hidden_count(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    return rows.join(hidden, "id", "left_semi").agg(F.count("*").alias("hidden"))


def toggle(hidden: DataFrame, item: str) -> DataFrame:
    """Hide an id, or show it again if it is hidden."""
    one = hidden.sparkSession.createDataFrame([(item,)], "id string")
    return hidden.select("id").join(one, "id", "left_anti").unionByName(one.join(hidden, "id", "left_anti"))


def any_of(text: Column, query: str) -> Column:
    """Alternatives between ||; their case counts."""
    out = F.lit(False)
    for q in (x.strip() for x in query.split("||")):
        if q:
            out = out | text.contains(q)
    return out


def subsequence(text: Column, query: str) -> Column:
    """The query's characters in order, whatever their case."""
    chars = [re.escape(c) for c in query.lower() if not c.isspace()]
    return text.rlike("(?is)" + ".*?".join(chars)) if chars else F.lit(True)


def fuzzy_score(text: Column, query: str) -> Column:
    """Ours: the whole query in one piece 1, at the start of a word 0.1 more, else by the length of the shortest
    stretch found from the left."""
    q = query.lower()
    low = F.lower(text)
    chars = [re.escape(c) for c in q if not c.isspace()]
    stretch = F.length(F.regexp_extract(low, "(?s)" + ".*?".join(chars), 0))
    at_word = low.rlike(r"(?:^|[^\p{L}\p{N}])" + re.escape(q))
    return F.when(at_word, 1.1).when(low.contains(q), 1.0).when(stretch > 0, len(chars) / stretch).otherwise(0.0)


def has_tag(tags: Column, wanted: list[str]) -> Column:
    """Any wanted tag is one of the item's or an ancestor of one."""
    norm = lambda t: t if t.startswith("#") else "#" + t
    return F.exists(tags, lambda t: _any(((t == norm(w)) | t.startswith(norm(w) + "/")) for w in wanted)) if wanted else F.lit(True)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def suggest(items: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """text@tag@tag, with || for alternatives or else fuzzy, best first."""
    from skerry.plans.query import split_tags

    head, tags = split_tags(query)
    if "||" in head:
        rows = items.where(any_of(F.col("text"), head)).withColumn("score", F.lit(1.0))
    else:
        rows = items.where(subsequence(F.col("text"), head)).withColumn("score", F.round(fuzzy_score(F.col("text"), head), 6)) if head else items.withColumn("score", F.lit(0.0))
    rows = rows.where(has_tag(F.col("tags"), tags)) if tags else rows
    return rows.orderBy(F.desc("score"), "text", "id").limit(limit)


def tag_counts(items: DataFrame) -> DataFrame:
    return items.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def with_aliases(files: DataFrame) -> DataFrame:
    """One row for the file and one for each alias; the alias is a column of its own."""
    names = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("aliases", F.array()))
    each = files.select("path", "tags", F.explode_outer(names).alias("alias"))
    return each.withColumn("text", F.coalesce("alias", "path"))


def without_suffixes(files: DataFrame, suffixes: list[str]) -> DataFrame:
    return files.where(~_any(F.col("path").endswith(s) for s in suffixes))


def link_candidates(files: DataFrame, unresolved: DataFrame, source: str, suffixes: list[str] = (), recent: DataFrame | None = None) -> DataFrame:
    """Files and unresolved targets but for the source, recent ones first, then by name."""
    both = without_suffixes(files.select("path"), list(suffixes)).withColumn("is_unresolved", F.lit(False)).unionByName(unresolved.select(F.col("target").alias("path"), F.lit(True).alias("is_unresolved")))
    kept = both.where(F.col("path") != source)
    if recent is None:
        return kept.withColumn("last_opened", F.lit(None).cast("timestamp")).orderBy("path")
    return kept.join(recent.select("path", "last_opened"), "path", "left").orderBy(F.desc_nulls_last("last_opened"), "path")


def substring_search(rows: DataFrame, query: str, limit: int = 50) -> DataFrame:
    return rows.where(F.lower("path").contains(query.lower())).orderBy("path").limit(limit)


def default_suggestions(recent: DataFrame, files: DataFrame, total: int = 10, opened: int = 8) -> DataFrame:
    """The last opened (score 1), then the last modified that aren't among them (0.8), up to the total."""
    first = recent.orderBy(F.desc("last_opened"), "path").limit(opened).select("path", F.col("last_opened").alias("at"), F.lit(1.0).alias("score"))
    rest = files.join(first.select("path"), "path", "left_anti").orderBy(F.desc("last_modified"), "path").limit(total).select("path", F.col("last_modified").alias("at"), F.lit(0.8).alias("score"))
    return first.unionByName(rest).orderBy(F.desc("score"), F.desc("at"), "path").limit(total)


@dataclass
class Macros:
    """Named lists of queries, run in order if all are there."""

    known: dict[str, Callable] = field(default_factory=dict)
    lists: dict[str, tuple[tuple[str, ...], int]] = field(default_factory=dict)

    def add(self, name: str, queries: list[str], delay_ms: int = 0) -> None:
        self.lists[name] = (tuple(queries), delay_ms)

    def remove(self, name: str) -> None:
        self.lists.pop(name, None)

    def available(self, name: str) -> bool:
        return all(q in self.known for q in self.lists[name][0])

    def run(self, name: str, spark, sf_dir: str) -> list[DataFrame]:
        if not self.available(name):
            raise KeyError(f"macro {name} names queries that don't exist")
        return [self.known[q](spark, sf_dir) for q in self.lists[name][0]]

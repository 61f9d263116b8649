"""Behaviour: opens, searches, bounces, and the reports made of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import scores

BOUNCE_SECONDS, HISTORY = 5.0, 1000


def access(events: DataFrame, kinds: tuple[str, ...] = ("click",)) -> DataFrame:
    """(path, opens, first_opened, last_opened)."""
    opens = events.where(F.col("kind").isin(*kinds))
    return opens.groupBy("path").agg(F.count("*").alias("opens"), F.min("ts").alias("first_opened"), F.max("ts").alias("last_opened"))


def scored_access(table: DataFrame, now: Column) -> DataFrame:
    """Usage in relation to the most opened file, and recency. The largest count is one row."""
    most = table.agg(F.greatest(F.max("opens"), F.lit(1)).alias("most"))
    return table.crossJoin(F.broadcast(most)).withColumn("usage", scores.usage_score(F.col("opens"), F.col("most"))).withColumn("recency", scores.recency(F.col("last_opened"), now)).drop("most")


def bounces(events: DataFrame, open_kind: str = "click", modal_kind: str = "view", seconds: float = BOUNCE_SECONDS, per: str | None = None, slot: int = 3600) -> DataFrame:
    """A search modal that opens less than so many seconds after the latest open from a search: (path, ts, after).

    Only the event just before can be that open, since any modal clears what came before it. per: the
    column within which events follow each other (one user's), None for one stream of all. Events are
    looked at in time slots, each with the last events of the slot before it as far back as a bounce can
    reach, so a single stream is no single task.
    """
    both = events.where(F.col("kind").isin(open_kind, modal_kind))
    width = int(max(slot, math.ceil(seconds)) * 1e6)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.floor(us / width)
    late = us - own * width >= width - int(math.ceil(seconds * 1e6))
    places = F.when(late, F.array(F.struct(own.alias("slot"), F.lit(True).alias("own")), F.struct((own + 1).alias("slot"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(own.alias("slot"), F.lit(True).alias("own"))))
    dealt = both.select("*", F.inline(places))
    w = Window.partitionBy("slot", *([per] if per else [])).orderBy("ts", "event_id")
    seen = dealt.select("*", F.lag("kind").over(w).alias("before"), F.lag("path").over(w).alias("opened"), F.lag("ts").over(w).alias("at")).where("own")
    after = scores.seconds_between(F.col("at"), F.col("ts"))
    kept = seen.where((F.col("kind") == modal_kind) & (F.col("before") == open_kind) & (after < seconds))
    return kept.select(*([per] if per else []), F.col("opened").alias("path"), "ts", F.round(after, 6).alias("after"))


def bounce_table(events: DataFrame, found: DataFrame, open_kind: str = "click") -> DataFrame:
    """(path, opens, bounces, last_bounce)."""
    opens = events.where(F.col("kind") == open_kind).groupBy("path").agg(F.count("*").alias("opens"))
    back = found.groupBy("path").agg(F.count("*").alias("bounces"), F.max("ts").alias("last_bounce"))
    return opens.join(back, "path", "left").withColumn("bounces", F.coalesce("bounces", F.lit(0)))


def high_bounce(table: DataFrame, least: int = 3, k: int = 10) -> DataFrame:
    rate = F.col("bounces") / F.col("opens")
    return table.where(F.col("opens") >= least).select("path", F.round(rate, 6).alias("bounce_rate"), "bounces").orderBy(F.desc("bounce_rate"), "path").limit(k)


def recent(table: DataFrame, k: int = 10) -> DataFrame:
    return table.orderBy(F.desc("last_opened"), "path").limit(k)


def frequent(table: DataFrame, k: int = 10) -> DataFrame:
    return table.orderBy(F.desc("opens"), "path").limit(k)


def stale(table: DataFrame, now: Column, days: int = 30, k: int = 10) -> DataFrame:
    """Not opened for so many days, the longest first."""
    return table.where(scores.seconds_between(F.col("last_opened"), now) > days * scores.DAY).orderBy("last_opened", "path").limit(k)


def totals(table: DataFrame, searches: DataFrame) -> DataFrame:
    """One row: opens, files and searches."""
    return table.agg(F.coalesce(F.sum("opens"), F.lit(0)).alias("total_opens"), F.count("*").alias("files")).crossJoin(searches.agg(F.count("*").alias("searches")))


def history(searches: DataFrame, k: int = HISTORY) -> DataFrame:
    """The latest searches, trimmed text; blank ones aren't kept."""
    kept = searches.where("query is not null and query <> ''").withColumn("query", F.trim("query"))
    return kept.orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def query_frequency(searches: DataFrame, k: int = 10) -> DataFrame:
    """(query, count, last_used), the most frequent first, then the latest."""
    each = searches.groupBy(F.trim("query").alias("query")).agg(F.count("*").alias("count"), F.max("ts").alias("last_used"))
    return each.orderBy(F.desc("count"), F.desc("last_used"), "query").limit(k)


def with_signals(results: DataFrame, usage: DataFrame, bounce: DataFrame, ranks: DataFrame, key: str = "path") -> DataFrame:
    """Results with usage, recency, bounce and page rank, 0 where there is none."""
    out = results
    for table in (usage, bounce, ranks):
        out = out.join(table, key, "left")
    return out


def selection(ts: Column, user: Column, query: Column, path: Column) -> Column:
    """A chosen result as the two events that it is: a search with its choice and one open."""
    search = F.struct(ts.alias("ts"), user.alias("user"), F.lit("search").alias("kind"), query.alias("query"), path.alias("path"))
    opened = F.struct(ts.alias("ts"), user.alias("user"), F.lit("open").alias("kind"), F.lit(None).cast("string").alias("query"), path.alias("path"))
    return F.array(search, opened)


def export_json(table: DataFrame, folder: str) -> None:
    table.write.mode("overwrite").json(folder)


def import_json(spark, folder: str) -> DataFrame:
    """Access rows of a version 1 or 2 export; missing values become 0 or the other date."""
    raw = spark.read.schema("version string, path string, opens bigint, first_opened timestamp, last_opened timestamp").json(folder)
    ok = raw.where(F.col("version").isNull() | F.substring_index("version", ".", 1).isin("1", "2")).where("path is not null")
    return ok.select("path", F.coalesce("opens", F.lit(0)).alias("opens"), F.coalesce("first_opened", "last_opened").alias("first_opened"), F.coalesce("last_opened", "first_opened").alias("last_opened"))


def estimated_bytes(files: Column, searches: Column) -> Column:
    return files * 100 + searches * 80

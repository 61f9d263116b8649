"""Incremental maintenance: change detection, event compaction, validity of caches, keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def needs_indexing(files: DataFrame, metadata: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """Files (id, content_hash, last_modified, size) without metadata, changed, newer than their index, or not in it: (id, reason).

    The hash decides; the time only matters where hashes are missing or the entry is older than the file.
    """
    m = metadata.select("id", F.col("content_hash").alias("h"), F.col("last_modified").alias("t"), F.col("size").alias("s"), "indexed_at", F.lit(True).alias("known"))
    rows = files.join(m, "id", "left")
    if indexed is not None:
        rows = rows.join(indexed.select("id", F.lit(True).alias("there")), "id", "left")
    else:
        rows = rows.withColumn("there", F.lit(True))
    same = F.col("content_hash").eqNullSafe(F.col("h"))
    reason = F.when(F.col("known").isNull(), "new").when(~same, "content").when(~F.col("size").eqNullSafe(F.col("s")), "size").when(F.col("last_modified") > F.col("indexed_at"), "stale").when(F.col("there").isNull(), "missing")
    return rows.withColumn("reason", reason).where("reason is not null").select("id", "reason")


def removed(files: DataFrame, metadata: DataFrame) -> DataFrame:
    return metadata.join(files, "id", "left_anti").select("id")


def indexable(files: DataFrame, most: int = 512 * 1024) -> DataFrame:
    return files.where((F.col("size") <= most) & (F.trim("content") != ""))


def placed(rows: DataFrame, order: str = "id", slots: int = 64) -> DataFrame:
    """Rows with their 0-based place by a numeric column. Ranks are counted in slots between quantiles and
    shifted by the slots before, so no task sorts the whole table. The quantiles are ``slots`` numbers."""
    cuts = rows.agg(F.percentile_approx(order, [i / slots for i in range(1, slots)], 1000).alias("q")).first().q or []
    bounds = sorted(set(cuts))
    slot = sum((F.when(F.col(order) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    cut = rows.withColumn("slot", slot)
    sums = cut.groupBy("slot").agg(F.count("*").alias("c"))
    before = sums.select("slot", F.coalesce(F.sum("c").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("slot").orderBy(order)) - 1
    return cut.withColumn("n", inside).join(F.broadcast(before), "slot").withColumn("place", F.col("before") + F.col("n")).drop("slot", "n", "before")  # ``slots`` rows at most


def spread_sample(rows: DataFrame, n: int, order: str = "id") -> DataFrame:
    """n rows evenly spread by place: those at floor(i * total / n). The total is one row."""
    ranked = placed(rows, order).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))
    first = F.ceil(F.col("place") * n / F.col("total"))
    hit = (first < n) & (F.floor(first * F.col("total") / n) == F.col("place"))
    return ranked.where((F.col("total") <= n) | hit).drop("place", "total")


def cache_valid(cached: DataFrame, live: DataFrame, sample: int = 50) -> DataFrame:
    """One row: whether the count has drifted by more than 10 % (or one), and whether a sampled file is newer."""
    counts = cached.agg(F.count("*").alias("cached")).crossJoin(live.agg(F.count("*").alias("live")))
    some = spread_sample(live, sample).join(cached.select("id", "indexed_at"), "id", "left")
    newer = some.agg(F.coalesce(F.max((F.col("indexed_at").isNull() | (F.col("last_modified") > F.col("indexed_at"))).cast("int")), F.lit(0)).alias("newer"))
    drift = F.abs(F.col("cached") - F.col("live")) > F.greatest(F.lit(1.0), F.col("live") * 0.1)
    return counts.crossJoin(newer).select("cached", "live", drift.alias("drifted"), (F.col("newer") == 1).alias("newer"), (~drift & (F.col("newer") == 0)).alias("valid"))


def compacted(events: DataFrame) -> DataFrame:
    """The last event of each path; a rename is the old path's deletion and the new one's creation."""
    plain = F.struct(F.col("path").alias("path"), F.col("op").alias("op"))
    pair = F.array(F.struct(F.col("old_path").alias("path"), F.lit("delete").alias("op")), F.struct(F.col("path").alias("path"), F.lit("create").alias("op")))
    each = events.select("ts", "event_id", F.explode(F.when(F.col("op") == "rename", pair).otherwise(F.array(plain))).alias("e")).select("ts", "event_id", "e.path", "e.op")
    return each.groupBy("path").agg(F.max_by("op", F.struct("ts", "event_id")).alias("op"), F.max("ts").alias("ts"), F.count("*").alias("events"))


def debounced(events: DataFrame, gap: float, key: str = "path") -> DataFrame:
    """Bursts of each key that are no more than gap seconds apart: (key, started, ended, n, last op)."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    new = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > F.lit(int(gap * 1e6))) | F.lag("ts").over(w).isNull()
    marked = events.withColumn("burst", F.sum(new.cast("int")).over(w))
    return marked.groupBy(key, "burst").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.max_by("op", F.struct("ts", "event_id")).alias("op"))


def throttled(events: DataFrame, seconds: int, key: str = "path") -> DataFrame:
    """Fixed windows with the set of keys pending in each: (window, keys, events)."""
    start = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds
    return events.groupBy(start.alias("window")).agg(F.countDistinct(key).alias("keys"), F.count("*").alias("events"))


def allowed(events: DataFrame, paused: bool) -> DataFrame:
    """While paused only deletions pass."""
    return events.where("op = 'delete'") if paused else events


def upserted(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows in the place of those with their keys; the last of a key wins by its order in ``seq`` if there is one."""
    if "seq" in rows.columns:
        n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
        rows = rows.withColumn("n", n).where("n = 1").drop("n", "seq")
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(table.columns))


def updated_df(df: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Document frequencies after documents changed: (term, df) plus and minus the distinct terms of (id, term)."""
    delta = after.distinct().select("term", F.lit(1).alias("d")).unionByName(before.distinct().select("term", F.lit(-1).alias("d")))
    return df.select("term", F.col("df").alias("d")).unionByName(delta).groupBy("term").agg(F.sum("d").alias("df")).where("df > 0")


def updated_postings(post: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without those of changed or deleted documents, and the new ones."""
    ids = fresh.select("id").union(gone.select("id")).distinct()
    return post.join(ids, "id", "left_anti").select(fresh.columns).unionByName(fresh)


def progressive(results: DataFrame, limit: int, step: int = 10, score: str = "score", key: str = "id") -> DataFrame:
    """The first ``limit`` rows in content order, each with the emission that first shows it."""
    place = F.row_number().over(Window.orderBy(F.desc(score), key))
    kept = results.withColumn("place", place).where(F.col("place") <= limit)
    return kept.withColumn("emission", F.ceil(F.col("place") / step).cast("int"))


def store_stats(rows: DataFrame, size: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"))


def index_stats(docs: DataFrame, updated: Column) -> DataFrame:
    return docs.agg(F.count("*").alias("document_count"), (F.count("*") * 1024).alias("index_size"), F.max(updated).alias("last_updated")).withColumn("version", F.lit("1.0.0"))

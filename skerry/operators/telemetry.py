"""Latency statistics, the health score, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST = 100


def last_samples(samples: DataFrame, k: int = LAST) -> DataFrame:
    """The latest k samples of each kind: (kind, ts, ms). Spark limits each group before the shuffle."""
    n = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("ts"), F.desc("event_id")))
    return samples.withColumn("n", n).where(F.col("n") <= k).drop("n")


def latency_stats(samples: DataFrame, k: int = LAST) -> DataFrame:
    """Mean, the sample at floor(n/2), that at floor(0.95 n), largest and number. Groups hold k samples at most."""
    kept = last_samples(samples, k).groupBy("kind").agg(F.sort_array(F.collect_list("ms")).alias("s"))
    n = F.size("s")
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / n
    at = lambda q: F.element_at("s", F.floor(n * q).cast("int") + 1)
    return kept.select("kind", F.round(mean, 6).alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"), F.array_max("s").alias("max"), n.alias("n"))


def memory_stats(samples: DataFrame, k: int = LAST) -> DataFrame:
    """Mean, peak and latest of (kind, ts, mb); 0 without samples."""
    kept = last_samples(samples, k)
    return kept.agg(F.coalesce(F.round(F.avg("ms"), 6), F.lit(0.0)).alias("average"), F.coalesce(F.max("ms"), F.lit(0.0)).alias("peak"), F.coalesce(F.max_by("ms", F.struct("ts", "event_id")), F.lit(0.0)).alias("current"))


def health(search_ms: Column, indexing_ms: Column, memory_mb: Column) -> Column:
    """100 less three capped penalties, rounded, not below 0."""
    over = lambda x, base, unit, cap: F.when(x > base, F.least(F.lit(float(cap)), (x - base) / unit)).otherwise(0.0)
    return F.greatest(F.lit(0), F.round(100 - over(search_ms, 100, 10, 50) - over(indexing_ms, 1000, 100, 30) - over(memory_mb, 50, 10, 20)).cast("int"))


def acceptable(mean: Column, p95: Column) -> Column:
    return (mean <= 200) & (p95 <= 500)


def recommendations(mean: Column, p95: Column, indexing: Column, memory: Column) -> Column:
    said = F.array(F.when(mean > 100, "search is slow on average"), F.when(p95 > 300, "some searches are slow"), F.when(indexing > 2000, "indexing is slow"), F.when(memory > 100, "memory use is high"))
    return F.array_compact(said)


def slow(ms: Column, kind: Column) -> Column:
    return ((kind == "search") & (ms > 1000)) | ((kind == "indexing") & (ms > 100))


def concurrency(samples: DataFrame, start: int = 5, top: int = 10, cooldown: float = 5.0) -> DataFrame:
    """The adaptive request limit as a fold over each key's samples (key, ts, ms, ok): (key, ts, limit).

    Of the last ten samples: an error or more than half slow lowers it, more than 70 percent fast and a fast mean
    raises it, at most once in the cooldown, within 1 and ``top``.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, limit, changed, window = [], start, None, []
        for ts, ms, ok in pdf.sort_values(["ts", "ms"])[["ts", "ms", "ok"]].itertuples(index=False):
            window = [*window, (ms, ok)][-10:]
            if changed is None or (ts - changed).total_seconds() >= cooldown:
                times = [m for m, _ in window]
                step = 0
                if not all(o for _, o in window) or sum(m > 2000 for m in times) > len(times) / 2:
                    step = -1
                elif sum(m < 500 for m in times) > 0.7 * len(times) and sum(times) / len(times) < 500:
                    step = 1
                new = max(1, min(top, limit + step))
                if new != limit:
                    limit, changed = new, ts
            rows.append((pdf["key"].iloc[0], ts, limit))
        return pd.DataFrame(rows, columns=["key", "ts", "limit"])

    return samples.groupBy("key").applyInPandas(fold, "key string, ts timestamp, `limit` int")


def batch_plan(files: int, batch: int = 2, per_file_ms: int = 150, per_batch_ms: int = 400) -> dict[str, int]:
    """More than 200 files: twice the batch (20 at most) and half the delays."""
    if files > 200:
        return {"batch": min(20, batch * 2), "per_file_ms": per_file_ms // 2, "per_batch_ms": per_batch_ms // 2}
    return {"batch": batch, "per_file_ms": per_file_ms, "per_batch_ms": per_batch_ms}

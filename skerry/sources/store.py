"""Keyed tables on Parquet: content, index metadata, usage and page ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.maintenance import upserted


class Store:
    """Versions of keyed tables under one folder; a write makes a new version and then points to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, table: str) -> list[int]:
        fs, p = self._fs(f"{self.folder}/{table}")
        if not fs.exists(p):
            return []
        done = []
        for s in fs.listStatus(p):
            ok, q = self._fs(f"{s.getPath().toString()}/_SUCCESS")
            if ok.exists(q):
                done.append(int(s.getPath().getName()[1:]))
        return sorted(done)

    def read(self, table: str) -> DataFrame | None:
        """The last version that was written whole."""
        v = self._versions(table)
        return self.spark.read.parquet(f"{self.folder}/{table}/v{v[-1]}") if v else None

    def write(self, table: str, rows: DataFrame, keep: int = 2) -> None:
        v = self._versions(table)
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/v{(v[-1] if v else 0) + 1}")
        for old in v[: max(0, len(v) + 1 - keep)]:
            fs, p = self._fs(f"{self.folder}/{table}/v{old}")
            fs.delete(p, True)

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to the last version without reading or writing what it holds."""
        v = self._versions(table)
        rows.write.mode("append").parquet(f"{self.folder}/{table}/v{v[-1] if v else 1}")

    def put(self, table: str, rows: DataFrame, key: str = "id") -> None:
        now = self.read(table)
        self.write(table, rows.drop("seq") if now is None else upserted(now, rows, key))

    def delete(self, ids: DataFrame, tables: tuple[str, ...] = ("content", "index_metadata", "usage_stats"), key: str = "id") -> None:
        """Take ids out of all tables."""
        for t in tables:
            if (now := self.read(t)) is not None:
                self.write(t, now.join(ids.select(key), key, "left_anti"))

    def clear(self, tables: tuple[str, ...] = ("content", "index_metadata", "usage_stats")) -> None:
        for t in tables:
            fs, p = self._fs(f"{self.folder}/{t}")
            fs.delete(p, True)

    def save_index(self, postings: DataFrame, df: DataFrame) -> None:
        """Postings and term counts in order of terms, so that a query's terms prune files and row groups.

        Each posting tells the generation that wrote it; this one is 0 and replaces all others.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for name, rows in (("postings", postings.withColumn("gen", F.lit(0).cast("long"))), ("term_df", df)):
            self.write(name, rows.repartitionByRange(n, "term").sortWithinPartitions("term"))
        self.clear(("changed",))

    def change_index(self, postings: DataFrame, ids: DataFrame, df: DataFrame) -> None:
        """Postings of a batch, and the ids whose former postings end with it: written beside what is there.

        ``df`` holds the changes of term counts, a row for each term that has any. ``save_index`` folds all in again.
        """
        known = self.read("changed")
        gen = (known.agg(F.max("gen").alias("g")).first().g or 0 if known is not None else 0) + 1
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.append("postings", postings.withColumn("gen", F.lit(gen).cast("long")).repartitionByRange(n, "term").sortWithinPartitions("term"))
        whole = self.read("term_df").unionByName(df).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        self.write("term_df", whole.repartitionByRange(n, "term").sortWithinPartitions("term"))
        self.append("changed", ids.select("id").distinct().withColumn("gen", F.lit(gen).cast("long")))

    def load_index(self) -> tuple[DataFrame, DataFrame] | None:
        post, df, changed = self.read("postings"), self.read("term_df"), self.read("changed")
        if post is None or df is None:
            return None
        if changed is not None:
            last = changed.groupBy("id").agg(F.max("gen").alias("last"))
            post = post.join(last, "id", "left").where("last is null or gen = last").drop("last")
        return post.drop("gen"), df

    def save_ranks(self, ranks: DataFrame, at) -> None:
        self.write("page_rank", ranks.withColumn("computed_at", at))

    def load_ranks(self, now, fresh_seconds: int = 3600) -> DataFrame | None:
        """Page ranks that are less than an hour old."""
        rows = self.read("page_rank")
        return None if rows is None else rows.where(F.unix_timestamp(now) - F.unix_timestamp("computed_at") < fresh_seconds)

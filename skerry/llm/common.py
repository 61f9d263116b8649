"""Helpers shared by the training-data operators: scratch tables, keys and graph contraction."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_BYTES, BROADCAST = 8 << 20, 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session on one machine gets a temporary folder. On a cluster that would be a disk
    of each machine's own, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "skerry")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder if re.match(r"\w+:", folder) else "file://" + os.path.abspath(folder)


class Scratch:
    """Tables written once into the shared folder; losing an executor loses none of them.

    What an operator's result still reads is deleted when the driver's Python ends, the rest before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.named = spark, []
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._at_end)

    def _at_end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be stopped by then
            self.drop()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """A table in buckets by its keys, so that joins on them needn't shuffle it again."""
        n = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        known = f"{re.sub(r'[^A-Za-z0-9]', '_', self.root.rsplit('/', 1)[-1])}_{name}"
        df.write.mode("overwrite").format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", f"{self.root}/{name}").saveAsTable(known)
        self.named.append(known)
        return self.spark.table(known)

    def drop(self, name: str = "") -> None:
        for known in self.named if not name else ():
            self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int, most: int = BROADCAST) -> DataFrame:
    """A table of a few numbers in each row, broadcast if it has been counted to be small."""
    return F.broadcast(df) if rows <= most else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage; the blocks live in the shared folder until Spark's cleaner frees them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def document_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key as a long and the text, whatever else the table holds; a null text becomes empty.

    A key that is no number fails under ANSI rules and is null without them.
    """
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that gone tells by doc_id and text_key, the hash of the text; all columns stay as they are.

    Columns of docs may have any names: the two that are matched are named apart from all of them.
    """
    d, t = (next(n for n in (f"{c}{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for c in ("gone_id_", "gone_text_"))
    keys = gone.select(F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(t))
    return docs.join(keys.hint("merge"), same, "left_anti")


def local_roots(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches within a block's links."""
    root, big = ids.copy(), np.iinfo(np.int64).max
    while True:
        low = np.minimum(root, np.where(near, root[None, :], big).min(axis=1))
        if (low == root).all():
            return root
        root = low


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, component)`` with the smallest reachable node, nodes with links only.

    Alternating large-star and small-star contraction (Kiveris et al., 2014): each round is two
    aggregations with map-side combining and two joins, and never gathers a component anywhere.
    The number of rounds grows with the logarithm of the longest path. Until nothing changes, each round
    moves a link to smaller ends or drops one and moves none to larger ones, so it ends for any graph.
    """
    pairs = edges.select("a", "b").where("a <> b")
    live = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        sums = live.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not sums.n or sums == before:
            break
        before = sums
        both = live.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        live = checkpointed(small.distinct())
    return live.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("e")).select("e.*").distinct()


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound the bytes of one Arrow batch, so that very long texts never meet in a Python worker by thousands.

    Plans are lazy, so this must hold when they run: it is one bound for all operators, and a session that
    asks for a smaller one keeps it.
    """
    jvm, key = spark.sparkContext._jvm, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))

"""The link graph: edges, resolution, degrees and PageRank."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def click_edges(events: DataFrame, open_kind: str = "click") -> DataFrame:
    """Distinct transitions between consecutive opens of a user, without self-loops."""
    w = Window.partitionBy("user").orderBy("ts", "event_id")
    opens = events.where(F.col("kind") == open_kind).select(F.col("path").alias("dst"), F.lag("path").over(w).alias("src"))
    return opens.where("src is not null and src <> dst").select("src", "dst").distinct()


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """(src, target) to edges: the full path first, then with .md, then by base name (the shortest, then first path).

    Links that resolve to nothing or to their own file are dropped.
    """
    from skerry.functions.text import basename

    path = F.col("path")
    names = files.select(F.explode(F.array(F.struct(path.alias("name"), F.lit(0).alias("level")), F.struct(F.regexp_replace(path, r"\.md$", "").alias("name"), F.lit(1).alias("level")), F.struct(basename(path).alias("name"), F.lit(2).alias("level")))).alias("n"), path.alias("dst"))
    best = names.groupBy("n.name").agg(F.min(F.struct("n.level", F.length("dst").alias("len"), "dst")).alias("b")).select("name", F.col("b.dst").alias("dst"))
    return links.join(best, links["target"] == best["name"]).select("src", "dst").where("src <> dst").distinct()


def unresolved(links: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct link targets that no file answers to."""
    from skerry.functions.text import basename

    path = F.col("path")
    names = files.select(F.explode(F.array(path, F.regexp_replace(path, r"\.md$", ""), basename(path))).alias("target"))
    return links.select("target").distinct().join(names.distinct(), "target", "left_anti")


def backlinks(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("backlinks"))


def stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges, mean and largest number of backlinks over all nodes."""
    nodes = edges.select(F.col("src").alias("path")).union(edges.select(F.col("dst").alias("path"))).distinct()
    degrees = nodes.join(backlinks(edges).withColumnRenamed("dst", "path"), "path", "left").select(F.coalesce("backlinks", F.lit(0)).alias("b"))
    return degrees.agg(F.count("*").alias("nodes"), F.sum("b").alias("edges"), F.round(F.avg("b"), 6).alias("avg_backlinks"), F.max("b").alias("max_backlinks"))


def _shared(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names; only a session on one machine may do without."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "skerry"))


def page_rank(edges: DataFrame, vertices: DataFrame | None = None, damping: float = 0.85, rounds: int = 20, epsilon: float | None = 1e-4, every: int = 5) -> DataFrame:
    """(path, page_rank), divided by the largest. Rank of vertices without out-links isn't handed on.

    Each round is one join on the source and one aggregate with map-side combining; the edges are
    partitioned once. epsilon: stop when the largest change is below it (one small action per round);
    None: always ``rounds`` rounds in one plan, cut every few rounds into the checkpoint folder.
    """
    spark = edges.sparkSession
    _shared(spark)
    if vertices is None:
        vertices = edges.select(F.col("src").alias("path")).union(edges.select(F.col("dst").alias("path"))).distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    links = edges.join(out, "src").checkpoint()
    nodes = vertices.select("path").distinct().checkpoint()
    n = nodes.count()
    if not n:
        return nodes.withColumn("page_rank", F.lit(0.0))
    ranks = nodes.withColumn("r", F.lit(1.0 / n))
    for turn in range(1, rounds + 1):
        given = links.join(ranks.select(F.col("path").alias("src"), "r"), "src").groupBy(F.col("dst").alias("path")).agg(F.sum(F.col("r") / F.col("degree")).alias("g"))
        ranks = ranks.join(given, "path", "left").select("path", F.col("r").alias("was"), ((1 - damping) / n + damping * F.coalesce("g", F.lit(0.0))).alias("r"))
        if epsilon is not None or turn % every == 0:
            ranks = ranks.checkpoint()
        if epsilon is not None and (ranks.agg(F.max(F.abs(F.col("r") - F.col("was"))).alias("d")).first().d or 0.0) < epsilon:
            break
    top = ranks.agg(F.max("r").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).select("path", F.when(F.col("top") > 0, F.col("r") / F.col("top")).otherwise(0.0).alias("page_rank"))  # one row


def top_by_rank(ranks: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    best = ranks.orderBy(F.desc("page_rank"), "path").limit(k)
    return best.join(backlinks(edges).withColumnRenamed("dst", "path"), "path", "left").select("path", "page_rank", F.coalesce("backlinks", F.lit(0)).alias("backlinks"))


def apply_changes(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges after file events (op, path, new_path, links), the last event of each path.

    delete: edges from and to the path go; modify and create: the path's out-edges are replaced; rename:
    the path is called new_path at both ends.
    """
    gone = changes.where("op = 'delete'").select(F.col("path").alias("p"))
    redone = changes.where("op in ('create', 'modify')")
    renamed = changes.where("op = 'rename'").select(F.col("path").alias("p"), F.col("new_path").alias("np"))
    kept = edges.join(gone, edges["src"] == gone["p"], "left_anti").join(gone, edges["dst"] == gone["p"], "left_anti")
    kept = kept.join(redone.select(F.col("path").alias("p")), F.col("src") == F.col("p"), "left_anti")
    fresh = redone.select(F.col("path").alias("src"), F.explode("links").alias("dst")).where("src <> dst")
    whole = kept.select("src", "dst").unionByName(fresh)
    for end in ("src", "dst"):
        whole = whole.join(renamed, F.col(end) == F.col("p"), "left").withColumn(end, F.coalesce("np", end)).drop("p", "np")
    return whole.where("src <> dst").distinct()

"""Semantic retrieval, fusion, re-ranking and clustering of results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import scores
from skerry.session import HybridSettings


def best_chunks(chunks: DataFrame, vector: list[float], key: str = "path", index: str = "chunk_idx") -> DataFrame:
    """The best chunk of each document for a query vector, the lower index among equals. A scan and one aggregate."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    sim = scores.cosine(F.col("embedding"), query)
    best = F.max(F.struct(F.col("sim"), (-F.col(index)).alias("i")))
    return chunks.select(key, index, sim.alias("sim")).groupBy(key).agg(best.alias("b")).select(key, F.col("b.sim").alias("similarity"), (-F.col("b.i")).alias("best_chunk"))


def semantic_top(found: DataFrame, limit: int, threshold: float, key: str = "path") -> DataFrame:
    """At least the threshold; by relevance, similarity, then name. Exact order, without a tolerance for ties."""
    return found.where(F.col("similarity") >= threshold).orderBy(F.desc("relevance"), F.desc("similarity"), key).limit(limit)


def ranked(results: DataFrame, score: str, key: str = "path") -> DataFrame:
    """Position and min-max normalized score. Result lists are bounded by their limits."""
    w = Window.orderBy(F.desc(score), key)
    whole = Window.partitionBy()
    return results.withColumn("rank", F.row_number().over(w)).withColumn("normalized", scores.min_max(F.col(score), F.min(score).over(whole), F.max(score).over(whole)))


def fuse(keyword: DataFrame, semantic: DataFrame, settings: HybridSettings = HybridSettings(), key: str = "path") -> DataFrame:
    """Reciprocal rank fusion as a full outer join of (key, rank, normalized)."""
    k = keyword.select(key, F.col("rank").alias("keyword_rank"), F.col("normalized").alias("keyword_score"))
    s = semantic.select(key, F.col("rank").alias("semantic_rank"), F.col("normalized").alias("semantic_score"))
    both = k.join(s, key, "full_outer")
    fusion = scores.rrf(F.col("keyword_rank"), settings.rrf_k, settings.keyword_weight) + scores.rrf(F.col("semantic_rank"), settings.rrf_k, settings.semantic_weight)
    source = F.when(F.col("keyword_rank").isNotNull() & F.col("semantic_rank").isNotNull(), "both").when(F.col("keyword_rank").isNotNull(), "keyword").otherwise("semantic")
    return both.withColumn("fusion", fusion).withColumn("source", source)


def fusion_order() -> list[Column]:
    return [F.desc("fusion"), F.asc_nulls_last("keyword_rank"), F.asc_nulls_last("semantic_rank")]


def pooled(fused: DataFrame, boost: Column, settings: HybridSettings = HybridSettings()) -> DataFrame:
    """Re-rank the first ``pool`` rows of the fusion order; the others keep their order below, whatever their score."""
    rows = fused.withColumn("fusion_rank", F.row_number().over(Window.orderBy(*fusion_order())))
    inside = (F.col("fusion_rank") <= settings.pool) & F.lit(settings.rerank)
    rows = rows.withColumn("in_pool", inside).withColumn("boost", F.when(inside, boost).otherwise(0.0))
    return rows.withColumn("final", F.when(inside, scores.reranked_final(F.col("fusion"), F.col("boost"))).otherwise(scores.plain_final(F.col("fusion"))))


def pool_order() -> list[Column]:
    return [F.desc("in_pool"), F.desc(F.when(F.col("in_pool"), F.col("final"))), F.asc("fusion_rank")]


def file_similarity(chunks: DataFrame, pairs: DataFrame, key: str = "path") -> DataFrame:
    """Largest similarity of any two chunks for pairs (a, b)."""
    a = chunks.select(F.col(key).alias("a"), F.col("embedding").alias("va"))
    b = chunks.select(F.col(key).alias("b"), F.col("embedding").alias("vb"))
    return pairs.join(a, "a").join(b, "b").groupBy("a", "b").agg(F.max(scores.cosine(F.col("va"), F.col("vb"))).alias("similarity"))


def leader_clusters(results: DataFrame, chunks: DataFrame, threshold: float = 0.85, key: str = "path", rank: str = "rank") -> DataFrame:
    """Greedy leader clusters of one page of results: (key, rank, cluster_id, is_primary, cluster_size).

    A row joins the first earlier cluster whose primary is similar enough. The pairs are those of one
    result page, bounded by its limit; the fold over them runs in one group.
    """
    page = results.select(key, rank)
    left, right = page.select(F.col(key).alias("a"), F.col(rank).alias("ra")), page.select(F.col(key).alias("b"), F.col(rank).alias("rb"))
    near = file_similarity(chunks, left.join(right, F.col("ra") > F.col("rb")).select("a", "b"), key).where(F.col("similarity") >= threshold)
    edges = near.groupBy("a").agg(F.collect_set("b").alias("near")).withColumnRenamed("a", key)
    rows = page.join(edges, key, "left")

    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(pdfs), ignore_index=True).sort_values([rank, key])
        leaders: list = []
        ids = []
        for name, around in zip(whole[key], whole["near"], strict=True):
            known = set(around) if around is not None and not isinstance(around, float) else set()
            hit = next((i for i, x in enumerate(leaders) if x in known), None)
            if hit is None:
                leaders.append(name)
            ids.append(len(leaders) - 1 if hit is None else hit)
        whole["cluster_id"] = ids
        whole["is_primary"] = [leaders[i] == n for i, n in zip(ids, whole[key], strict=True)]
        yield whole[[key, rank, "cluster_id", "is_primary"]]

    kind = dict(page.dtypes)
    folded = rows.coalesce(1).mapInPandas(fold, f"{key} {kind[key]}, {rank} {kind[rank]}, cluster_id int, is_primary boolean")
    return folded.withColumn("cluster_size", F.count("*").over(Window.partitionBy("cluster_id")))


def primaries(results: DataFrame, chunks: DataFrame, enabled: bool, threshold: float = 0.85, key: str = "path", rank: str = "rank") -> DataFrame:
    """Only the clusters' primaries; all rows if clustering is off, there are no vectors, or one result at most."""
    if not enabled or chunks.limit(1).count() == 0 or results.limit(2).count() < 2:
        return results
    lead = leader_clusters(results, chunks, threshold, key, rank).where("is_primary").select(key, "cluster_id", "cluster_size")
    return results.join(lead, key)

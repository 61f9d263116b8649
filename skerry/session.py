"""Session factory and the settings that are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str = "*", partitions: int = 8, name: str = "skerry", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster the submitter's settings hold."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.driver.memory": "8g",
    }
    return builder.config(map=base | conf).getOrCreate()


@dataclass(frozen=True)
class AnalyzerConfig:
    fold_accents: bool = True
    stemming: bool = False
    typo_tolerance: int = 1
    synonyms: tuple[str, ...] = ()
    index_chars: int = 2000

    def needs_rebuild(self, other: AnalyzerConfig) -> bool:
        """Whether a change of settings changes the index."""
        key = lambda c: (c.fold_accents, c.stemming, c.typo_tolerance, tuple(sorted(set(c.synonyms))))
        return key(self) != key(other)


@dataclass(frozen=True)
class ScoreWeights:
    relevance: float = 0.5
    recency: float = 0.2
    frequency: float = 0.15
    link_importance: float = 0.15

    def problems(self) -> list[str]:
        parts = {"relevance": self.relevance, "recency": self.recency, "frequency": self.frequency, "link_importance": self.link_importance}
        out = [f"{k} is not within 0 and 1" for k, v in parts.items() if not 0 <= v <= 1]
        return out + (["weights don't sum to 1"] if abs(sum(parts.values()) - 1) > 0.01 else [])


@dataclass(frozen=True)
class HybridSettings:
    rrf_k: int = 60
    keyword_weight: float = 0.5
    semantic_weight: float = 0.5
    rerank: bool = True
    pool: int = 20
    title: float = 0.25
    recency: float = 0.15
    usage: float = 0.15
    content: float = 0.25
    page_rank: float = 0.2
    proximity: float = 0.15
    max_results: int = 20
    min_score: float = 0.1
    clustering: bool = False
    cluster_threshold: float = 0.85
    semantic_threshold: float = 0.3
    semantic_limit: int = 10

    def rerank_weights(self) -> dict[str, float]:
        parts = {k: getattr(self, k) for k in ("title", "recency", "usage", "content", "page_rank", "proximity")}
        total = sum(parts.values())
        return {k: v / total for k, v in parts.items()} if total > 0 else dict.fromkeys(parts, 1 / 6)


@dataclass(frozen=True)
class Settings:
    weights: ScoreWeights = field(default_factory=ScoreWeights)
    analyzer: AnalyzerConfig = field(default_factory=AnalyzerConfig)
    hybrid: HybridSettings = field(default_factory=HybridSettings)
    half_life_days: float = 7.0
    max_usage: float = 100.0
    max_files: int = 10_000
    max_file_size: int = 512 * 1024
    chunk_size: int = 1000
    suggestion_limit: int = 50
    damping: float = 0.85
    rank_rounds: int = 20
    rank_epsilon: float = 1e-4

"""A facade over index, search, usage and maintenance for one store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import scores
from skerry.operators import graph, index, maintenance, usage
from skerry.plans import hybrid
from skerry.session import AnalyzerConfig, Settings
from skerry.sources.store import Store

NOTES = "id string, path string, title string, tags array<string>, content string, size bigint, last_modified timestamp, frontmatter map<string,array<string>>, content_hash string"
EVENTS = "event_id long, ts timestamp, user string, kind string, path string, query string"


class SearchService:
    """Notes, postings, term counts, events, edges and ranks of one store. Nothing is kept on the driver."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings()):
        self.spark, self.store, self.settings, self.paused = spark, Store(spark, folder), settings, False

    def _notes(self) -> DataFrame:
        rows = self.store.read("notes")
        return rows if rows is not None else self.spark.createDataFrame([], NOTES)

    def _events(self) -> DataFrame:
        rows = self.store.read("events")
        return rows if rows is not None else self.spark.createDataFrame([], EVENTS)

    def _terms(self, notes: DataFrame, sign: int) -> DataFrame:
        each = notes.select(F.explode(F.array_distinct(index.tokenize(F.col("content"), self.settings.analyzer))).alias("term"))
        return each.groupBy("term").agg((F.count("*") * sign).alias("df"))

    def _known(self, ids: DataFrame) -> DataFrame:
        return self._notes().join(ids.select("id"), "id", "left_semi")

    def index(self, notes: DataFrame, progress: Callable[[str], None] = lambda step: None) -> None:
        """Put notes into the store and their postings beside the others; term counts follow by the difference.

        progress is told each step when it is done.
        """
        if self.paused:
            return
        fresh = maintenance.indexable(notes.select(*[c.split()[0] for c in NOTES.split(", ")]), self.settings.max_file_size)
        post = index.postings(fresh, self.settings.analyzer)
        if self.store.read("postings") is None:
            self.store.save_index(post, self._terms(fresh, 1))
        else:
            change = self._terms(fresh, 1).unionByName(self._terms(self._known(fresh), -1))
            self.store.change_index(post, fresh, change.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"))
        progress("index")
        self.store.put("notes", fresh)
        progress("notes")

    def trigger_indexing(self, files: DataFrame, progress: Callable[[str], None] = lambda step: None) -> None:
        """Index what is new or has changed among files."""
        self.index(files.join(self.stale(files).select("id"), "id", "left_semi"), progress)

    def remove(self, ids: DataFrame) -> None:
        """Deletions pass even while indexing is paused."""
        gone = self._known(ids)
        if self.store.read("postings") is not None:
            none = index.postings(self._notes().where(F.lit(False)), self.settings.analyzer)
            self.store.change_index(none, ids, self._terms(gone, -1))
        self.store.delete(ids, ("notes",))

    def rename(self, old: str, new: str, path: str | None = None) -> None:
        """A note's new id, with its content as it is."""
        one = self._notes().where(F.col("id") == old).withColumn("id", F.lit(new)).withColumn("path", F.lit(path or new))
        moved = self.spark.createDataFrame(one.collect(), one.schema)  # one note
        self.remove(self.spark.createDataFrame([(old,)], "id string"))
        self.index(moved)

    def force_save(self) -> None:
        """Fold all batches into one index, as after a rebuild."""
        if (found := self.store.load_index()) is not None:
            self.store.save_index(*found)

    def shutdown(self) -> None:
        self.force_save()
        self.paused = True

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def stale(self, files: DataFrame) -> DataFrame:
        """Files that need indexing, with the reason."""
        known = self._notes().withColumn("indexed_at", F.col("last_modified"))
        return maintenance.needs_indexing(files, known)

    def record(self, rows: list[tuple]) -> None:
        """Events (event_id, ts, user, kind, path, query): opens, searches, modals."""
        fresh = self.spark.createDataFrame(rows, EVENTS)
        self.store.append("events", fresh)

    def recompute_graph(self, edges: DataFrame, at: datetime) -> None:
        s = self.settings
        self.store.save_ranks(graph.page_rank(edges, damping=s.damping, rounds=s.rank_rounds, epsilon=s.rank_epsilon), F.lit(at).cast("timestamp"))

    def signals(self, now: datetime) -> DataFrame:
        at, e = F.lit(now).cast("timestamp"), self._events()
        opened = usage.scored_access(usage.access(e, ("click", "open")), at)
        back = usage.bounce_table(e, usage.bounces(e, per="user"))
        rate = back.select("path", scores.bounce_score(F.col("bounces"), F.col("opens"), F.col("last_bounce"), at).alias("bounce"))
        ranks = self.store.load_ranks(at)
        out = opened.select("path", "usage", "recency", "last_opened").join(rate, "path", "left")
        ranks = ranks.select("path", "page_rank") if ranks is not None else self.spark.createDataFrame([], "path string, page_rank double")
        return out.join(ranks, "path", "full_outer").withColumnRenamed("path", "id")

    def corpus(self, now: datetime, chunks: DataFrame | None = None) -> hybrid.Corpus:
        found = self.store.load_index()
        chunks = chunks if chunks is not None else self.spark.createDataFrame([], "id string, chunk_idx int, embedding array<float>")
        notes = self._notes()
        return hybrid.Corpus(notes, chunks, self.signals(now), *(found or (None, None)), config=self.settings.analyzer)

    def search(self, query: str, now: datetime, vector: list[float] | None = None, chunks: DataFrame | None = None, **kw) -> DataFrame:
        return hybrid.search(self.corpus(now, chunks), query, vector, F.lit(now).cast("timestamp"), self.settings.hybrid, **kw)

    def search_stream(self, query: str, now: datetime, vector: list[float], chunks: DataFrame) -> DataFrame:
        return hybrid.phases(self.corpus(now, chunks), query, vector, F.lit(now).cast("timestamp"), self.settings.hybrid)

    def update_settings(self, analyzer: AnalyzerConfig) -> bool:
        """Take new analyzer settings; whether they made the index be built again."""
        again = self.settings.analyzer.needs_rebuild(analyzer)
        self.settings = replace(self.settings, analyzer=analyzer)
        if again:
            self.rebuild()
        return again

    def rebuild(self) -> None:
        notes = self._notes()
        self.store.save_index(index.postings(notes, self.settings.analyzer), index.document_frequency(notes, "content", self.settings.analyzer))

    def stats(self) -> DataFrame:
        return maintenance.index_stats(self._notes(), F.col("last_modified"))

    def clear(self) -> None:
        self.store.clear(("notes", "postings", "term_df", "changed", "events", "page_rank"))

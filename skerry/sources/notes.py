"""Markdown folders, embedding caches and provider hooks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as T

CACHE_VERSION = "2.0.0"


def read_notes(spark: SparkSession, folder: str, limit: int | None = None, pattern: str = "*.md") -> DataFrame:
    """One row for each markdown file, with what can be said of it from its text and name."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("last_modified"))
    return described(rows.orderBy("path").limit(limit) if limit else rows)


def described(rows: DataFrame) -> DataFrame:
    """(path, content, ...) with title, headings, tags, links, aliases, frontmatter and hash."""
    c = F.col("content")
    block = F.regexp_extract(c, r"\A---\n([\s\S]*?)\n---", 1)
    pairs = F.filter(F.transform(F.split(block, "\n"), lambda x: F.regexp_extract_all(x, F.lit(r"^([\w-]+):\s*(.*)$"), 0)), lambda x: F.size(x) > 0)
    entry = lambda x: F.struct(F.regexp_extract(x[0], r"^([\w-]+):", 1), F.split(F.regexp_replace(F.regexp_replace(x[0], r"^[\w-]+:\s*", ""), r"^\[|\]$|['\"]", ""), r"\s*,\s*"))
    front = F.when(block != "", F.map_from_entries(F.transform(pairs, entry)))
    aliases = F.coalesce(F.try_element_at(front, F.lit("aliases")), F.array().cast("array<string>"))
    title = F.coalesce(F.get(F.try_element_at(front, F.lit("title")), F.lit(0)), T.basename(F.col("path")))
    links = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[\[([^\]|#]+)"), 1), lambda s: F.trim(s)))
    shown = F.regexp_extract_all(c, F.lit(r"\[\[[^\]|]+\|([^\]]+)\]\]"), 1)
    tags = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?:^|\s)(#[\p{L}\p{N}_/-]+)"), 1))
    return rows.select("*", title.alias("title"), T.headings_of(c).alias("headings"), tags.alias("tags"), links.alias("links"), shown.alias("link_texts"), aliases.alias("aliases"), front.alias("frontmatter"), T.content_hash(c).alias("content_hash"))


def list_files(spark: SparkSession, folder: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Files of any kind by their metadata; contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
    for suffix in excluded:
        raw = raw.where(~F.col("path").endswith(suffix))
    return raw


def write_notes(rows: DataFrame, folder: str) -> DataFrame:
    """Create the files of (path, content) that aren't there: (path, created). ``.md`` is appended where it lacks.

    A path that isn't valid creates nothing. Each task writes its own rows; the folder is one that all tasks share.
    """
    schema = pa.schema([("path", pa.string()), ("created", pa.bool_())])
    named = rows.where(T.valid_path(F.col("path"))).select(F.when(F.col("path").endswith(".md"), F.col("path")).otherwise(F.concat("path", F.lit(".md"))).alias("path"), F.coalesce("content", F.lit("")).cast("binary").alias("content"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            made = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = f"{base}/{path}"
                new = files.get_file_info(at).type == fs.FileType.NotFound
                if new:
                    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    with files.open_output_stream(at) as out:
                        out.write(content.as_py())
                made.append(new)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.bool_())], schema=schema)

    return named.mapInArrow(put, "path string, created boolean")


def link_table(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("path").alias("src"), F.explode("links").alias("target"))


def generated(spark: SparkSession, count: int, path: str = "notes", ext: str = "md", name: str = "note {c}", text: str = "text {c}") -> DataFrame:
    """Synthetic files; {c} is the counter."""
    c = F.col("id").cast("string")
    put = lambda s: F.replace(F.lit(s), F.lit("{c}"), c)
    return spark.range(count).select(F.concat(F.lit(path + "/"), put(name), F.lit("." + ext)).alias("path"), put(text).alias("content"))


def write_embeddings(chunks: DataFrame, folder: str, model: str, dimension: int, files: DataFrame | None = None) -> None:
    """Chunk vectors with the cache's version, model and dimension in each row's columns.

    files: (path, last_modified) of those that exist; chunks of others, or of files without a time, are left out.
    """
    if files is not None:
        chunks = chunks.join(files.where("last_modified is not null").select("path"), "path", "left_semi")
    chunks.withColumns({"version": F.lit(CACHE_VERSION), "model": F.lit(model), "dimension": F.lit(dimension)}).write.mode("overwrite").parquet(folder)


def read_embeddings(spark: SparkSession, folder: str, files: DataFrame, dimension: int) -> DataFrame:
    """Rows of the right version and dimension whose file is there and not newer than its entry."""
    rows = spark.read.parquet(folder).where((F.col("version") == CACHE_VERSION) & (F.size("embedding") == dimension))
    live = files.select("path", F.col("last_modified").alias("file_time"))
    return rows.join(live, "path").where(F.col("file_time") <= F.col("last_modified")).drop("file_time", "version", "model", "dimension")


def with_retries(call: Callable, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> Callable:
    """A provider's function that is tried so many times, 2, 4, ... seconds apart; the last error is raised."""

    def run(*args):
        for n in range(1, attempts + 1):
            try:
                return call(*args)
            except Exception:
                if n == attempts:
                    raise
                wait(2.0**n)

    return run


def model_is_there(models: Callable[[], list[str]], name: str) -> bool:
    """The connection probe: a provider's list of models holds the configured one; a failing provider has none."""
    try:
        return any(m == name or m.split(":")[0] == name for m in models())
    except Exception:
        return False


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], attempts: int = 3) -> DataFrame:
    """Chunks with vectors from a provider, batch by batch. The provider is any function of a list of texts."""

    def run(pdfs: Iterator) -> Iterator:
        for pdf in pdfs:
            yield pdf.assign(embedding=with_retries(embed, attempts)(pdf["text"].tolist()))

    return chunks.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in chunks.dtypes) + ", embedding array<float>")


def recent_paths(events: DataFrame, k: int = 10) -> DataFrame:
    return events.groupBy("path").agg(F.max("ts").alias("last_opened")).orderBy(F.desc("last_opened"), "path").limit(k)

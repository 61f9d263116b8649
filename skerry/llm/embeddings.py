"""Operator 10: near-duplicate vectors by spherical-cap filters.

Directions are a structured random code: vectors are turned by a random rotation, cut in two blocks,
and a filter is a pair of code vectors, one for each block, so ``m * m`` directions cost ``2 * m``
products. Directions of one code are alike, so how many caps hold a vector varies much; ``CODES`` codes of
their own rotations share the work evenly. Each vector is list-decoded to all directions whose cap it lies in (Becker, Ducas, Gama and
Laarhoven, 2016); with none it keeps its nearest direction. Vectors meet in their filters and are
verified by cosine in double precision.

The number of directions follows the number of vectors (``PER_FILTER`` of them for each direction), and
the cap follows from it: two vectors at the threshold share ``MEETINGS`` filters on average, more when
they are closer. What is found is exact, what is missed is a pair without a common filter; the tests
hold recall against brute force.

Equal vectors are one class beforehand, told apart by a 128-bit digest of their bytes: copies count as
links without being compared. A filter that holds very many vectors is dealt out to pairs of blocks of
about ``BLOCK`` vectors, so no task gets a whole hot filter and none is cut short; a pair of blocks is a
product of a few dozen MB. A pair that meets in several filters counts in the first one only, so each row
takes along the filters before the one that it goes to. Links are summed to counts and local stars; no
list of all pairs is made.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with
nothing and are their own component; vectors of different lengths don't link, whatever lengths there are;
an empty table gives no rows; repeated ids are rows of their own, with the same or other vectors; a null id
takes part, and a component of such rows alone has a null id, of which every row is kept; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, checkpointed, connected_components, local_roots, sized, small_arrow_batches
from skerry.sources.tables import read_table

THRESHOLD, PER_FILTER, MEETINGS, CODES, BLOCK, SEED = 0.9, 8, 16.0, 6, 1024, 20240101


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def both_tails(z: float, rho: float) -> float:
    """P(y > z | x > z) for normal x and y of correlation rho."""
    x = np.linspace(z, z + 8, 4001)
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    inner = np.array([upper_tail((z - rho * t) / math.sqrt(1 - rho * rho)) for t in x])
    return float(np.trapezoid(density * inner, x) / upper_tail(z))


@dataclass(frozen=True)
class CapFilters:
    """The directions for vectors of one length, and the cap's height."""

    rotation: np.ndarray
    left: np.ndarray
    right: np.ndarray
    height: float

    @staticmethod
    def make(dim: int, vectors: int, threshold: float = THRESHOLD, meetings: float = MEETINGS, per_filter: int = PER_FILTER, seed: int = SEED) -> CapFilters:
        m = max(4, math.ceil(math.sqrt(vectors / per_filter)))
        lo, hi = -1.0, 8.0
        for _ in range(60):  # the cap at which a pair at the threshold is expected to share so many filters
            z = (lo + hi) / 2
            lo, hi = (z, hi) if m * m * upper_tail(z) * both_tails(z, threshold) > meetings else (lo, z)
        rng = np.random.default_rng(seed + dim)
        rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        half = max(1, dim // 2)
        code = lambda n: (c := rng.standard_normal((m, n))) / np.linalg.norm(c, axis=1, keepdims=True)
        left, right = code(half), code(dim - half) if dim > half else np.zeros((m, 0))
        return CapFilters(rotation, left, right, lo / math.sqrt(half))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter numbers of all unit vectors, and whose they are: in order of vectors, then numbers."""
        turned = unit @ self.rotation
        half, m, n = self.left.shape[1], len(self.left), len(unit)
        a, b = turned[:, :half] @ self.left.T, turned[:, half:] @ self.right.T
        order = np.argsort(-b, axis=1, kind="stable")
        falling = np.take_along_axis(b, order, axis=1)
        vec, row = np.nonzero(a + falling[:, :1] >= self.height)
        # One search for all: products lie within -1 and 1, so vectors are 4 apart.
        line = (np.arange(n)[:, None] * 4.0 - falling).ravel()
        count = np.searchsorted(line, vec * 4.0 + a[vec, row] - self.height, "right") - vec * m
        count = np.maximum(count, 1)
        whose, filters = np.repeat(vec, count), np.repeat(row * m, count)
        filters = filters + order[whose, np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)]
        lost = np.setdiff1d(np.arange(n), vec)  # without any: the nearest direction
        whose, filters = np.concatenate((whose, lost)), np.concatenate((filters, a[lost].argmax(axis=1) * m + order[lost, 0]))
        by = np.lexsort((filters, whose))
        return filters[by], whose[by]


@lru_cache(maxsize=64)
def codes_for(dim: int, vectors: int, threshold: float, meetings: float, per_filter: int) -> list[CapFilters]:
    """The same in every task, for they are made from seeds."""
    return [CapFilters.make(dim, vectors, threshold, meetings / CODES, per_filter, SEED + k * 1_000_003) for k in range(CODES)]


def decode_all(codes: list[CapFilters], unit: np.ndarray) -> list[np.ndarray]:
    """Sorted filter numbers over several codes, which follow each other."""
    parts = [c.decode(unit) for c in codes]
    size = len(codes[0].left) ** 2
    filters, whose = np.concatenate([f + k * size for k, (f, _) in enumerate(parts)]), np.concatenate([w for _, w in parts])
    by = np.argsort(whose, kind="stable")
    return np.split(filters[by], np.searchsorted(whose[by], np.arange(1, len(unit)))) if len(unit) else []


def matrix(column: pa.ListArray) -> np.ndarray:
    """A column of vectors of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(ids: np.ndarray, sizes: np.ndarray, unit: np.ndarray, lists: list[np.ndarray], side: np.ndarray, here: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with links in one filter or pair of its blocks: id, linked vectors not counted elsewhere, local root."""
    if not len(side) > 1 or not same and (side == side[0]).all():
        return ids[:0], sizes[:0], ids[:0]
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    if not same:  # pairs within a block belong to that block's own comparison
        near &= side[:, None] != side[None, :]
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return ids[:0], sizes[:0], ids[:0]
    near = near[np.ix_(rows, rows)]
    earlier = [lists[r][lists[r] < here] for r in rows]
    known = np.unique(np.concatenate(earlier))
    first = near
    if len(known):
        member = np.zeros((len(rows), len(known)), np.float32)
        for i, e in enumerate(earlier):
            member[i, np.searchsorted(known, e)] = 1
        first = near & (member @ member.T < 0.5)
    return ids[rows], first @ sizes[rows], local_roots(near, ids[rows])


def valid(vector) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def digests(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, key``: the key is null for what links with nothing. Vectors become doubles or stay floats."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32() if kind == "float" else pa.float64())), ("key", pa.binary())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.blake2b(x.values.to_numpy(zero_copy_only=False).tobytes(), digest_size=16).digest() if ok else None for x, ok in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(schema.field(1).type), pa.array(keys, pa.binary())], schema=schema)

    return vectors.select(F.col("vec_id").cast("long"), v, valid(v)).mapInArrow(digest, f"vec_id long, embedding array<{kind}>, key binary")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, meetings: float = MEETINGS, per_filter: int = PER_FILTER, block: int = BLOCK) -> DataFrame:
    """``vec_id, embedding`` to ``vec_id, n_links, component_id``."""
    spark = vectors.sparkSession
    small_arrow_batches(spark)
    scratch = Scratch(spark, "embeddings")
    keyed = digests(vectors)
    keys = scratch.table(keyed.drop("embedding"), "keys")
    # vec_id may repeat, so classes are told apart by their vectors alone.
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("d", F.size("embedding")), "classes")
    counts = classes.groupBy("d").agg(F.count("*").alias("vectors"))
    schema = pa.schema([("cls", pa.int64()), ("d", pa.int32()), ("filters", pa.list_(pa.int64()))])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for d in np.unique(sizes):
                own = batch.filter(pa.array(sizes == d))
                codes = codes_for(int(d), own.column(3)[0].as_py(), threshold, meetings, per_filter)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(decode_all(codes, unit_rows(matrix(own.column(2)))), pa.list_(pa.int64()))], schema=schema)

    # As many rows as there are lengths; joined by split partitions if that is very many.
    counts = scratch.table(counts, "lengths")
    decoded = classes.join(sized(counts, counts.count()), "d").select("cls", "d", "embedding", "vectors")
    decoded = scratch.table(decoded.mapInArrow(decode, "cls long, d int, filters array<long>"), "filters")
    each = decoded.select("cls", "d", F.posexplode("filters").alias("at", "f"))
    held = scratch.table(each.groupBy("d", "f").agg(F.count("*").alias("n")).where("n > 1"), "held")
    blocks = F.ceil(F.col("n") / block).cast("int")
    # Numbers are dealt out first; only what goes to a filter that holds others gets its vector.
    dealt = each.join(held, ["d", "f"]).withColumn("side", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("d", "f", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "cls", "side", "at")
    payload = classes.select("cls", "size", "embedding").join(decoded.select("cls", "filters"), "cls")
    dealt = dealt.join(payload, "cls").select("d", "f", "i", "j", "cls", "size", "side", F.slice("filters", F.lit(1), F.col("at")).alias("filters"), "embedding")
    found = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their filter and pair of blocks; those of one may go on in the next batch."""
        held_key, kept = None, []

        def closed() -> tuple[np.ndarray, ...]:
            cls, size, side, unit = (np.concatenate([k[i] for k in kept]) for i in range(4))
            lists = [x for k in kept for x in k[4]]
            return compare(cls, size, unit, lists, side, held_key[1], threshold, held_key[2] == held_key[3])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])
            cls, size, side = (batch.column(c).to_numpy() for c in ("cls", "size", "side"))
            ends, values = batch.column("filters").offsets.to_numpy(), batch.column("filters").values.to_numpy()
            lists = [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            out: list[tuple[np.ndarray, ...]] = []
            at, unit = 0, np.empty((0, 0))
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                key = tuple(int(x) for x in keys[:, a])
                if a >= at + len(unit):  # the units of all rows of this length
                    at, many = a, int(np.searchsorted(keys[0, a:], keys[0, a], "right"))
                    unit = unit_rows(matrix(batch.column("embedding").slice(a, many)))
                if key != held_key and kept:
                    if sum(len(k[0]) for k in kept) > 1:
                        out.append(closed())
                    kept = []
                held_key = key
                kept.append((cls[a:b], size[a:b], side[a:b], unit[a - at : b - at], lists[a:b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], schema=found)
        if sum(len(k[0]) for k in kept) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in closed()], schema=found)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = dealt.repartition(n, "d", "f", "i", "j").sortWithinPartitions("d", "f", "i", "j").mapInArrow(verify, "cls long, links long, root long")
    pairs = scratch.table(pairs, "pairs")
    links = pairs.groupBy("cls").agg(F.sum("links").alias("links"))
    components = connected_components(pairs.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.select("cls", "key", "size", "rep").join(links, "cls", "left").join(components.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.withColumn("component", F.coalesce("component", "cls"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = keys.join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = checkpointed(out)
    scratch.drop()
    return out


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Operator 8: near-duplicate documents by an inverted join of MinHash coordinates.

Every document is posted under each (coordinate, value) of its signature. Two documents are candidates
with at least ``matches`` common postings of ``coordinates``. The join that counts them is cut short as
in prefix and skip merging: postings are ordered by rarity; a posting of one document can't match; a
document with fewer than ``matches`` others can't either; and of the rest only its rarest ones, all but
``matches - 1``, need be joined, since a pair with enough matches shares one of those. Candidates are
confirmed on the full shingle sets, as sets of 64-bit hashes of whole shingles.

At a similarity of 0.8, 48 coordinates and 22 matches miss a linked pair with a probability below one in
a million, less for closer ones.

Texts with equal sets are one class beforehand, so copies cost a row each. What is asked for is
components, so a list of postings needs no pairs among documents known to be connected:

1. Each class is held against the head that most of its lists name, and what links is connected.
2. A list that still has members of several components names a zone, that of its largest one. The
   others in it are held against that component's members in such lists and against each other.

Postings are kept apart by the sizes of their sets too, in steps that two linked sets can't be further
apart than one of. Zones are dealt into blocks of at most ``BLOCK`` classes, and pairs of blocks are
compared as wholes: first their signatures, which counts the collisions of all 48 coordinates; then, for
the classes that some other one matches often enough, their shingle sets, as a product of incidences. A
class so goes to as many tasks as there are blocks on the other side, not pairs, and no task ever holds
a whole zone. Nothing is capped.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; a text of fewer
words than a shingle is one shingle; equal texts are linked; rows that repeat a doc_id are rows of their
own; a null doc_id takes part, and a component of such rows alone has a null id; an empty table gives no
rows; other columns are ignored by the query and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, checkpointed, connected_components, local_roots, small_arrow_batches, without_rows
from skerry.llm.shingles import U, mix, shingle_set
from skerry.sources.tables import read_table

COORDINATES, MATCHES, BLOCK = 48, 22, 256


def signature(shingles: np.ndarray, coordinates: int = COORDINATES, seed: int = 7) -> np.ndarray:
    """The least of each of so many 32-bit hashes of the set."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * U(2) + U(1)
    b = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64)
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 2048):
        x = shingles[i : i + 2048]
        out = np.minimum(out, (((x[:, None] ^ b) * a) >> U(32)).astype(np.uint32).min(axis=0))
    return out


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    one, two = mix(shingles ^ U(0x5851F42D4C957F2D)), mix(shingles ^ U(0x14057B7EF767814F))
    return int(one.sum(dtype=U).view(np.int64)), int(two.sum(dtype=U).view(np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    key, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return docs.select(key.alias("doc_id"), F.xxhash64(text).alias("text_key"), F.xxhash64(key, text).alias("row_key"), text.alias("text"))


def signatures(docs: DataFrame, k: int, coordinates: int) -> DataFrame:
    """``doc_id, text_key, row_key, n, k1, k2, sig`` of every row; row_key and text_key tell a row's text and id."""
    small_arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.list_(pa.int32()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for text in batch.column(3):
                s = shingle_set(text.as_py(), k)
                one, two = set_key(s)
                n.append(len(s))
                k1.append(one)
                k2.append(two)
                sig.append(signature(s, coordinates).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in ((n, pa.int64()), (k1, pa.int64()), (k2, pa.int64()), (sig, pa.list_(pa.int32()))))], schema=schema)

    return keyed(docs).mapInArrow(sign, "doc_id long, text_key long, row_key long, n long, k1 long, k2 long, sig array<int>")


def prefixes(classes: DataFrame, percent: int, matches: int) -> DataFrame:
    """``cls, key``: the rarest postings of each class that can have enough matches.

    Sets of which one has 100 / percent times the other's size at most lie in one step of sizes or in
    neighbouring ones, so each class posts for its own step and the next, and any linked pair has a step
    in common. Each step is a collection of its own, with its own counts.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9) if percent < 100 else F.col("n")
    stepped = classes.select("cls", "sig", F.explode(F.array(step, step + 1)).alias("step"))
    postings = stepped.select("cls", "step", F.posexplode("sig").alias("pos", "val")).select("cls", "step", F.xxhash64("pos", "val", "step").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    met = postings.join(shared, "key").groupBy("cls", "step").agg(F.collect_list(F.struct("df", "key")).alias("p")).where(F.size("p") >= matches)
    rarest = F.slice(F.sort_array("p"), F.lit(1), F.size("p") - (matches - 1))
    return met.select("cls", F.explode(F.transform(rarest, lambda x: x["key"])).alias("key"))


def linked_rows(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets reach the similarity, as a symmetric matrix without the diagonal."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    both = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, len(values), 8192):  # incidence a stretch of values at a time
        own = (inverse >= at) & (inverse < at + 8192)
        part = np.zeros((len(sets), min(8192, len(values) - at)), np.float32)
        part[row[own], inverse[own] - at] = 1
        both += np.rint(part @ part.T).astype(np.int64)
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(near, False)
    return near


def matching_rows(sigs: np.ndarray, sizes: np.ndarray, percent: int, matches: int) -> np.ndarray:
    """Which pairs have enough equal coordinates, and sizes that a link allows."""
    count = np.zeros((len(sigs), len(sigs)), np.int16)
    for c in range(sigs.shape[1]):
        count += sigs[:, c][:, None] == sigs[:, c][None, :]
    short, long = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    return (count >= matches) & (100 * short >= percent * long)


def compared(zones: DataFrame, payload: DataFrame, judge, output: str, among: bool, block: int = BLOCK, on: tuple[str, ...] = ("cls",)) -> DataFrame:
    """Blocks of zones of (zone, cls, component, large), with the payload of each class: large rows meet the
    others, and with ``among`` the others each other, but not within a component. judge gets the rows of a
    pair of blocks and which pairs count, and gives a batch or nothing. on: what the payload is found by."""
    side = zones.withColumn("salt", F.xxhash64("cls"))
    blocks = lambda c: F.ceil(F.sum(c.cast("long")) / block).cast("int")
    sizes = zones.groupBy("zone").agg(blocks(F.col("large")).alias("nl"), blocks(~F.col("large")).alias("ns"), (F.sum((~F.col("large")).cast("long")) > 1).alias("several")).where("ns > 0" if among else "ns > 0 and nl > 0")
    # Written, so that the join's two sides are dealt out alike and a large zone can be split.
    rows = side.join(checkpointed(sizes), "zone").withColumn("at", F.pmod("salt", F.when(F.col("large"), F.col("nl")).otherwise(F.col("ns"))).cast("int"))
    count = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    as_large = F.transform(count("ns"), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("at").alias("j")))
    as_small = F.transform(count("nl"), lambda j: F.struct(F.lit(0).alias("kind"), F.col("at").alias("i"), j.alias("j")))
    if among:  # needless where there is one other
        again = F.transform(F.when(F.col("several"), count("ns")).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit(1).alias("kind"), F.least(F.col("at"), i).alias("i"), F.greatest(F.col("at"), i).alias("j")))
        as_small = F.concat(as_small, again)
    found = [*on, *(c for c in ("cls",) if c not in on)]
    dealt = rows.select("zone", *found, "component", "large", F.inline(F.when(F.col("large"), as_large).otherwise(as_small)))
    n = int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = dealt.join(payload, list(on)).select("zone", "kind", "i", "j", "cls", "component", "large", *[c for c in payload.columns if c not in on])
    full = full.repartition(n, "zone", "kind", "i", "j").sortWithinPartitions("zone", "kind", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = None, []

        def closed() -> pa.RecordBatch | None:
            rows = pa.Table.from_batches(kept)
            comp, large = np.asarray(rows.column("component")), np.asarray(rows.column("large"))
            if (comp == comp[0]).all():
                return None
            counts = comp[:, None] != comp[None, :]
            return judge(rows, counts if held[1] else counts & (large[:, None] != large[None, :]))

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                key = tuple(int(x) for x in keys[:, a])
                if key != held and kept:
                    if (out := closed()) is not None:
                        yield out
                    kept = []
                held = key
                kept.append(batch.slice(a, b - a))
        if kept and (out := closed()) is not None:
            yield out

    return full.mapInArrow(compare, output)


def confirmed(zones: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int, matches: int, among: bool, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) in zones: first by collisions of whole signatures, then by whole sets."""
    flags, links = pa.schema([("zone", pa.int64()), ("cls", pa.int64())]), pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def by_signature(rows: pa.Table, counts: np.ndarray) -> pa.RecordBatch | None:
        sigs = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        hit = np.flatnonzero((matching_rows(sigs, np.asarray(rows.column("n")), percent, matches) & counts).any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(rows.column(c))[hit]) for c in ("zone", "cls")], schema=flags) if len(hit) else None

    def by_set(rows: pa.Table, counts: np.ndarray) -> pa.RecordBatch | None:
        ids = np.asarray(rows.column("cls"))
        root = local_roots(linked_rows([shingle_set(t.as_py(), k) for t in rows.column("text")], percent) & counts, ids)
        own = np.flatnonzero(root != ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(root[own])], schema=links) if len(own) else None

    near = compared(zones, classes.select("cls", "n", "sig"), by_signature, "zone long, cls long", among).distinct()
    left = zones.join(near, ["zone", "cls"], "left_semi").join(classes.select("cls", "rep.row_key", "rep.text_key"), "cls")
    left = scratch.table(left, f"{name}-near")
    return scratch.table(compared(left, texts, by_set, "a long, b long", among, on=("row_key", "text_key")), f"{name}-links")


def head_zones(lists: DataFrame) -> DataFrame:
    """Each class with the head (smallest class) that most of its lists have, and the heads themselves."""
    heads = lists.groupBy("key").agg(F.min("cls").alias("head"))
    met = lists.join(heads, "key").where("cls <> head").groupBy("cls", "head").agg(F.count("*").alias("c"))
    best = met.groupBy("cls").agg(F.max(F.struct("c", (-F.col("head")).alias("h"))).alias("m")).select((-F.col("m.h")).alias("zone"), "cls")
    own = best.select("zone", F.col("zone").alias("cls")).distinct()
    rows = best.withColumn("large", F.lit(False)).union(own.withColumn("large", F.lit(True)))
    return rows.select("zone", "cls", F.col("cls").alias("component"), "large")


def mixed_zones(lists: DataFrame, components: DataFrame) -> DataFrame:
    """Members of lists that hold several components: the zone is the one with most members there."""
    named = lists.select("key", "cls").join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    shares = named.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component")).alias("top")).where("parts > 1").select("key", F.col("top.component").alias("zone"))
    return named.join(mixed, "key").select("zone", "cls", "component", (F.col("component") == F.col("zone")).alias("large")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """``doc_id, text`` to ``doc_id, text_key, n_shingles, component_id``, one row for each row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.table(signatures(docs, k, coordinates), "signed")
    classes = signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key", "row_key")).alias("rep"), F.first("sig").alias("sig"))
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    posted = scratch.table(prefixes(classes, percent, matches), "posted")
    crowded = posted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    lists = scratch.table(posted.join(crowded.select("key"), "key"), "lists")
    wanted = classes.join(lists.select("cls").distinct(), "cls", "left_semi").select("rep.row_key", "rep.text_key")
    # What is wanted grows with the documents, so it isn't broadcast at any size. A row that stands many times is one text.
    texts = keyed(docs).select("row_key", "text_key", "text").join(wanted.hint("merge"), ["row_key", "text_key"]).dropDuplicates(["row_key", "text_key"])
    texts = scratch.bucketed(texts, "texts", "row_key", "text_key")
    zones = scratch.table(head_zones(lists), "heads")
    stars = confirmed(zones, classes, texts, k, percent, matches, False, scratch, "star")
    components = connected_components(stars)
    zones = scratch.table(mixed_zones(lists, components), "zones")
    more = confirmed(zones, classes, texts, k, percent, matches, True, scratch, "rest")
    # The old stars and the new links say all that is connected.
    components = connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = classes.select("cls", "k1", "k2", "n", "rep").join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = named.groupBy("component").agg(F.min("rep.doc_id").alias("component_id"))
    named = named.join(lowest, "component").select("k1", "k2", "n", "component_id", F.lit(True).alias("known"))
    out = signed.join(named, ["k1", "k2", "n"], "left")
    own = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    out = checkpointed(out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), own.alias("component_id")))
    scratch.drop()
    return out


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns."""
    return without_rows(docs, near_duplicates(docs, k, percent).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, as this query's contract has it."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"), k=2)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

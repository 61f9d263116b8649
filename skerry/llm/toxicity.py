"""Operator 1: a toxicity classifier that identity terms alone don't move.

A document's features are the distinct words in it, hashed. The model is a logistic regression whose
features are scaled by their log-count ratio between the classes (Wang and Manning, 2012), with a
counterfactual term (Garg et al., 2019): in every sentence of the sample that names a group, the name is
swapped for that of another group of its kind, and the squared change of the logit is penalised. A name
that only happens to stand in toxic sentences so shares its weight with names that don't, and neutral
mentions stay clean.

It is fitted on the driver from a bounded sample: at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows,
those with the smallest hashes of their keys, and of these the first whose words come to ``MAX_WORDS``
together; they are weighted back to the proportions among all labels. All swaps of the sample count; there
are only so many different ones, so a document's are kept as counts. Scoring reads every whole text.

Defined cases: a null or empty text, or one of unknown words, gets the score of the model's bias; repeated
rows repeat their scores; of rows that share a labelled key one is learnt from; an empty table gives none;
without labels of both classes every score is (toxic + 1/2) / (labels + 3/2), which is one third without any;
conflicting labels of a document count as toxic; a doc_id is a whole number or can be cast to one; other
columns, whatever their names, are ignored by the query and kept by ``keep_clean``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import document_columns, small_arrow_batches
from skerry.sources.tables import read_table

BUCKETS, MAX_TOXIC, MAX_CLEAN, MAX_WORDS, FOLDS = 1 << 18, 4000, 8000, 20_000_000, 5
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")

#: Names of groups by kind; a name is swapped for another of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslimisch", "christlich", "jüdisch", "musulman", "chrétien", "juif", "cristiano", "judío"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "schwarz", "weiß", "noir", "blanc", "negro", "blanco"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "schwul", "lesbisch", "homosexuel", "homosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "einwanderer", "flüchtlinge", "ausländer", "immigrés", "réfugiés", "étrangers", "inmigrantes", "refugiados", "extranjeros"),
    ("disabled", "blind", "deaf", "elderly", "young", "behindert", "handicapé", "discapacitado"),
)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & (BUCKETS - 1)


def features(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swaps(text: str, terms: dict[str, tuple[str, ...]]) -> Counter[tuple[int, int]]:
    """For all sentences that name a group: the bucket that a swap takes away and the one that it adds, counted."""
    out: Counter[tuple[int, int]] = Counter()
    low = text.lower()
    if not terms.keys() & set(WORD.findall(low)):
        return out
    for sentence in SENTENCE.split(low):
        words = set(WORD.findall(sentence))
        for w in words & terms.keys():
            for other in terms[w]:
                if other not in words:
                    out[bucket(w), bucket(other)] += 1
    return out


def swap_table() -> dict[str, tuple[str, ...]]:
    return {w: tuple(x for x in kind if x != w) for kind in IDENTITY_TERMS for w in kind}


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        w, known, out = self.weights, {}, np.empty(len(texts))
        for i, text in enumerate(texts):
            total = self.bias
            for word in features(text):
                x = known.get(word)
                if x is None:
                    if len(known) > 200_000:
                        known = {}
                    x = known[word] = float(w[bucket(word)])
                total += x
            out[i] = total
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, pairs: list[tuple[int, int, int]], ridge: float = 0.3, counterfactual: float = 4.0, steps: int = 250, smooth: float = 1.0) -> Model:
    """rows: distinct buckets of each document; pairs: what each swap takes away and adds, and how often."""
    total, ones = float(weight.sum()), float((weight * toxic).sum())
    prior = ones / total if total else 0.0
    if not 0 < prior < 1:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((ones + 0.5) / (total - ones + 1))))
    seen = np.bincount(np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64), minlength=BUCKETS)
    rows = [r[seen[r] >= 3] for r in rows]  # rarer ones have no ratio, so no weight
    lens = np.array([len(r) for r in rows])
    idx = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), lens)
    used, idx = np.unique(idx, return_inverse=True)
    n = len(used)
    count = lambda v: np.bincount(idx, v[row], n)
    p, q = count(weight * toxic) + smooth, count(weight * (1 - toxic)) + smooth
    ratio = np.log(p / (weight * toxic).sum()) - np.log(q / (weight * (1 - toxic)).sum())
    place = {int(b): i for i, b in enumerate(used)}
    gone = np.array([(place.get(a, -1), place.get(b, -1)) for a, b, _ in pairs], np.int64).reshape(-1, 2)
    times = np.array([c for _, _, c in pairs], float)
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    padded = lambda w: np.append(w * ratio, 0.0)
    for t in range(1, steps + 1):
        z = np.bincount(row, (w * ratio)[idx], len(rows)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / total
        dw = count(g) * ratio + ridge * w / total
        if len(gone):
            change = padded(w)[gone[:, 0]] - padded(w)[gone[:, 1]]
            d = 2 * counterfactual * change * times / times.sum()
            at = np.bincount(gone[:, 0][gone[:, 0] >= 0], d[gone[:, 0] >= 0], n) - np.bincount(gone[:, 1][gone[:, 1] >= 0], d[gone[:, 1] >= 0], n)
            dw += at * ratio
        db = float(g.sum())
        m, v = 0.9 * m + 0.1 * dw, 0.99 * v + 0.01 * dw * dw
        mb, vb = 0.9 * mb + 0.1 * db, 0.99 * vb + 0.01 * db * db
        rate = 0.05 * (1 - 0.9 * t / steps)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w * ratio
    return Model(weights, b)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)) == 0


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_words: int = MAX_WORDS) -> Model:
    """Fit on labelled rows outside the held-out fold; ``docs`` has doc_id and text, ``labels`` doc_id and toxic."""
    small_arrow_batches(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("toxic")).where(~held_out())
    order = known.withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id"))
    # Both samples are bounded by parameters, so is what is broadcast and collected.
    some = order.where("toxic = 1").orderBy("h", "doc_id").limit(max_toxic).union(order.where("toxic = 0").orderBy("h", "doc_id").limit(max_clean)).select("doc_id", "toxic", "h")
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    terms = swap_table()
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("h", pa.int64()), ("words", pa.int64()), ("buckets", pa.binary()), ("swaps", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, changed = [], []
            for text in batch.column(1).to_pylist():
                found.append(np.array(sorted({bucket(w) for w in features(text)}), "<i4"))
                changed.append(np.array([(a, b, n) for (a, b), n in sorted(swaps(text, terms).items())], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(map(len, found), pa.int64()), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(changed, pa.binary())], schema=schema)

    rows = document_columns(docs).join(F.broadcast(some), "doc_id").mapInArrow(extract, "doc_id long, toxic int, h long, words long, buckets binary, swaps binary")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("h", "words", "buckets", "swaps", "toxic")).alias("r")).select("doc_id", "r.*")
    # The sample's size is bounded, so this window is too.
    so_far = F.sum("words").over(Window.orderBy("h", "doc_id"))
    got = sorted(one.withColumn("so_far", so_far).where(F.col("so_far") <= max_words).drop("so_far").collect(), key=lambda r: r.doc_id)
    toxic = np.array([r.toxic for r in got], float)
    each = {k: sizes.get(k, 0) / max(1, int((toxic == k).sum())) for k in (0, 1)}
    weight = np.array([each[int(t)] for t in toxic]) if len(got) else np.empty(0)
    pairs: Counter[tuple[int, int]] = Counter()
    for r in got:
        for a, b, n in np.frombuffer(r.swaps, "<i4").reshape(-1, 3).tolist():
            pairs[a, b] += n
    return fit([np.frombuffer(r.buckets, "<i4") for r in got], toxic, weight, [(a, b, n) for (a, b), n in sorted(pairs.items())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text."""
    small_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the corpus
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()), pa.float64())], schema=schema)

    return document_columns(docs).mapInArrow(judge, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    small_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores([t or "" for t in batch.column(at).to_pylist()]) < threshold))

    return docs.mapInArrow(judge, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

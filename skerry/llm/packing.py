"""Operator 7: mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' ids. A window (sequence) takes from each queue what its share
of the window comes to; what can't be served in whole ids is a deficit that the queue carries to the
next window. The schedule follows from the queues' totals alone: within a phase, in which no queue runs
dry, it repeats after ``cycle`` windows, so a table of one cycle tells for any place in any queue which
window and which offset it goes to. When a queue runs dry, one window is filled by the others, and a new
phase begins with the shares of those left. There are at most twice as many phases as queues. Tasks then
cut their own documents by the table, without a shuffle, so windows cross partitions freely and only the
last one can be short.

More than ``fan`` sources are scheduled in two levels: the smaller ones are dealt into queues that are
packed from their members' queues by the same rule, and that have the sum of their members' shares. What
the tasks get is a number for each source; each one makes the tables that its own documents need.

The number of sources that keep queues of their own is bounded by ``max_queues`` (65,536), for their names
and totals go to the driver. Of more, those that ``shares`` names keep theirs and the others share the
rest by their hashes, again with the sum of their shares; which queue a document is in never changes the
``source`` that its pieces tell.

Defined cases: a null text is empty and packs its end id; null sources form one queue; repeated rows
are packed each for itself; an empty table packs nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, small_arrow_batches
from skerry.llm.tokens import encoder
from skerry.sources.tables import read_table

WINDOW, CYCLE, FAN, MAX_QUEUES = 1024, 64, 256, 1 << 16
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


@dataclass
class Phase:
    """Windows first .. first + windows - 1. alloc: ids by window of the cycle and queue; start: what each queue has given before."""

    first: int
    windows: int
    start: np.ndarray
    alloc: np.ndarray


def largest_remainder(weights: list[int], total: int) -> list[int]:
    """Whole shares of total in proportion to the weights."""
    whole = sum(weights)
    out = [w * total // whole for w in weights]
    for i in sorted(range(len(weights)), key=lambda i: (-(weights[i] * total % whole), i))[: total - sum(out)]:
        out[i] += 1
    return out


def round_robin(weights: list[int], window: int, cycle: int) -> np.ndarray:
    """Ids that each queue gives in each window of a cycle; deficits are kept in 1/cycle ids and end at 0."""
    quota = np.array(largest_remainder(weights, window * cycle), np.int64)
    deficit, out = np.zeros(len(weights), np.int64), np.zeros((cycle, len(weights)), np.int64)
    for k in range(cycle - 1):
        deficit += quota
        give = np.maximum(deficit // cycle, 0)
        left = np.where(deficit > 0, deficit - give * cycle, -1)
        give[np.argsort(-left, kind="stable")[: window - int(give.sum())]] += 1
        deficit -= give * cycle
        out[k] = give
    out[-1] = quota - out[:-1].sum(0)
    return out


def schedule(totals: list[int], shares: list[int] | None = None, window: int = WINDOW, cycle: int = CYCLE) -> list[Phase]:
    """Phases that use up all queues. shares: target proportions; in proportion to the totals unless given."""
    left, shares = np.array(totals, np.int64), [int(s) for s in (shares or totals)]
    phases, first = [], 0
    while left.sum():
        active = [i for i in range(len(left)) if left[i]]
        weights = [shares[i] for i in active]
        table = np.zeros((cycle, len(left)), np.int64)
        table[:, active] = round_robin(weights if sum(weights) else [1] * len(active), window, cycle)
        given, full = np.cumsum(table, 0), table.sum(0)
        lasts = []
        for i in active:
            if full[i]:
                rounds = int(left[i] // full[i])
                lasts.append(rounds * cycle + int(np.searchsorted(given[:, i], left[i] - rounds * full[i], "right")))
        if windows := min(lasts):
            phases.append(Phase(first, windows, np.array(totals) - left, table.astype(np.int32)))
            left = left - windows // cycle * full - (given[windows % cycle - 1] if windows % cycle else 0)
            first += windows
        if left.sum():
            give = np.minimum(table[windows % cycle], left)
            for i in np.argsort(-left, kind="stable"):  # the others make up for what the dry queue lacks
                give[i] += min(window - int(give.sum()), int(left[i] - give[i]))
            phases.append(Phase(first, 1, np.array(totals) - left, give[None, :].astype(np.int32)))
            left, first = left - give, first + 1
    return phases


class Cutter:
    """Pieces of intervals of one queue."""

    def __init__(self, phases: list[Phase], queue: int):
        self.parts = []
        for p in phases:
            give = p.alloc[:, queue]
            used = np.flatnonzero(give)
            rounds, rest = divmod(p.windows, len(give))
            size = int(rounds * give.sum() + give[:rest].sum())
            if size:
                before = p.alloc[:, :queue].sum(1)[used]
                self.parts.append((int(p.start[queue]), size, p.first, len(give), used, np.concatenate(([0], np.cumsum(give[used]))), before))

    def cut(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """For intervals [a, b) of the queue: interval, from, to, window, offset in the window."""
        out = []
        for start, size, first, cycle, used, cum, before in self.parts:
            own = np.flatnonzero((a < start + size) & (b > start))
            if not len(own):
                continue
            lo, hi = np.maximum(a[own], start) - start, np.minimum(b[own], start + size) - start
            full, k = int(cum[-1]), len(used)
            slot = lambda x: x // full * k + np.searchsorted(cum, x % full, "right") - 1  # noqa: E731, B023
            s0, s1 = slot(lo), slot(hi - 1)
            n = s1 - s0 + 1
            row = np.repeat(np.arange(len(own)), n)
            s = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + s0[row]
            base, j = s // k * full, s % k
            x, y = np.maximum(base + cum[j], lo[row]), np.minimum(base + cum[j + 1], hi[row])
            out.append((own[row], x + start, y + start, first + s // k * cycle + used[j], before[j] + x - base - cum[j]))
        if not out:
            return tuple(np.empty(0, np.int64) for _ in range(5))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Mixture:
    """Where the ids of each queue go. Only totals and shares are sent to tasks; tables are made where they are used."""

    def __init__(self, totals: dict[str, int], shares: dict[str, int] | None, window: int, cycle: int, fan: int):
        self.totals, self.shares, self.window, self.cycle, self.fan = totals, shares, window, cycle, fan
        order = sorted(totals, key=lambda q: (-totals[q], q))
        groups = min(fan, max(0, -(-(len(order) - fan) // max(1, fan - 1))))
        lone = fan - groups if groups else len(order)
        self.nodes: list[list[str]] = [[q] for q in order[:lone]] + [order[lone + i :: groups] for i in range(groups)]
        self.place = {q: (i, j) for i, node in enumerate(self.nodes) for j, q in enumerate(node)}
        self.made: dict[tuple, object] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": {}}

    def _phases(self, members: list[list[str]], key: int) -> list[Phase]:
        if ("phases", key) not in self.made:
            sums = [sum(self.totals[q] for q in m) for m in members]
            shares = [sum(self.shares[q] for q in m) for m in members] if self.shares else None
            self.made["phases", key] = schedule(sums, shares, self.window, self.cycle)
        return self.made["phases", key]

    def _cutter(self, members: list[list[str]], node: int, at: int) -> Cutter:
        if (node, at) not in self.made:
            self.made[node, at] = Cutter(self._phases(members, node), at)
        return self.made[node, at]

    def cut(self, queue: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """For intervals [a, b) of a queue: interval, from, to, window, offset in the window."""
        i, j = self.place[queue]
        outer = self._cutter(self.nodes, -1, i)
        if len(self.nodes[i]) == 1:
            return outer.cut(a, b)
        own, x, y, seq, offset = self._cutter([[q] for q in self.nodes[i]], i, j).cut(a, b)
        at = seq * self.window + offset  # place in the stream that the members make up
        row, u, v, seq, offset = outer.cut(at, at + y - x)
        return own[row], x[row] + u - at[row], x[row] + v - at[row], seq, offset


def queued(docs: DataFrame, shares: dict[str, int] | None, max_queues: int) -> tuple[DataFrame, dict[str, int] | None]:
    """``doc_id, text, source, queue`` and the shares of the queues."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), source.alias("source"))
    names = rows.select("source").distinct()
    many = names.limit(max_queues + 1).count() > max_queues
    named = sorted(shares or {}) if len(shares or {}) < max_queues else []
    hashed = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(max_queues - len(named))).cast("string"))
    queue = F.concat(F.lit("="), "source")
    if many:
        queue = F.when(F.col("source").isin(named), queue).otherwise(hashed) if named else hashed
    rows, known = rows.withColumn("queue", queue), None
    if shares:
        given = docs.sparkSession.createDataFrame(list(shares.items()), "source string, share long")
        each = names.withColumn("queue", queue).join(given, "source", "left").withColumn("share", F.coalesce("share", F.lit(1)))
        known = {r.queue: r.share for r in each.groupBy("queue").agg(F.sum("share").alias("share")).collect()}
    return rows, known


def encoded(rows: DataFrame, scratch: Scratch, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Ids of every document, written once: part and local place tell where its queue holds it."""
    small_arrow_batches(rows.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("queue", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, places = encoder(tokenizer), TaskContext.get().partitionId(), {}
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in batches:
            queues, out = batch.column(3).to_pylist(), []
            for text, queue in zip(batch.column(1), queues, strict=True):
                ids = np.append(enc.ids(text.as_py()), np.uint32(end_id)).astype(f"<u{width}")
                out.append((places.get(queue, 0), len(ids), ids.tobytes()))
                places[queue] = places.get(queue, 0) + len(ids)
            place, n, ids = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([part] * len(n), pa.int32()), pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return scratch.table(rows.select("doc_id", "text", "source", "queue").mapInArrow(encode, "doc_id long, source string, queue string, part int, place long, n long, ids binary"), "ids")


def pack(docs: DataFrame, scratch: Scratch, shares: dict[str, int] | None = None, tokenizer: str | None = None, window: int = WINDOW, cycle: int = CYCLE, max_queues: int = MAX_QUEUES, end_id: int = 0, fan: int = FAN) -> DataFrame:
    """Pieces of ``doc_id, text, source`` in windows: one row for each, see ``PIECES_DDL``.

    shares: target weights by source, whole numbers (a source that isn't named gets 1); without them
    the mixture is that of the corpus, and all queues run dry together.
    """
    rows, known = queued(docs, shares, max_queues)
    ids = encoded(rows, scratch, tokenizer, end_id)
    parts = ids.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")
    parts = scratch.table(parts.select("queue", "part", "n", before.alias("before")), "parts")
    totals = {r.queue: r.n for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    mixture = Mixture(totals, known, window, cycle, fan)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, queue, place, n, raw, source = (batch.column(i) for i in range(6))
            names, place, n = np.array(queue.to_pylist(), object), place.to_numpy(), n.to_numpy()
            for name in dict.fromkeys(names):
                rows = np.flatnonzero(names == name)
                which, x, y, seq, offset = mixture.cut(name, place[rows], place[rows] + n[rows])
                crc, last, ids = np.empty(len(which), np.int64), -1, b""
                which = rows[which]
                starts, lengths = x - place[which], y - x
                for k, (r, s, e) in enumerate(zip(which.tolist(), (starts * 4).tolist(), ((starts + lengths) * 4).tolist(), strict=True)):
                    if r != last:
                        buf = raw[r].as_buffer()
                        last, ids = r, memoryview(np.frombuffer(buf, f"<u{len(buf) // int(n[r])}").astype("<u4")).cast("B")
                    crc[k] = zlib.crc32(ids[s:e])
                if len(which):
                    taken = pa.array(which)
                    yield pa.RecordBatch.from_arrays([doc.take(taken), *(pa.array(c, pa.int64()) for c in (starts, lengths, crc, n[which], seq, offset)), source.take(taken)], schema=PIECES)

    # The parts are joined by broadcast only while Spark finds their files small enough.
    placed = ids.join(parts.drop("n"), ["queue", "part"]).select("doc_id", "queue", (F.col("place") + F.col("before")).alias("place"), "n", "ids", "source")
    return placed.mapInArrow(cut, PIECES_DDL)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed to 1024 ids in the corpus's own mixture."""
    return pack(read_table(spark, sf_dir, "documents"), Scratch(spark, "packing"))

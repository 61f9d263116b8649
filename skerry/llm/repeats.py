"""Operator 2: removal of repeated passages by an enhanced suffix array cut into buckets.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller key.

Sorting every suffix of a corpus moves far more than the corpus, so only those suffixes are sorted that
can matter. Anchors are chosen as in winnowing (Schleimer, Wilkerson and Aiken, 2003): of every
``LENGTH - ANCHOR + 1`` neighbouring strings of ``ANCHOR`` bytes, those with the least hash. Any common
string of ``LENGTH`` bytes holds an anchor that both documents choose. An anchor that a single document
has can't lie in a repeat; the others' suffixes, with the bytes on their left, make up the array:

1. Texts are dealt into groups, and each group sends the distinct hashes of its anchors to buckets. The
   answer is one bit for each: whether another document has it.
2. Groups send the surroundings of those anchors to buckets, equal ones once. A bucket sorts its
   suffixes, takes the longest common prefixes of neighbours and scans them with a stack, which gives
   the tree of common-prefix intervals: all occurrences that share a prefix, not just neighbours. The
   same is done to the left, and an interval whose members differ on the left is split where they do, so
   every maximal repeat is met with all its occurrences. The least key of each part tells which of the
   windows around an anchor an earlier document has.
3. Groups cut those windows out of their texts.

Copies of a whole text are found by their hashes beforehand and take no part: whatever repeats them
repeats the first of them. An anchor of a very frequent passage costs a bucket one entry for each group
of texts and surrounding, not one for each document.

Texts are shuffled once; all three steps read that one exchange. Groups hold ``GROUP_BYTES`` of text each and
there is a bucket for each ``BUCKET_BYTES``, so what a task holds stays alike in any corpus. Where anchors
stand never leaves a group: the last step chooses them again. Anchors only propose: step 2 compares bytes.
Whole copies are told by their length and two 64-bit hashes.

Defined cases: a null text is empty; a text shorter than the length loses nothing; rows that share a key
take nothing from each other; a null key loses nothing and takes nothing from others; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import document_columns, small_arrow_batches
from skerry.llm.shingles import BASE, BASE_INVERSE, LETTERS, U, mix, powers
from skerry.sources.tables import read_table

LENGTH, ANCHOR, PIECE, GROUP_BYTES, BUCKET_BYTES = 50, 25, 1 << 16, 5 << 19, 10 << 20
SIDE = LENGTH - ANCHOR
NONE = np.iinfo(np.int64).max


# --- anchors ---------------------------------------------------------------------------------------


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick over every w neighbours."""
    step = 1
    while step * 2 <= w:
        x = pick(x[: len(x) - step], x[step:])
        step *= 2
    return pick(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that stand behind each other; ends: where each text ends."""
    w, places, hashes = SIDE + 1, [], []
    up, down = powers(1 << 17)
    outside = np.zeros(len(data) + 1, bool)  # strings that would reach into the next text
    for e in ends.tolist():
        outside[max(0, e - ANCHOR + 1) : e] = True
    margin = ANCHOR - 1 + 2 * (w - 1)
    for at in range(0, max(1, len(data) - ANCHOR + 1), PIECE):
        first = max(0, at - (w - 1))
        b = data[first : at + PIECE + margin]
        if len(b) < LENGTH:  # only if all the data are shorter: a later piece begins SIDE before its range
            break
        sums = np.zeros(len(b) + 1, U)
        np.cumsum(LETTERS[b] * up[: len(b)], out=sums[1:])
        n = len(b) - ANCHOR + 1
        full = (sums[ANCHOR:] - sums[:n]) * down[:n]
        order = ((full * U(BASE)) >> U(32)).astype(np.uint32)
        order[outside[first : first + n]] = 0xFFFFFFFF
        least = sliding(order, w, np.minimum)
        edge = np.zeros(w - 1, np.uint32)
        chosen = sliding(np.concatenate((edge, least, edge)), w, np.maximum) == order
        chosen &= order != 0xFFFFFFFF
        own = np.flatnonzero(chosen) + first
        own = own[(own >= at) & (own < at + PIECE)]
        places.append(own)
        hashes.append(mix(full[own - first]))
    if not places:
        return np.empty(0, np.int64), np.empty(0, U)
    return np.concatenate(places), np.concatenate(hashes)


# --- the array of a bucket -------------------------------------------------------------------------


def words_of(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian words, which sort like the bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return list(padded.view(">u8").astype(U).T)


def sorted_suffixes(rows: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the common prefix of each with its predecessor (-1 where first differs)."""
    keys = [lengths, *reversed(words_of(rows))] + ([first] if first is not None else [])
    order = np.lexsort(keys)
    s, n = rows[order], lengths[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common = np.minimum(common, np.minimum(n[1:], n[:-1]))
    if first is not None:
        f = first[order]
        common[f[1:] != f[:-1]] = -1
    return order, np.concatenate(([-1], common)) if len(rows) else np.empty(0, np.int64)


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Common-prefix intervals of a depth of at least ``least``: first, last, depth, parent's depth (or least - 1).

    One pass with a stack: an interval opens where the common prefix grows and closes where it shrinks.
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []
    values = common.tolist()
    for i, c in enumerate([*values, -1]):
        start = i - 1
        while stack and stack[-1][1] > c:
            start, depth = stack.pop()
            if depth >= least:
                out.append((start, i - 1, depth, max(c, stack[-1][1] if stack else -1, least - 1)))
        if c >= 0 and (not stack or stack[-1][1] < c):
            stack.append((start, c))
    return out


def earlier_windows(hashes: np.ndarray, keys: np.ndarray, around: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each entry the bits of the windows around its anchor that an entry with a smaller key has.

    around: the bytes from SIDE before the anchor to SIDE behind it; left and right: how many of those
    before and behind are the text's own. Window j takes SIDE - j bytes before the anchor and j behind.
    """
    out = np.zeros(len(keys), np.uint32)
    if len(keys) < 2:
        return out
    forward, common = sorted_suffixes(around[:, SIDE:], right + ANCHOR, hashes)
    backward, before = sorted_suffixes(np.ascontiguousarray(around[:, :SIDE][:, ::-1]), left)
    found = intervals(common, ANCHOR)
    if not found:
        return out
    first, last, depth, parent = (np.array(c, np.int64) for c in zip(*found, strict=True))
    for j in range(SIDE + 1):
        own = np.flatnonzero((depth >= ANCHOR + j) & (parent < ANCHOR + j))  # the widest intervals of that depth
        if not len(own):
            break
        sizes = last[own] - first[own] + 1
        node = np.repeat(np.arange(len(own)), sizes)
        place = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[own][node]
        entry = forward[place]
        part = np.empty(len(keys), np.int64)  # members that agree on the left stay together
        part[backward] = np.cumsum(before < SIDE - j)
        fits = (left[entry] >= SIDE - j) & (right[entry] >= j)
        node, entry = node[fits], entry[fits]
        code = node * (len(keys) + 1) + part[entry]
        order = np.argsort(code, kind="stable")
        if not len(order):
            continue
        cut = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
        low = np.minimum.reduceat(keys[entry[order]], cut)
        low = np.repeat(low, np.diff(np.concatenate((cut, [len(order)]))))
        out[entry[order][low < keys[entry[order]]]] |= np.uint32(1 << j)
    return out


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Maximal repeats of a few texts in memory: each string that can't be extended, with all its places.

    Shows what the buckets compute, on every suffix; for small inputs.
    """
    suffixes = sorted((t[i:], k, i) for k, t in enumerate(texts) for i in range(len(t)))
    common = [-1]
    for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        common.append(n)
    out = []
    for first, last, depth, _ in intervals(np.array(common), least):
        places = [(k, i) for _, k, i in suffixes[first : last + 1]]
        if len({texts[k][i - 1 : i] if i else (k,) for k, i in places}) > 1:  # diverse on the left
            out.append((suffixes[first][0][:depth], sorted(places)))
    return sorted(out)


# --- groups of texts -------------------------------------------------------------------------------


def laid_out(docs: pa.Table, copies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A group's rows that take part, in a fixed order: row, key, start of its bytes; and all the bytes."""
    keys = docs.column("doc_id").to_pylist()
    texts = [t.encode("utf-8", "surrogatepass") for t in docs.column("text").to_pylist()]
    gone = set(copies.column("doc_id").to_pylist())
    rows = [i for i, k in enumerate(keys) if k is not None and len(texts[i]) >= LENGTH]
    rows = sorted((i for i in rows if (keys[i]) not in gone), key=lambda i: (keys[i], texts[i]))
    sizes = np.array([len(texts[i]) for i in rows], np.int64)
    starts = np.cumsum(sizes) - sizes if len(rows) else np.empty(0, np.int64)
    return np.array(rows, np.int64), np.array([keys[i] for i in rows], np.int64), starts, np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, highest first, so that their many zero bytes compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def anchor_lists(key: tuple, docs: pa.Table, copies: pa.Table, buckets: int) -> pa.Table:
    """Step 1: for each bucket the distinct hashes in this group, sorted, and whether two texts have them."""
    _, _, starts, data = laid_out(docs, copies)
    places, hashes = anchors(data, np.append(starts[1:], len(data)) if len(starts) else starts)
    text = np.searchsorted(starts, places, "right")
    order = np.lexsort((text, hashes))
    h, t = hashes[order], text[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
    cut = np.flatnonzero(new)
    again = (np.maximum.reduceat(t, cut) != np.minimum.reduceat(t, cut)) if len(cut) else np.empty(0, bool)
    h = h[new]
    rows = {"b": [], "g": [], "h": [], "again": []}
    for b, own in split(h % U(buckets)):
        rows["b"].append(b)
        rows["g"].append(key[0].as_py())
        rows["h"].append(planes(np.diff(h[own] >> U(16), prepend=U(0))))
        rows["again"].append(np.packbits(again[own]).tobytes())
    return pa.table(rows, schema=pa.schema([("b", pa.int64()), ("g", pa.int64()), ("h", pa.binary()), ("again", pa.binary())]))


def split(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Rows of each bucket in their order."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(order) else np.empty(0, np.int64)
    return [(int(sorted_[c]), part) for c, part in zip(cut, np.split(order, cut[1:]), strict=True)] if len(order) else []


def answer_lists(key: tuple, lists: pa.Table) -> pa.Table:
    """Which of each group's hashes stand in more than one text."""
    hs = [np.cumsum(unplanes(x.as_buffer()), dtype=U) for x in lists.column("h")]
    again = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(h)) for x, h in zip(lists.column("again"), hs, strict=True)]
    all_h = np.concatenate(hs)
    values, inverse, counts = np.unique(all_h, return_inverse=True, return_counts=True)
    known = counts > 1
    known[inverse[np.concatenate(again).astype(bool)]] = True
    bits = known[inverse]
    cut = np.cumsum([len(h) for h in hs])[:-1]
    masks = [np.packbits(x).tobytes() for x in np.split(bits, cut)]
    return pa.table({"g": lists.column("g"), "b": lists.column("b"), "mask": pa.array(masks, pa.binary())})


def repeated_anchors(docs: pa.Table, told: pa.Table, buckets: int) -> tuple[Iterator[tuple[int, dict[str, np.ndarray]]], tuple[np.ndarray, ...]]:
    """For each bucket the distinct surroundings of this group's repeated anchors, with the least key of each,
    and where they stand; and the group as it is laid out. The same whenever it is asked for."""
    copies, answers = told.filter(pc.is_valid(told.column("doc_id"))), told.filter(pc.is_valid(told.column("mask")))
    laid = laid_out(docs, copies)
    _, ids, starts, data = laid
    masks = dict(zip(answers.column("b").to_pylist(), answers.column("mask"), strict=True))
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    places, hashes = anchors(data, ends)
    bucket = hashes % U(buckets)
    hit = np.zeros(len(places), bool)
    for b, own in split(bucket):
        distinct, inverse = np.unique(hashes[own], return_inverse=True)
        hit[own] = np.unpackbits(np.frombuffer(masks[b].as_buffer(), np.uint8), count=len(distinct)).astype(bool)[inverse]
    places, hashes, bucket = places[hit], hashes[hit], bucket[hit]
    text = np.searchsorted(starts, places, "right") - 1
    left = np.minimum(places - starts[text], SIDE) if len(places) else places
    right = np.minimum(ends[text] - places - ANCHOR, SIDE) if len(places) else places
    padded = np.concatenate((np.zeros(SIDE, np.uint8), data, np.zeros(SIDE + ANCHOR, np.uint8)))

    def each() -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        for b, own in split(bucket):
            p, lo, hi, key = places[own], left[own], right[own], ids[text[own]]
            around = np.lib.stride_tricks.sliding_window_view(padded, LENGTH + SIDE)[p].copy()
            cols = np.arange(LENGTH + SIDE)
            around[(cols < SIDE - lo[:, None]) | (cols >= SIDE + ANCHOR + hi[:, None])] = 0
            whole = np.concatenate((hashes[own].astype(">u8").view(np.uint8).reshape(-1, 8), around, lo[:, None].astype(np.uint8), hi[:, None].astype(np.uint8)), axis=1)
            sort = np.lexsort([key, *reversed(words_of(whole))])
            s = whole[sort]
            new = np.concatenate(([True], (s[1:] != s[:-1]).any(axis=1)))
            at = sort[new]  # of equal ones that with the least key
            entry = np.cumsum(new) - 1
            yield b, {"h": hashes[own][at], "keys": key[at], "around": around[at], "sides": np.stack((lo[at], hi[at])), "entry": entry, "place": p[sort], "later": key[sort] > key[at][entry]}

    return each(), laid


def surroundings(key: tuple, docs: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    """Step 2, in a group: the distinct surroundings of repeated anchors. Where they stand stays in the group."""
    schema = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("h", pa.binary()), ("keys", pa.binary()), ("around", pa.binary()), ("sides", pa.binary())])
    each, _ = repeated_anchors(docs, told, buckets)
    rows = [(b, key[0].as_py(), x["h"].astype("<u8").tobytes(), x["keys"].astype("<i8").tobytes(), x["around"].tobytes(), x["sides"].astype(np.uint8).tobytes()) for b, x in each]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def windows_inside(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits of the windows that lie in the text."""
    j = np.arange(SIDE + 1)
    return ((left[:, None] >= SIDE - j) & (right[:, None] >= j)) @ (1 << j)


def judge_bucket(key: tuple, lists: pa.Table) -> pa.Table:
    """Step 2, in a bucket: for each place the windows to cut out."""
    num = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in lists.column(name)]
    hs = num("h", "<u8")
    sides = [x.reshape(2, -1).astype(np.int64) for x in num("sides", np.uint8)]
    around = np.concatenate([x.reshape(-1, LENGTH + SIDE) for x in num("around", np.uint8)])
    sides = np.concatenate(sides, axis=1)
    bits = earlier_windows(np.concatenate(hs), np.concatenate(num("keys", "<i8")), around, sides[0], sides[1])
    cut = np.cumsum([len(h) for h in hs])[:-1]
    return pa.table({"g": lists.column("g"), "b": lists.column("b"), "bits": pa.array([x.astype("<u4").tobytes() for x in np.split(bits, cut)], pa.binary())})


def cut_out(key: tuple, docs: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    """Step 3: what is left of a group's texts."""
    copies = told.filter(pc.is_valid(told.column("doc_id")))
    judged = told.filter(pc.is_valid(told.column("bits")))
    answers = dict(zip(judged.column("b").to_pylist(), judged.column("bits"), strict=True))
    each, (rows, _, starts, data) = repeated_anchors(docs, told, buckets)
    change = np.zeros(len(data) + 1, np.int32)
    for b, x in each:
        own = np.frombuffer(answers[b].as_buffer(), "<u4")
        bits = np.where(x["later"], windows_inside(*x["sides"])[x["entry"]], own[x["entry"]]).astype(np.uint32)
        for j in range(SIDE + 1):
            from_ = x["place"][(bits >> np.uint32(j)) & np.uint32(1) == 1] - SIDE + j
            np.add.at(change, from_, 1)
            np.add.at(change, from_ + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    cut = dict(zip(rows.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(data)], strict=True), strict=True)) if len(rows) else {}
    whole = set(copies.column("doc_id").to_pylist())
    out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    for i, (k, t) in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True)):
        raw = t.encode("utf-8", "surrogatepass")
        removed = spans = 0
        kept = raw
        if i in cut:
            a, b = cut[i]
            g = gone[a:b]
            if removed := int(g.sum()):
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
                kept = data[a:b][~g].tobytes()
        elif k in whole and len(raw) >= LENGTH:
            removed, spans, kept = len(raw), 1, b""
        for name, v in zip(out, (k, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
            out[name].append(v)
    return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))


def remove_repeats(docs: DataFrame, groups: int | None = None, buckets: int | None = None) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes left)."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    if not (groups and buckets):
        total = document_columns(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        groups, buckets = groups or 1 + total // GROUP_BYTES, buckets or 1 + total // BUCKET_BYTES
    laid = document_columns(docs).withColumn("g", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(groups)))
    signed = document_columns(docs).select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")).where(f"n >= {LENGTH} and doc_id is not null")
    first = signed.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = signed.join(first, ["k1", "k2", "n"]).where("doc_id > first").select("doc_id").withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(None).cast("long")), F.lit(groups)))
    # A key with several texts is not told apart here, so only keys whose texts are all copies are left out.
    odd = signed.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    copies = copies.join(odd, "doc_id", "left_anti")
    by_group = lambda df: df.groupBy("g")
    told = lambda *parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, copies.select("g", "doc_id")])
    lists = by_group(laid).cogroup(by_group(copies)).applyInArrow(lambda key, a, b: anchor_lists(key, a, b, buckets), "b long, g long, h binary, again binary")
    masks = lists.groupBy("b").applyInArrow(answer_lists, "g long, b long, mask binary")
    around = by_group(laid).cogroup(by_group(told(masks))).applyInArrow(lambda key, a, b: surroundings(key, a, b, buckets), "b long, g long, h binary, keys binary, around binary, sides binary")
    judged = around.groupBy("b").applyInArrow(judge_bucket, "g long, b long, bits binary")
    return by_group(laid).cogroup(by_group(told(judged, masks))).applyInArrow(lambda key, a, b: cut_out(key, a, b, buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")

"""Operator 3: token counts that follow edits without encoding a text again.

A text is cut into pre-token leaves: before a space or line break that stands in front of anything but white
space a pre-token always begins. The counts of leaves sum to the count of the text, so they are the leaves
of a segment tree whose nodes hold sums of code points and of tokens. An edit finds its leaves by the sums
of code points, takes the leaf on the left as context too if it touches the two code points that make the
cut safe, encodes that region again, and updates the sums on the paths to the root. What it leaves is cut
into leaves anew: a region of several becomes a tree of its own in its place, so no leaf grows. The leaf on
the right needs no look: its own first two code points keep its cut safe whatever stands before it. Where
an added token could begin there is no cut, as that ends a run of white space too.

Defined cases: a null text is empty and has no tokens; edits are of the text as the ones before have left
it; a region may become empty; repeated rows repeat their results; an empty table gives no rows; a doc_id is
a whole number or can be cast to one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import document_columns, small_arrow_batches
from skerry.llm.pii import spans
from skerry.llm.tokens import Encoder, encoder
from skerry.sources.tables import read_table

LEAF = 1


@lru_cache(maxsize=8)
def cut_places(added: tuple[str, ...]) -> re.Pattern[str]:
    """Where a pre-token begins, whatever stands around it."""
    return re.compile(rf"(?=[ \n][^\s\u180e{re.escape(''.join(sorted({t[0] for t in added if t})))}])")


def cuts(text: str, enc: Encoder, size: int = LEAF) -> list[str]:
    """Leaves of at least ``size`` code points; one if the encoder knows no safe cuts."""
    pieces = cut_places(tuple(enc.added)).split(text) if enc.by_piece else [text]
    if size <= 1:
        return pieces if pieces[0] or len(pieces) == 1 else pieces[1:]
    out, now, n = [], [], 0
    for p in pieces:
        now.append(p)
        n += len(p)
        if n >= size:
            out.append("".join(now))
            now, n = [], 0
    return [*out, "".join(now)] if now or not out else out


def sums(values: list[int], width: int) -> np.ndarray:
    """A segment tree of sums over ``width`` leaves: the root at 1, the children of k at 2 k and 2 k + 1."""
    level = np.zeros(width, np.int64)
    level[: len(values)] = values
    levels = [level]
    while len(level) > 1:
        level = level.reshape(-1, 2).sum(axis=1)
        levels.append(level)
    return np.concatenate([np.zeros(1, np.int64), *reversed(levels)])


class CountedText:
    """A text and its number of tokens, kept right through edits."""

    def __init__(self, text: str, enc: Encoder, leaf: int = LEAF):
        self.enc, self.leaf = enc, leaf
        self.leaves: list[str | CountedText] = list(cuts(text, enc, leaf))
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars = sums([len(t) for t in self.leaves], self.width)
        self.tokens = sums(enc.lengths(self.leaves), self.width)
        self.encoded = len(text)

    @property
    def count(self) -> int:
        return int(self.tokens[1])

    @property
    def text(self) -> str:
        return "".join(self._text(i) for i in range(len(self.leaves)))

    def _text(self, leaf: int) -> str:
        own = self.leaves[leaf]
        return own if isinstance(own, str) else own.text

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a place, and the place in it; the end of the text is in the last leaf with text."""
        node = 1
        while node < self.width:
            node *= 2
            here = int(self.chars[node])
            if at > here or (at == here and self.chars[node + 1]):
                at -= here
                node += 1
        return node - self.width, at

    def _sum_up(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        more = (chars - int(self.chars[node]), tokens - int(self.tokens[node]))
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2

    def _set(self, leaf: int, text: str) -> None:
        if len(cuts(text, self.enc, self.leaf)) > 1:
            own = self.leaves[leaf] = CountedText(text, self.enc, self.leaf)
            tokens = own.count
        else:
            self.leaves[leaf] = text
            tokens = self.enc.lengths([text])[0]
        self.encoded += len(text)
        self._sum_up(leaf, len(text), tokens)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put new in the place of the code points from start to before end."""
        i, a = self.find(start)
        j, b = self.find(end)
        own = self.leaves[i]
        if i == j and a >= 2 and isinstance(own, CountedText):  # all within a tree that a former edit has left
            before = own.encoded
            own.replace(a, b, new)
            self.encoded += own.encoded - before
            self._sum_up(i, int(own.chars[1]), own.count)
            return
        while i and a < 2:  # the cut before this leaf depends on what changes
            i -= 1
            while i and not self.chars[self.width + i]:
                i -= 1
            a += len(self._text(i))
        head, tail = "".join(self._text(k) for k in range(i, j)), self._text(j)
        region = (head + tail[:b])[:a] + new + tail[b:]
        # Leaves beyond j start with their own safe cut. If j itself is left without one, it is in the region.
        for k in range(i + 1, j + 1):
            self._set(k, "")
        self._set(i, region)


def repeated_lines(text: str) -> list[tuple[int, int, str]]:
    """Lines of at least 20 code points that the text had before, with the line break in front of them."""
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        if len(line) >= 20 and line in seen:
            out.append((at - 1, at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    return out


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Production edits: personal data masked and repeated lines dropped; from the back, without overlap."""
    lines = repeated_lines(text)
    found = [*lines, *((a, b, f"<{kind.upper()}>") for a, kind, b, _ in spans(text))]
    out: list[tuple[int, int, str]] = []
    for a, b, new in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, new))
    return out[::-1]


def edited_counts(docs: DataFrame, edits=cleaning_edits, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, text`` to token counts before and after edits, and how many code points were encoded again."""
    small_arrow_batches(docs.sparkSession)
    names = ("n_chars_before", "n_tokens_before", "n_edits", "n_chars_after", "n_tokens_after", "n_chars_reencoded")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows: list[list[int]] = [[] for _ in names]
            for text in batch.column(1).to_pylist():
                counted = CountedText(text, enc)
                before, script = counted.count, edits(text)
                for a, b, new in script:
                    counted.replace(a, b, new)
                for col, v in zip(rows, (len(text), before, len(script), int(counted.chars[1]), counted.count, counted.encoded - len(text)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in rows)], schema=schema)

    return document_columns(docs).mapInArrow(count, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def op3_edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after cleaning."""
    return edited_counts(read_table(spark, sf_dir, "documents"))

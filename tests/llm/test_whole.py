"""Whole results of the training-data operators at the edges of their pieces."""

from __future__ import annotations

import random

import numpy as np
import pytest

from skerry.llm import repeats
from tests.llm.test_operators import by_id, documents


@pytest.mark.parametrize("pieces", [1, 2])
@pytest.mark.parametrize("more", range(25, 50))
def test_anchors_do_not_depend_on_pieces(monkeypatch, pieces, more):
    data = np.random.default_rng(more).integers(97, 123, 65536 * pieces + more).astype(np.uint8)
    ends = np.array([len(data)])
    got = repeats.anchors(data, ends)
    monkeypatch.setattr(repeats, "PIECE", 50000)
    assert [x.tolist() for x in got] == [x.tolist() for x in repeats.anchors(data, ends)]


def test_repeat_at_the_end_of_a_group(spark):
    r = random.Random(1)
    text = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    same, first = text(50), text(60)
    long = text(65536 + 49 - 110 - 50) + same
    got = by_id(repeats.remove_repeats(documents(spark, [same + first, long]), groups=1, buckets=3), "n_removed")
    assert got == {0: (0,), 1: (50,)}

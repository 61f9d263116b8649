"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

U = np.uint64
BASE, BLOCK, LONG_WORD = 0x9E3779B97F4A7C15, 1 << 20, 512
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def separators() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


SEPARATORS = separators()
LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, U(BASE)), np.full(n, U(BASE_INVERSE))
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text: runs between ASCII white space, with A-Z lower-cased."""
    data = text.encode("utf-8", "surrogatepass").lower()
    out = []
    at = 0
    while at < len(data):
        stop = len(data)
        if stop - at > BLOCK:  # cut behind white space, so that long texts need little memory
            cuts = [c for c in (data.find(bytes([s]), at + BLOCK) for s in np.flatnonzero(SEPARATORS).tolist()) if c >= 0]
            stop = min(cuts, default=len(data))
        b = np.frombuffer(data, np.uint8, stop - at, at)
        space = np.empty(len(b) + 2, bool)
        space[0] = space[-1] = True
        space[1:-1] = SEPARATORS[b]
        change = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = change[::2], change[1::2]
        if len(starts):
            up, down = powers(1 << max(12, int(len(b)).bit_length()))
            sums = np.zeros(len(b) + 1, U)
            np.cumsum(LETTERS[b] * up[: len(b)], out=sums[1:])
            h = mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(U))
            for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
                h[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
            out.append(h)
        at = stop
    return np.concatenate(out) if out else np.empty(0, U)


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of k neighbouring words; of the whole text if it has fewer; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, U(n))
    for i in range(n):
        h = mix(h * U(BASE) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def exact_set(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The same set as words themselves."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else ({tuple(w)} if w else set())

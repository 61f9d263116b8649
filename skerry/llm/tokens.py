"""Token ids of whole texts by the ``tokenizers`` library."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: A text may be cut before these without changing its ids: see ``Encoder``.
CUT = re.compile(r"(?= [^\s\u180e])|(?=\n[^\s\u180e])")
SAFE = re.compile(r"\n?[^\s\u180e]")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LONGEST, MOST = 64, 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """``Tokenizer.encode(text, add_special_tokens=False)`` for many texts.

    Every id is the library's own. A byte-level pre-tokenizer without a prefix space begins a piece at each
    space or line break that stands before something other than white space, and merges never cross pieces.
    So texts are cut there, and the library encodes each distinct piece once and not for each time that it
    stands somewhere; a process keeps up to ``MOST`` of them (about 160 MB). Added tokens end a run of white space too, so texts with one go to the library as they
    are, and so does every text if the file names another pre-tokenizer or a normalizer.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        self.by_piece = self._cuts_are_safe()
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {"": 0}

    def _cuts_are_safe(self) -> bool:
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        own = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        return bool(plain and own and not spec.get("truncation") and not spec.get("padding"))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return np.empty(0, "<u4")
        if not self.by_piece or any(t in text for t in self.added):
            return self.whole(text)
        # A space is left out of the pieces behind it; one that begins with a line break has none.
        head, *rest = text.replace("\n", " \n").split(" ")
        known = self.known
        try:
            return np.frombuffer(self.head(head) + b"".join(map(known.__getitem__, rest)), "<u4")
        except KeyError:
            new = set(rest).difference(known)
        if not all(map(SAFE.match, new)):  # white space in a row
            head, *rest = CUT.split(text)
            rest = [p if p[0] == "\n" else p[1:] for p in rest]
            new = set(rest).difference(known)
        self.learn(new)
        out = self.head(head) + b"".join(map(known.__getitem__, rest))
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        if len(known) > MOST:
            known.clear()
        return np.frombuffer(out, "<u4")

    def head(self, text: str) -> bytes:
        return self.raw(text) if text else b""

    def raw(self, text: str) -> bytes:
        if (ids := self.tails.get(text)) is None:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            if len(text) < 4 and len(self.tails) < MOST:
                self.tails[text] = ids
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Ask the library for pieces. Letters and the signs behind them are pieces of their own as well."""
        known, parts, asked = self.known, [], []
        for p in pieces:
            core = p.rstrip(SIGNS) if len(p) <= LONGEST else p
            if core != p and core and core[-1].isascii() and core[-1].isalpha():
                parts.append((p, core, p[len(core) :]))
                if core not in known and core not in pieces:
                    asked.append(core)
            else:
                asked.append(p)
        asked = list(dict.fromkeys(asked))
        for p, e in zip(asked, self.tokenizer.encode_batch_fast([p if p[0] == "\n" else " " + p for p in asked], add_special_tokens=False), strict=True):
            known[p] = array("I", e.ids).tobytes()
        for p, core, tail in parts:
            known[p] = known[core] + self.raw(tail)

    def lengths(self, pieces: list[str]) -> list[int]:
        """How many ids each piece has by itself."""
        try:
            return list(map(self.sizes.__getitem__, pieces))
        except KeyError:
            new = list({p for p in pieces if p not in self.sizes})
        found = dict(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        out = [self.sizes[p] if p in self.sizes else found[p] for p in pieces]
        if len(self.sizes) > MOST:
            self.sizes = {"": 0}
        self.sizes.update((p, n) for p, n in found.items() if len(p) <= LONGEST)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    key = path or ""
    if key not in _encoders:
        _encoders[key] = Encoder(path)
    return _encoders[key]

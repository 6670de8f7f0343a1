"""Token ids by the tokenizers library, behind the bounded cache of parts.PartCoder."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from floodgauge.llm.parts import CACHED_PARTS, LETTERS, PartCoder, Ragged

#: Words of one call's strings; a bound on memory only.
JOINED = 4000


class LibraryEncoder:
    """The library's ``encode(text, add_special_tokens=False)``.

    ``spaced``: words keep the space before them, as in byte-level tokenizers; else spaces separate
    and words end with ``</w>``. New words are encoded many in one string, the ids being told apart by
    the space (or line end) that begins, or the word end that ends, each of them."""

    def __init__(self, path: str, spaced: bool, cached: int = CACHED_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        flags = lambda test: np.array([test(t) for t in tokens])
        if spaced:
            self.groups = [(re.compile(r" [^\s<]+"), "", flags(lambda t: t[:1] == "Ġ")), (re.compile(r"\n[^\s<]+"), "", flags(lambda t: t[:1] == "Ċ"))]
        else:
            self.groups = [(re.compile(f"[{LETTERS}]+"), " ", flags(lambda t: t.endswith("</w>")))]
        normalizer = self.tokenizer.normalizer
        self.coder = PartCoder(self._code, spaced, folds=normalizer is not None and normalizer.normalize_str("Q") == "q", cached=cached)

    def _each(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str], between: str, marks: np.ndarray) -> list[bytes]:
        text = between.join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(marks[ids])
        if len(at) != len(words):
            return self._each(words)
        bounds = (4 * np.append(at, len(ids)) if self.spaced else 4 * np.append(0, at + 1)).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _code(self, words: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        rest = words
        for shape, between, marks in self.groups:
            match = shape.fullmatch
            group = [w for w in rest if match(w)]
            if len(group) > 1:
                for at in range(0, len(group), JOINED):
                    some = group[at : at + JOINED]
                    out.update(zip(some, self._joined(some, between, marks)))
                rest = [w for w in rest if w not in out]
        for at in range(0, len(rest), 20_000):
            out.update(zip(rest[at : at + 20_000], self._each(rest[at : at + 20_000])))
        return list(map(out.__getitem__, words))

    def encode(self, texts: pa.Array, end: int | None = None) -> Ragged:
        """Ids of all texts, each followed by the ``end`` id, and the bounds of the texts."""
        return self.coder.encode(texts, end)


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> LibraryEncoder:
    return LibraryEncoder(path, spaced)

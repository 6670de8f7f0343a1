"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of documents form the corpus. An inverted index maps every mergeable
pair to its positions in all words; merges are replayed in rank order over the whole index, and each
merge touches only the two neighbours of the merged positions. Encoded words are cached per worker
process (bounded), so that a word is replayed about once however often it occurs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from floodgauge.llm.common import map_blocks, table
from floodgauge.llm.generations import Generations
from floodgauge.llm.parts import CACHED_CHARS, LETTERS, PartCoder, Ragged

#: Words of texts that are coded whole in one cached generation per worker process, and symbols per
#: replayed corpus: bounds on memory only.
CACHED_WORDS, CORPUS_SYMBOLS = 100_000, 2_000_000
_WORD = re.compile(f"[ ]?[{LETTERS}]+")


class MergeReplay:
    """Encoder and decoder over ``ranks`` (token bytes to id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        first = np.full((256, 256), -1, np.int64)
        for token, i in ranks.items():
            if len(token) == 2:
                first[token[0], token[1]] = i
        self.first = first
        self.find, self.words = regex.compile(pattern).findall, Generations(CACHED_WORDS)
        self.coder = PartCoder(self._code)

    def _rank(self, a: int, b: int) -> int:
        r = self.pair_rank.get((a, b))
        if r is None:
            if len(self.pair_rank) > 2_000_000:
                self.pair_rank.clear()
            r = self.pair_rank[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, all words merged together in rank order."""
        out: list[list[int] | None] = [[self.ranks[w]] if w in self.ranks else None for w in words]
        todo = [i for i, x in enumerate(out) if x is None]
        flat = np.frombuffer(b"".join(words[i] for i in todo), np.uint8)
        n = len(flat)
        if not n:
            return [x or [] for x in out]
        ends = np.cumsum([len(words[i]) for i in todo])
        word_of = np.repeat(np.arange(len(todo)), np.diff(ends, prepend=0)).tolist()
        pair = np.full(n, -1, np.int64)
        pair[:-1] = self.first[flat[:-1], flat[1:]]
        pair[ends[ends > 0] - 1] = -1
        order = np.argsort(pair, kind="stable")
        order = order[pair[order] >= 0]
        keys, starts = np.unique(pair[order], return_index=True)
        index: dict[int, list[int]] = {int(k): x.tolist() for k, x in zip(keys, np.split(order, starts[1:]))} if len(keys) else {}
        queue = sorted(index)
        at, sym = pair.tolist(), self.byte_id[flat].tolist()
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends.tolist():
            if e:
                right[e - 1] = -1
            if e < n:
                left[e] = -1
        again: set[int] = set()
        rank = self._rank
        while queue:
            r = heapq.heappop(queue)
            places = index.pop(r)
            places.sort()
            for i in places:
                if at[i] != r:
                    continue
                j = right[i]
                k = right[j]
                sym[i], right[i], at[j], sym[j] = r, k, -1, -1
                if k >= 0:
                    left[k] = i
                    new = at[i] = rank(r, sym[k])
                    if new >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(queue, new)
                        if new < r:
                            again.add(word_of[i])
                else:
                    at[i] = -1
                h = left[i]
                if h >= 0:
                    new = at[h] = rank(sym[h], r)
                    if new >= 0:
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            heapq.heappush(queue, new)
                        if new < r:
                            again.add(word_of[h])
        start = 0
        for w, (i, e) in enumerate(zip(todo, ends.tolist())):
            out[i] = self.one_word(words[i]) if w in again else [s for s in sym[start:e] if s >= 0]
            start = e
        return out

    def one_word(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first, in one word: for words in which a merge makes a pair
        of lower rank, where the order between words must not decide."""
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        right, left = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := self._rank(sym[i], sym[i + 1])) >= 0]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = right[i]
            if sym[i] < 0 or j < 0 or self._rank(sym[i], sym[j]) != r:
                continue
            k = right[j]
            sym[i], sym[j], right[i] = r, -1, k
            if k >= 0:
                left[k] = i
                if (new := self._rank(r, sym[k])) >= 0:
                    heapq.heappush(queue, (new, i))
            h = left[i]
            if h >= 0 and (new := self._rank(sym[h], r)) >= 0:
                heapq.heappush(queue, (new, h))
        return [s for s in sym if s >= 0]

    def _replayed(self, words: list[str]) -> list[bytes]:
        """Ids of words, together one corpus of bounded size after the other."""
        raw = [w.encode() for w in words]
        out: list[bytes] = []
        start, size = 0, 0
        for i, w in enumerate(raw):
            if size and size + len(w) > CORPUS_SYMBOLS:
                out += [array("I", x).tobytes() for x in self.replay(raw[start:i])]
                start, size = i, 0
            size += len(w)
        return out + [array("I", x).tobytes() for x in self.replay(raw[start:])]

    def _code(self, texts: list[str]) -> list[bytes]:
        """Ids of each string; most are one word, others are split by the pattern."""
        split = [t if _WORD.fullmatch(t) else self.find(t) for t in texts]
        one = list({t for t in split if isinstance(t, str)})
        ids = dict(zip(one, self._replayed(one)))
        every = set().union(*(t for t in split if not isinstance(t, str)))
        self.words.fill(every, self._replayed)
        word = self.words.young.__getitem__
        out = [ids[t] if isinstance(t, str) else b"".join(map(word, t)) for t in split]
        self.words.forget([w for w in every if len(w) > CACHED_CHARS])
        return out

    def encode(self, texts: pa.Array) -> Ragged:
        """Ids of all texts and the bounds of the texts."""
        return self.coder.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> MergeReplay:
    with open(path, "rb") as lines:
        return MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def bpe_round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: encoded by the ranks in ``path``
    (every worker reads its own copy of that file), decoded again from the ids.

    Null and empty texts give no tokens and the digests of nothing. Special-token strings are
    ordinary text. Rows are independent: repeated rows repeat, other columns are ignored.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def block(cols: dict[str, list]) -> dict[str, list]:
        codec = load(path, pattern)
        values, bounds = codec.encode(cols["text"])
        ids = [values[a:b] for a, b in pairwise(bounds.tolist())]
        return {
            "doc_id": cols["doc_id"],
            "n_tokens": list(map(len, ids)),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_blocks(docs.select("doc_id", "text"), block, schema, arrow=("text",))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))

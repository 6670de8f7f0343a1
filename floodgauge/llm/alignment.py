"""Alignment of two tokenizers over the same texts, by pandas merge_asof.

A text with a space before it is encoded by a byte-level BPE (A) and by a sentencepiece model (B, which
adds that space itself). Where the bytes of both sides are those of the text, tokens have byte offsets in
one space: each token start of one side finds, by a backward as-of join keyed by document, the token of
the other side that covers it. The union of both directions is every pair of overlapping tokens; a start
that meets a start (so an end that meets an end) begins a new group.

Counts of linked id pairs hold for the corpus: blocks of documents are aligned in one pass, which keeps
each block's distinct pairs and, per link, the place of its pair among them; the pairs are added up by
Spark, and each block gets the counts of its own pairs back.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.llm.common import blocks, map_blocks, materialize, table
from floodgauge.llm.parts import PartCoder, Ragged, take
from floodgauge.llm.tokens import LibraryEncoder

#: An id pair as one number: A id times this, plus B id.
PAIR = 1 << 24
SEPARATORS = b",|;"
#: Bytes of text of one block (a longer text is a block of its own), and parts that each side's cache
#: holds in a generation: bounds on a worker's memory.
BLOCK_TEXT, CACHED = 1_200_000, 200_000


class ByteLevel:
    """Side A: ids of ``space + text``, strings of special tokens being plain text."""

    def __init__(self, path: str):
        self.library = LibraryEncoder(path, True, CACHED)
        tokenizer = self.library.tokenizer
        tokenizer.encode_special_tokens = True
        entries = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        self.entries = [bytes(byte[c] for c in e) if all(c in byte for c in e) else b"" for e in entries]

    def encode(self, spaced: pa.Array) -> Ragged:
        return self.library.encode(spaced)


class Pieces:
    """Side B: ids of a sentencepiece model whose pieces do not span words, so that words are coded alone."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.coder = PartCoder(self._code, spaced=True, special="\0", cached=CACHED)
        self.entries = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def _code(self, parts: list[str]) -> list[bytes]:
        """The model puts a space before what it is given: parts that begin with one give theirs up, the
        others go behind a line end, which is a byte of its own and merges with nothing."""
        own = [p[:1] == " " for p in parts]
        ids = self.model.encode([p[1:] if o else "\n" + p for p, o in zip(parts, own)], num_threads=1)
        lone = self.model.encode("\n ")[2:]
        return [np.array(lone if p == " " else x if o else x[2:], "<u4").tobytes() for p, x, o in zip(parts, ids, own)]

    def encode(self, spaced: pa.Array) -> Ragged:
        return self.coder.encode(spaced)


class Written:
    """Ids in decimal with what follows them, as fixed rows of bytes and their lengths."""

    def __init__(self, ids: int):
        rows = [str(i).encode() + SEPARATORS[s : s + 1] for i in range(ids) for s in range(3)]
        self.length = np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(self.length.max(initial=1))
        self.table = np.frombuffer(b"".join(r.ljust(width) for r in rows), np.uint8).reshape(-1, width)
        self.used = np.arange(width) < self.length[:, None]


@lru_cache(maxsize=1)
def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces, Written]:
    a, b = ByteLevel(path_a), Pieces(path_b)
    return a, b, Written(max(len(a.entries), len(b.entries)))


def _bytes_of(entries: list[bytes], tokens: Ragged) -> tuple[bytes, np.ndarray]:
    size = np.fromiter(map(len, entries), np.int64, len(entries))
    flat = (np.frombuffer(b"".join(entries), np.uint8), np.concatenate([[0], np.cumsum(size)]))
    values, at = take(flat, tokens[0].astype(np.int64))
    return values.tobytes(), at[tokens[1]]


class Aligned:
    """Tokens of a block of texts with their groups and links.

    a, b: ids and bounds of the texts; cover_a, cover_b: the other side's token that covers each start;
    fresh_a, fresh_b: whether a group begins there. Texts that are null or empty, or whose tokens' bytes
    are not theirs, have no tokens."""

    def __init__(self, texts: pa.Array, path_a: str, path_b: str):
        side_a, side_b, self.written = sides(path_a, path_b)
        filled = pc.fill_null(texts, "")
        spaced = pc.binary_join_element_wise(" ", filled, "")
        a, b = side_a.encode(spaced), side_b.encode(spaced)
        want = spaced.cast(pa.binary()).to_pylist()
        (raw_a, at_a), (raw_b, at_b) = _bytes_of(side_a.entries, a), _bytes_of(side_b.entries, b)
        good = np.array([len(w) > 1 and raw_a[p:q] == w and raw_b[r:s] == w for w, p, q, r, s in zip(want, at_a, at_a[1:], at_b, at_b[1:])], bool)
        self.a, self.b = (self._kept(t, good) for t in (a, b))
        frames = []
        for entries, tokens in ((side_a.entries, self.a), (side_b.entries, self.b)):
            size = np.fromiter(map(len, entries), np.int64, len(entries))[tokens[0].astype(np.int64)]
            owner = np.repeat(np.arange(len(texts)), np.diff(tokens[1]))
            frames.append(pd.DataFrame({"start": np.cumsum(size) - size, "text": owner, "token": np.arange(len(size))}))
        # Texts stand one behind the other, so that starts ascend over the block as merge_asof asks.
        covers = [pd.merge_asof(x[["start", "text"]], y, on="start", by="text")["token"].to_numpy(np.int64) for x, y in (frames, frames[::-1])]
        self.cover_a, self.cover_b = covers
        starts = [f["start"].to_numpy() for f in frames]
        self.fresh_a, self.fresh_b = starts[0] == starts[1][covers[0]], starts[1] == starts[0][covers[1]]

    @staticmethod
    def _kept(tokens: Ragged, good: np.ndarray) -> Ragged:
        values, at = tokens
        size = np.diff(at) * good
        return values[np.repeat(good, np.diff(at))], np.concatenate([[0], np.cumsum(size)])

    def per_text(self, flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the A and B token of each link, and the bounds of the texts."""
        late = ~self.fresh_b  # where both starts are one, the other direction has the link
        left = np.concatenate([np.arange(len(self.cover_a)), self.cover_b[late]])
        right = np.concatenate([self.cover_a, np.flatnonzero(late)])
        n = np.diff(self.a[1]) + self.per_text(late, self.b[1])
        owner = np.concatenate([np.repeat(np.arange(len(n)), np.diff(self.a[1])), np.repeat(np.arange(len(n)), np.diff(self.b[1]))[late]])
        order = np.argsort(owner, kind="stable")
        return left[order], right[order], np.concatenate([[0], np.cumsum(n)])

    def groups_text(self) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of every text, and the bounds of the texts."""
        na, nb = len(self.fresh_a), len(self.fresh_b)
        group_a, group_b = np.cumsum(self.fresh_a) - 1, np.cumsum(self.fresh_b) - 1
        first_a, first_b = np.append(np.flatnonzero(self.fresh_a), na), np.append(np.flatnonzero(self.fresh_b), nb)
        follows = np.zeros(na + nb, np.int64)
        at_a, at_b = np.arange(na) + first_b[group_a], np.arange(nb) + first_a[group_b + 1]
        follows[at_a], follows[at_b] = 3 * self.a[0].astype(np.int64), 3 * self.b[0].astype(np.int64)
        follows[at_a[first_a[1:] - 1]] += 1
        follows[at_b[first_b[1:] - 1]] += 2
        ends = np.concatenate([[0], np.cumsum(self.written.length[follows])])
        return self.written.table[follows][self.written.used[follows]].tobytes(), ends[self.a[1] + self.b[1]]


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, a_ids, b_ids, the group of each token (a_groups, b_groups) and the links as
    places of their tokens (link_a, link_b). Null and empty texts, and texts that one of the tokenizers
    does not give back byte for byte, have empty arrays; rows are kept as they come, repeated or without
    an id; an empty table gives no rows; a long text is aligned whole. Other columns are not read."""

    def run(rows: dict) -> dict:
        x = Aligned(rows["text"], path_a, path_b)
        left, right, at = x.links()
        cut = lambda values, bounds: [values[p:q] for p, q in zip(bounds, bounds[1:])]
        place = lambda values, bounds, base: [v - s for v, s in zip(cut(values, bounds), base)]
        groups = [place(np.cumsum(f), s[1], np.concatenate([[0], np.cumsum(f)])[s[1]] + 1) for f, s in ((x.fresh_a, x.a), (x.fresh_b, x.b))]
        return {
            "doc_id": rows["doc_id"], "a_ids": cut(x.a[0].astype(np.int32), x.a[1]), "b_ids": cut(x.b[0].astype(np.int32), x.b[1]),
            "a_groups": groups[0], "b_groups": groups[1], "link_a": place(left, at, x.a[1]), "link_b": place(right, at, x.b[1]),
        }

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, a_groups array<long>, b_groups array<long>, link_a array<long>, link_b array<long>"
    return map_blocks(docs.select("doc_id", "text"), run, schema, arrow=("text",))


_BLOCK = "block string, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, links binary, pairs array<long>, times array<long>"


def _pack(places: np.ndarray) -> bytes:
    """Pairs are numbered by falling frequency, so the high bytes are mostly zero: one plane a byte."""
    planes = places.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per block of documents, bounded in bytes of text: the documents' numbers and digests, the
    block's distinct id pairs with their number of links, and per link the place of its pair."""
    schema = docs.sparkSession.createDataFrame([], _BLOCK).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_TEXT):
                if not block.num_rows:
                    continue
                x = Aligned(block.column("text"), path_a, path_b)
                left, right, at = x.links()
                codes, pairs = pd.factorize(x.a[0][left].astype(np.int64) * PAIR + x.b[0][right])
                times = np.bincount(codes, minlength=len(pairs))
                order = np.argsort(-times, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                raw, cuts = x.groups_text()
                digests = [hashlib.sha256(raw[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(cuts.tolist(), cuts[1:].tolist())]
                row = {
                    "block": uuid.uuid4().hex, "doc_ids": block.column("doc_id").to_pylist(), "n_a": np.diff(x.a[1]), "n_b": np.diff(x.b[1]),
                    "n_groups": x.per_text(x.fresh_a, x.a[1]), "n_links": np.diff(at), "digests": digests, "links": _pack(place[codes]),
                    "pairs": pairs[order], "times": times[order],
                }
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in out], schema=out)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def alignment_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The count of an id pair is the number of links of the whole corpus that hold it; n_best counts the
    links whose pair has the highest count of its B id (ties too), count_sum adds the counts of all
    links. What has no tokens (see aligned_tokens) has zeros and an empty digest; the same rows and edge
    cases as there."""
    kept = materialize(aligned_blocks(docs, path_a, path_b), "aligned")
    own = kept.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = own.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair") % PAIR)
    counts = materialize(counts, "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # a row per id of B's vocabulary at most
    known = counts.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = own.select(F.col("block").alias("of"), "place", "pair").join(known, "pair").select("of", "place", "count", "best")
    out = docs.sparkSession.createDataFrame([], "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").schema

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        if not block.num_rows:
            return schema.empty_table()
        order = found.column("place").to_numpy()
        count, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        count[order], best[order] = found.column("count").to_numpy(), found.column("best").to_numpy()
        links, x = _unpack(block.column("links")[0].as_py()), {n: block.column(n).combine_chunks().flatten() for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests")}
        at = np.concatenate([[0], np.cumsum(x["n_links"].to_numpy())])
        sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(v[links])])[at])) for v in (best, count)]
        return pa.Table.from_arrays([x["doc_ids"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], *sums, x["digests"]], schema=schema)

    rows = kept.select("block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "links")
    return rows.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(finish, out)


def op11_align_tokens(spark: SparkSession, sf_dir: str, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    import public_tokenizers

    a, b = tokenizer_a or public_tokenizers.path("byte_bpe_50k.json"), tokenizer_b or public_tokenizers.path("piece_bpe_32k.model")
    return alignment_counts(table(spark, sf_dir, "documents"), a, b)

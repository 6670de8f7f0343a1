"""Best-fit packing of documents into fixed-length sequences, improved by swap-based local search.

Pieces are dealt by hash into blocks of bounded size. Each block is packed best fit first, then bins
with room exchange documents (a move, one for one, two for one) wherever that raises the sum of
squared fills, until no exchange helps; emptied bins go. The pieces of bins that stay underfull are
dealt into new blocks and packed again, so that room left in one block meets pieces of others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.llm.common import map_blocks, materialize, table
from floodgauge.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of each document's ids with the end id; only documents above ``capacity`` are cut,
    the remainder first. Null text counts as empty and gives one piece, the end id."""

    def block(cols: dict[str, list]) -> dict[str, list]:
        ids, bounds = encoder(path, True).encode(cols["text"], end_id)
        rows = []
        for doc, begin, stop in zip(cols["doc_id"], bounds.tolist(), bounds[1:].tolist()):
            n = stop - begin
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            rows += [(doc, i, a, b - a, zlib.crc32(ids[begin + a : begin + b])) for i, (a, b) in enumerate(pairwise(cuts))]
        pa.default_memory_pool().release_unused()  # else the worker keeps what Arrow needed for the block
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows)))

    return map_blocks(docs.select("doc_id", "text"), block, PIECES, arrow=("text",))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            left, k = capacity - lengths[i], len(bins) - 1
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            left -= lengths[i]
        if left:
            insort(room, (left, k))
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins that raise the sum of squared fills, until none does.

    Fuller bins gain first. A bin A with room g takes from a less filled bin B: an item of at most g;
    or one item for a smaller one; or two items for one. Each exchange moves length from a less to a
    more filled bin or empties B, so the sum rises and the search ends.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    open_bins = {k for k, f in enumerate(fill) if f < capacity}
    holders: dict[int, set[int]] = defaultdict(set)  # length -> open bins that hold such an item
    for k in open_bins:
        for i in bins[k]:
            holders[lengths[i]].add(k)

    def donor(size: int, a: int) -> int | None:
        return min((k for k in holders.get(size, ()) if k != a and 0 < fill[k] <= fill[a]), key=lambda k: (fill[k], k), default=None)

    def item(k: int, size: int) -> int:
        return next(i for i in bins[k] if lengths[i] == size)

    def refresh(*changed: int) -> None:
        for k in changed:
            sizes = {lengths[i] for i in bins[k]} if fill[k] < capacity else set()
            for size in touched:
                (holders[size].add if size in sizes else holders[size].discard)(k)
            if fill[k] >= capacity or not bins[k]:
                open_bins.discard(k)

    queue = sorted(open_bins, key=lambda k: (-fill[k], k))
    while queue:
        again = []
        for a in queue:
            if a not in open_bins:
                continue
            gap, done = capacity - fill[a], False
            options = [(gain, own) for gain in range(gap, 0, -1) for own in (None, *bins[a])]
            for gain, own in options:
                size = gain + (lengths[own] if own is not None else 0)
                b = donor(size, a)
                if b is not None and fill[a] + gain > fill[b]:
                    given = [item(b, size)]
                elif own is not None and (pair := two_for_one(a, size, donor, bins, lengths)):
                    b, given = pair
                else:
                    continue
                touched = {lengths[i] for i in [*bins[a], *bins[b]]}
                for i in given:
                    bins[b].remove(i)
                    bins[a].append(i)
                if own is not None:
                    bins[a].remove(own)
                    bins[b].append(own)
                fill[a] += gain
                fill[b] -= gain
                refresh(a, b)
                done = True
                break
            if done:
                again.append(a)
        queue = sorted((k for k in again if k in open_bins), key=lambda k: (-fill[k], k))
    return [b for b in bins if b]


def two_for_one(a: int, size: int, donor, bins: list[list[int]], lengths: list[int]) -> tuple[int, list[int]] | None:
    """Two items of one less filled bin that together have ``size``."""
    for first in {lengths[i] for i in bins[a] if lengths[i] < size}:
        b = donor(size - first, a)
        if b is not None:
            one = next(i for i in bins[b] if lengths[i] == size - first)
            other = next((i for i in bins[b] if i != one and lengths[i] == first), None)
            if other is not None:
                return b, [one, other]
    return None


def pack_blocks(pieces: DataFrame, n_blocks: int, capacity: int, round_no: int) -> DataFrame:
    schema = f"{PIECES}, salt long, sequence_id long, offset long, fill int"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=False, ignore_index=True)
        lengths = pdf["length"].tolist()
        base = (round_no << 56) | (int(pdf["block"].iloc[0]) << 24)
        seq, off, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int32)
        for k, members in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = base | k, at
                at += lengths[i]
            fill[members] = at
        return pdf.drop(columns="block").assign(sequence_id=seq, offset=off, fill=fill)

    block = F.pmod(F.xxhash64("salt", F.lit(round_no)), F.lit(n_blocks))
    return pieces.withColumn("block", block).groupBy("block").applyInPandas(pack, schema)


def block_count(n: int, block_pieces: int, least_blocks: int = 64) -> int:
    """Blocks of at most about ``block_pieces``; small inputs still make up to ``least_blocks``, to
    occupy more tasks in all rounds but the last."""
    return max(-(-n // block_pieces), min(least_blocks, -(-n // 500)), 1)


def pack_sequences(
    docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2, block_pieces: int = 20_000, rounds: int = 2
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Offsets within a sequence are gapless from 0. Repeated rows are packed as documents of their own,
    a null doc_id as any other, an empty table gives no rows; a very long text is cut into pieces like
    any above the capacity. Strings of special tokens are coded as the library codes them. Only doc_id
    and text are read.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    # The salt deals pieces into blocks: the doc_id would not, where many rows share one or have none.
    pieces = materialize(token_pieces(docs, path, capacity, end_id).withColumn("salt", F.monotonically_increasing_id()), "pieces")
    columns = pieces.columns
    done = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.col("salt")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    for round_no in range(1, rounds + 1):
        packed = pack_blocks(rest, block_count(rest.count(), block_pieces, 64 if round_no < rounds else 1), capacity, round_no)
        if round_no < rounds:
            packed = materialize(packed, "packed")
            full = F.col("fill") >= capacity
            rest = packed.where(~full).select(*columns)
            packed = packed.where(full)
        done = done.unionByName(packed.drop("fill"))
    return done.drop("salt")


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"))

"""Near-duplicate groups: MinHash with banding, signature verification, exact confirmation on full
shingle sets, and connected components by alternating large-star and small-star.

Documents with equal shingle sets form one class, represented by its smallest doc_id; only the
representatives are compared. Every band key is a bucket. Its members are paired with two hubs (the
smallest and one drawn by hash), never all with all. Pairs pass the signature estimate and then the
full sets. Buckets whose members lie in several components after that are searched on the full sets for
the links that the choice of hubs lost: a bucket of one block in one task, which returns at most a
spanning forest; the members of larger ones by their rarest shingles, of which two sets as similar as
that must share one among the first few. No group is expanded into its pairs.

Signatures keep one byte of each minimum, sets 32 bits of each shingle's hash. Joins against whole
tables always shuffle, so that the plan is the same at every size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.llm.common import map_blocks, materialize, table

BANDS, ROWS = 30, 6
HASHES = BANDS * ROWS
#: Standard deviations by which a signature may underestimate; members and shingles of one block.
SLACK, BLOCK, BLOCK_SHINGLES = 5.0, 256, 2_000_000
KNOWN_WORDS, CHUNK = 150_000, 1 << 15


@lru_cache(maxsize=1)
def _universal() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the universal hash functions x -> (a x + b mod 2^64) >> 32."""
    rng = np.random.default_rng(20240101)
    return rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, np.uint64)


class _Words(dict):
    """Word to 64-bit hash, kept for words seen in this worker process (bounded)."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of the whole text; with fewer
    words one of the whole sequence; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of all hash functions for each (non-empty) set."""
    a, b = _universal()
    out = np.empty((len(sets), HASHES), np.uint32)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[start:end])
        cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : end - 1]], dtype=np.int64)]).astype(np.int64)
        for i in range(HASHES):
            out[start:end, i] = np.minimum.reduceat(x * a[i] + b[i], cuts) >> np.uint64(32)
        start = end
    return out


def features(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, keys of the bands, signature and set (null without
    shingles)."""

    def block(cols: dict[str, list]) -> dict[str, list]:
        import xxhash

        sets = [shingle_set(t, size) for t in cols["text"]]
        full = [s for s in sets if len(s)]
        minima = signatures(full) if full else np.zeros((0, HASHES), np.uint32)
        keys = np.zeros((len(full), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(full), band + 1, np.uint64)
            for column in range(band * ROWS, (band + 1) * ROWS):
                key = (key ^ minima[:, column]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys[:, band] = key
        at = iter(range(len(full)))
        index = [next(at) if len(s) else None for s in sets]
        return {
            "doc_id": cols["doc_id"],
            "n_shingles": [len(s) for s in sets],
            "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "bands": [None if i is None else keys[i].view(np.int64) for i in index],
            "signature": [None if i is None else minima[i].astype(np.uint8).tobytes() for i in index],
            "shingles": [None if i is None else s.astype(np.uint32).view(np.int32) for i, s in zip(index, sets)],
        }

    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary, shingles array<int>"
    return map_blocks(docs.select("doc_id", "text"), block, schema)


def _pairs(low, high) -> list:
    return [F.least(low, high).alias("lo"), F.greatest(low, high).alias("hi")]


def hub_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's two hubs."""
    both = members.select("rep", F.explode(F.array("first", "drawn")).alias("hub")).where("rep <> hub")
    return both.select(*_pairs(F.col("rep"), F.col("hub"))).distinct()


def matches_needed(similarity: float) -> int:
    """Least number of equal signature bytes that a pair of this similarity can be expected to show."""
    return int(np.floor(HASHES * similarity - SLACK * np.sqrt(HASHES * similarity * (1 - similarity))))


def signature_filter(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose signatures agree often enough for the similarity to be possible."""
    need = matches_needed(similarity)

    def block(cols: dict[str, list]) -> dict[str, list]:
        keep = [np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) >= need for a, b in zip(cols["sig_lo"], cols["sig_hi"])]
        return {c: [v for v, k in zip(cols[c], keep) if k] for c in ("lo", "hi")}

    lo, hi = (reps.select(F.col("rep").alias(c), F.col("signature").alias(f"sig_{c}")).hint("merge") for c in ("lo", "hi"))
    joined = pairs.join(lo, "lo").join(hi, "hi")
    return map_blocks(joined.select("lo", "hi", "sig_lo", "sig_hi"), block, "lo long, hi long", text=None)


def sets_of(base: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and shingles of the given documents."""
    return base.select("doc_id", "shingles").join(ids.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def confirm(pairs: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full shingle sets."""
    sets = materialize(sets_of(base, pairs.select(F.explode(F.array("lo", "hi")).alias("doc_id")).distinct()), "sets")
    lo, hi = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}")).hint("merge") for c in ("lo", "hi"))
    shared = F.size(F.array_intersect("set_lo", "set_hi"))
    union = F.size("set_lo") + F.size("set_hi") - shared
    return pairs.join(lo, "lo").join(hi, "hi").where(100 * shared.cast("long") >= percent * union.cast("long")).select("lo", "hi")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (lo, hi): the smallest node reachable.

    Alternating large-star and small-star; each round is written to the shared folder. Hubs are met
    by an aggregate and an equi-join, which adaptive execution splits where one hub is hot.
    """
    edges = materialize(edges.select(F.greatest("lo", "hi").alias("u"), F.least("lo", "hi").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, as sums of products of their
    incidence matrices over ``width`` shared shingles at a time."""
    sets = [*left, *right]
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = np.cumsum(counts > 1) - 1
    used = counts[column] > 1
    row, column = row[used], place[column[used]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(place[-1]) + 1, width):
        a, b = np.searchsorted(column, (start, start + width))
        incidence = np.zeros((len(sets), width), np.float32)
        incidence[row[a:b], column[a:b] - start] = 1
        out += incidence[: len(left)] @ incidence[len(left) :].T
    return out


def forest(reps: list[int], others: list[int], own: list[int], theirs: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join components not yet joined by earlier ones."""
    parent: dict[int, int] = {}

    def find(c: int) -> int:
        while (p := parent.setdefault(c, c)) != c:
            parent[c] = parent.setdefault(p, p)
            c = p
        return c

    out = []
    for x, y in zip(*np.nonzero(linked)):
        a, b = find(own[x]), find(theirs[y])
        if a != b:
            parent[a] = b
            out.append((min(reps[x], others[y]), max(reps[x], others[y])))
    return out


def blocks_of(members: Column, shingles: Column) -> Column:
    """Blocks that a group is dealt into, so that one is bounded in members and in shingles."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def compared(groups: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """Links between components within groups (key, rep, component, n blocks), on full sets: each pair
    of blocks is one task's group of bounded size, and gives at most a spanning forest."""
    own, n = F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"), F.col("n")
    pairs = groups.select("key", "rep", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    pairs = pairs.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return _compare(pairs.withColumns({"left": F.col("own") == F.col("i"), "right": F.col("own") == F.col("j")}), base, percent)


def probed(groups: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """Links between the ``short`` members and all members of groups (key, rep, component, short, n blocks
    of all, n_short blocks of the short ones), as compared() finds them: members that are not short are
    not compared with each other."""
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    asked = F.transform(every("n_short"), lambda i: cell(i, own("n"), False))
    asking = F.when(F.col("short"), F.transform(every("n"), lambda j: cell(own("n_short"), j, True)))
    cells = F.explode(F.concat(asked, F.coalesce(asking, F.array().cast("array<struct<i:int,j:int,left:boolean>>"))))
    pairs = groups.select("key", "rep", "component", cells.alias("c")).select("key", "rep", "component", "c.*")
    return _compare(pairs.withColumn("right", ~F.col("left")), base, percent)


def _compare(pairs: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """Links between the left and the right rows of each cell (key, i, j)."""
    sets = sets_of(base, pairs.select(F.col("rep").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "rep")
    dealt = pairs.select("key", "rep", "component", "i", "j", "left", "right").join(sets.hint("merge"), "rep")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["left"]], pdf[pdf["right"]]
        out: list[tuple[int, int]] = []
        if len(left) and len(right) and pdf["component"].nunique() > 1:
            a, b = ([np.asarray(s, np.int32).view(np.uint32) for s in side["shingles"]] for side in (left, right))
            shared = overlaps(a, b)
            union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - shared
            ca, cb = left["component"].to_numpy(), right["component"].to_numpy()
            linked = (100 * shared >= percent * union) & (ca[:, None] != cb[None, :])
            out = forest(left["rep"].tolist(), right["rep"].tolist(), ca.tolist(), cb.tolist(), linked)
        return pd.DataFrame(out, columns=["lo", "hi"]).astype("int64")

    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "lo long, hi long")


def rare_entries(docs: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each document (rep, component): token, rep, component, size, short.

    In one order of all shingles, rarest first, two sets that are similar enough share one among the
    first size - ceil(percent / 100 size) + 1 of the larger and, ``short``, among the first
    size - ceil(2 percent / (100 + percent) size) + 1 of the smaller."""
    sets = sets_of(base, docs.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep")
    tokens = materialize(docs.join(sets.hint("merge"), "rep").select("rep", "component", F.explode("shingles").alias("token")), "tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    counted = tokens.join(often.hint("merge"), "token").groupBy("rep", "component").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("order"))
    size = F.size("order")
    probe = size - F.ceil(size * percent / 100) + 1
    short = size - F.ceil(size * 2 * percent / (100 + percent)) + 1
    first = counted.select("rep", "component", size.alias("size"), short.alias("shorter"), F.posexplode(F.slice("order", F.lit(1), probe.cast("int"))).alias("at", "t"))
    return first.where("t.often > 1").select(F.col("t.token").alias("token"), "rep", "component", "size", (F.col("at") < F.col("shorter")).alias("short"))


def rare_links(docs: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """Links between components among ``docs`` (rep, component), by pairs that share a rare shingle. A
    shingle without a short entry makes none; one that is rare for more documents than a block holds makes
    blocks of its short entries and of all instead of pairs."""
    entries = materialize(rare_entries(docs, base, percent), "rare")
    held = entries.groupBy("token").agg(
        blocks_of(F.count(F.lit(1)), F.sum("size")).alias("n"), blocks_of(F.count_if("short"), F.sum(F.when(F.col("short"), F.col("size")))).alias("n_short"),
        (F.min("component") != F.max("component")).alias("mixed"),
    ).where("mixed AND n_short > 0")
    listed = materialize(entries.join(held.hint("merge"), "token"), "listed")
    large = probed(listed.where("n > 1").select(F.col("token").cast("long").alias("key"), "rep", "component", "short", "n", "n_short"), base, percent)
    few = listed.where("n = 1")
    x, y = few.select("token", *[F.col(c).alias(f"x_{c}") for c in ("rep", "component", "size")]), few.where("short").select("token", *[F.col(c).alias(f"y_{c}") for c in ("rep", "component", "size")])
    fits = "x_component <> y_component AND 100 * y_size >= {0} * x_size AND (y_size < x_size OR y_size = x_size AND y_rep < x_rep)".format(percent)
    pairs = x.join(y.hint("merge"), "token").where(fits).select(*_pairs(F.col("x_rep"), F.col("y_rep"))).distinct()
    return large.union(confirm(materialize(pairs, "rare_pairs"), base, percent))


def residual_links(members: DataFrame, labels: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """Links between components within buckets of three members or more, on full sets."""
    large = members.where("m > 2").select("key", "rep", blocks_of(F.col("m"), F.col("weight")).alias("n"))
    labelled = materialize(large.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled")
    mixed = materialize(labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key"), "mixed")
    wanted = materialize(labelled.join(mixed.hint("merge"), "key"), "wanted")
    small = materialize(compared(wanted.where("n = 1"), base, percent), "small")
    return small.union(rare_links(wanted.where("n > 1").select("rep", "component").distinct(), base, percent)).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Links have 100 * intersection >= percent * union over ``size``-word shingles, words lower-cased in
    A-Z. Null and empty texts have no shingles and stay alone. A doc_id names one text: rows repeated
    under it share its component; a null doc_id is kept and linked with nothing. An empty table gives
    no rows; a very long text is one set, whole. Columns other than doc_id and text are not read.
    """
    base = materialize(features(docs, size), "features")
    linked = base.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    best = F.min(F.struct("doc_id", "n_shingles", "bands", "signature")).alias("best")
    reps = materialize(linked.groupBy("digest").agg(best).select("digest", F.col("best.doc_id").alias("rep"), "best.n_shingles", "best.bands", "best.signature"), "reps")
    entries = reps.select("rep", "n_shingles", F.explode("bands").alias("key"))
    drawn = F.min(F.struct(F.xxhash64("rep", "key"), F.col("rep").alias("rep")))
    hubs = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("weight"), F.min("rep").alias("first"), drawn["rep"].alias("drawn")).where("m > 1")
    # Written first, so that both sides of the join are plain shuffles and a hot bucket can be split.
    members = materialize(entries.drop("n_shingles").join(materialize(hubs, "hubs").hint("merge"), "key"), "members")
    tried = materialize(signature_filter(hub_pairs(members), reps, percent / 100), "pairs")
    edges = materialize(confirm(tried, base, percent), "links")
    labels = materialize(connected_components(edges), "labels")
    more = materialize(residual_links(members, labels, base, percent), "more")
    if not more.isEmpty():
        labels = connected_components(edges.union(more))
    groups = reps.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = base.select("doc_id", "n_shingles", "digest").join(groups, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)

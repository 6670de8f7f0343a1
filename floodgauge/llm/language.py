"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is its letters in lower case, everything else one space; its subwords are the character 2-, 3-
and 4-grams, hashed into a table of embeddings, averaged over the whole text. Training takes a bounded
sample of labelled documents; part of it is set aside to calibrate the scores (temperature) and the
score below which a document is rejected. So is a document with more subwords unseen in training than
documents of the sample have that no other of it holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodgauge.llm.common import map_blocks, table

BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
UNKNOWN = "und"
#: Slots of the subwords seen in training; subwords of the common share that a text's own are mixed with.
SLOTS, PRIOR = 1 << 20, 50
#: What the quantiles are eased by, as few documents give them.
SLACK = 0.5
#: Inverse temperatures tried.
SCALES = np.geomspace(0.1, 1000, 161)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def hashes(text: str) -> np.ndarray:
    """Hashes of all grams of the whole text; empty where it has no letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a word stands for the space
    codes = np.concatenate([[32], np.where(letter, codes, 32)[keep], [32]]).astype(np.uint32)
    out = []
    for n in GRAMS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            out.append(h)
    return np.concatenate(out)


def subwords(text: str) -> np.ndarray:
    """Buckets of all grams of the whole text; empty where it has no letters."""
    return (hashes(text) % np.uint32(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    classes: list[str]
    table: np.ndarray  # BUCKETS x classes: embeddings times softmax weights
    bias: np.ndarray
    scale: float  # inverse temperature
    reject_below: float
    seen: np.ndarray  # SLOTS: grams of the training texts
    usual: float  # share of unseen grams in documents of the learned languages
    reject_above: float

    def scores(self, grams: np.ndarray) -> np.ndarray:
        z = self.scale * (self.table[grams].mean(axis=0) + self.bias)
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        h = hashes(text or "")
        if not len(h) or not self.classes:
            return UNKNOWN, 0.0, True
        p = self.scores((h % np.uint32(BUCKETS)).astype(np.int64))
        known = np.count_nonzero(self.seen[h % np.uint32(SLOTS)])
        rejected = p.max() < self.reject_below or mixed(len(h) - known, len(h), self.usual) > self.reject_above
        return self.classes[int(p.argmax())], float(p.max()), bool(rejected)


def mixed(unseen: int, n: int, usual: float) -> float:
    """Share of unseen grams; of short texts, which say little, nearer to the usual share."""
    return (unseen + PRIOR * usual) / (n + PRIOR)


def seen_grams(texts: list[str]) -> tuple[np.ndarray, float, list[float]]:
    """(slots of the grams of all texts, usual share of unseen grams, mixed share of each text); unseen
    in a text is what no other holds."""
    slots = lambda t: hashes(t) % np.uint32(SLOTS)
    holders = np.zeros(SLOTS, np.uint8)  # texts that hold a slot: none, one or more
    for t in texts:
        own = np.unique(slots(t))
        holders[own] = np.minimum(holders[own] + 1, 2)
    counts = [(int(np.count_nonzero(holders[g] < 2)), len(g)) for g in map(slots, texts)]
    usual = sum(u for u, _ in counts) / sum(n for _, n in counts)
    return holders > 0, usual, [mixed(u, n, usual) for u, n in counts]


def fit(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 7, tolerance: float = 0.001) -> Model:
    """``tolerance``: the share of calibration documents that rejection may lose."""
    classes = sorted(set(langs))
    bags, used = [], []  # of each text its distinct buckets, their shares and its class, and the text; grams are not kept
    for text, lang in zip(texts, langs):
        grams = subwords(text)
        if len(grams):
            ids, counts = np.unique(grams, return_counts=True)
            bags.append((ids.astype(np.uint16), (counts / len(grams)).astype(np.float32), classes.index(lang)))
            used.append(text)
    if not bags:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros(SLOTS, bool), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held = max(1, len(bags) // 5) if len(bags) >= 10 else 0
    train, check = order[held:], order[:held] if held else order
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, bias = rng.normal(0, 0.1, (DIM, len(classes))), np.zeros(len(classes))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, share, y = bags[i]
            share = share[:, None]
            rows_e = emb[ids]
            v = (rows_e * share).sum(axis=0)
            z = v @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - done / steps)
            back = w @ p
            w -= step * np.outer(v, p)
            bias -= 0.1 * step * p
            emb[ids] = rows_e - step * 20 * share * back
            done += 1
    flat = (emb @ w).astype(np.float32)
    z = np.array([(flat[ids] * share[:, None]).sum(axis=0) + bias for ids, share, _ in (bags[i] for i in check)])
    y = np.array([bags[i][2] for i in check])

    def chances(s: float) -> np.ndarray:
        e = np.exp(s * (z - z.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)

    # Each document counts for its label but for a share that few documents cannot rule out; so the best
    # temperature is a finite one even where all of them are told apart.
    doubt = 1 / (len(y) + 2)
    target = np.full(z.shape, doubt / max(1, len(classes) - 1))
    target[np.arange(len(y)), y] = 1 - doubt
    scale = float(min(SCALES, key=lambda s: -(target * np.log(chances(s) + 1e-300)).sum(axis=1).mean()))
    least = float(np.quantile(chances(scale).max(axis=1), tolerance))
    seen, usual, shares = seen_grams(used)
    return Model(classes, flat, bias, scale, least * SLACK, seen, usual, float(np.quantile(shares, 1 - tolerance)) / SLACK)


def draw_bound(wanted: int, n: int) -> int:
    """The 63-bit hash below which about ``wanted`` of ``n`` rows fall; at least 1."""
    return min(2**63 - 1, max(1, 2**63 * wanted // max(1, n)))


def draw(known: DataFrame, sample: int, sample_bytes: int, longest: int) -> DataFrame:
    """At most ``sample`` rows and ``sample_bytes`` bytes of text, the same number of each language, by
    a hash of doc_id and text; texts of over ``longest`` bytes are not drawn."""
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return known.limit(0)
    each = max(1, sample // len(counts))
    order = F.xxhash64("doc_id", "text", F.lit(11)).bitwiseAND(F.lit(2**63 - 1))
    wanted = F.lit(False)
    for lang, n in sorted(counts.items()):
        wanted = wanted | ((F.col("lang") == lang) & (F.col("_draw") < F.lit(draw_bound(2 * each, n))))
    few = known.where(F.octet_length("text") <= longest).withColumn("_draw", order).where(wanted)
    w = Window.partitionBy("lang").orderBy("_draw", "doc_id")
    few = few.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= each)  # the exact bound, also where rows repeat
    size = F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("_bytes", size).where(F.col("_bytes") <= max(longest, sample_bytes // len(counts))).drop("_draw", "_k", "_bytes")


def train(docs: DataFrame, sample: int = 2000, sample_bytes: int = 64 << 20, longest: int = 1 << 20) -> Model:
    """Fit on a sample of labelled documents outside the held-out third, bounded in rows and bytes as
    draw() says: it goes to the driver."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != 1))
    rows = draw(known, sample, sample_bytes, longest).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    Null texts and texts without letters are ``und`` with score 0 and rejected. A null doc_id is not
    held out. Rows are independent, repeated ones give repeated rows; an empty table gives no rows; a
    very long text is read whole. Columns other than doc_id and text are not read.
    """

    def block(cols: dict[str, list]) -> dict[str, list]:
        lang, score, rejected = zip(*[model.predict(t) for t in cols["text"]]) if cols["text"] else ((), (), ())
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": list(lang), "score": list(score), "rejected": list(rejected)}

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    source = docs.select("doc_id", held.alias("held_out"), "text")
    return map_blocks(source, block, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents that the model rejects."""
    columns = docs.columns

    def block(cols: dict[str, list]) -> dict[str, list]:
        keep = [not model.predict(t)[2] for t in cols["text"]]
        return {c: [v for v, k in zip(cols[c], keep) if k] for c in columns}

    return map_blocks(docs, block, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))

"""Ranked lexical search, term at a time with a limited set of accumulators.

The terms of an item are taken rarest first, in rounds whose postings grow by a constant factor. Each
round adds its contributions to accumulators, one per (item, document), and brings the k leading ones of
each item up to date. Once the bounds of the terms that remain add up to less than the k-th of those
scores, no new document can enter the item's list: the item is closed, accumulators that can no longer
reach that score go, and those left get the contributions of the remaining terms exactly, by (document,
term). So the long lists of frequent terms are never multiplied by the items that hold them.

One pass over the texts writes the postings of the terms that items hold; all rounds read those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodgauge.llm.common import blocks, materialize, table

#: Bytes of a term become themselves (A-Z in lower case), all others a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
PAIR = ["item", "row", "doc_id"]
_COUNTED = "row long, id long, n long, term string, tf long"


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(terms of each text, text, term and count of each distinct term of a text)."""
    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    raw = memoryview(texts.buffers()[2] or b"")[at[0] : at[-1]].tobytes().translate(_BYTES)
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(raw))
    lists = pc.split_pattern(clean, " ")
    coded = lists.flatten().dictionary_encode()
    index, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    keep = real[index] if len(index) else np.zeros(0, bool)
    index, owner = index[keep].astype(np.int64), owner[keep]
    pairs, count = np.unique(owner * max(1, len(coded.dictionary)) + index, return_counts=True)
    doc, term = np.divmod(pairs, max(1, len(coded.dictionary)))
    return np.bincount(owner, minlength=len(texts)), doc, coded.dictionary.take(pa.array(term)), count


def counted(rows: DataFrame, name: str) -> DataFrame:
    """row (a number of the input row), id, n, term, tf: one row per distinct term of each text, and
    one with the empty term for the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in blocks(batch, "text"):
                n, doc, term, count = term_counts(block.column("text"))
                every = np.concatenate([np.arange(len(n)), doc])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every + row), block.column("id").take(pa.array(every)), pa.array(n[every].astype(np.int64)),
                     pa.concat_arrays([pa.array([""] * len(n), pa.string()), term]), pa.array(np.concatenate([np.zeros(len(n), np.int64), count.astype(np.int64)]))],
                    names=["row", "id", "n", "term", "tf"],
                )
                row += len(n)

    return rows.select(F.col(name).cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _COUNTED)


def _top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


class Postings:
    """Postings of the items' terms, and what scores are made of."""

    def __init__(self, docs: DataFrame, items: DataFrame):
        asked = materialize(counted(items, "item_id").where("term <> ''").select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term", F.col("tf").alias("times")), "asked")
        terms = materialize(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("term_id")), "terms")
        # Terms of no item go at once; the row of the empty term stays for every document.
        held = counted(docs, "doc_id").join(terms, "term", "left").where("term = '' OR term_id IS NOT NULL")
        self.rows = materialize(held.select("row", F.col("id").alias("doc_id"), "n", "term_id", "tf"), "postings")
        total = self.rows.where("term_id IS NULL").agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.n_docs, self.n_terms = int(total[0]), max(1, int(total[1]))
        self.asked = asked.join(terms, "term")

    def impacts(self) -> DataFrame:
        m = F.lit(75) + F.expr(f"(25 * n * {self.n_docs}L) DIV {self.n_terms}L")
        held = self.rows.where("term_id IS NOT NULL").withColumn("m", m)
        return held.select("row", "doc_id", "term_id", F.expr("(1000000000L * tf) DIV (1000 * tf + 12 * m)").alias("impact"))

    def plan(self, first: int, growth: int) -> DataFrame:
        """item, item_id, term_id, weight (of an occurrence's impact), bound, round: round 0 has the
        rarest terms, up to ``first`` postings and one term at least; each later one ``growth`` times
        the postings of all before it."""
        held = self.impacts().groupBy("term_id").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("most"))
        w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * self.n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
        rows = self.asked.join(held, "term_id").withColumn("weight", w * F.col("times"))
        before = Window.partitionBy("item").orderBy("df", "term_id")
        size = F.sum("df").over(before) / F.lit(first)
        step = F.when(size <= 1, 0).otherwise(F.ceil(F.log(size) / F.log(F.lit(float(growth))))).cast("int")
        step = F.when(F.row_number().over(before) == 1, 0).otherwise(step)
        return materialize(rows.select("item", "item_id", "term_id", "weight", (F.col("weight") * F.col("most")).alias("bound"), step.alias("round")), "plan")


def _completed(partial: DataFrame, plan: DataFrame, impacts: DataFrame) -> DataFrame:
    """Whole scores: to the partial ones come the contributions of the rounds after theirs, each asked
    for by (document, term)."""
    wanted = partial.join(plan.select("item", "term_id", "weight", "round"), "item").where("round > after").select(*PAIR, "term_id", "weight")
    more = wanted.join(impacts.drop("doc_id"), ["row", "term_id"]).select(*PAIR, (F.col("weight") * F.col("impact")).alias("score"))
    return partial.select(*PAIR, "score").unionByName(more).groupBy(*PAIR).agg(F.sum("score").alias("score"))


def _able(partial: DataFrame, state: DataFrame) -> DataFrame:
    """Accumulators that can still reach the score in ``least``; the others go for good, whether the item
    is closed or not."""
    return partial.join(state.select("item", "rest", "least"), "item").where(F.col("score") + F.col("rest") >= F.col("least")).select(*PAIR, "score")


def _state(plan: DataFrame, impacts: DataFrame, partial: DataFrame, bounds: DataFrame, step: int, k: int) -> DataFrame:
    """item, rest (bound of the terms after ``step``), least (a score that ``k`` documents reach: the
    leading accumulators are brought up to date first), closed."""
    leaders = materialize(_top(partial, k, F.desc("score")).select(*PAIR, "score", F.lit(step).alias("after")), "leaders")
    rows = materialize(leaders.select("row").distinct(), "leading-rows")
    whole = _completed(leaders, plan, impacts.join(rows, "row", "left_semi"))
    best = whole.groupBy("item").agg(F.min("score").alias("now"), F.count(F.lit(1)).alias("got")).where(F.col("got") >= k)
    fields = bounds.join(best, "item", "left").select("item", "rest", F.greatest("least", F.coalesce("now", F.lit(0))).alias("least"))
    return materialize(fields.withColumn("closed", F.col("rest") < F.col("least")), "state")


def search(docs: DataFrame, items: DataFrame, k: int = 20, first: int = 2000, growth: int = 4) -> DataFrame:
    """The ``k`` best documents of each row of ``items``: item_id, rank, doc_id, score.

    Terms are maximal runs of ASCII letters and digits and all other characters beyond ASCII, A-Z in
    lower case. Equal scores go by ascending doc_id (none last); scores of 0 are left out. Null and empty
    texts have no terms: such items have no rows, such documents do not count. Each row is an item or a
    document of its own, repeated or without an id. Empty tables give no rows. Columns other than
    doc_id, item_id and text are not read. ``first`` and ``growth`` cut the rounds; they change no result.
    """
    postings = Postings(docs, items)
    plan = postings.plan(first, growth)
    impacts, last = postings.impacts(), plan.agg(F.max("round")).first()[0]
    state = plan.select("item", F.lit(0).cast("long").alias("least")).distinct()
    partial, survivors = docs.sparkSession.createDataFrame([], "item long, row long, doc_id long, score long"), []
    for step in range(-1 if last is None else last + 1):
        terms = plan.where(F.col("round") == step).join(state, "item", "left_semi")
        new = impacts.join(terms.select("item", "term_id", "weight"), "term_id").select(*PAIR, (F.col("weight") * F.col("impact")).alias("score"))
        added = partial.unionByName(new).groupBy(*PAIR).agg(F.sum("score").alias("score"))
        rest = plan.where(F.col("round") > step).groupBy("item").agg(F.sum("bound").alias("rest"))
        state = materialize(state.join(rest, "item", "left").select("item", F.coalesce("rest", F.lit(0)).alias("rest"), "least"), "bounds")
        partial = materialize(_able(added, state), "accumulators")
        state = _state(plan, impacts, partial, state, step, k)
        alive = _able(partial, state)
        survivors.append(materialize(alive.join(state.where("closed"), "item", "left_semi").withColumn("after", F.lit(step)), "survivors"))
        state = state.where("NOT closed").select("item", "least")
        partial = alive.join(state, "item", "left_semi")
        if state.isEmpty():
            break
    whole = partial.withColumn("after", F.lit(-1 if last is None else last))
    for part in survivors:
        whole = whole.unionByName(part)
    full = _completed(whole, plan, impacts).where("score > 0")
    best = _top(full, k, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    return best.join(plan.select("item", "item_id").distinct(), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPLIT}'), lambda t: t <> '')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS times FROM i GROUP BY ALL),
whole AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) x GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df CROSS JOIN whole),
scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN weights USING (term) JOIN tf USING (term) CROSS JOIN whole
  GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

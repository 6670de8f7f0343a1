"""Exact deduplication as a tree-merge of sorted digest runs, in DataFrame functions only.

Documents are dealt into ``runs`` runs, each a list sorted by digest that holds, per digest, the best
row and a count. Runs then meet in rounds over a binomial tree: in each round ``radix`` neighbouring
runs cut their lists at the same digest bits, exchange the slices, and each partner merges the slices it
receives into one sorted run, keeping the smallest verified identifier of equal digests. After
log_radix(runs) rounds every run holds one slice of all digests, each once. The decisions walk the same
tree down again. So the number of partners stays ``runs`` in every round, and a digest that a third of
all rows share meets at most ``radix`` rows per key at any level above the documents.

Rows agree when two independent hashes of the normalised text and its length agree (the verification
kept beside every identifier). Every level is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.llm.common import materialize, table

WHITESPACE = " \t\n\x0b\x0c\r"
KEY = ["digest", "verify"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def digest_runs(docs: DataFrame, runs: int) -> DataFrame:
    """(doc_id, digest, verify, chars, run), the narrow table that everything after works on."""
    text = normalised(F.col("text"))
    return docs.select(
        "doc_id",
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.xxhash64(text, F.length(text)).alias("verify"),
        F.length(F.coalesce("text", F.lit(""))).alias("chars"),
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).alias("run"),
    )


def merged_runs(level: DataFrame, best: Column, n: Column, slot: Column, name: str) -> DataFrame:
    """One round: rows go to the partner that ``slot`` names, which merges them as one sorted run, one
    row per digest and run number."""
    dealt = level.withColumn("slot", slot).repartition("slot").sortWithinPartitions("slot", "run", *KEY)
    return materialize(dealt.groupBy("slot", "run", *KEY).agg(best.alias("best"), n.alias("n")).drop("slot"), name)


def exact_duplicates(docs: DataFrame, runs: int = 4096, radix: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty and so all empty and null texts form one group. The longest original
    text stays, then the smallest doc_id; a null doc_id loses to any other. Repeated rows of one
    doc_id share its decision and each count in group_size. An empty table gives no rows; a very long
    text is one digest like any other. Columns other than doc_id and text are ignored, whatever their
    names. ``runs`` is a power of ``radix``.
    """
    base = materialize(digest_runs(docs, runs), "digests")
    best = F.struct((-F.col("chars")).alias("rank"), F.col("doc_id").isNull().alias("missing"), F.col("doc_id"))
    levels = [merged_runs(base, F.min(best), F.count(F.lit(1)), F.col("run"), "runs")]
    width, slices = runs, 1
    while width > 1:
        width, slices = width // radix, slices * radix
        # Partner: the number of the merged run, and the slice of the digests that it takes.
        parent = levels[-1].withColumn("run", F.expr(f"run DIV {radix}"))
        slot = F.col("run") * slices + F.pmod(F.col("verify"), F.lit(slices))
        levels.append(merged_runs(parent, F.min("best"), F.sum("n"), slot, "runs"))
    # Down the tree: a single text needs no message, so only digests with copies travel.
    up = F.expr(f"run DIV {radix}")
    down = levels[-1].where("n > 1").select(*KEY, F.col("run").alias("up"), F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    for lower in levels[-2::-1]:
        down = lower.select(*KEY, "run", up.alias("up")).join(down, [*KEY, "up"]).select(*KEY, F.col("run").alias("up"), "keep_id", "group_size")
    out = base.withColumnRenamed("run", "up").join(down, [*KEY, "up"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS kept,
       text_sha256
FROM t
"""

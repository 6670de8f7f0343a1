"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``window`` consecutive hashes of ``gram`` words the smallest is kept (the rightmost of equal
ones), in documents and in benchmark items alike, so that two texts that share ``gram + window - 1``
words share a kept hash at the same place of the span. Kept hashes of documents meet those of the items
in an equi-join; each meeting names a diagonal (document position less item position), and the words on
it are compared, so that a hash collision never counts.

An item of fewer words than the span is one window of its own; items of each such length are a class
with a gram and a window that add up to it. Only classes that the items have are fingerprinted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodgauge.llm.common import materialize, table

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A kept hash and its place in one number: 32 bits of the hash above 31 bits that fall with the place.
PLACE_BITS, PLACES = 31, (1 << 31) - 1
KEY = ["k1", "k2"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), "")


def word_hashes(text: Column) -> Column:
    """xxhash64 of each of words_of(text). Cut first: words of ASCII then take the fast lower()."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), CASED_SPLIT), "")
    plain = lambda w: F.octet_length(w) == F.length(w)
    return F.transform(words, lambda w: F.xxhash64(F.when(plain(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))))


def _shape(length: int, gram: int) -> tuple[int, int]:
    """Gram and window for spans of ``length`` words."""
    return min(gram, length), length - min(gram, length) + 1


def kept_hashes(rows: DataFrame, length: int, gram: int, own: bool) -> DataFrame:
    """A row for each kept hash of the array ``hashes`` (of words): its columns, and length, hash, place.
    ``own`` adds a row of length 0 for the row itself.

    The array is computed once a row, below the generator; the grams of a window and of the one before
    it are compiled arithmetic on the array, and a window is kept where its smallest gram is another."""
    k, w = _shape(length, gram)
    count = F.size("hashes") - F.lit(length)
    starts = F.when(count >= 0, F.sequence(F.lit(0), count)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("at", F.explode(F.concat(starts, F.array(F.lit(-1))) if own else starts))

    def packed(j: int) -> Column:
        whole = F.xxhash64(*[F.get("hashes", F.col("at") + j + i) for i in range(k)])
        return F.shiftleft(whole.bitwiseAND(F.lit(0xFFFFFFFF)), PLACE_BITS).bitwiseOR(F.lit(PLACES).cast("long") - F.col("at") - j)

    grams = [packed(j).alias(f"gram{j + 1}") for j in range(-1, w)]
    # The one-row generator keeps the grams from being computed again in every condition on them.
    kept = [c for c in rows.columns if c != "hashes"]
    rows = rows.select(*kept, F.inline(F.array(F.struct(*grams))))
    names = [f"gram{j}" for j in range(w + 1)]
    least = lambda some: F.least(*some) if len(some) > 1 else F.col(some[0])
    rows = rows.withColumn("packed", least(names[1:])).where((F.col("at") <= 0) | (least(names[:-1]) != F.col("packed")))
    fields = {
        "length": F.when(F.col("at") >= 0, F.lit(length)).otherwise(0),
        "hash": F.shiftright("packed", PLACE_BITS),
        "place": (F.lit(PLACES) - F.col("packed").bitwiseAND(F.lit(PLACES))).cast("int"),
    }
    return rows.withColumns(fields).select(*[c for c in kept if c != "at"], *fields)


def _key() -> list[Column]:
    """What a row is found again by: rows alike in id and text have the same results."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2")]


def benchmark_items(bench: DataFrame, span: int) -> DataFrame:
    """Items with words: item (a number of the row), item_id, words, length of its windows."""
    rows = bench.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    return materialize(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "words", F.least(F.size("words"), F.lit(span)).alias("length")), "items")


def candidate_places(docs: DataFrame, items: DataFrame, gram: int, span: int) -> DataFrame:
    """One pass over the texts: a row per document (item null) with its number of words, and a row per
    meeting of a kept hash of the document with one of an item: item, size of the item, diagonal."""
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most ``span`` values
    hashes = F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    theirs = items.select("item", F.size("words").alias("item_words"), hashes, F.col("length").alias("own"))
    theirs = _union([kept_hashes(theirs.where(F.col("own") == n), n, gram, False) for n in lengths], items.sparkSession, "item long, item_words int, length int, hash long, place int")
    theirs = materialize(theirs.withColumnRenamed("place", "item_place"), "item-hashes")
    rows = docs.select("doc_id", *_key(), word_hashes(F.col("text")).alias("hashes")).withColumn("n_words", F.size("hashes"))
    ours = [kept_hashes(rows, n, gram, i == 0) for i, n in enumerate(lengths or [span])]  # the first has the documents too
    met = _union(ours).join(theirs, ["length", "hash"], "left").where("length = 0 OR item IS NOT NULL")
    return materialize(met.select("doc_id", *KEY, "n_words", "item", "item_words", (F.col("place") - F.col("item_place")).alias("diagonal")), "places")


def _union(parts: list[DataFrame], spark: SparkSession | None = None, schema: str = "") -> DataFrame:
    columns = [c.strip().split(" ")[0] for c in schema.split(",")] if schema else parts[0].columns
    whole = parts[0].select(columns) if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        whole = whole.unionByName(p.select(columns))
    return whole


def occurrences(docs: DataFrame, items: DataFrame, places: DataFrame) -> DataFrame:
    """Windows of items that stand in documents: k1, k2, item_id, start, length."""
    lines = places.where("item IS NOT NULL").groupBy(*KEY).agg(F.collect_set(F.struct("item", "item_words", "diagonal")).alias("lines"))
    lines = materialize(lines, "lines")
    texts = docs.select(*_key(), "text").join(lines, KEY).select(*KEY, words_of(F.col("text")).alias("words"), "lines")
    first = F.greatest("line.diagonal", F.lit(0))
    part = F.slice("words", first + 1, F.col("line.item_words"))
    found = texts.withColumn("line", F.explode("lines")).select(*KEY, "line.item", "line.diagonal", first.alias("first"), part.alias("part")).distinct()
    own = items.select("item", "item_id", F.col("words").alias("item_text"), "length")
    shift = F.col("first") - F.col("diagonal")
    same = lambda i: F.slice("part", i - shift + 1, F.col("length")) == F.slice("item_text", i + 1, F.col("length"))
    last = F.size("item_text") - F.col("length")
    starts = F.filter(F.when(last >= shift, F.sequence(shift, last)).otherwise(F.array().cast("array<int>")), same)
    return found.join(own, "item").select(*KEY, "item_id", "length", "diagonal", F.explode(starts).alias("at")).select(*KEY, "item_id", (F.col("diagonal") + F.col("at")).alias("start"), "length")


def contamination(docs: DataFrame, bench: DataFrame, span: int = 10, gram: int = 5) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``span`` consecutive words of an item, or the whole of a shorter item. A word of a
    document is hit if it stands in an occurrence of a window. Null and empty texts have no words, and
    items without words no windows. Items are told apart by item_id: rows under one id are one item,
    and those without an id hit words but are not listed. Repeated rows and rows without a doc_id have
    a result each. Empty tables on either side give no rows, or no hits. Columns other than doc_id,
    item_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    items = benchmark_items(bench, span)
    places = candidate_places(docs, items, gram, span)
    found = materialize(occurrences(docs, items, places), "occurrences")
    order = Window.partitionBy(*KEY).orderBy("start", "length")
    end = F.col("start") + F.col("length")
    covered = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(covered, F.lit(0))))
    hit = found.select(*KEY, "start", "length").distinct().withColumn("new", new).groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    named = found.select(*KEY, "item_id").distinct().groupBy(*KEY).agg(ids.alias("ids"))
    got = hit.join(named, KEY)
    own = places.where("item IS NULL").select("doc_id", *KEY, "n_words").join(got, KEY, "left")
    return own.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPLIT}'), lambda w: w <> '') AS w
  FROM documents),
i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPLIT}'), lambda w: w <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS span
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0) x),
places AS (
  SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS span
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) k) x),
hits AS (SELECT r, p, n, item_id FROM places JOIN windows USING (n, span)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits) y) z GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) y WHERE s IS NOT NULL GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

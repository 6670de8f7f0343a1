"""Greedy thinning of times: a time is kept if it is at least a gap behind the last kept one.

Each choice rests on the one before, but the time kept next after a kept one is a function of that time
alone: the first one at least a gap behind it. So every time gets a pointer to it, and the kept times are
those that pointers reach from where a choice is certain (a time that far behind its predecessor). They
are found by pointer doubling: each round follows the pointers four times as far as the one before, in
equi-joins. Pointers and certain times come from time cells as wide as the gap, so no step orders all
times of a key in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodgauge.sources.scratch import materialize

#: Cells of one stretch, in which the next cell with times is looked up.
STRETCH = 1024


def _next_cells(cells: DataFrame) -> DataFrame:
    """key, cell and the first time of the next cell that has any: within the stretch of the cell, else
    the first of the next stretch (a list of one row in ``STRETCH`` or fewer)."""
    placed = cells.withColumn("stretch", F.floor(F.col("cell") / STRETCH))
    inside = F.lead("first").over(Window.partitionBy("key", "stretch").orderBy("cell"))
    heads = placed.groupBy("key", "stretch").agg(F.min("first").alias("head"))
    heads = heads.select("key", "stretch", F.lead("head").over(Window.partitionBy("key").orderBy("stretch")).alias("beyond"))
    return placed.withColumn("inside", inside).join(heads, ["key", "stretch"]).select("key", "cell", F.coalesce("inside", "beyond").alias("then"))


def _pointers(times: DataFrame, gap_ms: int) -> DataFrame:
    """key, at, to, certain: the first time at least the gap later, and whether the time before is at
    least that far away (then the time is kept whatever came before)."""
    placed = times.withColumn("cell", F.floor(F.col("at") / gap_ms))
    own = Window.partitionBy("key", "cell").orderBy("at")
    cells = placed.groupBy("key", "cell").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # What is a gap later falls into the next cell: there, or else in the next one with times.
    wanted = placed.select("key", (F.col("cell") + 1).alias("cell"), (F.col("at") + gap_ms).alias("at"), F.col("at").alias("asker"), F.lit(None).cast("long").alias("found"))
    offered = placed.select("key", "cell", "at", F.lit(None).cast("long").alias("asker"), F.col("at").alias("found"))
    later = Window.partitionBy("key", "cell").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    near = wanted.unionByName(offered).withColumn("to", F.min("found").over(later)).where("asker IS NOT NULL").select("key", F.col("cell") - 1, F.col("asker").alias("at"), "to").toDF("key", "cell", "at", "near")
    before = cells.select("key", (F.col("cell") + 1).alias("cell"), F.col("last").alias("left_of"))
    # The cell behind the next one is asked for by its place, so a gap of many empty cells costs nothing.
    ahead = _next_cells(cells.select("key", "cell", "first").unionByName(placed.select("key", F.col("cell") + 1, F.lit(None).cast("long")).distinct().toDF("key", "cell", "first")).groupBy("key", "cell").agg(F.min("first").alias("first")))
    joined = near.join(placed.withColumn("prev", F.lag("at").over(own)), ["key", "cell", "at"]).join(before, ["key", "cell"], "left")
    joined = joined.join(ahead.select("key", (F.col("cell") - 1).alias("cell"), "then"), ["key", "cell"], "left")
    certain = F.coalesce(F.col("at") - F.coalesce("prev", "left_of") >= gap_ms, F.lit(True))
    return joined.select("key", "at", F.coalesce("near", "then").alias("to"), certain.alias("certain"))


def _follow(from_: DataFrame, by: DataFrame) -> DataFrame:
    """(key, at, to) of ``from_`` followed once more by ``by``."""
    return from_.join(by.select("key", F.col("at").alias("to"), F.col("to").alias("_then")), ["key", "to"]).select("key", "at", F.col("_then").alias("to"))


def thinned_times(times: DataFrame, keys: list[str], gap_ms: int, time: str = "at_ms") -> DataFrame:
    """The kept times of each key, as ``keys`` and ``time``; rows without a time are left out, times that
    repeat are one. The number of rounds is the logarithm (base 4) of the longest run of kept times in
    which no time is a gap behind its predecessor."""
    if gap_ms <= 0:
        return times.where(F.col(time).isNotNull()).select(*keys, time).distinct()
    rows = times.where(F.col(time).isNotNull()).select(F.struct(*keys).alias("key"), F.col(time).cast("long").alias("at")).distinct()
    rows = materialize(_pointers(rows, gap_ms), "pointers")
    certain = rows.where("certain")
    if rows.where("NOT certain").isEmpty():
        return certain.select(*[F.col("key")[k].alias(k) for k in keys], F.col("at").alias(time))
    # A pointer to a certain time adds nothing: such a time is reached anyway.
    to = rows.where("to IS NOT NULL").join(certain.select("key", F.col("at").alias("to")), ["key", "to"], "left_anti").select("key", "at", "to")
    state = materialize(certain.select("key", "at", F.lit(None).cast("long").alias("to"), F.lit(True).alias("kept")).unionByName(to.withColumn("kept", F.lit(False))), "pointers")
    while not (pointers := state.where("NOT kept").select("key", "at", "to")).isEmpty():
        kept = state.where("kept").select("key", "at")
        one = kept.withColumn("to", F.col("at"))
        reached = [kept]
        for _ in range(3):
            one = _follow(one, pointers)
            reached.append(one.select("key", F.col("to").alias("at")))
        all_kept = reached[0]
        for r in reached[1:]:
            all_kept = all_kept.unionByName(r)
        twice = _follow(pointers, pointers)
        both = all_kept.select("key", "at", F.lit(None).cast("long").alias("to"), F.lit(True).alias("kept")).unionByName(_follow(twice, twice).withColumn("kept", F.lit(False)))
        state = materialize(both, "pointers")
    return state.where("kept").select(*[F.col("key")[k].alias(k) for k in keys], F.col("at").alias(time))

"""Per-minute summaries: five narrow, additive tables, and their retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgauge.functions import fields as X

#: Key and counts of each table; counts add up over minutes and over partial loads.
TABLES = {
    "totals": (["kind"], ["n", "s2", "s3", "s4", "s5", "with_host"]),
    "paths": (["backend", "method", "path"], ["n", "s2", "s3", "s4", "s5", "sum_ta", "n_ta"]),
    "blocked": (["kind", "method", "path"], ["n"]),
    "clients": (["client"], ["n", "blocked"]),
    "backends": (["backend"], ["n", "s2", "s3", "s4", "s5", "blocked"]),
}
#: Lists that thinning and dropping apply to, with the rows that a thinned minute keeps.
LISTS = {"paths": 50, "blocked": 50, "clients": 30}
#: Weight of a row of each list at full and thinned detail, and of a backend row.
WEIGHTS = {"paths": (1600, 1200), "blocked": (400, 150), "clients": (250, 120)}
BACKEND_WEIGHT, BARE_WEIGHT = 200, 500

def minute() -> Column:
    return F.expr("at_ms DIV 60000")


def with_counts(access: DataFrame) -> DataFrame:
    """Additive count columns of each record."""
    served = (F.col("kind") == "served") & (F.col("ta") >= 0)
    classes = {f"s{k}": F.col("status").between(100 * k, 100 * k + 99).cast("long") for k in (2, 3, 4, 5)}
    return access.withColumns(
        {
            "n": F.lit(1).cast("long"), **classes, "with_host": (F.col("host") != "").cast("long"), "blocked": X.is_blocked(F.col("kind")).cast("long"),
            "sum_ta": F.when(served, F.col("ta")).otherwise(0).cast("long"), "n_ta": served.cast("long"),
        }
    )


def merge(table: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of a table added up over ``keys`` (default: minute and the table's key)."""
    key, counts = TABLES[name]
    return table.groupBy(*(["minute", *key] if keys is None else keys)).agg(*[F.sum(c).alias(c) for c in counts])


def minute_rollup(access: DataFrame) -> dict[str, DataFrame]:
    """The five tables by minute of request start; raw tcp records are left out."""
    rows = with_counts(access.where("kind <> 'tcp'")).withColumn("minute", minute())
    return {name: merge(rows.where("blocked = 1") if name == "blocked" else rows, name) for name in TABLES}


def tiered_retention(tables: dict[str, DataFrame], now_minute: int, detail: int = 60, lists: int = 360, retention: int = 1440) -> dict[str, DataFrame]:
    """Minutes older than ``detail`` keep their busiest rows of each list, older than ``lists`` none,
    older than ``retention`` nothing. Totals and backends stay whole. Applied on every run, as late
    records may fill an old minute again."""
    age = now_minute - F.col("minute")
    out = {}
    for name, table in tables.items():
        kept = table.where(age < retention)
        if name in LISTS:
            kept = _thinned(kept.where(age < lists), name, age >= detail)
        out[name] = kept
    return out


def _thinned(table: DataFrame, name: str, old) -> DataFrame:
    """New minutes whole, of old ones the busiest rows; only old ones are ranked, so that the limit
    per minute is applied before the shuffle."""
    busiest = Window.partitionBy("minute").orderBy(F.desc("n"), *TABLES[name][0])
    few = table.where(old).withColumn("_rank", F.row_number().over(busiest)).where(F.col("_rank") <= LISTS[name]).drop("_rank")
    return table.where(~old).unionByName(few)


def minute_weights(tables: dict[str, DataFrame]) -> DataFrame:
    """Weight of each minute at full detail, thinned and bare: minute, w0, w1, w2."""
    parts = []
    for name, (full, thin) in WEIGHTS.items():
        rows = tables[name].groupBy("minute").agg(F.count(F.lit(1)).alias("rows"))
        parts.append(rows.select("minute", (F.col("rows") * full).alias("w0"), (F.least("rows", F.lit(LISTS[name])) * thin).alias("w1"), F.lit(0).cast("long").alias("w2")))
    own = F.count(F.lit(1)) * BACKEND_WEIGHT
    parts.append(tables["backends"].groupBy("minute").agg(own.alias("w0"), own.alias("w1"), (own + BARE_WEIGHT).alias("w2")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("minute").agg(*[F.sum(c).alias(c) for c in ("w0", "w1", "w2")])


def budget_levels(weights: DataFrame, budget: int) -> DataFrame:
    """minute, level: the oldest minutes go to level 1 (thinned), then to level 2 (no lists), until
    the weights fit the budget. One row a minute: the ordered sums run over few rows."""
    before = Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    excess = F.sum("w0").over(Window.partitionBy()) - budget
    one = weights.withColumn("_over", excess).withColumn("_saved1", F.coalesce(F.sum(F.col("w0") - F.col("w1")).over(before), F.lit(0)))
    one = one.withColumn("_one", F.col("_over") > F.col("_saved1"))
    now = F.sum(F.when(F.col("_one"), F.col("w1")).otherwise(F.col("w0"))).over(Window.partitionBy()) - budget
    two = one.withColumn("_left", now).withColumn("_saved2", F.coalesce(F.sum(F.when(F.col("_one"), F.col("w1")).otherwise(F.col("w0")) - F.col("w2")).over(before), F.lit(0)))
    level = F.when(F.col("_left") > F.col("_saved2"), 2).when(F.col("_one"), 1).otherwise(0)
    return two.select("minute", level.alias("level"))


def budget_retention(tables: dict[str, DataFrame], budget: int) -> dict[str, DataFrame]:
    """The tables brought to the levels of budget_levels(); counts in totals and backends stay."""
    levels = budget_levels(minute_weights(tables), budget)
    return {**tables, **{name: at_levels(tables[name], name, levels) for name in LISTS}}


def at_levels(table: DataFrame, name: str, levels: DataFrame) -> DataFrame:
    """A list table at the levels of its minutes."""
    return _thinned(table.join(levels, "minute").where("level < 2"), name, F.col("level") == 1).drop("level")


def coverage(levels: DataFrame, now_minute: int) -> DataFrame:
    """Minutes that full detail and the lists reach back."""
    oldest = [F.min(F.when(c, F.col("minute"))) for c in (F.col("level") == 0, F.col("level") <= 1)]
    return levels.agg(*[F.coalesce(now_minute - m + 1, F.lit(0)).cast("long").alias(a) for m, a in zip(oldest, ("detail_minutes", "list_minutes"))])

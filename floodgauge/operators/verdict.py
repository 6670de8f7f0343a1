"""Findings about an incident, from its series, totals, backends, terms and events.

Series have at most 360 rows an incident; a column ``incident`` may number several incidents, and all
windows and groups are kept apart by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgauge.sources.scratch import materialize


def _numbered(series: DataFrame) -> DataFrame:
    return series if "incident" in series.columns else series.withColumn("incident", F.lit(0))


def _islands(rows: DataFrame, bad: Column) -> DataFrame:
    """Runs of bad slices, joined across a single good one: incident, run, first, last."""
    w = Window.partitionBy("incident").orderBy("bin")
    marked = rows.where(bad).select("incident", "bin")
    begins = F.coalesce(F.col("bin") - F.lag("bin").over(w) > 2, F.lit(True)).cast("int")
    runs = marked.withColumn("_begins", begins).withColumn("run", F.sum("_begins").over(w))
    return runs.groupBy("incident", "run").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))


def _ranked(values: Column, part: Column) -> Column:
    """The value at position floor(part) of the sorted values."""
    return F.get(F.sort_array(F.collect_list(values)), F.floor(part).cast("int"))


def _within(rows: DataFrame, runs: DataFrame) -> DataFrame:
    return rows.join(runs, "incident").where(F.col("bin").between(F.col("first"), F.col("last")))


def problem_periods(series: DataFrame, to_ms: int, step: int) -> DataFrame:
    """Periods of raised server errors: first and last slice, sum of errors, whether the main one (most
    errors, the first on a tie), its peak slice, its ratio outside, minutes, whether it touches the
    start or the end, and the number of periods."""
    s = _numbered(series).withColumn("ratio", F.try_divide("c5", "n"))
    big = F.when(F.col("n") >= 5, F.col("ratio"))
    calm = s.groupBy("incident").agg(F.coalesce(_ranked(big, F.count(big) / 10), F.lit(0.0)).alias("calm"), F.max("bin").alias("end"), F.sum("n").alias("all_n"), F.sum("c5").alias("all_5"))
    joined = s.join(calm, "incident")
    bar = F.greatest(F.lit(0.05), F.col("calm") * 2 + 0.03)
    runs = _islands(joined, (F.col("c5") >= 3) & (F.col("n") > 0) & (F.col("ratio") >= bar))
    peak = F.struct(F.coalesce("ratio", F.lit(-1.0)).alias("ratio"), (-F.col("bin")).alias("bin"))
    got = _within(s, runs).groupBy("incident", "run", "first", "last").agg(F.sum("c5").alias("errors"), F.sum("n").alias("n"), F.max(peak).alias("peak"), F.min("t").alias("from_t"), F.max("t").alias("last_t"))
    got = got.join(calm, "incident")
    main = F.row_number().over(Window.partitionBy("incident").orderBy(F.desc("errors"), "first")) == 1
    until = F.least(F.col("last_t") + step * 60_000, F.lit(to_ms))
    return got.select(
        "incident", "first", "last", "errors", main.alias("main"), (-F.col("peak.bin")).alias("peak_bin"), F.col("peak.ratio").alias("peak_ratio"),
        F.try_divide(F.col("all_5") - F.col("errors"), F.col("all_n") - F.col("n")).alias("outside_ratio"),
        F.floor((until - F.col("from_t")) / 60_000 + 0.5).alias("minutes"), (F.col("first") == 0).alias("at_start"), (F.col("last") >= F.col("end")).alias("at_end"),
        F.count(F.lit(1)).over(Window.partitionBy("incident")).alias("periods"),
    )


def continuing_problem(totals: DataFrame, periods: DataFrame) -> DataFrame:
    """The share of server errors, where it is high throughout without a period; else no row."""
    any_period = periods.agg(F.count(F.lit(1)).alias("periods")).withColumn("_k", F.lit(1))
    got = totals.withColumn("_k", F.lit(1)).join(any_period, "_k").drop("_k")
    return got.where((F.col("periods") == 0) & (F.col("n") >= 100) & (F.col("c5") / F.col("n") >= 0.03)).select("n", F.col("c5").alias("errors"), (F.col("c5") / F.col("n")).alias("share"))


def main_cause(totals: DataFrame, backends: DataFrame, terms: DataFrame, periods: DataFrame) -> DataFrame:
    """One row where there are server errors: the top backend with its share and own ratio, the first
    reason with its share, and the level."""
    k = F.lit(1).alias("_k")
    b = backends.orderBy(F.desc("c5"), F.desc("n"), "backend").limit(1).where("c5 > 0").select(k, "backend", F.col("c5").alias("backend_errors"), F.col("n").alias("backend_n"))
    t = terms.where("errors > 0").orderBy(F.desc("errors"), F.desc("n"), "code").limit(1).select(k, F.col("code").alias("reason"), F.col("errors").alias("reason_errors"))
    p = periods.agg(F.count(F.lit(1)).alias("periods")).select(k, "periods")
    got = totals.where("c5 > 0").select(k, "n", "c5").join(p, "_k").join(b, "_k", "left").join(t, "_k", "left")
    share = F.col("c5") / F.col("n")
    level = F.when((F.col("periods") > 0) | ((F.col("n") >= 100) & (share >= 0.03)), "bad").when(share >= 0.01, "warn").otherwise("info")
    return got.select(
        level.alias("level"), "backend", (F.col("backend_errors") / F.col("c5")).alias("backend_share"), (F.col("backend_errors") / F.col("backend_n")).alias("backend_ratio"),
        "reason", (F.col("reason_errors") / F.col("c5")).alias("reason_share"),
    )


def unrouted_notes(totals: DataFrame, frontends: DataFrame, backends: DataFrame) -> DataFrame:
    """Requests without a matching backend, and requests per backend without a server: level, rule,
    target, n."""
    k = F.lit(1).alias("_k")
    nomatch = frontends.agg(F.coalesce(F.sum("nomatch"), F.lit(0)).alias("lost")).select(k, "lost").join(totals.select(k, "n"), "_k").where("lost > 0")
    first = nomatch.select(F.when(F.col("lost") / F.col("n") >= 0.01, "warn").otherwise("info").alias("level"), F.lit("nomatch").alias("rule"), F.lit("").alias("target"), F.col("lost").alias("n"))
    second = backends.where("noserver > 0").select(F.lit("bad").alias("level"), F.lit("noserver").alias("rule"), F.col("backend").alias("target"), F.col("noserver").alias("n"))
    return first.unionByName(second)


def server_outages(events: DataFrame, from_ms: int) -> DataFrame:
    """The first outage of each server: down_at, up_at (the next up, strictly later; null if none),
    reason, whether it began before the range."""
    # From the newest event back, so that the frame only ever grows.
    w = Window.partitionBy("backend", "server").orderBy(F.desc("at_ms")).rangeBetween(Window.unboundedPreceding, -1)
    up = F.min(F.when(F.col("type") == "up", F.col("at_ms"))).over(w)
    downs = events.where(F.col("type").isin("down", "up")).withColumn("up_at", up).where("type = 'down'")
    got = downs.groupBy("backend", "server").agg(F.min(F.struct("at_ms", "up_at", "reason")).alias("f"))
    return got.select("backend", "server", F.col("f.at_ms").alias("down_at"), F.col("f.up_at").alias("up_at"), F.col("f.reason").alias("reason"), (F.col("f.at_ms") < from_ms).alias("before_range"))


def _longest(runs: DataFrame) -> DataFrame:
    order = Window.partitionBy("incident").orderBy((F.col("first") - F.col("last")), "first")
    return runs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "run")


def traffic_drop(series: DataFrame, to_ms: int, step: int) -> DataFrame:
    """The longest run of slices under a quarter of the median rate, where the median slice holds at
    least 20 requests: first, last, mean rate, median rate, whether traffic stopped."""
    length = F.greatest(F.lit(1 / 60), F.least(F.lit(float(step)), (F.lit(to_ms) - F.col("t")) / 60_000))
    s = _numbered(series).withColumn("rate", F.col("n") / length)
    med = s.groupBy("incident").agg(_ranked(F.col("rate"), F.count(F.lit(1)) / 2).alias("median"))
    joined = s.join(med, "incident")
    runs = _longest(_islands(joined, (F.col("median") * step >= 20) & (F.col("rate") < F.col("median") * 0.25)))
    got = _within(joined, runs).groupBy("incident", "first", "last", "median").agg(F.avg("rate").alias("rate"))
    return got.withColumn("stopped", F.col("rate") < 0.5)


def slow_periods(series: DataFrame) -> DataFrame:
    """The longest run of slices whose p95 is over a second and three medians, and its worst slice."""
    s = _numbered(series)
    used = (F.col("n") >= 5) & (F.col("p95_ms") >= 0)
    p = F.when(used, F.col("p95_ms"))
    med = s.groupBy("incident").agg(F.coalesce(_ranked(p, F.count(p) / 2), F.lit(0)).alias("median"))
    joined = s.join(med, "incident")
    runs = _longest(_islands(joined, (F.col("n") >= 5) & (F.col("p95_ms") > F.greatest(F.lit(1000), F.col("median") * 3))))
    worst = F.max(F.struct("p95_ms", (-F.col("bin")).alias("b")))
    got = _within(joined, runs).groupBy("incident", "first", "last", "median").agg(worst.alias("w"))
    return got.select("incident", "first", "last", "median", (-F.col("w.b")).alias("worst_bin"), F.col("w.p95_ms").alias("worst_p95"))


def backend_health(backends: DataFrame) -> DataFrame:
    share = F.col("c5") / F.col("n")
    health = F.when((F.col("noserver") > 0) | (share >= 0.05), "problem").when((share >= 0.01) | (F.col("avg_ms") >= 2000), "attention").otherwise("normal")
    return backends.withColumn("health", health)


def incident_verdict(totals: DataFrame, periods: DataFrame, cause: DataFrame, notes: DataFrame, outages: DataFrame, drop: DataFrame, slow: DataFrame) -> DataFrame:
    """All findings as (level, rule, target); one ``ok`` row where none is bad or a warning."""
    def row(df: DataFrame, level, rule: str, target) -> DataFrame:
        return df.select(level.alias("level"), F.lit(rule).alias("rule"), target.alias("target"))

    bad, warn, none = F.lit("bad"), F.lit("warn"), F.lit("")
    found = row(periods.where("main"), bad, "error_period", none)
    found = found.unionByName(row(continuing_problem(totals, periods), bad, "continuing", none)).unionByName(row(cause.where("backend IS NOT NULL"), F.col("level"), "main_backend", F.col("backend")))
    found = found.unionByName(notes.select("level", "rule", "target")).unionByName(row(outages, bad, "outage", F.concat_ws("/", "backend", "server")))
    found = found.unionByName(row(drop, warn, "traffic_drop", none)).unionByName(row(slow, warn, "slow", none))
    # Written, as it is asked twice: for its rows and for whether any is bad.
    found = materialize(found.unionByName(row(totals.where("n = 0"), warn, "no_requests", none)), "findings")
    calm = found.agg(F.count_if(F.col("level").isin("bad", "warn")).alias("n")).where("n = 0")
    return found.unionByName(row(calm, F.lit("ok"), "no_problem", none))

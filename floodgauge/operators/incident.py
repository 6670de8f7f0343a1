"""Incident review: everything about the requests and events of one time range.

All functions take request records already sliced to the range (time_slice) unless they say otherwise.
Grains are aggregated before anything is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgauge.functions import fields as X
from floodgauge.operators.cidr import ip_in_cidrs
from floodgauge.operators.report import ranked
from floodgauge.operators.thinning import thinned_times

SLACK_MS = 300_000
STEPS = (1, 2, 5, 10, 15, 30, 60)
CLASS_COLUMNS = ("c2", "c3", "c4", "c5", "c0")


def one() -> Column:
    return F.count(F.lit(1)).alias("n")


def incident_step(from_ms: int, to_ms: int) -> int:
    """The smallest step in minutes that makes at most 360 slices."""
    return next((m for m in STEPS if to_ms - from_ms <= m * 360 * 60_000), STEPS[-1])


def slice_count(from_ms: int, to_ms: int, step: int) -> int:
    return max(1, -(-(to_ms - from_ms) // (step * 60_000)))


def coarse_slice(df: DataFrame, from_ms: int, to_ms: int, day: str, hour: str | None = None, slack_ms: int = SLACK_MS) -> DataFrame:
    """Prune by partition columns of the date, and of the hour where there is one. The slack is for
    lines placed by when they were written, which is after they began."""
    lo, hi = from_ms - slack_ms, to_ms + slack_ms
    first, last = (F.to_date(F.timestamp_millis(F.lit(t))) for t in (lo, hi))
    kept = df.where(F.col(day).between(first, last))
    if hour is None:
        return kept
    of_day = lambda t: t // 3_600_000 % 24
    return kept.where(((F.col(day) > first) | (F.col(hour) >= of_day(lo))) & ((F.col(day) < last) | (F.col(hour) <= of_day(hi))))


def time_slice(df: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    return df.where(F.col("at_ms").between(from_ms, to_ms))


def classes() -> list[Column]:
    """Counts of 2xx to 5xx and of everything else (no answer) as c2, c3, c4, c5, c0."""
    c = X.class5(F.col("status"))
    return [F.count_if(c == i).alias(name) for i, name in enumerate(CLASS_COLUMNS)]


def kind_counts() -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(k) for k in ("served", "denied", "nomatch", "noserver", "redirect", "proxy")]


def _fe() -> Column:
    return X.frontend_answered(F.col("server"), F.col("backend"), F.col("frontend"))


def with_bucket(df: DataFrame) -> DataFrame:
    """The duration bucket of each record, for duration_aggregates()."""
    return df.withColumn("_bucket", X.duration_bucket(F.col("ta")))


def duration_aggregates() -> list[Column]:
    """Histogram, sum and maximum of the durations of at least 0, to be aggregated beside the counts of
    a section in one pass; histograms of parts add up."""
    ta = F.when(F.col("ta") >= 0, F.col("ta"))
    hist = F.array(*[F.count_if(F.col("_bucket") == i) for i in range(len(X.DURATION_BOUNDS) + 1)])
    return [hist.alias("_hist"), F.coalesce(F.sum(ta), F.lit(0)).alias("_total"), F.coalesce(F.max(ta), F.lit(-1)).cast("long").alias("max_ms")]


def with_durations(df: DataFrame, p: float = 0.95) -> DataFrame:
    """The aggregates as avg_ms, p95_ms and max_ms, -1 without durations. The percentile is linear
    within the first bucket that reaches it."""
    add = lambda a, x: a + x
    zero, hist, i = F.lit(0).cast("long"), F.col("_hist"), F.col("_i")
    out = df.withColumn("_upto", F.transform(hist, lambda _, k: F.aggregate(F.slice(hist, F.lit(1), k + 1), zero, add)))
    out = out.withColumn("_n", F.element_at("_upto", -1))
    target = F.lit(p) * F.col("_n")
    out = out.withColumn("_i", (F.array_position(F.transform("_upto", lambda u: u >= target), F.lit(True)) - 1).cast("int"))
    bounds = F.array(*map(F.lit, X.DURATION_BOUNDS))
    low = F.when(i > 0, F.get(bounds, i - 1)).otherwise(0)
    high = F.least(F.coalesce(F.get(bounds, i), F.col("max_ms") + 1), F.col("max_ms") + 1)
    part = (target - (F.get("_upto", i) - F.get(hist, i))) / F.get(hist, i)
    value = F.least(low + F.floor(part * (high - low)), F.col("max_ms")).cast("long")
    some = F.col("_n") > 0
    out = out.withColumns({"avg_ms": F.when(some, F.expr("_total DIV _n")).otherwise(-1), "p95_ms": F.when(some, value).otherwise(-1)})
    return out.drop("_hist", "_total", "_upto", "_n", "_i")


def duration_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, avg_ms, p95_ms, max_ms over durations of at least 0; keys without any do not appear."""
    return with_durations(with_bucket(df).groupBy(*keys).agg(*duration_aggregates())).where("max_ms >= 0")


def incident_series(df: DataFrame, from_ms: int, to_ms: int, step: int | None = None) -> DataFrame:
    """One row per slice, empty ones included: bin, t, n, classes, noserver, avg_ms, p95_ms, codes."""
    step = step or incident_step(from_ms, to_ms)
    bins = slice_count(from_ms, to_ms, step)
    binned = df.withColumn("bin", F.least(F.expr(f"(at_ms - {from_ms}) DIV {step * 60_000}"), F.lit(bins - 1).cast("long")))
    counts = with_bucket(binned).groupBy("bin").agg(one(), *classes(), F.count_if(F.col("kind") == "noserver").alias("noserver"), *duration_aggregates())
    codes = binned.groupBy("bin", "status").agg(one()).groupBy("bin").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("codes"))
    return on_grid(counts, codes, from_ms, to_ms, step)


def on_grid(counts: DataFrame, codes: DataFrame, from_ms: int, to_ms: int, step: int) -> DataFrame:
    """Counts and code maps by slice as the series, with the slices that have none."""
    grid = counts.sparkSession.range(slice_count(from_ms, to_ms, step)).select(F.col("id").alias("bin"), (F.lit(from_ms) + F.col("id") * step * 60_000).alias("t"))
    out = grid.join(with_durations(counts), "bin", "left").join(codes, "bin", "left").fillna(-1, ["avg_ms", "p95_ms", "max_ms"])
    return out.fillna(0, ["n", *CLASS_COLUMNS, "noserver"]).withColumn("codes", F.coalesce("codes", F.create_map().cast("map<int,bigint>")))


def series_rates(series: DataFrame, to_ms: int, step: int) -> DataFrame:
    """Requests per minute of each slice, server errors and the rest, by the slice's true length."""
    length = F.greatest(F.lit(1 / 60), F.least(F.lit(float(step)), (F.lit(to_ms) - F.col("t")) / 60_000))
    avg = F.when(F.col("avg_ms") >= 0, F.col("avg_ms"))
    return series.select("bin", "t", (F.col("c5") / length).alias("errors_per_minute"), ((F.col("n") - F.col("c5")) / length).alias("rest_per_minute"), avg.alias("avg_ms"))


def incident_totals(df: DataFrame) -> DataFrame:
    got = with_bucket(df).agg(
        one(), *classes(), *kind_counts(), F.count_if(F.col("kind") == "tcp").alias("tcp"), F.count_if(F.col("host") != "").alias("with_host"),
        F.min("at_ms").alias("first_at"), F.max("at_ms").alias("last_at"), *duration_aggregates(),
    )
    return with_durations(got).drop("max_ms")


def incident_codes(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(one()).orderBy(F.desc("n"), "status")


def incident_backends(df: DataFrame) -> DataFrame:
    """Backends by server errors; answers of the frontend itself are left out."""
    own = with_bucket(df.where(~_fe()))
    error = F.when(X.class5(F.col("status")) == 3, F.col("at_ms"))
    got = own.groupBy("backend").agg(one(), *classes(), *kind_counts(), F.min(error).alias("first_5xx"), F.max(error).alias("last_5xx"), *duration_aggregates())
    return with_durations(got).orderBy(F.desc("c5"), F.desc("n"), "backend")


def incident_servers(df: DataFrame) -> DataFrame:
    own = with_bucket(df.where(~_fe() & (F.col("server") != "") & (F.col("server") != X.NO_SERVER)))
    got = own.groupBy("backend", "server").agg(one(), *classes(), *duration_aggregates())
    return with_durations(got).orderBy("backend", F.desc("c5"), F.desc("n"), "server")


def incident_frontends(df: DataFrame) -> DataFrame:
    return df.where(_fe()).groupBy("frontend").agg(one(), *classes(), *kind_counts()).orderBy(F.desc("n"), "frontend")


def _terms(df: DataFrame) -> DataFrame:
    error = X.class5(F.col("status")) >= 3
    each = df.withColumn("code", X.term_code(F.col("term"))).where("code <> '--'")
    return each.groupBy("code", "backend", _fe().alias("fe")).agg(one(), F.count_if(error).alias("errors"))


def termination_codes(df: DataFrame) -> DataFrame:
    """code, n, errors, the backend that has it most often, its meaning and side."""
    return ranked_terms(_terms(df))


def ranked_terms(each: DataFrame) -> DataFrame:
    """The same from counts by code, backend and fe."""
    top = F.min_by("backend", F.struct(-F.col("n"), F.col("backend"))).alias("backend")
    tops = each.where("NOT fe").groupBy("code").agg(top)
    got = each.groupBy("code").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors")).join(tops, "code", "left")
    code = F.col("code")
    return got.select("code", "n", "errors", F.coalesce("backend", F.lit("")).alias("backend"), X.explain_term(code).alias("meaning"), X.term_side(code).alias("side")).orderBy(F.desc("errors"), F.desc("n"), "code")


def backend_terms(df: DataFrame, n: int = 5) -> DataFrame:
    return ranked_backend_terms(_terms(df), n)


def ranked_backend_terms(each: DataFrame, n: int) -> DataFrame:
    each = each.where("NOT fe").groupBy("backend", "code").agg(F.sum("n").alias("n"))
    return ranked(each, ["backend"], [F.desc("n"), "code"], n)


def _paths(df: DataFrame) -> DataFrame:
    return df.groupBy("method", "path", "backend", _fe().alias("frontend_answered")).agg(one(), *classes())


def _path_order(*first) -> list:
    return [*first, F.desc("n"), F.concat("method", "path", "backend"), "frontend_answered"]


def error_paths(df: DataFrame, n: int = 15) -> DataFrame:
    return _paths(df).where("c4 + c5 + c0 > 0").orderBy(*_path_order(F.desc("c5"), F.desc("c4"))).limit(n)


def incident_top_paths(df: DataFrame, n: int = 15) -> DataFrame:
    return _paths(df).orderBy(*_path_order()).limit(n)


def incident_ips(df: DataFrame, cidrs: DataFrame, n: int = 15) -> DataFrame:
    top = df.groupBy("client").agg(one(), *classes()).orderBy(F.desc("n"), "client").limit(n)
    return ip_in_cidrs(top, cidrs)


def incident_hosts(df: DataFrame, n: int = 15) -> DataFrame:
    return df.where("host <> ''").groupBy("host").agg(one(), *classes()).orderBy(F.desc("c5"), F.desc("n"), "host").limit(n)


def coalesce_restarts(events: DataFrame, gap_ms: int = 60_000) -> DataFrame:
    """Start and stop rows within ``gap_ms`` of the last kept one of their type (and host, where the
    events have one) go; other events stay, and so do restarts without a time. Which times are kept is
    decided by thinned_times() over the distinct times; rows of one kept time are one."""
    restart = F.col("type").isin("start", "stop") & F.col("at_ms").isNotNull()
    keys = [*(["host"] if "host" in events.columns else []), "type"]
    rows = events.where(restart)
    kept = thinned_times(rows, keys, gap_ms)
    columns = [c for c in events.columns if c not in (*keys, "at_ms")]
    first = rows.groupBy(*keys, "at_ms").agg(*[F.min(c).alias(c) for c in columns]) if columns else rows.distinct()
    same = [first[c].eqNullSafe(kept[c]) for c in (*keys, "at_ms")]
    return events.where(~F.coalesce(restart, F.lit(False))).unionByName(first.join(kept, same, "left_semi").select(*events.columns))


def incident_events(events: DataFrame, from_ms: int, to_ms: int, n: int = 500) -> DataFrame:
    """The first ``n`` events from five minutes before the range, and whether that cut any."""
    own = coalesce_restarts(events.where(F.col("at_ms").between(from_ms - SLACK_MS, to_ms)))
    order = ["at_ms", *sorted(c for c in own.columns if c != "at_ms")]
    top = own.orderBy(*order).limit(n + 1)
    rank = F.row_number().over(Window.orderBy(*order))  # over n + 1 rows
    return top.withColumn("_rank", rank).withColumn("cut", F.max("_rank").over(Window.partitionBy()) > n).where(F.col("_rank") <= n).drop("_rank")

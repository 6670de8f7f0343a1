"""Cumulative counter snapshots to rates, windowed deltas and charts.

A snapshot row is (host, at_ms, uptime_sec, pxname, svname, type, counters). What depends on the order
of snapshots works on the short list of (host, at_ms); rows meet their earlier values by equi-join on
the earlier snapshot, so that a row missing from a snapshot is not compared across the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgauge.functions import fields as X
from floodgauge.operators.thinning import thinned_times
from floodgauge.sources.scratch import materialize

CODES = ["h1", "h2", "h3", "h4", "h5", "ho"]
WINDOWED = ["req_tot", "stot", *CODES, "econ", "eresp"]
POINT = ["c2", "c3", "c4", "c5", "bytes_in", "bytes_out", "reqs"]
ROW = ["pxname", "svname"]
FINE_MINUTES, CHART_POINTS = 60, 360


def row_keys(*frames: DataFrame, row: list[str] | None = None) -> list[str]:
    """What names a row in all frames: the host, where all have one, and proxy and server."""
    return [*(["host"] if all("host" in f.columns for f in frames) else []), *(ROW if row is None else row)]


def _snapshots(rows: DataFrame) -> DataFrame:
    return rows.groupBy("host", "at_ms").agg(F.min("uptime_sec").alias("uptime_sec"))


def mark_resets(rows: DataFrame) -> DataFrame:
    """host, at_ms, uptime_sec, epoch, prev_at: a new epoch begins where the uptime falls; the first
    snapshot of an epoch has no earlier one."""
    w = Window.partitionBy("host").orderBy("at_ms")
    fell = F.coalesce(F.col("uptime_sec") < F.lag("uptime_sec").over(w), F.lit(False))
    s = _snapshots(rows).withColumn("_fell", fell.cast("int")).withColumn("epoch", F.sum("_fell").over(w)).drop("_fell")
    return s.withColumn("prev_at", F.lag("at_ms").over(Window.partitionBy("host", "epoch").orderBy("at_ms")))


def _fall(now: str, then: str) -> Column:
    return F.greatest(F.col(now) - F.col(then), F.lit(0))


def _against(rows: DataFrame, times: DataFrame, base: str, keep: list[str]) -> DataFrame:
    """Rows at (host, at_ms) of ``times`` beside their values, named was_*, at the time in ``base``."""
    values = [c for c in rows.columns if c in {*WINDOWED, "bin_bytes", "bout"}]
    cur = rows.join(times, ["host", "at_ms"])
    then = rows.select("host", F.col("at_ms").alias(base), *ROW, *[F.col(c).alias(f"was_{c}") for c in values])
    return cur.join(then, ["host", base, *ROW]).select("host", "at_ms", *keep, *ROW, "type", *values, *[f"was_{c}" for c in values])


def counter_rates(rows: DataFrame) -> DataFrame:
    """Rates per second against the snapshot before, within an epoch."""
    times = mark_resets(rows).where("prev_at IS NOT NULL AND at_ms > prev_at").select("host", "at_ms", "prev_at")
    dt = (F.col("at_ms") - F.col("prev_at")) / 1000
    got = _against(rows, times, "prev_at", ["prev_at"])
    names = {"bytes_in": "bin_bytes", "bytes_out": "bout", "econ": "econ", **{c: c for c in CODES}}
    rps = F.coalesce(_fall("req_tot", "was_req_tot"), _fall("stot", "was_stot")) / dt
    return got.select("host", "at_ms", *ROW, "type", rps.alias("rps"), *[(_fall(c, f"was_{c}") / dt).alias(a) for a, c in names.items()])


def traffic_points(rows: DataFrame) -> DataFrame:
    """One point per snapshot that has one before it: the rates of all frontends together."""
    r = counter_rates(rows).where("type = 0")
    sums = {"c2": "h2", "c3": "h3", "c4": "h4", "c5": "h5", "bytes_in": "bytes_in", "bytes_out": "bytes_out", "reqs": "rps"}
    got = r.groupBy("host", "at_ms").agg(*[F.sum(c).alias(a) for a, c in sums.items()])
    return mark_resets(rows).where("prev_at IS NOT NULL").select("host", "at_ms", "epoch").join(got, ["host", "at_ms"], "left").fillna(0.0, POINT)


def sample_every(rows: DataFrame, gap_ms: int = 10_000) -> DataFrame:
    """host, epoch, at_ms of the snapshots kept: at least ``gap_ms`` after the last kept one of their
    epoch."""
    return thinned_times(mark_resets(rows), ["host", "epoch"], gap_ms)


def _minute_bases(rows: DataFrame) -> DataFrame:
    """host, epoch, minute, base (its first snapshot), at_ms (the first of the next minute seen);
    the minute left open by a reset or by the end has none."""
    s = mark_resets(rows).withColumn("minute", F.expr("at_ms DIV 60000"))
    first = s.groupBy("host", "epoch", "minute").agg(F.min("at_ms").alias("base"))
    return first.withColumn("at_ms", F.lead("base").over(Window.partitionBy("host", "epoch").orderBy("minute"))).where("at_ms IS NOT NULL")


def minute_deltas(rows: DataFrame) -> DataFrame:
    """host, minute, row key and its increases over the minute; rows without any are left out."""
    got = _against(rows, _minute_bases(rows), "base", ["minute"])
    out = got.select("host", "minute", *ROW, "type", *[_fall(c, f"was_{c}").alias(c) for c in WINDOWED])
    return out.where(F.greatest(*WINDOWED) > 0)


def minute_points(rows: DataFrame, retention: int = 1440) -> DataFrame:
    """host, at_ms (start of the minute) and the mean of the minute's traffic points."""
    points = traffic_points(rows).withColumn("minute", F.expr("at_ms DIV 60000")).groupBy("host", "epoch", "minute").agg(*[F.avg(c).alias(c) for c in POINT])
    got = _minute_bases(rows).select("host", "epoch", "minute").join(points, ["host", "epoch", "minute"], "left").fillna(0.0, POINT)
    newest = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("minute"), F.desc("epoch")))
    return got.withColumn("_r", newest).where(F.col("_r") <= retention).select("host", (F.col("minute") * 60_000).alias("at_ms"), *POINT)


def latest(rows: DataFrame) -> DataFrame:
    """Rows of the last snapshot of each host."""
    last = rows.groupBy("host").agg(F.max("at_ms").alias("at_ms"))
    return rows.join(last, ["host", "at_ms"], "left_semi")


def _windowed(got: DataFrame, n: Column, covered: Column) -> DataFrame:
    return got.select("host", *ROW, "type", n.cast("double").alias("n"), *[F.col(c).cast("double").alias(c) for c in [*CODES, "econ", "eresp"]], covered.alias("covered_seconds"))


def window_delta(rows: DataFrame, minutes: int, gap_ms: int = 10_000) -> DataFrame:
    """Increases since the sample at or before the start of the window (else the earliest sample) of
    the current epoch; rows that the base lacks are skipped."""
    times = materialize(mark_resets(rows), "snapshots")  # short, and read several times
    cur = times.groupBy("host").agg(F.max("at_ms").alias("cur"), F.max("epoch").alias("epoch"))
    s = thinned_times(times, ["host", "epoch"], gap_ms).join(cur, ["host", "epoch"])
    start = F.col("cur") - minutes * 60_000
    base = s.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("at_ms") <= start, F.col("at_ms"))), F.min("at_ms")).alias("base"), F.max("cur").alias("at_ms"))
    got = _against(rows, base, "base", ["base"])
    n = F.when(F.col("req_tot").isNull(), _fall("stot", "was_stot")).otherwise(_fall("req_tot", "was_req_tot"))
    covered = (F.col("at_ms") - F.col("base")) / 1000
    fallen = got.select("*", n.alias("_n")).withColumns({c: _fall(c, f"was_{c}") for c in [*CODES, "econ", "eresp"]})
    return _windowed(fallen, F.col("_n"), covered)


def window_from_minutes(rows: DataFrame, minutes: int) -> DataFrame:
    """Sums of the minute deltas since the start of the window."""
    cur = rows.groupBy("host").agg(F.max("at_ms").alias("cur"))
    start = F.col("cur") - minutes * 60_000
    first = _minute_bases(rows).join(cur, "host").where(F.col("minute") * 60_000 >= start).groupBy("host").agg((F.min("minute") * 60_000).alias("first"), F.max("cur").alias("cur"))
    got = minute_deltas(rows).join(first, "host").where(F.col("minute") * 60_000 >= F.col("first"))
    sums = got.groupBy("host", *ROW, "type", "first", "cur").agg(*[F.sum(c).alias(c) for c in WINDOWED])
    return _windowed(sums, F.when(F.col("req_tot") == 0, F.col("stot")).otherwise(F.col("req_tot")), (F.col("cur") - F.col("first")) / 1000)


def window_choose(rows: DataFrame, minutes: int) -> DataFrame:
    """The long form above an hour, else the short form unless the long one covers over 30 s more."""
    long = window_from_minutes(rows, minutes)
    if minutes > FINE_MINUTES:
        return long
    # A row per counter row each: written, as the choice and its result read them.
    long, short = materialize(long, "long-window"), materialize(window_delta(rows, minutes), "short-window")
    reach = [w.groupBy("host").agg(F.max("covered_seconds").alias(a)) for w, a in ((short, "_short"), (long, "_long"))]
    pick = reach[0].join(reach[1], "host", "full").select("host", (F.col("_short").isNull() | (F.coalesce("_long", F.lit(0.0)) > F.col("_short") + 30)).alias("_use_long"))
    parts = [w.join(pick, "host").where(c).drop("_use_long") for w, c in ((short, ~F.col("_use_long")), (long, F.col("_use_long")))]
    return parts[0].unionByName(parts[1])


def history_points(rows: DataFrame, minutes: int) -> DataFrame:
    """Points since the start of the window: fine ones up to an hour unless there are none or minute
    points begin over 60 s earlier."""
    cur = rows.groupBy("host").agg((F.max("at_ms") - minutes * 60_000).alias("_from"))
    coarse = minute_points(rows).join(cur, "host").where("at_ms >= _from").select("host", "at_ms", *POINT)
    if minutes > FINE_MINUTES:
        return coarse
    fine = traffic_points(rows).join(cur, "host").where("at_ms >= _from").select("host", "at_ms", *POINT)
    reach = [p.groupBy("host").agg(F.min("at_ms").alias(a)) for p, a in ((fine, "_fine"), (coarse, "_coarse"))]
    pick = reach[0].join(reach[1], "host", "full").select("host", (F.col("_fine").isNull() | (F.coalesce(F.col("_coarse") < F.col("_fine") - 60_000, F.lit(False)))).alias("_c"))
    parts = [p.join(pick, "host").where(c).drop("_c") for p, c in ((fine, ~F.col("_c")), (coarse, F.col("_c")))]
    return parts[0].unionByName(parts[1])


def downsample(points: DataFrame, values: list[str], most: int = CHART_POINTS) -> DataFrame:
    """At most ``most`` points per host: means of consecutive groups, stamped with the group's last."""
    w = Window.partitionBy("host")
    n = points.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy("at_ms")) - 1)
    group = F.floor(F.col("_i") / F.ceil(F.col("_n") / most)).alias("_g")
    return n.groupBy("host", group).agg(F.max("at_ms").alias("at_ms"), *[F.avg(c).alias(c) for c in values]).drop("_g")


def error_ratio(window: DataFrame, keys: list[str]) -> DataFrame:
    every = sum((F.col(c) for c in CODES[1:]), F.col(CODES[0]))
    return window.groupBy(*keys).agg(F.try_divide(F.sum("h5"), F.sum(every)).alias("error_ratio"))


def backend_requests(window: DataFrame) -> DataFrame:
    return window.where("type = 1").agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"))


def topology(rows: DataFrame) -> DataFrame:
    """Frontends, and backends with their servers; a backend with servers only is made up."""
    keys = row_keys(rows, row=["pxname"])
    fronts = rows.where("type = 0").select(*keys).distinct().select(*keys, F.lit("frontend").alias("role"), F.array().cast("array<string>").alias("servers"), F.lit(True).alias("has_row"))
    backs = rows.where("type = 1").select(*keys).distinct().withColumn("has_row", F.lit(True))
    servers = rows.where("type = 2").groupBy(*keys).agg(F.sort_array(F.collect_set("svname")).alias("servers"))
    both = backs.join(servers, keys, "full").select(*keys, F.lit("backend").alias("role"), F.coalesce("servers", F.array().cast("array<string>")).alias("servers"), F.coalesce("has_row", F.lit(False)).alias("has_row"))
    return fronts.unionByName(both)


def pulse_summary(now: DataFrame, rates: DataFrame, window: DataFrame, state: DataFrame) -> DataFrame:
    """One row of fleet totals: rates, requests, connections, error ratio, servers by state."""
    k = F.lit(1).alias("_k")
    front = now.where("type = 0").agg(F.coalesce(F.sum("req_tot"), F.lit(0)).alias("requests")).select(k, "requests")
    rate = rates.where("type = 0").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("rps", "bytes_in", "bytes_out")]).select(k, "*")
    errors = error_ratio(window.where("type = 0"), []).select(k, "error_ratio")
    kind = X.server_state(F.col("status"))
    states = state.agg(
        F.coalesce(F.sum(F.when(F.col("type") == 0, F.col("scur"))), F.lit(0)).alias("connections"), F.count_if(F.col("type") == 2).alias("servers"),
        *[F.count_if((F.col("type") == 2) & (kind == s)).alias(s) for s in ("up", "failing", "recovering", "down", "maint", "drain", "nocheck")],
    ).select(k, "*")
    return front.join(rate, "_k").join(errors, "_k").join(states, "_k").drop("_k")


def top_backends(now: DataFrame, window: DataFrame) -> DataFrame:
    """Backends by requests in the window, or over their life where there is no window."""
    life = now.where("type = 1").select("host", *ROW, F.coalesce(F.col("req_tot"), F.col("stot"), F.lit(0)).cast("double").alias("lifetime"))
    got = life.join(window.where("type = 1").select("host", *ROW, "n", F.lit(1).alias("_seen")), ["host", *ROW], "left")
    some = F.max(F.coalesce("_seen", F.lit(0))).over(Window.partitionBy()) == 1
    value = got.withColumn("n", F.when(some, F.coalesce("n", F.lit(0.0))).otherwise(F.col("lifetime"))).drop("_seen", "svname")
    share = F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy())), F.lit(0.0))
    return value.withColumn("share", share).orderBy(F.desc("n"), "pxname")


def backend_ranking(state: DataFrame, window: DataFrame) -> DataFrame:
    """Backends (of each host) with nothing reachable first, then those with trouble, then by requests."""
    kind, keys = X.server_state(F.col("status")), row_keys(state, window, row=["pxname"])
    econ = window.where("type = 2").groupBy(*keys).agg(F.max("econ").alias("econ"))
    servers = state.where("type = 2").groupBy(*keys).agg(
        (~F.bool_or(kind.isin(*X.REACHABLE))).alias("dead"), F.bool_or(kind.isin("down", "failing", "recovering")).alias("trouble")
    )
    n = window.where("type = 1").groupBy(*keys).agg(F.sum("n").alias("n"))
    got = state.where("type = 1").select(*keys).distinct().join(servers, keys, "left").join(econ, keys, "left").join(n, keys, "left")
    dead, bad = F.coalesce("dead", F.lit(False)), F.coalesce("trouble", F.lit(False)) | (F.coalesce("econ", F.lit(0.0)) > 0)
    score = F.when(dead, 2e9).otherwise(0.0) + F.when(bad, 1e9).otherwise(0.0) + F.coalesce("n", F.lit(0.0))
    return got.select(*keys, dead.alias("dead"), bad.alias("bad"), score.alias("score")).orderBy(F.desc("score"), *keys)


def error_attribution(window: DataFrame, code: str = "h5") -> DataFrame:
    """Per backend: errors by its own count and by its servers, the top server's share and own ratio,
    whether servers fail alike, and what the proxy made by itself."""
    every = sum((F.col(c) for c in CODES[1:]), F.col(CODES[0]))
    w = window.withColumn("e", F.col(code)).withColumn("total", every)
    ratio = F.when(F.col("total") >= 20, F.col("e") / F.col("total"))
    keys = row_keys(window, row=["pxname"])
    servers = w.where("type = 2").groupBy(*keys).agg(
        F.sum("e").alias("by_servers"), F.min_by(F.struct("svname", "e", "total"), F.struct(-F.col("e"), F.col("svname"))).alias("top"),
        F.count(ratio).alias("busy"), F.min(ratio).alias("least"), F.max(ratio).alias("most"),
    )
    own = w.where("type = 1").groupBy(*keys).agg(F.sum("e").alias("by_backend"))
    got = own.join(servers, keys, "full").fillna(0.0, ["by_servers", "by_backend"])
    named = F.col("top.e") > 0
    alike = F.coalesce((F.col("busy") >= 2) & (F.col("least") > 0) & (F.try_divide("most", "least") < 1.5), F.lit(False))
    gap = F.col("by_backend") - F.col("by_servers")
    return got.select(
        *keys, "by_backend", "by_servers", F.greatest("by_backend", "by_servers").alias("total"), F.when(named, F.col("top.svname")).alias("top_server"),
        F.when(named, F.col("top.e") / F.col("by_servers")).alias("top_share"), F.when(named, F.try_divide(F.col("top.e"), F.col("top.total"))).alias("top_ratio"), alike.alias("even"),
        F.when(gap > F.greatest(F.lit(5.0), F.col("by_backend") * 0.1), gap).alias("from_proxy"),
    )


def entity_tables(state: DataFrame, rates: DataFrame, window: DataFrame) -> DataFrame:
    """One row per frontend, backend and server (of each host) with its state, load and errors in the
    window."""
    every = sum((F.col(c) for c in CODES[1:]), F.col(CODES[0]))
    keys = row_keys(state, rates, window)
    last = rates.groupBy("host").agg(F.max("at_ms").alias("at_ms"))
    r = rates.join(last, ["host", "at_ms"], "left_semi").select(*keys, "rps")
    w = window.select(*keys, "n", "h4", "h5", every.alias("answers"), "econ", "eresp")
    kind = X.server_state(F.col("status"))
    health = state.where("type = 2").groupBy(*keys[:-1]).agg(F.count_if(kind == "up").alias("healthy"), F.count(F.lit(1)).alias("servers"))
    got = state.join(r, keys, "left").join(w, keys, "left").join(health, keys[:-1], "left")
    return got.select(
        *keys, "type", kind.alias("state"), X.explain_check(F.col("check_status"), F.col("check_code")).alias("check"), "scur", F.try_divide("scur", F.nullif("slim", F.lit(0))).alias("used"), "rps",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("n", "h4", "h5", "econ", "eresp")], F.try_divide("h4", "answers").alias("h4_share"), F.try_divide("h5", "answers").alias("h5_share"), "rtime",
        F.when(F.col("type") == 1, F.coalesce("healthy", F.lit(0))).alias("healthy"), F.when(F.col("type") == 1, F.coalesce("servers", F.lit(0))).alias("servers"),
    )

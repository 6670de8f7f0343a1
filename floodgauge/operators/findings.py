"""Rules over counters and the log: (level, rule, target, item, value) rows, and the host where the
counters have one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.functions import fields as X
from floodgauge.operators.counters import CODES, error_attribution, error_ratio, row_keys

LEVELS = {"bad": 0, "warn": 1, "info": 2}


def _row(df: DataFrame, level, rule: str, target, item=None, value=None) -> DataFrame:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    host = ["host"] if "host" in df.columns else []
    return df.select(*host, as_column(level).alias("level"), F.lit(rule).alias("rule"), as_column(target).alias("target"), as_column("" if item is None else item).alias("item"), as_column(value).cast("double").alias("value"))


def unreachable_backends(state: DataFrame) -> DataFrame:
    kind = X.server_state(F.col("status"))
    got = state.where("type = 2").groupBy(*row_keys(state, row=["pxname"])).agg(F.bool_or(kind.isin(*X.REACHABLE)).alias("ok")).where("NOT ok")
    return _row(got, "bad", "unreachable", F.col("pxname"))


def server_states(state: DataFrame) -> DataFrame:
    kind = X.server_state(F.col("status"))
    level = F.when(kind == "down", "bad").when(kind.isin("failing", "recovering"), "warn").when(kind.isin("maint", "drain"), "info")
    got = state.where("type = 2").withColumn("_level", level).where("_level IS NOT NULL")
    return _row(got, F.col("_level"), "server_state", F.col("pxname"), F.concat_ws(":", "svname", kind))


def connect_errors(state: DataFrame, window: DataFrame, recent: DataFrame | None) -> DataFrame:
    """Failed connections in the window; bad only where they go on and nothing checks the server."""
    keys = row_keys(state, window, *([] if recent is None else [recent]))
    got = state.where("type = 2").join(window.where("type = 2 AND econ > 0").select(*keys, "econ"), keys)
    now = F.col("econ") if recent is None else F.coalesce("econ_now", F.lit(0.0))
    got = got if recent is None else got.join(recent.select(*keys, F.col("econ").alias("econ_now")), keys, "left")
    nocheck = X.server_state(F.col("status")) == "nocheck"
    going_on = _row(got.where(now > 0), F.when(nocheck, "bad").otherwise("warn"), "connect_errors", F.col("pxname"), F.col("svname"), now)
    return going_on.unionByName(_row(got.where(now <= 0), "warn", "connect_errors_recovered", F.col("pxname"), F.col("svname"), F.col("econ")))


def flapping(state: DataFrame) -> DataFrame:
    return _row(state.where("type = 2 AND chkdown >= 5"), "warn", "flapping", F.col("pxname"), F.col("svname"), F.col("chkdown"))


def queueing(state: DataFrame) -> DataFrame:
    return _row(state.where("type = 1 AND qcur > 0"), "warn", "queueing", F.col("pxname"), None, F.col("qcur"))


def backend_errors(window: DataFrame) -> DataFrame:
    """Backends with over 2 % server errors in at least 50 answers; the item is the top server, with
    ``=`` where the servers fail alike."""
    every = sum((F.col(c) for c in CODES[1:]), F.col(CODES[0]))
    keys = row_keys(window, row=["pxname"])
    own = window.where("type = 1").groupBy(*keys).agg(F.sum(every).alias("answers")).join(error_ratio(window.where("type = 1"), keys), keys)
    got = own.where("answers >= 50 AND error_ratio > 0.02").join(error_attribution(window), keys)
    return _row(got, "warn", "backend_5xx", F.col("pxname"), F.concat(F.coalesce("top_server", F.lit("")), F.when(F.col("even"), "=").otherwise("")), F.col("error_ratio"))


def slow_backends(state: DataFrame) -> DataFrame:
    return _row(state.where("type = 1 AND rtime > 800"), "warn", "slow_backend", F.col("pxname"), None, F.col("rtime"))


def saturated_frontends(state: DataFrame) -> DataFrame:
    f = state.where("type = 0")
    full = X.server_state(F.col("status")) == "full"
    used = F.try_divide("scur", F.nullif("slim", F.lit(0)))
    return _row(f.where(full), "bad", "frontend_full", F.concat(F.lit("fe:"), "pxname")).unionByName(_row(f.where(~full & (used > 0.8)), "warn", "frontend_saturation", F.concat(F.lit("fe:"), "pxname"), None, used))


def unrouted(totals: DataFrame, blocked: DataFrame) -> DataFrame:
    """From the log: requests without a matching backend (the item is the most frequent), and requests
    without a server, bad where they go on in the last two minutes."""
    top = blocked.where("kind = 'nomatch'").orderBy(F.desc("n"), "path", F.concat("method", "kind")).limit(1).select("kind", F.concat_ws(" ", "method", "path").alias("top"))
    nomatch = totals.where("kind = 'nomatch' AND n > 0").join(top, "kind", "left")
    noserver = totals.where("kind = 'noserver' AND n > 0")
    out = _row(nomatch, "warn", "nomatch", "logs", F.coalesce("top", F.lit("")), F.col("n"))
    out = out.unionByName(_row(noserver.where("recent > 0"), "bad", "noserver", "logs", None, F.col("recent")))
    return out.unionByName(_row(noserver.where("recent = 0"), "warn", "noserver_recovered", "logs", None, F.col("n")))


def all_findings(state: DataFrame, window: DataFrame, recent: DataFrame | None, totals: DataFrame, blocked: DataFrame) -> DataFrame:
    """The union of all rules with the rank of the level."""
    parts = [
        unreachable_backends(state), server_states(state), connect_errors(state, window, recent), flapping(state), queueing(state), backend_errors(window),
        slow_backends(state), saturated_frontends(state), unrouted(totals, blocked),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    rank = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in LEVELS.items()])
    return out.withColumn("rank", rank).orderBy("rank")

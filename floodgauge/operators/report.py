"""The live report over the last minutes of request records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodgauge.functions import fields as X
from floodgauge.operators.cidr import ip_in_cidrs
from floodgauge.operators.rollup import minute, with_counts

OTHER = "(other)"
PATH_KEY = ["backend", "method", "path"]


def one() -> Column:
    return F.count(F.lit(1)).alias("n")


def last_minutes(access: DataFrame, now_minute: int, minutes: int, retention: int = 1440) -> DataFrame:
    """Records of the last N minutes, N held within 1 and the retention; raw tcp is left out."""
    n = max(1, min(minutes, retention))
    return access.where((minute() >= now_minute - n + 1) & (F.col("kind") != "tcp"))


def ranked(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key, after aggregation."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def _sums(*names: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def report_totals(rows: DataFrame, now_minute: int) -> DataFrame:
    """One row per kind: n, recent (last two minutes), classes, lines with a host, last time."""
    recent = F.count_if(minute() > now_minute - 2).alias("recent")
    return with_counts(rows).groupBy("kind").agg(*_sums("n"), recent, *_sums("s2", "s3", "s4", "s5", "with_host"), F.max("at_ms").alias("last_at"))


def report_top_paths(rows: DataFrame, n: int = 40) -> DataFrame:
    got = with_counts(rows).groupBy(*PATH_KEY).agg(*_sums("n", "s2", "s3", "s4", "s5", "sum_ta", "n_ta"))
    got = got.withColumn("avg_ms", F.try_divide("sum_ta", "n_ta")).drop("sum_ta", "n_ta")
    return got.orderBy(F.desc("n"), "path", F.concat("method", "backend")).limit(n)


def _top_codes(counted: DataFrame, keys: list[str], codes: int = 6) -> DataFrame:
    """Per key the most frequent codes, the rest as ``other``: keys, code, n."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "status")
    code = F.when(F.row_number().over(order) <= codes, F.col("status").cast("string")).otherwise("other")
    return counted.withColumn("code", code).groupBy(*keys, "code").agg(F.sum("n").alias("n"))


def path_ip_breakdown(rows: DataFrame, listed: DataFrame, ips: int = 20) -> DataFrame:
    """Codes of the busiest addresses of each listed path: key, client, code, n. Addresses beyond the
    first are one remainder row, so that a path's numbers add up."""
    each = rows.join(F.broadcast(listed.select(*PATH_KEY)), PATH_KEY, "left_semi").groupBy(*PATH_KEY, "client", "status").agg(one())
    order = Window.partitionBy(*PATH_KEY).orderBy(F.desc("total"), "client")
    totals = each.groupBy(*PATH_KEY, "client").agg(F.sum("n").alias("total")).withColumn("shown", F.row_number().over(order) <= ips)
    label = F.when(F.col("shown"), F.col("client")).otherwise(OTHER)
    named = each.join(totals.drop("total"), [*PATH_KEY, "client"]).withColumn("client", label)
    return _top_codes(named.groupBy(*PATH_KEY, "client", "status").agg(F.sum("n").alias("n")), [*PATH_KEY, "client"])


def code_paths(rows: DataFrame, per_class: int = 20) -> DataFrame:
    """Paths with answers above 299: the busiest of each class, together once."""
    mixed = F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("")
    got = with_counts(rows).groupBy(*PATH_KEY).agg(mixed.alias("kind"), *_sums("n", "s3", "s4", "s5"))
    tie = F.concat("path", "method", "backend")
    tops = [got.where(f"{c} > 0").orderBy(F.desc(c), tie).limit(per_class) for c in ("s5", "s4", "s3")]
    return tops[0].union(tops[1]).union(tops[2]).distinct()


def code_path_codes(rows: DataFrame, listed: DataFrame, codes: int = 6) -> DataFrame:
    counted = rows.join(F.broadcast(listed.select(*PATH_KEY)), PATH_KEY, "left_semi").groupBy(*PATH_KEY, "status").agg(one())
    return ranked(counted, PATH_KEY, [F.desc("n"), "status"], codes)


def blocked_requests(rows: DataFrame, n: int = 40) -> DataFrame:
    got = rows.where(X.is_blocked(F.col("kind"))).groupBy("kind", "method", "path").agg(one())
    return got.orderBy(F.desc("n"), "path", F.concat("method", "kind")).limit(n)


def request_detail(rows: DataFrame, listed: DataFrame, keys: list[str], origins: int = 8, samples: int = 5, ips: int = 8) -> DataFrame:
    """Origins, raw paths and addresses of listed rows: keys, section, name, n, total, host_known."""
    own = rows.join(F.broadcast(listed.select(*keys)), keys, "left_semi").withColumn("origin", X.origin(F.col("host"), F.col("tls")))
    totals = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("origin") != "").alias("host_known"))
    parts = []
    for section, column, n in (("origin", "origin", origins), ("sample", "raw_path", samples), ("ip", "client", ips)):
        counted = own.groupBy(*keys, F.col(column).alias("name")).agg(one())
        parts.append(ranked(counted, keys, [F.desc("n"), "name"], n).withColumn("section", F.lit(section)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(totals, keys)


def top_clients(rows: DataFrame, cidrs: DataFrame, n: int = 30) -> DataFrame:
    got = with_counts(rows).groupBy("client").agg(*_sums("n", "blocked")).orderBy(F.desc("n"), "client").limit(n)
    return ip_in_cidrs(got, cidrs)


def _request(df: DataFrame) -> Column:
    return F.concat_ws(" ", "method", "path")


def client_paths(rows: DataFrame, clients: DataFrame, n: int = 6) -> DataFrame:
    own = rows.join(F.broadcast(clients.select("client")), "client", "left_semi")
    return ranked(own.groupBy("client", _request(own).alias("request")).agg(one()), ["client"], [F.desc("n"), "request"], n)


def backend_breakdown(rows: DataFrame) -> DataFrame:
    return with_counts(rows).groupBy("backend").agg(*_sums("n", "s2", "s3", "s4", "s5", "blocked")).orderBy(F.desc("n"), "backend")


def backend_tops(rows: DataFrame, n: int = 10) -> DataFrame:
    """The busiest requests and addresses of each backend: backend, section, name, n."""
    paths = rows.groupBy("backend", _request(rows).alias("name")).agg(one())
    ips = rows.groupBy("backend", F.col("client").alias("name")).agg(one())
    return ranked(paths, ["backend"], [F.desc("n"), "name"], n).withColumn("section", F.lit("path")).unionByName(
        ranked(ips, ["backend"], [F.desc("n"), "name"], n).withColumn("section", F.lit("ip"))
    )


def request_summary(totals: DataFrame, minutes: int) -> DataFrame:
    """One row: shares and rates per minute of the classes, and where requests ended."""
    def kinds(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*names), F.col("n"))), F.lit(0))

    got = totals.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "s2", "s3", "s4", "s5")],
        kinds("served").alias("reached_server"), kinds("redirect", "denied", "proxy").alias("answered_by_proxy"), kinds("nomatch", "noserver").alias("reached_nothing"),
    )
    for c in ("s2", "s3", "s4", "s5"):
        got = got.withColumn(f"{c}_share", F.try_divide(c, F.col("s2") + F.col("s3") + F.col("s4") + F.col("s5"))).withColumn(f"{c}_per_minute", F.col(c) / minutes)
    return got


def stats_vs_log_check(backend_requests: DataFrame, totals: DataFrame, errors_only: bool = False) -> DataFrame:
    """One row: the counters saw at least 100 requests reach backends, the log none though it was read.

    Both inputs are reduced to one row before they meet."""
    log = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("parsed"), F.coalesce(F.sum(F.when(F.col("kind") == "served", F.col("n"))), F.lit(0)).alias("served"))
    seen = backend_requests.agg(F.coalesce(F.sum("n"), F.lit(0.0)).cast("double").alias("backend_requests"))
    silent = (F.col("backend_requests") >= 100) & (F.col("parsed") > 0) & (F.col("served") == 0) & F.lit(not errors_only)
    return seen.withColumn("_k", F.lit(1)).join(log.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn("warn", silent)

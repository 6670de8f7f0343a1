"""Host metrics from cumulative samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUES = ["cpu", "iowait", "steal", "mem_pct", "swap_pct", "read_sectors", "write_sectors", "load1"]
# Fixed value: whole physical disks; partitions and virtual devices count twice or not at all.
PHYSICAL = r"^(sd[a-z]+|vd[a-z]+|xvd[a-z]+|hd[a-z]+|nvme[0-9]+n[0-9]+)$"
JIFFIES = ["user_j", "nice_j", "system_j", "idle_j", "iowait_j", "irq_j", "softirq_j", "steal_j"]


def physical_device(name: Column) -> Column:
    return name.rlike(PHYSICAL)


def _before(name: str) -> Column:
    return F.lag(name).over(Window.partitionBy("host").orderBy("at_ms"))


def cpu_percent(samples: DataFrame) -> DataFrame:
    """host, at_ms, cpu, iowait, steal in percent since the sample before; 0 without one."""
    total = sum((F.col(c) for c in JIFFIES if c in samples.columns), F.lit(0))
    s = samples.withColumn("_total", total).withColumn("_idle", F.col("idle_j") + F.col("iowait_j"))
    d = {a: F.col(c) - _before(c) for a, c in (("_dt", "_total"), ("_di", "_idle"), ("_dw", "iowait_j"), ("_ds", "steal_j"))}
    s = s.withColumns(d)
    share = lambda part: F.when(F.col("_dt") > 0, 100 * part / F.col("_dt")).otherwise(0.0)
    return s.select("host", "at_ms", share(F.col("_dt") - F.col("_di")).alias("cpu"), share(F.col("_dw")).alias("iowait"), share(F.col("_ds")).alias("steal"))


def mem_percent(samples: DataFrame) -> DataFrame:
    used = lambda total, free: F.when(F.col(total) > 0, 100 * (F.col(total) - F.col(free)) / F.col(total)).otherwise(0.0)
    return samples.select("host", "at_ms", used("mem_total", "mem_available").alias("mem_pct"), used("swap_total", "swap_free").alias("swap_pct"))


def disk_rates(devices: DataFrame) -> DataFrame:
    """Sectors per second of all physical devices: host, at_ms, read_sectors, write_sectors.

    A device counts against the host's sample before, where it was present there and did not fall."""
    own = devices.where(physical_device(F.col("device")))
    times = devices.select("host", "at_ms").distinct().withColumn("prev_at", _before("at_ms"))
    then = own.select("host", F.col("at_ms").alias("prev_at"), "device", F.col("sectors_read").alias("r0"), F.col("sectors_written").alias("w0"))
    got = own.join(times.where("prev_at < at_ms"), ["host", "at_ms"]).join(then, ["host", "prev_at", "device"])
    dt = (F.col("at_ms") - F.col("prev_at")) / 1000
    rate = lambda now, was: F.sum(F.when(F.col(now) >= F.col(was), (F.col(now) - F.col(was)) / dt).otherwise(0.0))
    sums = got.groupBy("host", "at_ms").agg(rate("sectors_read", "r0").alias("read_sectors"), rate("sectors_written", "w0").alias("write_sectors"))
    return times.select("host", "at_ms").join(sums, ["host", "at_ms"], "left").fillna(0.0, ["read_sectors", "write_sectors"])


def metric_points(samples: DataFrame, devices: DataFrame) -> DataFrame:
    keys = ["host", "at_ms"]
    return cpu_percent(samples).join(mem_percent(samples), keys).join(disk_rates(devices), keys).join(samples.select(*keys, F.col("load1").cast("double").alias("load1")), keys)


def metric_minutes(points: DataFrame, retention: int | None = 1440) -> DataFrame:
    """Means per minute, stamped with its start; the last, open minute is not closed yet. The newest
    ``retention`` closed minutes of a host, or all of them (None). A minute's points are summed in the
    order of their times, so that a mean is the same to its last digit however the rows are dealt."""
    w, own = Window.partitionBy("host"), Window.partitionBy("host", "minute").orderBy("at_ms")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    means = points.withColumn("minute", F.expr("at_ms DIV 60000")).select("host", "minute", F.row_number().over(own).alias("_n"), *[F.avg(c).over(whole).alias(c) for c in VALUES])
    closed = means.where("_n = 1").withColumn("_last", F.max("minute").over(w)).where("minute < _last")
    if retention is not None:
        closed = closed.withColumn("_r", F.row_number().over(w.orderBy(F.desc("minute")))).where(F.col("_r") <= retention)
    return closed.select("host", (F.col("minute") * 60_000).alias("at_ms"), *VALUES)


def metric_history(points: DataFrame, minutes: int, now_ms: int, fine_since_ms: int = 0) -> DataFrame:
    """Above an hour minute means; else fine points (those kept since ``fine_since_ms``) behind the
    minute means that lie over 60 s before the first of them. Only the range cuts, not the retention
    of minutes; means are taken of no points but those that the range can show."""
    from_ms = now_ms - minutes * 60_000
    in_range = points.where(F.col("at_ms") >= -(-from_ms // 60_000) * 60_000)  # the first minute that begins in it
    if minutes > 60:
        return metric_minutes(in_range, None)
    fine = points.where(F.col("at_ms") >= fine_since_ms).select("host", "at_ms", *VALUES)
    first = fine.groupBy("host").agg(F.min("at_ms").alias("_first"))
    # A fine point closes every minute that lies 60 s before it, so points before the fine ones make all means that stay.
    early = metric_minutes(in_range.where(F.col("at_ms") < fine_since_ms).unionByName(first.selectExpr("host", "_first AS at_ms"), True), None)
    older = early.join(first, "host", "left").where(F.col("_first").isNull() | (F.col("at_ms") < F.col("_first") - 60_000)).drop("_first")
    return older.unionByName(fine.where(F.col("at_ms") >= from_ms))


def disk_usage(mounts: DataFrame) -> DataFrame:
    """path and used percent, each file system once by its first path in the given order (``n``)."""
    got = mounts.where("total > 0").groupBy("host", "fsid").agg(F.min_by(F.struct("path", "total", "free"), "n").alias("m"))
    return got.select("host", F.col("m.path").alias("path"), (100 * (F.col("m.total") - F.col("m.free")) / F.col("m.total")).alias("used_pct"))


def metric_levels(points: DataFrame) -> DataFrame:
    """Levels of cpu, memory and waiting for disks: bad, warn or ok."""
    level = lambda c, bad, warn: (F.when(F.col(c) >= bad, "bad") if bad else F.when(F.lit(False), "bad")).when(F.col(c) >= warn, "warn").otherwise("ok")
    return points.select("host", "at_ms", level("cpu", 85, 60).alias("cpu_level"), level("mem_pct", 90, 80).alias("mem_level"), level("iowait", None, 20).alias("iowait_level"))


def disk_levels(usage: DataFrame) -> DataFrame:
    return usage.withColumn("level", F.when(F.col("used_pct") >= 90, "bad").when(F.col("used_pct") >= 80, "warn").otherwise("ok"))

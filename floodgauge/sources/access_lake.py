"""Access records kept as a lake: Parquet partitioned by date and hour of the request's start, in time
order within each file, so that a range reads its hours only and skips row groups inside them.

Logs are written when a request ends and stamped with its start, so records of one load fall into
earlier hours too; they are placed by their start, and the range of a read is exact without slack. A
load replaces itself when it is written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.operators.incident import coarse_slice, time_slice
from floodgauge.operators.parse import ACCESS


def _start() -> Column:
    return F.timestamp_millis(F.col("at_ms"))


def write_access_lake(access: DataFrame, path: str, load: str, rows_per_file: int = 5_000_000) -> None:
    """Add the records of one load. Hours are spread over tasks by ranges of time, so that a busy hour
    is written by several; records without a time are left out, as no range can find them."""
    if not load or "/" in load or "=" in load:
        raise ValueError(f"not the name of a load: {load!r}")
    placed = access.where("at_ms IS NOT NULL").select(*ACCESS, F.to_date(_start()).alias("date"), F.hour(_start()).alias("hour"))
    dealt = placed.repartitionByRange("at_ms").sortWithinPartitions("date", "hour", "at_ms")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("date", "hour").parquet(f"{path.rstrip('/')}/load={load}")


def read_access_lake(spark: SparkSession, path: str, from_ms: int, to_ms: int) -> DataFrame:
    """The records that start in [from_ms, to_ms], of all loads; other hours are not read."""
    kinds = {"at_ms": "long", "ta": "int", "status": "int", "tls": "boolean"}
    schema = ", ".join([*(f"{c} {kinds.get(c, 'string')}" for c in ACCESS), "load string", "date date", "hour int"])
    rows = spark.read.schema(schema).parquet(path)
    return time_slice(coarse_slice(rows, from_ms, to_ms, "date", "hour", slack_ms=0), from_ms, to_ms).select(*ACCESS)

"""Streams over data derived from the tables, read to their end, with the SQL of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.operators.parse import parse_access, render_access
from floodgauge.plans import fixtures as fx
from floodgauge.plans.counter_queries import BASE, RATES, counters
from floodgauge.plans.incident_queries import _events_sql
from floodgauge.plans.log_queries import _DAY, A, ROLLUP_SQL
from floodgauge.sources.scratch import scratch_dir
from floodgauge.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}
HIGH_WATER = fx.T0 + 43_200_000


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def as_stream(df: DataFrame, name: str) -> DataFrame:
    """A stream of the files that ``df`` makes in the shared folder."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def collected(stream: DataFrame, name: str) -> DataFrame:
    """All rows that an append stream gives until its input ends."""
    spark = stream.sparkSession
    out, checkpoint = scratch_dir(spark, name), scratch_dir(spark, f"{name}-checkpoint")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("T1_stream_minute_rollup", f"WITH {_DAY} {ROLLUP_SQL['backends']}")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backends per minute; the lateness covers the whole day, as its records come in any order."""
    updates = live.stream_minute_rollup(as_stream(fx.access(spark, sf_dir), "access"), "backends", "1 day")
    store, checkpoint = scratch_dir(spark, "rollup"), scratch_dir(spark, "rollup-checkpoint")
    live.upsert(updates, store, checkpoint).awaitTermination()
    return live.read_upserts(spark, store, ["minute", "backend"])


@query("T2_resume_filter", f"WITH {A} SELECT at_ms > {HIGH_WATER} AS again, count(*) AS n, max(at_ms) AS high_water_ms FROM access GROUP BY ALL")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run up to a mark and one that resumes behind it, which counts nothing twice."""
    access = fx.access(spark, sf_dir)
    parts = []
    for again, rows in ((False, access.where(F.col("at_ms") <= HIGH_WATER)), (True, live.resume_filter(access, HIGH_WATER))):
        mark = rows.agg(F.count(F.lit(1)).alias("n"), F.max("at_ms").alias("high_water_ms"))
        parts.append(mark.select(F.lit(again).alias("again"), "n", "high_water_ms"))
    return parts[0].unionByName(parts[1])


@query("T3_stream_counter_rates", f"{BASE}, {RATES} SELECT 'lb' || h AS host, rates.* FROM rates CROSS JOIN (SELECT unnest(range(1, 5)) AS h) hosts")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hosts of the same counters, whose snapshots are numbered by their ticks."""
    hosts = F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda h: F.concat(F.lit("lb"), h.cast("string"))))
    rows = counters(spark, sf_dir).withColumn("host", hosts).withColumn("snapshot", F.expr("at_ms DIV 10000"))
    return collected(live.stream_counter_rates(as_stream(rows, "counters")), "rates")


@query("T4_stream_restart_coalesce", f"{_events_sql('true')} SELECT type, at_ms FROM kept WHERE type IN ('start', 'stop')")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected(live.stream_restart_coalesce(as_stream(fx.events(spark, sf_dir), "events")), "restarts")


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines, every twentieth or so damaged, with the time they arrive: when their request starts."""
    access = fx.dealt(fx.access(spark, sf_dir)).where("at_ms IS NOT NULL")
    line = render_access(access.where("ta % 20 <> 7")).union(render_access(access.where("ta % 20 = 7")).select(F.regexp_replace("value", r"\] .*$", "] ?")))
    stamp = F.try_to_timestamp(F.regexp_extract("value", r"\[(\d{2}/[^\]]+)\]", 1), F.lit("dd/MMM/yyyy:HH:mm:ss.SSS"))
    return line.withColumn("arrived", stamp)


@query("T5_stream_parse_quality", f"WITH {A} SELECT at_ms // 60000 AS minute, count(*) FILTER (ta % 20 <> 7) AS parsed, count(*) FILTER (ta % 20 = 7) AS unparsed FROM access GROUP BY ALL")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth or so line is damaged; lines arrive when their request starts, in any order of
    the day."""
    stream = live.stream_parse_quality(parse_access(as_stream(damaged(spark, sf_dir), "lines")), "arrived", lateness="1 day")
    store, checkpoint = scratch_dir(spark, "quality"), scratch_dir(spark, "quality-checkpoint")
    live.upsert(stream, store, checkpoint).awaitTermination()
    return live.read_upserts(spark, store, ["minute"])


_SAMPLE = "client || ':40000 [01/Jan/2024:' || strftime(epoch_ms(at_ms), '%H:%M:%S.%g') || '] ?…'"


@query("T5_stream_samples", f"WITH {A}, o AS (SELECT at_ms // 60000 AS minute, {_SAMPLE} AS sample, row_number() OVER (PARTITION BY at_ms // 60000 ORDER BY at_ms DESC, {_SAMPLE} DESC) AS k FROM access WHERE ta % 20 = 7) SELECT minute, string_agg(sample, ';' ORDER BY k) AS samples FROM o WHERE k <= 3 GROUP BY minute")
def t5_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three damaged lines of each minute; the lines come in any order of the day."""
    stream = live.stream_unparsed_samples(parse_access(as_stream(damaged(spark, sf_dir), "sampled")), "arrived", lateness="1 day")
    store, checkpoint = scratch_dir(spark, "samples"), scratch_dir(spark, "samples-checkpoint")
    live.upsert(stream, store, checkpoint).awaitTermination()
    return live.read_upserts(spark, store, ["minute"]).select("minute", F.array_join("samples", ";").alias("samples"))

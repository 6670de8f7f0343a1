"""Queries from files: text logs, counter dumps, minute summaries and report sections, written from the
derived inputs and read back through the sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.functions import fields as X
from floodgauge.operators import counters as ctr
from floodgauge.operators import report, rollup, search
from floodgauge.operators.parse import ACCESS, parse_access, render_access
from floodgauge.plans import fixtures as fx
from floodgauge.plans.counter_queries import EPOCHS, RATES
from floodgauge.plans.log_queries import _DAY, _END, FROM, TO, A, BLOCKED, ROLLUP_SQL
from floodgauge.sources import logs
from floodgauge.sources.access_lake import read_access_lake, write_access_lake
from floodgauge.sources.minute_store import MinuteStore
from floodgauge.sources.scratch import scratch_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOON = fx.T0 + fx.DAY_MS // 2


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """The name of a log: the afternoon in plain files, the morning in rotated, compressed ones."""
    folder, access = scratch_dir(spark, "log"), fx.dealt(fx.access(spark, sf_dir))
    render_access(access.where(F.col("at_ms") >= NOON)).write.text(folder)
    render_access(access.where(F.col("at_ms") < NOON)).write.mode("append").option("compression", "gzip").text(folder)
    return f"{folder}/part"


@query("S1_read_log_lines", f"WITH {A} SELECT {', '.join(ACCESS)} FROM access")
def s1(spark, sf_dir):
    """Text files, some compressed, to records."""
    return parse_access(logs.read_log_lines(spark, log_files(spark, sf_dir))).select("access.*")


_LINE = """'Jan  1 00:00:00 lb1 haproxy[77]: ' || client || ':40000 [01/Jan/2024:00:00:00.000] ' || frontend || CASE WHEN tls THEN '~' ELSE '' END || ' ' || backend || '/' || server || ' 0/0/1/2/' || ta
  || ' ' || status || ' 512 - - ' || term || ' 1/1/0/0/0 0/0 {' || host || '} "' || method || ' ' || raw_path || ' HTTP/1.1"'"""


@query("Q1_scanned", f"WITH {A} SELECT count(*) AS lines, CAST(sum(strlen({_LINE}) + 1) AS BIGINT) AS bytes FROM access")
def q1_scanned(spark, sf_dir):
    """Lines and bytes that a search reads."""
    return search.scanned(logs.read_log_lines(spark, log_files(spark, sf_dir)))


_DUMPS = f"WITH {fx.DUCK_COUNTERS.replace('counters AS (', 'every AS (')}, counters AS (SELECT * FROM every WHERE at_ms % 60000 = 0), {EPOCHS}, {RATES}"


@query("S2_read_counter_dump", f"{_DUMPS} SELECT 'lb1' AS host, * FROM rates")
def s2(spark, sf_dir):
    """One dump a minute as CSV text, the type of servers left empty, and the uptime as its info; read
    back into rates (S2, P17, P18, C2)."""
    rows = fx.counters(spark, sf_dir).where("at_ms % 60000 = 0")
    columns = ["pxname", "svname", "type", "req_tot", "stot", *ctr.CODES, "econ", "eresp", "bin_bytes", "bout"]
    values = [F.when(F.col("type") < 2, F.col("type").cast("string")).otherwise("") if c == "type" else F.col(c).cast("string") for c in columns]
    text = rows.select(F.col("at_ms").alias("dump_id"), F.concat(F.concat_ws(",", *values), F.lit(",")).alias("value"))
    head = rows.select(F.col("at_ms").alias("dump_id")).distinct().withColumn("value", F.lit("# " + ",".join(columns) + ","))
    info = rows.groupBy(F.col("at_ms").alias("dump_id")).agg(F.concat(F.lit("Uptime_sec: "), F.min("uptime_sec").cast("string")).alias("value"))
    dumps, infos = scratch_dir(spark, "dumps"), scratch_dir(spark, "infos")
    head.union(text).repartition(1, "dump_id").write.partitionBy("dump_id").text(dumps)
    info.write.partitionBy("dump_id").text(infos)
    got = logs.read_counter_dump(spark.read.text(dumps))
    up = logs.read_info_dump(spark.read.text(infos)).select("dump_id", X.number(F.col("info")["Uptime_sec"]).cast("long").alias("uptime_sec"))
    field = lambda c: F.col("fields")[c]
    typed = got.select("dump_id", "pxname", "svname", X.row_type(field("type"), F.col("svname")).alias("type"), *[X.number(field(c)).cast("long").alias(c) for c in columns[3:]])
    snapshots = typed.join(up, "dump_id").withColumn("host", F.lit("lb1")).withColumnRenamed("dump_id", "at_ms").withColumn("at_ms", F.col("at_ms").cast("long"))
    return ctr.counter_rates(snapshots)


@query("S3_minute_summaries", f"WITH {_DAY} SELECT * FROM ({ROLLUP_SQL['clients']}) WHERE {_END} - minute < 1000")
def s3(spark, sf_dir):
    """A day in three loads that share its minutes: two, the second of them repeated, are compacted before
    the third comes late; read within the retention."""
    path, access = scratch_dir(spark, "summaries"), fx.access(spark, sf_dir)
    part = lambda k: {"clients": rollup.minute_rollup(access.where(F.pmod("ta", F.lit(3)) == k))["clients"]}
    for k in (0, 1, 1):
        logs.write_minute_summaries(part(k), path, str(k))
    MinuteStore(spark, path).compact("clients")
    logs.write_minute_summaries(part(2), path, "2")
    return logs.read_minute_summaries(spark, path, "clients", _END, 1000)


_THIN = f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY minute ORDER BY n DESC, client) AS k FROM {{}}) WHERE {_END} - minute < 360 AND ({_END} - minute < 60 OR k <= 30)"
_CLIENTS = "SELECT minute, client, CAST(sum(n) AS BIGINT) AS n, CAST(sum(blocked) AS BIGINT) AS blocked FROM ({}) GROUP BY minute, client"


@query(
    "L13_stored_retention",
    f"WITH {_DAY.replace('FROM access)', 'FROM access WHERE ta % 5 <> 0)')}, a AS ({ROLLUP_SQL['clients']}), late AS (SELECT at_ms // 60000 AS minute, client, count(*) AS n, count(*) FILTER ({BLOCKED}) AS blocked FROM access WHERE ta % 5 = 0 GROUP BY ALL), "
    f"one AS ({_THIN.format('a')}), joined AS ({_CLIENTS.format('SELECT * FROM one UNION ALL SELECT * FROM late')}), two AS ({_THIN.format('joined')}) SELECT * FROM two",
)
def l13_stored(spark, sf_dir):
    """Lists of a store thinned by age; late rows fill old minutes again and are thinned with them."""
    store, access = MinuteStore(spark, scratch_dir(spark, "retained")), fx.access(spark, sf_dir)
    for load, rows in (("1", access.where("ta % 5 <> 0")), ("2", access.where("ta % 5 = 0"))):
        store.add({"clients": rollup.minute_rollup(rows)["clients"]}, load)
        store.retain(_END, 60, 360, 1000)
    return store.read("clients")


@query("F5_access_lake", f"WITH {A} SELECT {', '.join(ACCESS)} FROM access WHERE at_ms BETWEEN {FROM} AND {TO}")
def f5_lake(spark, sf_dir):
    """The records of a range from a lake of two loads, one of them written again."""
    path, access = scratch_dir(spark, "lake"), fx.access(spark, sf_dir)
    for load, rows in (("1", access.where("ta % 5 <> 0")), ("2", access.where("ta % 5 = 0")), ("2", access.where("ta % 5 = 0"))):
        write_access_lake(rows, path, load)
    return read_access_lake(spark, path, FROM, TO)


@query("S5_stream_log_lines", f"WITH {A} SELECT at_ms // 60000 AS minute, count(*) AS n FROM access GROUP BY ALL")
def s5(spark, sf_dir):
    """Log segments as a stream of records, kept as a section (S5, S6) and counted per minute."""
    stream = parse_access(logs.stream_log_lines(spark, log_files(spark, sf_dir), 4), fields=["at_ms"]).select("access.at_ms")
    path = scratch_dir(spark, "lines")
    logs.write_section(stream, path, checkpoint=scratch_dir(spark, "lines-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch=*").groupBy(rollup.minute().alias("minute")).agg(report.one())


@query("S6_write_section", f"WITH {A} SELECT backend, count(*) AS n FROM access GROUP BY backend")
def s6(spark, sf_dir):
    """A section as JSON."""
    path = scratch_dir(spark, "section")
    section = fx.access(spark, sf_dir).groupBy("backend").agg(report.one())
    logs.write_section(section, path, "json")
    return spark.read.schema(section.schema).json(path)

"""Streams read to the end equal the batch form."""

from pyspark.sql import functions as F

from floodgauge.operators import counters, incident, rollup
from floodgauge.operators.parse import parse_access, render_access
from floodgauge.plans import fixtures
from floodgauge.streaming import live


def _stream(spark, df, path, parts=4):
    df.repartition(parts).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _run(df, spark, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    return spark.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_minute_rollup(spark, sf_dir, tmp_path):
    a = fixtures.access(spark, sf_dir).where("at_ms % 5 = 0")
    s = live.stream_minute_rollup(_stream(spark, a, tmp_path / "a"), "backends", "2 days")
    q = live.upsert(s, str(tmp_path / "store"), str(tmp_path / "cp"))
    assert q.awaitTermination(150)
    batch = rollup.minute_rollup(a)["backends"]
    got = live.read_upserts(spark, str(tmp_path / "store"), ["minute", "backend"])
    assert rows(got.select(batch.columns)) == rows(batch)


def test_resume(spark, sf_dir):
    a = fixtures.access(spark, sf_dir)
    hwm = a.where("at_ms % 2 = 0").agg(F.percentile_approx("at_ms", 0.5)).first()[0]
    first, second = a.where(F.col("at_ms") <= hwm), live.resume_filter(a, hwm)
    assert first.count() + second.count() == a.count() and live.high_water(first).first()[0] == hwm


def test_counter_rates(spark, sf_dir, tmp_path):
    c = fixtures.counters(spark, sf_dir).withColumn("host", F.explode(F.array(F.lit("lb1"), F.lit("lb2")))).where("at_ms % 60000 = 0").withColumn("snapshot", F.expr("at_ms DIV 60000"))
    c.repartitionByRange(3, "at_ms").sortWithinPartitions("at_ms").write.parquet(str(tmp_path / "c"))
    files = sorted((tmp_path / "c").glob("*.parquet"))
    for i, f in enumerate(files):  # the source takes files by age
        import os

        os.utime(f, (1_700_000_000 + i,) * 2)
    s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
    got = _run(live.stream_counter_rates(s), spark, "rates", tmp_path)
    batch = counters.counter_rates(c)
    assert rows(got.select(batch.columns)) == rows(batch)


def test_restarts(spark, sf_dir, tmp_path):
    ev = fixtures.events(spark, sf_dir).where("type = 'start'")
    got = _run(live.stream_restart_coalesce(_stream(spark, ev.select("type", "at_ms"), tmp_path / "e", 1)), spark, "starts", tmp_path)
    assert rows(got) == rows(incident.coalesce_restarts(ev).select("type", "at_ms"))


def test_parse_quality(spark, sf_dir, tmp_path):
    a = fixtures.access(spark, sf_dir).limit(200)
    lines = render_access(a).union(spark.createDataFrame([("10.0.0.1:5 odd?k=1",)] * 3, "value string")).withColumn("arrived", F.timestamp_millis(F.lit(fixtures.T0)))
    s = parse_access(_stream(spark, lines, tmp_path / "l", 2))
    got = _run(live.stream_parse_quality(s, "arrived"), spark, "quality", tmp_path, "complete").collect()
    assert [(r.parsed, r.unparsed) for r in got] == [(200, 3)]
    spread = lines.withColumn("arrived", F.timestamp_millis(F.lit(fixtures.T0) + 60_000 * F.pmod(F.hash("value"), F.lit(7))))
    s = parse_access(_stream(spark, spread, tmp_path / "m", 3))
    q = live.upsert(live.stream_parse_quality(s, "arrived", lateness="1 hour"), str(tmp_path / "store"), str(tmp_path / "cp"))
    assert q.awaitTermination(150)
    want = spread.groupBy((F.unix_millis("arrived") / 60_000).cast("long").alias("minute")).agg(F.count_if(~F.contains("value", F.lit("odd"))).alias("parsed"), F.count_if(F.contains("value", F.lit("odd"))).alias("unparsed"))
    assert rows(live.read_upserts(spark, str(tmp_path / "store"), ["minute"]).select(want.columns)) == rows(want)
    live.compact(spark, str(tmp_path / "store"), str(tmp_path / "compacted"), ["minute"])
    assert rows(live.read_upserts(spark, str(tmp_path / "compacted"), ["minute"]).select(want.columns)) == rows(want)
    assert len(list((tmp_path / "compacted").iterdir())) == 1
    assert [r.sample for r in live.unparsed_samples(parse_access(lines)).collect()] == ["10.0.0.1:5 odd?…"] * 3


def test_samples_of_shuffled_batches(spark, tmp_path):
    """The newest three of each minute, whatever batch they come in; what is not traffic or parsed is none."""
    lines = [(60_000 * m + 7 * i % 60_000, f"10.0.0.{i}:5 [01/Jan/2024:00:00:00.000] odd?k={i}") for m in range(3) for i in range(40)]
    extra = [(5, "not traffic"), (None, "10.0.0.1:5 [01/Jan/2024:00:00:00.000] no time?")]
    df = spark.createDataFrame(lines + extra, "at long, value string").select("value", F.timestamp_millis("at").alias("arrived"))
    s = live.stream_unparsed_samples(parse_access(_stream(spark, df, tmp_path / "l", 5)), "arrived", lateness="1 hour")
    assert live.upsert(s, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(150)
    got = {r.minute: r.samples for r in live.read_upserts(spark, str(tmp_path / "store"), ["minute"]).collect()}
    newest = {m: sorted(((t, v.split("?")[0] + "?…") for t, v in lines if t // 60_000 == m), reverse=True)[:3] for m in range(3)}
    assert got == {m: [v for _, v in rows] for m, rows in newest.items()}

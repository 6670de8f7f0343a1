"""The stores of minute summaries and of access records, and thinning of times."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from floodgauge.operators import rollup
from floodgauge.operators.thinning import thinned_times
from floodgauge.plans import fixtures
from floodgauge.sources.access_lake import read_access_lake, write_access_lake
from floodgauge.sources.minute_store import REWRITTEN, MinuteStore

NOON = fixtures.T0 // 60000 + 720
DAY = 1440


def clients(spark, rows):
    return {"clients": spark.createDataFrame(rows, "minute long, client string, n long, blocked long")}


def content(store, **options):
    return sorted(tuple(r) for r in store.read("clients", **options).select("minute", "client", "n", "blocked").collect())


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_late_load_keeps_what_is_stored(spark, tmp_path):
    store = MinuteStore(spark, str(tmp_path))
    store.add(clients(spark, [(NOON, "a", 2, 1), (NOON + 1, "b", 3, 0)]), "1")
    store.add(clients(spark, [(NOON, "a", 5, 0), (NOON + 2, "c", 1, 1)]), "2")
    want = [(NOON, "a", 7, 1), (NOON + 1, "b", 3, 0), (NOON + 2, "c", 1, 1)]
    assert content(store) == want
    store.add(clients(spark, [(NOON, "a", 5, 0), (NOON + 2, "c", 1, 1)]), "2")  # repeated
    assert content(store) == want
    assert content(store, now_minute=NOON + 2, retention=2) == want[1:]
    for bad in ("", "a/b", "x=1", REWRITTEN + "1"):
        with pytest.raises(ValueError):
            store.add({}, bad)


def test_compaction(spark, tmp_path):
    store = MinuteStore(spark, str(tmp_path))
    store.add(clients(spark, [(NOON, "a", 2, 1), (NOON + DAY, "a", 1, 0)]), "1")
    store.add(clients(spark, [(NOON, "a", 5, 0)]), "2")
    before, kept = content(store), [f for f in files(tmp_path) if "date=2024-01-02" in f]
    assert store.compact("clients") == [dt.date(2024, 1, 1)] and store.compact("clients") == []
    assert content(store) == before and len(store.parts("clients")) == 2
    assert [f for f in files(tmp_path) if "date=2024-01-02" in f] == kept  # the other day keeps its file
    store.add(clients(spark, [(NOON, "a", 5, 0)]), "2")  # a repeated load that is merged already
    assert content(store) == before
    store.vacuum("clients")
    assert content(store) == before and not [f for f in files(tmp_path) if "load=1/date=2024-01-01" in f]
    store.add(clients(spark, [(NOON, "a", 1, 0)]), "3")
    assert content(store)[0] == (NOON, "a", 8, 1)


def test_a_rewrite_lost_before_its_commit_changes_nothing(spark, tmp_path):
    store = MinuteStore(spark, str(tmp_path))
    store.add(clients(spark, [(NOON, "a", 2, 1)]), "1")
    store.add(clients(spark, [(NOON, "b", 1, 0)]), "2")
    before = content(store)
    store._write("clients", store.read("clients"), REWRITTEN + "lost")
    assert content(store) == before and store.compact("clients") == [dt.date(2024, 1, 1)] and content(store) == before


def test_retention_of_the_store(spark, tmp_path):
    store = MinuteStore(spark, str(tmp_path))
    rows = [(NOON + d * DAY + m, f"c{i:02d}", 40 - i, 0) for d in (0, 1) for m in (0, 100) for i in range(40)]
    store.add(clients(spark, rows), "1")
    now, ages = NOON + DAY + 130, (60, 2000, 3000)
    assert store.retain(now, *ages)["clients"] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    sizes = {m: n for m, n in store.read("clients").groupBy("minute").count().collect()}
    assert sizes == {NOON: 30, NOON + 100: 30, NOON + DAY: 30, NOON + DAY + 100: 40}
    state, held = content(store), files(tmp_path)
    assert store.retain(now, *ages)["clients"] == [] and content(store) == state and files(tmp_path) == held
    # Late rows fill an old minute again; only their day is rewritten.
    store.add(clients(spark, [(NOON, f"late{i:02d}", 100, 0) for i in range(5)]), "2")
    other = [f for f in files(tmp_path) if "date=2024-01-02" in f]
    assert store.retain(now, *ages)["clients"] == [dt.date(2024, 1, 1)]
    first = [r for r in content(store) if r[0] == NOON]
    assert len(first) == 30 and sum(r[1].startswith("late") for r in first) == 5
    assert [f for f in files(tmp_path) if "date=2024-01-02" in f] == other
    # As time goes on, minutes cross ages: the newest one is thinned, then all go.
    assert store.retain(now + 60, *ages)["clients"] == [dt.date(2024, 1, 2)]
    assert store.read("clients").where(F.col("minute") == NOON + DAY + 100).count() == 30
    store.retain(now + 10_000, *ages)
    assert content(store) == []


def test_totals_never_fall(spark, sf_dir, tmp_path):
    tables = rollup.minute_rollup(fixtures.access(spark, sf_dir))
    store = MinuteStore(spark, str(tmp_path))
    store.add(tables, "1")
    store.retain(fixtures.T0 // 60000 + 1439)
    sums = lambda t: t.agg(F.sum("n"), F.count(F.lit(1))).first()
    for name in ("totals", "backends"):
        assert sums(store.read(name)) == sums(tables[name])
    before = store.read("clients").count()
    assert store.fit(10**12) == {n: [] for n in rollup.LISTS} and store.read("clients").count() == before
    assert store.fit(1)["clients"] and store.read("clients").count() == 0
    assert sums(store.read("totals")) == sums(tables["totals"])


def access_rows(spark, minutes):
    """Records that start at these minutes of the day."""
    columns = "at_ms long, client string, frontend string, backend string, server string, ta int, status int, term string, method string, path string, raw_path string, host string, tls boolean, kind string"
    return spark.createDataFrame([(None if m is None else fixtures.T0 + m * 60_000, f"c{i}", "f", "b", "s", 1, 200, "----", "GET", "/", "/", "", False, "served") for i, m in enumerate(minutes)], columns)


def test_lake_reads_the_hours_asked_for(spark, tmp_path):
    write_access_lake(access_rows(spark, [*range(0, 2880, 10), None]), str(tmp_path), "1")
    late = access_rows(spark, [125, 1500])  # written a day later, placed by their start
    for _ in range(2):
        write_access_lake(late, str(tmp_path), "2")
    read = lambda a, b: read_access_lake(spark, str(tmp_path), fixtures.T0 + a * 60_000, fixtures.T0 + b * 60_000)
    minutes = lambda df: sorted((r.at_ms - fixtures.T0) // 60_000 for r in df.collect())
    assert minutes(read(0, 9999)) == sorted([*range(0, 2880, 10), 125, 1500])
    assert minutes(read(121, 179)) == [125, 130, 140, 150, 160, 170] and minutes(read(1430, 1445)) == [1430, 1440]
    assert minutes(read(5, 9)) == [] and minutes(read(3000, 4000)) == []
    some = read(121, 179)
    assert some.count() == 6 and len(some.collect()) == 6
    plan = some._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    assert "date" in plan.toString().split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(at_ms" in plan.toString()
    folders = [f for f in files(tmp_path) if "date=2024-01-01/hour=2/" in f]
    assert scan.metrics().get("numFiles").get().value() == len(folders) < len(files(tmp_path)) / 20


def test_thinning_equals_the_walk(spark):
    rng = random.Random(4)
    rows = [(h, rng.randrange(span)) for h, n, span in (("a", 300, 20_000), ("b", 200, 2_000_000), (None, 200, 5_000), ("c", 1, 10)) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("a", None)], "host string, at_ms long")
    for gap in (7, 1000):
        want = []
        for host in ("a", "b", None, "c"):
            last = None
            for t in sorted({t for h, t in rows if h == host}):
                if last is None or t - last >= gap:
                    want.append((host, last := t))
        assert sorted(map(tuple, thinned_times(df, ["host"], gap).collect()), key=str) == sorted(want, key=str)
    assert thinned_times(df, ["host"], 0).count() == len(set(rows)) and thinned_times(df.limit(0), ["host"], 5).count() == 0


def test_thinning_of_one_long_key(spark):
    df = spark.range(100_000).select(F.lit("x").alias("host"), (F.col("id") * 10).alias("at_ms"))
    got = thinned_times(df, ["host"], 95)
    assert got.count() == 10_000 and got.where("at_ms % 100 <> 0").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan

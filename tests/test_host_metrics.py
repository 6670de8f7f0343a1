"""Host metrics over long histories: more samples of a host than an INT of milliseconds or a day's minutes hold."""

import os

import duckdb
import pytest

from floodgauge import catalog
from floodgauge.operators import hostmetrics
from floodgauge.plans.log_queries import rounded


def tables(spark, folder, samples: int) -> str:
    """A table of events of one host, a sample each."""
    spark.range(samples).selectExpr("id AS event_id", "id * 0 AS user_id").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def differences(spark, name: str, sf_dir: str, out) -> tuple[int, int, int]:
    """Rows of the query, its rows that the SQL lacks, and the SQL's rows that it lacks."""
    catalog.QUERIES[name](spark, sf_dir).write.parquet(os.fspath(out))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet/*.parquet'")
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{out}/*.parquet'")
    con.execute(f"CREATE TABLE want AS SELECT {', '.join(r[0] for r in con.execute('DESCRIBE got').fetchall())} FROM ({catalog.SQL[name]})")
    less = "SELECT count(*) FROM (SELECT * FROM {} EXCEPT ALL SELECT * FROM {})"
    return tuple(con.execute(q).fetchall()[0][0] for q in ("SELECT count(*) FROM got", less.format("got", "want"), less.format("want", "got")))


@pytest.fixture(scope="module")
def long_host(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("long"), 430_000)


@pytest.mark.parametrize("name", ["H1_cpu_percent", "H2_mem_percent", "H3_disk_rates", "H7_metric_levels"])
def test_more_samples_than_an_int_of_milliseconds(spark, long_host, tmp_path, name):
    assert differences(spark, name, long_host, tmp_path / "out") == (430_000, 0, 0)


def test_more_minutes_than_an_int_of_milliseconds(spark, long_host, tmp_path):
    assert differences(spark, "H4_metric_minutes", long_host, tmp_path / "out") == (430_000 * 5 // 60, 0, 0)


def test_more_history_than_an_int_of_milliseconds(spark, long_host, tmp_path):
    assert differences(spark, "H5_metric_history", long_host, tmp_path / "out") == (39 + 430_000 - 479, 0, 0)


@pytest.fixture(scope="module")
def two_days(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("days"), 2 * 17_280)


def test_minutes_of_more_than_a_day(spark, two_days, tmp_path):
    assert differences(spark, "H4_metric_minutes", two_days, tmp_path / "out") == (2 * 1440, 0, 0)


def test_minute_means_add_in_the_order_of_time(spark):
    """Doubles whose sum depends on the order, and of which another order than the time's comes first."""
    cpu = [1e16, 1.0, -1e16, 1.0]
    rows = [("h", t * 1000, *[v] * len(hostmetrics.VALUES)) for t, v in reversed(list(enumerate([*cpu, *[0.0] * 57])))]
    points = spark.createDataFrame(rows, ["host", "at_ms", *hostmetrics.VALUES]).repartition(4)
    got = {r.at_ms: r.cpu for r in hostmetrics.metric_minutes(points).collect()}
    assert got == {0: 1 / 60}


def test_rounds_as_the_sql(spark):
    """Next to a half: the digits of the second lie below it, its multiple does not."""
    values = [26.8640154685, 22.212098717499998, -22.212098717499998, 0.5e-9, None]
    got = rounded(spark.createDataFrame([(v,) for v in values], "v double"), ["v"], 9).collect()
    assert [r.v for r in got] == [duckdb.execute("SELECT round(?::DOUBLE, 9)", [v]).fetchall()[0][0] for v in values]


def test_history_of_more_than_a_day(spark, two_days, tmp_path):
    assert differences(spark, "H5_metric_history", two_days, tmp_path / "out") == (39 + 2 * 17_280 - 479, 0, 0)


@pytest.mark.parametrize(("minutes", "fine_since"), [(60, 0), (60, 17 * 60_000), (60, 17 * 60_000 + 59_999), (60, 10**9), (30, 20 * 60_000 + 30_000), (61, 0), (1500, 0)])
def test_history_shows_what_all_minutes_and_points_show(spark, minutes, fine_since):
    """Against the means of all points, cut afterwards; host a has points through, b until minute 12 only."""
    now = 75 * 60_000 + 7_000
    at = [("a", t * 20_000) for t in range(3 * 80)] + [("b", t * 20_000) for t in range(3 * 13)]
    points = spark.createDataFrame([(h, t, *[float(t % 7)] * len(hostmetrics.VALUES)) for h, t in at], ["host", "at_ms", *hostmetrics.VALUES])
    means = {(r.host, r.at_ms): r.cpu for r in hostmetrics.metric_minutes(points, None).collect()}
    fine = {(h, t): float(t % 7) for h, t in at if t >= fine_since}
    first = {h: min((t for g, t in fine if g == h), default=None) for h in "ab"}
    shown = means if minutes > 60 else {k: v for k, v in means.items() if first[k[0]] is None or k[1] < first[k[0]] - 60_000} | fine
    got = [((r.host, r.at_ms), r.cpu) for r in hostmetrics.metric_history(points, minutes, now, fine_since).collect()]
    assert sorted(got) == sorted((k, v) for k, v in shown.items() if k[1] >= now - minutes * 60_000)

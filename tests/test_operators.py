"""Semantics that the table queries do not reach: greedy choices, resets, ranges, retention, sources."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from floodgauge.operators import cidr, counters, findings, hostmetrics, incident, rollup, search, verdict
from floodgauge.plans import fixtures
from floodgauge.sources import logs


def test_ranges_and_queries():
    now = 10**12
    assert search.incident_range(now - 5000, now + 9, now) == (now - 5000, now)
    for bad in ((now, now), (now - 8 * 86_400_000, now), (now + 1, now + 2)):
        with pytest.raises(ValueError):
            search.incident_range(*bad, now)
    assert search.build_query(now, status="5xx", hours=2).since_ms == now - 7_200_000
    assert search.build_query(now, from_ms=now - 1, to_ms=now).until_ms == now
    for bad in ({}, {"method": "FETCH"}, {"status": "6xx"}, {"status": "20"}, {"path": "x" * 201}, {"ip": "1", "hours": -1}):
        with pytest.raises(ValueError):
            search.build_query(now, **bad)
    assert [incident.incident_step(0, m * 60_000) for m in (360, 361, 7 * 1440)] == [1, 2, 30]
    assert incident.slice_count(0, 61_000, 1) == 2


def test_cidrs(spark):
    lines = spark.createDataFrame([("# note",), ("",), ("10.0.0.0/8",), ("2001:db8::/33",), ("192.0.2.7",), ("300.1.1.1/8",), ("10.0.0.0/40",)], "value string")
    nets = cidr.load_cidrs(lines, builtin=[])
    assert nets.count() == 3
    want = {"10.255.0.1": True, "11.0.0.1": False, "2001:db8:7fff::1": True, "2001:db8:8000::1": False, "192.0.2.7": True, "192.0.2.8": False, "::1": False, "x": False, "1.2.3": False, "10.01.0.1": False}
    got = cidr.ip_in_cidrs(spark.createDataFrame([(k,) for k in want], "client string"), nets)
    assert {r.client: r.in_cdn for r in got.collect()} == want
    assert cidr.ip_in_cidrs(spark.createDataFrame([("1.1.1.1",)], "client string"), nets.limit(0)).first().in_cdn is False


def test_restarts_keep_the_last_kept(spark):
    times = [0, 20_000, 59_000, 70_000, 129_000, 130_000]
    ev = spark.createDataFrame([(t, "start", "", "", "", -1) for t in times] + [(5, "down", "b", "s", "", 1)], "at_ms long, type string, backend string, server string, reason string, remaining int")
    got = incident.coalesce_restarts(ev)
    assert sorted(r.at_ms for r in got.where("type = 'start'").collect()) == [0, 70_000, 130_000] and got.count() == 4


def test_p95_on_edges(spark):
    df = spark.createDataFrame([("a", 5)] * 20 + [("b", -1), ("c", 0), ("d", 150_000)], "k string, ta int")
    got = {r.k: (r.avg_ms, r.p95_ms, r.max_ms) for r in incident.duration_stats(df, ["k"]).collect()}
    assert got == {"a": (5, 5, 5), "c": (0, 0, 0), "d": (150_000, 148_500, 150_000)}


def _snap(spark, rows):
    names = "host string, at_ms long, uptime_sec long, pxname string, svname string, type int, req_tot long, stot long, h1 long, h2 long, h3 long, h4 long, h5 long, ho long, econ long, eresp long, bin_bytes long, bout long"
    return spark.createDataFrame([("h", t, up, "b", s, 1, n, n, 0, n, 0, 0, 0, 0, 0, 0, n, n) for t, up, s, n in rows], names)


def test_resets_and_gaps(spark):
    rows = _snap(spark, [(0, 100, "x", 10), (10_000, 110, "x", 20), (20_000, 5, "x", 3), (30_000, 15, "x", 5), (0, 100, "y", 1), (20_000, 5, "y", 9), (30_000, 15, "y", 9)])
    rates = {(r.at_ms, r.svname): r.rps for r in counters.counter_rates(rows).collect()}
    assert rates == {(10_000, "x"): 1.0, (30_000, "x"): 0.2, (30_000, "y"): 0.0}  # y misses one snapshot; the restart has no rate
    window = {r.svname: (r.n, r.covered_seconds) for r in counters.window_delta(rows, 60).collect()}
    assert window == {"x": (2.0, 10.0), "y": (0.0, 10.0)}
    assert [r.at_ms for r in counters.sample_every(rows, 15_000).orderBy("at_ms").collect()] == [0, 20_000]


def test_downsample_short_group(spark):
    pts = spark.createDataFrame([("h", i, float(i)) for i in range(7)], "host string, at_ms long, v double")
    assert [(r.at_ms, r.v) for r in counters.downsample(pts, ["v"], 3).orderBy("at_ms").collect()] == [(2, 1.0), (5, 4.0), (6, 6.0)]
    assert counters.downsample(pts, ["v"], 10).count() == 7


def test_devices(spark):
    names = {"sda": True, "sda1": False, "nvme0n1": True, "nvme0n1p1": False, "vdb": True, "xvda": True, "loop0": False, "dm-0": False, "sr0": False, "zram0": False}
    df = spark.createDataFrame([(n,) for n in names], "d string")
    assert {r.d: r.p for r in df.select("d", hostmetrics.physical_device(F.col("d")).alias("p")).collect()} == names


def test_quiet_incident_is_ok(spark):
    ser = spark.createDataFrame([(i, i * 60_000, 50, 50, 0, 0, 0, 0, 0, 10, 20, 30) for i in range(30)], "bin long, t long, n long, c2 long, c3 long, c4 long, c5 long, c0 long, noserver long, avg_ms long, p95_ms long, max_ms long")
    assert verdict.problem_periods(ser, 1_800_000, 1).count() == verdict.traffic_drop(ser, 1_800_000, 1).count() == verdict.slow_periods(ser).count() == 0


def test_counts_survive_merging_and_order(spark, sf_dir):
    a = fixtures.access(spark, sf_dir)
    whole = {r.asDict()["minute"]: r.n for r in rollup.minute_rollup(a)["totals"].groupBy("minute").agg(F.sum("n").alias("n")).collect()}
    halves = [rollup.minute_rollup(a.where(f"ta % 2 = {k}"))["totals"] for k in (0, 1)] + [rollup.minute_rollup(a.where("ta % 2 NOT IN (0, 1)"))["totals"]]
    parts = halves[0].unionByName(halves[1]).unionByName(halves[2])
    assert {r.minute: r.n for r in rollup.merge(parts, "totals").groupBy("minute").agg(F.sum("n").alias("n")).collect()} == whole
    assert sum(whole.values()) == a.count()


def test_budget_drops_lists_not_counts(spark, sf_dir):
    tables = rollup.minute_rollup(fixtures.access(spark, sf_dir))
    small = rollup.budget_retention(tables, 1)
    assert small["paths"].count() == 0 and small["totals"].count() == tables["totals"].count()
    assert rollup.coverage(rollup.budget_levels(rollup.minute_weights(tables), 10**12), 0).first().detail_minutes < 0


def test_rotated_logs(spark, tmp_path):
    import gzip
    import os

    for name, n in (("lb.log", 2), ("lb.log.1", 3), ("other.log", 5)):
        (tmp_path / name).write_text("x\n" * n)
    with gzip.open(tmp_path / "lb.log-2.gz", "wt") as f:
        f.write("y\n" * 4)
    old = datetime.now() - timedelta(days=3)
    os.utime(tmp_path / "lb.log.1", (old.timestamp(),) * 2)
    path = f"file://{tmp_path}/lb.log"
    assert logs.read_log_lines(spark, path).count() == 9
    since = datetime.now() - timedelta(days=1)  # at least half a day from either file in any zone
    assert logs.read_log_lines(spark, path, since).count() == 6
    assert [r.file for r in logs.skipped_files(spark, path, since).collect()] == ["lb.log.1"]


def test_counter_dump(spark):
    text = spark.createDataFrame([(1, "# pxname,svname,scur,status,type,"), (1, "web,s1,3,UP,2,"), (1, "web,BACKEND,4"), (1, ",s2,1,UP,2,"), (2, "# pxname,svname,"), (2, "a,b,")], "dump_id int, value string")
    got = {(r.dump_id, r.svname): r.fields for r in logs.read_counter_dump(text).collect()}
    assert got[1, "s1"]["status"] == "UP" and got[1, "BACKEND"]["type"] == "" and set(got) == {(1, "s1"), (1, "BACKEND"), (2, "b")}
    with pytest.raises(Exception, match="no header"):
        logs.read_counter_dump(spark.createDataFrame([(3, "a,b,c")], "dump_id int, value string")).collect()
    info = logs.read_info_dump(spark.createDataFrame([(1, "Uptime_sec: 5"), (1, "Name: a: b")], "dump_id int, value string")).first().info
    assert info == {"Uptime_sec": "5", "Name": "a: b"}
    twice = spark.createDataFrame([(1, 0, "n: 9"), (1, 2, "n: 5"), (1, 1, "n: 7")], "dump_id int, line int, value string")
    assert logs.read_info_dump(twice).first().info == {"n": "5"}


def test_summaries_on_disk(spark, sf_dir, tmp_path):
    tables = {"backends": rollup.minute_rollup(fixtures.access(spark, sf_dir))["backends"]}
    for _ in range(2):  # a repeated load replaces itself
        logs.write_minute_summaries(tables, str(tmp_path / "sums"), "1")
    now = fixtures.T0 // 60000 + 1439
    assert logs.read_minute_summaries(spark, str(tmp_path / "sums"), "backends", now).count() == tables["backends"].count()
    assert logs.read_minute_summaries(spark, str(tmp_path / "sums"), "backends", now, 100).agg(F.min("minute")).first()[0] >= now - 99


def test_hosts_stay_apart(spark):
    """Two hosts with the same proxies and servers give what each gives alone."""
    state_names = "host string, pxname string, svname string, type int, status string, check_status string, check_code string, chkdown int, qcur int, rtime int, scur int, slim int"
    window_names = "host string, pxname string, svname string, type int, n double, h1 double, h2 double, h3 double, h4 double, h5 double, ho double, econ double, eresp double, covered_seconds double"
    rate_names = "host string, at_ms long, pxname string, svname string, type int, rps double"

    def one(host, down, errors):
        state = [(host, "be", "BACKEND", 1, "UP", "", "", 0, 1, 900, 5, 10), (host, "be", "s1", 2, "DOWN" if down else "UP", "L4CON", "", 6, 0, 1, 1, 10), (host, "be", "s2", 2, "DOWN" if down else "no check", "", "", 0, 0, 1, 1, 10), (host, "fe", "FRONTEND", 0, "OPEN", "", "", 0, 0, 0, 9, 10)]
        window = [(host, p, v, t, 100.0, 0.0, 90.0, 0.0, 1.0, errors, 0.0, errors, 0.0, 60.0) for _, p, v, t, *_ in state]
        rates = [(host, 5 if down else 7, p, v, t, 3.0 + errors) for _, p, v, t, *_ in state]
        return state, window, rates

    parts = {"a": one("a", True, 40.0), "b": one("b", False, 2.0)}

    def frames(hosts):
        rows = [[r for h in hosts for r in parts[h][i]] for i in range(3)]
        return [spark.createDataFrame(r, n) for r, n in zip(rows, (state_names, window_names, rate_names))]

    def results(hosts):
        state, window, rates = frames(hosts)
        return {
            "tables": counters.entity_tables(state, rates, window), "ranking": counters.backend_ranking(state, window), "attribution": counters.error_attribution(window), "topology": counters.topology(rates),
            "unreachable": findings.unreachable_backends(state), "connect": findings.connect_errors(state, window, window), "backend": findings.backend_errors(window), "states": findings.server_states(state),
        }

    every = results("ab")
    for host in "ab":
        for name, alone in results(host).items():
            assert sorted(map(str, every[name].where(F.col("host") == host).collect())) == sorted(map(str, alone.collect())), name
    assert every["unreachable"].count() == 1 and every["tables"].count() == 8


def test_restarts_of_two_hosts_and_without_time(spark):
    rows = [("a", t, "start") for t in (0, 20_000, 59_999, 60_000, 500_000)] + [("b", 30_000, "start"), ("a", None, "start"), ("a", 10, "stop"), ("a", 5, None)]
    got = incident.coalesce_restarts(spark.createDataFrame(rows, "host string, at_ms long, type string"))
    assert sorted(((r.host, r.at_ms, r.type) for r in got.collect()), key=repr) == sorted([("a", 0, "start"), ("a", 60_000, "start"), ("a", 500_000, "start"), ("b", 30_000, "start"), ("a", None, "start"), ("a", 10, "stop"), ("a", 5, None)], key=repr)


def test_outages_end_strictly_later(spark):
    rows = [(5, "down", "x"), (5, "up", ""), (9, "up", ""), (20, "down", "y"), (3, "up", "")]
    df = spark.createDataFrame([(t, k, "b", "s", r) for t, k, r in rows] + [(7, "down", "b", "t", "z")], "at_ms long, type string, backend string, server string, reason string")
    got = {r.server: (r.down_at, r.up_at, r.before_range) for r in verdict.server_outages(df, 6).collect()}
    assert got == {"s": (5, 9, True), "t": (7, None, False)}


def test_a_problem_throughout(spark):
    totals = spark.createDataFrame([(1000, 50)], "n long, c5 long")
    none = spark.createDataFrame([], "main boolean")
    assert [tuple(r) for r in verdict.continuing_problem(totals, none).collect()] == [(1000, 50, 0.05)]
    assert verdict.continuing_problem(totals, spark.createDataFrame([(True,)], "main boolean")).count() == 0
    assert verdict.continuing_problem(spark.createDataFrame([(99, 50)], "n long, c5 long"), none).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from floodgauge.sources.scratch import scratch_dir

    context = SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_dir(SimpleNamespace(sparkContext=context), "x")

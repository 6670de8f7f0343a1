"""The review's sections from the one cube against those over the records."""

from pyspark.sql import functions as F

from floodgauge.operators import incident as inc
from floodgauge.operators import review as rev
from floodgauge.operators.parse import parse_access, unplaced
from floodgauge.plans import fixtures
from floodgauge.plans.log_queries import FROM, TO


def rows(df):
    plain = lambda v: tuple(sorted(v.items())) if isinstance(v, dict) else v
    return [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]


def test_sections_of_the_cube(spark, sf_dir):
    records = inc.time_slice(fixtures.access(spark, sf_dir), FROM, TO)
    cube = rev.review_cube(records, FROM, TO)
    assert rows(rev.series(cube, FROM, TO).orderBy("bin")) == rows(inc.incident_series(records, FROM, TO).orderBy("bin"))
    for name in ("totals", "codes", "backends", "servers", "frontends"):
        assert rows(getattr(rev, name)(cube)) == rows(getattr(inc, f"incident_{name}")(records)), name
    assert rows(rev.termination_codes(cube)) == rows(inc.termination_codes(records))
    assert sorted(rows(rev.backend_terms(cube))) == sorted(rows(inc.backend_terms(records)))
    assert cube.where("section IS NULL").count() == 0


def test_cube_of_nothing(spark, sf_dir):
    none = fixtures.access(spark, sf_dir).limit(0)
    cube = rev.review_cube(none, FROM, TO)
    assert rows(rev.totals(cube)) == rows(inc.incident_totals(none)) and rev.backends(cube).count() == 0
    assert rows(rev.series(cube, FROM, TO).orderBy("bin")) == rows(inc.incident_series(none, FROM, TO).orderBy("bin"))


def test_records_are_read_once(spark, sf_dir, tmp_path):
    inc.time_slice(fixtures.access(spark, sf_dir), FROM, TO).write.parquet(str(tmp_path / "slice"))
    records = spark.read.parquet(str(tmp_path / "slice"))
    cube = rev.review_cube(records, FROM, TO)
    sections = [rev.series(cube, FROM, TO), rev.totals(cube), rev.backends(cube), rev.frontends(cube), rev.termination_codes(cube)]
    plans = [s._jdf.queryExecution().optimizedPlan().toString() for s in sections]
    assert all(str(tmp_path) not in p for p in [s._jdf.queryExecution().executedPlan().toString() for s in sections])
    assert all("at_ms" not in p for p in plans) and cube.agg(F.count(F.lit(1))).first()[0] < 3000


def test_many_ranges_at_once_are_each_alone(spark, sf_dir):
    access = fixtures.access(spark, sf_dir)
    ranges = [(1, FROM, TO), (2, FROM + 3_600_000, TO + 7_200_000), (3, fixtures.T0 - 600_000, fixtures.T0 - 1)]
    frame = spark.createDataFrame(ranges, "incident int, from_ms long, to_ms long")
    cube = rev.incidents_cube(access, frame)
    series, backends = rev.incidents_series(cube, frame), rev.incidents_backends(cube)
    for i, a, b in ranges:
        own = rev.review_cube(inc.time_slice(access, a, b), a, b)
        assert rows(series.where(F.col("incident") == i).drop("incident").orderBy("bin")) == rows(rev.series(own, a, b).drop("codes").orderBy("bin"))
        assert rows(backends.where(F.col("incident") == i).drop("incident").orderBy("backend")) == rows(rev.backends(own).orderBy("backend"))


def test_what_could_not_be_placed(spark):
    start, now = fixtures.T0, F.timestamp_millis(F.lit(fixtures.T0 + fixtures.DAY_MS))
    odd, up = " lb1 haproxy[77]: 10.0.0.1:4000 [01/Jan/2024:00:00:00.000] ?", " lb1 haproxy[77]: Server be/s is UP. 1 active and 0 backup servers online."
    lines = spark.createDataFrame([("Jan  1 00:00:10" + odd,), ("Jan  1 00:10:00" + odd,), ("?" + odd,), ("?" + up,), ("Jan  1 00:00:10 lb1 haproxy[77]: Started.",), (None,)], "value string")
    got = unplaced(parse_access(lines), start, start + 60_000, now).first()
    assert tuple(got) == (2, 1, 1, 1, True)
    more = lines.union(spark.createDataFrame([("Jan  1 00:10:00" + up,)], "value string"))
    assert tuple(unplaced(parse_access(more), start, start + 60_000, now).first()) == (2, 1, 2, 1, False)

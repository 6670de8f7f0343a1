"""Queries of the incident review over derived request records and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floodgauge.operators import incident as inc
from floodgauge.operators import review as rev
from floodgauge.operators import verdict as ver
from floodgauge.operators.cidr import builtin_cidrs
from floodgauge.operators.parse import parse_access, render_access, render_events, unplaced
from floodgauge.functions import fields as X
from floodgauge.plans import fixtures as fx
from floodgauge.sources.scratch import materialize
from floodgauge.plans.log_queries import rounded
from floodgauge.plans.log_queries import A, BOUNDS, FROM, IN_CDN, TO

QUERIES: dict = {}
SQL: dict[str, str] = {}
STEP = inc.incident_step(FROM, TO)
BINS = inc.slice_count(FROM, TO, STEP)
_S = f"s AS (SELECT *, CASE WHEN status BETWEEN 200 AND 599 THEN status // 100 - 2 ELSE 4 END AS c, server = '<NOSRV>' AND backend = frontend AS fe, least((at_ms - {FROM}) // {STEP * 60000}, {BINS - 1}) AS bin FROM access WHERE at_ms BETWEEN {FROM} AND {TO})"
BASE = f"{A}, {_S}"
CLS = ", ".join(f"count(*) FILTER (c = {i}) AS {n}" for i, n in enumerate(inc.CLASS_COLUMNS))
KINDS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("served", "denied", "nomatch", "noserver", "redirect", "proxy"))


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.time_slice(fx.access(spark, sf_dir), FROM, TO)


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of all sections, for queries of several."""
    return rev.review_cube(sliced(spark, sf_dir), FROM, TO, STEP)


def stats_sql(name: str, source: str, keys: list[str]) -> str:
    """CTEs that give avg_ms, p95_ms and max_ms per key under ``name``."""
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"""{name}_h AS (SELECT {k}len(list_filter({BOUNDS}, lambda b: b <= ta)) AS bucket, count(*) AS n, sum(ta) AS total, max(ta) AS top FROM {source} WHERE ta >= 0 GROUP BY ALL),
      {name}_c AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS n_all, sum(total) OVER ({part}) AS t_all, max(top) OVER ({part}) AS top_all FROM {name}_h),
      {name}_f AS (SELECT *, CASE WHEN bucket > 0 THEN {BOUNDS}[bucket] ELSE 0 END AS low, least(coalesce({BOUNDS}[bucket + 1], top_all + 1), top_all + 1) AS high FROM {name}_c WHERE upto >= 0.95::DOUBLE * n_all QUALIFY row_number() OVER ({part} ORDER BY bucket) = 1),
      {name} AS (SELECT {k}CAST(t_all // n_all AS BIGINT) AS avg_ms, CAST(least(low + trunc((0.95::DOUBLE * n_all - (upto - n)) / n * (high - low)), top_all) AS BIGINT) AS p95_ms, CAST(top_all AS BIGINT) AS max_ms FROM {name}_f)"""


_D = "coalesce(avg_ms, -1) AS avg_ms, coalesce(p95_ms, -1) AS p95_ms, coalesce(max_ms, -1) AS max_ms"
TOTALS = f"{stats_sql('ts', 's', [])}, totals AS (SELECT * EXCLUDE (avg_ms, p95_ms, max_ms), coalesce(avg_ms, -1) AS avg_ms, coalesce(p95_ms, -1) AS p95_ms FROM (SELECT count(*) AS n, {CLS}, {KINDS}, 0::BIGINT AS tcp, count(*) FILTER (host <> '') AS with_host, min(at_ms) AS first_at, max(at_ms) AS last_at FROM s) LEFT JOIN ts ON true)"
BACKENDS = f"sb AS (SELECT * FROM s WHERE NOT fe), {stats_sql('bs', 'sb', ['backend'])}, backends AS (SELECT g.*, {_D} FROM (SELECT backend, count(*) AS n, {CLS}, {KINDS}, min(at_ms) FILTER (c = 3) AS first_5xx, max(at_ms) FILTER (c = 3) AS last_5xx FROM sb GROUP BY backend) g LEFT JOIN bs USING (backend))"
FRONTENDS = f"frontends AS (SELECT frontend, count(*) AS n, {CLS}, {KINDS} FROM s WHERE fe GROUP BY frontend)"
_TERMS = "e AS (SELECT term[1:2] AS code, backend, fe, count(*) AS n, count(*) FILTER (c >= 3) AS errors FROM s WHERE term[1:2] <> '--' GROUP BY ALL)"
_WHY = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in X.TERM_SPECIAL.items())
TERMS = f"""{_TERMS}, terms AS (SELECT code, CAST(sum(n) AS BIGINT) AS n, CAST(sum(errors) AS BIGINT) AS errors, coalesce(arg_min(backend, (-n, backend)) FILTER (NOT fe), '') AS backend,
  CASE code {_WHY} END AS meaning, CASE WHEN code[1:1] IN ('S', 's', 'R', 'I', 'D', 'U') THEN 'server' WHEN code[1:1] IN ('C', 'c') THEN 'client' ELSE 'rule' END AS side FROM e GROUP BY code)"""
SERIES = f"{stats_sql('ss', 's', ['bin'])}, series AS (SELECT g.bin, {FROM} + g.bin * {STEP * 60000} AS t, coalesce(n, 0) AS n, {', '.join(f'coalesce({c}, 0) AS {c}' for c in inc.CLASS_COLUMNS)}, coalesce(noserver, 0) AS noserver, {_D} FROM (SELECT unnest(range({BINS})) AS bin) g LEFT JOIN (SELECT bin, count(*) AS n, {CLS}, count(*) FILTER (kind = 'noserver') AS noserver FROM s GROUP BY bin) USING (bin) LEFT JOIN ss USING (bin))"


def series(spark, sf_dir):
    return inc.incident_series(sliced(spark, sf_dir), FROM, TO, STEP)


@query(
    "I2_incident_series",
    f"WITH {BASE}, {SERIES}, codes AS (SELECT bin, string_agg(status || ':' || n, ',' ORDER BY status) AS codes FROM (SELECT bin, status, count(*) AS n FROM s GROUP BY ALL) GROUP BY bin) SELECT series.*, coalesce(codes, '') AS codes FROM series LEFT JOIN codes USING (bin)",
)
def i2(spark, sf_dir):
    from pyspark.sql import functions as F

    pairs = F.transform(F.array_sort(F.map_entries("codes")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return series(spark, sf_dir).withColumn("codes", F.array_join(pairs, ","))


@query("I3_duration_stats", f"WITH {BASE}, {stats_sql('d', 's', ['backend', 'path'])} SELECT * FROM d")
def i3(spark, sf_dir):
    return inc.duration_stats(sliced(spark, sf_dir), ["backend", "path"])


@query("I4_incident_totals", f"WITH {BASE}, {TOTALS} SELECT * FROM totals")
def i4(spark, sf_dir):
    return inc.incident_totals(sliced(spark, sf_dir))


@query("I4_incident_codes", f"WITH {BASE} SELECT status, count(*) AS n FROM s GROUP BY status")
def i4_codes(spark, sf_dir):
    return inc.incident_codes(sliced(spark, sf_dir))


_HEALTH = "CASE WHEN noserver > 0 OR c5 / n >= 0.05 THEN 'problem' WHEN c5 / n >= 0.01 OR avg_ms >= 2000 THEN 'attention' ELSE 'normal' END AS health"


@query("I5_incident_backends", f"WITH {BASE}, {BACKENDS} SELECT *, {_HEALTH} FROM backends")
def i5(spark, sf_dir):
    """Which backend had the server errors, and is it a problem (I5, I22)."""
    return ver.backend_health(inc.incident_backends(sliced(spark, sf_dir)))


@query("I22_backend_health", f"WITH {BASE}, {BACKENDS} SELECT backend, {_HEALTH} FROM backends")
def i22(spark, sf_dir):
    return ver.backend_health(inc.incident_backends(sliced(spark, sf_dir))).select("backend", "health")


@query(
    "I6_incident_servers",
    f"WITH {BASE}, sv AS (SELECT * FROM s WHERE NOT fe AND server NOT IN ('', '<NOSRV>')), {stats_sql('vs', 'sv', ['backend', 'server'])} SELECT g.*, {_D} FROM (SELECT backend, server, count(*) AS n, {CLS} FROM sv GROUP BY ALL) g LEFT JOIN vs USING (backend, server)",
)
def i6(spark, sf_dir):
    return inc.incident_servers(sliced(spark, sf_dir))


@query("I7_incident_frontends", f"WITH {BASE}, {FRONTENDS} SELECT * FROM frontends")
def i7(spark, sf_dir):
    return inc.incident_frontends(sliced(spark, sf_dir))


@query("I8_termination_codes", f"WITH {BASE}, {TERMS} SELECT * FROM terms")
def i8(spark, sf_dir):
    return inc.termination_codes(sliced(spark, sf_dir))


@query("I9_backend_terms", f"WITH {BASE}, {_TERMS} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY n DESC, code) AS k FROM (SELECT backend, code, CAST(sum(n) AS BIGINT) AS n FROM e WHERE NOT fe GROUP BY backend, code)) WHERE k <= 5")
def i9(spark, sf_dir):
    return inc.backend_terms(sliced(spark, sf_dir))


_PATHS = f"p AS (SELECT method, path, backend, fe AS frontend_answered, count(*) AS n, {CLS} FROM s GROUP BY ALL)"
_TIE = "n DESC, method || path || backend, frontend_answered"


@query("I10_error_paths", f"WITH {BASE}, {_PATHS} SELECT * FROM p WHERE c4 + c5 + c0 > 0 ORDER BY c5 DESC, c4 DESC, {_TIE} LIMIT 15")
def i10(spark, sf_dir):
    return inc.error_paths(sliced(spark, sf_dir))


@query("I11_incident_top_paths", f"WITH {BASE}, {_PATHS} SELECT * FROM p ORDER BY {_TIE} LIMIT 15")
def i11(spark, sf_dir):
    return inc.incident_top_paths(sliced(spark, sf_dir))


@query("I12_incident_ips", f"WITH {BASE} SELECT *, {IN_CDN} AS in_cdn FROM (SELECT client, count(*) AS n, {CLS} FROM s GROUP BY client ORDER BY n DESC, client LIMIT 15)")
def i12(spark, sf_dir):
    return inc.incident_ips(sliced(spark, sf_dir), builtin_cidrs(spark))


@query("I12_incident_hosts", f"WITH {BASE} SELECT host, count(*) AS n, {CLS} FROM s WHERE host <> '' GROUP BY host ORDER BY c5 DESC, n DESC, host LIMIT 15")
def i12_hosts(spark, sf_dir):
    return inc.incident_hosts(sliced(spark, sf_dir))


_WALK = """walk AS (SELECT at_ms, at_ms AS last FROM (SELECT min(at_ms) AS at_ms FROM starts) WHERE at_ms IS NOT NULL
  UNION ALL SELECT x.at_ms, x.at_ms FROM walk w, LATERAL (SELECT min(at_ms) AS at_ms FROM starts WHERE at_ms - w.last >= 60000) x WHERE x.at_ms IS NOT NULL)"""
_WALKED = f"SELECT * FROM ev WHERE type <> 'start' UNION ALL SELECT at_ms, 'start', '', '', '', -1 FROM walk"


def _events_sql(where: str) -> str:
    return f"WITH RECURSIVE ev AS (SELECT * FROM ({fx.DUCK_EVENTS}) WHERE {where}), starts AS (SELECT DISTINCT at_ms FROM ev WHERE type = 'start'), {_WALK}, kept AS ({_WALKED})"


@query("I13_incident_events", f"{_events_sql(f'at_ms BETWEEN {FROM - inc.SLACK_MS} AND {TO}')} SELECT *, (SELECT count(*) FROM kept) > 500 AS cut FROM kept ORDER BY at_ms, backend, reason, remaining, server, type LIMIT 500")
def i13(spark, sf_dir):
    return inc.incident_events(fx.events(spark, sf_dir), FROM, TO)


@query("I14_coalesce_restarts", f"{_events_sql('true')} SELECT * FROM kept")
def i14(spark, sf_dir):
    return inc.coalesce_restarts(fx.events(spark, sf_dir))


PERIODS = f"""calm AS (SELECT coalesce(list_sort(list(c5 / n) FILTER (n >= 5))[count(*) FILTER (n >= 5) // 10 + 1], 0) AS calm, max(bin) AS last_bin, sum(n) AS all_n, sum(c5) AS all_5 FROM series),
  bad AS (SELECT bin, bin - coalesce(lag(bin) OVER (ORDER BY bin), -9) > 2 AS begins FROM series, calm WHERE c5 >= 3 AND c5 / n >= greatest(0.05::DOUBLE, calm * 2 + 0.03::DOUBLE)),
  runs AS (SELECT run, min(bin) AS first, max(bin) AS last FROM (SELECT bin, count(*) FILTER (begins) OVER (ORDER BY bin) AS run FROM bad) GROUP BY run),
  per AS (SELECT first, last, sum(c5) AS errors, sum(n) AS n, arg_max(bin, (CASE WHEN n > 0 THEN c5 / n ELSE -1 END, -bin)) AS peak_bin, max(CASE WHEN n > 0 THEN c5 / n ELSE -1 END) AS peak_ratio, min(t) AS from_t, max(t) AS last_t FROM runs JOIN series ON bin BETWEEN first AND last GROUP BY ALL),
  periods AS (SELECT 0 AS incident, first, last, CAST(errors AS BIGINT) AS errors, row_number() OVER (ORDER BY errors DESC, first) = 1 AS main, peak_bin, peak_ratio, CASE WHEN all_n > n THEN (all_5 - errors) / (all_n - n) END AS outside_ratio,
    CAST(floor((least(last_t + {STEP * 60000}, {TO}) - from_t) / 60000 + 0.5) AS BIGINT) AS minutes, first = 0 AS at_start, last >= last_bin AS at_end, count(*) OVER () AS periods FROM per, calm)"""


def periods(spark, sf_dir):
    return ver.problem_periods(series(spark, sf_dir), TO, STEP)


@query("I15_problem_periods", f"WITH {BASE}, {SERIES}, {PERIODS} SELECT * FROM periods")
def i15(spark, sf_dir):
    return periods(spark, sf_dir)


_CONTINUING = "SELECT n, c5 AS errors, c5 / n AS share FROM totals WHERE n >= 100 AND c5 / n >= 0.03 AND NOT EXISTS (SELECT 1 FROM periods)"


@query("I16_continuing_problem", f"WITH {BASE}, {SERIES}, {PERIODS}, {TOTALS} {_CONTINUING}")
def i16(spark, sf_dir):
    return ver.continuing_problem(inc.incident_totals(sliced(spark, sf_dir)), periods(spark, sf_dir))


#: Ranges that overlap each other, one that is part of another, and one without records.
RANGES = [(1, FROM, TO), (2, FROM + 3_600_000, TO + 7_200_000), (3, fx.T0, fx.T0 + fx.DAY_MS - 1), (4, FROM + 600_000, FROM + 1_200_000), (5, fx.T0 - 600_000, fx.T0 - 1)]
_MANY = (
    f"{A}, ranges AS (SELECT * FROM (VALUES {', '.join(map(str, RANGES))}) v(incident, from_ms, to_ms)), plan AS (SELECT *, greatest(1, CAST(ceil((to_ms - from_ms) / (step * 60000)) AS BIGINT)) AS bins FROM (SELECT *, CASE "
    + " ".join(f"WHEN to_ms - from_ms <= {m * 360 * 60_000} THEN {m}" for m in inc.STEPS)
    + " END AS step FROM ranges) r), s AS (SELECT incident, access.*, CASE WHEN status BETWEEN 200 AND 599 THEN status // 100 - 2 ELSE 4 END AS c, server = '<NOSRV>' AND backend = frontend AS fe, least((at_ms - from_ms) // (step * 60000), bins - 1) AS bin FROM access JOIN plan ON at_ms BETWEEN from_ms AND to_ms)"
)


def many(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ranges = spark.createDataFrame(RANGES, "incident int, from_ms long, to_ms long")
    return rev.incidents_cube(fx.access(spark, sf_dir), ranges), ranges


@query(
    "I5_backends_of_many",
    f"WITH {_MANY}, sb AS (SELECT * FROM s WHERE NOT fe), {stats_sql('bs', 'sb', ['incident', 'backend'])} SELECT g.*, {_D} FROM (SELECT incident, backend, count(*) AS n, {CLS}, {KINDS}, min(at_ms) FILTER (c = 3) AS first_5xx, max(at_ms) FILTER (c = 3) AS last_5xx FROM sb GROUP BY ALL) g LEFT JOIN bs USING (incident, backend)",
)
def i5_many(spark, sf_dir):
    """Backends of several overlapping incidents from one pass."""
    return rev.incidents_backends(many(spark, sf_dir)[0])


@query(
    "I2_series_of_many",
    f"WITH {_MANY}, {stats_sql('ss', 's', ['incident', 'bin'])}, grid AS (SELECT incident, from_ms, step, unnest(range(bins)) AS bin FROM plan) SELECT grid.incident, grid.bin, from_ms + grid.bin * step * 60000 AS t, coalesce(n, 0) AS n, {', '.join(f'coalesce({c}, 0) AS {c}' for c in inc.CLASS_COLUMNS)}, coalesce(noserver, 0) AS noserver, {_D} FROM grid LEFT JOIN (SELECT incident, bin, count(*) AS n, {CLS}, count(*) FILTER (kind = 'noserver') AS noserver FROM s GROUP BY ALL) g USING (incident, bin) LEFT JOIN ss USING (incident, bin)",
)
def i2_many(spark, sf_dir):
    """The series of several overlapping incidents, each in slices of its own step."""
    cube, ranges = many(spark, sf_dir)
    return rev.incidents_series(cube, ranges)


#: A range before the incident, in slices of an hour, of which most good answers are left out: a steady
#: share of errors without a period of them.
_STEADY_TO, _STEADY_STEP = fx.T0 + 780 * 60_000, 60
_STEADY_BINS = inc.slice_count(fx.T0, _STEADY_TO, _STEADY_STEP)
_STEADY = "status >= 500 OR ta % 40 = 0"


def _steady_sql(sql: str) -> str:
    for old, new in ((f"// {STEP * 60000}", f"// {_STEADY_STEP * 60000}"), (f"* {STEP * 60000}", f"* {_STEADY_STEP * 60000}"), (f"+ {STEP * 60000}", f"+ {_STEADY_STEP * 60000}"), (f", {BINS - 1})", f", {_STEADY_BINS - 1})"), (f"range({BINS})", f"range({_STEADY_BINS})"), (str(FROM), str(fx.T0)), (str(TO), str(_STEADY_TO)), ("FROM access WHERE", f"FROM access WHERE ({_STEADY}) AND")):
        sql = sql.replace(old, new)
    return sql


@query("I16_steady_errors", f"WITH {A}, " + _steady_sql(f"{_S}, {SERIES}, {PERIODS}, {TOTALS} {_CONTINUING}"))
def i16_steady(spark, sf_dir):
    """Errors throughout, which no period stands out from."""
    rows = inc.time_slice(fx.access(spark, sf_dir).where(_STEADY), fx.T0, _STEADY_TO)
    cube = rev.review_cube(rows, fx.T0, _STEADY_TO, _STEADY_STEP)
    return ver.continuing_problem(rev.totals(cube), ver.problem_periods(rev.series(cube, fx.T0, _STEADY_TO, _STEADY_STEP), _STEADY_TO, _STEADY_STEP))


@query(
    "I4_unplaced",
    f"""WITH {A}, ev AS ({fx.DUCK_EVENTS}), e AS (SELECT count(*) AS events, count(*) FILTER (type = 'up') AS events_without_time FROM ev)
      SELECT count(*) FILTER (ta % 40 = 7 OR at_ms // 1000 * 1000 BETWEEN {FROM} AND {TO}) AS unparsed, count(*) FILTER (ta % 40 = 7) AS unparsed_without_time, any_value(events) AS events, any_value(events_without_time) AS events_without_time,
      any_value(events > 0 AND events = events_without_time) AS events_unknown FROM access, e WHERE ta % 20 = 7""",
)
def i4_unplaced(spark, sf_dir):
    """Damaged lines, half of them without a readable stamp, among whole ones and events, of which those
    of servers that come up have none."""
    from pyspark.sql import functions as F

    access, events = fx.dealt(fx.access(spark, sf_dir)), fx.events(spark, sf_dir)
    at = F.timestamp_millis("at_ms")
    stamp = F.concat(F.date_format(at, "MMM "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "), F.date_format(at, " HH:mm:ss"))
    odd = F.concat(F.when(F.col("ta") % 40 == 7, F.lit("?")).otherwise(stamp), F.lit(" lb1 haproxy[77]: "), "client", F.lit(":40000 [01/Jan/2024:00:00:00.000] ?"))
    lines = render_access(access.where("ta % 20 <> 7")).union(access.where("ta % 20 = 7").select(odd))
    lines = lines.union(render_events(events.where("type <> 'up'"))).union(render_events(events.where("type = 'up'")).select(F.regexp_replace("value", "^.{15}", "?")))
    return unplaced(parse_access(lines), FROM, TO, F.timestamp_millis(F.lit(fx.T0 + fx.DAY_MS)))


CAUSE = """cause AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM periods) OR (totals.n >= 100 AND totals.c5 / totals.n >= 0.03) THEN 'bad' WHEN totals.c5 / totals.n >= 0.01 THEN 'warn' ELSE 'info' END AS level,
  b.backend, b.c5 / totals.c5 AS backend_share, b.c5 / b.n AS backend_ratio, t.code AS reason, t.errors / totals.c5 AS reason_share
  FROM totals LEFT JOIN (SELECT * FROM backends WHERE c5 > 0 ORDER BY c5 DESC, n DESC, backend LIMIT 1) b ON true LEFT JOIN (SELECT * FROM terms WHERE errors > 0 ORDER BY errors DESC, n DESC, code LIMIT 1) t ON true WHERE totals.c5 > 0)"""


def cause(spark, sf_dir):
    c = reviewed(spark, sf_dir)
    per = ver.problem_periods(rev.series(c, FROM, TO, STEP), TO, STEP)
    return ver.main_cause(rev.totals(c), rev.backends(c), rev.termination_codes(c), per)


@query("I17_main_cause", f"WITH {BASE}, {SERIES}, {PERIODS}, {TOTALS}, {BACKENDS}, {TERMS}, {CAUSE} SELECT * FROM cause")
def i17(spark, sf_dir):
    return cause(spark, sf_dir)


NOTES = """notes AS (SELECT CASE WHEN lost / n >= 0.01 THEN 'warn' ELSE 'info' END AS level, 'nomatch' AS rule, '' AS target, lost AS n FROM (SELECT CAST(sum(nomatch) AS BIGINT) AS lost FROM frontends), totals WHERE lost > 0
  UNION ALL SELECT 'bad', 'noserver', backend, noserver FROM backends WHERE noserver > 0)"""


def notes(spark, sf_dir):
    c = reviewed(spark, sf_dir)
    return ver.unrouted_notes(rev.totals(c), rev.frontends(c), rev.backends(c))


@query("I18_unrouted_notes", f"WITH {BASE}, {TOTALS}, {BACKENDS}, {FRONTENDS}, {NOTES} SELECT * FROM notes")
def i18(spark, sf_dir):
    return notes(spark, sf_dir)


_IN_RANGE = f"at_ms BETWEEN {FROM - inc.SLACK_MS} AND {TO}"
OUTAGES = f"""down AS (SELECT *, row_number() OVER (PARTITION BY backend, server ORDER BY at_ms, up_at NULLS FIRST, reason) AS k FROM (SELECT d.*, (SELECT min(at_ms) FROM evs u WHERE u.type = 'up' AND u.backend = d.backend AND u.server = d.server AND u.at_ms > d.at_ms) AS up_at FROM evs d WHERE type = 'down')),
  outages AS (SELECT backend, server, at_ms AS down_at, up_at, reason, at_ms < {FROM} AS before_range FROM down WHERE k = 1)"""
_EVS = f"evs AS (SELECT * FROM ({fx.DUCK_EVENTS}) WHERE {{}})"


@query("I19_server_outages", f"WITH {_EVS.format('true')}, {OUTAGES} SELECT * FROM outages")
def i19(spark, sf_dir):
    return ver.server_outages(fx.events(spark, sf_dir), FROM)


_RATE = f"greatest(1 / 60, least({STEP}::DOUBLE, ({TO} - t) / 60000))"


def _longest_sql(name: str, bad: str, source: str) -> str:
    return f"""{name}_bad AS (SELECT bin, bin - coalesce(lag(bin) OVER (ORDER BY bin), -9) > 2 AS begins FROM {source} WHERE {bad}),
      {name}_run AS (SELECT min(bin) AS first, max(bin) AS last FROM (SELECT bin, count(*) FILTER (begins) OVER (ORDER BY bin) AS run FROM {name}_bad) GROUP BY run ORDER BY last - first DESC, first LIMIT 1)"""


DROP = f"""rates AS (SELECT *, n / {_RATE} AS rate FROM series), med AS (SELECT list_sort(list(rate))[count(*) // 2 + 1] AS median FROM rates),
  rm AS (SELECT * FROM rates, med), {_longest_sql('dr', f'median * {STEP} >= 20 AND rate < median * 0.25', 'rm')},
  drops AS (SELECT 0 AS incident, first, last, median, avg(rate) AS rate, avg(rate) < 0.5 AS stopped FROM dr_run JOIN rm ON bin BETWEEN first AND last GROUP BY ALL)"""
SLOW = f"""pm AS (SELECT coalesce(list_sort(list(p95_ms) FILTER (n >= 5 AND p95_ms >= 0))[count(*) FILTER (n >= 5 AND p95_ms >= 0) // 2 + 1], 0) AS median FROM series),
  sm AS (SELECT * FROM series, pm), {_longest_sql('sl', 'n >= 5 AND p95_ms > greatest(1000, median * 3)', 'sm')},
  slows AS (SELECT 0 AS incident, first, last, median, arg_max(bin, (p95_ms, -bin)) AS worst_bin, max(p95_ms) AS worst_p95 FROM sl_run JOIN sm ON bin BETWEEN first AND last GROUP BY ALL)"""


@query("I20_traffic_drop", f"WITH {BASE}, {SERIES}, {DROP} SELECT * REPLACE (round(rate, 6) AS rate, round(median, 6) AS median) FROM drops")
def i20(spark, sf_dir):
    return rounded(ver.traffic_drop(series(spark, sf_dir), TO, STEP), ["rate", "median"], 6)


@query("I21_slow_periods", f"WITH {BASE}, {SERIES}, {SLOW} SELECT * FROM slows")
def i21(spark, sf_dir):
    return ver.slow_periods(series(spark, sf_dir))


_VERDICT = f"""found AS (SELECT 'bad' AS level, 'error_period' AS rule, '' AS target FROM periods WHERE main UNION ALL SELECT 'bad', 'continuing', '' FROM ({_CONTINUING})
  UNION ALL SELECT level, 'main_backend', backend FROM cause WHERE backend IS NOT NULL UNION ALL SELECT level, rule, target FROM notes UNION ALL SELECT 'bad', 'outage', backend || '/' || server FROM outages
  UNION ALL SELECT 'warn', 'traffic_drop', '' FROM drops UNION ALL SELECT 'warn', 'slow', '' FROM slows UNION ALL SELECT 'warn', 'no_requests', '' FROM totals WHERE n = 0)"""


@query(
    "I23_incident_verdict",
    f"WITH {BASE}, {SERIES}, {PERIODS}, {TOTALS}, {BACKENDS}, {FRONTENDS}, {TERMS}, {CAUSE}, {NOTES}, {_EVS.format(_IN_RANGE)}, {OUTAGES}, {DROP}, {SLOW}, {_VERDICT} SELECT * FROM found UNION ALL SELECT 'ok', 'no_problem', '' WHERE NOT EXISTS (SELECT 1 FROM found WHERE level IN ('bad', 'warn'))",
)
def i23(spark, sf_dir):
    c = reviewed(spark, sf_dir)
    ser = materialize(rev.series(c, FROM, TO, STEP).drop("codes"), "series")
    per = materialize(ver.problem_periods(ser, TO, STEP), "periods")
    events = fx.events(spark, sf_dir).where(f"at_ms BETWEEN {FROM - inc.SLACK_MS} AND {TO}")  # all, not the first 500
    totals, backends = materialize(rev.totals(c), "totals"), materialize(rev.backends(c), "backends")
    why = ver.main_cause(totals, backends, rev.termination_codes(c), per)
    return ver.incident_verdict(totals, per, why, ver.unrouted_notes(totals, rev.frontends(c), backends), ver.server_outages(events, FROM), ver.traffic_drop(ser, TO, STEP), ver.slow_periods(ser))


@query("I24_series_rates", f"WITH {BASE}, {SERIES} SELECT bin, t, c5 / {_RATE} AS errors_per_minute, (n - c5) / {_RATE} AS rest_per_minute, CASE WHEN avg_ms >= 0 THEN avg_ms END AS avg_ms FROM series")
def i24(spark, sf_dir):
    return inc.series_rates(series(spark, sf_dir), TO, STEP)

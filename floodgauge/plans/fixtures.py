"""Inputs derived from the star-schema test tables, as SQL text that Spark and DuckDB both run.

Only integer arithmetic is used. ``div`` is written as {div} and the table names are plain, so that a
query and its comparison SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: 2024-01-01 00:00:00 UTC in milliseconds, the day that all derived traffic falls into.
T0 = 1704067200000
DAY_MS = 86_400_000

_ACCESS = """
SELECT at_ms, frontend, backend, server, ta, status,
  CASE WHEN status = 301 AND fe THEN 'LR--' WHEN status = 403 AND fe THEN 'PR--' WHEN status = 503 THEN 'SC--'
       WHEN status = 502 THEN 'SH--' WHEN status = 500 THEN 'sH--' WHEN status = -1 THEN 'CD--' ELSE '----' END AS term,
  CASE WHEN h % 101 = 0 THEN '2606:4700::' || (1 + h % 9)
       WHEN h % 10 < 6 THEN '162.158.' || (h % 4) || '.' || (p % 200) ELSE '198.51.100.' || (p % 250) END AS client,
  CASE WHEN ln = 6 THEN 'POST' WHEN ln = 7 THEN 'HEAD' ELSE 'GET' END AS method,
  CASE h % 5 WHEN 0 THEN '/api/v1/orders/' || o WHEN 1 THEN '/product/' || p || '/review' WHEN 2 THEN '/'
       WHEN 3 THEN '/static/app.js' ELSE '/blog/post' END AS raw_path,
  CASE h % 5 WHEN 0 THEN '/api/v1/orders/{id}' WHEN 1 THEN '/product/{id}/review' WHEN 2 THEN '/'
       WHEN 3 THEN '/static/app.js' ELSE '/blog/post' END AS path,
  CASE h % 4 WHEN 0 THEN '' WHEN 1 THEN 'shop.example.com' WHEN 2 THEN 'api.example.com' ELSE 'www.example.com' END AS host,
  ln % 2 = 1 AS tls,
  CASE WHEN server <> '<NOSRV>' THEN 'served' WHEN status = 403 THEN 'denied' WHEN status = 503 AND backend = frontend THEN 'nomatch'
       WHEN status = 503 THEN 'noserver' WHEN status >= 300 AND status < 400 THEN 'redirect' ELSE 'proxy' END AS kind
FROM (
  SELECT *, CASE WHEN fe OR (status = 503 AND h % 2 = 0) THEN '<NOSRV>' ELSE 'srv' || (1 + sk % 3) END AS server
  FROM (
    SELECT *,
      CASE WHEN fe THEN CASE WHEN h % 9 = 2 THEN 503 WHEN h % 3 = 1 THEN 403 ELSE 301 END
           WHEN backend = 'be_web' AND mi BETWEEN 840 AND 879 AND h % 3 < 2 THEN 503
           WHEN h % 200 = 1 THEN 500 WHEN h % 200 = 2 THEN 502 WHEN h % 40 IN (3, 4) THEN 404 WHEN h % 40 = 6 THEN 403
           WHEN h % 40 IN (7, 8, 9) THEN 301 WHEN h % 40 = 11 THEN 304 WHEN h % 200 = 12 THEN -1 ELSE 200 END AS status,
      CAST(CASE WHEN h % 97 = 0 THEN -1 WHEN h % 53 = 0 THEN 20000 + h % 180000
           WHEN backend = 'be_api' AND mi BETWEEN 900 AND 919 THEN 4000 + h % 2000 ELSE h % 400 END AS INT) AS ta
    FROM (
      SELECT *, h % 25 = 0 AS fe, 'http_front' AS frontend,
        CASE WHEN h % 25 = 0 THEN 'http_front' WHEN p % 10 < 5 THEN 'be_web' WHEN p % 10 < 8 THEN 'be_api' WHEN p % 10 = 8 THEN 'be_static' ELSE 'be_auth' END AS backend
      FROM (
        SELECT o, ln, p, sk, h, at_ms, (at_ms - 1704067200000) {div} 60000 AS mi
        FROM (
          SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS sk,
            (CAST(l_orderkey AS BIGINT) * 7919 + CAST(l_linenumber AS BIGINT) * 104729 + CAST(l_partkey AS BIGINT) * 31) % 1000003 AS h,
            1704067200000 + (CAST(l_orderkey AS BIGINT) * 2654435 + CAST(l_linenumber AS BIGINT) * 9756101) % 86400000 AS at_ms
          FROM lineitem) k) m
      WHERE NOT (mi BETWEEN 960 AND 969) OR h % 10 = 0) b) s) v
"""

_EVENTS = """
SELECT at_ms, type, CASE WHEN type = 'start' THEN '' ELSE backend END AS backend,
  CASE WHEN type IN ('start', 'noserver') THEN '' ELSE server END AS server,
  CASE WHEN type = 'down' THEN 'Layer4 connection problem' ELSE '' END AS reason,
  CAST(CASE WHEN type IN ('down', 'up') THEN leftover ELSE -1 END AS INT) AS remaining
FROM (
  SELECT at_ms + pause AS at_ms, backend, server, leftover,
    CASE k WHEN 0 THEN 'down' WHEN 2 THEN 'down' WHEN 1 THEN 'up' WHEN 3 THEN 'up' WHEN 4 THEN 'noserver' WHEN 5 THEN 'start' ELSE 'maint' END AS type
  FROM (
    SELECT (1704067200000 + (CAST(o_orderkey AS BIGINT) * 58620) % 86400000) {div} 1000 * 1000 AS at_ms, o_orderkey % 7 AS k,
      CASE o_custkey % 4 WHEN 0 THEN 'be_web' WHEN 1 THEN 'be_api' WHEN 2 THEN 'be_static' ELSE 'be_auth' END AS backend,
      'srv' || (1 + o_custkey % 3) AS server, o_custkey % 3 AS leftover
    FROM orders) e
  CROSS JOIN (SELECT 0 AS pause UNION ALL SELECT 20000 UNION ALL SELECT 70000) x
  WHERE pause = 0 OR k = 5) t
"""

#: Cumulative counters every ten seconds, from 13:30 to 14:30, of servers, backends and frontends. At
#: 14:00 the process restarts; srv3 of be_api is missing from 13:50 to 14:10.
TICK_FROM, TICK_TO, TICK_RESET = T0 + 48_600_000, T0 + 52_200_000, T0 + 50_400_000

_COUNTER_BASE = """
SELECT bin, pxname, svname, type,
  CAST(count(*) AS BIGINT) AS req_tot,
  CAST(sum(CASE WHEN status BETWEEN 200 AND 299 THEN 1 ELSE 0 END) AS BIGINT) AS h2,
  CAST(sum(CASE WHEN status BETWEEN 300 AND 399 THEN 1 ELSE 0 END) AS BIGINT) AS h3,
  CAST(sum(CASE WHEN status BETWEEN 400 AND 499 THEN 1 ELSE 0 END) AS BIGINT) AS h4,
  CAST(sum(CASE WHEN status BETWEEN 500 AND 599 THEN 1 ELSE 0 END) AS BIGINT) AS h5,
  CAST(sum(CASE WHEN status = -1 THEN 1 ELSE 0 END) AS BIGINT) AS ho,
  CAST(sum(CASE WHEN status = 503 THEN 1 ELSE 0 END) AS BIGINT) AS econ,
  CAST(sum(CASE WHEN status = 502 THEN 1 ELSE 0 END) AS BIGINT) AS eresp,
  CAST(sum(100 + length(raw_path)) AS BIGINT) AS bin_bytes, CAST(sum(1000 + status) AS BIGINT) AS bout
FROM (
  SELECT *, greatest(0, (at_ms - {tick_from} + 9999) {div} 10000) AS bin FROM access WHERE at_ms <= {tick_to}) a
CROSS JOIN (SELECT 0 AS type UNION ALL SELECT 1 UNION ALL SELECT 2) g
CROSS JOIN LATERAL (SELECT CASE WHEN type = 0 THEN frontend ELSE backend END AS pxname,
                           CASE type WHEN 0 THEN 'FRONTEND' WHEN 1 THEN 'BACKEND' ELSE server END AS svname) n
WHERE type = 0 OR (backend <> frontend AND (type = 1 OR server <> '<NOSRV>'))
GROUP BY bin, pxname, svname, type
"""

_COUNTERS = """
SELECT at_ms, uptime_sec, pxname, svname, type, req_tot, stot, h1, h2, h3, h4, h5, ho, econ, eresp, bin_bytes, bout
FROM (
  SELECT t.at_ms, CASE WHEN t.at_ms >= {tick_reset} THEN (t.at_ms - {tick_reset}) {div} 1000 ELSE 100000 + (t.at_ms - {tick_from}) {div} 1000 END AS uptime_sec,
    t.pxname, t.svname, t.type, {columns}
  FROM run t LEFT JOIN (SELECT * FROM run WHERE at_ms = {tick_reset}) z ON t.pxname = z.pxname AND t.svname = z.svname) s
WHERE NOT (pxname = 'be_api' AND svname = 'srv3' AND at_ms BETWEEN {gone_from} AND {gone_to})
"""

_NAMES = ("req_tot", "h2", "h3", "h4", "h5", "ho", "econ", "eresp", "bin_bytes", "bout")


def _counter_sql(div: str, ticks: str) -> str:
    """CTEs grid, base, run and counters over the view or CTE ``access``."""
    names = {"div": div, "tick_from": TICK_FROM, "tick_to": TICK_TO, "tick_reset": TICK_RESET, "gone_from": TICK_FROM + 1_200_000, "gone_to": TICK_FROM + 2_400_000}
    sums = ", ".join(f"CAST(sum(coalesce(b.{c}, 0)) OVER (PARTITION BY g.pxname, g.svname ORDER BY g.bin) AS BIGINT) AS {c}" for c in _NAMES)
    own = [f"t.{c} - CASE WHEN t.at_ms >= {TICK_RESET} THEN coalesce(z.{c}, 0) ELSE 0 END AS {c}" for c in _NAMES]
    own += [f"t.req_tot - CASE WHEN t.at_ms >= {TICK_RESET} THEN coalesce(z.req_tot, 0) ELSE 0 END AS stot", "CAST(0 AS BIGINT) AS h1"]
    return (
        f"base AS ({_COUNTER_BASE.format(**names)}), "
        f"grid AS (SELECT bin, pxname, svname, type FROM (SELECT DISTINCT pxname, svname, type FROM base) r CROSS JOIN ({ticks}) k), "
        f"run AS (SELECT {TICK_FROM} + g.bin * 10000 AS at_ms, g.pxname, g.svname, g.type, {sums} FROM grid g LEFT JOIN base b ON g.bin = b.bin AND g.pxname = b.pxname AND g.svname = b.svname), "
        f"counters AS ({_COUNTERS.format(columns=', '.join(own), **names)})"
    )


_N_TICKS = (TICK_TO - TICK_FROM) // 10_000

#: The proxy's own view of each row at the last tick: health check state and gauges.
_STATE = """
SELECT pxname, svname, type, k,
  CASE WHEN type = 0 THEN 'OPEN' WHEN type = 1 THEN 'UP'
       ELSE CASE k % 9 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' WHEN 2 THEN 'UP 1/3' WHEN 3 THEN 'DOWN 1/2' WHEN 4 THEN 'MAINT (via be)' WHEN 5 THEN 'DRAIN' WHEN 6 THEN 'no check' WHEN 7 THEN 'NOLB' ELSE 'UP' END END AS status,
  CASE k % 4 WHEN 0 THEN 'L4OK' WHEN 1 THEN '* L7STS' WHEN 2 THEN 'L4CON' ELSE 'L9X' END AS check_status,
  CASE k % 4 WHEN 1 THEN '500' ELSE '' END AS check_code,
  k % 8 AS chkdown, CASE WHEN type = 1 THEN k % 3 ELSE 0 END AS qcur, 100 * (k * 7 % 12) AS rtime, 9 * (k % 14) AS scur, CASE WHEN k % 5 = 0 THEN 0 ELSE 100 END AS slim
FROM (
  SELECT pxname, svname, type,
    CASE pxname WHEN 'be_api' THEN 3 WHEN 'be_auth' THEN 4 WHEN 'be_static' THEN 10 WHEN 'be_web' THEN 14 ELSE 23 END
    + CASE svname WHEN 'srv1' THEN 0 WHEN 'srv2' THEN 9 WHEN 'srv3' THEN 11 WHEN 'BACKEND' THEN 2 ELSE 1 END AS k
  FROM (SELECT DISTINCT pxname, svname, type FROM counters WHERE at_ms = {tick_to}) r) q
"""

_HOST = """
SELECT host, at_ms, n, user_j, system_j, idle_j, iowait_j, steal_j, mem_total, mem_available, swap_total, swap_free, load1, sectors_read, sectors_written
FROM (
  SELECT 'host' || h AS host, {t0} + {n} * 5000 AS at_ms, n,
    CAST(sum(e % 40) OVER w AS BIGINT) AS user_j, CAST(sum(e % 11) OVER w AS BIGINT) AS system_j, CAST(sum(50 + e % 70) OVER w AS BIGINT) AS idle_j,
    CAST(sum(e % 7) OVER w AS BIGINT) AS iowait_j, CAST(sum(e % 3) OVER w AS BIGINT) AS steal_j,
    CAST(8000000 AS BIGINT) AS mem_total, 1000000 + (e * 7919) % 6000000 AS mem_available, CAST(CASE WHEN h = 3 THEN 0 ELSE 2000000 END AS BIGINT) AS swap_total, (e * 31) % 2000000 AS swap_free,
    (e % 400) / 100.0 AS load1, CAST(sum(e % 900) OVER w AS BIGINT) AS sectors_read, CAST(sum(e % 500) OVER w AS BIGINT) AS sectors_written
  FROM (SELECT CAST(event_id AS BIGINT) AS e, CAST(user_id AS BIGINT) % 4 AS h, row_number() OVER (PARTITION BY CAST(user_id AS BIGINT) % 4 ORDER BY event_id) AS n FROM events) s
  WINDOW w AS (PARTITION BY h ORDER BY n)) x
"""

DUCK_ACCESS = _ACCESS.replace("{div}", "//")
DUCK_EVENTS = _EVENTS.replace("{div}", "//")
DUCK_COUNTERS = f"access AS ({DUCK_ACCESS}), {_counter_sql('//', f'SELECT unnest(range(0, {_N_TICKS} + 1)) AS bin')}"
DUCK_STATE = f"{DUCK_COUNTERS}, state AS ({_STATE.format(tick_to=TICK_TO)})"
DUCK_HOST = _HOST.format(t0=T0, n="n")


def _view(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(columns)


def dealt(rows: DataFrame) -> DataFrame:
    """For queries that write and parse text, whose work is worth a shuffle: rows that are read as fewer
    tasks than there are cores (a file of one row group cannot be split) over the cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request records of one day, one per lineitem row."""
    query = _ACCESS.replace("{div}", "div").replace("{id}", "{{id}}").replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(query, lineitem=_view(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server and proxy events: at_ms, type, backend, server, reason, remaining."""
    return spark.sql(_EVENTS.replace("{div}", "div").replace("FROM orders", "FROM {orders}"), orders=_view(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter snapshots every ten seconds: at_ms, uptime_sec, pxname, svname, type and counters."""
    ticks = f"SELECT id AS bin FROM range(0, {_N_TICKS} + 1)"
    query = _counter_sql("div", ticks).replace("FROM access", "FROM {access}")
    return spark.sql(f"WITH {query} SELECT * FROM counters", access=access(spark, sf_dir))


def state(spark: SparkSession, counter_rows: DataFrame) -> DataFrame:
    """State columns of each row at the last tick."""
    return spark.sql(_STATE.format(tick_to=TICK_TO).replace("FROM counters", "FROM {counters}"), counters=counter_rows)


def host_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw host samples every five seconds, cumulative jiffies and sectors. Spark numbers rows by INT,
    which times 5000 overflows behind 429,496 samples of a host."""
    return spark.sql(_HOST.format(t0=T0, n="CAST(n AS BIGINT)").replace("FROM events", "FROM {events}"), events=_view(spark, sf_dir, "events", ["event_id", "user_id"]))

"""Queries over derived request records: parsing, search and the live report, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.functions import fields as X
from floodgauge.operators import report, rollup, search
from floodgauge.operators.cidr import builtin_cidrs, ip_in_cidrs
from floodgauge.operators.parse import ACCESS, parse_access, parse_events, parse_quality, parse_raw, records, render_access, render_events
from floodgauge.plans import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The live report looks at the 120 minutes up to 15:30; the search at 13:00 to 16:30.
NOW_MINUTE, MINUTES = fx.T0 // 60000 + 930, 120
FROM, TO = fx.T0 + 780 * 60000, fx.T0 + 990 * 60000
A = f"access AS ({fx.DUCK_ACCESS})"
_LIVE = f"r AS (SELECT *, (at_ms // 60000) AS minute FROM access WHERE at_ms // 60000 >= {NOW_MINUTE - MINUTES + 1})"
LIVE = f"{A}, {_LIVE}"
IN_CDN = """(client LIKE '2606:4700:%' OR client LIKE '162.158.%' OR client LIKE '162.159.%')"""
S = {f"s{k}": f"CAST(sum(CASE WHEN status BETWEEN {k}00 AND {k}99 THEN 1 ELSE 0 END) AS BIGINT) AS s{k}" for k in (2, 3, 4, 5)}
S_ALL = ", ".join(S.values())
BLOCKED = "kind IN ('denied', 'nomatch', 'noserver')"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.last_minutes(fx.access(spark, sf_dir), NOW_MINUTE, MINUTES)


def rounded(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    """Means and sums of doubles depend on the order of rows in their last digits. As the SQL rounds: a
    multiple and back, where Spark's own takes the decimal digits, which differs near a half."""
    return df.withColumns({c: F.round(F.col(c) * 10.0**digits) / 10.0**digits for c in columns})


def rounded_sql(columns: list[str], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


# ---- parsing -------------------------------------------------------------------------------------


@query("P2_parse_access", f"WITH {A} SELECT {', '.join(ACCESS)} FROM access")
def p2(spark, sf_dir):
    """Records rendered to text and parsed again (P1 to P4, P6 to P11)."""
    return parse_access(render_access(fx.dealt(fx.access(spark, sf_dir)))).select("access.*")


CUSTOM = '%{+Q}r|%ci|%[req.hdr(host)]|%ST|%Ta|%ft|%b/%s|%{+X}Ts|%tsc'


@query(
    "P1_custom_format",
    f"""WITH {A} SELECT at_ms // 1000 * 1000 AS at_ms, client, frontend, backend, server, ta, status, term, method, path, raw_path, lower(host) AS host, tls, kind FROM access WHERE status >= 0""",
)
def p1(spark, sf_dir):
    """A format of one's own: quoted request, header expression, hexadecimal unix time."""
    a = fx.access(spark, sf_dir).where("status >= 0")
    fe = F.concat("frontend", F.when(F.col("tls"), "~").otherwise(""))
    host = F.when(F.col("host") == "", "-").otherwise(F.upper("host"))
    stamp = F.lower(F.hex(F.expr("at_ms DIV 1000")))
    line = F.format_string('"%s %s HTTP/2.0"|%s|%s|%s|%s|%s|%s/%s|%s|%s', "method", "raw_path", "client", host, "status", "ta", fe, "backend", "server", stamp, "term")
    return parse_access(a.select(line.alias("value")), [CUSTOM]).select("access.*")


@query("P5_syslog_time", f"SELECT at_ms, type FROM ({fx.DUCK_EVENTS})")
def p5(spark, sf_dir):
    """Stamps without a year, read against a time of the following year's first hours."""
    lines = render_events(fx.dealt(fx.events(spark, sf_dir)))
    now = F.timestamp_millis(F.lit(fx.T0 + fx.DAY_MS))
    return parse_events(lines, now).select("at_ms", "type")


@query("P20_parse_event", f"SELECT at_ms, type, backend, server, reason, remaining FROM ({fx.DUCK_EVENTS})")
def p20(spark, sf_dir):
    return parse_events(render_events(fx.dealt(fx.events(spark, sf_dir))), F.timestamp_millis(F.lit(fx.T0 + fx.DAY_MS)))


_CUT = r"regexp_replace(url, '[?#].*$', '', 's')"
_REST = f"regexp_replace({_CUT}, '^.*?://', '', 's')"
_PLAIN = f"CASE WHEN contains({_CUT}, '://') THEN CASE WHEN contains({_REST}, '/') THEN regexp_replace({_REST}, '^[^/]*', '', 's') ELSE '/' END ELSE {_CUT} END"
_ID = "regexp_matches(x, '^[0-9]+$') OR (length(x) >= 16 AND regexp_matches(x, '^[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]*$'))"


@query(
    "P7_norm_path",
    f"""SELECT page_id, CASE WHEN length(p) > 120 THEN p[1:120] || '…' ELSE p END AS path, CASE WHEN length(q) > 200 THEN q[1:200] || '…' ELSE q END AS raw_path, host FROM (
      SELECT page_id, array_to_string(list_transform(string_split(q, '/'), lambda x: CASE WHEN {_ID} THEN '{{id}}' ELSE x END), '/') AS p, q, host
      FROM (SELECT page_id, {_PLAIN} AS q, CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '://([^/?]*)', 1)) ELSE '' END AS host FROM pages))""",
)
def p7(spark, sf_dir):
    """Paths and hosts of page addresses (P7, P8 and the absolute form of P9)."""
    u = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.norm_path(u).alias("path"), X.raw_path(u).alias("raw_path"), X.uri_host(u).alias("host"))



@query(
    "P9_extract_host",
    f"""WITH {A} SELECT at_ms, client, path, CASE frontend WHEN 'http_front' THEN host END AS by_slot, host AS guessed, CASE WHEN host = '' THEN '' WHEN tls THEN 'https://' || host ELSE 'http://' || host END AS origin FROM access""",
)
def p9(spark, sf_dir):
    """The host from a known capture slot and by guessing, and the origin (P9, P10): lines are parsed
    once, as only the last step differs."""
    lines = render_access(fx.dealt(fx.access(spark, sf_dir)))
    fields = ["at_ms", "client", "path", "host", "tls"]
    known = records(parse_raw(lines, fields=fields), "known", {"http_front": 0}, ["host"])
    both = records(known, fields=fields)
    a = F.col("access")
    return both.select(a["at_ms"].alias("at_ms"), a["client"].alias("client"), a["path"].alias("path"), F.col("known.host").alias("by_slot"), a["host"].alias("guessed"), X.origin(a["host"], a["tls"]).alias("origin"))


@query(
    "P11_classify",
    f"""WITH {A} SELECT kind, CASE WHEN status BETWEEN 200 AND 599 THEN status // 100 - 2 ELSE 4 END AS class5, {BLOCKED} AS blocked, server = '<NOSRV>' AND backend = frontend AS frontend_answered, count(*) AS n FROM access GROUP BY ALL""",
)
def p11(spark, sf_dir):
    """Kind, class, blocked and answered by the frontend (P11 to P13)."""
    a = fx.access(spark, sf_dir)
    kind = X.kind(F.col("server"), F.col("status"), F.col("backend"), F.col("frontend"))
    fe = X.frontend_answered(F.col("server"), F.col("backend"), F.col("frontend"))
    return a.groupBy(kind.alias("kind"), X.class5(F.col("status")).alias("class5"), X.is_blocked(F.col("kind")).alias("blocked"), fe.alias("frontend_answered")).agg(report.one())


_MEANING = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in X.TERM_SPECIAL.items())


@query(
    "P14_explain_term",
    f"""WITH {A} SELECT term[1:2] AS code, CASE term[1:2] {_MEANING} ELSE 'unknown cause (-)' END AS meaning,
      CASE WHEN term[1:1] IN ('S', 's', 'R', 'I', 'D', 'U') THEN 'server' WHEN term[1:1] IN ('C', 'c') THEN 'client' ELSE 'rule' END AS side, count(*) AS n FROM access GROUP BY ALL""",
)
def p14(spark, sf_dir):
    code = X.term_code(F.col("term"))
    return fx.access(spark, sf_dir).groupBy(code.alias("code"), X.explain_term(code).alias("meaning"), X.term_side(code).alias("side")).agg(report.one())


BOUNDS = str(X.DURATION_BOUNDS)


@query("P19_duration_bucket", f"WITH {A} SELECT CAST(len(list_filter({BOUNDS}, lambda b: b <= ta)) AS INTEGER) AS bucket, count(*) AS n, min(ta) AS least, max(ta) AS most FROM access WHERE ta >= 0 GROUP BY ALL")
def p19(spark, sf_dir):
    a = fx.access(spark, sf_dir).where("ta >= 0")
    return a.groupBy(X.duration_bucket(F.col("ta")).alias("bucket")).agg(report.one(), F.min("ta").alias("least"), F.max("ta").alias("most"))


@query(
    "P21_redact",
    """SELECT page_id, CASE WHEN length(m) > 400 THEN m[1:400] || '…' ELSE m END AS message, regexp_matches(line, '^[^\\s]+:\\d+ ') AS traffic
       FROM (SELECT page_id, line, regexp_replace(line, '\\?[^ "]*', '?…', 'g') AS m FROM (SELECT page_id, 'x:1 "GET ' || url || '?k=' || page_id || ' HTTP/1.1"' AS line FROM pages))""",
)
def p21(spark, sf_dir):
    line = F.concat(F.lit('x:1 "GET '), "url", F.lit("?k="), F.col("page_id").cast("string"), F.lit(' HTTP/1.1"'))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.redact(line).alias("message"), X.traffic_like(line).alias("traffic"))


@query("P22_ip_in_cidrs", f"WITH {A} SELECT client, count(*) AS n, {IN_CDN} AS in_cdn FROM access GROUP BY ALL")
def p22(spark, sf_dir):
    each = fx.access(spark, sf_dir).groupBy("client").agg(report.one())
    return ip_in_cidrs(each, builtin_cidrs(spark))


# ---- search --------------------------------------------------------------------------------------

SEARCH = dict(path="/Product/", status="4xx", backend="WEB", from_ms=FROM, to_ms=TO)
HITS = f"{A}, h AS (SELECT * FROM access WHERE (contains(lower(raw_path), '/product/') OR contains(lower(path), '/product/')) AND status BETWEEN 400 AND 499 AND contains(backend, 'web') AND at_ms BETWEEN {FROM} AND {TO})"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = search.build_query(TO, **SEARCH)
    lines = search.prefilter_lines(render_access(fx.dealt(fx.access(spark, sf_dir))), q)
    return search.search_filter(parse_access(lines).select("access.*"), q)


@query("Q1_search_totals", f"WITH {HITS} SELECT count(*) AS matches, min(at_ms) AS first_at, max(at_ms) AS last_at FROM h")
def q1(spark, sf_dir):
    """From text: prefilter (F2), parse, filter (F1), totals."""
    return search.search_totals(hits(spark, sf_dir))


@query("Q2_search_codes", f"WITH {HITS} SELECT status, count(*) AS n FROM h GROUP BY ALL")
def q2(spark, sf_dir):
    return search.search_codes(hits(spark, sf_dir))


@query("Q3_search_top_ips", f"WITH {HITS} SELECT client, n, {IN_CDN} AS in_cdn FROM (SELECT client, count(*) AS n FROM h GROUP BY ALL ORDER BY n DESC, client LIMIT 20)")
def q3(spark, sf_dir):
    return search.search_top_ips(hits(spark, sf_dir), builtin_cidrs(spark))


@query("Q4_search_top_paths", f"WITH {HITS} SELECT method || ' ' || path AS request, count(*) AS n FROM h GROUP BY ALL ORDER BY n DESC, request LIMIT 20")
def q4(spark, sf_dir):
    return search.search_top_paths(hits(spark, sf_dir))


_ALL = ", ".join(ACCESS)


@query("Q5_search_hits", f"WITH {HITS} SELECT {_ALL} FROM h ORDER BY at_ms DESC, {', '.join(sorted(c for c in ACCESS if c != 'at_ms'))} LIMIT 200")
def q5(spark, sf_dir):
    return search.search_hits(hits(spark, sf_dir))


@query("F1_search_exact", f"WITH {A} SELECT {_ALL} FROM access WHERE (path = '/api/v1/orders/{{id}}' OR raw_path = '/api/v1/orders/{{id}}') AND client LIKE '162.158.1%' AND method = 'POST'")
def f1(spark, sf_dir):
    return search.search_filter(fx.access(spark, sf_dir), search.build_query(TO, path="/api/v1/orders/{id}", exact=True, ip="162.158.1", method="post")).select(*ACCESS)


@query("F2_prefilter", f"WITH {A} SELECT count(*) AS n, CAST(sum(ta) AS BIGINT) AS total FROM access WHERE method = 'HEAD' AND status BETWEEN 500 AND 599 AND contains(path, 'orders/{{id}}')")
def f2(spark, sf_dir):
    """Filtering the text first loses no match."""
    q = search.build_query(TO, path="orders/{id}", method="HEAD", status="5xx")
    lines = search.prefilter_lines(render_access(fx.dealt(fx.access(spark, sf_dir))), q)
    return search.search_filter(parse_access(lines).select("access.*"), q).agg(report.one(), F.sum("ta").alias("total"))


@query(
    "F6_last_minutes",
    f"WITH {LIVE} SELECT count(*) AS n, count(*) FILTER (minute > {NOW_MINUTE} - 2) AS recent, min(at_ms) AS first_at FROM r",
)
def f6(spark, sf_dir):
    return live(spark, sf_dir).agg(report.one(), F.count_if(rollup.minute() > NOW_MINUTE - 2).alias("recent"), F.min("at_ms").alias("first_at"))


# ---- per-minute summaries ------------------------------------------------------------------------

_TA = "CAST(sum(CASE WHEN kind = 'served' AND ta >= 0 THEN ta ELSE 0 END) AS BIGINT) AS sum_ta, count(*) FILTER (kind = 'served' AND ta >= 0) AS n_ta"
ROLLUP_SQL = {
    "totals": f"SELECT minute, kind, count(*) AS n, {S_ALL}, count(*) FILTER (host <> '') AS with_host FROM r GROUP BY ALL",
    "paths": f"SELECT minute, backend, method, path, count(*) AS n, {S_ALL}, {_TA} FROM r GROUP BY ALL",
    "blocked": f"SELECT minute, kind, method, path, count(*) AS n FROM r WHERE {BLOCKED} GROUP BY ALL",
    "clients": f"SELECT minute, client, count(*) AS n, count(*) FILTER ({BLOCKED}) AS blocked FROM r GROUP BY ALL",
    "backends": f"SELECT minute, backend, count(*) AS n, {S_ALL}, count(*) FILTER ({BLOCKED}) AS blocked FROM r GROUP BY ALL",
}
_DAY = f"{A}, r AS (SELECT *, at_ms // 60000 AS minute FROM access)"
_ROLLUPS = ", ".join(f"m_{k} AS ({v})" for k, v in ROLLUP_SQL.items())
_END = fx.T0 // 60000 + 1439


def _rollup(name: str):
    return lambda spark, sf_dir: rollup.minute_rollup(fx.access(spark, sf_dir))[name]


def _tiered(name: str):
    return lambda spark, sf_dir: rollup.tiered_retention(rollup.minute_rollup(fx.access(spark, sf_dir)), _END, 60, 360, 1000)[name]


for _name, (_key, _) in rollup.TABLES.items():
    query(f"L1_minute_{_name}", f"WITH {_DAY} {ROLLUP_SQL[_name]}")(_rollup(_name))
    _kept = f"SELECT * FROM m_{_name} WHERE {_END} - minute < 1000"
    if _name in rollup.LISTS:
        _kept = f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY minute ORDER BY n DESC, {', '.join(_key)}) AS k FROM m_{_name}) WHERE {_END} - minute < 360 AND ({_END} - minute < 60 OR k <= {rollup.LISTS[_name]})"
    query(f"L13_retained_{_name}", f"WITH {_DAY}, {_ROLLUPS} {_kept}")(_tiered(_name))

_W = " UNION ALL ".join(f"SELECT minute, count(*) * {f} AS w0, least(count(*), {rollup.LISTS[k]}) * {t} AS w1, 0 AS w2 FROM m_{k} GROUP BY minute" for k, (f, t) in rollup.WEIGHTS.items())
_WEIGHTS = f"w AS (SELECT minute, CAST(sum(w0) AS BIGINT) AS w0, CAST(sum(w1) AS BIGINT) AS w1, CAST(sum(w2) AS BIGINT) AS w2 FROM ({_W} UNION ALL SELECT minute, count(*) * 200, count(*) * 200, count(*) * 200 + 500 FROM m_backends GROUP BY minute) GROUP BY minute)"
#: Weight that the lists may have; smaller tables stay below it.
BUDGET = 30_000_000
_LEVELS = f"""one AS (SELECT *, sum(w0) OVER () - {BUDGET} > coalesce(sum(w0 - w1) OVER (ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS thin FROM w),
  two AS (SELECT *, CASE WHEN thin THEN w1 ELSE w0 END AS w FROM one),
  three AS (SELECT *, sum(w) OVER () - {BUDGET} > coalesce(sum(w - w2) OVER (ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bare FROM two),
  levels AS (SELECT minute, CASE WHEN bare THEN 2 WHEN thin THEN 1 ELSE 0 END AS level FROM three)"""


@query("L14_budget_levels", f"WITH {_DAY}, {_ROLLUPS}, {_WEIGHTS}, {_LEVELS} SELECT minute, level FROM levels")
def l14(spark, sf_dir):
    return rollup.budget_levels(rollup.minute_weights(rollup.minute_rollup(fx.access(spark, sf_dir))), BUDGET)


@query(
    "L14_budget_clients",
    f"WITH {_DAY}, {_ROLLUPS}, {_WEIGHTS}, {_LEVELS} SELECT minute, client, n, blocked FROM (SELECT c.*, level, row_number() OVER (PARTITION BY c.minute ORDER BY n DESC, client) AS k FROM m_clients c JOIN levels USING (minute)) WHERE level = 0 OR (level = 1 AND k <= 30)",
)
def l14_clients(spark, sf_dir):
    return rollup.budget_retention(rollup.minute_rollup(fx.access(spark, sf_dir)), BUDGET)["clients"]


# ---- live report ---------------------------------------------------------------------------------

_TOTALS = f"SELECT kind, count(*) AS n, count(*) FILTER (minute > {NOW_MINUTE} - 2) AS recent, {S_ALL}, count(*) FILTER (host <> '') AS with_host, max(at_ms) AS last_at FROM r GROUP BY kind"
_TOP = f"SELECT backend, method, path, n, s2, s3, s4, s5, CASE WHEN n_ta > 0 THEN sum_ta / n_ta END AS avg_ms FROM (SELECT backend, method, path, count(*) AS n, {S_ALL}, {_TA} FROM r GROUP BY ALL) ORDER BY n DESC, path, method || backend LIMIT 40"
_CODE_PATHS = f"cp AS (SELECT backend, method, path, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE '' END AS kind, count(*) AS n, {S['s3']}, {S['s4']}, {S['s5']} FROM r GROUP BY backend, method, path), " + (
    "listed AS (SELECT * EXCLUDE (k3, k4, k5) FROM (SELECT *, "
    + ", ".join(f"row_number() OVER (ORDER BY s{k} DESC, path || method || backend) AS k{k}" for k in (3, 4, 5))
    + " FROM cp) WHERE (k5 <= 20 AND s5 > 0) OR (k4 <= 20 AND s4 > 0) OR (k3 <= 20 AND s3 > 0))"
)
_BLOCKED = f"SELECT kind, method, path, count(*) AS n FROM r WHERE {BLOCKED} GROUP BY kind, method, path ORDER BY n DESC, path, method || kind LIMIT 40"


@query("L2_report_totals", f"WITH {LIVE} {_TOTALS}")
def l2(spark, sf_dir):
    return report.report_totals(live(spark, sf_dir), NOW_MINUTE)


@query("L3_report_top_paths", f"WITH {LIVE} {_TOP}")
def l3(spark, sf_dir):
    return report.report_top_paths(live(spark, sf_dir))


@query(
    "L4_path_ip_breakdown",
    f"""WITH {LIVE}, top AS ({_TOP}), e AS (SELECT r.backend, r.method, r.path, client, status, count(*) AS n FROM r JOIN top ON r.backend = top.backend AND r.method = top.method AND r.path = top.path GROUP BY ALL),
      t AS (SELECT backend, method, path, client, row_number() OVER (PARTITION BY backend, method, path ORDER BY sum(n) DESC, client) AS k FROM e GROUP BY backend, method, path, client),
      l AS (SELECT e.backend, e.method, e.path, CASE WHEN k <= 20 THEN client ELSE '(other)' END AS client, status, sum(n) AS n FROM e JOIN t USING (backend, method, path, client) GROUP BY ALL),
      c AS (SELECT *, row_number() OVER (PARTITION BY backend, method, path, client ORDER BY n DESC, status) AS k FROM l)
      SELECT backend, method, path, client, CASE WHEN k <= 6 THEN CAST(status AS VARCHAR) ELSE 'other' END AS code, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL""",
)
def l4(spark, sf_dir):
    rows = live(spark, sf_dir)
    return report.path_ip_breakdown(rows, report.report_top_paths(rows))


@query("L5_code_paths", f"WITH {LIVE}, {_CODE_PATHS} SELECT * FROM listed")
def l5(spark, sf_dir):
    return report.code_paths(live(spark, sf_dir))


@query(
    "L5_code_path_codes",
    f"WITH {LIVE}, {_CODE_PATHS}, c AS (SELECT r.backend, r.method, r.path, status, count(*) AS n FROM r SEMI JOIN listed l ON r.backend = l.backend AND r.method = l.method AND r.path = l.path GROUP BY ALL) SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY backend, method, path ORDER BY n DESC, status) AS k FROM c) WHERE k <= 6",
)
def l5_codes(spark, sf_dir):
    rows = live(spark, sf_dir)
    return report.code_path_codes(rows, report.code_paths(rows))


@query("L6_blocked_requests", f"WITH {LIVE} {_BLOCKED}")
def l6(spark, sf_dir):
    return report.blocked_requests(live(spark, sf_dir))


def _detail_sql(listed: str, keys: list[str], where: str) -> str:
    k, on = ", ".join(keys), " AND ".join(f"r.{c} = l.{c}" for c in keys)
    rk = ", ".join(f"r.{c}" for c in keys)
    parts = " UNION ALL ".join(
        f"SELECT {k}, '{s}' AS section, name, n FROM (SELECT {k}, {c} AS name, count(*) AS n, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {c}) AS i FROM o GROUP BY {k}, {c}) WHERE i <= {n}"
        for s, c, n in (("origin", "origin", 8), ("sample", "raw_path", 5), ("ip", "client", 8))
    )
    return (
        f"WITH {LIVE}, {listed}, o AS (SELECT {rk}, client, raw_path, CASE WHEN host = '' THEN '' WHEN tls THEN 'https://' || host ELSE 'http://' || host END AS origin FROM r SEMI JOIN listed l ON {on} WHERE {where}), "
        f"t AS (SELECT {k}, count(*) AS total, count(*) FILTER (origin <> '') AS host_known FROM o GROUP BY {k}) SELECT * FROM ({parts}) JOIN t USING ({k})"
    )


@query("L7_code_path_detail", _detail_sql(_CODE_PATHS, report.PATH_KEY, "status >= 300"))
def l7(spark, sf_dir):
    rows = live(spark, sf_dir)
    return report.request_detail(rows.where("status >= 300"), report.code_paths(rows), report.PATH_KEY)


@query("L7_blocked_detail", _detail_sql(f"listed AS ({_BLOCKED})", ["kind", "method", "path"], BLOCKED))
def l7_blocked(spark, sf_dir):
    rows = live(spark, sf_dir)
    return report.request_detail(rows, report.blocked_requests(rows), ["kind", "method", "path"])


_CLIENTS = f"top AS (SELECT client, count(*) AS n, count(*) FILTER ({BLOCKED}) AS blocked FROM r GROUP BY client ORDER BY n DESC, client LIMIT 30)"


@query("L8_top_clients", f"WITH {LIVE}, {_CLIENTS} SELECT *, {IN_CDN} AS in_cdn FROM top")
def l8(spark, sf_dir):
    return report.top_clients(live(spark, sf_dir), builtin_cidrs(spark))


@query(
    "L8_client_paths",
    f"WITH {LIVE}, {_CLIENTS} SELECT client, request, n FROM (SELECT client, method || ' ' || path AS request, count(*) AS n, row_number() OVER (PARTITION BY client ORDER BY count(*) DESC, method || ' ' || path) AS k FROM r SEMI JOIN top USING (client) GROUP BY 1, 2) WHERE k <= 6",
)
def l8_paths(spark, sf_dir):
    rows = live(spark, sf_dir)
    return report.client_paths(rows, report.top_clients(rows, builtin_cidrs(spark)))


@query("L9_backend_breakdown", f"WITH {LIVE} SELECT backend, count(*) AS n, {S_ALL}, count(*) FILTER ({BLOCKED}) AS blocked FROM r GROUP BY backend")
def l9(spark, sf_dir):
    return report.backend_breakdown(live(spark, sf_dir))


@query(
    "L9_backend_tops",
    f"WITH {LIVE} "
    + " UNION ALL ".join(
        f"SELECT backend, '{s}' AS section, name, n FROM (SELECT backend, {e} AS name, count(*) AS n, row_number() OVER (PARTITION BY backend ORDER BY count(*) DESC, {e}) AS k FROM r GROUP BY backend, {e}) WHERE k <= 10"
        for s, e in (("path", "method || ' ' || path"), ("ip", "client"))
    ),
)
def l9_tops(spark, sf_dir):
    return report.backend_tops(live(spark, sf_dir))


_SHARES = ", ".join(f"s{k} / (s2 + s3 + s4 + s5) AS s{k}_share, s{k} / {MINUTES} AS s{k}_per_minute" for k in (2, 3, 4, 5))


@query(
    "L10_request_summary",
    f"WITH {LIVE} SELECT *, {_SHARES} FROM (SELECT count(*) AS n, {S_ALL}, count(*) FILTER (kind = 'served') AS reached_server, count(*) FILTER (kind IN ('redirect', 'denied', 'proxy')) AS answered_by_proxy, count(*) FILTER (kind IN ('nomatch', 'noserver')) AS reached_nothing FROM r)",
)
def l10(spark, sf_dir):
    return report.request_summary(report.report_totals(live(spark, sf_dir), NOW_MINUTE), MINUTES)


@query(
    "L11_parse_quality",
    f"""WITH {A}, q AS (SELECT count(*) AS lines, count(*) FILTER (ta % 20 <> 7) AS parsed, count(*) FILTER (ta % 20 <> 7 AND host <> '') AS with_host, count(*) FILTER (ta % 20 = 7) AS unparsed FROM access)
      SELECT lines, lines AS traffic, parsed, 0 AS tcp, with_host, unparsed, parsed / lines >= 0.8 AS usable, unparsed >= 20 AND unparsed >= 0.05 * lines AS note FROM q""",
)
def l11(spark, sf_dir):
    """Every twentieth or so line is damaged behind its date."""
    a = fx.dealt(fx.access(spark, sf_dir))
    lines = render_access(a.where("ta % 20 <> 7")).union(render_access(a.where("ta % 20 = 7")).select(F.regexp_replace("value", r"\] .*$", "] ?")))
    return parse_quality(parse_access(lines))

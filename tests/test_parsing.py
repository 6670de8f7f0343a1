"""Golden cases of single lines, formats and fields."""

from datetime import datetime

from pyspark.sql import functions as F

from floodgauge.functions import fields as X
from floodgauge.functions.logformat import compile_format, format_specs
from floodgauge.operators.parse import parse_access, parse_events, parse_quality

HEAD = "Sep 10 11:36:46 lb1 haproxy[4242]: "


def access(spark, *lines, **options):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    return [r["access"] for r in parse_access(df, **options).orderBy("i").collect()]


def test_http_lines(spark):
    deny = HEAD + '203.0.113.9:51234 [10/Sep/2026:11:36:46.774] web~ web/<NOSRV> 0/-1/-1/-1/0 403 192 - - PR-- 1/1/0/0/0 0/0 {a.example.com|x} "GET /item/12345?token=1 HTTP/1.1"'
    v6 = '2001:db8::7:443 [10/Sep/2026:11:36:47.001] web web/<NOSRV> 0/-1/-1/-1/+12 301 0 - - LR-- 1/1/0/0/0 0/0 "GET http://Shop.Example.com/old HTTP/1.1"'
    no_backend = '198.51.100.1:1 [10/Sep/2026:11:36:47.001] web web/<NOSRV> 0/-1/-1/-1/0 503 0 - - SC-- 1/1/0/0/0 0/0 "GET / HTTP/1.1"'
    no_server = '198.51.100.1:1 [10/Sep/2026:11:36:47.001] web api/<NOSRV> 0/-1/-1/-1/0 503 0 - - SC-- 1/1/0/0/0 0/0 "GET / HTTP/1.1"'
    a, b, c, d, e = access(spark, deny, v6, no_backend, no_server, "Server web/s1 is DOWN")
    assert (a.client, a.frontend, a.tls, a.status, a.term, a.kind) == ("203.0.113.9", "web", True, 403, "PR--", "denied")
    assert (a.path, a.raw_path, a.host, a.method) == ("/item/{id}", "/item/12345", "a.example.com", "GET")
    assert datetime.fromtimestamp(a.at_ms / 1000).microsecond == 774000
    assert (b.client, b.ta, b.kind, b.host, b.path) == ("2001:db8::7", 12, "redirect", "shop.example.com", "/old")
    assert (c.kind, d.kind, e) == ("nomatch", "noserver", None)


def test_tcp_line(spark):
    (r,) = access(spark, "10.0.0.1:1 [10/Sep/2026:11:36:46.774] fe be_db/db1 1/0/5007 212 -- 1/1/1/1/0 0/0")
    assert (r.kind, r.ta, r.server, r.term, r.path) == ("tcp", 5007, "db1", "--", "(no path)")


def test_custom_formats(spark):
    unix = access(spark, '{"t":1789000000,"c":"10.1.1.1","s":200,"p":"/a/b"}', formats=['{"t":%Ts,"c":"%ci","s":%ST,"p":"%HP"}'])[0]
    assert (unix.at_ms, unix.client, unix.status, unix.path) == (1789000000000, "10.1.1.1", 200, "/a/b")
    zone = access(spark, "10.1.1.1 [10/Sep/2026:11:36:46 +0300] GET /x", formats=["%ci [%trl] %HM %HU"])[0]
    assert zone.at_ms == 1789029406000 and zone.method == "GET"
    slots = access(spark, '10.1.1.1 f/b s 200 "GET / HTTP/1.1" h.example.org', formats=['%ci %f/%b %s %ST %{+Q}r %[capture.req.hdr(1)]'], host_slots={"f": 1})[0]
    assert slots.host == "h.example.org"


def test_missing_date_takes_ingest(spark):
    (r,) = access(spark, "10.1.1.1 GET /x", formats=["%ci %HM %HU"], ingest=F.timestamp_millis(F.lit(5000)))
    assert r.at_ms == 5000


def test_formats_once_and_literals():
    assert [s.source for s in format_specs(["%ci", "%ci"])][:1] == ["%ci"] and len(format_specs(["%ci"])) == 3
    assert compile_format("100%% %zz x").regex.startswith(r"^100% (?:\S*) x")
    assert compile_format("%{+Q]r").regex.startswith("^%\\{")


def test_paths(spark):
    cases = {
        "/urun/12345": "/urun/{id}", "/a/550e8400-e29b-41d4-a716-446655440000/b": "/a/{id}/b", "https://x.example/y?z=1": "/y", "https://x.example": "/",
        "/haber/12-mac-sonucu": "/haber/12-mac-sonucu", "/deadbeefdeadbeef": "/deadbeefdeadbeef", "/deadbeefdeadbee1": "/{id}", "/a#b": "/a", "": "", "/" + "x" * 130: "/" + "x" * 119 + "…",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.p for r in df.select("u", X.norm_path(F.col("u")).alias("p")).collect()} == cases


def test_guessed_host(spark):
    rows = [("{a.example.com|b}", "", "a.example.com"), ("{10.0.0.1:80}", "", "10.0.0.1:80"), ("{x|y}", "https://ref.example.com/ 1/sni.Example.com/-", "sni.example.com"), ("", "", "")]
    df = spark.createDataFrame(rows, "c string, t string, want string")
    assert all(r.h == r.want for r in df.select("want", X.guessed_host(F.col("c"), F.col("t")).alias("h")).collect())


def test_events(spark):
    lines = [
        'Oct  8 14:00:01 lb haproxy[1]: Server web/s1 is DOWN, reason: Layer4 timeout, code: 0, info: "x", check duration: 1ms. 1 active and 0 backup servers left.',
        "2026-10-08T14:00:01.123+03:00 lb haproxy[1]: backend web has no server available!",
        "2026-10-08T14:00:01.123+0300 lb haproxy[1]: Proxy fe started.",
        "Dec 31 23:59:59 lb haproxy[1]: Server web/s1 is UP/READY. 2 active and 0 backup servers online.",
        "no stamp haproxy[1]: Server web/s2 enters drain state.",
        "Oct  8 14:00:01 lb haproxy[1]: Stopping proxy fe in 0 ms.",
        "nothing",
    ]
    now = F.timestamp_millis(F.lit(1791500000000))  # 2026-10-08
    got = parse_events(spark.createDataFrame([(x,) for x in lines], "value string"), now).collect()
    assert [r.type for r in got] == ["down", "noserver", "start", "up", "drain", "stop"]
    assert (got[0].backend, got[0].server, got[0].reason, got[0].remaining) == ("web", "s1", "Layer4 timeout, code: 0", 1)
    assert got[1].at_ms == got[2].at_ms == 1791457201123
    assert datetime.fromtimestamp(got[3].at_ms / 1000 - 86_400).year == 2025  # over 48 hours ahead: the year before
    assert got[4].at_ms is None


def test_quality(spark):
    good = '198.51.100.1:1 [10/Sep/2026:11:36:47.001] web api/s1 0/0/0/0/0 200 0 - - ---- 1/1/0/0/0 0/0 "GET / HTTP/1.1"'
    df = spark.createDataFrame([(good,)] * 70 + [("10.0.0.1:5 odd",)] * 30 + [("Server x is DOWN",)], "value string")
    (r,) = parse_quality(parse_access(df)).collect()
    assert (r.lines, r.traffic, r.parsed, r.unparsed, r.usable, r.note) == (101, 100, 70, 30, False, True)


def test_states_terms_numbers(spark):
    cases = {"UP": "up", "UP 1/3": "failing", "DOWN": "down", "DOWN 1/2": "recovering", "MAINT (via x)": "maint", "NOLB": "drain", "no check": "nocheck", "OPEN": "up", "FULL": "full", "STOP": "down", "": "none", "x": "none"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.k for r in df.select("s", X.server_state(F.col("s")).alias("k")).collect()} == cases
    (r,) = spark.range(1).select(X.number(F.lit("x")).alias("a"), X.number(F.lit("1.5")).alias("b"), X.explain_term(F.lit("KD")).alias("t"), X.explain_term(F.lit("??")).alias("u"), X.duration_bucket(F.lit(-1)).alias("d")).collect()
    assert (r.a, r.b, r.d) == (0.0, 1.5, None) and r.t == "connection killed by an administrator, during data transfer" and r.u == "unknown cause (?)"


def test_redact(spark):
    (r,) = spark.range(1).select(X.redact(F.lit('GET /a?token=secret HTTP/1.1"')).alias("m")).collect()
    assert r.m == 'GET /a?… HTTP/1.1"'

"""Records of some fields only, and several records from one parse."""

import pytest
from pyspark.sql import functions as F

from floodgauge.functions.logformat import DEFAULT_FORMATS, compile_format
from floodgauge.operators.parse import ACCESS, parse_access, parse_raw, records
from floodgauge.plans import log_queries

HTTP = '10.0.0.{n}:4000 [01/Jan/2024:00:00:0{n}.000] {fe} be/{s} 0/0/1/2/{n} {st} 512 - - ---- 1/1/0/0/0 0/0 {c}"GET {u} HTTP/1.1"{x}'
LINES = [
    HTTP.format(n=1, fe="web~", s="srv1", st=200, c="{a.example.com|B.example.com} ", u="/x/12?q=1", x=""),
    HTTP.format(n=2, fe="web", s="<NOSRV>", st=503, c="{-|b.example.com} ", u="http://C.example.com/y", x=""),
    HTTP.format(n=3, fe="other", s="srv2", st=301, c="", u="/", x=" tail d.example.com"),
    "10.0.0.4:4000 [01/Jan/2024:00:00:04.000] tcp be_db/db1 1/0/5007 212 -- 1/1/1/1/0 0/0",
    "no traffic at all",
]
SLOTS = {"web": 1, "other": -1}


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("Jan  1 00:00:00 lb1 haproxy[7]: " + x,) for x in LINES] + [(LINES[0],)], "value string")


@pytest.mark.parametrize("slots", [None, SLOTS])
def test_each_field_alone_is_that_of_the_whole_record(lines, slots):
    whole = {r.value: r.access for r in parse_access(lines, host_slots=slots).collect()}
    assert sum(a is None for a in whole.values()) == 1
    for fields in [[c] for c in ACCESS] + [["at_ms", "client", "path", "host", "tls"], ACCESS[::-1]]:
        for r in parse_access(lines, host_slots=slots, fields=fields).collect():
            want = whole[r.value]
            assert (r.access is None) == (want is None)
            assert want is None or r.access.asDict() == {c: want[c] for c in fields}


def test_several_records_of_one_parse(lines):
    both = records(records(parse_raw(lines), "known", SLOTS), "guessed")
    want = parse_access(parse_access(lines, host_slots=SLOTS).withColumnRenamed("access", "known")).withColumnRenamed("access", "guessed")
    names = ["value", "known", "guessed"]
    assert sorted(map(str, both.select(names).collect())) == sorted(map(str, want.select(names).collect()))


def test_stream_of_times_makes_no_other_fields(lines):
    times = plan(parse_access(lines, fields=["at_ms"]).select(F.col("access.at_ms")))
    assert "map_from_entries" not in times and "captures" not in times and "haproxy[" in times


def test_hosts_in_two_ways_take_one_parse(spark, sf_dir):
    regex = compile_format(DEFAULT_FORMATS[0]).regex
    assert plan(log_queries.p9(spark, sf_dir)).count(regex) == 1

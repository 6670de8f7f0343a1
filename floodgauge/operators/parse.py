"""Log lines to typed request records and event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.functions import fields as X
from floodgauge.functions.logformat import SEPARATOR, FormatSpec, format_specs

ACCESS = ["at_ms", "client", "frontend", "backend", "server", "ta", "status", "term", "method", "path", "raw_path", "host", "tls", "kind"]
#: Raw fields behind those of a record, where they are not the one of the same name.
_SOURCES = {
    "at_ms": ["at"], "path": ["uri"], "raw_path": ["uri"], "host": ["uri", "host", "sni", "captures", "slots", "trailing", "frontend"],
    "tls": ["frontend"], "kind": ["tcp", "server", "status", "backend", "frontend"],
}


def _record(spec: FormatSpec, groups: Column, ingest: Column, needed: set[str]) -> Column:
    """The needed raw fields of one format as a struct of the same shape for every format."""

    def text(role: str) -> Column:
        at = spec.group(role)
        return F.lit("") if at is None else groups[at]

    def number(role: str) -> Column:
        return F.coalesce(F.regexp_replace(text(role), r"^\+", "").try_cast("int"), F.lit(0))

    dates = [X.log_time(groups[i], r) for i, r in reversed(list(enumerate(spec.roles))) if r.startswith("date_")]
    slots = [F.struct(F.lit(int(r[4:])).alias("k"), X.unquote(groups[i]).alias("v")) for i, r in enumerate(spec.roles) if r.startswith("slot")]
    request = F.split(X.unquote(text("request")), " ", 3)
    whole = F.size(request) >= 2
    has_request = spec.group("request") is not None
    method = F.when(whole, request[0]).otherwise("") if has_request else X.unquote(text("method"))
    path = F.when(~whole, X.unquote(text("request"))).otherwise("") if has_request else X.unquote(text("path"))
    uri = F.when(whole, F.get(request, F.lit(1))).otherwise("") if has_request else X.unquote(text("uri"))
    fields = {
        "at": F.coalesce(*dates, ingest),
        "client": text("client"),
        "frontend": text("frontend"),
        "backend": text("backend"),
        "server": text("server"),
        "ta": number("ta") if spec.group("ta") is not None else number("tt"),
        "status": number("status"),
        "term": text("term"),
        "method": method,
        "uri": F.when(uri != "", uri).otherwise(path),
        "host": X.unquote(text("host")),
        "sni": X.unquote(text("sni")),
        "captures": text("captures"),
        "slots": F.map_from_entries(F.array(*slots)) if slots else F.create_map().cast("map<int,string>"),
        "trailing": text("trailing"),
        "tcp": F.lit(all(spec.group(r) is None for r in ("status", "request", "path", "uri"))),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items() if k in needed])


def _host(r: Column, slot: Column) -> Column:
    by_slot = F.coalesce(r["slots"][slot], F.lit(""))
    captured = F.split(F.regexp_replace(r["captures"], r"^[{}]+|[{}]+$", ""), r"\|", -1)
    return (
        F.when(F.contains(r["uri"], F.lit("://")), X.uri_host(r["uri"]))
        .when((r["host"] != "") & (r["host"] != "-"), F.lower(r["host"]))
        .when((slot >= 0) & (by_slot != ""), F.lower(by_slot))
        .when((slot >= 0) & (r["captures"] != ""), F.coalesce(F.lower(F.trim(F.get(captured, F.greatest(slot, F.lit(0))))), F.lit("")))
        .when((r["sni"] != "") & (r["sni"] != "-"), F.lower(r["sni"]))
        .when(slot == -2, X.guessed_host(r["captures"], r["trailing"]))
        .otherwise(X.guessed_host(F.lit(""), r["trailing"]))
    )


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value``, which is computed below a one-row generator. What uses it stays above, and
    is not written out in terms of the expression, which would then run once per use; the expression
    itself is in a projection of its own, as a generator's input is not compiled."""
    return df.withColumn(name, value).withColumn(name, F.explode(F.array(name)))


def parse_raw(lines: DataFrame, formats: list[str] | None = None, ingest: Column | None = None, column: str = "value", fields: list[str] | None = None) -> DataFrame:
    """``lines`` with a column ``_raw``: what a format holds for the ``fields`` of a record (null where no
    format matches). From it records() makes a record, or several that differ in their host slots."""
    ingest = F.lit(None).cast("timestamp") if ingest is None else ingest
    needed = {raw for name in (ACCESS if fields is None else fields) for raw in _SOURCES.get(name, [name])}
    out = lines.withColumn("_message", X.strip_syslog(F.col(column)))
    taken: Column = F.lit(False)
    records = []
    for i, spec in enumerate(format_specs(formats)):
        groups = F.split(F.regexp_replace("_message", spec.regex, spec.template), SEPARATOR, -1)
        out = once(out, f"_groups{i}", F.when(~taken, groups))
        hit = F.coalesce(F.size(f"_groups{i}") == len(spec.roles), F.lit(False))
        # A record for each format in a projection of its own: one for all would be too large a method for the JVM to compile.
        out = once(out, f"_record{i}", F.when(hit, _record(spec, F.col(f"_groups{i}"), ingest, needed)))
        records.append(F.col(f"_record{i}"))
        taken = taken | hit
    return once(out, "_raw", F.coalesce(*records)).drop("_message", *[f"_{name}{i}" for name in ("groups", "record") for i in range(len(records))])


def records(raw: DataFrame, name: str = "access", host_slots: dict[str, int] | None = None, fields: list[str] | None = None) -> DataFrame:
    """``raw`` of parse_raw() with a record (or null) of the ``fields`` under a name."""
    r = F.col("_raw")

    def frontend() -> Column:
        return F.regexp_replace(r["frontend"], "~$", "")

    def host() -> Column:
        slots = F.create_map(*[F.lit(x) for pair in host_slots.items() for x in pair])[frontend()] if host_slots else F.lit(None)
        return _host(r, F.coalesce(slots, F.lit(-2)).cast("int"))

    def path(of) -> Column:
        return F.when(r["uri"] == "", X.NO_PATH).otherwise(of(r["uri"]))

    made = {
        "at_ms": lambda: F.unix_millis(r["at"]), "frontend": frontend, "path": lambda: path(X.norm_path), "raw_path": lambda: path(X.raw_path),
        "host": host, "tls": lambda: r["frontend"].endswith("~"),
        "kind": lambda: F.when(r["tcp"], "tcp").otherwise(X.kind(r["server"], r["status"], r["backend"], frontend())),
    }
    record = F.struct(*[made.get(c, lambda c=c: r[c])().alias(c) for c in (ACCESS if fields is None else fields)])
    return once(raw, name, F.when(r.isNotNull(), record))


def parse_access(lines: DataFrame, formats: list[str] | None = None, host_slots: dict[str, int] | None = None, ingest: Column | None = None, column: str = "value", fields: list[str] | None = None) -> DataFrame:
    """``lines`` with a column ``access`` (a record, or null where no format matches).

    Formats are tried in order, the configured ones before the built-in ones; each is one pass of a
    regular expression over lines that no earlier format took. ``host_slots`` names the captured
    header that holds the host for each frontend (-1: none; absent: guess). ``ingest`` stands in for
    a missing date; no wall clock is read. Of a record only the ``fields`` are made where they are given,
    as the engine does not leave out those that nobody reads.
    """
    return records(parse_raw(lines, formats, ingest, column, fields), "access", host_slots, fields).drop("_raw")


def render_access(access: DataFrame) -> DataFrame:
    """Records as lines of the built-in http format, the inverse of parse_access()."""
    at = F.date_format(F.timestamp_millis("at_ms"), "dd/MMM/yyyy:HH:mm:ss.SSS")
    frontend = F.concat("frontend", F.when(F.col("tls"), "~").otherwise(""))
    form = 'Jan  1 00:00:00 lb1 haproxy[77]: %s:40000 [%s] %s %s/%s 0/0/1/2/%s %s 512 - - %s 1/1/0/0/0 0/0 {%s} "%s %s HTTP/1.1"'
    line = F.format_string(form, "client", at, frontend, "backend", "server", "ta", "status", "term", "host", "method", "raw_path")
    return once(access, "value", line).select("value")


# Event messages of the proxy.
_SERVER = r"Server ([^/\s]+)/(\S+) (is DOWN|is UP|is going DOWN for maintenance|was DOWN and now enters maintenance|enters drain state|is UP/READY)"
_REASON = r'reason: (.+?)(?:, info: "[^"]*")?(?:, check duration: [^.]*)?\.'
_LEFT = r"(\d+) active and (\d+) backup servers? (?:left|online)"
_EMPTY = r"backend (\S+) has no server available"
_STARTED, _STOPPED = r"Proxy (\S+) started\.", r"(?:Stopping proxy|Proxy) (\S+) (?:in \d+ ms|stopped)"


def parse_events(lines: DataFrame, now: Column, column: str = "value") -> DataFrame:
    """Event rows of ``lines``: at_ms (null without a readable stamp), type, backend, server, reason,
    remaining (servers left, -1 unknown)."""
    out = lines.select(F.col(column).alias("_line"), X.strip_syslog(F.col(column)).alias("_message"))
    message = F.col("_message")
    out = out.withColumn("_server", F.split(F.regexp_replace(message, f"^.*?{_SERVER}.*$", f"$1{SEPARATOR}$2{SEPARATOR}$3"), SEPARATOR))
    server = F.size("_server") == 3
    what = F.get("_server", F.lit(2))
    type_ = (
        F.when(server, F.when(what == "is DOWN", "down").when(what.isin("is UP", "is UP/READY"), "up").when(what == "enters drain state", "drain").otherwise("maint"))
        .when(message.rlike(_EMPTY), "noserver").when(message.rlike(_STARTED), "start").when(message.rlike(_STOPPED), "stop")
    )
    out = out.withColumn("type", type_).where("type IS NOT NULL")
    return out.select(
        F.unix_millis(X.syslog_time(F.col("_line"), now)).alias("at_ms"),
        "type",
        F.when(server, F.get("_server", F.lit(0))).when(F.col("type") == "noserver", F.regexp_extract(message, _EMPTY, 1)).otherwise("").alias("backend"),
        F.when(server, F.get("_server", F.lit(1))).otherwise("").alias("server"),
        F.when(server, F.regexp_extract(message, _REASON, 1)).otherwise("").alias("reason"),
        F.when(server, F.coalesce(F.regexp_extract(message, _LEFT, 1).try_cast("int"), F.lit(-1))).otherwise(-1).alias("remaining"),
    )


def is_event(message: Column) -> Column:
    """Whether parse_events() takes the line, by its text behind the syslog prefix."""
    return message.rlike("|".join(f"(?:{p})" for p in (_SERVER, _EMPTY, _STARTED, _STOPPED)))


def unplaced(parsed: DataFrame, from_ms: int, to_ms: int, now: Column, column: str = "value") -> DataFrame:
    """One row on what a review of [from_ms, to_ms] could not place, from lines with an ``access`` column:
    unparsed (traffic lines without a record and no event, stamped in the range or not readably),
    unparsed_without_time, events, events_without_time, and events_unknown (events, but none with a time)."""
    message, none = X.strip_syslog(F.col(column)), F.col("access").isNull()
    at = F.unix_millis(X.syslog_time(F.col(column), now))
    rows = parsed.select(at.alias("at"), (none & is_event(message)).alias("event"), (none & ~is_event(message) & X.traffic_like(message)).alias("odd"))
    timeless = F.col("at").isNull()
    got = rows.agg(
        F.count_if(F.col("odd") & (timeless | F.col("at").between(from_ms, to_ms))).alias("unparsed"), F.count_if(F.col("odd") & timeless).alias("unparsed_without_time"),
        F.count_if("event").alias("events"), F.count_if(F.col("event") & timeless).alias("events_without_time"),
    )
    return got.withColumn("events_unknown", (F.col("events") > 0) & (F.col("events") == F.col("events_without_time")))


def render_events(events: DataFrame) -> DataFrame:
    """Events as syslog lines without a year, the inverse of parse_events()."""
    at = F.timestamp_millis("at_ms")
    stamp = F.concat(F.date_format(at, "MMM "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "), F.date_format(at, " HH:mm:ss"))
    name = F.concat_ws("/", "backend", "server")
    left = F.concat(F.col("remaining").cast("string"), F.lit(" active and 0 backup servers "))
    text = (
        F.when(F.col("type") == "down", F.concat(F.lit("Server "), name, F.lit(" is DOWN, reason: "), "reason", F.lit(', info: "refused", check duration: 0ms. '), left, F.lit("left.")))
        .when(F.col("type") == "up", F.concat(F.lit("Server "), name, F.lit(" is UP. "), left, F.lit("online.")))
        .when(F.col("type") == "maint", F.concat(F.lit("Server "), name, F.lit(" is going DOWN for maintenance.")))
        .when(F.col("type") == "noserver", F.concat(F.lit("backend "), "backend", F.lit(" has no server available!")))
        .otherwise(F.lit("Proxy http_front started."))
    )
    return events.select(F.concat(stamp, F.lit(" lb1 haproxy[77]: "), text).alias("value"))


def parse_quality(parsed: DataFrame, column: str = "value") -> DataFrame:
    """One row about lines with an ``access`` column: lines, traffic, parsed, tcp, with_host, unparsed,
    usable (at least 0.8 of http traffic parses), note (at least 20 and 5 % do not)."""
    a = F.col("access")
    tcp = a["kind"] == "tcp"
    odd = a.isNull() & X.traffic_like(X.strip_syslog(F.col(column)))
    got = parsed.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(a.isNotNull() | odd).alias("traffic"), F.count_if(a.isNotNull() & ~tcp).alias("parsed"),
        F.count_if(tcp).alias("tcp"), F.count_if(a.isNotNull() & ~tcp & (a["host"] != "")).alias("with_host"), F.count_if(odd).alias("unparsed"),
    )
    http = F.col("traffic") - F.col("tcp")
    return got.withColumn("usable", F.coalesce(F.try_divide("parsed", http) >= 0.8, F.lit(False))).withColumn(
        "note", (F.col("unparsed") >= 20) & (F.col("unparsed") >= 0.05 * http)
    )

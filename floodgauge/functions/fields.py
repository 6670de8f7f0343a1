"""Column functions on single request, event and counter fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SERVER = "<NOSRV>"
ID_MARK, CUT_MARK, NO_PATH = "{id}", "…", "(no path)"
# What counts as a host name or address.
HOST_NAME = r"(?i)^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,63}(:\d{1,5})?$"
HOST_IP = r"^\d{1,3}(\.\d{1,3}){3}(:\d{1,5})?$"
# Upper bounds of the duration buckets in milliseconds.
DURATION_BOUNDS = [1, 2, 3, 5, 7, 10, 15, 20, 30, 50, 70, 100, 150, 200, 300, 500, 700, 1000, 1500, 2000, 3000, 5000, 7000, 10000, 15000, 20000, 30000, 60000, 120000]
CLASSES = ("2xx", "3xx", "4xx", "5xx", "none")

# Causes and phases of a session end, and the pairs with an explanation of their own.
TERM_WHO = {
    "C": "client closed the connection", "c": "client-side timeout", "S": "server closed or refused the connection", "s": "server-side timeout",
    "P": "the proxy stopped the request", "L": "the proxy answered by itself", "R": "the proxy ran out of a resource", "I": "internal proxy error",
    "D": "connection killed because the server went down", "U": "connection killed because a backup server took over", "K": "connection killed by an administrator",
}
TERM_WHEN = {"R": "while waiting for the request", "Q": "while queued", "C": "while connecting to the server", "H": "while waiting for response headers", "D": "during data transfer", "L": "while sending the last data", "T": "while tarpitted"}
TERM_SPECIAL = {
    "SC": "could not connect to the server", "sC": "timeout while connecting to the server", "SH": "server closed before answering or answered badly (often 502)",
    "sH": "server did not answer in time (often 504)", "SD": "server broke off during its answer", "sD": "timeout during the server's answer",
    "SQ": "server refused while the request was queued", "sQ": "queued too long, no server became free (often 503)", "CD": "client left during the answer",
    "cD": "timeout during transfer on the client side", "CR": "client left before its request was complete", "cR": "client did not send its request in time (408)",
    "CH": "client left while waiting for the answer", "CC": "client left while the server was being connected", "CQ": "client left while its request was queued",
    "PR": "a proxy rule blocked the request", "PH": "the proxy blocked the server's answer", "LR": "the proxy answered by itself (such as a redirect)", "LH": "the proxy answered by itself",
    "DD": "open connection cut because the server went down", "DC": "connection cut because the server went down",
}
# Health check results.
CHECK_RESULTS = {
    "UNK": "unknown", "INI": "initializing", "SOCKERR": "socket error on the proxy", "L4OK": "port open", "L4TOUT": "connection timeout", "L4CON": "connection refused",
    "L6OK": "TLS connection works", "L6TOUT": "TLS handshake timeout", "L6RSP": "TLS handshake failed", "L7OK": "HTTP check passed", "L7OKC": "HTTP check passed conditionally",
    "L7TOUT": "HTTP check timeout", "L7RSP": "invalid response", "L7STS": "unexpected HTTP status", "PROCERR": "external check failed", "PROCTOUT": "external check timeout", "PROCOK": "external check passed",
}


def lookup(key: Column, values: dict[str, str]) -> Column:
    """A constant dictionary as a map literal: constant folded, and null where the key is absent."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def strip_syslog(line: Column) -> Column:
    """The message after the first "]: " where the program before it is the proxy."""
    at = F.instr(line, "]: ")
    return F.when((at > 0) & F.contains(F.substring_index(line, "]: ", 1), F.lit("haproxy[")), line.substr(at + 3, F.length(line))).otherwise(line)


def unquote(v: Column) -> Column:
    return F.when(v.rlike(r'(?s)^".*"$') & (F.length(v) >= 2), v.substr(F.lit(2), F.length(v) - 2)).when(v == "-", "").otherwise(v)


def _without_query(uri: Column) -> Column:
    """Most paths are plain already, which one look tells."""
    return F.when(uri.rlike(r"[?#]|://"), _query_cut(uri)).otherwise(uri)


def _query_cut(uri: Column) -> Column:
    cut = F.regexp_replace(uri, r"(?s)[?#].*$", "")
    rest = F.regexp_replace(cut, r"(?s)^.*?://", "")
    absolute = F.when(F.contains(rest, F.lit("/")), F.regexp_replace(rest, r"(?s)^[^/]*", "")).otherwise("/")
    return F.when(F.contains(cut, F.lit("://")), absolute).otherwise(cut)


def _cut(v: Column, n: int) -> Column:
    return F.when(F.length(v) > n, F.concat(F.substring(v, 1, n), F.lit(CUT_MARK))).otherwise(v)


def is_id(segment: Column) -> Column:
    return segment.rlike(r"^[0-9]+$") | ((F.length(segment) >= 16) & segment.rlike(r"^[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]*$"))


def norm_path(uri: Column) -> Column:
    """The path without query, identifiers folded, at most 120 characters."""
    plain = _without_query(uri)
    folded = F.transform(F.split(plain, "/", -1), lambda s: F.when(is_id(s), ID_MARK).otherwise(s))
    return _cut(F.when(uri.rlike("[0-9]"), F.array_join(folded, "/")).otherwise(plain), 120)  # an identifier has a digit


def raw_path(uri: Column) -> Column:
    """The path without query, identifiers kept, at most 200 characters."""
    return _cut(_without_query(uri), 200)


def uri_host(uri: Column) -> Column:
    """Host of an absolute URI ("://" anywhere counts), lower-cased; empty if none."""
    return F.when(F.contains(uri, F.lit("://")), F.lower(F.regexp_extract(uri, r"(?s)://([^/?]*)", 1))).otherwise("")


def guessed_host(captures: Column, trailing: Column) -> Column:
    """The first captured value that looks like a host name, else a sole captured address, else the
    first host-like token of trailing fields that are not URLs; empty if none. A single captured value
    and no trailing fields, the usual case, take no arrays."""
    sole = F.trim(captures.substr(F.lit(2), F.length(captures) - 2))
    one = F.when(sole.rlike(HOST_NAME), F.lower(sole)).when(sole.rlike(HOST_IP), sole).otherwise("")
    short = F.when(captures.rlike(r"^\{[^{}|]*\}$"), one).when(captures.isin("", "{}"), "")
    return F.when((trailing == "") & short.isNotNull(), short).otherwise(_searched_host(captures, trailing))


def _searched_host(captures: Column, trailing: Column) -> Column:
    blocks = F.transform(F.split(captures, r"\} "), lambda b: F.regexp_replace(F.trim(b), r"^[{}]+|[{}]+$", ""))
    values = F.transform(F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), lambda b: F.split(b, r"\|", -1))), lambda v: F.trim(v))
    named = F.get(F.filter(values, lambda v: v.rlike(HOST_NAME)), F.lit(0))
    sole = F.when((F.size(values) == 1) & F.get(values, F.lit(0)).rlike(HOST_IP), F.get(values, F.lit(0)))
    fields = F.filter(F.split(trailing, r"\s+"), lambda f: ~F.contains(f, F.lit("://")))
    tokens = F.flatten(F.transform(fields, lambda f: F.split(f, r'[/",{}|]')))
    after = F.get(F.filter(tokens, lambda t: t.rlike(HOST_NAME)), F.lit(0))
    return F.coalesce(F.lower(named), sole, F.lower(after), F.lit(""))


def origin(host: Column, tls: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.when(tls, "https://").otherwise("http://"), host))


def kind(server: Column, status: Column, backend: Column, frontend: Column) -> Column:
    return (
        F.when(server != NO_SERVER, "served").when(status == 403, "denied").when((status == 503) & (backend == frontend), "nomatch")
        .when(status == 503, "noserver").when(status.between(300, 399), "redirect").otherwise("proxy")
    )


def class5(status: Column) -> Column:
    """0 to 3 for 2xx to 5xx, 4 for anything else."""
    return F.when(status.between(200, 599), F.floor(status / 100).cast("int") - 2).otherwise(4)


def is_blocked(kind_: Column) -> Column:
    return kind_.isin("denied", "nomatch", "noserver")


def frontend_answered(server: Column, backend: Column, frontend: Column) -> Column:
    return (server == NO_SERVER) & (backend == frontend)


def term_code(term: Column) -> Column:
    return F.substring(term, 1, 2)


def explain_term(code: Column) -> Column:
    who = F.coalesce(lookup(F.substring(code, 1, 1), TERM_WHO), F.concat(F.lit("unknown cause ("), F.substring(code, 1, 1), F.lit(")")))
    when = lookup(F.substring(code, 2, 1), TERM_WHEN)
    return F.coalesce(lookup(code, TERM_SPECIAL), F.when(when.isNull(), who).otherwise(F.concat(who, F.lit(", "), when)))


def term_side(code: Column) -> Column:
    first = F.substring(code, 1, 1)
    return F.when(first.isin(*"SsRIDU"), "server").when(first.isin("C", "c"), "client").otherwise("rule")


def server_state(status: Column) -> Column:
    u = F.upper(F.trim(status))
    slash = F.contains(u, F.lit("/"))
    return (
        F.when(status.isNull() | (status == ""), "none").when(u.startswith("MAINT"), "maint").when(u.startswith("DRAIN") | (u == "NOLB"), "drain")
        .when(u.startswith("DOWN"), F.when(slash, "recovering").otherwise("down")).when(u.startswith("UP"), F.when(slash, "failing").otherwise("up"))
        .when(u == "OPEN", "up").when(u == "FULL", "full").when(u == "STOP", "down").when(u == "NO CHECK", "nocheck").otherwise("none")
    )


REACHABLE = ("up", "failing", "nocheck", "drain")


def explain_check(status: Column, code: Column) -> Column:
    plain = F.trim(F.regexp_replace(status, r"^\*\s*", ""))
    unexpected = F.concat(F.lit("server answered HTTP "), F.coalesce(F.nullif(code, F.lit("")), F.lit("?")))
    return F.when(status.isNull() | (status == ""), None).when(plain == "L7STS", unexpected).otherwise(F.coalesce(lookup(plain, CHECK_RESULTS), plain))


def number(v: Column) -> Column:
    """A counter as double; 0 where it is empty or not a number."""
    return F.coalesce(v.try_cast("double"), F.lit(0.0))


def row_type(type_: Column, svname: Column) -> Column:
    return F.coalesce(type_.try_cast("int"), F.when(svname == "FRONTEND", 0).when(svname == "BACKEND", 1).otherwise(2))


def duration_bucket(ms: Column) -> Column:
    """Number of bounds not above ``ms``; null for negative durations."""
    return F.when(ms >= 0, F.size(F.filter(F.array(*map(F.lit, DURATION_BOUNDS)), lambda b: b <= ms)))


def redact(message: Column) -> Column:
    """Query strings hidden, at most 400 characters."""
    return _cut(F.regexp_replace(message, r'\?[^ "]*', "?…"), 400)


# Fixed value: what an unparsed line of traffic looks like.
TRAFFIC_LIKE = r"^\S+:\d+ |^\d{1,3}(\.\d{1,3}){3}[ :,]|^[\[{]|\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}"


def traffic_like(message: Column) -> Column:
    return message.rlike(TRAFFIC_LIKE)


def log_time(v: Column, role: str) -> Column:
    """Time of a log field by its encoding; null where it does not parse."""
    if role == "date_ms":
        return F.try_to_timestamp(v, F.lit("dd/MMM/yyyy:HH:mm:ss.SSS"))
    if role == "date_tz":
        return F.try_to_timestamp(v, F.lit("dd/MMM/yyyy:HH:mm:ss xx"))
    return F.timestamp_seconds((F.conv(v, 16, 10) if role == "date_hex" else v).try_cast("bigint"))


def syslog_time(line: Column, now: Column) -> Column:
    """Time of a syslog stamp: ISO 8601 with an offset, or month, day and time without a year, which
    is the year of ``now``, less one where that lies over 48 hours ahead."""
    first = F.substring_index(line, " ", 1)
    offset = F.regexp_replace(first, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(first.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), offset.try_cast("timestamp"))
    short = F.regexp_replace(F.substring(line, 1, 15), " +", " ")
    dated = F.try_to_timestamp(F.concat_ws(" ", F.year(now).cast("string"), short), F.lit("yyyy MMM d HH:mm:ss"))
    ahead = dated > now + F.expr("INTERVAL 48 HOURS")
    year_less = F.when(ahead, dated - F.expr("INTERVAL 1 YEAR")).otherwise(dated)
    is_iso = (F.length(line) >= 19) & (line.substr(5, 1) == "-") & (line.substr(11, 1) == "T")
    return F.when(is_iso, iso).when((F.length(line) >= 15) & (line.substr(4, 1) == " ") & (line.substr(10, 1) == ":"), year_less)

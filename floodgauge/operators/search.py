"""Search over request records and over raw lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.operators.cidr import ip_in_cidrs

METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "CONNECT", "TRACE")
MAX_RANGE_MS = 7 * 86_400_000


@dataclass(frozen=True)
class SearchQuery:
    path: str = ""
    ip: str = ""
    status: str = ""
    method: str = ""
    backend: str = ""
    exact: bool = False
    since_ms: int | None = None
    until_ms: int | None = None


def incident_range(from_ms: int, to_ms: int, now_ms: int) -> tuple[int, int]:
    """A valid range: not empty, at most seven days, begun by now, and ending by now."""
    if to_ms <= from_ms:
        raise ValueError("the end must lie after the start")
    if to_ms - from_ms > MAX_RANGE_MS:
        raise ValueError("at most seven days")
    if from_ms > now_ms:
        raise ValueError("the start lies in the future")
    return from_ms, min(to_ms, now_ms)


def build_query(now_ms: int, hours: int | None = None, from_ms: int | None = None, to_ms: int | None = None, **fields) -> SearchQuery:
    """A validated query; ``hours`` sets the start where no range is given."""
    q = SearchQuery(**{k: v.strip() if isinstance(v, str) else v for k, v in fields.items()})
    if from_ms is not None or to_ms is not None:
        if from_ms is None or to_ms is None:
            raise ValueError("a range needs a start and an end")
        since, until = incident_range(from_ms, to_ms, now_ms)
        q = replace(q, since_ms=since, until_ms=until)
    if not (q.path or q.ip or q.status or q.method or q.backend) and q.until_ms is None:
        raise ValueError("nothing to search for")
    q = replace(q, method=q.method.upper())
    if q.method and q.method not in METHODS:
        raise ValueError(f"unknown method {q.method}")
    if len(q.path) > 200 or len(q.ip) > 60 or len(q.backend) > 80:
        raise ValueError("the text is too long")
    if q.status and not re.fullmatch(r"[1-5](\d\d|xx)", q.status):
        raise ValueError("a status is like 200 or 5xx")
    if hours is not None and not 0 <= hours <= 24 * 365:
        raise ValueError("hours out of range")
    if hours and q.since_ms is None:
        q = replace(q, since_ms=now_ms - hours * 3_600_000)
    return q


def search_filter(access: DataFrame, q: SearchQuery) -> DataFrame:
    out = access
    if q.path and q.exact:
        out = out.where((F.col("path") == q.path) | (F.col("raw_path") == q.path))
    elif q.path:
        low = F.lit(q.path.lower())
        out = out.where(F.contains(F.lower("raw_path"), low) | F.contains(F.lower("path"), low))
    if q.ip:
        out = out.where(F.col("client").startswith(q.ip))
    if q.method:
        out = out.where(F.upper("method") == q.method.upper())
    if q.backend:
        out = out.where(F.contains(F.lower("backend"), F.lit(q.backend.lower())))
    if q.status.endswith("xx"):
        out = out.where(F.col("status").cast("string").startswith(q.status[0]))
    elif q.status:
        out = out.where(F.col("status") == int(q.status))
    if q.since_ms is not None:
        out = out.where(F.col("at_ms") >= q.since_ms)
    if q.until_ms is not None:
        out = out.where(F.col("at_ms") <= q.until_ms)
    return out


def prefilter_lines(lines: DataFrame, q: SearchQuery, column: str = "value") -> DataFrame:
    """Lines that can match: cheap necessary conditions on the raw text, before it is parsed."""
    line, low = F.col(column), F.lower(column)
    texts = [] if q.path.startswith("(") else re.split(r"\{id\}|…", q.path.lower())
    for text in [*texts, q.ip.lower(), q.backend.lower()]:
        if text:
            lines = lines.where(F.contains(low, F.lit(text)))
    if q.method:
        lines = lines.where(line.rlike(f"(?i)(?<![a-z]){q.method}(?![a-z])"))
    if q.status:
        lines = lines.where(line.rlike(f"(?<![0-9]){q.status.replace('xx', '[0-9]{2}')}(?![0-9])"))
    return lines


def search_totals(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("matches"), F.min("at_ms").alias("first_at"), F.max("at_ms").alias("last_at"))


def scanned(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines and bytes read, line ends included."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.octet_length(column) + 1), F.lit(0)).alias("bytes"))


def search_codes(hits: DataFrame) -> DataFrame:
    return hits.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def search_top_ips(hits: DataFrame, cidrs: DataFrame, n: int = 20) -> DataFrame:
    top = hits.groupBy("client").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "client").limit(n)
    return ip_in_cidrs(top, cidrs)


def search_top_paths(hits: DataFrame, n: int = 20) -> DataFrame:
    key = F.concat_ws(" ", "method", "path")
    return hits.groupBy(key.alias("request")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "request").limit(n)


def search_hits(hits: DataFrame, n: int = 200) -> DataFrame:
    """The newest hits; ties stand in the order of all columns."""
    rest = sorted(c for c in hits.columns if c != "at_ms")
    return hits.orderBy(F.desc("at_ms"), *rest).limit(n)

"""The counts of an incident review from one pass over the records of its range.

The records are summed once to a grain of their small dimensions (slice, backend, server, frontend, answer,
reason and duration bucket), which does not grow with traffic, and GROUPING SETS over that grain give the
counts of every section; durations stay histograms, which add up. The result is a short table, one row per
key of each section, that the sections below are read from. Paths, clients and hosts have as many keys as
the traffic likes and keep aggregates of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.functions import fields as X
from floodgauge.operators import incident as inc
from floodgauge.sources.scratch import materialize

_DIMENSIONS = ["bin", "status", "backend", "server", "frontend", "fe", "code"]
_SETS = {
    "totals": [], "codes": ["status"], "series": ["bin"], "series_codes": ["bin", "status"], "backends": ["backend", "fe"],
    "servers": ["backend", "server", "fe"], "frontends": ["frontend", "fe"], "terms": ["code", "backend", "fe"],
}
_KINDS = ("served", "denied", "nomatch", "noserver", "redirect", "proxy", "tcp")
_CLASSES = dict(zip(inc.CLASS_COLUMNS, range(5)))


def _grouping_id(columns: list[str]) -> int:
    return sum(1 << (len(_DIMENSIONS) - 1 - i) for i, c in enumerate(_DIMENSIONS) if c not in columns)


def _grain(df: DataFrame, bin_: Column, keys: list[str]) -> DataFrame:
    ta = F.when(F.col("ta") >= 0, F.col("ta"))
    keyed = df.select(
        *keys, bin_.alias("bin"), "status", "backend", "server", "frontend",
        X.frontend_answered(F.col("server"), F.col("backend"), F.col("frontend")).alias("fe"), X.term_code(F.col("term")).alias("code"), "kind",
        (F.col("host") != "").alias("named"), F.when(F.col("ta") >= 0, X.duration_bucket(F.col("ta"))).alias("bucket"), ta.alias("ta"), "at_ms",
    )
    sums = [F.count(F.lit(1)).alias("n"), F.sum("ta").alias("ta"), F.max("ta").alias("max_ta"), F.min("at_ms").alias("first_at"), F.max("at_ms").alias("last_at")]
    # Grouping sets null their columns where they sum over them, so the class has one of its own.
    return keyed.groupBy(*keys, *_DIMENSIONS, "kind", "named", "bucket").agg(*sums).withColumn("class", X.class5(F.col("status")))


def _sum(condition: Column | None = None) -> Column:
    n = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0)).cast("long")


def review_cube(df: DataFrame, from_ms: int, to_ms: int, step: int | None = None) -> DataFrame:
    """The sections' counts, written once: section, its keys, n, classes, kinds, errors, with_host, times
    and histograms. ``df`` holds the records of the range and is read once."""
    step = step or inc.incident_step(from_ms, to_ms)
    last = F.lit(inc.slice_count(from_ms, to_ms, step) - 1).cast("long")
    return _cube(df, F.least(F.expr(f"(at_ms - {from_ms}) DIV {step * 60_000}"), last), [])


def _cube(df: DataFrame, bin_: Column, keys: list[str]) -> DataFrame:
    grain = _grain(df, bin_, keys)
    c, error = F.col("class"), F.col("class") == 3
    counts = {"n": _sum(), **{k: _sum(c == i) for k, i in _CLASSES.items()}, **{k: _sum(F.col("kind") == k) for k in _KINDS}}
    counts |= {"errors": _sum(c >= 3), "with_host": _sum(F.col("named"))}
    counts |= {"first_at": F.min("first_at"), "last_at": F.max("last_at"), "first_5xx": F.min(F.when(error, F.col("first_at"))), "last_5xx": F.max(F.when(error, F.col("last_at")))}
    counts |= {"_hist": F.array(*[_sum(F.col("bucket") == i) for i in range(len(X.DURATION_BOUNDS) + 1)]), "_total": F.coalesce(F.sum("ta"), F.lit(0)), "max_ms": F.coalesce(F.max("max_ta"), F.lit(-1)).cast("long")}
    sets = grain.groupingSets([[F.col(k) for k in (*keys, *own)] for own in _SETS.values()], *map(F.col, (*keys, *_DIMENSIONS)))
    got = sets.agg(F.grouping_id().alias("_set"), *[v.alias(k) for k, v in counts.items()])
    name = F.coalesce(*[F.when(F.col("_set") == _grouping_id(own), k) for k, own in _SETS.items()])
    return materialize(got.withColumn("section", name).drop("_set"), "review")


def planned(ranges: DataFrame) -> DataFrame:
    """incident, from_ms, to_ms with the step in minutes and the number of slices of each range."""
    length = F.col("to_ms") - F.col("from_ms")
    step = F.coalesce(*[F.when(length <= m * 360 * 60_000, m) for m in inc.STEPS], F.lit(inc.STEPS[-1]))
    out = ranges.select("incident", "from_ms", "to_ms", step.alias("step"))
    return out.withColumn("bins", F.greatest(F.lit(1), F.ceil((F.col("to_ms") - F.col("from_ms")) / (F.col("step") * 60_000))).cast("long"))


def in_ranges(df: DataFrame, ranges: DataFrame, cell_ms: int = 3_600_000) -> DataFrame:
    """The records of every range of ``ranges`` (incident, from_ms, to_ms, ...), once for each range they
    fall into, beside its columns. Ranges are cut into cells of time, so that records meet them by an
    equi-join on the cell and then by the exact bounds."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.expr(f"from_ms DIV {cell_ms}"), F.expr(f"to_ms DIV {cell_ms}"))))
    return df.withColumn("_cell", F.expr(f"at_ms DIV {cell_ms}")).join(cells, "_cell").where("at_ms BETWEEN from_ms AND to_ms").drop("_cell")


def incidents_cube(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """review_cube() of many ranges at once, each with slices of its own step: everything is keyed by
    ``incident``. Ranges may overlap; one without records has no rows."""
    rows = in_ranges(df, planned(ranges))
    return _cube(rows, F.least(F.expr("(at_ms - from_ms) DIV (step * 60000)"), F.col("bins") - 1), ["incident"])


def incidents_series(cube: DataFrame, ranges: DataFrame) -> DataFrame:
    """incident, bin, t, n, classes, noserver and durations of every slice, empty ones included."""
    plan = planned(ranges)
    grid = plan.select("incident", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"), "from_ms", "step")
    grid = grid.select("incident", "bin", (F.col("from_ms") + F.col("bin") * F.col("step") * 60_000).alias("t"))
    counts = inc.with_durations(_section(cube, "series").select("incident", "bin", "n", *inc.CLASS_COLUMNS, "noserver", "_hist", "_total", "max_ms"))
    return grid.join(counts, ["incident", "bin"], "left").fillna(-1, ["avg_ms", "p95_ms", "max_ms"]).fillna(0, ["n", *inc.CLASS_COLUMNS, "noserver"])


def incidents_backends(cube: DataFrame) -> DataFrame:
    """The backends of each incident, by server errors."""
    own = _section(cube, "backends").where("NOT fe")
    got = inc.with_durations(own.select("incident", "backend", "n", *inc.CLASS_COLUMNS, *_KINDS[:6], "first_5xx", "last_5xx", "_hist", "_total", "max_ms"))
    return got.orderBy("incident", F.desc("c5"), F.desc("n"), "backend")


def _section(cube: DataFrame, name: str) -> DataFrame:
    return cube.where(F.col("section") == name)


def series(cube: DataFrame, from_ms: int, to_ms: int, step: int | None = None) -> DataFrame:
    """As incident_series()."""
    step = step or inc.incident_step(from_ms, to_ms)
    counts = _section(cube, "series").select("bin", "n", *inc.CLASS_COLUMNS, "noserver", "_hist", "_total", "max_ms")
    codes = _section(cube, "series_codes").groupBy("bin").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("codes"))
    return inc.on_grid(counts, codes, from_ms, to_ms, step)


def totals(cube: DataFrame) -> DataFrame:
    """As incident_totals()."""
    one = cube.sparkSession.range(1).select(F.lit("totals").alias("section"))
    got = one.join(_section(cube, "totals").drop(*_DIMENSIONS, "errors", "first_5xx", "last_5xx"), "section", "left").drop("section")
    zeros = [c for c in got.columns if c not in ("first_at", "last_at", "_hist", "max_ms")]
    got = got.fillna(0, zeros).fillna(-1, ["max_ms"]).withColumn("_hist", F.coalesce("_hist", F.array_repeat(F.lit(0).cast("long"), len(X.DURATION_BOUNDS) + 1)))
    return inc.with_durations(got).drop("max_ms")


def codes(cube: DataFrame) -> DataFrame:
    """As incident_codes()."""
    return _section(cube, "codes").select("status", "n").orderBy(F.desc("n"), "status")


def backends(cube: DataFrame) -> DataFrame:
    """As incident_backends()."""
    own = _section(cube, "backends").where("NOT fe")
    got = inc.with_durations(own.select("backend", "n", *inc.CLASS_COLUMNS, *_KINDS[:6], "first_5xx", "last_5xx", "_hist", "_total", "max_ms"))
    return got.orderBy(F.desc("c5"), F.desc("n"), "backend")


def servers(cube: DataFrame) -> DataFrame:
    """As incident_servers()."""
    own = _section(cube, "servers").where((~F.col("fe")) & (F.col("server") != "") & (F.col("server") != X.NO_SERVER))
    return inc.with_durations(own.select("backend", "server", "n", *inc.CLASS_COLUMNS, "_hist", "_total", "max_ms")).orderBy("backend", F.desc("c5"), F.desc("n"), "server")


def frontends(cube: DataFrame) -> DataFrame:
    """As incident_frontends()."""
    return _section(cube, "frontends").where("fe").select("frontend", "n", *inc.CLASS_COLUMNS, *_KINDS[:6]).orderBy(F.desc("n"), "frontend")


def _terms(cube: DataFrame) -> DataFrame:
    return _section(cube, "terms").where("code <> '--'").select("code", "backend", "fe", "n", "errors")


def termination_codes(cube: DataFrame) -> DataFrame:
    """As the function of that name over records."""
    return inc.ranked_terms(_terms(cube))


def backend_terms(cube: DataFrame, n: int = 5) -> DataFrame:
    """As the function of that name over records."""
    return inc.ranked_backend_terms(_terms(cube), n)

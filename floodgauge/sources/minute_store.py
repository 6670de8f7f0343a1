"""A merge-safe store of minute summaries: an additive log of loads, summed when read.

Every load writes its rows under its own number, ``<root>/<table>/load=<number>/date=<day>``: loads may
cover the same minutes in any order, and a load written again replaces itself. Rewriting (to compact, or
to thin by age or budget) sums the live parts of some days into a part of its own and then commits, in
one small file of ``<root>/<table>.merged``, which parts that one stands for. A part counts if no commit
merged it, a rewritten one only if a commit names it; so a run that is lost midway leaves the state as it
was, and days that are not rewritten keep their files. What is merged stays merged: a load repeated after
that is not counted again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.operators import rollup
from floodgauge.sources.scratch import delete, exists

REWRITTEN = "rewritten-"
_COMMIT = "date date, load string, into string, now_minute long"


def _day(minute: int) -> dt.date:
    return dt.datetime.fromtimestamp(minute * 60, dt.UTC).date()


class MinuteStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, tables: dict[str, DataFrame], load: str) -> None:
        """Write a load of some of the five tables; ``load`` names it for good (a batch number, say)."""
        if not load or load.startswith(REWRITTEN) or "/" in load or "=" in load:
            raise ValueError(f"not the name of a load: {load!r}")
        for name, table in tables.items():
            self._write(name, table.select(self._columns(name)), load)

    def read(self, name: str, now_minute: int | None = None, retention: int = 1440) -> DataFrame:
        """The table summed over all loads; with ``now_minute``, the minutes within the retention (older
        days are not read)."""
        rows = self._live(name)
        if now_minute is not None:
            oldest = now_minute - retention + 1
            rows = rows.where((F.col("date") >= F.lit(_day(oldest))) & F.col("minute").between(oldest, now_minute))
        return rollup.merge(rows, name)

    def compact(self, name: str, before: dt.date | None = None) -> list[dt.date]:
        """Make one part of each day that has several (days before ``before`` only); returns the days."""
        loads: dict[dt.date, int] = {}
        for date, _ in self.parts(name):
            loads[date] = loads.get(date, 0) + 1
        dates = sorted(d for d, n in loads.items() if n > 1 and (before is None or d < before))
        self._rewrite(name, dates, lambda rows: rows)
        return dates

    def retain(self, now_minute: int, detail: int = 60, lists: int = 360, retention: int = 1440) -> dict[str, list[dt.date]]:
        """Thin by age (rollup.tiered_retention) and return the days rewritten, by table: those with a
        load since the last run, and those with a minute that has crossed an age since. Counts in totals
        and backends never fall."""
        done = {}
        for name in self.names():
            crossed = self._crossed(name, now_minute, (detail, lists, retention) if name in rollup.LISTS else (retention,))
            dates = sorted({d for d, load in self.parts(name) if not load.startswith(REWRITTEN) or d in crossed})
            self._rewrite(name, dates, lambda rows, n=name: rollup.tiered_retention({n: rows}, now_minute, detail, lists, retention)[n], now_minute)
            done[name] = dates
        return done

    def fit(self, budget: int) -> dict[str, list[dt.date]]:
        """Bring the stored lists to the levels of rollup.budget_levels; days that lose no row stay."""
        tables = {name: self.read(name) for name in self.names()}
        kept, done = rollup.budget_retention(tables, budget), {}
        for name in rollup.LISTS:
            each = [t.groupBy(_date()).agg(F.count(F.lit(1)).alias(n)) for t, n in ((tables[name], "had"), (kept[name], "has"))]
            less = each[0].join(each[1], "date", "left").where(F.col("had") > F.coalesce("has", F.lit(0)))
            done[name] = sorted(r.date for r in less.select("date").collect())  # days of one retention
            levels = rollup.budget_levels(rollup.minute_weights(tables), budget)
            self._rewrite(name, done[name], lambda rows, n=name, by=levels: rollup.at_levels(rows, n, by))
        return done

    def vacuum(self, name: str) -> None:
        """Remove the files of merged parts, once no reader of the state before needs them."""
        if (merged := self._merged(name)) is not None:
            for r in merged.select("date", "load").distinct().collect():
                delete(self.spark, f"{self.root}/{name}/load={r.load}/date={r.date}")

    def names(self) -> list[str]:
        return [n for n in rollup.TABLES if exists(self.spark, f"{self.root}/{n}")]

    def parts(self, name: str) -> list[tuple[dt.date, str]]:
        """(day, load) of the live parts: what a reader's listing of folders holds."""
        return sorted((r.date, r.load) for r in self._live(name).select("date", "load").distinct().collect())

    @staticmethod
    def _columns(name: str) -> list[str]:
        key, counts = rollup.TABLES[name]
        return ["minute", *key, *counts]

    def _write(self, name: str, rows: DataFrame, load: str) -> None:
        rows.withColumn("date", _date()).write.mode("overwrite").partitionBy("date").parquet(f"{self.root}/{name}/load={load}")

    def _merged(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}.merged"
        return self.spark.read.schema(_COMMIT).parquet(path) if exists(self.spark, path) else None

    def _live(self, name: str) -> DataFrame:
        key, counts = rollup.TABLES[name]
        schema = ", ".join(["minute long", *[f"{c} string" for c in key], *[f"{c} long" for c in counts], "load string", "date date"])
        rows, merged = self.spark.read.schema(schema).parquet(f"{self.root}/{name}"), self._merged(name)
        own = rows.where(~F.col("load").startswith(REWRITTEN))
        if merged is None:
            return own
        gone, stand = merged.select("date", "load").distinct(), merged.select("date", F.col("into").alias("load")).distinct()
        rewritten = rows.where(F.col("load").startswith(REWRITTEN)).join(stand, ["date", "load"], "left_semi")
        return own.unionByName(rewritten).join(gone, ["date", "load"], "left_anti")

    def _crossed(self, name: str, now: int, ages: Iterable[int]) -> set[dt.date]:
        """Days with a minute that has reached one of the ages since the last run; without one, all."""
        merged, rows = self._merged(name), self._live(name)
        last = merged.agg(F.max("now_minute")).first()[0] if merged is not None else None
        if last is not None:
            spans = [(last - age + 1, now - age) for age in ages if now > last]
            within = [F.col("date").between(F.lit(_day(a)), F.lit(_day(b))) & F.col("minute").between(a, b) for a, b in spans]
            rows = rows.where(reduce(or_, within, F.lit(False)))
        return {r.date for r in rows.select("date").distinct().collect()}

    def _rewrite(self, name: str, dates: list[dt.date], change: Callable[[DataFrame], DataFrame], now_minute: int | None = None) -> None:
        if not dates:
            return
        parts = [p for p in self.parts(name) if p[0] in set(dates)]
        into = REWRITTEN + uuid.uuid4().hex
        taken = self.spark.createDataFrame(parts, "date date, load string")  # a load that comes meanwhile is not taken
        rows = self._live(name).where(F.col("date").isin(dates)).join(F.broadcast(taken), ["date", "load"], "left_semi")
        self._write(name, change(rollup.merge(rows, name)).select(self._columns(name)), into)
        commit = [(date, load, into, now_minute) for date, load in parts]
        self.spark.createDataFrame(commit, _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}.merged")


def _date():
    return F.to_date(F.timestamp_seconds(F.col("minute") * 60)).alias("date")

"""Structured Streaming forms of the live report, counters and events.

Each result equals the batch form over all input seen, as long as lateness stays within the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from floodgauge.functions import fields as X
from floodgauge.operators.counters import CODES
from floodgauge.operators.rollup import TABLES, with_counts


def stream_minute_rollup(access: DataFrame, name: str, lateness: str = "5 minutes") -> DataFrame:
    """One summary table over tumbling minutes of request start; later records than ``lateness``
    behind the newest are dropped, so set it to the retention to take them all."""
    key, counts = TABLES[name]
    rows = with_counts(access.where("kind <> 'tcp'"))
    rows = rows.where("blocked = 1") if name == "blocked" else rows
    timed = rows.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", lateness)
    got = timed.groupBy(F.window("at", "1 minute").alias("w"), *key).agg(*[F.sum(c).alias(c) for c in counts])
    return got.select((F.unix_millis("w.start") / 60_000).cast("long").alias("minute"), *key, *counts)


def upsert(updates: DataFrame, store: str, checkpoint: str):
    """Start writing updates, each batch under its number; a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def read_upserts(spark: SparkSession, store: str, keys: list[str]) -> DataFrame:
    """The newest row of each key."""
    return _newest(spark.read.parquet(store), keys).drop("batch")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"), F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*", "batch")


def compact(spark: SparkSession, store: str, compacted: str, keys: list[str]) -> None:
    """Write the newest row of each key of a stopped store to another folder, under the number of the
    store's last batch; the stream goes on there with its old checkpoint, and the old store may go."""
    rows = spark.read.parquet(store)
    last = rows.agg(F.max("batch")).first()[0]
    if last is not None:
        _newest(rows, keys).withColumn("batch", F.lit(last)).write.mode("overwrite").parquet(f"{compacted}/batch={last}")


def resume_filter(access: DataFrame, high_water_ms: int | None) -> DataFrame:
    """Records that an earlier run has not counted."""
    return access if high_water_ms is None else access.where(F.col("at_ms") > high_water_ms)


def high_water(access: DataFrame) -> DataFrame:
    return access.agg(F.max("at_ms").alias("high_water_ms"))


_RATES = {"bytes_in": "bin_bytes", "bytes_out": "bout", "econ": "econ", **{c: c for c in CODES}}


def stream_counter_rates(rows: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """Rates per second of each row against its host's snapshot before, skipping restarts.

    ``rows`` are numbered by their host's snapshots (column ``snapshot``, one more each): a row that is
    missing from a snapshot has no rate in the next one. The state is kept by (host, proxy, server), the
    last values of that row, and goes once the newest snapshot of any host is twice ``ttl_ms`` ahead;
    rows more than ``ttl_ms`` behind the newest are dropped, and snapshots at or before the last one seen
    of a row are not compared again."""
    values = list(dict.fromkeys(["req_tot", *_RATES.values()]))
    kept = ["snapshot", "at_ms", "uptime_sec", *values]
    schema = "host string, at_ms long, pxname string, svname string, type int, rps double, " + ", ".join(f"{c} double" for c in _RATES)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = pd.concat(list(frames)).drop_duplicates("snapshot")  # a row's few snapshots of one batch
        if state.exists:
            last = dict(zip(kept, state.get))
            now = pd.concat([pd.DataFrame([{**last, "type": 0}]), now[now["snapshot"] > last["snapshot"]]])
        now = now.sort_values("snapshot", ignore_index=True)
        state.update(tuple(int(x) for x in now[kept].iloc[-1]))
        state.setTimeoutTimestamp(int(now["at_ms"].iloc[-1]) + ttl_ms)
        step = now[kept].astype("int64").diff()
        good = (step["snapshot"] == 1) & (step["at_ms"] > 0) & (step["uptime_sec"] >= 0)
        rates = step.loc[good, values].clip(lower=0).div(step.loc[good, "at_ms"] / 1000, axis=0)
        own = now.loc[good, ["at_ms", "type"]].assign(host=key[0], pxname=key[1], svname=key[2], rps=rates["req_tot"], **{c: rates[v] for c, v in _RATES.items()})
        yield own[["host", "at_ms", "pxname", "svname", "type", "rps", *_RATES]]

    own = rows.select("host", "pxname", "svname", F.col("type").cast("int").alias("type"), *[F.col(c).cast("long").alias(c) for c in kept])
    own = own.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", f"{ttl_ms} milliseconds")
    state_schema = ", ".join(f"{c} long" for c in kept)
    return own.groupBy("host", "pxname", "svname").applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def stream_restart_coalesce(events: DataFrame, gap_ms: int = 60_000) -> DataFrame:
    """Start and stop events, those within ``gap_ms`` of the last kept one of their type (and host,
    where the events have one) left out; the state is one time per host and type."""
    keys = [*(["host"] if "host" in events.columns else []), "type"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, kept = (state.get[0] if state.exists else None), []
        for t in sorted(pd.concat(list(frames))["at_ms"]):
            if last is None or not 0 <= t - last < gap_ms:
                kept.append(int(t))
                last = int(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({**dict(zip(keys, key)), "at_ms": kept})

    own = events.where(F.col("type").isin("start", "stop") & F.col("at_ms").isNotNull()).select(*keys, "at_ms")
    schema = ", ".join(f"{k} string" for k in keys) + ", at_ms long"
    return own.groupBy(*keys).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def stream_parse_quality(parsed: DataFrame, arrival: str, column: str = "value", lateness: str = "5 minutes") -> DataFrame:
    """Parsed and unparsed traffic lines per minute of arrival; lines later than ``lateness`` behind
    the newest are dropped."""
    odd = F.col("access").isNull() & X.traffic_like(X.strip_syslog(F.col(column)))
    timed = parsed.withWatermark(arrival, lateness).groupBy(F.window(arrival, "1 minute").alias("w"))
    got = timed.agg(F.count_if(F.col("access").isNotNull()).alias("parsed"), F.count_if(odd).alias("unparsed"))
    return got.select((F.unix_millis("w.start") / 60_000).cast("long").alias("minute"), "parsed", "unparsed")


def stream_unparsed_samples(parsed: DataFrame, arrival: str, n: int = 3, column: str = "value", lateness: str = "5 minutes") -> DataFrame:
    """minute, samples: the newest ``n`` unparsed traffic lines of each minute of arrival, redacted, newest
    first (of one time the greater text); an updated row whenever a batch has lines of the minute. The
    state of a minute is those few lines, and goes when the watermark has passed the minute."""
    text = X.strip_syslog(F.col(column))
    odd = parsed.where(F.col("access").isNull() & X.traffic_like(text) & F.col(arrival).isNotNull()).withWatermark(arrival, lateness)
    rows = odd.select(F.expr(f"unix_millis({arrival}) DIV 60000").alias("minute"), F.unix_micros(arrival).alias("at"), X.redact(text).alias("sample"), arrival)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = pd.DataFrame({"at": state.get[0], "sample": state.get[1]} if state.exists else {"at": [], "sample": []})
        for frame in frames:
            kept = pd.concat([kept, frame[["at", "sample"]]]).sort_values(["at", "sample"], ascending=False, ignore_index=True).head(n)
        state.update(([int(x) for x in kept["at"]], list(kept["sample"])))
        state.setTimeoutTimestamp(int(max((key[0] + 1) * 60_000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame({"minute": [int(key[0])], "samples": [list(kept["sample"])]})

    return rows.groupBy("minute").applyInPandasWithState(run, "minute long, samples array<string>", "at array<long>, sample array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def unparsed_samples(parsed: DataFrame, n: int = 3, column: str = "value") -> DataFrame:
    """A few unparsed traffic lines of a batch, redacted, for foreachBatch."""
    odd = F.col("access").isNull() & X.traffic_like(X.strip_syslog(F.col(column)))
    return parsed.where(odd).select(X.redact(X.strip_syslog(F.col(column))).alias("sample")).orderBy("sample").limit(n)

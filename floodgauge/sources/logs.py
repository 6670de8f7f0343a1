"""Log lines, counter dumps, minute summaries and report sections, in and out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.sources.minute_store import MinuteStore


def _split(path: str) -> tuple[str, str]:
    folder, _, base = path.rpartition("/")
    return folder or ".", f"{{{base},{base}.*,{base}-*}}"


def read_log_lines(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """Lines of a log and its rotated copies (the name itself, or followed by . or -), plain or gzip:
    value, file, modified. Files not changed after ``since`` are not read."""
    folder, names = _split(path)
    reader = spark.read.option("pathGlobFilter", names)
    if since is not None:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    return reader.text(folder).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def skipped_files(spark: SparkSession, path: str, since: datetime) -> DataFrame:
    """Names of the copies that read_log_lines() leaves out; contents are not read."""
    folder, names = _split(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("modifiedBefore", since.strftime("%Y-%m-%dT%H:%M:%S")).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"))


def stream_log_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the same files. A file is read once, so it has to be complete when it appears under
    its name: write the running log as segments (by time or size) and move each in when it is closed."""
    folder, names = _split(path)
    return spark.readStream.option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_batch).text(folder)


def read_counter_dump(lines: DataFrame) -> DataFrame:
    """Rows of counter dumps in CSV form: dump_id, pxname, svname, fields (map of strings).

    Input: dump_id, value. The header of a dump begins with #; a trailing comma ends every line;
    missing values are empty; rows without both names go. A dump without a header raises."""
    text = F.rtrim("value")
    head = lines.where(text.startswith("#")).groupBy("dump_id").agg(F.min(text).alias("head"))
    names = F.filter(F.split(F.regexp_replace("head", r"^#\s*", ""), ","), lambda c: c != "")
    rows = lines.where(~text.startswith("#") & (text != "")).select("dump_id", F.split(text, ",", -1).alias("v"))
    got = rows.join(head.select("dump_id", names.alias("names")), "dump_id", "left")
    known = F.when(F.col("names").isNull(), F.raise_error(F.lit("a counter dump has no header")).cast("array<string>")).otherwise(F.col("names"))
    values = F.transform(known, lambda c, i: F.coalesce(F.get(F.col("v"), i), F.lit("")))
    fields = got.select("dump_id", F.map_from_arrays(known, values).alias("fields"))
    named = fields.select("dump_id", F.col("fields")["pxname"].alias("pxname"), F.col("fields")["svname"].alias("svname"), "fields")
    return named.where("pxname <> '' AND svname <> ''")


def read_info_dump(lines: DataFrame) -> DataFrame:
    """dump_id, info (map): lines of ``key: value``; of a repeated key the last line counts, by the
    column ``line`` where there is one, else as the lines are read."""
    parts = F.split("value", ":", 2)
    line = F.col("line") if "line" in lines.columns else F.monotonically_increasing_id()
    pairs = lines.select("dump_id", "value", line.alias("line")).where(F.size(parts) == 2)
    last = pairs.groupBy("dump_id", F.trim(parts[0]).alias("k")).agg(F.max_by(F.trim(parts[1]), "line").alias("v"))
    return last.groupBy("dump_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("info"))


def write_minute_summaries(tables: dict[str, DataFrame], path: str, load: str) -> None:
    """One load of summaries, added to what is stored; the same load written again replaces itself."""
    MinuteStore(next(iter(tables.values())).sparkSession, path).add(tables, load)


def read_minute_summaries(spark: SparkSession, path: str, name: str, now_minute: int, retention: int = 1440) -> DataFrame:
    """The minutes within retention, summed over all loads; older dates are not read."""
    return MinuteStore(spark, path).read(name, now_minute, retention)


def write_section(section: DataFrame, path: str, form: str = "parquet", checkpoint: str | None = None):
    """A report section as Parquet or JSON. A stream goes there batch by batch, each under its number,
    so that a repeated batch replaces itself; its query is returned."""
    if not section.isStreaming:
        section.write.mode("overwrite").format(form).save(path)
        return None

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(form).save(f"{path}/batch={number}")

    writer = section.writeStream.option("checkpointLocation", checkpoint or f"{path}-checkpoint")
    return writer.trigger(availableNow=True).foreachBatch(write).start()

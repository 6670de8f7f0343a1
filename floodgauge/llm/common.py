"""Shared helpers of the training-data operators: tables, shared scratch tables, row blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from floodgauge.sources.scratch import materialize, scratch_dir

__all__ = ["blocks", "map_blocks", "materialize", "scratch_dir", "strings", "table"]

#: Bytes of text that one block of rows may hold before it is processed.
BLOCK_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(column: pa.Array) -> list:
    """A list of the values; for strings and bytes by way of numpy, which is several times faster."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def map_blocks(
    df: DataFrame,
    function: Callable[[dict[str, list]], dict[str, list]],
    schema: str,
    text: str | None = "text",
    arrow: tuple[str, ...] = (),
) -> DataFrame:
    """Apply ``function`` to blocks of rows (column name to list, or to Arrow array for the names in
    ``arrow``), bounded in rows and in bytes of the ``text`` column, so that a task's memory does not
    follow its partition."""
    out_schema = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(out_schema)
        for batch in batches:
            for block in blocks(batch, text):
                names = block.schema.names
                got = function({n: block.column(i) if n in arrow else strings(block.column(i)) for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, out_schema)


def blocks(batch: pa.RecordBatch, text: str | None, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    if text is None or batch.num_rows < 2:
        yield batch
        return
    size, start = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            size, start = 0, i
        size += n
    yield batch.slice(start)

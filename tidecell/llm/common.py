"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecell.functions.stage import materialize, shared_dir

__all__ = ["WORD", "materialize", "shared_dir", "slices", "table", "utf8_of", "word_count"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(col) -> F.Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


#: Bytes of text that a task's vectors hold at a time.
SLICE_BYTES = 1 << 20


def utf8_of(column):
    """An Arrow string column as (bytes, starts, ends), nulls empty, without copying the text."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at[:-1], at[1:]


def slices(starts, ends, limit=SLICE_BYTES):
    """Ranges (i, j) of rows that hold about ``limit`` bytes; a longer row stands alone."""
    i, n, size = 0, len(starts), 0
    for j in range(n):
        w = int(ends[j] - starts[j])
        if j > i and size + w > limit:
            yield i, j
            i, size = j, 0
        size += w
    if n > i:
        yield i, n

"""Small helpers that several operators share."""

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The documents table with only the named columns."""
    df = spark.read.parquet(f"{folder}/documents.parquet")
    return df.select(*columns) if columns else df


def crc_rest(column: Column, modulus: int) -> Column:
    """Unsigned CRC-32 of a column written as text, modulo ``modulus``; null counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or as much longer as it must be to be no column's name, case aside."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def groups(spark: SparkSession) -> int:
    """How many groups work is dealt into: the session's own figure for a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow text column without copying; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # a text of over 2 GB in all comes in chunks
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def blocks(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts are about ``limit`` bytes together, one row at least."""
    _, at = texts_of(column)
    start = 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield start, stop
        start = stop


def rebatched(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        for start, stop in blocks(batch.column(text), limit):
            yield batch.slice(start, stop - start)
    release()


def release() -> None:
    """Give freed memory back: a worker process stays for the next tasks and must not keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)

"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefit.functions.shared import cut, shared_dir
from lodefit.functions.shipping import ship

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "FEW", "batch_of", "cut", "draw", "give_back", "held_out", "kept", "shared_dir", "small_batches", "table", "texts"]

#: Rows of one Arrow batch handed to a Python worker; bounds its memory.
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20
#: A table of counted size is broadcast up to so many rows of a few numbers; a larger one is joined by exchange.
FEW = 500_000


_KEPT: dict[tuple, object] = {}


def kept(name: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one thing, so that one operator's doesn't weigh on the next one's."""
    if name not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits for its next task is small; does nothing where the C library can't."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Ready the session for Python workers: at most BATCH_ROWS rows at a time."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def draw(rows: DataFrame, most: int, key: str) -> DataFrame:
    """At most so many rows, those of the smallest hashes of key; all of them if there are fewer.

    A rate from the number of rows comes first, so that a task hands on its share
    of the sample and not as many rows as the whole sample has.
    """
    space = 1 << 30
    rate = min(space, space * (2 * most + 100) // max(1, rows.count()))
    near = rows.where(F.pmod(F.xxhash64(key), F.lit(space)) < rate)
    return near.orderBy(F.pmod(F.xxhash64(key), F.lit(space)), key).limit(most)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod modulus is remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def texts(batch: pa.RecordBatch, name: str) -> list:
    """A string column as Python strings, null as None."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batch_of(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

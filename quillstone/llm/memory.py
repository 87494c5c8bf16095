"""Batches of Python workers: what they hold at a time, and whole numbers beside nulls."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
WHOLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}


def small_batches(spark: SparkSession) -> None:
    """Texts come to Python workers by some hundred rows, so that a batch of long ones fits.

    Batches are cut when a query runs, so the session keeps the settings.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_frames(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """df.mapInPandas(work, schema), with whole numbers as nullable columns.

    Plain pandas turns a whole number beside a null into a double, which loses digits beyond 2^53.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in work(b.to_pandas(types_mapper=WHOLE.get) for b in batches):
            yield pa.RecordBatch.from_pandas(frame, schema=kinds, preserve_index=False)

    return df.mapInArrow(run, schema)


def hash_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes, or all if there are fewer.

    A bound on the hash comes first, so that about that many rows, whatever the table's size, go into the sort.
    """
    n = df.count()
    bound = min(1.0, (1.2 * most + 200) / max(1, n))
    upper = int(-(2**63) + bound * (2**64 - 1)) if bound < 1 else 2**63 - 1
    return df.where(key <= F.lit(upper)).orderBy(key).limit(most)


def free_name(columns: list[str], stem: str) -> str:
    """A column name that no column has."""
    taken = {c.lower() for c in columns}
    return next(name for k in range(len(taken) + 1) if (name := f"__{stem}{k}") not in taken)


def release() -> None:
    """Gives freed memory back to the machine; without it a worker keeps its largest batch's for all later tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)

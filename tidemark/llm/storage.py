"""Tables in the folder that every executor shares, and columns by name."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, new_path, shared_dir  # noqa: F401


def fresh(df: DataFrame, *keep: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash."""
    return df.select(*[df[c] for c in keep])


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is shuffled, never broadcast.

    Spark estimates a table by its compressed files and a Python step or ``explode`` by what it reads,
    and both may hold many times that. The driver holds all of a broadcast table, once as rows and once as blocks.
    """
    return side.hint("merge")


def packed(table: np.ndarray) -> bytes:
    """A table of 64-bit integers as compressed bytes, in 32 bits where its numbers fit."""
    small = not len(table) or -(1 << 31) <= int(table.min()) <= int(table.max()) < 1 << 31
    return (b"4" if small else b"8") + zlib.compress(table.astype("<i4" if small else "<i8").tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), "<i4" if raw[:1] == b"4" else "<i8")


def added_tables(rows: DataFrame, spread: int = 1024, last: Callable[[np.ndarray], bytes] = packed) -> DataFrame:
    """part, n: the sum of all ``packed`` tables of each part, as ``last`` writes it.

    ``rows`` has one row a task and part. They are added in two steps, first the tasks of one of
    ``spread`` shares, and batch by batch, so no task reads the rows of all tasks or holds more than
    one table a part. A further Python step on the result would take a second worker for each task,
    and executors keep these; ``last`` spares it.
    """

    def add(batches: Iterator[pa.RecordBatch], write: Callable[[np.ndarray], bytes] = packed) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = unpacked(n.as_py())
                if k in total:
                    total[k] += own
                else:
                    total[k] = own.astype(np.int64)
        while total:
            k, n = total.popitem()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([write(n)], pa.binary())], names=["part", "n"])

    kinds = "part long, n binary"
    shares = rows.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(spread))).repartition("part", "share").select("part", "n")
    return shares.mapInArrow(add, kinds).repartition("part").mapInArrow(lambda batches: add(batches, last), kinds)

"""Vectors as numpy arrays inside tasks, and exact sums of them across tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 27  # integers are held within this, so that sums of their squares stay exact


def finite(column: str = "embedding") -> Column:
    """Whether the vector is there and all of its components are finite numbers."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(good, F.lit(False))


def matrix(column, width: int, kind=np.float64) -> np.ndarray:
    """Rows of an Arrow list column, all of ``width`` numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as integers, held within LIMIT."""
    return np.clip(np.floor(values * float(scale)), -LIMIT, LIMIT).astype(np.int64)


def lists(values: np.ndarray, kind) -> pa.ListArray:
    """A matrix as an Arrow list column."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def summed(partial: DataFrame) -> dict[int, int]:
    """Totals by slot of rows (slot, total): as many numbers as there are slots reach the driver."""
    rows = partial.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return {r["slot"]: int(r["total"]) for r in rows}


def slots(totals: np.ndarray) -> pa.RecordBatch:
    """The entries of an integer array that are not 0 as rows (slot, total)."""
    flat = totals.ravel()
    at = np.flatnonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["slot", "total"])


SLOTS = "slot int, total long"

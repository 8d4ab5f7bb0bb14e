"""Vectors of a table as matrices, batch by batch, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite entries alone."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """A list column without nulls as rows of doubles; shorter vectors end in zeros."""
    values, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(values) == len(lengths) * size and (lengths == size).all():
        return values.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size))
    out[np.arange(size) < lengths[:, None]] = values
    return out


def usable_rows(batches: Iterator[pa.RecordBatch], vector: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows of batches whose column number ``vector`` usable() takes, without batches that have none."""
    for batch in batches:
        column = batch.column(vector)
        fine = column.is_valid().to_numpy(zero_copy_only=False)
        lengths = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
        finite = np.isfinite(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # a null entry comes as nan
        if not finite.all():
            fine[np.repeat(np.arange(len(lengths)), lengths)[~finite]] = False
        if fine.any():
            yield batch if fine.all() else batch.filter(pa.array(fine))

"""Joins in which null keys meet null keys, and Arrow batches in slices."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alike(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet null keys; the keys of ``right`` go."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    met = left.join(renamed, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), how)
    return met.drop(*(f"__{k}" for k in keys))


def in_slices(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows: what Python makes of a row takes many times its room, so only so many rows are held as objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)

"""Vectors in bounded blocks: valid rows, dealing, and pairs of a block of rows with a block of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """True for a vector that is there and whose components all are finite numbers."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def blocks_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def dealt(df: DataFrame, columns: list[str], blocks: int, name: str) -> DataFrame:
    """A block number by the hash of ``columns``: distinct rows go to blocks of about equal size."""
    return df.withColumn(name, F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int"))


def block_pairs(rows: DataFrame, row_blocks: int, queries: DataFrame, query_blocks: int):
    """Both sides grouped by (block, query_block), every block of rows with every block of queries:
    a task holds one block of each, whatever the number of rows or queries."""
    left = rows.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    key = ["block", "query_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key))


def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the offsets of its rows."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    offsets = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64))]).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets


def matrix(table: pa.Table, name: str, width: int) -> np.ndarray:
    """A list column as a matrix; components that a shorter vector lacks are zero."""
    values, offsets = lists(table, name)
    out = np.zeros((table.num_rows, width), dtype=values.dtype)
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(table.num_rows), lengths)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1], lengths)] = values
    return out


def width_of(*tables: pa.Table, name: str) -> int:
    return max([1, *(int(np.diff(lists(t, name)[1]).max()) for t in tables if t.num_rows)])


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()

"""Rows gathered into blocks, and values looked up for a whole block at a time.

A block is what one task makes of some hundred or thousand neighbouring rows: one output row with
arrays. What is looked up or counted corpus-wide (words, pairs of ids) moves once a block instead of
once a row, so the most frequent value moves as often as there are blocks, and a hot one is a skewed
join that adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block is handed on once it holds so many items (words, links), or so many rows.
BLOCK_ITEMS, BLOCK_ROWS = 1 << 20, 1 << 13
#: How tables of blocks are written. Parquet's writer looks at the size of what it holds after a hundred rows at
#: first, and a reader decodes a row group at once; a hundred blocks are most of an executor's memory.
WIDE_ROWS = {"parquet.block.size": 1 << 23, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


class BlockNumbers:
    """Numbers that no other task of the job gives."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 32

    def take(self) -> int:
        self.next += 1
        return self.next - 1


def one_list(values: np.ndarray | pa.Array) -> pa.Array:
    """A column of one row that holds ``values`` as its list."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def list_of(column: pa.Array, row: int) -> np.ndarray:
    """The list in ``row`` of a column of numbers; empty if null."""
    found = column[row]
    return found.values.to_numpy(zero_copy_only=False) if found.is_valid else np.zeros(0, np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start``, ``start`` + 1, ... of each range, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def looked_up(blocks: DataFrame, entries: DataFrame, key: str, values: list[str], name: str) -> DataFrame:
    """``blocks`` with the array ``name``: structs of ``key`` and ``values``, ascending by ``key``.

    ``entries`` has a row (``block``, ``key``, ``values``) for each distinct key of a block, so an
    array is no longer than its block is. A block without a key gets null.
    """
    found = entries.groupBy(F.col("block").alias("_at")).agg(F.array_sort(F.collect_list(F.struct(key, *values))).alias(name))
    return blocks.join(found, F.col("block") == F.col("_at"), "left").drop("_at")

"""Functions on Arrow batches that hold Python objects of a small part of a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: A part has about so many bytes of text, or so many elements of arrays; one row at least.
BYTES, ELEMENTS = 1 << 20, 1 << 16


def portions(rows: pa.Array) -> Iterator[pa.Array]:
    """An array of texts or of arrays in parts; a batch has thousands of rows, whose texts may be long."""
    listed = pa.types.is_list(rows.type) or pa.types.is_large_list(rows.type)
    lengths = pc.list_value_length(rows) if listed else pc.binary_length(rows)
    part = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False), dtype=np.int64) // (ELEMENTS if listed else BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        yield rows.slice(a, b - a)


def each_row(kind: str, begun: Callable[[], Callable]):
    """A user function of one column: ``begun()`` is called once a task and gives the function of a row's value."""
    types = {"int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = begun()
        for batch in batches:
            for rows in portions(batch):
                yield pa.array([of(x) for x in rows.to_pylist()], types[kind])

    return run

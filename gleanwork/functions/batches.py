"""Python functions over Arrow batches: columns that a function does not make pass through as they are.

A pandas batch would turn an integer column with a null to doubles, and so change large ids; here no column
but the ones that are read leaves Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

TYPES = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def ranges(rows: int, lengths: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of a batch's rows of at most `most` in total; a longer row has a range of its own."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < rows:
        yield begin, rows


def lists(batches: Iterator[pa.RecordBatch], read: Sequence[str], text: str | None = None, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Slices of the batches with their `read` columns as lists; a slice has at most `most` bytes of the column text.

    After each batch Arrow gives back what it keeps of earlier ones, since workers stay, idle or busy, while other stages run.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        if text is None:
            cuts = [(0, batch.num_rows)]
        else:
            cuts = ranges(batch.num_rows, [n or 0 for n in pc.binary_length(batch.column(text)).to_pylist()], most)
        for i, j in cuts:
            part = batch.slice(i, j - i)
            yield part, [part.column(c).to_pylist() for c in read]
    batch = part = None
    pa.default_memory_pool().release_unused()


def with_made(rows: DataFrame, made: str, read: Sequence[str], start: Callable[[], Callable[..., Sequence[Sequence]]], text: str | None = None, most: int = 1_000_000) -> DataFrame:
    """rows with the columns of the schema `made`, which take the place of those of the same name.

    start() is called once a task and returns a function from the `read` columns, as lists, to the made
    columns. With text, it is called on at most `most` bytes of that column at once.
    """
    fields = {f.name: f for f in StructType.fromDDL(made)}
    schema = StructType([fields.get(f.name, f) for f in rows.schema] + [f for f in fields.values() if f.name not in rows.columns])
    kinds, names = {n: f.dataType.simpleString() for n, f in fields.items()}, schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for part, columns in lists(batches, read, text, most):
            own = {n: pa.array(v, TYPES[kinds[n]]) for n, v in zip(kinds, of(*columns), strict=True)}
            yield pa.RecordBatch.from_arrays([own[n] if n in own else part.column(n) for n in names], names=names)

    return rows.mapInArrow(run, schema)

"""Python functions of single rows as columns, with bounded memory in a worker.

Spark hands a worker batches of some ten thousand rows, whatever their size. A plain UDF holds all results of a batch before it returns any; here a
worker makes Python values of a few rows at a time and hands their results on, so beside the batch as it came it holds a part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A part: so many rows at most, of so many bytes or a single row.
ROWS, BYTES = 256, 1 << 20


def parts(columns: tuple[pa.Array, ...], rows: int = ROWS, size: int = BYTES) -> Iterator[tuple[list, ...]]:
    """The columns' values, a part after the other."""
    n = len(columns[0])
    lengths = [pc.binary_length(c).fill_null(0).to_pylist() for c in columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type)]
    of_row = list(map(sum, zip(*lengths, strict=True))) if lengths else [0] * n
    start = held = 0
    for at in range(n):
        if at > start and (at - start >= rows or held + of_row[at] > size):
            yield tuple(c.slice(start, at - start).to_pylist() for c in columns)
            start, held = at, 0
        held += of_row[at]
    if n > start:
        yield tuple(c.slice(start).to_pylist() for c in columns)


def by_row(make: Callable[[], Callable], kind: str, *columns: Column) -> Column:
    """A column of what make()'s function gives for the values of each row; make is called once a task. kind: its type; a struct's rows are dicts or tuples."""
    from pyspark.sql.types import DataType, StructType

    to = DataType.fromDDL(kind)
    names = to.names if isinstance(to, StructType) else None

    def results(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        f, arrow = make(), to_arrow_type(to)
        for b in batches:
            for values in parts(b if isinstance(b, tuple) else (b,)):
                out = list(map(f, *values))
                if names:
                    out = [dict(zip(names, x, strict=True)) if isinstance(x, tuple) else x for x in out]
                yield pa.array(out, arrow)
        pa.default_memory_pool().release_unused()

    if len(columns) == 1:

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from results(batches)
    else:

        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            yield from results(batches)

    run.__annotations__ = {"batches": Iterator[pa.Array] if len(columns) == 1 else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, to)(*columns)

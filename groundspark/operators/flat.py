"""One row to many without holding a batch's results: Arrow batches go in as they come, and out as soon as they hold enough text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Characters and rows of one batch of results.
MOST_CHARS, MOST_ROWS = 1 << 20, 4096


def flat_batches(batches: Iterator[pa.RecordBatch], function: Callable[[object], Iterator[tuple]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at: list[int] = []
        rows: list[tuple] = []
        chars = 0
        for k in range(batch.num_rows):
            for row in function(batch.column(1)[k].as_py()):
                at.append(k)
                rows.append(row)
                chars += sum(len(x) for x in row if isinstance(x, str))
                if chars > MOST_CHARS or len(rows) >= MOST_ROWS:
                    yield _packed(batch, at, rows, names)
                    at, rows, chars = [], [], 0
        if rows:
            yield _packed(batch, at, rows, names)


def _packed(batch: pa.RecordBatch, at: list[int], rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, zip(*rows))], names=names)


def flat_map(df: DataFrame, function: Callable[[object], Iterator[tuple]], added: str) -> DataFrame:
    """The first column of ``df``, and a row of ``added`` columns for each tuple that ``function`` makes of the second one."""
    schema = StructType([*df.select(df.columns[0]).schema.fields, *StructType.fromDDL(added).fields])
    names = schema.names
    return df.mapInArrow(lambda batches: flat_batches(batches, function, names), schema)

"""Scans in order with a little state per key: linear in the rows, whatever a key's number of them.

Rows are dealt by key and sorted inside their partition by Spark, which spills;
the scan then streams over Arrow batches and holds one state, never a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame

Step = Callable[[Any, tuple], tuple[Any, Any]]


def _in_order(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _scan(keys: list[str], uses: list[str], start: Any, step: Step) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        last, state = None, start
        for batch in batches:
            out = []
            own = zip(*[batch.column(c).to_pylist() for c in keys], strict=True)
            values = zip(*[batch.column(c).to_pylist() for c in uses], strict=True)
            for key, value in zip(own, values, strict=True):
                if key != last:
                    last, state = key, start
                state, got = step(state, value)
                out.append(got)
            yield batch, out

    return run


def kept_in_order(rows: DataFrame, keys: list[str], order: list[Column | str], uses: list[str], start: Any, step: Step) -> DataFrame:
    """The rows for which step(state, values of uses) -> (state, keep) says so; state begins anew with every key."""
    scan = _scan(keys, uses, start, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, keep in scan(batches):
            yield batch.filter(pa.array(keep, pa.bool_()))

    return _in_order(rows, keys, order).mapInArrow(run, rows.schema)


def numbered_in_order(
    rows: DataFrame, keys: list[str], order: list[Column | str], uses: list[str], start: Any, step: Step, names: list[str]
) -> DataFrame:
    """rows with further long columns: step(state, values of uses) -> (state, their values)."""
    scan = _scan(keys, uses, start, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in scan(batches):
            more = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"`{n}` long" for n in names])
    return _in_order(rows, keys, order).mapInArrow(run, schema)

"""Ordered scans: path-dependent operators with bounded memory.

Rows are hash-partitioned by key and sorted by (key, t, seq) once; a kernel then
walks them Arrow batch by Arrow batch and keeps only its state for the key in
hand, so that a key of any length streams through one task without being held.

``column_scan`` hands a kernel the times and values of a whole run of one key and takes
back which rows it emits and their values; all other columns stay Arrow buffers.
``ordered_scan`` hands over rows one by one as dicts, for kernels that need them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A kernel is made anew for each key; called with a row (a dict) it yields rows to emit.
Kernel = Callable[[dict], Iterator[dict]]


def ordered_scan(df: DataFrame, keys: list[str], kernel: Callable[[], Kernel], out: str | T.StructType, order: tuple[str, ...] = ("t", "seq"), at_end: bool = False) -> DataFrame:
    """Walk rows in order with one kernel a key; ``out`` is the schema of what kernels yield.

    With ``at_end`` a kernel is called once more with None after a key's last row.
    Without keys all rows are one sequence and go through one task.
    """
    schema = T._parse_datatype_string(out) if isinstance(out, str) else out
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema.fields]
    placed = df.repartition(*keys) if keys else df.coalesce(1)
    placed = placed.sortWithinPartitions(*keys, *order)

    def walk(batches):
        key, run = object(), None

        def emit(rows):
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=arrow)

        last = None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                at = tuple(row[k] for k in keys)
                if at != key:
                    if run is not None and at_end:
                        made += [last | r for r in run(None)]
                    key, run = at, kernel()
                last = {k: row[k] for k in keys}
                made += [last | r for r in run(row)]
            if made:
                yield emit(made)
        if run is not None and at_end:
            if made := [last | r for r in run(None)]:
                yield emit(made)

    return placed.mapInArrow(walk, schema)


def _starts(columns: list[pa.Array], n: int) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns (nulls are equal to nulls)."""
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        if n > 1:
            a, b = c.slice(1), c.slice(0, n - 1)
            differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            new[1:] |= differs | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return new


def whole_instants(batches, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, dealt anew so that no instant (keys, t) is cut."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        last = int(np.flatnonzero(_starts([batch.column(c) for c in (*keys, "t")], batch.num_rows))[-1])
        if last:
            yield batch.slice(0, last)
        waiting = batch.slice(last)
    if waiting is not None:
        yield waiting


def runs(rows: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, first row, row after the last) of each run of one key."""
    edges = [*np.flatnonzero(_starts([rows.column(k) for k in keys], rows.num_rows)).tolist(), rows.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield tuple(rows.column(k)[lo].as_py() for k in keys), lo, hi


def placed_in_order(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return (df.repartition(*keys) if keys else df.coalesce(1)).sortWithinPartitions(*keys, *order)


def column_scan(df: DataFrame, keys: list[str], kernel: Callable, kind: str) -> DataFrame:
    """Walk (keys, t, seq, v) in order; ``kernel()`` makes a key's state, whose ``run(times, values)`` gives (rows or None for all, values).

    A kernel gets whole instants: the last one of a batch waits for the next batch.
    """
    kept = [*keys, "t", "seq"]
    out = T.StructType([*[df.schema[c] for c in kept], T.StructField("v", T._parse_datatype_string(kind))])
    arrow = to_arrow_schema(out)
    placed = placed_in_order(df.select(*kept, "v"), keys, "t", "seq")

    def walk(batches):
        state, key = None, None

        def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal state, key
            take, made = [], []
            t, v = rows.column("t").to_numpy().tolist(), rows.column("v").to_pylist()
            for own, lo, hi in runs(rows, keys):
                if state is None or own != key:
                    state, key = kernel(), own
                at, values = state.run(t[lo:hi], v[lo:hi])
                take += range(lo, hi) if at is None else [lo + i for i in at]
                made += values
            held = rows if len(take) == rows.num_rows else rows.take(pa.array(take, pa.int64()))
            return pa.RecordBatch.from_arrays([*[held.column(c).cast(arrow.field(c).type) for c in kept], pa.array(made, arrow.field("v").type)], schema=arrow)

        for rows in whole_instants(batches, keys):
            yield whole(rows)

    return placed.mapInArrow(walk, out)

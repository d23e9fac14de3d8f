"""Arrow batches: whole groups of sorted partitions, and vector sums by key with partial sums before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the keys (long or int columns); a group is never cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for c in keys:
            values = batch.column(c).to_numpy(zero_copy_only=False)
            same &= values == values[-1]
        begin = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if begin:
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
            held = []
        elif held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if any(last.column(c)[0] != batch.column(c)[0] for c in keys):
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def read_batches(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """A written table in a task, through any file system that pyarrow knows, so many rows at a time."""
    system, root = pa.fs.FileSystem.from_uri(path)
    parts = system.get_file_info(pa.fs.FileSelector(root))
    for part in sorted(x.path for x in parts if x.path.endswith(".parquet")):
        with system.open_input_file(part) as file:
            yield from (b for b in pa.parquet.ParquetFile(file).iter_batches(rows, use_threads=False) if b.num_rows)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def arrays(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of arrays."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1] if rows.size else 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets[: len(rows) + 1]), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first, axis=0)


def grouped_vector_sum(df: DataFrame, key: str, features: Callable[[pa.RecordBatch], np.ndarray], step: int = 4_096) -> DataFrame:
    """(key, total): the sum over each key's rows of the row vectors that ``features`` makes of a batch.

    Sums are made per batch before the shuffle, so a key of most rows sends a few partial sums. Rows with a NULL key
    must have been removed.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                keys, sums = _summed(batch.column(key).to_numpy(zero_copy_only=False), features(batch))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), arrays(sums)], ["k", "total"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["k"]):
            keys, sums = _summed(table["k"].to_numpy(), matrix(table["total"]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), arrays(sums)], ["k", "total"])

    schema = "k long, total array<double>"
    return df.mapInArrow(partial, schema).repartition("k").sortWithinPartitions("k").mapInArrow(final, schema).withColumnRenamed("k", key)


def map_rows(df: DataFrame, keys: list[str], vectors: list[str], function: Callable[..., np.ndarray], name: str) -> DataFrame:
    """``keys`` (longs) and an array column ``name`` = function(*matrices of the columns ``vectors``), batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = function(*(matrix(b.column(v)) if pa.types.is_list(b.column(v).type) else b.column(v).to_numpy(zero_copy_only=False) for v in vectors))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), arrays(out)], [*keys, name])

    schema = ", ".join(f"{k} long" for k in keys) + f", {name} array<double>"
    return df.select(*keys, *vectors).mapInArrow(run, schema)

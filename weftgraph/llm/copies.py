"""Duplicates hidden by formatting: recursive radix partitioning on canonical bytes, then counting in tries.

A record's canonical form is compared as UTF-8 bytes. All records are one bucket at first; a bucket of more than
``capacity`` rows is split by its next ``STRIDE`` bytes, and its parts again, until each fits or is a single record. Where
a part still holds at least half of its bucket, what its records have in common is skipped: the next split begins after
the longest common prefix, so a long common header costs one level and not one for every few bytes. A record that alone
exceeds the capacity is never brought together: its first row is found by partial aggregation and joined back by
broadcast. All other buckets are dealt to tasks; a task builds a trie over the canonical bytes of each of its buckets, one
digit of eight bytes a level, with a counter and the smallest row id at the terminals.

A bucket is named by a hash of its prefix. Should two prefixes share a hash they are split alike, which changes nothing
for the records: equal records always take the same way, and tries compare all bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.vertexkey import stripped
from weftgraph.session import written, written_counted

STRIDE = 4
#: Above, the capacity is the rows over BUCKETS, so that a level has fewer than BUCKETS oversized parts whatever the data:
#: the bound for broadcasting them. A bucket of fewer rows than LEAST isn't worth a split.
LEAST = 2_000
BUCKETS = 4_096
#: Rows that one task's tries hold.
TASK_ROWS = 50_000
#: After so many levels what is left is written, so that the plan stays short.
WRITE_EVERY = 4


def canonical(*fields: Column | str) -> Column:
    """Fields that ``plain`` was applied to (lower-case letters and digits), in byte order, joined by a unit separator.

    A NULL field counts as empty; NULL if no field has any letter or digit.
    """
    given = [F.col(f) if isinstance(f, str) else f for f in fields]
    whole = F.array_join(F.array_sort(F.array(*(F.coalesce(f, F.lit("")) for f in given))), "\x1f")
    return F.when(F.length(F.replace(whole, F.lit("\x1f"), F.lit(""))) > 0, whole)


def canonical_record(*fields: Column) -> Column:
    """The canonical form of raw fields of any type."""
    return canonical(*(F.lower(stripped(f.cast("string"))) for f in fields))


def terminals(records: pa.Array, buckets: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The terminal node of each record in a trie for each bucket (one for all without ``buckets``), and the number of terminals.

    The trie is kept level by level: a node is numbered by (its parent, its digit); records end at the level of their
    length, so a record that is a prefix of another has a terminal of its own.
    """
    n = len(records)
    binary = records.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64, n + 1, binary.offset * 8)
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    ends, total = np.full(n, -1, np.int64), 0
    # The roots are the buckets.
    node = np.zeros(n, np.int64) if buckets is None else np.unique(buckets, return_inverse=True)[1]
    alive, level = np.arange(n), 0
    while len(alive):
        # A terminal is a pair of a node and the number of bytes of the last, partly filled digit.
        left = lengths[alive] - 8 * level
        width = np.minimum(left, 8)
        take = offsets[alive] + 8 * level
        digit = np.zeros(len(alive), np.uint64)
        for i in range(8):
            has = width > i
            digit[has] |= data[take[has] + i].astype(np.uint64) << np.uint64(56 - 8 * i)
        _, d = np.unique(digit, return_inverse=True)
        _, node = np.unique((node * (d.max() + 1) + d) * 9 + np.maximum(width, 0), return_inverse=True)
        over = left <= 8
        if over.any():
            _, t = np.unique(node[over], return_inverse=True)
            ends[alive[over]] = t + total
            total += int(t.max()) + 1
        alive, node, level = alive[~over], node[~over], level + 1
    return ends, total


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The length of the longest common prefix of ``low`` and ``high``."""
    for b in batches:
        out = []
        for low, high in zip(b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True):
            n = min(len(low), len(high))
            differ = np.flatnonzero(np.frombuffer(low, np.uint8, n) != np.frombuffer(high, np.uint8, n))
            out.append(int(differ[0]) if len(differ) else n)
        yield pa.RecordBatch.from_arrays([b.column("leaf"), pa.array(out, pa.int64())], ["leaf", "common"])


def _leaf(cut: Column) -> Column:
    return F.xxhash64(F.substring("rec", F.lit(1), cut))


def split_buckets(rows: DataFrame, capacity: int, total: int) -> tuple[DataFrame, int]:
    """``rows`` (row_id, rec BINARY; ``total``) with their bucket ``leaf``, and ``alone``: whether it is a single record
    beyond the capacity; and the number of levels."""
    spark: SparkSession = rows.sparkSession
    placed = rows.withColumns({"cut": F.lit(STRIDE), "leaf": _leaf(F.lit(STRIDE)), "above": F.lit(0).cast("long"), "settled": F.lit(False), "alone": F.lit(False)})
    parents, level = {0: total}, 0
    while True:
        going = placed.filter("NOT settled")
        counts = going.groupBy("leaf", "above").agg(F.count("*").alias("n"), F.max("cut").alias("cut"), F.max(F.length("rec") > F.col("cut")).alias("longer"))
        over = counts.filter(F.col("n") > capacity).collect()  # fewer than rows / capacity <= BUCKETS
        if not over:
            return placed.select("row_id", "rec", "leaf", "alone"), level
        level += 1
        cuts = {r["leaf"]: r["cut"] + STRIDE for r in over}
        stuck = [r["leaf"] for r in over if r["longer"] and 2 * r["n"] >= parents.get(r["above"], 0)]
        if stuck:
            ends = going.filter(F.col("leaf").isin(stuck)).groupBy("leaf").agg(F.min("rec").alias("low"), F.max("rec").alias("high"))
            for r in ends.mapInArrow(_common, "leaf long, common long").collect():
                cuts[r["leaf"]] = max(cuts[r["leaf"]], r["common"] + STRIDE)
        parents = {r["leaf"]: r["n"] for r in over}
        # No record of the bucket goes on after its prefix: it is one record.
        ended = {r["leaf"] for r in over} - {r["leaf"] for r in over if r["longer"]}
        table = spark.createDataFrame([(k, c, k in ended) for k, c in cuts.items()], "leaf long, next int, ended boolean")
        marked = placed.join(F.broadcast(table), "leaf", "left")
        split = ~F.col("settled") & F.col("next").isNotNull() & ~F.col("ended")
        placed = marked.select(
            "row_id",
            "rec",
            F.when(split, F.col("next")).otherwise(F.col("cut")).alias("cut"),
            F.when(split, _leaf(F.col("next"))).otherwise(F.col("leaf")).alias("leaf"),
            F.when(split, F.col("leaf")).otherwise(F.col("above")).alias("above"),
            (~split).alias("settled"),
            (F.col("alone") | (~F.col("settled") & F.coalesce("ended", F.lit(False)))).alias("alone"),
        )
        if level % WRITE_EVERY == 0:
            placed = written(placed, "split")


def _count_bin(table: pa.Table) -> pa.Table:
    ends, n = terminals(table["rec"].combine_chunks(), table["leaf"].to_numpy())
    ids = table["row_id"].to_numpy()
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, ends, ids)
    counters = np.bincount(ends, minlength=n)
    return pa.table({"row_id": ids, "first_row_id": first[ends], "n_copies": counters[ends].astype(np.int64)})


def mark_copies(df: DataFrame, row_id: str, record: Column, least: int = LEAST, buckets: int = BUCKETS) -> DataFrame:
    """(row_id, first_row_id, n_copies) of every row whose ``record`` (canonical text) isn't NULL.

    first_row_id is the smallest row id with the same record and n_copies the number of such rows, itself included.
    Row ids are unique longs. Other columns are dropped at once. An empty table gives an empty one.
    """
    # Rows without a record are dropped after reading back: a filter on ``record`` would have it computed twice.
    rows, total = written_counted(df.select(F.col(row_id).cast("long").alias("row_id"), record.cast("binary").alias("rec")), "records")
    rows = rows.filter("rec IS NOT NULL")
    capacity = max(least, -(-total // buckets))
    placed, levels = split_buckets(rows, capacity, total)
    bins = max(1, -(-total // max(TASK_ROWS, capacity)))
    placed = placed.withColumn("bin", F.pmod("leaf", F.lit(bins)).cast("int"))
    fit = placed.filter("NOT alone").select("row_id", "rec", "leaf", "bin")
    counted = fit.groupBy("bin").applyInArrow(_count_bin, "row_id long, first_row_id long, n_copies long")
    if not levels:
        return counted
    # Single records that fill an oversized bucket: fewer than BUCKETS a level.
    hot = placed.filter("alone").select("row_id", "rec")
    firsts = hot.groupBy("rec").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("n_copies"))
    return counted.unionByName(hot.join(F.broadcast(firsts), "rec").select("row_id", "first_row_id", "n_copies"))

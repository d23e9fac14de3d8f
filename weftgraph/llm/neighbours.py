"""Most similar vectors for every vector: multi-index hashing over one learned rotated binary code.

* Code. On a bounded sample (about ``SAMPLE`` vectors, chosen by hash) the unit vectors are whitened and one rotation is
  learned that brings them close to the corners of a cube of as many dimensions as the code has bits (iterative
  quantisation; the vectors are padded with zeros). The signs are the bits.
* Index. The code is cut into ``TABLES`` substrings, of about log2 N - SPARE bits each, and every vector goes into one bucket of
  each table. By the pigeonhole principle two codes that differ in fewer than TABLES bits agree in a whole substring, so
  the buckets of a vector hold every code within Hamming radius TABLES - 1, and many beyond.
* Radius. Of a bucket only codes within ``RADIUS`` of all bits are looked at, and only in the first table in which two
  vectors meet.
* Rerank. Cosines of the vectors (32-bit numbers, multiplied as 64-bit ones) decide; each vector keeps its k best of each
  table, and the best of those in the end. Pairs are never emitted.

Groups of equal vectors are collapsed first: k + 1 of each group stand for all. A bucket of more than ``BUCKET`` vectors is
worked off exactly as a grid of blocks of at most that size, spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.batches import whole_groups
from weftgraph.session import small_or_plain, written, written_counted

SAMPLE, TABLES, BUCKET, ROUNDS, SPARE = 20_000, 5, 4_096, 30, 4
#: The part of a code's bits in which two vectors may differ.
RADIUS = 0.25
#: Members of a group of equal vectors that one task sorts.
EQUAL_PART = 10_000
#: A neighbour and its cosine, as results travel.
NEAR = np.dtype([("other", "<i8"), ("sim", "<f8")])


def usable(vector: Column, dim: int) -> Column:
    """Whether an array holds exactly ``dim`` finite numbers that are not all 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Whitening and one learned rotation to a code of ``tables`` substrings of ``bits`` bits."""

    def __init__(self, sample: np.ndarray, tables: int, bits: int, seed: int = 7) -> None:
        d = sample.shape[1]
        self.tables, self.bits = tables, bits
        self.mean = sample.mean(axis=0)
        values, vectors = np.linalg.eigh(np.cov((sample - self.mean).T).reshape(d, d) if len(sample) > 1 else np.eye(d))
        white = vectors / np.sqrt(np.maximum(values, 1e-9))
        z = (sample - self.mean) @ white
        # The padding of z with zeros is left out of all products; only the first d rows of the rotation matter.
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(d, tables * bits),) * 2))[0]
        for _ in range(ROUNDS):
            corners = np.where(z @ r[:d] > 0, 1.0, -1.0)
            product = np.zeros_like(r)
            product[:d] = z.T @ corners
            u, _, v = np.linalg.svd(product)
            r = u @ v
        self.rotation = white @ r[:d, : tables * bits]

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) longs: the code, cut."""
        bits = (x - self.mean) @ self.rotation > 0
        return bits.reshape(len(x), self.tables, self.bits) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _bytes(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = np.arange(0, len(rows) * width + 1, max(width, 1), dtype=np.int32)[: len(rows) + 1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _content(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in one piece, and the length of each value."""
    if column.num_chunks != 1:
        column = pa.chunked_array([column.combine_chunks()]) if column.num_chunks else column
    array = column.chunk(0)
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4)
    return np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, similarity) of the k best columns of each row; -inf never is one."""
    if sims.shape[1] > k:
        columns = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        columns = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    rows = np.repeat(np.arange(len(sims)), columns.shape[1])
    flat = columns.ravel()
    values = sims[rows, flat]
    real = values > -2
    return rows[real], ids[flat[real]], values[real]


def _search(dim: int, k: int, tables: int, radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    keys = ["t", "bucket", "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            columns = [table[c].to_numpy() for c in keys]
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            cuts = np.append(np.flatnonzero(new), table.num_rows)
            ids, role = table["vid"].to_numpy(), table["role"].to_numpy()
            content = _content(table["x"])[0].reshape(table.num_rows, -1)
            x = np.ascontiguousarray(content[:, : 4 * dim]).view("<f4").astype(float)
            code = np.ascontiguousarray(content[:, 4 * dim :]).view("<i8")
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                t = columns[0][a]
                asked, data = np.flatnonzero(role[a:b] != 2) + a, np.flatnonzero(role[a:b] != 1) + a
                for c in range(0, len(asked), 1024):
                    q = asked[c : c + 1024]
                    apart = np.zeros((len(q), len(data)), np.uint8)
                    far = ids[q][:, None] == ids[data][None, :]
                    for s in range(tables):
                        if s != t:
                            differ = code[q, s][:, None] ^ code[data, s][None, :]
                            apart += np.bitwise_count(differ)
                            if s < t:
                                # They have met in that table.
                                far |= differ == 0
                    far |= apart > radius
                    sims = x[q] @ x[data].T
                    sims[far] = -np.inf
                    rows, found, values = _best(sims, ids[data], k)
                    out.append((q[rows], found, values))
            if out:
                rows, found, values = (np.concatenate(c) for c in zip(*out, strict=True))
                near = np.empty(len(found), NEAR)
                near["other"], near["sim"] = found, values
                first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
                ends = np.append(first, len(rows)).astype(np.int32) * NEAR.itemsize
                lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(near.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[first]]), lists], ["vid", "near"])

    return search


def _merge(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["vid"]):
            content, sizes = _content(table["near"])
            near = content.view(NEAR)
            vid, other, sim = np.repeat(table["vid"].to_numpy(), sizes // NEAR.itemsize), near["other"], near["sim"]
            order = np.lexsort((other, -sim, vid))
            vid, other, sim = vid[order], other[order], sim[order]
            begin = np.concatenate(([0], np.flatnonzero(vid[1:] != vid[:-1]) + 1))
            place = np.arange(len(vid)) - np.repeat(begin, np.diff(np.append(begin, len(vid))))
            keep = place < k
            yield pa.RecordBatch.from_arrays([pa.array(vid[keep]), pa.array(other[keep]), pa.array(sim[keep])], ["vid", "other", "sim"])

    return merge


def _collapsed(coded: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """(vectors that stay in the index, (vid, heads) of those left out): of a group of more than k + 1 equal vectors the k + 1
    smallest ids, the heads, stay; every other member's nearest are the first k heads."""
    named = coded.withColumns({"e": F.xxhash64("x"), "f": F.hash("x")})
    groups, n = written_counted(named.groupBy("e", "f").agg(F.count("*").alias("n")).filter(F.col("n") > k + 1), "equal")
    if not n:
        return coded, None
    members = named.join(small_or_plain(groups, n), ["e", "f"]).select("e", "f", "vid", F.pmod(F.xxhash64("vid"), F.ceil(F.col("n") / EQUAL_PART)).alias("part"))
    least = F.slice(F.sort_array(F.collect_list("vid")), 1, k + 1)
    heads = members.groupBy("e", "f", "part").agg(least.alias("vids")).select("e", "f", F.explode("vids").alias("vid")).groupBy("e", "f").agg(least.alias("heads"))
    marked = named.join(small_or_plain(written(heads, "heads"), n), ["e", "f"], "left")
    out = F.coalesce(~F.array_contains("heads", F.col("vid")), F.lit(False))
    marked = written(marked.withColumn("out", out), "collapsed")
    return marked.filter("NOT out").select(*coded.columns), marked.filter("out").select("vid", F.slice("heads", 1, k).alias("heads"))


def nearest(df: DataFrame, vid: str, vector: str, dim: int, k: int = 5, tables: int = TABLES, bucket: int = BUCKET, sample: int = SAMPLE, radius: float = RADIUS, seed: int = 7) -> DataFrame:
    """(vid, other, sim): for every usable vector up to k others of highest cosine.

    A vector is usable if it has exactly ``dim`` finite numbers, not all 0; others, and rows without an id, are left out.
    Ids are unique longs; further columns are ignored. Equal similarities are ordered by id. Approximate: a neighbour
    whose code differs in ``tables`` or more bits may be missed. An empty table gives an empty result.
    """
    spark = df.sparkSession
    none = spark.createDataFrame([], "vid long, other long, sim double")
    rows = df.select(F.col(vid).cast("long").alias("vid"), F.col(vector).cast("array<double>").alias("x"))
    n = df.count()  # of the whole table: a bound is enough for the length of the code and the rate of the sample
    rows = rows.filter(F.col("vid").isNotNull() & usable(F.col("x"), dim))
    rate = 1_000_000 * sample // max(n, 1)
    # Some rows more or less than ``sample`` numbers of dim; at most 1.1 times as many reach the driver.
    drawn = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("vid"), F.lit(1_000_000)) < rate)
    chosen = drawn.limit(sample * 11 // 10).toArrow()
    if chosen.num_rows == 0:
        chosen = rows.limit(sample).toArrow()
        if chosen.num_rows == 0:
            return none
    bits = int(np.clip(np.ceil(np.log2(max(n, 2))) - SPARE, 4, 40))
    codes = Codes(unit(_vectors(chosen["x"].combine_chunks(), dim)), tables, bits, seed)
    sent = spark.sparkContext.broadcast(codes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(_vectors(batch.column(1), dim)) if batch.num_rows else np.zeros((0, dim))
            subs = sent.value.substrings(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, subs.size + 1, tables, dtype=np.int32)), pa.array(subs.ravel()))
            whole = np.concatenate((x.astype("<f4").view(np.uint8).reshape(len(x), -1), subs.astype("<i8").view(np.uint8).reshape(len(x), -1)), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _bytes(whole), lists], ["vid", "x", "subs"])

    coded = written(rows.mapInArrow(encode, "vid long, x binary, subs array<long>"), "codes")
    coded, left_out = _collapsed(coded, k)
    entries = coded.select("vid", "x", F.posexplode("subs").alias("t", "bucket"))
    sizes = coded.select(F.posexplode("subs").alias("t", "bucket")).groupBy("t", "bucket").count().filter(F.col("count") > bucket)
    large, n_large = written_counted(sizes.select("t", "bucket", F.ceil(F.col("count") / bucket).cast("int").alias("g")), "large")
    whole = F.lit(0)
    if not n_large:
        placed = entries.select("vid", "x", "t", "bucket", whole.alias("i"), whole.alias("j"), whole.alias("role"))
    else:
        # role 0: query and data, 1: query, 2: data. The cells (i, j) of a large bucket's grid hold queries i and data j.
        own = F.pmod(F.xxhash64("vid"), F.col("g")).cast("int")
        joined = entries.join(small_or_plain(large, n_large), ["t", "bucket"], "left").withColumn("own", own)
        every = F.sequence(F.lit(0), F.col("g") - 1)
        cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
        cells = F.concat(F.transform(every, lambda j: cell(F.col("own"), j, 1)), F.transform(every, lambda i: cell(i, F.col("own"), 2)))
        single = F.array(cell(F.lit(0), F.lit(0), 0))
        placed = joined.select("vid", "x", "t", "bucket", F.inline(F.when(F.col("g").isNull(), single).otherwise(cells)))
    keys = ["t", "bucket", "i", "j"]
    search = _search(dim, k, tables, int(radius * tables * bits))
    found = placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "vid long, near binary")
    best = found.repartition("vid").sortWithinPartitions("vid").mapInArrow(_merge(k), "vid long, other long, sim double")
    if left_out is None:
        return best
    return best.unionByName(left_out.select("vid", F.explode("heads").alias("other"), F.lit(1.0).alias("sim")))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(vid_a, vid_b): unordered pairs of which at least one is among the nearest of the other; vid_a < vid_b."""
    return near.select(F.least("vid", "other").alias("vid_a"), F.greatest("vid", "other").alias("vid_b")).distinct()


def exact_nearest(df: DataFrame, queries: Column, vid: str, vector: str, dim: int, k: int = 5, block: int = 2_048) -> DataFrame:
    """(vid, other, sim) for the usable vectors that meet ``queries``, by comparing each with every vector: the measure of recall.

    The queries are worked off in blocks of ``block``, one scan of the table for each; a scan sends k rows a task and query.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vid).cast("long").alias("vid"), F.col(vector).cast("array<double>").alias("x"))
    rows = written(rows.filter(F.col("vid").isNotNull() & usable(F.col("x"), dim)), "usable")
    asked = rows.filter(queries)
    n = asked.count()
    found = spark.createDataFrame([], "vid long, other long, sim double")
    for i in range(-(-n // block)):
        part = asked.filter(F.pmod(F.xxhash64("vid"), F.lit(-(-n // block))) == i).toArrow()
        if not part.num_rows:
            continue
        sent = spark.sparkContext.broadcast((part["vid"].to_numpy(), unit(_vectors(part["x"].combine_chunks(), dim))))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best, names = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1)
            for whole in batches:
                for a in range(0, whole.num_rows, 1_024):
                    b = whole.slice(a, 1_024)
                    data = b.column(0).to_numpy()
                    sims = q @ unit(_vectors(b.column(1), dim)).T
                    sims[ids[:, None] == data[None, :]] = -np.inf
                    sims = np.concatenate((best, sims), axis=1)
                    every = np.concatenate((names, np.broadcast_to(data, (len(ids), len(data)))), axis=1)
                    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    best, names = np.take_along_axis(sims, top, axis=1), np.take_along_axis(every, top, axis=1)
            r, c = np.nonzero(best > -2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(names[r, c]), pa.array(best[r, c])], ["vid", "other", "sim"])

        found = found.unionByName(rows.mapInArrow(search, "vid long, other long, sim double"))
    place = F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("sim"), "other"))
    return found.withColumn("place", place).filter(F.col("place") <= k).drop("place")

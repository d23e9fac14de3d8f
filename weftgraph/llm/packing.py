"""Filling fixed-capacity containers with documents: sum-of-squares packing.

Documents are measured in tokens of a public tokenizer. One longer than the capacity is divided: its full pieces fill
containers of their own, and the rest is packed like any other document. Items are dealt by hash to shards of about
``SHARD_ITEMS`` items, one task each; a shard is packed by the sum-of-squares rule: with N(g) open containers of residual
gap g, an item goes where the sum of N(g)^2 over all gaps becomes smallest. Larger items come first. What the shards
leave at most half full (a few containers each) is brought together and packed once more, containers being the items.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import written, written_counted

CAPACITY = 2_048
SHARD_ITEMS = 20_000


def default_vocabulary() -> str:
    """The installed vocabulary file of a byte-level BPE for many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    """The expression by which that vocabulary cuts a text before merging."""
    from public_tokenizers import PATTERN

    return PATTERN


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> object:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, doc_id: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens) of every document with text: one that is neither NULL nor all whitespace."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t and not t.isspace() else 0 for t in batch.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])
            yield out.filter(pc.greater(out.column(1), 0))

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.filter("text IS NOT NULL").mapInArrow(count, "doc_id long, n_tokens long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item (in the order given; 1 <= size <= capacity), and what each container holds.

    Ties go to the smallest gap, and a container that is open is preferred to a new one.
    """
    open_bins = np.zeros(capacity + 1, np.int64)  # N(g); N(0) stays 0: full containers don't count
    stacks: dict[int, list[int]] = defaultdict(list)
    where, held = np.zeros(len(sizes), np.int64), []
    for i, s in enumerate(sizes.tolist()):
        # Twice the change of the sum / 2 for each gap g >= s; the gap s itself closes the container.
        before, after = open_bins[s:capacity], open_bins[: capacity - s]
        change = np.where(before > 0, 2 * (after - before) + 2, np.iinfo(np.int64).max)
        best = int(change.argmin()) if len(change) else -1
        least = int(change[best]) if best >= 0 else np.iinfo(np.int64).max
        if len(before) and before[0] > 0 and 1 - 2 * int(before[0]) <= least:
            best, least = 0, 1 - 2 * int(before[0])
        fresh = 2 * int(open_bins[capacity - s]) + 1 if s < capacity else 0
        if best >= 0 and least <= fresh:
            gap = best + s
            b = stacks[gap].pop()
            open_bins[gap] -= 1
            held[b] += s
        else:
            gap, b = capacity, len(held)
            held.append(s)
        if gap > s:
            open_bins[gap - s] += 1
            stacks[gap - s].append(b)
        where[i] = b
    return where, np.array(held, np.int64)


def _packer(capacity: int, stage: str, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs the shard that a task's rows are: (shard, size, *keep), larger sizes first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if whole is not None:
            shards = whole["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = whole.slice(a, b - a)
                where, held = sum_of_squares(part["size"].to_numpy(), capacity)
                names = np.array([f"{stage}{shards[a]}-{k}" for k in range(len(held))], object)
                out = part.select([*keep, "size"]).append_column("bin", pa.array(names[where], pa.string())).append_column("held", pa.array(held[where], pa.int64()))
                yield from out.combine_chunks().to_batches()

    return pack


def _packed(items: DataFrame, shards: int, capacity: int, stage: str, keep: str) -> DataFrame:
    names = [k.split()[0] for k in keep.split(", ")]
    # One partition a shard, whatever its bytes: packing is a loop over items, so shards mustn't be put together.
    placed = items.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.desc("size"), *names)
    return placed.select("shard", "size", *names).mapInArrow(_packer(capacity, stage, names), f"{keep}, size long, bin string, held long")


def pack_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, pattern: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(bin_id, doc_id, part, first_token, n_tokens): every document with text, placed whole or, if longer than a container, in parts.

    NULL and blank texts are left out. doc_id must be unique; other columns are ignored; an empty table gives an empty one.
    vocabulary and pattern: a public tokenizer's file and the expression that goes with it.
    """
    sizes, n = written_counted(count_tokens(documents, doc_id, text, vocabulary or default_vocabulary(), pattern or default_pattern()), "tokens")
    whole = (F.col("n_tokens") / capacity).cast("long")
    full = sizes.filter(F.col("n_tokens") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part"))
    full = full.select(F.format_string("f%d-%d", "doc_id", "part").alias("bin_id"), "doc_id", "part", (F.col("part") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"))
    rests = sizes.select("doc_id", whole.alias("part"), (F.col("n_tokens") - whole * capacity).alias("size")).filter("size > 0")
    shards = max(1, round(n / shard_items))
    items = rests.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    placed = written(_packed(items, shards, capacity, "s", "doc_id long, part long"), "packed")
    # A few containers a shard; so this stage is smaller than the first by the order of shard_items.
    loose_items = placed.filter(F.col("held") * 2 <= capacity)
    left, n_left = written_counted(loose_items.select("bin", "held").distinct(), "left")
    again = max(1, round(n_left / shard_items))
    loose = left.select(F.col("bin").alias("old"), F.col("held").alias("size"), F.pmod(F.xxhash64("bin"), F.lit(again)).cast("int").alias("shard"))
    merged = _packed(loose, again, capacity, "m", "old string").select(F.col("old").alias("bin"), F.col("bin").alias("new_bin"))
    # Only the items of those containers meet the new names; both sides are small, and neither needs to be sent to every task.
    moved = loose_items.join(written(merged, "merged").hint("shuffle_hash"), "bin").select("doc_id", "part", "size", F.col("new_bin").alias("bin"))
    placed = placed.filter(F.col("held") * 2 > capacity).select("doc_id", "part", "size", "bin").unionByName(moved)
    parts = placed.select(F.col("bin").alias("bin_id"), "doc_id", "part", (F.col("part") * capacity).alias("first_token"), F.col("size").alias("n_tokens"))
    return full.unionByName(parts)


def packing_checks(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: the documents placed, and whether each lies there once and whole, no container holds more than the capacity,
    and the containers are within a hundredth of the least possible number."""
    per_doc = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("part").alias("last"), F.countDistinct("part").alias("parts"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    docs = per_doc.agg(F.count("*").alias("n_documents"), F.bool_and((F.col("n") == F.col("parts")) & (F.col("last") + 1 == F.col("n")) & (F.col("tokens") == F.col("end"))).alias("whole_and_once"), F.sum("tokens").alias("total"))
    bins = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("held")).agg(F.coalesce(F.max("held") <= capacity, F.lit(True)).alias("none_overfull"), F.count("*").alias("n_bins"))
    both = docs.crossJoin(F.broadcast(bins))  # one row each
    return both.select("n_documents", "whole_and_once", "none_overfull", (F.col("n_bins") <= F.ceil(F.col("total") / capacity) * 1.01 + 1).alias("near_the_least"))

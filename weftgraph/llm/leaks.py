"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search, vectorised.

A case is a run of at least ``RUN`` letters and digits, common to an item and a document after everything else and case
have been disregarded. Patterns are pieces of ``PIECE`` characters cut from the items every ``PIECE + 1`` characters:
any common run of RUN = 2 * PIECE characters holds one whole piece. Over the documents a window of PIECE characters
moves on by the shift that a table gives for the block of ``BLOCK`` characters at its end: where the block occurs in no
piece, by PIECE - BLOCK + 1 at once. Where the shift is 0, the block at the window's end names a bucket of pieces (those
that end in a block of the same hash), of which those that begin like the window are taken; the characters of the piece
and around it are compared directly with the item until the run is long enough or ends.

Many windows (one for each segment of the text) advance in step, so that each step is a few numpy operations. Items
are searched for in blocks of at most ``ITEM_CHARS`` characters, ``BLOCKS_AT_ONCE`` blocks in one pass over texts that are
folded once; so what is broadcast and held is bounded however many items there are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import written

RUN, PIECE, BLOCK = 40, 20, 5
#: Characters of items in one search, and of documents in one step of a task.
ITEM_CHARS, STEP_CHARS = 4_000_000, 4_000_000
BLOCKS_AT_ONCE = 8
SEGMENT = 512
TABLE_BITS = 22
#: Ends a text; no letter or digit has this number, and items and documents have different ones.
TEXT_END, ITEM_END = 0x7FFFFFFE, 0x7FFFFFFF
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """For each code point its lower-case form if it is a letter or decimal digit, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalnum() and unicodedata.category(c)[0] in "LN":
            table[cp] = ord(c.lower()[0])
    return table


def folded(texts: list[str], end: int, pad: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of folded characters, each followed by ``end``, padded on both sides; and the ends' places."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = folding()[points]
    keep = plain != 0
    kept = np.concatenate(([0], np.cumsum(keep)))[np.cumsum(sizes)] if len(texts) else np.zeros(0, np.int64)
    out = np.insert(plain[keep], kept, np.uint32(end))
    fill = np.full(pad, end, np.uint32)
    return np.concatenate((fill, out, fill)), kept + np.arange(len(texts)) + pad


def _block_hash(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for i in range(BLOCK):
        h = (h + text[at + i]) * MULTIPLIER
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _bucket(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of a window's last block, which names a bucket of pieces, above that of its first block."""
    return (_block_hash(text, at + (PIECE - BLOCK)) << TABLE_BITS) | _block_hash(text, at)


class Patterns:
    """The search tables of a block of items."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.items, ends = folded(texts, ITEM_END)
        self.ids = np.array(ids, np.int64)
        begins = np.concatenate(([64], ends[:-1] + 1)) if len(ends) else ends
        places, owners = [], []
        for k, (a, b) in enumerate(zip(begins, ends, strict=True)):
            if b - a >= RUN:
                here = np.arange(a, b - PIECE + 1, PIECE + 1)
                places.append(here)
                owners.append(np.full(len(here), k))
        self.place = np.concatenate(places) if places else np.zeros(0, np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.shift = np.full(1 << TABLE_BITS, PIECE - BLOCK + 1, np.uint8)
        for j in range(PIECE - BLOCK + 1):
            np.minimum.at(self.shift, _block_hash(self.items, self.place + j), np.uint8(PIECE - BLOCK - j))
        buckets = _bucket(self.items, self.place)
        order = np.argsort(buckets, kind="stable")
        self.buckets, self.place, self.owner = buckets[order], self.place[order], owner[order]

    def search(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the text, item id) of every case in ``folded`` texts, without repeats."""
        last = len(text) - 64 - PIECE
        starts = np.arange(64, max(65, last + 1), SEGMENT)
        stops = np.minimum(starts + SEGMENT, last + 1)
        at, hits = starts, []
        alive = at < stops
        at, stops = at[alive], stops[alive]
        while len(at):
            s = self.shift[_block_hash(text, at + (PIECE - BLOCK))]
            zero = s == 0
            if zero.any():
                hits.append(at[zero])
            at = at + np.maximum(s, 1)
            alive = at < stops
            if not alive.all():
                at, stops = at[alive], stops[alive]
        if not hits or not len(self.buckets):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(hits)
        h = _bucket(text, at)
        low, high = np.searchsorted(self.buckets, h, "left"), np.searchsorted(self.buckets, h, "right")
        n = high - low
        found: list[np.ndarray] = []
        # Windows with many pieces are compared in portions.
        for group in np.array_split(np.flatnonzero(n), max(1, int(n.sum() // 500_000))):
            k = n[group]
            window = np.repeat(at[group], k)
            piece = np.repeat(low[group], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            found.append(self._confirm(text, ends, window, piece))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pairs[:, 0], self.ids[pairs[:, 1]]

    def _confirm(self, text: np.ndarray, ends: np.ndarray, window: np.ndarray, piece: np.ndarray) -> np.ndarray:
        place = self.place[piece]
        whole = np.ones(len(window), bool)
        for i in range(PIECE):
            whole &= text[window + i] == self.items[place + i]
        window, place, piece = window[whole], place[whole], piece[whole]
        run = np.full(len(window), PIECE)
        for step, begin in ((-1, -1), (1, PIECE)):
            going = np.ones(len(window), bool)
            for i in range(PIECE):
                going &= text[window + begin + step * i] == self.items[place + begin + step * i]
                if not going.any():
                    break
                run += going
        ok = run >= RUN
        return np.stack((np.searchsorted(ends, window[ok]), self.owner[piece[ok]]), axis=1)


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of together about ``most`` characters; a longer text is a range of its own."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) of every document and item that share a run of at least RUN letters and digits, once each.

    NULL texts, and items of fewer than RUN letters and digits, have no cases. The documents are read once for every
    BLOCKS_AT_ONCE blocks of items (one block up to ITEM_CHARS characters), without a shuffle of texts.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    wanted = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).filter("t IS NOT NULL AND i IS NOT NULL")

    def blocks() -> Iterator[Patterns]:
        ids, texts, size = [], [], 0
        for r in wanted.toLocalIterator():
            if texts and size + len(r["t"]) > ITEM_CHARS:
                yield Patterns(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(r["i"])
            texts.append(r["t"])
            size += len(r["t"])
        yield Patterns(ids, texts)

    def one_pass(held: list[Patterns]) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                for a, b in _slices(sizes, STEP_CHARS):
                    plain, ends = folded(texts[a:b], TEXT_END)
                    for patterns in sent.value:
                        d, i = patterns.search(plain, ends)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][d], pa.int64()), pa.array(i, pa.int64())], ["doc_id", "item_id"])

        return rows.mapInArrow(search, "doc_id long, item_id long"), sent

    found, held = None, []
    source = blocks()
    while len(held := list(islice(source, BLOCKS_AT_ONCE))) == BLOCKS_AT_ONCE:
        # A pass that isn't the last is written at once, so that its items can be let go.
        part, sent = one_pass(held)
        part = written(part, "leaks")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    if held or found is None:
        part, _ = one_pass(held)
        found = part if found is None else found.unionByName(part)
    return found.distinct()

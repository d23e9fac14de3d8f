"""Topic models over counts (doc, word, n): CVB0 and collapsed Gibbs sampling in synchronous rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.batches import arrays, grouped_vector_sum, matrix
from weftgraph.operators.neighborhood import top_k
from weftgraph.session import forget, written

MAX_COUNT = 100


def bag_of_words(tokens: DataFrame) -> DataFrame:
    """(doc, word, n) with longs for doc and word, repeats added up and counts capped at MAX_COUNT."""
    return tokens.filter("doc IS NOT NULL AND word IS NOT NULL").groupBy(F.col("doc").cast("long").alias("doc"), F.col("word").cast("long").alias("word")).agg(F.least(F.sum("n"), F.lit(MAX_COUNT)).cast("long").alias("n"))


def _totals(cells: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    weighted = lambda b: matrix(b.column("g")) * b.column("n").to_numpy()[:, None]
    docs = written(grouped_vector_sum(cells.select("doc", "n", "g"), "doc", weighted), "docs")
    words = written(grouped_vector_sum(cells.select("word", "n", "g"), "word", weighted), "words")
    topics = docs.select(F.posexplode("total").alias("t", "x")).groupBy("t").agg(F.sum("x").alias("x")).orderBy("t").collect()
    return docs, words, np.array([r["x"] for r in topics])


def _draws(doc: np.ndarray, word: np.ndarray, token: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on the token and the round only, not on how rows are split into batches."""
    with np.errstate(over="ignore"):
        x = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ word.astype(np.uint64)
        x = x * np.uint64(0xBF58476D1CE4E5B9) + token.astype(np.uint64) * np.uint64(0x94D049BB133111EB) + np.uint64(seed * 1_000_003 + step)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _rounds(bag: DataFrame, topics: int, iterations: int, alpha: float, beta: float, seed: int, sample: bool) -> tuple[DataFrame, DataFrame, DataFrame, list[float]]:
    start = F.pmod(F.xxhash64("doc", "word", F.lit(seed)), F.lit(topics))
    hard = F.transform(F.sequence(F.lit(0), F.lit(topics - 1)), lambda k: F.when(k == start, 1.0).otherwise(0.0))
    cells = written(bag.select("doc", "word", "n", hard.alias("g")), "cells")
    w = bag.select("word").distinct().count()
    trend: list[float] = []
    docs, words, total = _totals(cells)
    for step in range(iterations):
        joined = cells.join(docs.toDF("doc", "nd"), "doc").join(words.toDF("word", "nw"), "word")

        def update(batches: Iterator[pa.RecordBatch], total: np.ndarray = total, step: int = step) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                n, g = b.column("n").to_numpy().astype(float), matrix(b.column("g"))
                nd, nw = matrix(b.column("nd")), matrix(b.column("nw"))
                likelihood = n * np.log(((alpha + nd) * (beta + nw) / (beta * w + total)).sum(axis=1) / (alpha * topics + nd.sum(axis=1)))
                if sample:
                    # Each token is drawn against the counts at the start of the round without itself.
                    held = np.rint(g * n[:, None]).astype(np.int64)
                    cell, old = np.nonzero(held)
                    times = held[cell, old]
                    cell, old = np.repeat(cell, times), np.repeat(old, times)
                    own = np.zeros((len(cell), topics))
                    own[np.arange(len(cell)), old] = 1.0
                    p = np.maximum((alpha + nd[cell] - own) * (beta + nw[cell] - own) / (beta * w + total - own), 1e-12).cumsum(axis=1)
                    begin = np.searchsorted(cell, np.arange(len(n)))
                    u = _draws(b.column("doc").to_numpy()[cell], b.column("word").to_numpy()[cell], np.arange(len(cell)) - begin[cell], seed, step)
                    new = (p < (u * p[:, -1])[:, None]).sum(axis=1)
                    g = np.zeros_like(g)
                    np.add.at(g, (cell, new), 1.0)
                    g /= np.maximum(n, 1)[:, None]
                else:
                    # CVB0 leaves one token's own belief out of the counts.
                    p = (alpha + np.maximum(nd - g, 0)) * (beta + np.maximum(nw - g, 0)) / (beta * w + total - g)
                    g = p / p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("word"), b.column("n"), arrays(g), pa.array(likelihood)], ["doc", "word", "n", "g", "ll"])

        new = written(joined.mapInArrow(update, "doc long, word long, n long, g array<double>, ll double"), "cells")
        trend.append(new.agg(F.sum("ll")).first()[0] or 0.0)
        forget(cells)
        cells = new
        docs, words, total = _totals(cells)
    return docs, words, cells, trend


def lda_cvb0(bag: DataFrame, topics: int = 50, iterations: int = 10, alpha: float = 1.0, beta: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame, list[float]]:
    """((doc, total), (word, total), log likelihood before each round): expected topic counts by soft beliefs."""
    docs, words, _, trend = _rounds(bag, topics, iterations, alpha, beta, seed, False)
    return docs, words, trend


def lda_gibbs(bag: DataFrame, topics: int = 50, iterations: int = 10, alpha: float = 1.0, beta: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame, list[float]]:
    """The same with hard topics of single tokens, drawn against the counts at the start of the round."""
    docs, words, _, trend = _rounds(bag, topics, iterations, alpha, beta, seed, True)
    return docs, words, trend


def top_words(words: DataFrame, k: int = 10) -> DataFrame:
    """(topic, place, word, weight): the k heaviest words of each topic; ties to the larger word."""
    cells = words.select("word", F.posexplode("total").alias("topic", "weight"))
    return top_k(cells, ["topic"], [F.desc("weight"), F.desc("word")], k).select("topic", "place", "word", "weight")

"""Per-key results where a few keys hold most rows.

A frequent-items sketch finds the heavy keys: one sketch a task, merged as a tree (about sqrt(tasks) at a time), so no task
ever holds more than that many. A key is heavy if it could fill half a shuffle partition. The rows of heavy keys meet
the sketch's short list by broadcast join and are grouped by (key, partner), so that a hot key is spread over all tasks;
every other row takes one ordinary shuffle on its key, in which no key is above half a partition; the two are united.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import BROADCAST_ROWS

#: A sketch of t counters misses no key whose share of the rows exceeds about 3.5 / t; it gets this many per 1 / share.
COUNTERS = 8
#: The sketch's largest size, and so the smallest share that can be asked for (8e-6: 60,000 shuffle partitions).
MOST_TRACKED = 1_000_000


@dataclass(frozen=True)
class KeyStats:
    """``heavy`` and ``rest``: DataFrames (key, n_rows, n_partners) that share no key; ``all_keys``: both."""

    heavy: DataFrame
    rest: DataFrame

    @property
    def all_keys(self) -> DataFrame:
        return self.heavy.unionByName(self.rest)


def heavy_share(spark: SparkSession) -> float:
    """The share of the keyed rows from which on a key is heavy: half a shuffle partition, one in a thousand at most."""
    return max(COUNTERS / MOST_TRACKED, min(0.001, 0.5 / int(spark.conf.get("spark.sql.shuffle.partitions"))))


def heavy_keys(df: DataFrame, key: Column, share: float | None = None) -> list[int]:
    """Every key (long) that holds at least ``share`` of the rows with a key, by sketch; some lighter keys may be among them.

    The list has at most 2 / share entries whatever the data: more keys cannot hold that share of all rows within the
    sketch's error. NULL keys are ignored; an empty input gives an empty list. ``share`` defaults to ``heavy_share``.
    """
    share = share or heavy_share(df.sparkSession)
    tracked, most = math.ceil(COUNTERS / share), int(2 / share)
    if tracked > MOST_TRACKED:
        raise ValueError("the sketch would be too large for this share")
    keyed = df.select(key.alias("k")).filter("k IS NOT NULL")
    branches = max(1, math.isqrt(df.rdd.getNumPartitions()))
    # A task's rows all have one branch: it sends one sketch, and a branch merges about sqrt(tasks) of them.
    leaf = keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(branches)).alias("branch"))
    partial = leaf.agg(F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(k, {tracked})").alias("s"))
    # Grouped by a constant: a partition without a branch must not send an empty sketch, which can't be merged.
    row = partial.groupBy(F.pmod("branch", F.lit(1))).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {most})").alias("top")).first()
    if row is None:
        return []
    return [x["item"] for x in row["top"] or [] if x["item"] is not None and x["count"] >= share * row["n"] / 2]


def skew_key_stats(df: DataFrame, key: str, partner: str, heavy: list[int]) -> KeyStats:
    """Rows and distinct partners of every key.

    Rows with a NULL key are left out; a NULL partner counts as a row but not as a partner. Other columns are dropped
    before any shuffle. ``heavy`` may be empty, and any keys in it are merely processed the other way.
    """
    rows = df.select(F.col(key).alias("__k"), F.col(partner).alias("__p")).filter("__k IS NOT NULL")
    short = F.broadcast(df.sparkSession.createDataFrame([(int(k),) for k in heavy], "__k long"))
    totals = [F.sum("__n").alias("n_rows"), F.count("__p").alias("n_partners")]

    def of(x: DataFrame) -> DataFrame:
        return x.groupBy("__k", "__p").agg(F.count("*").alias("__n")).groupBy("__k").agg(*totals).withColumnRenamed("__k", key)

    hot = of(rows.join(short, "__k", "left_semi"))
    # One exchange on the key serves both aggregations.
    return KeyStats(hot, of(rows.join(short, "__k", "left_anti").repartition("__k")))


def split_join(left: DataFrame, right: DataFrame, key: str, right_rows: int, hot: list[int], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row per key, ``right_rows`` in all) on a long column that may have hot keys on the left.

    A small right side is broadcast. Otherwise the rows of the keys in ``hot`` meet their few rows of ``right`` by
    broadcast and all others take an ordinary shuffle, so no task gets a hot key whole.
    """
    if right_rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    if not hot:
        return left.join(right, key, how)
    listed = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.filter(F.col(key).isin(hot)))
    return left.filter(listed).join(few, key, how).unionByName(left.filter(~listed).join(right.filter(~listed), key, how))

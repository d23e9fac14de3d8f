"""Consolidating pairwise matches into groups: connected components over billions of pairs.

1. The giant component is peeled by breadth-first frontier joins from the vertex of highest degree and anti-joined away.
   Where only thin tails are left of it (``TAIL`` levels in a row that add less than a hundredth each: long chains that
   hang on the giant), the vertices reached become one vertex and stay in the game, so the result is the same either way.
2. The remaining components are labelled by propagating the smallest key, with contraction as an accelerator: each
   vertex takes the smallest neighbour in a fixed pseudo-random order as its parent; the smallest key of all who chose a
   parent goes up to it; edges are rewritten to the parents, loops and repeats vanish, and so on. Each round at least
   about halves what is left of any chain, so a chain of length n takes about log2 n rounds of shrinking size instead of
   n rounds. Heavy hubs come first in the order: their stars vanish in one round.
3. The smallest keys are handed back down from the last round to the first.

Every join whose key may be hot (a hub among the edges, a parent of a third of all vertices) is split: the few rows of hot
keys are broadcast, the rest is shuffled. Ids are non-negative longs below 2^62.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.heavy import heavy_keys, split_join
from weftgraph.session import BROADCAST_ROWS, forget, small_or_plain, written, written_counted

#: Levels in a row that add less than a hundredth of what was reached, after which the giant is contracted.
TAIL = 4
#: Bits of either half of an id in the Feistel rounds, if nothing smaller is known to do.
HALF = 31
#: Odd multipliers of the Feistel rounds.
_KEYS = (1_640_531_527, 1_181_783_497, 2_034_852_277, 1_540_483_477)


def _round(x: Column, key: int, half: int) -> Column:
    return F.shiftright(x * F.lit(key).cast("long"), max(1, min(17, 48 - half))).bitwiseAND(F.lit((1 << half) - 1).cast("long"))


def mix(x: Column, half: int = HALF) -> Column:
    """A fixed pseudo-random bijection of ids below 2^(2 half) (Feistel), so that ids that rise along a chain don't.

    Ids keep their width: what is shuffled is no wider than the keys are.
    """
    left, right = F.shiftright(x, half), x.bitwiseAND(F.lit((1 << half) - 1).cast("long"))
    for key in _KEYS:
        left, right = right, left.bitwiseXOR(_round(right, key, half))
    return F.shiftleft(left, half).bitwiseOR(right)


def unmix(x: Column, half: int = HALF) -> Column:
    left, right = F.shiftright(x, half), x.bitwiseAND(F.lit((1 << half) - 1).cast("long"))
    for key in reversed(_KEYS):
        left, right = right.bitwiseXOR(_round(left, key, half)), left
    return F.shiftleft(left, half).bitwiseOR(right)


def _both(edges: DataFrame) -> DataFrame:
    """(v, u): each edge from either end, in one scan."""
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))))


def _hot(edges: DataFrame, size: int) -> list[int]:
    """The hubs, where a side beyond the broadcast limit may meet the edges."""
    return heavy_keys(_both(edges), F.col("v")) if size > BROADCAST_ROWS else []


def peel_giant(edges: DataFrame, root: int, hubs: list[int], tail: int = TAIL) -> tuple[DataFrame, int, bool]:
    """Vertices reached from ``root``, their number, and whether all that can be reached were. edges: (a, b), written."""
    visited = frontier = edges.sparkSession.createDataFrame([(root,)], "v long")
    reached = size = 1
    thin, both = 0, _both(edges)
    while thin < tail:
        near = split_join(both, frontier, "v", size, hubs, "left_semi").select(F.col("u").alias("v")).distinct()
        step, size = written_counted(near.join(small_or_plain(visited, reached), "v", "left_anti"), "frontier")
        if not size:
            return visited, reached, True
        thin = thin + 1 if size * 100 < reached else 0
        visited, frontier, reached = visited.unionByName(step), step, reached + size
    return visited, reached, False


def label_small(edges: DataFrame, size: int, low: Column) -> DataFrame | None:
    """(v, low): for each vertex of ``edges`` (a, b; a <> b; written) the least ``low`` (of column v) of its component."""
    trail: list[tuple[DataFrame, int]] = []
    nodes: DataFrame | None = None
    while size > 0:
        hot = _hot(edges, size)
        least = _both(edges).groupBy("v").agg(F.min("u").alias("u"))
        # A vertex without edges left has no parent: its component is complete.
        begun = least.withColumn("low", low) if nodes is None else nodes.join(least, "v", "left")
        step, n = written_counted(begun.select("v", F.when(F.col("u").isNotNull(), F.least("v", "u")).alias("p"), "low"), "parents")
        trail.append((step, n))
        live = step.filter("p IS NOT NULL").select("v", "p")
        moved = split_join(edges, live.toDF("a", "pa"), "a", n, hot)
        moved = split_join(moved, live.toDF("b", "pb"), "b", n, hot).filter("pa <> pb")
        moved = moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        # A graph of hardly more edges than vertices has few repeats, not worth a shuffle.
        after, size = written_counted(moved.distinct() if 2 * size > 3 * n else moved, "edges")
        if len(trail) > 1:
            forget(edges)
        edges = after
        nodes = step.filter("p IS NOT NULL").groupBy(F.col("p").alias("v")).agg(F.min("low").alias("low"))
        if len(trail) > 200:
            raise RuntimeError(f"no end after 200 rounds; {size} edges left")
    labels, above = nodes, trail[-1][1] if trail else 0
    while trail:
        step, n = trail.pop()
        live = step.filter("p IS NOT NULL").select("v", "p")
        hot = heavy_keys(live, F.col("p")) if above > BROADCAST_ROWS else []
        down = split_join(live, labels.toDF("p", "low"), "p", above, hot).select("v", "low")
        labels, above = step.filter("p IS NULL").select("v", "low").unionByName(down), n
        if trail and n > BROADCAST_ROWS:
            labels = written(labels, "labels")
    return labels


def components(pairs: DataFrame, a: str, b: str, tail: int = TAIL) -> DataFrame:
    """(v, group): every id in either column with the smallest id of its component.

    A pair with a NULL side links nothing, and neither does a vertex paired with itself, but the ids in them still come
    out. Direction and repeats don't matter; other columns are ignored. An empty table gives an empty result.
    """
    # Written first: filters on costly expressions would have them computed several times.
    ends = written(pairs.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")), "pairs")
    linked = ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, size = written_counted(linked.distinct(), "edges")
    alone = ends.filter("a IS NULL OR b IS NULL OR a = b").select(F.coalesce("a", "b").alias("v")).filter("v IS NOT NULL").distinct()
    alone, n_alone = written_counted(alone, "alone")
    if not size:
        return alone.select("v", F.col("v").alias("group"))
    hubs = heavy_keys(_both(edges), F.col("v"))
    counted = _both(edges).filter(F.col("v").isin(hubs)) if hubs else _both(edges)
    root = counted.groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").first()["v"]
    visited, reached, whole = peel_giant(edges, root, hubs, tail)
    visited = written(visited, "visited")
    least = visited.agg(F.min("v")).first()[0]
    if whole:
        # Of an edge both ends are in the giant or none is.
        rest = split_join(edges, visited.toDF("a"), "a", reached, hubs, "left_anti")
    else:
        # What was reached becomes the root, and the rest of its component is found by propagation.
        mark = visited.withColumn("r", F.lit(root))
        rest = split_join(edges, mark.toDF("a", "ra"), "a", reached, hubs, "left")
        rest = split_join(rest, mark.toDF("b", "rb"), "b", reached, hubs, "left")
        rest = rest.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct()
    # Hubs get negative order numbers and so come before all other vertices.
    half = max(4, -(-int(edges.agg(F.max("b")).first()[0]).bit_length() // 2))
    number = lambda c: F.when(F.col(c).isin(hubs), -mix(F.col(c), half) - 1).otherwise(mix(F.col(c), half)) if hubs else mix(F.col(c), half)
    plain = unmix(F.when(F.col("v") < 0, -F.col("v") - 1).otherwise(F.col("v")), half)
    rest, left = written_counted(rest.select(number("a").alias("a"), number("b").alias("b")), "rest")
    small = label_small(rest, left, F.least(plain, F.when(plain == root, F.lit(least)))) if left else None
    giant = visited.select("v", F.lit(least).alias("group"))
    if small is not None:
        small = small.select(plain.alias("v"), F.col("low").alias("group"))
        if not whole:
            small = written(small, "small")
            met = small.filter(F.col("v") == root).first()
            giant = visited.select("v", F.lit(least if met is None else met["group"]).alias("group"))
            small = small.filter(F.col("v") != root)
    labelled = giant if small is None else giant.unionByName(small)
    if not n_alone:
        return labelled
    labelled = written(labelled, "labelled")
    if n_alone <= BROADCAST_ROWS:
        linked_too = labelled.select("v").join(F.broadcast(alone), "v", "left_semi")
        single = alone.join(F.broadcast(linked_too), "v", "left_anti")
    else:
        single = alone.join(labelled.select("v"), "v", "left_anti")
    return labelled.unionByName(single.select("v", F.col("v").alias("group")))

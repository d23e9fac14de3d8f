"""Reproducible draws: uniform numbers from a key and seeds by plain integer arithmetic, so that tasks that run again, other
engines and SQL get the same; and draws of other distributions made from them."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers below a prime of 31 bits: products of two stay within a long.
PRIME = 2_147_483_647
#: Primitive roots of the prime.
STEP, TWIST = 48_271, 16_807
#: Added at the start, so that 0 isn't a fixed point.
BEGIN = 987_654_321


def _seed(x: object) -> int:
    return zlib.crc32(x.encode()) % PRIME if isinstance(x, str) else int(x) % PRIME


def mixed(c: Column, *more: object) -> Column:
    """A number in [0, PRIME) from a long and seeds (numbers, texts or long columns)."""
    p = F.lit(PRIME).cast("long")
    x = F.pmod(F.pmod(c.cast("long"), p) * STEP + F.pmod(F.floor(c.cast("long") / p).cast("long"), p) * TWIST + BEGIN, p)
    for m in more:
        seed = F.pmod(m.cast("long"), p) if isinstance(m, Column) else F.lit(_seed(m)).cast("long")
        x = F.pmod(x * STEP + seed, p)
    # Squares mod a prime take the number apart from its neighbours.
    for k in (TWIST, STEP):
        x = F.pmod(x * F.pmod(x + k, p), p)
    return x


def _folded(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**62 modulo the prime, by its form 2**31 - 1."""
    for _ in range(2):
        x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def mixed_numbers(keys: np.ndarray, numbers: np.ndarray, seed: int = 0) -> np.ndarray:
    """``mixed(key, number, seed)`` of each key (rows) and number (columns)."""
    keys = keys.astype(np.int64)[:, None]
    x = _folded(keys % PRIME * STEP + np.floor(keys / PRIME).astype(np.int64) % PRIME * TWIST + BEGIN)
    x = _folded(_folded(x * STEP) * STEP + _seed(seed)) + _folded(numbers.astype(np.int64) % PRIME * STEP)
    x = np.where(x >= PRIME, x - PRIME, x)
    for k in (TWIST, STEP):
        x = _folded(x * _folded(x + k))
    return x


def draw(c: Column, *more: object) -> Column:
    """A uniform number in (0, 1)."""
    return (mixed(c, *more).cast("double") + 0.5) / float(PRIME)


def sql_mixed(c: str, *more: object) -> str:
    """DuckDB SQL for ``mixed``; seeds may be numbers, texts in quotes-free form, or SQL in a 1-tuple."""
    p = f"{PRIME}::BIGINT"
    mod = lambda e: f"((({e}) % {p} + {p}) % {p})"
    steps = [f"({mod(f'({c})::BIGINT')} * {STEP} + {mod(f'floor(({c})::BIGINT / {PRIME})::BIGINT')} * {TWIST} + {BEGIN}) % {p}"]
    body = "x"
    for m in more:
        seed = mod(f"({m[0]})::BIGINT") if isinstance(m, tuple) else f"{_seed(m)}::BIGINT"
        steps.append(f"({body} * {STEP} + {seed}) % {p}")
    for k in (TWIST, STEP):
        steps.append(f"({body} * (({body} + {k}) % {p})) % {p}")
    # Nested lists of one number stand for local names.
    out = f"[{steps[0]}]"
    for s in steps[1:]:
        out = f"list_transform({out}, lambda x: {s})"
    return f"({out})[1]"


def sql_draw(c: str, *more: object) -> str:
    return f"(({sql_mixed(c, *more)})::DOUBLE + 0.5) / {float(PRIME)}"


def normal(c: Column, *more: object) -> Column:
    """A standard normal number, by the polar form of two uniform ones."""
    return F.sqrt(-2 * F.log(draw(c, *more, 1))) * F.cos(2 * F.pi() * draw(c, *more, 2))


def exponential(c: Column, *more: object) -> Column:
    return -F.log(draw(c, *more))


def gamma(c: Column, shape: float, *more: object, tries: int = 16) -> Column:
    """A gamma number of the shape (scale 1), by squeezing a cubed normal; the first of ``tries`` proposals that is accepted
    (each is with more than 0.95)."""
    boosted = shape if shape >= 1 else shape + 1
    d = boosted - 1 / 3
    k = 1 / (9 * d) ** 0.5
    # Lambdas name the proposals, so that their expressions aren't repeated.
    seen = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: F.struct(normal(c, *more, "x", t).alias("x"), draw(c, *more, "u", t).alias("u")))
    cubed = F.transform(seen, lambda s: F.struct(s["x"].alias("x"), F.log(s["u"]).alias("u"), F.pow(1 + k * s["x"], F.lit(3.0)).alias("v")))
    fit = F.filter(cubed, lambda s: (s["v"] > 0) & (s["u"] < 0.5 * s["x"] * s["x"] + d - d * s["v"] + d * F.log(F.greatest(s["v"], F.lit(1e-300)))))
    out = d * F.coalesce(F.try_element_at(fit, F.lit(1))["v"], F.lit(1.0))
    return out if shape >= 1 else out * F.pow(draw(c, *more, "boost"), F.lit(1 / shape))


def multinomial(c: Column, weights: Column, *more: object) -> Column:
    """The place (from 0) drawn in proportion to an array of weights that aren't negative; NULL if none is positive."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    mark = draw(c, *more) * total
    # The running sum and the number of weights passed.
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    passed = F.aggregate(weights, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + F.when(a["sum"] + x <= mark, 1).otherwise(0)).alias("n")))
    return F.when(total > 0, F.least(passed["n"], F.size(weights) - 1))


def permutation(size: Column, c: Column, *more: object) -> Column:
    """The numbers 0 .. size - 1 in a random order that depends on the key and the seeds."""
    numbers = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(mixed(c, *more, i).alias("m"), (i - 1).alias("i")))
    return F.when(size > 0, F.transform(F.array_sort(numbers), lambda s: s["i"])).otherwise(F.array().cast("array<int>"))


def choice(c: Column, options: Sequence[object], *more: object) -> Column:
    return F.array(*(F.lit(o) for o in options))[F.pmod(mixed(c, *more), F.lit(len(options))).cast("int")]

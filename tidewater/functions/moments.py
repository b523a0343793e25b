"""Sample deviations by Welford's sums, updated and combined as DuckDB does, so that both give the same bits; equal values have exactly 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _state(k: Column, mean: Column, square: Column) -> Column:
    return F.struct(k.alias("k"), mean.alias("mean"), square.alias("square"))


def _taken(s: Column, x: Column) -> Column:
    k = s["k"] + 1
    mean = s["mean"] + (x - s["mean"]) / k
    return F.when(x.isNull(), s).otherwise(_state(k, mean, s["square"] + (x - mean) * (x - s["mean"])))


def _deviation(s: Column) -> Column:
    return F.when(s["k"] > 1, F.sqrt(s["square"] / (s["k"] - 1)))


def sums(values: Column, start: Column | None = None) -> Column:
    """State of an array of doubles (nulls don't count), going on from a state."""
    return F.aggregate(values, _state(F.lit(0.0), F.lit(0.0), F.lit(0.0)) if start is None else start, _taken)


def let(make: Callable[..., Column], *values: Column) -> Column:
    """make of names for the values, so that each is computed once."""
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(named), lambda r: make(*[r[f"v{i}"] for i in range(len(values))]))[0]


def fma(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: the errors of the product (Dekker) and of the sum (Knuth) are added at the end."""
    cut = F.lit(134217729.0)  # 2^27 + 1 halves a double
    high = lambda x: cut * x - (cut * x - x)
    error = lambda x, xh, y, yh, p: xh * yh - p + xh * (y - yh) + (x - xh) * yh + (x - xh) * (y - yh)
    end = lambda z, p, e, t: t + ((p - (t - (t - p))) + (z - (t - p)) + e)
    product = lambda x, y, z: let(lambda x, xh, y, yh, z, p: let(lambda z, p, e: let(end, z, p, e, p + z), z, p, error(x, xh, y, yh, p)), x, high(x), y, high(y), z, x * y)
    return let(product, a, b, c)


def combined(first: Column, second: Column) -> Column:
    def both(s: Column, b: Column) -> Column:
        k, delta = s["k"] + b["k"], b["mean"] - s["mean"]
        found = _state(k, fma(delta, b["k"] / k, s["mean"]), s["square"] + b["square"] + delta * delta * b["k"] * s["k"] / k)
        return F.when(b["k"] == 0, s).when(s["k"] == 0, b).otherwise(found)

    return F.aggregate(F.array(second), first, both)  # each state is computed once


def deviation(values: Column, start: Column | None = None) -> Column:
    """Sample standard deviation of an array of doubles; null for fewer than two."""
    return F.aggregate(values, _state(F.lit(0.0), F.lit(0.0), F.lit(0.0)) if start is None else start, _taken, _deviation)

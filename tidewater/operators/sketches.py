"""Rollups over stored sketches: distinct counts and quantiles at every level from one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: log2 of the buckets of distinct-count sketches: a relative error of about 1.04 / 2^6 = 1.6 % (one standard deviation).
BUCKETS = 12
#: Size of quantile sketches: a rank error of about 0.6 % at 99 % confidence.
SIZE = 500


def sketch(df: DataFrame, keys: Sequence[str], value: str, distinct: str) -> DataFrame:
    """keys, n, total, distinct_sketch and quantile_sketch: one row for each combination, made to be written and merged later.

    n counts rows and total sums values; nulls are in neither sketch. A null key is a key.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("total"),
        F.hll_sketch_agg(distinct, F.lit(BUCKETS)).alias("distinct_sketch"), F.expr(f"kll_sketch_agg_double(CAST({value} AS DOUBLE), {SIZE})").alias("quantile_sketch"),
    )


def rolled_up(stored: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.5, 0.9), cube: bool = False) -> DataFrame:
    """keys, level, n, total, distinct_estimate and a column for each quantile (p50, p90, ...) at every level of a rollup or cube.

    stored: the rows of `sketch`. Sketches are merged, so a level reads one row for each combination, not the table.
    level: bits of the keys that are summed over, the first key highest, as grouping_id gives it; so a null key is told apart
    from a sum. Totals are exact, estimates within the error of the sketches.
    """
    grouped = stored.cube(*keys) if cube else stored.rollup(*keys)
    merged = grouped.agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.hll_union_agg("distinct_sketch").alias("_d"), F.expr(f"kll_merge_agg_double(quantile_sketch, {SIZE})").alias("_q"),
    )
    named = {q: f"p{q * 100:g}" for q in quantiles}
    return merged.select(*keys, "level", "n", "total", F.hll_sketch_estimate("_d").alias("distinct_estimate"), *[F.expr(f"kll_sketch_get_quantile_double(_q, {q})").alias(n) for q, n in named.items()])

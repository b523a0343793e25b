"""Splits that keep groups whole: balanced folds and a holdout that favours high targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidewater.operators.ranks import group_buckets, ranked
from tidewater.sources.shared import checkpointed


def fold_pattern(sizes: dict[int, int], n_folds: int) -> dict[int, tuple[list[int], list[int]]]:
    """Largest group first, each to the lightest fold (ties: the first): for each size the folds that its groups get in turn.

    sizes: how many groups have each size. Once loads differ by less than the size, folds take turns for good, so a
    size is given by a start and a cycle, however many groups have it.
    """
    loads = [0] * n_folds
    out = {}
    for size in sorted(sizes, reverse=True):
        start, left = [], sizes[size]
        while left and max(loads) - min(loads) >= size:
            f = loads.index(min(loads))
            loads[f] += size
            start.append(f)
            left -= 1
        cycle = sorted(range(n_folds), key=lambda f: (loads[f], f))
        for i, f in enumerate(cycle):
            loads[f] += size * (left // n_folds + (i < left % n_folds))
        out[size] = (start, cycle)
    return out


def group_kfold(df: DataFrame, group: str, n_folds: int = 5) -> DataFrame:
    """df with fold; no group is in two folds, and folds are as balanced as greedy assignment makes them.

    Rows without a group are a group of their own. Groups of equal size are taken in the order of a hash. The driver gets a row for each distinct size; ranks within
    a size are computed in parts, and the assignment is joined in whatever way its size allows.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")).withColumn("_h", F.xxhash64(group))
    counts = {r[0]: r[1] for r in sizes.groupBy("_size").count().collect()}
    if not counts:
        return df.withColumn("fold", F.lit(0))
    pattern = [(s, a, c) for s, (a, c) in fold_pattern(counts, n_folds).items()]
    folds = df.sparkSession.createDataFrame(pattern, "_size long, _first array<int>, _cycle array<int>")
    most = group_buckets(max(counts.values()))
    placed = ranked(sizes, ["_size"], [F.col("_h"), F.col(group)], F.pmod(F.shiftright("_h", 20), F.lit(most)), "_at").join(folds, "_size")
    n = F.size("_first")
    later = F.get("_cycle", F.pmod(F.col("_at") - n, F.lit(n_folds)).cast("int"))
    fold = F.when(F.col("_at") < n, F.get("_first", F.col("_at").cast("int"))).otherwise(later)
    named = placed.select(F.col(group).alias("_g"), fold.alias("fold"))
    return df.join(named, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


@dataclass
class HoldoutSettings:
    valid_group_ratio: float = 0.2
    high_pool_ratio: float = 0.2
    high_group_ratio: float = 0.3
    random_state: int = 42


def target_heavy_split(df: DataFrame, group: str, target: str, s: HoldoutSettings | None = None) -> DataFrame:
    """df with is_valid. Groups are ranked by falling mean target (ties go by group, null last); so many of the held-out
    groups come from the pool of the highest means and the rest from the others, each drawn by a seeded hash.

    Rows without a group are a group of their own. Ranks are computed in parts cut at quantiles of the means; the driver
    gets a few numbers.
    """
    s = s or HoldoutSettings()
    means = df.groupBy(F.col(group).alias("_g")).agg(F.avg(target).alias("_m"))
    falling = -F.coalesce(F.col("_m"), F.lit(float("-inf")))
    held = checkpointed(means.withColumn("_o", falling).withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(s.random_state)), F.col("_g").cast("string")))))
    n = held.count()
    n_valid, n_pool = int(n * s.valid_group_ratio), int(n * s.high_pool_ratio)
    n_high = int(n_valid * s.high_group_ratio)
    parts = group_buckets(n)
    cuts = held.agg(F.percentile_approx("_o", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c < F.col("_o")))
    placed = ranked(held, [], [F.col("_o"), F.col("_g").asc_nulls_last()], bucket, "_rank").withColumn("_high", F.col("_rank") < n_pool)
    by_draw = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long")
    drawn = ranked(placed, ["_high"], [F.col("_draw"), F.col("_g")], F.floor(by_draw * parts / float(1 << 32)).cast("int"), "_nth")
    chosen = drawn.select("_g", (F.col("_nth") < F.when(F.col("_high"), n_high).otherwise(n_valid - n_high)).alias("is_valid"))
    return df.drop("is_valid").join(chosen, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")

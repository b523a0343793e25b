"""Blends of predictions, their grids, weights and post-processing. Rows are always matched by key."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.nulls import floor_at

# Steps of the sample weights and the grids that are searched.
HIGH_STEPS = ((100, 8.0), (50, 4.0), (40, 2.0))
LOW_STEPS = ((1, 8.0), (10, 4.0), (20, 2.0))
DELAY_STEPS = ((100, 8.0), (50, 5.0), (40, 3.0))
RISK_FACTORS = (0.005, 0.01, 0.015, 0.02, 0.03)
QUANTILE_WEIGHTS = tuple(round(0.025 * i, 3) for i in range(25))
SPECIALIST_GRID = {
    "high_base": (0.0, 0.025, 0.05, 0.075),
    "high50_coef": (0.0, 0.05, 0.1, 0.2, 0.3),
    "high100_coef": (0.0, 0.1, 0.2, 0.4, 0.6),
    "max_high": (0.15, 0.25, 0.35, 0.45),
    "low_coef": (0.0, 0.05, 0.1, 0.2, 0.3),
    "max_low": (0.1, 0.2, 0.3),
}
ENSEMBLE_BEST, ENSEMBLE_FIRST, ENSEMBLE_SECOND = (0.5, 0.6, 0.7, 0.8), (0.0, 0.25, 0.34, 0.5), (0.0, 0.25, 0.33, 0.5)


def _steps(target: Column, steps: Iterable[tuple[float, float]], low: bool = False) -> Column:
    out = None
    for edge, weight in steps:
        hit = target < edge if low else target >= edge
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    return out.otherwise(1.0)


def high_weight(target: Column) -> Column:
    return _steps(target, HIGH_STEPS)


def low_weight(target: Column) -> Column:
    return _steps(target, LOW_STEPS, low=True)


def delay_weight(target: Column) -> Column:
    return _steps(target, DELAY_STEPS)


def blend(a: Column, b: Column, weight: float | Column) -> Column:
    """(1 - weight) a + weight b, not below 0."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return floor_at((1 - w) * a + w * b)


def low_delay(prediction: Column, p_low: Column, at: float = 0.7, scale: float = 0.8, shift: float = 1.0) -> Column:
    """Where a target under 1 is likely, the prediction is scaled and lowered."""
    return floor_at(F.when(p_low >= at, scale * prediction - shift).otherwise(prediction))


def soft_weights(p50: Column, p100: Column, p_low: Column, g: dict[str, Column | float]) -> tuple[Column, Column]:
    c = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in g.items()}
    high = c["high_base"] + c["high50_coef"] * p50 + c["high100_coef"] * p100
    low = c["low_coef"] * p_low
    return F.least(F.greatest(high, F.lit(0.0)), c["max_high"]), F.least(F.greatest(low, F.lit(0.0)), c["max_low"])


def specialist(base: Column, high: Column, low: Column, p50: Column, p100: Column, p_low: Column, g: dict[str, Column | float]) -> Column:
    """base drawn towards two specialists by gated weights."""
    hw, lw = soft_weights(p50, p100, p_low, g)
    return floor_at(base + hw * (high - base) + lw * (low - base))


def risk_variants(df: DataFrame, prediction: str, risk: str, factors: Iterable[float] = RISK_FACTORS, split: str | None = None) -> DataFrame:
    """A row for each factor: the prediction raised by factor times the risk, as a share of the largest (1 at least).

    A missing risk counts 0, a missing prediction stays missing, and rows without a split are a split of their own.
    """
    r = F.coalesce(F.col(risk).cast("double"), F.lit(0.0))
    keys = [split] if split else []
    most = df.groupBy(*keys).agg(F.greatest(F.max(r), F.lit(1.0)).alias("_max"))
    most = most.withColumnRenamed(split, "_split") if split else most
    both = df.join(F.broadcast(most), F.col(split).eqNullSafe(F.col("_split")), "left").drop("_split") if split else df.crossJoin(F.broadcast(most))  # a row for each split
    each = both.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    return each.withColumn("adjusted", floor_at(F.col(prediction) * (1 + F.col("factor") * r / F.col("_max")))).drop("_max")


def weight_grid(df: DataFrame, models: dict[str, str], base: str, target: str, validation: str, weights: Iterable[float] = QUANTILE_WEIGHTS) -> DataFrame:
    """q_model, weight, validation and mae for each blend of base with each model. Rows are expanded only before partial sums."""
    ws = [float(w) for w in weights]
    long = df.select(validation, F.col(target).alias("_t"), F.col(base).alias("_b"), F.explode(F.array(*[F.struct(F.lit(n).alias("q_model"), F.col(c).alias("q")) for n, c in models.items()])).alias("m"))
    errors = [F.avg(F.abs(F.col("_t") - blend(F.col("_b"), F.col("m.q"), w))).alias(f"e{i}") for i, w in enumerate(ws)]
    wide = long.groupBy(F.col("m.q_model").alias("q_model"), validation).agg(*errors)
    pairs = F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"e{i}").alias("mae")) for i, w in enumerate(ws)])
    return wide.select("q_model", validation, F.explode(pairs).alias("x")).select("q_model", "x.weight", validation, "x.mae")


def wide_grid(long: DataFrame, validation: str, names: tuple[str, ...], value: str = "mae") -> DataFrame:
    """Measures of each validation side by side."""
    keys = [c for c in long.columns if c not in (validation, value)]
    out = long.groupBy(*keys).pivot(validation, list(names)).agg(F.first(value))
    return out.select(*keys, *[F.col(n).alias(f"{n}_{value}") for n in names])


def specialist_grid(df: DataFrame, columns: dict[str, str], validation: str, grid: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """mae of every combination of the grid for each validation.

    columns: names for base, high, low, p50, p100, p_low and target. A missing specialist counts as the base and a
    missing probability as 0; rows without a base or a target have no error and aren't counted, as in an average of
    SQL; a missing validation is one of its own. Each Arrow batch becomes sums of errors for all combinations, so that
    no row is multiplied; the sums of all batches are then added up.
    """
    grid = grid or SPECIALIST_GRID
    names, combos = list(grid), np.array(list(product(*grid.values())))
    g = {n: combos[:, i] for i, n in enumerate(names)}
    schema = "validation string, combo int, total double, n long"

    def run(source):
        for batch in source:
            valid = np.array(batch.column(0).to_pylist(), object)
            base, high, low, p50, p100, p_low, y = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, 8))
            for v in dict.fromkeys(valid.tolist()):
                rows = np.array([i for i, x in enumerate(valid) if x == v])
                total = np.zeros(len(combos))
                for at in range(0, len(rows), 512):
                    i = rows[at : at + 512, None]
                    hw = np.clip(g["high_base"] + g["high50_coef"] * p50[i] + g["high100_coef"] * p100[i], 0, g["max_high"])
                    lw = np.clip(g["low_coef"] * p_low[i], 0, g["max_low"])
                    pred = np.maximum(base[i] + hw * (high[i] - base[i]) + lw * (low[i] - base[i]), 0)
                    total += np.abs(pred - y[i]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(combos), pa.string()), pa.array(np.arange(len(combos), dtype=np.int32)), pa.array(total), pa.array([len(rows)] * len(combos), pa.int64())], ["validation", "combo", "total", "n"])

    c = {k: F.col(n).cast("double") for k, n in columns.items()}
    known = df.filter(c["base"].isNotNull() & c["target"].isNotNull())
    whole = {k: F.coalesce(c[k], c["base"]) for k in ("high", "low")} | {k: F.coalesce(c[k], F.lit(0.0)) for k in ("p50", "p100", "p_low")}
    ready = known.select(F.col(validation).cast("string").alias("_v"), *[(whole | c if k in ("base", "target") else whole)[k].alias(f"_{k}") for k in ("base", "high", "low", "p50", "p100", "p_low", "target")])
    sums = ready.mapInArrow(run, schema).groupBy("validation", "combo").agg((F.sum("total") / F.sum("n")).alias("mae"))
    values = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in grid.values()])
    out, stride = sums, len(combos)
    for i, n in enumerate(names):
        stride //= len(grid[n])
        out = out.withColumn(n, values[i][(F.floor(F.col("combo") / stride) % len(grid[n])).cast("int")])
    return out.drop("combo").withColumnRenamed("validation", validation)


def ensemble_weights() -> list[tuple[float, float, float, float]]:
    """Weights of the best blend and three models; what the best leaves is shared out in proportion."""
    out = []
    for best, first, second in product(ENSEMBLE_BEST, ENSEMBLE_FIRST, ENSEMBLE_SECOND):
        third = max(0.0, 1 - first - second)
        total = first + second + third
        if total:
            out.append((best, *((1 - best) * x / total for x in (first, second, third))))
    return out


def ensemble_grid(df: DataFrame, best: str, first: str, second: str, third: str, target: str) -> DataFrame:
    """w_best, w_lgbm, w_xgb, w_cat and mae of every weighting, in one aggregation."""
    weights = ensemble_weights()
    mix = lambda w: sum((F.lit(float(x)) * F.col(c) for x, c in zip(w[1:], (first, second, third))), F.lit(float(w[0])) * F.col(best))
    wide = df.agg(*[F.avg(F.abs(F.col(target) - mix(w))).alias(f"e{i}") for i, w in enumerate(weights)])
    rows = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(w, ("w_best", "w_lgbm", "w_xgb", "w_cat"))], F.col(f"e{i}").alias("groupkfold_mae")) for i, w in enumerate(weights)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def mean_of(*predictions: Column) -> Column:
    return sum(predictions[1:], predictions[0]) / len(predictions)


def assemble(template: DataFrame, predictions: dict[str, DataFrame], key: str = "ID", value: str = "pred") -> DataFrame:
    """The template's rows with a column for each model's prediction, by key."""
    out = template
    for name, df in predictions.items():
        out = out.join(df.select(key, F.col(value).alias(name)), key, "left")
    return out


def check_same_targets(a: DataFrame, b: DataFrame, key: str = "ID", target: str = "target", tolerance: float = 1e-9) -> DataFrame:
    """How many rows one frame lacks or has with another target: one row of counts."""
    both = a.select(key, F.col(target).alias("_a")).join(b.select(key, F.col(target).alias("_b")), key, "full")
    differ = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.abs(F.col("_a") - F.col("_b")) > tolerance)
    return both.agg(F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("n_unmatched"), F.count(F.when(differ, 1)).alias("n_differ"))


"""Reports over predictions: summaries, bins, group statistics, ranking measures and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewater.functions.nulls import zero
from tidewater.operators.quantiles import exact_quantiles, with_quantiles

#: Labels of the target bins, which are closed on the right.
BINS = ("<20", "20-40", "40-50", "50-100", "100+")
BIN_EDGES = (20.0, 40.0, 50.0, 100.0)


def target_bin(c: Column) -> Column:
    """Number of the bin, closed on the right: 20 is in the first one."""
    out = F.lit(len(BIN_EDGES))
    for i in reversed(range(len(BIN_EDGES))):
        out = F.when(c <= BIN_EDGES[i], F.lit(i)).otherwise(out)
    return F.when(c.isNotNull(), out)


def bin_dimension(df: DataFrame, n: int = len(BINS)) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, BINS[i]) for i in range(n)], "bin int, target_bin string")


def prediction_frame(df: DataFrame, target: str, prediction: str, key: str = "ID", group: str | None = None) -> DataFrame:
    """key, target, pred, error, abs_error, group and bin of each row; predictions are not below 0."""
    pred = F.when(F.col(prediction).isNotNull(), F.greatest(F.col(prediction), F.lit(0.0)))
    named = df.select(F.col(key), F.col(target).cast("double").alias("target"), pred.alias("pred"), *([F.col(group).alias("group")] if group else []))
    return named.select("*", (F.col("pred") - F.col("target")).alias("error"), F.abs(F.col("pred") - F.col("target")).alias("abs_error"), target_bin(F.col("target")).alias("bin"))


# Quantiles of the summary.
SUMMARY_QUANTILES = {"target_median": ("target", 0.5), "pred_median": ("pred", 0.5), "pred_p90": ("pred", 0.9), "pred_p95": ("pred", 0.95), "pred_p99": ("pred", 0.99)}


def summary_columns() -> list[Column]:
    """All of the summary but its quantiles."""
    t, p = F.col("target"), F.col("pred")
    out = [F.count(F.lit(1)).alias("n_rows"), F.avg("abs_error").alias("mae")]
    for n, c in (("target", t), ("pred", p)):
        out += [F.avg(c).alias(f"{n}_mean"), F.max(c).alias(f"{n}_max")]
    for k in (50, 100):
        high = t >= k
        out += [
            F.count(F.when(high, 1)).alias(f"high{k}_count"),
            F.avg(zero(high.cast("double"))).alias(f"high{k}_ratio"),
            F.avg(F.when(high, t)).alias(f"high{k}_target_mean"),
            F.avg(F.when(high, p)).alias(f"high{k}_pred_mean"),
            F.avg(F.when(high, F.col("abs_error"))).alias(f"high{k}_mae"),
        ]
    return out


def summary(frame: DataFrame, *keys: str) -> DataFrame:
    """One row (for each combination of keys) over a prediction frame; measures of high rows are null without such rows.

    Combinations of keys have to be few, such as models or validations.
    """
    quantiles = exact_quantiles(frame, {"target": F.col("target"), "pred": F.col("pred")}, SUMMARY_QUANTILES, keys)
    return with_quantiles(frame.groupBy(*keys).agg(*summary_columns()), quantiles, keys)


def bin_report(frame: DataFrame) -> DataFrame:
    """A row for each bin, empty ones included."""
    found = frame.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg("target").alias("target_mean"), F.avg("pred").alias("pred_mean"), F.avg("abs_error").alias("mae"), F.max("pred").alias("pred_max"), F.max("target").alias("target_max"))
    return bin_dimension(frame).join(found, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def group_statistics(df: DataFrame, group: str, target: str) -> DataFrame:
    """A row for each group; groups are many and short (the median holds the distinct targets of one group)."""
    t = F.col(target)
    shares = [F.avg(zero((t >= k).cast("double"))).alias(f"high{k}_ratio") for k in (50, 100, 200)]
    return df.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(t).alias("target_mean"), F.percentile(t, F.lit(0.5)).alias("target_median"), F.max(t).alias("target_max"), zero(F.stddev_samp(t)).alias("target_std"), *shares)


def fold_report(df: DataFrame, fold: str, group: str, target: str = "target", prediction: str = "pred") -> DataFrame:
    t, p = F.col(target), F.col(prediction)
    return df.groupBy(fold).agg(F.count(F.lit(1)).alias("n_valid"), F.countDistinct(group).alias("n_groups"), F.avg(t).alias("valid_target_mean"), F.max(t).alias("valid_target_max"), F.avg(p).alias("pred_mean"), F.max(p).alias("pred_max"), F.avg(F.abs(t - p)).alias("mae"))


def mae_gap(train: DataFrame, valid: DataFrame) -> DataFrame:
    both = train.agg(F.avg("abs_error").alias("train_mae")).crossJoin(valid.agg(F.avg("abs_error").alias("valid_mae")))  # a row each
    return both.withColumn("gap", F.col("valid_mae") - F.col("train_mae"))


def describe(df: DataFrame, column: str, quantiles: tuple[float, ...] = (0.01, 0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    c = F.col(column)
    found = exact_quantiles(df, {"c": c}, {f"p{q * 100:g}": ("c", q) for q in quantiles})
    return with_quantiles(df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")), found)


def shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each category among the rows that have one."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(column, "n", (F.col("n") / F.col("_all")).alias("share"))  # one row of totals


def class_rates(df: DataFrame, column: str, classes: int) -> DataFrame:
    """Count and share of each class from 0 on, absent ones as 0."""
    total = df.agg(F.count(column).alias("_all"))
    found = df.groupBy(F.col(column).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    out = every.join(found, "class", "left").crossJoin(F.broadcast(total))  # one row of totals
    return out.select("class", F.coalesce("n", F.lit(0)).alias("n"), zero(F.try_divide("n", "_all")).alias("rate"))


def importance(df: DataFrame) -> DataFrame:
    """Mean importance (and splits, where df counts them) of each feature over folds, largest first."""
    counted = [F.avg("splits").alias("splits")] if "splits" in df.columns else []
    return df.groupBy("feature").agg(F.avg("importance").alias("importance"), *counted, F.count(F.lit(1)).alias("n_folds")).orderBy(F.desc("importance"), "feature")


def by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives of each distinct score: all that the ranking measures need."""
    rows = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def auc(df: DataFrame, label: str, score: str, parts: int = 64) -> DataFrame:
    """Exact area under the ROC curve (ties count half) and average precision over distinct scores, one row.

    Scores are cut into ranges at quantiles; running sums within a range start from the sums of the ranges above, so
    that no task orders all scores.
    """
    points = by_score(df, label, score)
    bounds = points.agg(F.percentile_approx("s", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    ranged = points.withColumn("_r", F.size(F.filter(cuts, lambda b: b <= F.col("s").cast("double"))))
    sums = ranged.groupBy("_r").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # at most `parts` rows
    starts = sums.select("_r", zero(F.sum("_p").over(above)).alias("_p0"), zero(F.sum("_n").over(above)).alias("_n0"))
    within = Window.partitionBy("_r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.join(F.broadcast(starts), "_r").select("pos", "neg", (F.sum("pos").over(within) + F.col("_p0")).alias("tp"), (F.sum("neg").over(within) + F.col("_n0")).alias("fp"))
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    area = F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg"))
    precision = F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos"))
    return run.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), area.alias("auc"), precision.alias("average_precision"))


def class_scores(df: DataFrame, label: str, probabilities: str, floor: float = 1e-7) -> DataFrame:
    """Accuracy of the first most likely class and log loss with clipped probabilities."""
    p = F.col(probabilities)
    own = F.try_element_at(p, F.col(label).cast("int") + 1)
    kept = F.least(F.greatest(own, F.lit(floor)), F.lit(1 - floor))
    right = F.array_position(p, F.array_max(p)) - 1 == F.col(label)
    return df.agg(F.avg(right.cast("double")).alias("accuracy"), (-F.avg(F.log(kept))).alias("log_loss"))


def submission_statistics(df: DataFrame, prediction: str) -> DataFrame:
    c = F.col(prediction)
    return with_quantiles(df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(c).alias("mean"), F.max(c).alias("max")), exact_quantiles(df, {"c": c}, {"p95": ("c", 0.95)}))


def compare(a: DataFrame, b: DataFrame, prediction: str, key: str = "ID", tolerance: float = 1e-12) -> DataFrame:
    """How far two sets of predictions differ; rows that one lacks count as not equal."""
    x, y = F.col("_a"), F.col("_b")
    both = a.select(key, F.col(prediction).alias("_a")).join(b.select(key, F.col(prediction).alias("_b")), key, "full")
    d = F.abs(x - y)
    alike = F.coalesce(d <= tolerance, x.isNull() & y.isNull())
    return both.agg(
        F.bool_and(F.coalesce(x == y, x.isNull() & y.isNull())).cast("int").alias("exact_equal"),
        F.bool_and(alike).cast("int").alias("allclose_1e_12"),
        F.max(d).alias("max_abs_diff"),
        F.avg(d).alias("mean_abs_diff"),
        F.count(F.when(d > tolerance, 1)).alias("num_diff_gt_1e_12"),
        F.avg(x).alias("reference_pred_mean"),
        F.avg(y).alias("candidate_pred_mean"),
    )


def union_reports(*reports: DataFrame) -> DataFrame:
    """Reports below each other by column name; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)

"""The prediction pipeline end to end: features, gates, models, blends, checks. Every stage is a table and is skipped if it is there."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.ml import models
from tidewater.ml.boosting import Trees
from tidewater.operators import blend, features, fill, reports, split, validate
from tidewater.operators.features import SCENARIO
from tidewater.registry import Registry, lineage
from tidewater.sources import tables

TARGET = "avg_delay_minutes_next_30m"
IDS = ("ID", "scenario_id", "layout_id", "split", "timeslot", "layout_type", TARGET)


@dataclass
class Settings:
    """windows and lags: what the base matrix keeps; blend_weight: share of the quantile model; bins: the delay bins
    whose probabilities become features; top: how many columns the last models get, by gain."""

    root: str
    windows: tuple[int, ...] = (19, 20)
    lags: tuple[int, ...] = (1, 2, 3, 5, 10)
    folds: int = 5
    alpha: float = 0.55
    blend_weight: float = 0.325
    trees: Trees = field(default_factory=lambda: Trees(patience=10, group="scenario_id"))
    bin_trees: Trees | None = None
    context: bool = True
    context_windows: tuple[int, ...] = features.CONTEXT_WINDOWS
    neighbour: bool = True
    first4: bool = True
    persistence: bool = True
    bins: tuple[str, ...] = ("wide_tail", "stable")
    top: int = 500
    last_rounds: int = 30
    high: dict = field(default_factory=lambda: {"high_base": 0.0, "high50_coef": 0.0, "high100_coef": 0.6, "max_high": 0.35, "low_coef": 0.3, "max_low": 0.3})


#: Edges of the delay bins by name.
BINS = {"wide_tail": features.WIDE_TAIL, "stable": features.STABLE}


def feature_store(panel: DataFrame, layout: DataFrame, s: Settings) -> DataFrame:
    """All base features behind one shuffle by scenario; of rolls only the windows that are kept or that other features need are planned."""
    df = features.add_bottleneck(features.add_layout(panel, layout))
    df = SCENARIO.with_slot(df)
    df = features.add_lags(df, lags=s.lags, diffs=s.lags)
    df = features.add_rolling(df, windows=sorted({*s.windows, *(features.NEIGHBOUR_WINDOWS if s.neighbour else ())}))
    df = features.add_scenario_risk(features.add_late_pressure(df))
    if s.first4:
        df = features.add_first4(df)
    return features.add_persistence(df) if s.persistence else df


def columns_of(df: DataFrame) -> list[str]:
    return Registry.of(df, without=(*IDS, "fold")).select()


def context_features(df: DataFrame, layout: DataFrame, windows: Sequence[int] = features.CONTEXT_WINDOWS) -> DataFrame:
    """Backlog, ranks within the scenario, context of the base prediction, layout types, and rolling context."""
    df = df.join(layout.select("layout_id", "layout_type"), "layout_id", "left")
    df = features.add_layout_encoding(df)
    df = features.add_prediction_context(features.add_scenario_rank(features.add_backlog(df)), "base_pred")
    return features.add_context_rolling(df, features.context_columns(df, "base_pred"), windows=windows)


def run(spark: SparkSession, directory: str, s: Settings, template: str | None = None) -> DataFrame:
    """Predictions for the test rows (ID and the target's name), in the template's order where one is given."""
    panel, layout = tables.load_panel(spark, directory)
    at = lambda name: f"{s.root}/{name}"
    folds = tables.stage(spark, at("folds"), lambda: split.group_kfold(panel.filter("split = 'train'").select("ID", "scenario_id"), "scenario_id", s.folds).select("ID", "fold"))

    def store() -> DataFrame:
        df = tables.stage(spark, at("windows"), lambda: feature_store(panel, layout, s))  # quantiles and features are taken from one table
        if s.neighbour:
            df = features.add_neighbour(df)
            extra = set(features.NEIGHBOUR_WINDOWS) - set(s.windows)
            df = df.drop(*[n for n, f in lineage(df).items() if f.kind == "roll" and f.window in extra])
        return fill.fill(df, columns_of(df), "linear", SCENARIO).join(folds, "ID", "left")

    base = tables.stage(spark, at("features"), store)
    names = columns_of(base)

    def model(name: str, df: DataFrame, fit: models.Fit, out: str) -> DataFrame:
        """Out-of-fold predictions of the training rows and mean predictions of the test rows, by ID; importances and kept rounds are written beside them."""

        def make() -> DataFrame:
            found = models.cross_fit(df.filter("split = 'train'"), df.filter("split = 'test'"), fit, out=out, folds=s.folds)
            tables.publish(found.importance, at(f"{name}_importance"))
            tables.publish(found.rounds, at(f"{name}_rounds"))
            return found.oof.select("ID", out).unionByName(found.test.select("ID", out))

        return tables.stage(spark, at(name), make)

    y = features.labels(F.col(TARGET))
    labelled = base.withColumns({f"y_{k}": c for k, c in y.items()})
    gates = {k: model(f"gate_{k}", labelled, models.binary_classifier(names, f"y_{k}", s.trees), f"p_{k}") for k in y}
    bins = {}
    for spec in s.bins:
        placed = base.withColumn("y_bin", features.digitise(F.col(TARGET), BINS[spec]).cast("int"))
        bins[spec] = model(f"bins_{spec}", placed, models.class_probabilities(names, "y_bin", len(BINS[spec]) - 1, s.bin_trees or s.trees), "p_bin")

    def with_probabilities() -> DataFrame:
        df = base.join(gates["lt1"], "ID", "left")
        df = features.with_named(df, features.low_probability_features(F.col("p_lt1")), "probability").drop("p_lt1")
        for spec, found in bins.items():
            df = df.join(found, "ID", "left")
            df = features.with_named(df, features.bin_features(F.col("p_bin"), BINS[spec], f"delay_{spec}_prob"), "probability").drop("p_bin")
        return df

    low = tables.stage(spark, at("low"), with_probabilities)
    first = model("base_model", low, models.absolute_regressor(columns_of(low), TARGET, s.trees, log=True), "base_pred")
    quantile = model(tables.artifact_name("wide_tail", "quantile", s.alpha), low, models.quantile_regressor(columns_of(low), TARGET, s.alpha, quantile_trees(s.trees)), "q_pred")

    full = tables.stage(spark, at("context"), lambda: context_features(low.join(first, "ID"), layout, s.context_windows) if s.context else low.join(first, "ID"))
    wide = columns_of(full)
    main = model("context_model", full, models.absolute_regressor(wide, TARGET, s.trees, log=True), "main_pred")
    weighted = full.withColumns({"w_high": blend.high_weight(F.col(TARGET)), "w_low": blend.low_weight(F.col(TARGET))})
    special = {k: model(f"specialist_{k}", weighted, models.absolute_regressor(wide, TARGET, s.trees, log=True, weight=f"w_{k}"), f"{k}_pred") for k in ("high", "low")}

    def blended() -> DataFrame:
        df = base.select("ID", "split", "fold", TARGET)
        for other in (main, quantile, special["high"], special["low"], *gates.values()):
            df = df.join(other, "ID")
        mixed = df.withColumn("mix", blend.blend(F.col("main_pred"), F.col("q_pred"), s.blend_weight))
        soft = blend.specialist(F.col("mix"), F.col("high_pred"), F.col("low_pred"), F.col("p_high50"), F.col("p_high100"), F.col("p_lt1"), s.high)
        return mixed.withColumn("best", blend.low_delay(soft, F.col("p_lt1")))

    best = tables.stage(spark, at("blend"), blended)
    strongest = models.top_features(spark.read.parquet(at("context_model_importance")), s.top)
    fallbacks = {n: model(f"fallback_{n}", full, fit, n) for n, fit in models.fallback_models(strongest, TARGET, "scenario_id", s.last_rounds).items()}
    every = best
    for other in fallbacks.values():
        every = every.join(other, "ID")
    every = tables.stage(spark, at("ensemble_inputs"), lambda: every)
    train = every.filter("split = 'train'")
    inputs = ("best", "lgbm", "xgb", "cat")
    grid = blend.ensemble_grid(train, *inputs, TARGET)
    w = blend.top(grid, 1, "groupkfold_mae", "w_best", "w_lgbm", "w_xgb").first()
    mix = sum((F.lit(float(w[f"w_{c}"])) * F.col(c) for c in inputs[1:]), F.lit(float(w["w_best"])) * F.col("best"))
    stacking = models.ridge_stack(inputs, TARGET)
    stack = stacking(train)
    held_out = models.cross_fit(train, None, stacking, out="stacked", folds=s.folds).oof  # no training row is predicted by a stack that saw it
    stacked = held_out.select("ID", "stacked").unionByName(stack(every.filter("split = 'test'"), "stacked").select("ID", "stacked"))
    done = every.join(stacked, "ID").withColumns({"weighted": blend.blend(mix, mix, 0.0), "averaged": blend.mean_of(*map(F.col, inputs))})
    final = tables.stage(spark, at("final"), lambda: done)

    known = final.filter("split = 'train'")
    report = lambda c: reports.summary(reports.prediction_frame(known, TARGET, c)).withColumn("model_name", F.lit(c))
    tables.publish(reports.union_reports(*map(report, (*inputs, "weighted", "averaged", "stacked"))), at("summary"))
    tables.publish(reports.bin_report(reports.prediction_frame(known, TARGET, "weighted")), at("bin_report"))
    out = final.filter("split = 'test'").select("ID", F.col("weighted").alias(TARGET))
    if template:
        wanted = tables.load_template(spark, template).select("ID", "ord")
        out = wanted.join(out, "ID", "left")
        validate.validate(out, wanted, TARGET)
    tables.publish(out, at("submission"))
    tables.write_json(spark, {"weights": {k: w[k] for k in ("w_best", "w_lgbm", "w_xgb", "w_cat")}, "ridge_alpha": stack.alpha, "rows": out.count(), "columns": len(wide), "last_columns": len(strongest)}, at("manifest.json"))
    return spark.read.parquet(at("submission"))


def quantile_trees(t: Trees) -> Trees:
    """The quantile model takes larger steps in fewer rounds, as each writes its state."""
    return replace(t, rounds=min(t.rounds, 15), rate=max(t.rate, 0.2), depth=min(t.depth, 4))


def main() -> None:
    p = argparse.ArgumentParser(description="Run the prediction pipeline over train, test and layout_info below a folder.")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--template", help="a CSV or Parquet file that fixes which rows are predicted, and their order")
    p.add_argument("--reference", help="earlier predictions (ID and the target) to compare with")
    a = p.parse_args()
    spark = SparkSession.builder.appName("tidewater").getOrCreate()
    out = run(spark, a.input, Settings(a.output), a.template)
    if a.reference:
        reports.compare(tables.read_table(spark, a.reference), out, TARGET).show(truncate=False)


if __name__ == "__main__":
    main()

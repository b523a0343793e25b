"""Two validations of a model, and searches over feature sets that use them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.ml import models
from tidewater.ml.boosting import Trees
from tidewater.operators import features, fill, hygiene, reports, search, split
from tidewater.operators.features import SCENARIO
from tidewater.registry import MODES, OPTIONAL, Registry, prune_by_importance
from tidewater.sources import tables
from tidewater.sources.shared import drop_written, written

GROUPED, HOLDOUT = "groupkfold", "target_heavy_holdout"

#: What makes a fit from the names of feature columns.
Maker = Callable[[Sequence[str]], models.Fit]


def grouped(df: DataFrame, fit: models.Fit, target: str, group: str, folds: int = 5, key: str = "ID", splits: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prediction frame over out-of-fold predictions, fold report with the rounds that each fold's model kept, and importances. A column `fold` is taken as it is."""
    placed = df if "fold" in df.columns else split.group_kfold(df, group, folds)
    found = models.cross_fit(placed, None, fit, key=key, folds=folds, splits=splits)
    report = reports.fold_report(found.oof, "fold", group, target, "pred").join(F.broadcast(found.rounds), "fold", "left")  # a row for each fold
    return reports.prediction_frame(found.oof, target, "pred", key, group), report, found.importance


def holdout(df: DataFrame, fit: models.Fit, target: str, group: str, s: split.HoldoutSettings | None = None, key: str = "ID") -> DataFrame:
    """Prediction frame over held-out groups, which favour high targets. A column `is_valid` is taken as it is."""
    placed = df if "is_valid" in df.columns else split.target_heavy_split(df, group, target, s)
    model = fit(placed.filter(~F.col("is_valid")))
    return reports.prediction_frame(model(placed.filter("is_valid"), "pred"), target, "pred", key, group)


def dual(df: DataFrame, fits: dict[str, models.Fit], target: str, group: str, root: str, folds: int = 5, s: split.HoldoutSettings | None = None) -> DataFrame:
    """Both validations of each model. Writes predictions (by model and validation), summaries, bin, fold and group reports and
    importances below root, and returns the summaries: a row for each model and validation."""
    spark = df.sparkSession
    tables.publish(reports.group_statistics(df, group, target), f"{root}/group_statistics")
    made_of: dict[str, list[DataFrame]] = {"summary": [], "bin_report": [], "fold_report": [], "importance": []}
    for name, fit in fits.items():
        frame, fold_report, importance = grouped(df, fit, target, group, folds, splits=True)
        for validation, made in ((GROUPED, frame), (HOLDOUT, holdout(df, fit, target, group, s))):
            tables.write_predictions(made, f"{root}/predictions", name, validation)
            kept = tables.read_predictions(spark, f"{root}/predictions", name, validation)
            tag = lambda d, v=validation, n=name: d.withColumn("model_name", F.lit(n)).withColumn("validation", F.lit(v))
            made_of["summary"].append(tag(reports.summary(kept)))
            made_of["bin_report"].append(tag(reports.bin_report(kept)))
        made_of["fold_report"].append(fold_report.withColumn("model_name", F.lit(name)))
        made_of["importance"].append(reports.importance(importance).withColumn("model_name", F.lit(name)))
    for report, parts in made_of.items():
        tables.publish(reports.union_reports(*parts), f"{root}/{report}")
    return spark.read.parquet(f"{root}/summary")


#: Columns of the history that run_ablation gives, one row for each experiment.
HISTORY = (
    "experiment_name string, base_after_run string, hypothesis string, feature_count int, groupkfold_mae double, target_heavy_holdout_mae double, "
    "high50_mae double, high100_mae double, improved_target_heavy_holdout boolean, best_target_heavy_holdout_after_run double, removed_count int"
)


def feature_store(panel: DataFrame, windows: Sequence[int], steps: Sequence[int], optional: bool = True) -> DataFrame:
    """Lags, differences and rolls of a panel with a slot and the bottleneck features, and the optional kinds; filled, with what each column is in its metadata."""
    store = features.add_rolling(features.add_lags(panel, lags=steps, diffs=steps), windows=windows)
    if optional:
        store = features.add_persistence(features.add_slope(features.add_decay(features.add_cumsum(store))))
    return store


def _filled(store: DataFrame, target: str) -> tuple[DataFrame, Registry]:
    """The store, filled and written once, so that an evaluation reads its own columns and plans no window; and what its columns are."""
    registry = Registry.of(store, without=("ID", "scenario_id", "layout_id", "fold", target))
    done = fill.fill(store, [n for n in registry.select() if n != SCENARIO.slot], "linear", SCENARIO)
    return written(done, "feature_store"), registry


def _errors(frame: DataFrame) -> tuple[float, float | None, float | None]:
    """Mean absolute error over all rows, and over those with a target of 50 and of 100 at least."""
    high = lambda low: F.avg(F.when(F.col("target") >= low, F.col("abs_error")))
    return tuple(frame.agg(F.avg("abs_error"), high(50), high(100)).first())


def run_ablation(
    panel: DataFrame, target: str, windows: Sequence[int] = (5, 10, 20), steps: Sequence[int] = (1, 5), trees: Trees | None = None, log: bool = False, folds: int = 5,
    make: Maker | None = None, history: str | None = None, only: Sequence[str] | None = None,
) -> DataFrame:
    """The experiments of search.plan over the store of `panel`, each with both validations; a row of HISTORY for each.

    panel: a frame with a slot and the bottleneck features. Every experiment starts from the configuration that had the
    least error on the holdout so far; one that isn't marked `keep` changes it for itself alone. Hygiene switches look
    at the columns of the experiment on the training rows; low importance is no gain in the tail of an earlier
    experiment's ranking. make: what fits a set of columns (boosted trees for the absolute error, if not given); rows
    are appended to history, if given. only: names of the experiments to run.
    """
    spark = panel.sparkSession
    raw = feature_store(split.group_kfold(split.target_heavy_split(panel, "scenario_id", target), "scenario_id", folds), windows, steps)
    store, registry = _filled(raw, target)
    unfilled = written(raw.select("ID", *registry.select()), "feature_store_unfilled")  # hygiene looks at values before they are filled
    make = make or (lambda names: models.absolute_regressor(names, target, trees, log=log))
    idle: set[str] = set()
    best, best_name, base, rows = float("inf"), None, {"mode": "active"}, []
    plan = [search.Experiment("baseline", "all lags, differences and rolls", {}, keep=False), *search.plan(registry.kinds(), OPTIONAL, registry.windows(), [m for m in MODES if m != "active"])]

    def columns(config: dict) -> tuple[list[str], int]:
        names = registry.select(**{k: v for k, v in config.items() if k != "hygiene"})
        before, switches = len(registry.select(mode=config["mode"], groups=config.get("groups", ()))), set(config.get("hygiene", ()))
        gone: set[str] = set()
        if "high_missing" in switches:
            gone |= {r["column"] for r in hygiene.high_missing(unfilled, names).collect()}  # a row for each column
        if "near_constant" in switches:
            gone |= {r["column"] for r in hygiene.near_constant(unfilled, names).collect()}
        if "duplicate" in switches:
            gone |= set(hygiene.duplicates(unfilled, names, "ID"))
        if "low_importance" in switches:
            gone |= idle
        kept = [n for n in names if n not in gone]
        return kept, before - len(kept)

    try:
        for e in plan:
            if only and e.name not in only:
                continue
            config = base | {k: (*base.get(k, ()), *v) if k in ("without", "groups", "hygiene") else v for k, v in e.change.items()}
            names, removed = columns(config)
            df = store.select("ID", "scenario_id", target, "fold", "is_valid", *names)
            fit = make(names)
            frame, _, importance = grouped(df, fit, target, "scenario_id", folds)
            fold_mae = _errors(frame)[0]
            mae, high50, high100 = _errors(holdout(df, fit, target, "scenario_id"))
            improved = mae < best
            if improved:
                best, best_name = mae, e.name
                base = config if e.keep else base
            gains = {r["feature"]: r["v"] for r in importance.groupBy("feature").agg(F.avg("importance").alias("v")).collect()}  # a row for each column
            idle |= set(prune_by_importance(gains, registry=registry))
            row = (e.name, best_name, e.hypothesis, len(names), fold_mae, mae, high50, high100, improved, best, removed)
            rows.append(row)
            if history:
                tables.append_history(spark.createDataFrame([row], HISTORY), history)
    finally:
        drop_written(store, unfilled)
    return spark.createDataFrame(rows, HISTORY)


def window_search(
    panel: DataFrame, target: str, windows: Sequence[int], steps: Sequence[int], budget: int = 400, history: str | None = None, trees: Trees | None = None, log: bool = False,
    window_budget: int | None = None, width: int = 12, seeds: int = 8, first_steps: Sequence[int] | None = None, make: Maker | None = None, threads: int = 4,
) -> search.Combo:
    """The set of windows, and then of steps, with the least error on the holdout; see search.Search.

    panel: a frame with a slot and the bottleneck features. All windows and steps are computed, filled and split once
    and written; an evaluation reads the columns of its set, and those of one step run as concurrent jobs. With
    history, results are appended there in the order of the candidates, and a search that is started again evaluates
    none of them twice. Rows of the history: kind, roll_windows, lag_steps, mae, feature_count, best_iteration.
    """
    spark: SparkSession = panel.sparkSession
    store, registry = _filled(split.target_heavy_split(feature_store(panel, windows, steps, optional=False), "scenario_id", target), target)
    make = make or (lambda names: models.absolute_regressor(names, target, trees, log=log))
    known: dict[search.Combo, float] = {}
    if history and tables.exists(spark, history):
        known = {search.key(r.kind, r.windows, r.steps): r.mae for r in tables.read_history(spark, history).collect()}
    told: dict[tuple, tuple[int, int | None]] = {}

    def evaluate(chosen: tuple[int, ...], lags: tuple[int, ...]) -> float:
        names = registry.select(windows=chosen, lags=lags)
        df = store.select("ID", "scenario_id", target, "is_valid", *names)
        model = make(names)(df.filter(~F.col("is_valid")))
        told[chosen, lags] = (len(names), getattr(model, "rounds", None))
        frame = reports.prediction_frame(model(df.filter("is_valid"), "pred"), target, "pred", "ID", "scenario_id")
        return float(_errors(frame)[0])

    def remember(combo: search.Combo, error: float) -> None:
        if history:
            kind, chosen, lags = combo
            row = [(kind, " ".join(map(str, chosen)), " ".join(map(str, lags)), error, *told[chosen, lags])]
            tables.append_history(spark.createDataFrame(row, "kind string, roll_windows string, lag_steps string, mae double, feature_count int, best_iteration int"), history)

    found = search.Search(evaluate, tuple(windows), tuple(steps), budget, window_budget, width, seeds, tuple(first_steps) if first_steps is not None else None, known, remember, threads)
    try:
        return found.run()
    finally:
        drop_written(store)

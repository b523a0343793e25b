import itertools
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import registry
from tidewater.ml import evaluate, models
from tidewater.operators import features, fill, search
from tidewater.operators.features import SCENARIO

WINDOWS, STEPS = (2, 3, 5, 8, 20), (1, 2, 3, 5)


def toy(windows, steps):
    """Least for windows 3, 5 and 20 and steps 2 and 5, with a pull towards small sets."""
    return abs(sum(windows) - 28) + 0.1 * len(windows) + abs(sum(steps) - 7) / 3 + 0.01 * len(steps)


def subsets(every):
    return [s for k in range(1, len(every) + 1) for s in itertools.combinations(every, k)]


def test_two_phases_find_the_set_that_brute_force_finds():
    seen = []
    s = search.Search(lambda w, k: seen.append((w, k)) or toy(w, k), WINDOWS, STEPS, budget=400)
    best = s.run()
    assert best[1:] == min(((w, k) for w in subsets(WINDOWS) for k in subsets(STEPS)), key=lambda c: (toy(*c), c))
    assert len(seen) == len(set(seen)) == len(s.history)
    kinds = {k for k, _, _ in s.history}
    assert {"rolling_single", "rolling_beam", "lag_single", "lag_beam"} <= kinds
    assert all(w == best[1] for k, w, _ in s.history if k.startswith("lag"))


def test_budgets_hold_and_a_restart_repeats_nothing():
    calls, results = [], []
    make = lambda history, budget=24: search.Search(lambda w, k: calls.append((w, k)) or toy(w, k), WINDOWS, STEPS, budget, window_budget=14, history=history, on_result=lambda c, e: results.append(c))
    whole = make({})
    best = whole.run()
    assert len(calls) == 24 and sum(c[0].startswith("rolling") for c in results) == 14 and results == list(whole.history)
    for stop in (0, 3, 13, 14, 20, 24):  # as if the run had ended after so many results
        before, calls[:], results[:] = dict(list(whole.history.items())[:stop]), [], []
        again = make(dict(before))
        assert again.run() == best and list(again.history.items()) == list(whole.history.items())
        assert len(calls) == 24 - stop and not {(w, k) for _, w, k in before} & set(calls)


def test_candidates_of_a_step_run_at_the_same_time_but_are_remembered_in_order():
    together, order = threading.Barrier(len(WINDOWS), timeout=20), []

    def error(w, k):
        if len(w) == 1:
            together.wait()  # fails unless all five are evaluated at once
        return toy(w, k)

    search.Search(error, WINDOWS, (), on_result=lambda c, e: order.append(c[1]), threads=5).run()
    assert order[:5] == [(w,) for w in WINDOWS]


def panel(spark, scenarios=10, slots=12):
    r = np.random.default_rng(2)
    names = ("order_inflow_15m", "battery_mean", "congestion_score", "pack_utilization", "backorder_ratio", "low_battery_ratio", "robot_utilization", "robot_charging", "robot_shortage_ratio", "order_per_pack_station", "pack_station_count")
    rows = []
    for i in range(scenarios * slots):
        x = [float(v) for v in r.uniform(0, 1, len(names))]
        rows.append((f"{i:04}", f"s{i // slots}", i % slots, 30 * x[0] + 40 * x[2] + float(r.exponential(20)), *x))
    return spark.createDataFrame(rows, "ID string, scenario_id string, timeslot int, y double, " + ", ".join(f"{n} double" for n in names))


def test_what_columns_are_is_kept_through_selects_and_files(spark, tmp_path):
    df = features.add_persistence(features.add_slope(features.add_decay(features.add_cumsum(features.add_rolling(features.add_lags(panel(spark), lags=(1,), diffs=(2,)), windows=(3, 4))))))
    first = registry.Registry.of(df, without=("y",))
    assert first.kinds() == {"raw", "lag", "diff", "roll", "cumsum", "decay", "slope", "persistence"} and first.windows() == [3, 4]
    f = first.features
    assert (f["battery_mean_diff2"].kind, f["battery_mean_diff2"].base, f["battery_mean_diff2"].window) == ("diff", "battery_mean", 2)
    assert (f["congestion_vs_roll4"].window, f["congestion_vs_roll4"].how) == (4, "vs")
    filled = fill.fill(df, first.select(), "linear", SCENARIO).filter("timeslot > 2").join(df.select("ID", F.lit(1).alias("extra")), "ID")
    filled.write.parquet(f"{tmp_path}/store")
    read = spark.read.parquet(f"{tmp_path}/store")
    assert registry.lineage(read) == registry.lineage(df)
    renamed = read.withColumnRenamed("battery_mean_lag1", "x_roll9_mean")  # names are not read
    assert registry.Registry.of(renamed).features["x_roll9_mean"].kind == "lag"


def test_modes_groups_and_windows(spark):
    df = features.add_layout(panel(spark).drop("pack_station_count").withColumn("layout_id", F.lit(1)), spark.createDataFrame([(1, "grid", 2.0, 3.0, 4.0)], "layout_id int, layout_type string, pack_station_count double, robot_total double, charger_count double"))
    r = registry.Registry.of(features.add_cumsum(features.add_rolling(features.add_lags(df, lags=(1, 2), diffs=(1,)), windows=(3, 4))), without=("y", "layout_id"))
    kinds = lambda names: {r.features[n].kind for n in names}
    assert kinds(r.select(mode="roll_only")) == {"roll"}
    assert kinds(r.select(mode="roll_base")) == {"raw", "roll"}
    assert kinds(r.select(mode="roll_base_layout")) == {"raw", "layout", "roll"}
    assert kinds(r.select(mode="active")) == {"raw", "layout", "lag", "diff", "roll"}
    assert kinds(r.select(mode="active", groups=("cumsum",), without=("lag",))) == {"raw", "layout", "diff", "roll", "cumsum"}
    assert {r.features[n].window for n in r.select(mode="roll_only", windows=(4,))} == {4}
    assert {r.features[n].window for n in r.select(lags=(2,)) if r.features[n].kind == "lag"} == {2}
    with pytest.raises(ValueError):
        r.select(mode="other")


def linear(names):
    return models.linear_model(names, "y", 0.1)


def test_ablation_reports_both_validations_for_every_experiment(spark, few_partitions, tmp_path):
    only = ["baseline", "add_cumsum", "remove_duplicate", "remove_near_constant", "remove_high_missing", "roll_only"]
    df = panel(spark, 8, 10).withColumn("constant", F.lit(1.0)).withColumn("twin", F.col("battery_mean")).withColumn("empty", F.lit(None).cast("double"))
    got = evaluate.run_ablation(df, "y", (2, 4), (1,), folds=2, make=linear, history=f"{tmp_path}/history", only=only).collect()
    assert [r.experiment_name for r in got] == only
    assert got[0].__fields__ == [c.split()[0] for c in evaluate.HISTORY.split(", ")]
    assert spark.read.parquet(f"{tmp_path}/history").count() == len(only)
    best = float("inf")
    for r in got:
        assert r.groupkfold_mae > 0 and r.improved_target_heavy_holdout == (r.target_heavy_holdout_mae < best)
        best = min(best, r.target_heavy_holdout_mae)
        assert r.best_target_heavy_holdout_after_run == best
    size = {r.experiment_name: (r.feature_count, r.removed_count) for r in got}
    assert size["baseline"][1] == 0 and size["roll_only"][0] == 2 * (5 * 3 + 8)
    assert size["remove_duplicate"][1] >= 1 and size["remove_near_constant"][1] >= 1 and size["remove_high_missing"][1] >= 1


def test_window_search_runs_both_phases_and_starts_again(spark, few_partitions, tmp_path):
    path = f"{tmp_path}/history"
    run = lambda budget: evaluate.window_search(panel(spark, 8, 10), "y", (2, 3), (1, 2), budget, path, window_budget=3, make=linear)
    part = run(4)
    assert spark.read.parquet(path).count() == 4
    best = run(7)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == len({(r.roll_windows, r.lag_steps) for r in rows}) <= 7 and {r.kind.split("_")[0] for r in rows} == {"rolling", "lag"}
    assert min(r.mae for r in rows) == next(r.mae for r in rows if (r.roll_windows, r.lag_steps) == (" ".join(map(str, best[1])), " ".join(map(str, best[2]))))
    assert part[0].startswith(("rolling", "lag")) and run(7) == best and spark.read.parquet(path).count() == len(rows)

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import registry
from tidewater.operators import blend, hygiene, reports, search, split, validate
from tidewater.sources import tables


def predictions(spark, n=300):
    r = random.Random(2)
    return spark.createDataFrame([(i, f"g{i % 30}", round(r.expovariate(1 / 30), 2), round(r.uniform(-5, 90), 2), float(r.random()), float(r.random()), float(r.random())) for i in range(n)], "ID int, g string, target double, pred double, p50 double, p100 double, p_low double")


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(x,) for x in (19.9, 20.0, 40.0, 50.0, 100.0, 100.1)], "x double")
    assert [reports.BINS[r[0]] for r in df.select(reports.target_bin(F.col("x"))).collect()] == ["<20", "<20", "20-40", "40-50", "50-100", "100+"]


def test_empty_bins_and_high_rows(spark):
    df = spark.createDataFrame([(1, 5.0, 6.0), (2, 30.0, -1.0)], "ID int, target double, pred double")
    frame = reports.prediction_frame(df, "target", "pred")
    assert [(r.target_bin, r["count"]) for r in reports.bin_report(frame).orderBy("bin").collect()] == [("<20", 1), ("20-40", 1), ("40-50", 0), ("50-100", 0), ("100+", 0)]
    s = reports.summary(frame).first()
    assert (s.n_rows, s.high50_count, s.high50_mae, s.mae) == (2, 0, None, 15.5)


def test_auc_and_average_precision_with_ties(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 1), float(r.randint(0, 30))) for _ in range(500)]
    got = reports.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    area = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    ap, recall = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        ap += (tp / len(pos) - recall) * tp / (tp + fp)
        recall = tp / len(pos)
    assert got.auc == pytest.approx(area) and got.average_precision == pytest.approx(ap)
    one = reports.auc(spark.createDataFrame([(1, 2.0)], "y int, s double"), "y", "s").first()
    assert one.auc is None and one.average_precision == 1.0


def test_folds_keep_groups_and_balance(spark):
    df = predictions(spark)
    got = split.group_kfold(df, "g", 5)
    assert got.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert {r["count"] for r in got.groupBy("fold").count().collect()} == {60}
    assert split.fold_pattern({5: 1, 3: 2, 1: 1}, 2) == {5: ([], [0, 1]), 3: ([1], [1, 0]), 1: ([0], [0, 1])}


def test_fold_patterns_equal_one_by_one():
    r = random.Random(3)
    for _ in range(60):
        sizes, k = {r.randint(1, 40): r.randint(1, 30) for _ in range(6)}, r.randint(2, 6)
        loads, want = [0] * k, []
        for size in sorted(sizes, reverse=True):
            for _ in range(sizes[size]):
                f = loads.index(min(loads))
                loads[f] += size
                want.append(f)
        got = []
        for size, (start, cycle) in split.fold_pattern(sizes, k).items():
            got += [start[i] if i < len(start) else cycle[(i - len(start)) % k] for i in range(sizes[size])]
        assert got == want


def test_holdout_draws_whole_groups(spark):
    got = split.target_heavy_split(predictions(spark), "g", "target")
    groups = got.groupBy("g").agg(F.countDistinct("is_valid").alias("n"), F.max("is_valid").alias("v")).collect()
    assert all(r.n == 1 for r in groups) and sum(r.v for r in groups) == 6
    assert split.target_heavy_split(predictions(spark).limit(0), "g", "target").count() == 0


def test_rows_without_a_group_are_a_group(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, float(i)) for i in range(30)], "ID long, g long, target double")
    for placed, column in ((split.group_kfold(df, "g", 3), "fold"), (split.target_heavy_split(df, "g", "target"), "is_valid")):
        rows = placed.select("g", column).collect()
        assert len(rows) == 30 and all(len({r[1] for r in rows if r[0] == g}) == 1 for g in (None, 1, 2)) and all(r[1] is not None for r in rows)


def test_specialist_grid_equals_one_by_one(spark):
    df = predictions(spark).withColumns({"v": F.when(F.col("ID") % 2 == 0, "a").otherwise("b"), "high": F.col("pred") * 1.3, "low": F.col("pred") * 0.5})
    grid = {"high_base": (0.0, 0.1), "high50_coef": (0.2,), "high100_coef": (0.0, 0.5), "max_high": (0.2, 0.4), "low_coef": (0.3,), "max_low": (0.1, 0.2)}
    got = blend.specialist_grid(df, {"base": "pred", "high": "high", "low": "low", "p50": "p50", "p100": "p100", "p_low": "p_low", "target": "target"}, "v", grid).collect()
    assert len(got) == 2 * 16
    for r in random.Random(0).sample(got, 6):
        g = {k: r[k] for k in grid}
        c = blend.specialist(*[F.col(x) for x in ("pred", "high", "low", "p50", "p100", "p_low")], g)
        assert df.filter(F.col("v") == r.v).agg(F.avg(F.abs(F.col("target") - c))).first()[0] == pytest.approx(r.mae)


def test_weights_sum_to_one_and_blends_stay_between(spark):
    assert len(blend.ensemble_weights()) == 64 and all(abs(sum(w) - 1) < 1e-12 for w in blend.ensemble_weights())
    df = predictions(spark).withColumn("b", blend.blend(F.abs("pred"), F.col("target"), 0.3))
    assert df.filter("b < least(abs(pred), target) - 1e-9 or b > greatest(abs(pred), target) + 1e-9").count() == 0
    assert len(blend.QUANTILE_WEIGHTS) == 25 and np.prod([len(v) for v in blend.SPECIALIST_GRID.values()]) == 6000


def test_duplicates_see_type_order_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1, None, None), (2, 2, 2.0, 2, 5, None), (3, 3, 3.0, 4, None, 5)], "ID int, a int, b double, c int, d int, e int").withColumn("f", F.col("a"))
    assert hygiene.duplicates(df, ["a", "b", "c", "d", "e", "f"], "ID") == {"f": "a"}
    assert hygiene.prune(df.withColumn("k", F.lit(1)), ["a", "c", "f", "k"], "ID") == ["a", "c"]


def test_submission_checks(spark):
    template = spark.createDataFrame([(1, 0), (2, 1)], "ID int, ord long")
    validate.validate(spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.0)], "ID int, ord long, p double"), template, "p")
    for bad in ([(1, 0, 0.5)], [(1, 0, -1.0), (2, 1, 0.0)], [(1, 0, None), (2, 1, 0.0)], [(1, 1, 0.5), (2, 0, 0.0)], [(1, 0, 0.5), (1, 0, 0.5)], [(1, 0, 0.5), (3, 1, 0.5)]):
        with pytest.raises(ValueError):
            validate.validate(spark.createDataFrame(bad, "ID int, ord long, p double"), template, "p")


def test_registry_selects_by_kind():
    r = registry.Registry().add(["a", "a_lag1", "a_lag4", "a_diff2", "a_roll19_mean", "a_roll3_std", "a_vs_roll19", "a_ctxroll20_mean", "a_cumsum", "a_decay07"])
    assert r.select(windows=(19,), lags=(1, 2)) == ["a", "a_lag1", "a_diff2", "a_roll19_mean", "a_vs_roll19", "a_ctxroll20_mean", "a_cumsum", "a_decay07"]
    assert r.select(without=("roll", "lag", "diff", "context")) == ["a", "a_cumsum", "a_decay07"]
    weights = {f"f{i}": float(i) for i in range(40)} | {"z": 0.0, "y_roll3_mean": 0.0}
    assert registry.prune_by_importance(weights) == ["f0", "z"]


def test_search_finds_the_best_set_and_never_repeats():
    seen = []

    def error(windows, steps):
        seen.append((windows, steps))
        return abs(sum(windows) - 13) + 0.1 * len(windows)

    s = search.Search(error, windows=(2, 3, 5, 8, 20), budget=60)
    best = s.run()
    assert error(best[1], best[2]) == min(abs(sum(c) - 13) + 0.1 * k for k in range(1, 5) for c in itertools.combinations((2, 3, 5, 8, 20), k))
    assert len(s.history) <= 60
    assert search.neighbours((1,), (1, 2)) == [(1, 2), (2,)]


def test_ablation_keeps_what_helps():
    rows = search.ablation({"x": 5}, [search.Experiment("down", "", {"x": 3}), search.Experiment("up", "", {"x": 9})], lambda c: c["x"])
    assert [(r["improved"], r["best_mae"]) for r in rows] == [(True, 3), (False, 3)]


def test_sources(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "ID int, pred double")
    tables.write_predictions(df, f"{root}/p", "m", "a")
    tables.write_predictions(df.filter("ID = 1"), f"{root}/p", "m", "b")
    assert tables.read_predictions(spark, f"{root}/p", "m", "a").count() == 2 and tables.read_predictions(spark, f"{root}/p", "m", "b").count() == 1
    calls = []
    for _ in range(2):
        assert tables.stage(spark, f"{root}/s", lambda: calls.append(1) or df).count() == 2
    assert len(calls) == 1
    tables.write_csv(df.withColumn("ord", -F.col("ID")), f"{root}/c.csv", "ord")
    assert [r.ID for r in tables.load_template(spark, f"{root}/c.csv").orderBy("ord").collect()] == [2, 1]
    tables.append_history(spark.createDataFrame([("k", "20 19", "1 2", 1.0), ("k", "19 20", "2 1", 1.0), ("j", "", "1", 2.0)], "kind string, roll_windows string, lag_steps string, mae double"), f"{root}/h")
    tables.append_history(spark.createDataFrame([("k", "19 20", "1 2", 1.0)], "kind string, roll_windows string, lag_steps string, mae double"), f"{root}/h")
    assert sorted((r.kind, r.windows, r.steps) for r in tables.read_history(spark, f"{root}/h").collect()) == [("j", [], [1]), ("k", [19, 20], [1, 2])]
    tables.write_json(spark, {"a": 1}, f"{root}/m.json")
    assert (tmp_path / "m.json").read_text() == '{\n  "a": 1\n}'
    with pytest.raises(FileNotFoundError):
        tables.require(spark, [f"{root}/none"])
    assert [r.available for r in tables.describe_artifacts(spark, {"a": f"{root}/s", "b": f"{root}/none"}).orderBy("name").collect()] == [True, False]
    assert tables.artifact_name("wide_tail", "quantile", 0.55) == "wide_tail_quantile_alpha_0p55"


def test_low_delay_and_weights(spark):
    df = spark.createDataFrame([(10.0, 0.7), (10.0, 0.69), (0.5, 0.9)], "p double, q double")
    assert [r[0] for r in df.select(blend.low_delay(F.col("p"), F.col("q"))).collect()] == [7.0, 10.0, 0.0]
    t = spark.createDataFrame([(x,) for x in (0.5, 5.0, 15.0, 45.0, 60.0, 100.0)], "t double")
    assert [tuple(r) for r in t.select(blend.high_weight(F.col("t")), blend.low_weight(F.col("t")), blend.delay_weight(F.col("t"))).collect()] == [(1, 8, 1), (1, 4, 1), (1, 2, 1), (2, 1, 3), (4, 1, 5), (8, 1, 8)]


def test_kinds_of_persistence_columns_are_known_and_kept():
    names = ["pack_high_run_length", "pack_high_count_roll5", "pack_high_cross_roll24", "bp_pack_overload_cumsum_prev", "bp_pack_overload_cummean_prev", "a"]
    r = registry.Registry().add(names)
    assert [f.kind for f in r.features.values()] == ["persistence"] * 3 + ["cumsum"] * 2 + ["raw"]
    assert registry.prune_by_importance(dict.fromkeys(names, 0.0)) == ["a"]


def test_experiments_come_from_the_registry():
    r = registry.Registry().add(["a", "a_lag1", "a_roll3_mean", "a_roll9_mean", "a_slope5"])
    tries = search.experiments(r.kinds(), (3, 9))
    assert [t.name for t in tries] == ["without_lag", "without_roll", "without_slope", "every_second_window", "longer_windows"]
    seen = []
    rows = search.ablation({}, tries, lambda config: seen.append(r.select(**config)) or len(seen[-1]))
    assert [x["best_mae"] for x in rows] == [4, 2, 1, 1, 1] and seen[0] == ["a", "a_lag1", "a_roll3_mean", "a_roll9_mean", "a_slope5"] and seen[3] == ["a"]


def test_no_row_is_lost_for_a_missing_split_or_validation(spark):
    df = spark.createDataFrame([(1, "a", 10.0, 2.0), (2, None, 20.0, 4.0), (3, "a", None, None)], "ID int, split string, pred double, risk double")
    got = {(r.ID, r.factor): r.adjusted for r in blend.risk_variants(df, "pred", "risk", (0.5,), "split").collect()}
    assert got == {(1, 0.5): 15.0, (2, 0.5): 30.0, (3, 0.5): None}
    grid = {"high_base": (0.5,), "high50_coef": (0.0,), "high100_coef": (0.0,), "max_high": (1.0,), "low_coef": (0.5,), "max_low": (1.0,)}
    rows = [("v", 10.0, 20.0, 4.0, 0.1, 0.1, 1.0, 12.0), (None, 10.0, None, 4.0, None, 0.1, None, 8.0), ("v", 10.0, 20.0, 4.0, 0.1, 0.1, 1.0, None)]
    names = ("base", "high", "low", "p50", "p100", "p_low", "target")
    df = spark.createDataFrame(rows, "v string, " + ", ".join(f"{n} double" for n in names))
    # 10 + 0.5 * 10 - 0.5 * 6 = 12; without a high specialist and probability of a low value the base stays
    assert {r.v: r.mae for r in blend.specialist_grid(df, {n: n for n in names}, "v", grid).collect()} == {"v": 0.0, None: 2.0}

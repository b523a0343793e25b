import os
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import ROOT, difference
from tidewater.operators import sketches, timeframes, timejoin
from tidewater.plans.time_queries import ORACLES, QUERIES


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="the test tables aren't there")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert difference(spark, "sf0.001", name, QUERIES[name], ORACLES[name]) is None


def rows(r, n, most=60, users=4):
    return [(i, None if r.random() < 0.05 else r.randrange(users), None if r.random() < 0.05 else r.randrange(most)) for i in range(n)]


@pytest.mark.parametrize("slices", [1, 5])
def test_asof_equals_brute_force(spark, slices):
    r = random.Random(4)
    a, b = rows(r, 80), rows(r, 50)
    a += a[:5]  # repeated rows come out each
    left = spark.createDataFrame(a, "id int, k int, t int").repartition(3)
    right = spark.createDataFrame([(*x, f"_t{x[0]}") for x in b], "id int, k int, t int, _t string").repartition(3)
    for tolerance in (None, 7):
        want = []
        for i, k, t in a:
            fits = [y for y in b if k is not None and t is not None and y[1] == k and y[2] is not None and y[2] <= t and (tolerance is None or t - y[2] <= tolerance)]
            want.append((i, max(fits, key=lambda y: (y[2], y[0]))[0] if fits else None))
        got = timejoin.asof_join(left, right, "k", "t", ties=("id",), tolerance=tolerance, slices=slices)
        assert got.columns == ["id", "k", "t", "right_id", "right_k", "right_t", "right__t"]
        assert sorted(((x.id, x.right_id) for x in got.collect()), key=str) == sorted(want, key=str)


def test_asof_with_empty_sides_and_one_hot_key(spark):
    left = spark.createDataFrame([(1, 1, 5)], "id int, k int, t int")
    assert timejoin.asof_join(left, left.limit(0), "k", "t").first().right_id is None
    assert timejoin.asof_join(left.limit(0), left, "k", "t").count() == 0
    hot = spark.range(2000).select(F.col("id"), F.lit(7).alias("k"), F.col("id").alias("t"))
    got = timejoin.asof_join(hot, hot.filter("id % 100 = 0"), "k", "t", slices=8)
    assert got.filter("right_id != id - id % 100").count() == 0 and got.count() == 2000


@pytest.mark.parametrize("hot", [100_000, 3])
def test_intervals_equal_brute_force(spark, hot):
    r = random.Random(6)

    def some(n):
        out = []
        for i in range(n):
            s = r.randrange(-300, 300)
            out.append((i, None if r.random() < 0.05 else r.randrange(3), None if r.random() < 0.05 else s, s + r.choice([0, 1, 1, 2, 3, 17, 64, 65, 500])))
        return [*out, (n, 1, -5000, 5000), (n + 1, 2, 8, 3)] + out[:3]

    a, b = some(40), some(50)
    schema = "id int, k int, s long, e long"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    over = lambda x, y: None not in (x[2], y[2]) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    for by in (None, ("k", "k")):
        want = sorted((x[0], y[0]) for x in a for y in b if over(x, y) and (by is None or (x[1] == y[1] and x[1] is not None)))
        got = timejoin.interval_join(left, right, ("s", "e"), ("s", "e"), by, hot=hot)
        assert sorted((x.id, x.right_id) for x in got.select("id", "right_id").collect()) == want and len(want) > 50
    assert timejoin.interval_join(left, right.limit(0), ("s", "e"), ("s", "e")).count() == 0


def test_one_interval_over_everything_isnt_multiplied(spark):
    points = spark.range(3000).select(F.col("id").alias("p"), (F.col("id") * 1_000_003).alias("s"), (F.col("id") * 1_000_003 + 1).alias("e"))
    whole = spark.createDataFrame([(0, 0, 1 << 40)], "q int, s long, e long")
    got = timejoin.interval_join(points, whole, ("s", "e"), ("s", "e"))
    assert got.count() == 3000
    assert timejoin.interval_join(whole, points, ("s", "e"), ("s", "e"), hot=100).select("right_p").distinct().count() == 3000


def test_range_frames_equal_brute_force_with_ties(spark):
    r = random.Random(9)
    data = [(i, k, t, None if r.random() < 0.1 else float(r.randrange(10))) for i, k, t in rows(r, 150, most=40, users=3)]
    df = spark.createDataFrame(data, "id int, k int, t long, v double").withColumn("_t", F.lit("x"))
    for now in (True, False):
        got = {x.id: x for x in timeframes.range_roll(df, "k", "t", 6, {"total": lambda: F.sum("v"), "n": lambda: F.count("v")}, include_now=now).collect()}
        assert len(got) == 150 and got[0].asDict().keys() == {"id", "k", "t", "v", "_t", "total", "n"}
        for i, k, t, _ in data:
            if t is None:
                assert got[i].total is None and got[i].n is None
                continue
            inside = [v for _, k2, t2, v in data if k2 == k and t2 is not None and t - 6 <= t2 <= (t if now else t - 1) and v is not None]
            assert (got[i].n, got[i].total) == (len(inside), sum(inside) if inside else None)


def test_sketches_stay_within_their_errors_at_every_level(spark, tmp_path):
    df = spark.range(40_000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 7 != 0, F.col("id") % 7).alias("b"), (F.col("id") * 7919 % 15_000).alias("who"), F.pow(F.rand(3), 3).alias("v"))
    df.write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    sketches.sketch(df, ["a", "b"], "v", "who").write.parquet(f"{tmp_path}/sketches")
    exact = {(r.a, r.b, r.level): r for r in df.rollup("a", "b").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.countDistinct("who").alias("d"), F.percentile("v", F.lit(0.85)).alias("low"), F.percentile("v", F.lit(0.95)).alias("high")).collect()}
    got = sketches.rolled_up(spark.read.parquet(f"{tmp_path}/sketches"), ["a", "b"]).collect()
    assert len(got) == len(exact) == 1 + 3 + 3 * 7
    for r in got:
        e = exact[r.a, r.b, r.level]
        assert r.n == e.n and r.total == pytest.approx(e.total)
        assert abs(r.distinct_estimate / e.d - 1) < 5 * 1.04 / 2 ** (sketches.BUCKETS / 2) and e.low <= r.p90 <= e.high
    assert sketches.rolled_up(spark.read.parquet(f"{tmp_path}/sketches"), ["a", "b"], cube=True).count() == 1 + 3 + 7 + 3 * 7

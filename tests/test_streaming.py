import pytest
from pyspark.sql import functions as F

from tidewater.operators import timeframes
from tidewater.operators.panel import Panel
from tidewater.streaming.rolling import PROVIDER, rolling_features


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    yield
    spark.conf.set(name, before)


def fed(spark, path, parts):
    """A stream that gets one part after the other."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(out, name, tmp_path):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return q


def clean(r):
    return tuple(None if x is None or x != x else round(x, 9) for x in r)


def test_stream_equals_batch(spark, rocks, tmp_path):
    rows = [(u, 10 * t + u, 1_700_000_000 + 60 * t, None if t == 5 else float((7 * t + u) % 11)) for u in range(3) for t in range(12)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    stream = fed(spark, f"{tmp_path}/in", [df.filter("event_id < 50"), df.filter("event_id >= 50")])
    run(rolling_features(stream, 4), "rolled", tmp_path)
    p = Panel("user_id", ("ts", "event_id"))
    want = df.select("user_id", "event_id", p.lag("value").alias("lag1"), p.roll("value", 4, "mean").alias("roll_mean"), p.roll("value", 4, "max").alias("roll_max"), p.cumulative_sum("value").alias("cumsum"))
    got = spark.sql("select user_id, event_id, lag1, roll_mean, roll_max, cumsum from rolled").collect()
    assert sorted(map(clean, got), key=str) == sorted(map(clean, want.collect()), key=str)


def test_idle_users_leave_the_state(spark, rocks, tmp_path):
    at = lambda rows: spark.createDataFrame(rows, "user_id long, event_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    first, hour = 1_700_000_000, 3600
    parts = [at([(1, 1, first, 5.0), (2, 2, first, 7.0)]), at([(2, 3, first + 2 * hour, 1.0)]), at([(2, 4, first + 3 * hour, 1.0)]), at([(1, 5, first + 3 * hour + 60, 2.0)])]
    q = run(rolling_features(fed(spark, f"{tmp_path}/in", parts), 4, idle="1 hour"), "idle", tmp_path)
    got = {r.event_id: r for r in spark.sql("select * from idle").collect()}
    assert len(got) == 5 and got[4].cumsum == 8 and got[5].cumsum == 0 and got[5].lag1 != 5.0  # user 1 starts anew
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal <= 3  # what one or two users hold


def test_sessions_of_a_stream_equal_the_batch_but_for_late_rows(spark, tmp_path):
    rows = [(u, 1_700_000_000 + 100 * t + (4000 if t > 8 else 0) + 7 * u, float(t)) for u in range(3) for t in range(16)]
    end = [(9, 1_700_030_000, 0.0), (9, 1_700_030_100, 0.0)]  # a batch drops what is later than the watermark of the batch before
    late = [(1, 1_700_000_050, 99.0)]
    at = lambda rows: spark.createDataFrame(rows, "user_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    parts = [at(rows[:20]), at(rows[20:]), at(end[:1]), at(end[1:]), at(late), at([(9, 1_700_060_000, 0.0)])]
    wanted = {"n": F.count(F.lit(1)), "total": F.sum("value")}
    stream = fed(spark, f"{tmp_path}/in", parts).withWatermark("ts", "2 hours")
    q = run(timeframes.sessions(stream, ["user_id"], "ts", wanted, "10 minutes"), "sessions", tmp_path)
    got = spark.sql("select user_id, start, end, n, total from sessions").collect()
    batch = timeframes.sessions(at(rows + end), ["user_id"], "ts", wanted, "10 minutes").collect()
    assert sorted(got) == sorted(batch) and len(batch) == 7
    assert timeframes.late_rows(q) == 1

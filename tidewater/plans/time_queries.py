"""Registered queries of the time operators, which go beyond the panel: joins by time, frames over spans, windows, sketches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.operators import sketches, timeframes, timejoin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")


@query("""WITH o AS (SELECT u, t, max(o_orderkey) AS o_orderkey FROM (SELECT o_orderkey, o_custkey % 150 AS u, make_timestamp(1704067200000000 + (epoch_us(o_orderdate) - 788918400000000) // 80) AS t FROM orders) GROUP BY u, t)
SELECT e.event_id, CASE WHEN epoch_us(e.ts) - epoch_us(o.t) <= 21600000000 THEN o.o_orderkey END AS o_orderkey FROM events e ASOF LEFT JOIN o ON e.user_id = o.u AND e.ts >= o.t""")
def asof_last_order(spark, sf):
    """Each event's last order of the same user within six hours; order dates are drawn together to the month of the events."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    at = F.lit(1704067200000000) + F.floor((micros(orders, "o_orderdate") - F.lit(788918400000000)) / 80).cast("long")
    right = orders.select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), at.alias("at"))
    found = timejoin.asof_join(events(spark, sf), right, "user_id", "ts", "at", ties=("o_orderkey",), tolerance=6 * HOUR)
    return found.select("event_id", F.col("right_o_orderkey").alias("o_orderkey"))


@query("""WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + (event_id % 12 + 1) * 3600000000 AS e FROM events WHERE event_type = 'purchase'),
b AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + (CASE WHEN event_id % 50 = 0 THEN 200 ELSE event_id % 5 END) * 3600000000 AS e FROM events WHERE event_type = 'error')
SELECT a.event_id AS purchase_id, b.event_id AS error_id FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e AND b.e > b.s""")
def interval_overlaps(spark, sf):
    """Pairs of purchases and errors of one user whose spans overlap; some errors last for days."""
    df = events(spark, sf)
    named = df.withColumn("s", micros(df, "ts"))
    i = F.col("event_id")
    a = named.filter("event_type = 'purchase'").select("event_id", "user_id", "s", (F.col("s") + (i % 12 + 1) * F.lit(HOUR)).alias("e"))
    b = named.filter("event_type = 'error'").select("event_id", "user_id", "s", (F.col("s") + F.when(i % 50 == 0, F.lit(200)).otherwise(i % 5) * F.lit(HOUR)).alias("e"))
    found = timejoin.interval_join(a, b, ("s", "e"), ("s", "e"), ("user_id", "user_id"))
    return found.select(F.col("event_id").alias("purchase_id"), F.col("right_event_id").alias("error_id"))


@query("""SELECT event_id, round(sum(value) OVER w, 6) AS sum_6h, CAST(count(value) OVER w AS BIGINT) AS n_6h, max(value) OVER w AS max_6h
FROM (SELECT *, date_trunc('hour', ts) AS hour FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)""")
def range_frame_sums(spark, sf):
    """Sums over the six hours up to each event's hour; events of the same hour share a frame."""
    df = events(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    got = timeframes.range_roll(df, "user_id", "hour", 6 * HOUR, {"sum_6h": lambda: F.sum("value"), "n_6h": lambda: F.count("value"), "max_6h": lambda: F.max("value")})
    return got.select("event_id", F.round("sum_6h", 6).alias("sum_6h"), "n_6h", "max_6h")


def micros(df: DataFrame, c: str) -> Column:
    return timejoin.ticks(F.col(c), dict(df.dtypes)[c])


def _aggregates() -> dict:
    return {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}


def _spans(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, micros(df, "start").alias("start_us"), micros(df, "end").alias("end_us"), "n", "total")


@query("SELECT event_type, epoch_us(date_trunc('day', ts)) AS start_us, epoch_us(date_trunc('day', ts)) + 86400000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    return _spans(timeframes.windowed(events(spark, sf), ["event_type"], "ts", _aggregates(), "1 day"), "event_type")


@query("""SELECT event_type, start_us, start_us + 86400000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT event_type, value, (epoch_us(ts) // 21600000000 - k) * 21600000000 AS start_us FROM events, range(4) AS t(k)) GROUP BY ALL""")
def sliding_windows(spark, sf):
    return _spans(timeframes.windowed(events(spark, sf), ["event_type"], "ts", _aggregates(), "1 day", "6 hours"), "event_type")


@query("""SELECT user_id, min(t) AS start_us, max(t) + 14400000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM (
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM (
SELECT user_id, value, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 14400000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
def session_windows(spark, sf):
    return _spans(timeframes.sessions(events(spark, sf), ["user_id"], "ts", _aggregates(), "4 hours"), "user_id")


@query("""SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def sketch_rollup_totals(spark, sf):
    """The exact part of a rollup over merged sketches; tests hold its estimates against exact figures."""
    stored = sketches.sketch(spark.read.parquet(f"{sf}/orders.parquet"), ["o_orderstatus", "o_orderpriority"], "o_totalprice", "o_custkey")
    return sketches.rolled_up(stored, ["o_orderstatus", "o_orderpriority"]).select("o_orderstatus", "o_orderpriority", F.col("level").cast("long").alias("level"), "n", F.round("total", 2).alias("total"))

"""Frames and windows over spans of time instead of numbers of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewater.operators.ranks import free_name
from tidewater.operators.timejoin import ticks


def range_roll(df: DataFrame, by: str, time: str, span: int, wanted: dict[str, Callable[[], Column]], include_now: bool = True) -> DataFrame:
    """df with aggregates over the rows of the same `by` from `span` ticks earlier up to the row's own time.

    wanted: for each result a function that gives an aggregate, as `lambda: F.sum("value")`. All rows of the same time
    belong to the frame, or none of them without include_now. Ticks are microseconds of timestamps. Rows without a time
    have null results and are in no frame; a null key is a key. Repeated rows count each.

    Time is cut into cells a span wide, and a row is also sent to the cell behind its own, where it only helps to fill
    frames. A task then orders at most what a key has in two cells, so a long history of one key is many tasks.
    """
    at = {c: free_name(df.columns, f"_{c}") for c in ("t", "cell", "own")}
    t = ticks(F.col(time), dict(df.dtypes)[time])
    span = max(1, int(span))
    dealt = df.withColumn(at["t"], t).withColumn(at["cell"], F.floor(F.col(at["t"]) / span))
    both = F.array(F.struct(F.col(at["cell"]).alias("cell"), F.lit(True).alias("own")), F.struct((F.col(at["cell"]) + 1).alias("cell"), F.lit(False).alias("own")))
    alone = F.array(F.struct(F.lit(None).cast("long").alias("cell"), F.lit(True).alias("own")))
    spread = dealt.withColumn("_d", F.explode(F.when(F.col(at["t"]).isNull(), alone).otherwise(both))).withColumn(at["cell"], F.col("_d.cell")).withColumn(at["own"], F.col("_d.own")).drop("_d")
    frame = Window.partitionBy(by, at["cell"]).orderBy(at["t"]).rangeBetween(-span, 0 if include_now else -1)
    made = spread.select("*", *[F.when(F.col(at["t"]).isNotNull(), make().over(frame)).alias(n) for n, make in wanted.items()])
    return made.filter(at["own"]).drop(*at.values())


def windowed(df: DataFrame, keys: list[str], time: str, wanted: dict[str, Column], length: str, slide: str | None = None) -> DataFrame:
    """keys, start, end and aggregates of tumbling windows, or of sliding ones with `slide`; for batches and streams (give streams a watermark)."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return df.groupBy(*keys, w.alias("_w")).agg(*[c.alias(n) for n, c in wanted.items()]).select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *wanted)


def sessions(df: DataFrame, keys: list[str], time: str, wanted: dict[str, Column], gap: str | Column) -> DataFrame:
    """keys, start, end (the last row's time plus the gap) and aggregates of sessions: rows of equal keys that follow each other by less than the gap.

    For batches and streams; a stream needs a watermark, gives a session once that has passed its end, and drops rows
    that come later still. Rows with a null time are in no session.
    """
    return df.groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(*[c.alias(n) for n, c in wanted.items()]).select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *wanted)


def late_rows(query) -> int:
    """How many rows a stream has dropped for being later than its watermark, of the progress that it still holds."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)

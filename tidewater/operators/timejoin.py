"""Joins by time: the last earlier row of another table, and overlapping intervals. Neither multiplies rows beyond a bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewater.operators.ranks import free_name


def ticks(c: Column, kind: str) -> Column:
    """A time as a whole number: microseconds since 1970 of timestamps and dates (whatever the session's zone, if they have none), other numbers as they are."""
    if kind in ("timestamp_ntz", "date"):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
    return F.unix_micros(c) if kind == "timestamp" else c.cast("long")


def asof_join(
    left: DataFrame, right: DataFrame, by: str, time: str, right_time: str | None = None, ties: Sequence[str] = (), tolerance: int | None = None, slices: int = 32, prefix: str = "right_",
) -> DataFrame:
    """left with the columns of the last row of right of the same `by` that isn't later (names get a prefix).

    Of rows of right at the same time the one with the largest `ties` is taken. tolerance: how many ticks (microseconds
    for timestamps) it may be earlier. Rows of left without such a row, without a key or without a time keep nulls in
    its columns; rows of right without a key or time never match. Every row of left comes out once, repeated ones
    included. Empty tables are allowed; columns may have the same names on both sides.

    Both sides are put into one frame and right's last row is carried forward within a key. So that a key that holds
    a third of all rows is no single task, time is cut into up to `slices` ranges at quantiles: rows are ordered within
    key and range, and the last row of each range is handed on through a table of one row for each key and range.
    """
    right_time = right_time or time
    at = {c: free_name([*left.columns, *right.columns], f"_{c}") for c in ("key", "t", "side", "slice", "row", "payload", "carried", "tie")}
    kinds, right_kinds = dict(left.dtypes), dict(right.dtypes)
    key_type = kinds[by]
    payload = F.struct(F.lit(0).alias("_"), ticks(F.col(right_time), right_kinds[right_time]).alias("_t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(right.columns)])
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(left.columns)])
    order = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)])
    a = left.select(F.col(by).alias(at["key"]), ticks(F.col(time), kinds[time]).alias(at["t"]), F.lit(1).alias(at["side"]), row.alias(at["row"]))
    b = right.select(F.col(by).cast(key_type).alias(at["key"]), ticks(F.col(right_time), right_kinds[right_time]).alias(at["t"]), F.lit(0).alias(at["side"]), payload.alias(at["payload"]), order.alias(at["tie"]))
    b = b.filter(F.col(at["key"]).isNotNull() & F.col(at["t"]).isNotNull())
    both = a.unionByName(b, allowMissingColumns=True)
    t = F.col(at["t"])
    cuts = sorted(set(right.select(ticks(F.col(right_time), right_kinds[right_time]).alias("t")).agg(F.percentile_approx("t", [i / slices for i in range(1, slices)] or [0.5], 100 * slices)).first()[0] or [])) if slices > 1 else []
    placed = both.withColumn(at["slice"], F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= t)))

    within = Window.partitionBy(at["key"], at["slice"]).orderBy(F.col(at["t"]).asc_nulls_first(), at["side"], at["tie"]).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("_last", F.last(at["payload"], True).over(within)).filter(F.col(at["side"]) == 1)
    ends = placed.filter(F.col(at["side"]) == 0).groupBy(at["key"], at["slice"]).agg(F.max_by(at["payload"], F.struct(at["t"], at["tie"])).alias(at["carried"]))
    # what each range of a key starts with; a key has a row for each of at most `slices` ranges
    every = F.explode(F.sequence(F.col(at["slice"]) + 1, F.coalesce(F.col("_next"), F.lit(len(cuts)))))
    following = F.lead(at["slice"]).over(Window.partitionBy(at["key"]).orderBy(at["slice"]))
    handed = ends.withColumn("_next", following).filter(F.col(at["slice"]) < len(cuts)).select(F.col(at["key"]).alias("_k"), every.alias("_s"), at["carried"])
    joined = found.join(handed, (F.col(at["key"]) == F.col("_k")) & (F.col(at["slice"]) == F.col("_s")), "left")
    last = F.coalesce(F.col("_last"), F.col(at["carried"]))
    usable = F.col(at["key"]).isNotNull() & F.col(at["t"]).isNotNull()
    if tolerance is not None:
        usable = usable & (F.col(at["t"]) - last["_t"] <= tolerance)
    got = joined.select(at["row"], F.when(usable, last).alias(at["payload"]))
    return got.select(*[F.col(at["row"])[f"c{i}"].alias(c) for i, c in enumerate(left.columns)], *[F.col(at["payload"])[f"c{i}"].alias(f"{prefix}{c}") for i, c in enumerate(right.columns)])


def interval_join(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], by: tuple[str, str] | None = None, hot: int = 100_000, prefix: str = "right_") -> DataFrame:
    """All pairs of rows whose half-open intervals [start, end) overlap (and whose `by` columns are equal), each once.

    Bounds are numbers or timestamps. Intervals with a null bound or without length overlap none, and a null key
    equals none. A point is an interval of one tick. Repeated rows pair up each.

    An interval of length up to 2^n ticks lives on level n, whose cells are that wide, so it lies in one or two of them,
    however long it is. Of a pair the one on the higher level (left, if equal) is at home in its cells and the other one
    asks there: an interval asks on each higher level that exists, in at most two cells. The cell of the later start
    gives the pair. So no interval is multiplied by its length, and one that covers everything has one or two rows.
    Cells of more than `hot` rows at home are split, and those who ask go to each part.
    """
    kinds = [dict(left.dtypes), dict(right.dtypes)]
    keys = [[F.lit(0)] if by is None else [F.col(by[i]).cast(kinds[0][by[0]])] for i in (0, 1)]

    def prepared(df: DataFrame, i: int, bounds: tuple[str, str]) -> DataFrame:
        start, end = (ticks(F.col(c), kinds[i][c]) for c in bounds)
        rows = df.select(keys[i][0].alias("k"), start.alias("s"), end.alias("e"), F.struct(*[F.col(c).alias(f"c{j}") for j, c in enumerate(df.columns)]).alias("row"))
        there = rows.filter(F.col("k").isNotNull() & (F.col("e") > F.col("s")))
        return there.withColumn("level", F.ceil(F.log2((F.col("e") - F.col("s")).cast("double")) - 1e-9).cast("int"))

    sides = [prepared(left, 0, left_bounds), prepared(right, 1, right_bounds)]
    levels = [sorted(r[0] for r in s.select("level").distinct().collect()) for s in sides]  # at most 64 numbers
    first, last = F.expr("shiftright(s, level)"), F.expr("shiftright(e - 1, level)")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.select("k", "level", F.explode(F.sequence(first, last)).alias("cell"), "s", "e", "row")

    def asking(rows: DataFrame, above: list[int], strictly: bool) -> DataFrame:
        over = [F.lit(n) for n in above]
        wanted = F.filter(F.array(*over).cast("array<int>"), lambda n: n > F.col("level") if strictly else n >= F.col("level"))
        return dealt(rows.withColumn("_at", F.explode(wanted)).drop("level").withColumnRenamed("_at", "level"))

    def matched(home: DataFrame, guests: DataFrame, swapped: bool) -> DataFrame:
        cells = ["k", "level", "cell"]
        sizes = home.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("parts"))
        h = home.join(sizes, cells).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
        g = guests.join(sizes, cells).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        g = g.withColumnsRenamed({"s": "s2", "e": "e2", "row": "row2"})
        pairs = h.join(g, [*cells, "part"]).filter("s < e2 AND s2 < e AND shiftright(greatest(s, s2), level) = cell")
        return pairs.select(*([F.col("row2").alias("a"), F.col("row").alias("b")] if swapped else [F.col("row").alias("a"), F.col("row2").alias("b")]))

    found = matched(dealt(sides[0]), asking(sides[1], levels[0], False), False).unionByName(matched(dealt(sides[1]), asking(sides[0], levels[1], True), True))
    return found.select(*[F.col("a")[f"c{i}"].alias(c) for i, c in enumerate(left.columns)], *[F.col("b")[f"c{i}"].alias(f"{prefix}{c}") for i, c in enumerate(right.columns)])

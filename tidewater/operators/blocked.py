"""Rolling means and deviations that equal DuckDB's to the last bit.

Sums of doubles depend on the order of additions. Where many windows have the same mean but for rounding, that order
decides which of them reach a quantile of their own column, so flags equal the SQL only if the order does. DuckDB (2.0)
deals the entities to hash groups, orders each group by entity and row, and keeps the aggregate of every 16 rows of a
group, counted from its first; a window takes single rows up to such a block, the block, and single rows after it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewater.functions.moments import combined, deviation, sums
from tidewater.functions.nulls import zero
from tidewater.operators.panel import FIRST, Panel

#: Fixed values of DuckDB: rows of a block, rows that a hash group has at most on average, and its least and most groups (as powers of 2).
BLOCK, GROUP_ROWS, LEAST_BITS, MOST_BITS = 16, 122_880, 4, 10
_FACTOR, _NULL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def hash_group(keys: pd.Series, bits: int) -> np.ndarray:
    """The hash group of each whole number of 64 bits (or null), of 2^bits."""
    null, half = keys.isna().to_numpy(), np.uint64(32)
    x = keys.fillna(0).astype("int64").to_numpy().view(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> half)) * _FACTOR
    x = np.where(null, _NULL, x ^ (x >> half))
    return ((x >> np.uint64(48 - bits)) & np.uint64((1 << bits) - 1)).astype("int32")


@dataclass(frozen=True)
class BlockedPanel(Panel):
    """A panel whose means and deviations are added up as DuckDB does.

    at: the column of `placed`, which the frame has to have beside the slot. The entity is a whole number of 64 bits.
    """

    at: str = "_at"

    def placed(self, df: DataFrame) -> DataFrame:
        """df with each row's place within its block. Entities are counted once; a hash group is ordered by one row for each of its entities."""
        rows, bits = df.count(), LEAST_BITS
        while bits < MOST_BITS and rows >> bits > GROUP_ROWS:
            bits += 1
        group = F.pandas_udf(lambda keys: pd.Series(hash_group(keys, bits)), "int")
        sizes = df.groupBy(F.col(self.entity).cast("long").alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("_g").orderBy(F.col("_e").asc_nulls_first()).rowsBetween(FIRST, -1)
        starts = sizes.withColumn("_g", group("_e")).select("_e", zero(F.sum("_n").over(before)).cast("long").alias("_start"))
        joined = df.join(starts, F.col(self.entity).eqNullSafe(F.col("_e")))  # a row for each entity
        return joined.select(*df.columns, F.pmod(F.col("_start") + F.col(self.slot), F.lit(BLOCK)).cast("int").alias(self.at))

    def roll(self, c: str | Column, n: int, how: str) -> Column:
        if n >= 2 * BLOCK:
            raise ValueError("a window may hold one block at most")
        if how == "mean":
            return self._mean(c, n)
        return self._std(c, n) if how == "std" else super().roll(c, n, how)

    def _mean(self, c: str | Column, n: int) -> Column:
        if n < BLOCK:
            return super().roll(c, n, "mean")
        after, most = F.col(self.at), n - BLOCK  # rows of the window after its block
        frame = lambda first, last: zero(F.sum(c).over(self.rows.rowsBetween(-first, -last)))
        start = F.lit(0.0)
        for k in range(most + 1):
            block = frame(k + BLOCK, k + 1)
            start = F.when(after == k, block if k == most else frame(n, k + BLOCK + 1) + block).otherwise(start)
        for k in range(most, 0, -1):  # one by one; 0 changes no sum
            start = start + F.when(after >= k, zero(self.lag(c, k))).otherwise(F.lit(0.0))
        total = F.when(self._whole(n), start).otherwise(F.sum(c).over(self.past(n)))
        return F.try_divide(total, F.count(c).over(self.past(n)))

    def _std(self, c: str | Column, n: int) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        past = F.transform(F.collect_list(F.struct(c.cast("double").alias("x"))).over(self.past(n)), lambda r: r["x"])
        if n < BLOCK:
            return deviation(past)
        after, seen = F.col(self.at), F.least(F.col(self.slot), F.lit(n))

        def cut(xs: Column) -> Column:
            left, block = sums(F.slice(xs, F.lit(1), seen - after - BLOCK)), sums(F.slice(xs, seen - after - BLOCK + 1, F.lit(BLOCK)))
            return F.when(self._whole(n), deviation(F.slice(xs, seen - after + 1, after), combined(left, block))).otherwise(deviation(xs))

        return F.transform(F.array(past), cut)[0]  # the window is computed once

    def _whole(self, n: int) -> Column:
        """Whether the n rows before hold a whole block."""
        after = F.col(self.at)
        return (after + BLOCK <= n) & (after + BLOCK <= F.col(self.slot))

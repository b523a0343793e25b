"""Gapless ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Rows that one window group holds on average when a rank is computed.
ROWS_PER_GROUP = 500_000


def group_buckets(n_rows: int) -> int:
    return max(16, -(-n_rows // ROWS_PER_GROUP))


def free_name(taken: list[str], wanted: str) -> str:
    """wanted, lengthened until it is none of the names taken (upper and lower case are one)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def ranked(df: DataFrame, groups: list[str], order: list[Column], bucket: Column, out: str) -> DataFrame:
    """A gapless rank from 0 within each combination of groups, without one task for each group.

    bucket splits a group into ordered parts; a part's rows are numbered by a window of its own and start where
    the parts before it end. df has to be cheap to read twice (a written table). The counts of the parts are one
    small row each and their running sum is taken by a window over the parts of a group.
    """
    part, rank, start = (free_name([*df.columns, out], n) for n in ("_part", "_rank", "_start"))
    keyed = df.withColumn(part, bucket)
    counts = keyed.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*groups, part]
    right = counts.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(start))
    numbered = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    same = [numbered[k].eqNullSafe(right[f"_r{i}"]) for i, k in enumerate(keys)]
    joined = numbered.join(right, same, "left").withColumn(rank, (F.col(rank) + right[start]).cast("long"))
    return joined.select(*[numbered[c] for c in df.columns if c != out], F.col(rank).alias(out))

"""Columns that carry nothing: missing, near constant or equal to another."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F


def missing_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, share of missing values; one pass for all columns."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns])).alias("x")).select("x.*")


def high_missing(df: DataFrame, columns: Sequence[str], share: float = 0.95) -> DataFrame:
    return missing_shares(df, columns).filter(F.col("share") >= share)


def value_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, distinct values (missing is one), share of the most frequent."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), (F.max("n") / F.sum("n")).alias("top_share"))


def near_constant(df: DataFrame, columns: Sequence[str], share: float = 0.999) -> DataFrame:
    """The rows of value_shares for columns with one value, or with one that has this share of the rows or more.

    A value with more than half of the rows is their median in any order: one pass takes the approximate median of a
    52-bit hash of every column, one counts the rows that have it, and only columns near the share are counted exactly.
    """
    asked = list(columns)
    if share > 0.51 and asked:
        hashed = df.select(*[F.shiftrightunsigned(F.xxhash64(c), 12).alias(f"h{i}") for i, c in enumerate(asked)])  # exact as a double
        middle = hashed.agg(*[F.percentile_approx(f"h{i}", 0.5, 10_000).alias(f"h{i}") for i in range(len(asked))]).first()
        held = hashed.agg(*[F.avg((F.col(f"h{i}") == F.lit(middle[i])).cast("double")).alias(f"h{i}") for i in range(len(asked))]).first()
        asked = [c for i, c in enumerate(asked) if (held[i] or 0.0) >= share - 1e-9]
    found = value_shares(df, asked or list(columns)[:1])
    return found.filter(F.col("column").isin(asked) & ((F.col("n_distinct") <= 1) | (F.col("top_share") >= share)))


def duplicates(df: DataFrame, columns: Sequence[str], key: str) -> dict[str, str]:
    """column -> the first column that it equals in every row, of the same type.

    One pass gives each column two fingerprints; columns that agree in both are then compared value by value.
    """
    kinds = dict(df.dtypes)
    h = {c: F.xxhash64(F.col(key), F.coalesce(F.xxhash64(F.col(c)), F.lit(0)), F.col(c).isNull()) for c in columns}
    row = df.agg(*[F.bit_xor(h[c]).alias(f"x{i}") for i, c in enumerate(columns)], *[F.sum(F.pmod(h[c], F.lit(1 << 31))).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    groups: dict[tuple, list[str]] = {}
    for i, c in enumerate(columns):
        groups.setdefault((kinds[c], row[f"x{i}"], row[f"s{i}"]), []).append(c)
    pairs = [p for g in groups.values() for p in combinations(g, 2)]
    if not pairs:
        return {}
    differ = df.agg(*[F.count(F.when(~F.col(a).eqNullSafe(F.col(b)), 1)).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first()
    out: dict[str, str] = {}
    for i, (a, b) in enumerate(pairs):
        if differ[f"d{i}"] == 0 and a not in out:
            out.setdefault(b, a)
    return out


def prune(df: DataFrame, columns: Sequence[str], key: str) -> list[str]:
    """The columns that are neither mostly missing, near constant nor equal to an earlier one."""
    drop = {r["column"] for r in high_missing(df, columns).collect()} | {r["column"] for r in near_constant(df, columns).collect()}
    drop |= set(duplicates(df, columns, key))
    return [c for c in columns if c not in drop]

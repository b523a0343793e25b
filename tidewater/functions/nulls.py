"""Column helpers with the null rules of the panel: a missing value is null, never NaN or infinite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from tidewater.functions.moments import deviation

#: The guard of divisions and the value that stands for missing in a model matrix.
EPSILON = 1e-6
SENTINEL = -999.0


def clean(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)


def sanitise(df: DataFrame) -> DataFrame:
    """All floating columns cleaned, in one projection."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[clean(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b + F.lit(EPSILON))


def floor_at(c: Column, low: float = 0.0) -> Column:
    """The larger of c and low; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0, also where it is null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def col_or(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """An optional column, or a constant if the frame lacks it."""
    return F.col(name) if name in df.columns else F.lit(float(default))


def _present(columns: Sequence[Column]) -> Column:
    return F.filter(F.array(*[c.cast("double") for c in columns]), lambda x: x.isNotNull())


def row_mean(*columns: Column) -> Column:
    xs = _present(columns)
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs))


def row_std(*columns: Column) -> Column:
    """Sample standard deviation over the present values of a row (equal ones: exactly 0); null for fewer than two."""
    return deviation(_present(columns))


def row_max(*columns: Column) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def row_min(*columns: Column) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def dot(values: Column, weights: Sequence[float]) -> Column:
    """Weighted sum of an array column."""
    products = F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)

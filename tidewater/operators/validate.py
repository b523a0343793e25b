"""Checks of a submission against its template."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def violations(df: DataFrame, template: DataFrame, prediction: str, key: str = "ID", order: str | None = "ord") -> DataFrame:
    """One row of counts: rows, rows of the template, missing, extra, repeated and misplaced keys, null and negative predictions."""
    places = [F.col(order).alias("_a")] if order and order in df.columns else [F.lit(None).cast("long").alias("_a")]
    wanted = [F.col(order).alias("_b")] if order and order in template.columns else [F.lit(None).cast("long").alias("_b")]
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(places[0]).alias("_a"), F.count(F.when(F.col(prediction).isNull(), 1)).alias("_null"), F.count(F.when(F.col(prediction) < 0, 1)).alias("_neg"))
    expected = template.groupBy(key).agg(F.count(F.lit(1)).alias("_t"), F.min(wanted[0]).alias("_b"))
    both = counts.join(expected, key, "full")
    zero = F.lit(0)
    return both.agg(
        F.coalesce(F.sum("_n"), zero).alias("n_rows"),
        F.coalesce(F.sum("_t"), zero).alias("n_expected"),
        F.count(F.when(F.col("_n").isNull(), 1)).alias("n_missing"),
        F.count(F.when(F.col("_t").isNull(), 1)).alias("n_extra"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("n_repeated"),
        F.count(F.when(F.col("_a") != F.col("_b"), 1)).alias("n_misplaced"),
        F.coalesce(F.sum("_null"), zero).alias("n_null"),
        F.coalesce(F.sum("_neg"), zero).alias("n_negative"),
    )


def validate(df: DataFrame, template: DataFrame, prediction: str, key: str = "ID", order: str | None = "ord") -> None:
    """Raise ValueError if columns or any count of violations are wrong."""
    want = [c for c in (key, prediction) if c not in df.columns]
    if want:
        raise ValueError(f"missing columns: {', '.join(want)}")
    found = violations(df, template, prediction, key, order).first().asDict()
    wrong = {k: v for k, v in found.items() if k not in ("n_rows", "n_expected") and v}
    if found["n_rows"] != found["n_expected"] or wrong:
        raise ValueError(f"the submission doesn't fit its template: {found}")

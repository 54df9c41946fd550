"""Data checks that stop a job or report what is wrong with a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, needed: Sequence[str], source: str = "table") -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{source}: missing columns {missing}")
    return df


def with_missing_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Add known columns a layout lacks, as typed nulls."""
    absent = {c: F.lit(None).cast(t) for c, t in schema.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def require_finite(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Fail the job on the first row with a null, NaN or infinite probability."""
    checked = {}
    for c in columns:
        value = F.col(c)
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
        checked[c] = F.when(finite, value).otherwise(
            F.raise_error(F.lit(f"{name}: non-finite values in {c}")).cast("double"))
    return df.withColumns(checked)


def count_non_finite(columns: Sequence[str]) -> Column:
    bad = F.lit(False)
    for c in columns:
        value = F.col(c)
        bad = bad | value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.count_if(bad)


def date_problems(df: DataFrame, text: str, parsed: Column) -> DataFrame:
    """Count of unreadable dates and up to three examples; one bounded row."""
    bad = F.when(parsed.isNull(), F.coalesce(F.col(text).cast("string"), F.lit("null")))
    return df.agg(F.count(bad).alias("bad_rows"), F.min(bad).alias("first_bad"),
                  F.max(bad).alias("last_bad"))

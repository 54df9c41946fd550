"""Evaluate wide expressions exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_once(df: DataFrame, columns: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns through a one-element generator.

    Filters are not pushed below a generator and projections do not merge across it, so an
    expensive expression used by several later columns and filters is not repeated in each.
    """
    kept = [c for c in df.columns if c not in drop]
    fields = F.struct(*[v.alias(k) for k, v in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(fields)))

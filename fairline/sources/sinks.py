"""Writing tables: rounding, JSON-safe values, thinned curves, the card payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fairline import config


def _doubles(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    columns = _doubles(df)
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns}) if columns else df


def finite(value: Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def json_safe(df: DataFrame, digits: int = 4) -> DataFrame:
    """JSON has no NaN: non-finite doubles become null, the rest are rounded; dates are text."""
    out = {c: F.round(finite(F.col(c)), digits) for c in _doubles(df)}
    out.update({f.name: F.date_format(f.name, "yyyy-MM-dd") for f in df.schema.fields
                if isinstance(f.dataType, (T.DateType, T.TimestampType))})
    return df.withColumns(out) if out else df


def write_table(df: DataFrame, path: str, digits: int | None = None,
                partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Parquet table sink, with rounding on write where the stored form is rounded."""
    frame = rounded(df, digits) if digits is not None else df
    writer = frame.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_json_rows(df: DataFrame, path: str, digits: int = 4, mode: str = "errorifexists"
                    ) -> None:
    """One JSON object per line, written by every task; nothing passes through the driver."""
    json_safe(df, digits).write.mode(mode).json(path)


def thin(df: DataFrame, position: str, limit: int = config.EQUITY_POINTS) -> DataFrame:
    """Keep rows at positions floor(i * n / limit) of a 1-based ``position``; all when few.

    A row decides by itself, from its position and the number of rows.
    """
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    step, place = F.col("_n") / F.lit(limit), F.col(position) - 1
    near = F.ceil(place / step)
    hit = F.col("_n") <= limit
    for i in (near - 1, near, near + 1):  # rounding can move it by one
        hit = hit | (i.between(0, limit - 1) & (F.floor(i * step) == place))
    return df.crossJoin(F.broadcast(size)).filter(hit).drop("_n")

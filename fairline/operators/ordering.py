"""Global orders without a global sort: ranks, running sums, folds and periods.

A window with no partition puts a whole table into one task. Here the order is cut into
levels (day, competition, a hash bucket of the row id); every level is summed first, only
the small level tables are run through windows, and rows are ranked inside their last level.
A cell that is hot (a large day of a competition) is split by the hash bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET, PART = "_bucket", "_part"
#: Rows of a cell up to which one task runs through it whole.
HOT = 1 << 18


def bucket_of(row_id: Column) -> Column:
    """256 buckets from the md5 of the row id; part of the total order."""
    return F.substring(F.md5(row_id), 1, 2)


def running(df: DataFrame, levels: Sequence[str], row_id: str, measures: dict[str, Column],
            by: Sequence[str] = (), hot: int = HOT) -> DataFrame:
    """Add inclusive running sums of ``measures`` in the order levels, bucket, row id.

    ``levels`` must be few-valued columns (a day, a competition). ``by`` restarts the sums.
    The cells of ``levels`` are summed and put in order; rows move once, to be run through
    inside their cell. Only a cell of over ``hot`` rows is split by bucket.
    """
    by, levels = list(by), list(levels)
    keys, names = by + levels, list(measures)
    rows = df.withColumns({BUCKET: bucket_of(F.col(row_id)),
                           **{f"_m_{n}": measures[n] for n in names}})
    cells = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), *[
        F.sum(f"_m_{n}").alias(f"_s_{n}") for n in names])
    offsets = cells.select(*keys, "_size")
    for depth in range(len(levels), 0, -1):
        at = by + levels[:depth]
        level = cells.groupBy(*at).agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in names])
        shifted = level.select(*at, *[_before(f"_s_{n}", by + levels[:depth - 1], levels[depth - 1])
                                      .alias(f"_o{depth}_{n}") for n in names])
        offsets = offsets.join(shifted, at)
    offsets = offsets.select(*keys, "_size", *[
        sum((F.col(f"_o{d}_{n}") for d in range(1, len(levels) + 1)), F.lit(0)).alias(f"_o_{n}")
        for n in names])
    if not by:
        offsets = F.broadcast(offsets)  # few values
    placed = rows.join(offsets, keys) if keys else rows.crossJoin(offsets)
    split = F.col("_size") > hot
    placed = placed.withColumn(PART, F.when(split, F.col(BUCKET)).otherwise("")).drop("_size")
    inside = (Window.partitionBy(*keys, PART).orderBy(BUCKET, row_id)
              .rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.withColumns({f"_r_{n}": F.sum(f"_m_{n}").over(inside) for n in names})
    large = F.broadcast(offsets.filter(split).select(*keys, F.lit(True).alias("_large")))  # at most a ``hot``-th of the rows
    large = rows.join(large, keys) if keys else rows.crossJoin(large)
    large = large.groupBy(*keys, BUCKET).agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in names])
    large = large.select(*keys, F.col(BUCKET).alias(PART), *[
        _before(f"_s_{n}", keys, BUCKET).alias(f"_b_{n}") for n in names])
    return summed.join(large, [*keys, PART], "left").select(*df.columns, *[
        (F.col(f"_o_{n}") + F.coalesce(f"_b_{n}", F.lit(0)) + F.col(f"_r_{n}")).alias(n)
        for n in names])


def _before(value: str, keys: Sequence[str], order: str) -> Column:
    """The sum of ``value`` over the earlier rows of the same keys; 0 for the first."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))


def rank_in_order(df: DataFrame, levels: Sequence[str], row_id: str, name: str = "rank",
                  by: Sequence[str] = ()) -> DataFrame:
    """Add the 1-based position of every row in the total order."""
    return running(df, levels, row_id, {name: F.lit(1).cast("long")}, by)


def ntile_at(rank: Column, n: Column, tiles: int) -> Column:
    """Equal-count tile (1..tiles) of a 1-based rank; the first tiles take the remainder."""
    base, extra = F.floor(n / tiles), n % tiles
    head = extra * (base + 1)
    at = rank - 1
    return F.when(at < head, F.floor(F.try_divide(at, base + 1)) + 1).otherwise(
        extra + F.floor(F.try_divide(at - head, base)) + 1).cast("int")


def equal_count_parts(df: DataFrame, tiles: int, levels: Sequence[str], row_id: str,
                      name: str) -> DataFrame:
    """Split rows into equal-count consecutive parts of the total order.

    Only the cells of ``levels`` are counted and put in order; a cell that lies in one part
    names it, and rows stay where they are. The at most ``tiles`` - 1 cells that a part ends
    in have their rows ranked. ``levels`` are few-valued, so the cells are broadcast.
    """
    levels = list(levels)
    cells = df.groupBy(*levels).agg(F.count(F.lit(1)).alias("_c"))
    first, *rest = levels
    top = cells.groupBy(first).agg(F.sum("_c").alias("_t"))
    # The first level's values (days) are few enough for one window.
    top = top.select(first, (F.sum("_t").over(Window.orderBy(first).rowsBetween(
        Window.unboundedPreceding, 0)) - F.col("_t")).alias("_o"),
        F.sum("_t").over(Window.partitionBy()).alias("_n"))
    before = F.lit(0)
    if rest:
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(first).orderBy(*rest).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("_b", before).join(F.broadcast(top), first).select(
        *levels, (F.col("_o") + F.col("_b")).alias("_before"), "_n",
        ntile_at(F.col("_o") + F.col("_b") + 1, F.col("_n"), tiles).alias("_lo"),
        ntile_at(F.col("_o") + F.col("_b") + F.col("_c"), F.col("_n"), tiles).alias("_hi"))
    whole = df.join(F.broadcast(placed.filter("_lo = _hi").select(
        *levels, F.col("_lo").alias(name))), levels)
    cut = df.join(F.broadcast(placed.filter("_lo < _hi")), levels)
    ranked = rank_in_order(cut, [], row_id, "_rank", by=levels).withColumn(
        name, ntile_at(F.col("_before") + F.col("_rank"), F.col("_n"), tiles))
    return whole.select(*df.columns, name).unionByName(ranked.select(*df.columns, name))


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
                 rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key in a total order.

    Written as a ranked filter so that the group-limit rule applies: every task keeps only
    ``k`` rows of a key before the shuffle, however many rows a hot key has.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)

"""Exact interpolated quantiles of unbounded groups, and equal-count bins and their sums.

``percentile`` holds every distinct value of a group in one buffer, which does not hold for
probabilities at scale. These quantiles are found by narrowing instead: count rows per
coarse cell (a map-side combined aggregate), see which cells hold the wanted ranks, count
finer cells inside those only, and order single values only in the cells that are left.
No row is sorted and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairline.session import stage

CELL_BITS = (14, 28)
BIN_STEPS = 8


def steps(bins: int) -> list[float]:
    if not 0 < bins < 2 ** BIN_STEPS:
        raise ValueError(f"between 1 and {2 ** BIN_STEPS - 1} bins can be told apart")
    return [i / bins for i in range(bins + 1)]


def _cell(value: Column, bits: int) -> Column:
    return F.floor(value * F.lit(float(2 ** bits)))


def _counted(rows: DataFrame, by: Sequence[str], extra: Sequence[str], measures: dict[str, Column],
             expand, source: Sequence[str]) -> DataFrame:
    """Counts and sums per cell, made per ``source`` group and added up per ``by`` group."""
    fine = rows.groupBy(*source, *extra).agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(v).alias(name) for name, v in measures.items()])
    return expand(fine).groupBy(*by, *extra).agg(
        *[F.sum(c).alias(c) for c in ("_c", *measures)])


def _position(q: Column) -> Column:
    return (F.col("_n") - 1).cast("double") * q


def _first_cells(table: DataFrame, by: Sequence[str], first: str, levels: Sequence[float]) -> DataFrame:
    """Coarse cells with the group's size, where they start and the wanted ranks they hold."""
    whole = Window.partitionBy(*by)
    order = whole.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({"_n": F.sum("_c").over(whole),
                               "_start": F.coalesce(F.sum("_c").over(order), F.lit(0))})
    wanted = F.array(*[F.lit(float(q)) for q in levels])
    ranks = F.array_distinct(F.concat(
        F.transform(wanted, lambda q: F.floor(_position(q))),
        F.transform(wanted, lambda q: F.ceil(_position(q)))))
    return table.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_start"))
                                               & (r < F.col("_start") + F.col("_c"))))


def _inside(rows: DataFrame, value: str, targets: DataFrame, shared: Sequence[str],
            keys: Sequence[str]) -> DataFrame:
    """Rows in the cells that hold wanted ranks, with their cells ``keys``.

    The cells are at most (groups x wanted ranks), so they are broadcast. A row looks one
    number up, the hash of its group and cell; the few rows that only share a hash with a
    cell go when their counts meet the cells themselves.
    """
    code = F.xxhash64(*shared, keys[-1])
    cells = targets.select(code.alias("_code")).distinct()
    kept = rows.withColumn(keys[-1], _cell(F.col(value), int(keys[-1][2:]))).withColumn("_code", code)
    kept = kept.join(F.broadcast(cells), ["_code"], "left_semi").drop("_code")
    return kept.withColumns({k: _cell(F.col(value), int(k[2:])) for k in keys[:-1]})


def _narrow(table: DataFrame, targets: DataFrame, by: Sequence[str], keys: Sequence[str],
            name: str) -> DataFrame:
    """Finer cells of the cells ``targets``, with the wanted ranks that each of them holds."""
    order = (Window.partitionBy(*by, *keys).orderBy(name)
             .rowsBetween(Window.unboundedPreceding, -1))
    held = targets.select(*by, *keys, "_n", F.col("_start").alias("_base"),
                          F.col("_ranks").alias("_held"))
    joined = table.withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0))).join(
        F.broadcast(held), [*by, *keys])
    start = F.col("_base") + F.col("_before")
    return joined.withColumns({
        "_start": start,
        "_ranks": F.filter("_held", lambda r: (r >= start) & (r < start + F.col("_c")))
    }).drop("_before", "_base", "_held")


def _levels(values: DataFrame, by: Sequence[str], value: str, levels: Sequence[float],
            measures: dict[str, Column], expand, source_by) -> list[tuple[str, DataFrame]]:
    """Cells by cells, then the values of the last ones: (column, counted table) per step.

    The counted tables, (groups x cells) rows, are stored: several steps need each of them,
    and the rows are to be read once for it.
    """
    by, source = list(by), list(source_by or by)
    expand = expand or (lambda df: df)
    shared = [c for c in source if c in by]
    rows = values.filter(F.col(value).isNotNull() & ~F.isnan(value))
    first = f"_k{CELL_BITS[0]}"
    table = _counted(rows.withColumn(first, _cell(F.col(value), CELL_BITS[0])), by, [first],
                     measures, expand, source)
    out, keys = [(first, stage(_first_cells(table, by, first, levels), "cells"))], [first]
    for name in [*[f"_k{bits}" for bits in CELL_BITS[1:]], "_v"]:
        targets = out[-1][1].filter(F.size("_ranks") > 0)
        finer = F.col(value) if name == "_v" else _cell(F.col(value), int(name[2:]))
        kept = _inside(rows, value, targets, shared, keys).withColumn(name, finer)
        table = _counted(kept, by, [*keys, name], measures, expand, source)
        out.append((name, stage(_narrow(table, targets, by, keys, name), "cells")))
        keys = [*keys, name]
    return out


def _edges(final: DataFrame, by: Sequence[str], levels: Sequence[float]) -> DataFrame:
    wanted = F.array(*[F.lit(float(q)) for q in levels])
    picked = final.select(*by, "_n", "_v", F.explode("_ranks").alias("_rank"))
    at = picked.groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(
        F.struct("_rank", "_v"))).alias("_at"))

    def interpolate(q: Column) -> Column:
        pos = _position(q)
        low, high = F.element_at("_at", F.floor(pos)), F.element_at("_at", F.ceil(pos))
        return low + (high - low) * (pos - F.floor(pos))

    return at.select(*by, F.col("_n").alias("n"),
                     F.transform(wanted, interpolate).alias("edges"))


def exact_quantiles(values: DataFrame, by: Sequence[str], value: str,
                    levels: Sequence[float],
                    expand: Callable[[DataFrame], DataFrame] | None = None,
                    source_by: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group: ``by``, ``n``, ``edges`` (array).

    ``values`` should be a stored frame or a projection of one: it is read once per narrowing
    step. Where groups are unions of smaller ones (folds up to k), ``source_by`` names the
    stored grouping and ``expand`` maps a count table from it onto ``by``: counts are
    combined, rows are not copied.
    """
    counted = _levels(values, by, value, levels, {}, expand, source_by)
    return _edges(counted[-1][1], list(by), levels)


def exact_bins(values: DataFrame, by: Sequence[str], value: str, levels: Sequence[float],
               measures: dict[str, Column],
               expand: Callable[[DataFrame], DataFrame] | None = None,
               source_by: Sequence[str] | None = None) -> DataFrame:
    """Rows between the quantiles of their group: ``by``, ``total``, ``edges``, ``slot``, ``n``
    and the sums ``measures``, a row per bin that is not empty.

    The rows are not read again to be put into bins. A cell that holds no wanted rank lies
    between two neighbouring edges, so its sums go to one bin as they are; the others are
    counted finer, down to single values.
    """
    by = list(by)
    counted = _levels(values, by, value, levels, measures, expand, source_by)
    cuts = _edges(counted[-1][1], by, levels).withColumn("edges", distinct_edges(F.col("edges")))
    pieces = None
    for name, table in counted:
        at = F.col("_v") if name == "_v" else F.col(name) / F.lit(float(2 ** int(name[2:])))
        whole = table if name == "_v" else table.filter(F.size("_ranks") == 0)
        whole = whole.select(*by, at.alias("_v"), "_c", *measures)
        pieces = whole if pieces is None else pieces.unionByName(whole)
    cuts = stage(cuts.select(*by, F.col("n").alias("total"), "edges"), "cuts")
    joined = pieces.join(F.broadcast(cuts), by) if by else pieces.crossJoin(F.broadcast(cuts))
    binned = add_bin(joined, "_v", "edges", "slot").groupBy(*by, "slot").agg(
        F.sum("_c").alias("n"), *[F.sum(m).alias(m) for m in measures])
    return binned.join(F.broadcast(cuts), by) if by else binned.crossJoin(F.broadcast(cuts))


def distinct_edges(edges: Column) -> Column:
    return F.array_distinct(edges)


def add_bin(df: DataFrame, value: str, edges: str, name: str, right_closed: bool = False
            ) -> DataFrame:
    """Add the 0-based bin of ``value`` among ``edges`` (up to 256) by binary search.

    Left-closed bins put a value equal to an inner edge into the upper bin; right-closed
    bins into the lower. Values beyond the ends take the end bins. The search is a ladder
    of plain columns, one per halving, so it stays inside whole-stage codegen.
    """
    kept = df.columns
    v, e = F.col(value), F.col(edges)
    at = F.lit(0)
    for step in range(BIN_STEPS - 1, -1, -1):
        jump = 2 ** step
        edge = F.get(e, at + jump)
        up = (edge < v) if right_closed else (edge <= v)
        df = df.withColumn(f"_at{step}", at + F.when(up, F.lit(jump)).otherwise(F.lit(0)))
        at = F.col(f"_at{step}")
    last = F.greatest(F.size(e) - 2, F.lit(0))
    return df.select(*kept, F.least(at, last).alias(name))

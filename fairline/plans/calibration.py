"""Monotone calibration per market group, fitted on the past only.

A calibrator is a small array of knots: means of equal-count bins, made monotone by pooling
adjacent violators. Binning runs over all rows; everything after it is bounded by the bins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fairline import config
from fairline.operators.ordering import equal_count_parts
from fairline.operators.quantiles import add_bin, exact_bins, steps
from fairline.session import stage

_BLOCK = "struct<s:double,w:double,n:int>"


def pool_violators(knots: Column) -> Column:
    """Weighted monotone fit of an ordered knot array of ``struct(y, w)``; one value per knot.

    A fold over the knots keeps a stack of blocks; a new knot swallows the blocks on top of
    the stack whose mean is above its own.
    """
    empty = F.array().cast(f"array<{_BLOCK}>")

    def block(s: Column, w: Column, n: Column) -> Column:
        return F.struct(s.alias("s"), w.alias("w"), n.alias("n")).cast(_BLOCK)

    def push(stack: Column, knot: Column) -> Column:
        start = F.struct(block(knot["y"] * knot["w"], knot["w"], F.lit(1)).alias("top"),
                         empty.alias("rest"))

        def absorb(acc: Column, below: Column) -> Column:
            top = acc["top"]
            violates = (F.size(acc["rest"]) == 0) & (
                below["s"] / below["w"] > top["s"] / top["w"])
            merged = block(top["s"] + below["s"], top["w"] + below["w"], top["n"] + below["n"])
            return F.when(violates, F.struct(merged.alias("top"), acc["rest"].alias("rest"))
                          ).otherwise(F.struct(
                top.alias("top"), F.concat(F.array(below), acc["rest"]).alias("rest")))

        return F.aggregate(F.reverse(stack), start, absorb,
                           lambda acc: F.concat(acc["rest"], F.array(acc["top"])))

    stack = F.aggregate(knots, empty, push)
    return F.flatten(F.transform(stack, lambda b: F.array_repeat(b["s"] / b["w"], b["n"])))


def fit(values: DataFrame, by: Sequence[str], bins: int = config.CALIBRATION_BINS,
        min_samples: int = config.CALIBRATION_MIN_SAMPLES,
        shrink: float = config.CALIBRATION_SHRINK, clip: float = config.CALIBRATION_CLIP,
        expand: Callable[[DataFrame], DataFrame] | None = None,
        source_by: Sequence[str] | None = None) -> DataFrame:
    """Knots ``x``, ``y`` and sample size ``n`` per group of a stored frame of prob and y.

    Groups that are too thin, or take fewer than three distinct edges, get the identity.
    """
    by = list(by)
    known = F.col("y").isNotNull()
    counted = stage(exact_bins(values, by, "prob", steps(bins), {
        "sx": F.col("prob"), "sy": F.col("y"), "ny": known.cast("long")}, expand, source_by), "bins")
    cuts = counted.select(*by, "total", "edges").distinct()
    usable = (F.col("total") >= min_samples) & (F.size("edges") >= 3)
    binned = counted.filter(usable).select(
        *by, "slot", F.col("n").cast("double").alias("w"), (F.col("sx") / F.col("n")).alias("x"),
        F.try_divide("sy", "ny").alias("y"))
    target = ((F.col("w") * F.col("y") + F.lit(shrink) * F.col("x"))
              / (F.col("w") + F.lit(shrink)))
    knots = binned.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        "slot", "x", target.alias("y"), (F.col("w") + F.lit(shrink)).alias("w")))).alias("_kn"))
    fitted = knots.select(
        *by, F.transform("_kn", lambda k: k["x"]).alias("x"),
        F.transform(pool_violators(F.transform("_kn", lambda k: F.struct(
            k["y"].alias("y"), k["w"].alias("w")))),
            lambda v: F.least(F.greatest(v, F.lit(clip)), F.lit(1.0 - clip))).alias("y"))
    identity = F.array(F.lit(0.0), F.lit(1.0))
    return cuts.select(*by, "total").join(fitted, by, "left").select(
        *by, F.coalesce("x", identity).alias("x"), F.coalesce("y", identity).alias("y"),
        F.col("total").alias("n"))


def interpolated(prob: Column, x: Column, y: Column, at: Column,
                 clip: float = config.CALIBRATION_CLIP) -> Column:
    """Calibrated probability between the knots ``at`` and ``at + 1``.

    Outside the knots the raw value's excess is kept; the identity passes values through.
    """
    first_x, last_x = F.get(x, F.lit(0)), F.get(x, F.size(x) - 1)
    first_y, last_y = F.get(y, F.lit(0)), F.get(y, F.size(y) - 1)
    identity = (F.size(x) == 2) & (first_x == 0.0) & (first_y == 0.0)
    x0, x1, y0, y1 = F.get(x, at), F.get(x, at + 1), F.get(y, at), F.get(y, at + 1)
    inside = F.coalesce(y0 + (prob - x0) * F.try_divide(y1 - y0, x1 - x0), y0)
    moved = (F.when(prob < first_x, F.least(prob, first_y))
             .when(prob > last_x, F.greatest(prob, last_y)).otherwise(inside))
    return F.when(identity, prob).otherwise(
        F.least(F.greatest(moved, F.lit(clip)), F.lit(1.0 - clip)))


def apply(df: DataFrame, calibrators: DataFrame, by: Sequence[str], name: str = "prob"
          ) -> DataFrame:
    """Replace ``prob`` by its calibrated value; groups without a calibrator stay raw.

    The calibrator table has one row per group (and fold), so it is broadcast.
    """
    small = calibrators.select(*by, F.col("x").alias("_x"), F.col("y").alias("_y"))
    joined = add_bin(df.join(F.broadcast(small), list(by), "left"), "prob", "_x", "_seg")
    moved = interpolated(F.col("prob"), F.col("_x"), F.col("_y"), F.col("_seg"))
    return joined.withColumn(name, F.when(F.col("_x").isNull(), F.col("prob")).otherwise(moved)
                             ).drop("_x", "_y", "_seg")


def with_folds(matches: DataFrame, folds: int = config.CALIBRATION_FOLDS) -> DataFrame:
    """Matches (not selections) with their chronological equal-count ``fold``."""
    return equal_count_parts(matches, folds, ["date", "competition"], "match_id", "fold")


def learn(values: DataFrame, by: Sequence[str] = ("group",),
          folds: int = config.CALIBRATION_FOLDS, **options) -> DataFrame:
    """The calibrators of every fold but the first, each fitted on the earlier folds."""
    by = list(by)
    later = lambda df: df.filter(F.col("fold") < folds).withColumn(
        "k", F.explode(F.sequence(F.col("fold") + 1, F.lit(folds)))).drop("fold")
    return fit(values, [*by, "k"], expand=later, source_by=[*by, "fold"], **options)


def walk_forward(values: DataFrame, by: Sequence[str] = ("group",),
                 folds: int = config.CALIBRATION_FOLDS, store=lambda df, name: df,
                 **options) -> DataFrame:
    """Calibrate every fold with calibrators fitted on earlier folds only.

    ``values`` has ``fold`` (1..folds). Adds ``raw`` and ``scored``; the first fold has nothing
    to learn from, stays raw and is not scored. ``store`` writes the calibrators, one row per
    group and fold, and reads them back, so that they are fitted once.
    """
    return replay(values, store(learn(values, by, folds, **options), "curves"), by)


def replay(values: DataFrame, learned: DataFrame, by: Sequence[str] = ("group",)) -> DataFrame:
    """``walk_forward`` with calibrators that have been learned: a projection of ``values``.

    The explode of one value is where a later filter on it stops. Moved below the halvings of the search it would be
    written out for every path through them, and the search made anew for each.
    """
    out = apply(values.withColumn("raw", F.col("prob")), learned.withColumnRenamed("k", "fold"),
                [*by, "fold"])
    kept = [c for c in out.columns if c != "prob"]
    out = out.select(*kept, F.explode(F.array("prob")).alias("prob")).select(*out.columns)
    return out.withColumn("scored", F.col("fold") > 1)


def replay_wide(rows: DataFrame, learned: DataFrame, group_of: dict[str, str]) -> DataFrame:
    """``replay`` where the selections of a match are the columns of its row: ``group_of`` names their market groups.

    Each group's curve of the row's fold joins the row once; the columns are searched one after the other. What is no
    number is null.
    """
    out, kept = rows, rows.columns
    for i, group in enumerate(sorted(set(group_of.values()))):
        curve = learned.filter(F.col("group") == group).select(
            F.col("k").alias("fold"), F.col("x").alias(f"_x{i}"), F.col("y").alias(f"_y{i}"))
        out = out.join(F.broadcast(curve), "fold", "left")
        for key in [k for k, g in group_of.items() if g == group]:
            out = add_bin(out, key, f"_x{i}", "_seg")
            moved = interpolated(F.col(key), F.col(f"_x{i}"), F.col(f"_y{i}"), F.col("_seg"))
            moved = F.when(F.col(f"_x{i}").isNull(), F.col(key)).otherwise(moved)
            out = out.withColumn(key, F.when(F.col(key).isNotNull() & ~F.isnan(key), moved)).drop("_seg")
    names = list(group_of)
    end = F.explode(F.array(F.struct(*names))).alias("_moved")  # where later filters stop, as in ``replay``
    return out.select(*[c for c in kept if c not in group_of], end).select(
        *[F.col(f"_moved.{c}").alias(c) if c in group_of else F.col(c) for c in kept])


def to_rows(calibrators: DataFrame, by: Sequence[str], digits: int = 6) -> DataFrame:
    """The stored form: one row per knot, rounded."""
    return calibrators.select(*by, "n", F.posexplode(F.arrays_zip("x", "y")).alias("knot", "_kn")
                              ).select(*by, "n", "knot", F.round("_kn.x", digits).alias("x"),
                                       F.round("_kn.y", digits).alias("y"))


def from_rows(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    return stored.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct(
        "knot", "x", "y"))).alias("_kn")).select(
        *by, F.transform("_kn", lambda k: k["x"]).alias("x"),
        F.transform("_kn", lambda k: k["y"]).alias("y"), "n")

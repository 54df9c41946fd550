"""Is a stated probability true? Scores, reliability, calibration error, coherence.

Inputs are graded selections, long: ``match_id, key, group, prob, y`` with y in {0, 1}.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fairline import config
from fairline.functions import markets, stats
from fairline.operators.quantiles import exact_bins, exact_quantiles, steps


def scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    p, y = F.col("prob"), F.col("y")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               F.avg(stats.squared_error(p, y)).alias("brier"),
                               F.avg(stats.log_error(p, y)).alias("log_loss"))


def band_sums(df: DataFrame, by: Sequence[str], edges=config.BAND_EDGES) -> DataFrame:
    """What scores and reliability are made of, summed per ``by`` and band (null outside the bands) in one pass."""
    p, y = F.col("prob"), F.col("y")
    inside = (p >= edges[0]) & (p < edges[-1])
    return df.groupBy(*by, F.when(inside, stats.band_low(p, edges)).alias("band_low")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("prob").alias("sp"), F.sum("y").alias("hits"),
        F.sum(stats.squared_error(p, y)).alias("squared"), F.sum(stats.log_error(p, y)).alias("log"),
        F.count(stats.squared_error(p, y)).alias("known"))


def scores_of(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``scores`` from ``band_sums`` by the same columns or more."""
    mean = lambda name: F.try_divide(F.sum(name), F.sum("known"))
    return sums.groupBy(*by).agg(F.sum("n").alias("n"), mean("squared").alias("brier"), mean("log").alias("log_loss"))


def reliability(df: DataFrame, edges=config.BAND_EDGES) -> DataFrame:
    """Predicted against actual by confidence band: all markets pooled, then each group.

    Rows are summed once to (group, band) - at most groups x bands rows - and the pooled
    scope is rolled up from that.
    """
    banded = df.filter((F.col("prob") >= edges[0]) & (F.col("prob") < edges[-1])).withColumn(
        "band_low", stats.band_low(F.col("prob"), edges))
    return reliability_of(banded.groupBy("group", "band_low").agg(
        F.count(F.lit(1)).alias("n"), F.sum("prob").alias("sp"), F.sum("y").alias("hits")), edges)


def reliability_of(sums: DataFrame, edges=config.BAND_EDGES) -> DataFrame:
    """``reliability`` from ``band_sums`` by group or finer."""
    fine = sums.filter("band_low IS NOT NULL")
    scoped = fine.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("group"))))
    table = scoped.groupBy("scope", "band_low").agg(
        *[F.sum(c).alias(c) for c in ("n", "sp", "hits")])
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    predicted, actual = F.col("sp") / F.col("n"), F.col("hits") / F.col("n")
    return table.select(
        "scope", stats.band_label(F.col("band_low"), edges).alias("band"), "band_low",
        stats.band_high(F.col("band_low"), edges).alias("band_high"), "n",
        predicted.alias("predicted"), actual.alias("actual"),
        (actual - predicted).alias("gap"), low.alias("ci_low"), high.alias("ci_high"))


def worst_gap(table: DataFrame, flag_at: float = 0.02) -> DataFrame:
    """Largest distance between claim and record in the pooled scope."""
    pooled = table.filter(F.col("scope") == "all")
    gap = F.abs(F.col("actual") - F.col("predicted"))
    return pooled.agg(F.max(gap).alias("worst_gap"), F.sum("n").alias("n"),
                      F.count_if(gap > flag_at).alias("flagged"))


def calibration_error(values: DataFrame, by: Sequence[str], bins: int = config.ECE_BINS,
                      prob: str = "prob") -> DataFrame:
    """Size-weighted mean gap over equal-count bins per group; null below 5 rows a bin.

    ``values`` is read once per quantile step: a stored frame, or a projection of one. The
    bins are put together from what the steps have counted.
    """
    by = list(by)
    binned = exact_bins(values, by, prob, steps(bins), {"sp": F.col(prob), "sy": F.col("y")})
    gap = F.abs(F.col("sp") / F.col("n") - F.col("sy") / F.col("n")) * F.col("n")
    enough = F.max("total") >= bins * 5
    return binned.groupBy(*by).agg(
        F.when(enough, F.sum(gap) / F.sum("n")).alias("ece"))


def _top(df: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    top = F.col("prob") >= threshold
    n_top = F.count_if(top)
    hits = F.sum(F.when(top, F.col("y")))
    low, high = stats.wilson(F.col("_hits"), F.col("n_top"))
    p, y = F.col("prob"), F.col("y")
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("base_rate"),
        F.avg(stats.squared_error(p, y)).alias("brier"),
        F.avg(stats.log_error(p, y)).alias("log_loss"), n_top.alias("n_top"),
        F.avg(F.when(top, p)).alias("predicted"), hits.alias("_hits"))
    return sums.withColumns({"actual": F.try_divide("_hits", "n_top"), "ci_low": low,
                             "ci_high": high}).drop("_hits")


def group_summary(values: DataFrame, threshold: float = config.MIN_CONFIDENCE) -> DataFrame:
    out = _top(values, ["group"], threshold).join(calibration_error(values, ["group"]), "group")
    return out.withColumn("name", markets.group_name(F.col("group")))


def per_selection(values: DataFrame, threshold: float = config.MIN_CONFIDENCE) -> DataFrame:
    return _top(values, ["key"], threshold).withColumn("selection",
                                                       markets.label_of(F.col("key")))


MARKET_OF = {"1x2_home": "q_home", "1x2_draw": "q_draw", "1x2_away": "q_away",
             "ou2.5_over": "q_over"}


def versus_market(values: DataFrame, store) -> DataFrame:
    """Ours against the de-vigged closing line, on the line's own selections.

    ``values`` carries q_home/q_draw/q_away/q_over. ``store`` writes a frame and reads it back.
    """
    market = F.lit(None).cast("double")
    for key, column in MARKET_OF.items():
        market = F.when(F.col("key") == key, F.col(column)).otherwise(market)
    both = values.filter(F.col("key").isin(*MARKET_OF)).withColumn("market", market).filter(
        F.col("market").isNotNull() & ~F.isnan("market"))
    both = store(both.select("key", "prob", "market", "y"))
    head = both.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(stats.squared_error(F.col("prob"), F.col("y"))).alias("brier_ours"),
        F.avg(stats.squared_error(F.col("market"), F.col("y"))).alias("brier_market"))
    ours = calibration_error(both, ["key"]).withColumnRenamed("ece", "ece_ours")
    line = calibration_error(both, ["key"], prob="market").withColumnRenamed("ece", "ece_market")
    return head.join(ours, "key").join(line, "key").withColumn(
        "delta", F.col("brier_ours") - F.col("brier_market"))


IDENTITIES = {
    "1X = 1 + X": ({"dc_1x": 1, "1x2_home": -1, "1x2_draw": -1}, 0.0),
    "12 = 1 + 2": ({"dc_12": 1, "1x2_home": -1, "1x2_away": -1}, 0.0),
    "X2 = X + 2": ({"dc_x2": 1, "1x2_draw": -1, "1x2_away": -1}, 0.0),
    "1 + X + 2 = 1": ({"1x2_home": 1, "1x2_draw": 1, "1x2_away": 1}, 1.0),
    "over/under 2.5 = 1": ({"ou2.5_over": 1, "ou2.5_under": 1}, 1.0),
}


COHERENT = tuple(sorted({k for terms, _ in IDENTITIES.values() for k in terms}))


def coherence(selections: DataFrame, store) -> DataFrame:
    """How far calibrated selections are from adding up: mean, 99th percentile, maximum."""
    wide = selections.filter(F.col("key").isin(*COHERENT)).groupBy("match_id").agg(*[
        F.max(F.when(F.col("key") == k, F.col("prob"))).alias(f"k{i}")
        for i, k in enumerate(COHERENT)])
    return coherence_of(wide, [f"k{i}" for i in range(len(COHERENT))], store)


def coherence_of(wide: DataFrame, columns: Sequence[str], store) -> DataFrame:
    """``coherence`` of a row per match that has the ``COHERENT`` selections in ``columns``."""
    at = {k: F.col(c) for k, c in zip(COHERENT, columns, strict=True)}
    gaps = []
    for name, (terms, target) in IDENTITIES.items():
        acc = F.lit(-target)
        for key, sign in terms.items():
            acc = acc + at[key] if sign > 0 else acc - at[key]
        gaps.append(F.struct(F.lit(name).alias("identity"), F.abs(acc).alias("gap")))
    long = store(wide.select(F.inline(F.array(*gaps))).filter(F.col("gap").isNotNull()))
    head = long.groupBy("identity").agg(F.avg("gap").alias("mean_abs_gap"),
                                        F.max("gap").alias("max"))
    p99 = exact_quantiles(long, ["identity"], "gap", [0.99]).select(
        "identity", F.get("edges", 0).alias("p99"))
    return head.join(p99, "identity")


ORDERED = ("1x2_home", "1x2_draw", "1x2_away")


def rps_table(selections: DataFrame, market: DataFrame) -> DataFrame:
    """Ranked probability score of ours, the closing line and a uniform guess, on 1X2.

    ``selections`` holds ``match_id, key, prob, result``; ``market`` holds ``match_id`` and
    the three closing probabilities. Only matches where exactly one outcome happened count.
    """
    at = lambda k, v: F.max(F.when(F.col("key") == k, v))
    wide = selections.filter(F.col("key").isin(*ORDERED)).groupBy("match_id").agg(
        F.array(*[at(k, F.col("prob")) for k in ORDERED]).alias("ours"),
        F.array(*[at(k, F.col("result").cast("int")) for k in ORDERED]).alias("won"))
    return rps_of(wide.join(market.select("match_id", F.array("q_home", "q_draw", "q_away").alias("line")), "match_id"))


def rps_of(rows: DataFrame) -> DataFrame:
    """``rps_table`` of a row per match: arrays ``ours``, ``won`` and ``line`` in the order of ``ORDERED``."""
    whole = lambda a: ~F.exists(a, lambda x: x.isNull() | F.isnan(x.cast("double")))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = rows.filter(
        whole(F.col("ours")) & whole(F.col("line")) & whole(F.col("won"))
        & (add(F.transform("won", lambda x: x.cast("double"))) == 1.0))
    rows = rows.select(
        (F.array_position("won", 1) - 1).cast("int").alias("happened"), "ours", "line",
        add(F.col("ours")).alias("total"), add(F.col("line")).alias("line_total"))
    scaled = rows.select(
        "happened", "total", F.transform("ours", lambda x: x / F.col("total")).alias("ours"),
        F.transform("line", lambda x: x / F.col("line_total")).alias("line"))
    third = F.array(*[F.lit(1.0 / 3.0)] * 3)
    score = lambda a: F.avg(stats.ranked_probability(a, F.col("happened")))
    one = scaled.agg(F.count(F.lit(1)).alias("n"), score(F.col("ours")).alias("a"),
                     score(F.col("line")).alias("b"), score(third).alias("c"),
                     F.avg(F.abs(F.col("total") - 1.0)).alias("moved"))
    row = lambda name, rps, renorm: F.struct(
        F.lit(name).alias("forecast"), F.col("n").alias("n"), rps.alias("rps"),
        renorm.alias("renorm"))
    zero = F.lit(0.0)
    return one.filter("n > 0").select(F.inline(F.array(
        row("Ours (calibrated)", F.col("a"), F.col("moved")),
        row("Closing line", F.col("b"), zero), row("Knowing nothing", F.col("c"), zero))))

"""Findings that can disprove an edge. Each is one row: id, state, stat, evidence.

A finding with too little data is absent. ``evidence`` is an array of text rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairline import config
from fairline.functions import stats
from fairline.operators.quality import require_finite
from fairline.operators.quantiles import add_bin, distinct_edges, exact_quantiles, steps
from fairline.plans import backtest

SIDES = ("home", "draw", "away")
STATE_RANK = {"critical": 0, "warning": 1, "neutral": 2, "good": 3}
ORDER = ("random-benchmark", "model-vs-market", "holdout", "edge-deciles", "edge-reliability",
         "band-sensitivity", "market-split", "calibration", "stability", "outcome-split",
         "by-competition")


def _text(*columns) -> Column:
    return F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def _row(df: DataFrame, name: str, state: Column, stat: Column, evidence: Column) -> DataFrame:
    return df.select(F.lit(name).alias("id"), state.alias("state"),
                     F.round(stat, 4).alias("stat"), evidence.alias("evidence"))


def _rows(sort: Column, *columns: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(
        sort.alias("s"), _text(*columns).alias("t")))), lambda x: x["t"])


def three_way_scores(preds: DataFrame) -> DataFrame:
    """Brier score and log loss over the three outcomes, model and market; one row."""
    checked = require_finite(preds, [f"{w}_{s}" for w in ("model", "market") for s in SIDES],
                             "predictions")
    hit = {s: (F.col("actual") == s).cast("double") for s in SIDES}

    def brier(who: str) -> Column:
        acc = F.lit(0.0)
        for s in SIDES:
            acc = acc + stats.squared_error(F.col(f"{who}_{s}"), hit[s])
        return F.avg(acc)

    def log_loss(who: str) -> Column:
        picked = F.lit(0.0)
        for s in SIDES:
            picked = picked + F.col(f"{who}_{s}") * hit[s]
        return F.avg(-F.ln(F.least(F.greatest(picked, F.lit(1e-12)), F.lit(1.0))))

    return checked.agg(F.count(F.lit(1)).alias("n"), brier("model").alias("brier_model"),
                       brier("market").alias("brier_market"),
                       log_loss("model").alias("log_loss_model"),
                       log_loss("market").alias("log_loss_market")).withColumn(
        "delta", (F.col("brier_model") - F.col("brier_market")) / F.col("brier_market") * 100.0)


def model_vs_market(preds: DataFrame) -> DataFrame:
    s = three_way_scores(preds).filter("n > 0")
    better = F.col("brier_model") < F.col("brier_market")
    r = lambda c: F.round(c, 4)
    return _row(s, "model-vs-market", F.when(better, "good").otherwise("critical"),
                F.col("delta"), F.array(
        _text(F.lit("Model"), r("brier_model"), r("log_loss_model")),
        _text(F.lit("Market close"), r("brier_market"), r("log_loss_market"))))


def edge_buckets(bets: DataFrame, buckets=config.EDGE_BUCKETS) -> DataFrame:
    bucket = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(buckets):
        bucket = F.when((F.col("edge") >= lo) & (F.col("edge") < hi), F.lit(i)).otherwise(bucket)
    return backtest.summary(bets.withColumn("bucket", bucket).filter("bucket IS NOT NULL"),
                            ["bucket"])


def edge_reliability(bets: DataFrame) -> DataFrame:
    size = bets.agg(F.count(F.lit(1)).alias("total"))
    numbered = edge_buckets(bets).withColumn(
        "i", F.row_number().over(Window.orderBy("bucket")).cast("double"))
    one = numbered.agg(F.count(F.lit(1)).alias("k"),
                       F.coalesce(F.nanvl(F.corr("i", "roi"), F.lit(0.0)), F.lit(0.0)).alias("c"),
                       _rows(F.col("bucket"), F.col("bucket"), F.col("n"),
                             F.round("win_rate", 4), F.round("roi", 2)).alias("e"))
    return _row(one.crossJoin(F.broadcast(size)).filter("k >= 3 AND total >= 40"),
                "edge-reliability", F.when(F.col("c") > 0.5, "good").otherwise("warning"),
                F.col("c"), F.col("e"))


def calibration_bins(preds: DataFrame, bins: int = 6) -> DataFrame:
    """Fixed bins over [0.05, 0.65) of every model probability; thin bins are left out."""
    long = preds.select(F.inline(F.array(*[F.struct(
        F.col(f"model_{s}").alias("p"), (F.col("actual") == s).cast("double").alias("y"))
        for s in SIDES])))
    binned = long.withColumn("bin", F.width_bucket("p", F.lit(0.05), F.lit(0.65), F.lit(bins)))
    return binned.filter(F.col("bin").between(1, bins)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"),
        F.avg("y").alias("observed")).filter("n >= 30")


def calibration(preds: DataFrame) -> DataFrame:
    one = calibration_bins(preds).agg(
        F.count(F.lit(1)).alias("k"),
        (F.sum(F.abs(F.col("observed") - F.col("predicted")) * F.col("n")) / F.sum("n") * 100.0)
        .alias("gap"), _rows(F.col("bin"), F.col("bin"), F.col("n"), F.round("predicted", 4),
                             F.round("observed", 4)).alias("e"))
    gap = F.col("gap")
    return _row(one.filter("k > 0"), "calibration", F.when(gap < 2, "good").when(
        gap < 4, "warning").otherwise("critical"), gap, F.col("e"))


def stability(bets: DataFrame, periods: int = config.PERIODS) -> DataFrame:
    one = backtest.by_period(bets, periods).agg(
        F.sum("n").alias("n"), (F.max("roi") - F.min("roi")).alias("spread"),
        _rows(F.col("period"), F.col("period"), F.col("n"), F.round("roi", 2)).alias("e"))
    spread = F.col("spread")
    return _row(one.filter(F.col("n") >= periods * 10), "stability", F.when(
        spread < 10, "good").when(spread < 25, "warning").otherwise("critical"), spread,
        F.col("e"))


def by_competition(bets: DataFrame) -> DataFrame:
    table = backtest.summary(bets, ["competition"])
    one = table.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") >= 10).alias("k"),
                    F.count_if((F.col("n") >= 10) & (F.col("roi") > 0)).alias("up"),
                    _rows(-F.col("roi"), F.col("competition"), F.col("n"), F.round("roi", 2))
                    .alias("e"))
    return _row(one.filter("all >= 2 AND k >= 2"), "by-competition", F.lit("neutral"),
                F.col("up").cast("double"), F.col("e"))


def outcome_split(bets: DataFrame) -> DataFrame:
    """Share of the dominant side among home, draw and away bets, of all bets."""
    size = bets.agg(F.count(F.lit(1)).alias("total"))
    sides = backtest.summary(bets.withColumn("side", F.lower("outcome")).filter(
        F.col("side").isin(*SIDES)), ["side"])
    one = sides.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("top"),
                    _rows(-F.col("n"), F.col("side"), F.col("n"), F.round("roi", 2)).alias("e"))
    share = F.col("top") / F.col("total") * 100.0
    return _row(one.crossJoin(F.broadcast(size)).filter("k >= 2"), "outcome-split",
                F.when(share > 70, "warning").otherwise("neutral"), share, F.col("e"))


def market_split(bets: DataFrame, samples: int = config.BOOTSTRAP_SAMPLES) -> DataFrame:
    one = backtest.with_interval(bets, ["market"], samples).agg(
        F.count(F.lit(1)).alias("k"), F.bool_or(F.col("ci_low") > 0).alias("proven"),
        _rows(-F.col("n"), F.col("market"), F.col("n"), F.round("roi", 2),
              F.round("ci_low", 1), F.round("ci_high", 1)).alias("e"))
    return _row(one.filter("k >= 2"), "market-split", F.when(F.col("proven"), "good").otherwise(
        "neutral"), F.col("k").cast("double"), F.col("e"))


def band_sensitivity(sweep: DataFrame) -> DataFrame:
    usable = sweep.filter("n > 0").withColumn("width", F.col("odds_max") - F.col("odds_min"))
    one = usable.agg(F.count(F.lit(1)).alias("k"),
                     F.coalesce(F.nanvl(F.corr("width", "roi"), F.lit(0.0)), F.lit(0.0)).alias("c"),
                     _rows(F.col("width"), F.col("band"), F.col("n"), F.round("roi", 2)).alias("e"))
    return _row(one.filter("k >= 3"), "band-sensitivity", F.when(F.col("c") > 0, "good")
                .otherwise("warning"), F.col("c"), F.col("e"))


def edge_deciles(bets: DataFrame, parts: int = 10) -> DataFrame:
    """ROI by right-closed quantile bin of the claimed edge; ``bets`` is a stored frame."""
    cuts = exact_quantiles(bets, [], "edge", steps(parts)).select(
        distinct_edges(F.col("edges")).alias("edges"))
    binned = add_bin(bets.crossJoin(F.broadcast(cuts)), "edge", "edges", "bin",
                     right_closed=True)
    return backtest.summary(binned.withColumn("decile", F.col("bin") + 1), ["decile"])


def edge_decile_finding(bets: DataFrame, parts: int = 10) -> DataFrame:
    table = edge_deciles(bets, parts)
    one = table.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct(
        "decile", "roi"))).alias("r"), _rows(F.col("decile"), F.col("decile"), F.col("n"),
                                            F.round("roi", 2)).alias("e"))
    third = F.greatest(F.floor(F.size("r") / 3).cast("int"), F.lit(1))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["roi"]) / third
    one = one.withColumns({"low": mean(F.slice("r", F.lit(1), third)),
                           "high": mean(F.slice("r", -third, third))})
    return _row(one.filter(F.col("total") >= parts * 30), "edge-deciles", F.when(
        F.col("low") > F.col("high"), "warning").otherwise("neutral"),
        F.col("high") - F.col("low"), F.col("e"))


def holdout(validation: DataFrame) -> DataFrame:
    at = lambda c: F.max(F.when(F.col("half") == "test", F.col(c)))
    one = validation.agg(F.count(F.lit(1)).alias("k"), at("gain").alias("gain"),
                         at("ci_low").alias("low"),
                         _rows(F.col("half"), F.col("half"), F.col("n_after"),
                               F.round("roi_before", 2), F.round("roi_after", 2)).alias("e"))
    held = F.col("gain") > 0
    return _row(one.filter("k = 2"), "holdout", F.when(held & (F.col("low") > 0), "good").when(
        held, "warning").otherwise("critical"), F.col("gain"), F.col("e"))


def random_returns(dataset: DataFrame, odds_min: float = config.ODDS_MIN,
                   odds_max: float = config.ODDS_MAX, samples: int = config.RANDOM_SAMPLES,
                   seed: int = 5) -> DataFrame:
    """Mean ROI of picking one in-band 1X2 leg per match at random, over replicates.

    Each match draws on its own row from the md5 of its id; replicates are summed before
    the shuffle.
    """
    won = (F.col("home_goals") > F.col("away_goals"), F.col("home_goals") == F.col("away_goals"),
           F.col("home_goals") < F.col("away_goals"))
    legs = F.array(*[F.struct(F.col(f"{s}_odds").alias("o"), h.alias("w"))
                     for s, h in zip(SIDES, won)])
    priced = dataset.dropna(subset=[f"{s}_odds" for s in SIDES])
    inband = priced.select("match_id", F.filter(legs, lambda l: l["o"].between(
        odds_min, odds_max)).alias("legs")).filter(F.size("legs") > 0)
    paid = inband.select("match_id", F.transform("legs", lambda l: F.when(
        l["w"], l["o"] - 1.0).otherwise(-1.0)).alias("paid"))
    rounds = paid.select("match_id", "paid", F.explode(
        F.sequence(F.lit(0), F.lit(samples // 4 - 1))).alias("_g")).withColumn(
        "_d", F.md5(F.concat_ws("|", F.lit(str(seed)), "_g", "match_id")))
    # A digest is read as two numbers of 64 bits, each of them two draws.
    rounds = rounds.select("_g", "paid", *[stats.half_digest(F.col("_d"), i).alias(f"_h{i}") for i in (0, 1)])
    unit = lambda i: stats.unit_of_half(F.col(f"_h{i // 2}"), i % 2)
    value = lambda i: F.get("paid", F.floor(unit(i) * F.size("paid")).cast("int"))
    per = rounds.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), *[
        (F.avg(value(i)) * 100.0).alias(f"r{i}") for i in range(4)])
    return per.agg(F.max("n").alias("matches"), F.avg(
        (F.col("r0") + F.col("r1") + F.col("r2") + F.col("r3")) / 4.0).alias("random_roi"))


def random_benchmark(bets: DataFrame, dataset: DataFrame, **options) -> DataFrame:
    one = backtest.summary(bets).filter("n > 0").crossJoin(random_returns(dataset, **options))
    delta = F.col("roi") - F.col("random_roi")
    return _row(one.filter("matches >= 100"), "random-benchmark", F.when(
        delta < 0, "critical").otherwise("good"), delta, F.array(
        _text(F.lit("Random pick in band"), F.col("matches"), F.round("random_roi", 2)),
        _text(F.lit("This model"), F.col("n"), F.round("roi", 2))))


def ranked(findings: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Findings that argue against an edge first, then in declared order."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    state = F.create_map(*[F.lit(x) for kv in STATE_RANK.items() for x in kv])
    place = F.array_position(F.array(*[F.lit(i) for i in ORDER]), F.col("id"))
    out = out.withColumn("severity", F.coalesce(F.try_element_at(state, F.col("state")), F.lit(9)))
    out = out.orderBy("severity", place)
    return out.limit(limit) if limit else out

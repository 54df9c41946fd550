"""From priced selections to a card: hit rates, ceilings, shortlists, slates, slips.

Picks are long: one row per (fixture, selection), with ``match_id`` naming the fixture.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairline import config
from fairline.operators.ordering import best_per_key


def resid_ok() -> Column:
    """A line the score distribution could not reproduce prices nothing else either."""
    return F.coalesce(F.col("implied_resid"), F.lit(0.0)) <= config.MAX_IMPLIED_RESID


def group_ceilings(reliability: DataFrame, min_n: int = config.MIN_BAND_SAMPLE,
                   max_gap: float = config.MAX_OVERSTATEMENT) -> DataFrame:
    """Highest probability each market group has justified; 0 when its first band fails."""
    rows = reliability.filter((F.col("scope") != "all"))
    high = rows.filter(F.col("band_low") >= config.CEILING_FLOOR)
    order = Window.partitionBy("scope").orderBy("band_low")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.lag("band_high").over(order)
    ok = ((F.col("n") >= min_n) & (F.col("actual") >= F.col("predicted") - max_gap)
          & (previous.isNull() | (F.col("band_low") <= previous + 1e-9)))
    walked = high.withColumn("_ok", ok).withColumn("_run", F.min("_ok").over(upto))
    best = walked.groupBy("scope").agg(F.max(F.when(F.col("_run"), F.col("band_high"))).alias("c"))
    return rows.select("scope").distinct().join(best, "scope", "left").select(
        F.col("scope").alias("group"), F.coalesce("c", F.lit(0.0)).alias("ceiling"))


def attach_hit_rates(picks: DataFrame, reliability: DataFrame | None) -> DataFrame:
    """What each pick's confidence band actually did, in its own group where tested.

    The reliability table is bounded by groups x bands. It is laid out by scope and by how many
    of all its band edges lie at or below a probability, so that a pick finds its band with a
    hash lookup and carries nothing but the edges.
    """
    if reliability is None:
        return picks.withColumns({
            "hit_rate": F.lit(None).cast("double"),
            "hit_rate_predicted": F.lit(None).cast("double"),
            "hit_rate_n": F.lit(0).cast("long"), "validated": F.lit(True)})
    edges = reliability.agg(F.array_sort(F.collect_set("band_low")).alias("_edges"))
    scopes = reliability.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct(
        "band_low", "actual", "predicted", "n"))).alias("bands"))
    below = F.filter("bands", lambda b: b["band_low"] <= F.get(F.col("_edges"), F.col("_seg") - 1))
    bands = scopes.crossJoin(F.broadcast(edges)).withColumn(
        "_seg", F.explode(F.sequence(F.lit(0), F.size("_edges")))).select("scope", "_seg", F.when(
            F.size(below) > 0, F.try_element_at(below, F.lit(-1))).otherwise(F.get("bands", F.lit(0))).alias("_band"))
    own = bands.select(F.col("scope").alias("group"), "_seg", F.col("_band").alias("_own"))
    pooled = bands.filter("scope = 'all'").select("_seg", F.col("_band").alias("_all"))
    limits = group_ceilings(reliability).select("group", F.col("ceiling").alias("_ceiling"))
    placed = picks.crossJoin(F.broadcast(edges)).withColumn(
        "_seg", F.size(F.filter("_edges", lambda e: e <= F.col("prob")))).drop("_edges")
    out = placed.join(F.broadcast(own), ["group", "_seg"], "left").join(
        F.broadcast(pooled), ["_seg"], "left").join(F.broadcast(limits), ["group"], "left")
    use = F.coalesce(F.col("_own.n") >= config.MIN_BAND_SAMPLE, F.lit(False))
    pick = lambda c: F.when(use, F.col(f"_own.{c}")).otherwise(F.col(f"_all.{c}"))
    return out.select(*picks.columns, pick("actual").alias("hit_rate"), pick("predicted").alias("hit_rate_predicted"),
                      pick("n").alias("hit_rate_n"), (F.col("prob") <= F.coalesce("_ceiling", F.lit(1.0)) + 1e-9).alias("validated"))


def confidence_score() -> Column:
    """The claim, scaled down by how far its band fell short of its own claims."""
    tested = ((F.col("hit_rate_n") >= config.MIN_BAND_SAMPLE) & F.col("hit_rate").isNotNull()
              & (F.coalesce(F.col("hit_rate_predicted"), F.lit(0.0)) != 0.0))
    factor = F.least(F.lit(1.0), F.try_divide("hit_rate", "hit_rate_predicted"))
    return F.when(tested, F.col("prob") * factor).otherwise(F.col("prob"))


def rank_order() -> list[Column]:
    """Score, then the evidence behind the band, then the claim; ids make it total."""
    return [F.desc("score"), F.desc("hit_rate_n"), F.desc("prob"), F.asc("match_id"),
            F.asc("key")]


def scored(picks: DataFrame) -> DataFrame:
    return picks.withColumn("score", F.round(confidence_score(), 9))


def shortlist(picks: DataFrame, min_confidence: float = config.MIN_CONFIDENCE,
              per_match: int | None = 1, groups: Sequence[str] | None = None,
              limit: int | None = None, min_odds: float | None = None,
              validated_only: bool = True) -> DataFrame:
    """The strongest selections, at most ``per_match`` from a fixture, most likely first."""
    out = picks.filter(F.col("prob") >= min_confidence).filter(resid_ok())
    if validated_only:
        out = out.filter("validated")
    if groups:
        out = out.filter(F.col("group").isin(*groups))
    if min_odds:
        out = out.filter(F.col("fair_odds") >= min_odds)
    if per_match:
        out = best_per_key(out, ["match_id"], [F.desc("prob"), F.asc("key")], per_match)
    out = out.orderBy(F.desc("prob"), "match_id", "key")
    return out.limit(limit) if limit else out


def card_floor(picks: DataFrame, floor: float = config.CARD_FLOOR) -> DataFrame:
    return picks.filter(F.col("prob") >= floor).orderBy(F.desc("prob"), "match_id", "key")


def browse(picks: DataFrame, min_prob: float, min_odds: float, priced: bool = False,
           unvalidated: bool = False, competition: str | None = None, group: str | None = None,
           text: str = "", one_per_match: bool = False) -> DataFrame:
    """The card browser's filters; with one per match, the first row in card order stays."""
    out = picks.filter((F.col("prob") >= min_prob) & (F.col("fair_odds") >= min_odds))
    if priced:
        out = out.filter(F.col("odds").isNotNull())
    if not unvalidated:
        out = out.filter("validated")
    if competition:
        out = out.filter(F.col("competition") == competition)
    if group:
        out = out.filter(F.col("group") == group)
    if text:
        out = out.filter(F.contains(F.lower("match"), F.lit(text.lower())))
    if one_per_match:
        out = best_per_key(out, ["match_id"], [F.desc("prob"), F.asc("key")])
    return out


def match_days(picks: DataFrame, days: int = config.PICK_DAYS, validated_only: bool = True
               ) -> DataFrame:
    """The next few days with fixtures on the card, numbered from 1."""
    rows = picks.filter("validated") if validated_only else picks
    first = rows.select(F.col("date").alias("day")).distinct().orderBy("day").limit(days)
    return first.select("day", F.row_number().over(Window.orderBy("day")).alias("day_no"))


def best_of_day(picks: DataFrame, odds_min: float = config.BEST_ODDS_MIN,
                odds_max: float = config.BEST_ODDS_MAX, day: str | None = None,
                validated_only: bool = True) -> DataFrame:
    """Most reliable selection of one day in a price range (both ends included)."""
    out = picks.filter(resid_ok() & F.col("fair_odds").between(odds_min, odds_max))
    if validated_only:
        out = out.filter("validated")
    out = scored(out)
    if day is None:
        first = out.agg(F.min("date").alias("day"))
        out = out.join(F.broadcast(first), F.col("date") == F.col("day"))
    else:
        out = out.withColumn("day", F.lit(day).cast("date")).filter("date = day")
    count = out.groupBy("day").agg(F.count(F.lit(1)).alias("candidates"))
    return best_per_key(out, ["day"], rank_order()).join(F.broadcast(count), "day")


def daily_slate(picks: DataFrame, days: int = config.PICK_DAYS, bands=config.PICK_BANDS,
                validated_only: bool = True) -> DataFrame:
    """Best pick per (match day, price band); an empty band is absent.

    Days x bands is nine rows, so both dimensions are broadcast and a pick meets at most
    the bands its price is in.
    """
    spark = picks.sparkSession
    dim = spark.createDataFrame([(i, n, lo, hi) for i, (n, lo, hi) in enumerate(bands)],
                                "band_no int, band string, band_low double, band_high double")
    out = picks.filter(resid_ok())
    if validated_only:
        out = out.filter("validated")
    horizon = match_days(picks, days, validated_only)
    out = scored(out).join(F.broadcast(horizon), F.col("date") == F.col("day"))
    out = out.join(F.broadcast(dim), F.col("fair_odds").between(F.col("band_low"),
                                                                F.col("band_high")))
    counts = out.groupBy("day", "band").agg(F.count(F.lit(1)).alias("candidates"))
    best = best_per_key(out, ["day", "band"], rank_order())
    return best.join(F.broadcast(counts), ["day", "band"])


def best_accumulators(picks: DataFrame, sizes: Sequence[int] = range(2, config.ACCA_MAX_LEGS + 1),
                      target_odds: float = config.ACCA_TARGET_ODDS,
                      days: int = config.PICK_DAYS, validated_only: bool = True) -> DataFrame:
    """For every size, the legs most likely to land among those that reach the target price."""
    if min(sizes) < 2:
        raise ValueError("an accumulator needs at least two legs")
    spark = picks.sparkSession
    dim = spark.createDataFrame([(s, target_odds ** (1.0 / s)) for s in sizes],
                                "legs int, min_leg_odds double")
    out = picks.filter(resid_ok())
    if validated_only:
        out = out.filter("validated")
    horizon = match_days(picks, days, validated_only)
    out = scored(out).join(F.broadcast(horizon), F.col("date") == F.col("day"))
    out = out.join(F.broadcast(dim), F.col("fair_odds") >= F.col("min_leg_odds"))
    one_each = best_per_key(out, ["legs", "match_id"], rank_order())
    window = Window.partitionBy("legs").orderBy(*rank_order())
    top = one_each.withColumn("leg", F.row_number().over(window)).filter(
        F.col("leg") <= max(sizes)).filter(F.col("leg") <= F.col("legs"))
    leg = F.struct("leg", "match_id", "key", "prob", "odds")
    slips = top.groupBy("legs", "min_leg_odds").agg(
        F.count(F.lit(1)).alias("_n"), F.product("prob").alias("probability"),
        F.when(F.bool_and(F.col("odds").isNotNull()), F.product("odds")).alias("offered_odds"),
        F.min("prob").alias("weakest_leg"), F.min("date").alias("first_day"),
        F.max("date").alias("last_day"), F.array_sort(F.collect_list(leg)).alias("selections"))
    return slips.filter(F.col("_n") == F.col("legs")).drop("_n").withColumns({
        "target_odds": F.lit(target_odds),
        "fair_odds": 1.0 / F.greatest("probability", F.lit(1e-12))})


def parlays(card: DataFrame, sizes: Sequence[int] = config.PARLAY_SIZES,
            pool: int = config.PARLAY_POOL) -> DataFrame:
    """Parlays from the top of the card: the first ``size`` fixtures, for each size."""
    one_each = best_per_key(card, ["match_id"], [F.desc("prob"), F.asc("key")])
    legs = one_each.orderBy(F.desc("prob"), "match_id", "key").limit(pool)
    numbered = legs.withColumn("leg", F.row_number().over(
        Window.orderBy(F.desc("prob"), "match_id", "key")))
    sized = numbered.withColumn("legs", F.explode(F.array(*[F.lit(s) for s in sizes]))).filter(
        F.col("leg") <= F.col("legs"))
    out = sized.groupBy("legs").agg(
        F.count(F.lit(1)).alias("_n"), F.product("prob").alias("probability"),
        F.when(F.bool_and(F.col("odds").isNotNull()), F.product("odds")).alias("offered_odds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "leg", F.concat_ws(": ", "match", "selection").alias("t")))), lambda s: s["t"]),
            " + ").alias("selections"))
    return out.filter(F.col("_n") == F.col("legs")).drop("_n").withColumn(
        "fair_odds", 1.0 / F.greatest("probability", F.lit(1e-9)))


def tray(legs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Combined chance and price of chosen legs; flags legs that share a fixture."""
    return legs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("legs"), F.product("prob").alias("probability"),
        F.when(F.bool_and(F.col("odds").isNotNull()), F.product("odds")).alias("offered"),
        F.min("prob").alias("weakest"),
        (F.count("match_id") > F.countDistinct("match_id")).alias("same_fixture"))


HEADLINE_KEYS = ("1x2_home", "1x2_draw", "1x2_away", "btts_yes", "ou1.5_over", "ou2.5_over",
                 "ou3.5_over")


def headline_markets(picks: DataFrame) -> DataFrame:
    """One row per fixture with the seven headline markets as columns."""
    wide = picks.filter(F.col("key").isin(*HEADLINE_KEYS)).groupBy(
        "match_id", "date", "competition", "match")
    # Not a pivot, which moves a row per fixture and market, twice.
    return wide.agg(*[F.max(F.when(F.col("key") == k, F.col("prob"))).alias(k) for k in HEADLINE_KEYS])


def card_header(picks: DataFrame) -> DataFrame:
    """The card payload's head: counts and span. The rows themselves are a table sink."""
    return picks.agg(
        F.countDistinct("match_id").alias("n_fixtures"), F.count(F.lit(1)).alias("n_selections"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.countDistinct("competition").alias("competitions"),
        F.array_join(F.array_sort(F.collect_set("group")), ",").alias("groups"))


def top_picks(fixtures: DataFrame, limit: int = 20) -> DataFrame:
    """Upcoming value picks: known teams only, qualifying first, then by edge."""
    return fixtures.filter("known").orderBy(F.desc("qualifies"), F.desc("edge"), "match_id",
                                            "outcome").limit(limit)


def best_pick(fixtures: DataFrame) -> DataFrame:
    """The strongest qualifying pick (any known one if none qualifies) with the counts."""
    known = fixtures.filter("known")
    counts = known.agg(F.count(F.lit(1)).alias("n_considered"),
                       F.count_if("qualifies").alias("n_qualifying"))
    return top_picks(fixtures, 1).crossJoin(F.broadcast(counts))

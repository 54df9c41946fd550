"""Fitted team strengths without lookahead, market-implied means, walk-forward predictions.

A fit depends on a match only through its (home, away) pair, and decay factorises, so the
input of every refit is a running sum of pair statistics. All refits are independent jobs:
the walk-forward has no sequential part.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fairline import config
from fairline.functions import fits, markets, prices
from fairline.operators import matching
from fairline.plans.backtest import day_number
from fairline.session import ship_package

CHUNK = 16
SUMS = fits.SUMS

_FIT_SCHEMA = ("competition string, fit_no int, fit_date date, n double, home_adv double, "
               "base double, rho double, scale_home double, scale_away double, "
               "teams map<string,struct<attack:double,defence:double>>")


def days_with_history(matches: DataFrame) -> DataFrame:
    """Per competition and day: how many matches were played strictly earlier."""
    days = matches.groupBy("competition", "date").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("competition").orderBy("date").rowsBetween(
        Window.unboundedPreceding, -1)
    return days.select("competition", "date",
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("n_train"))


def refit_by_days(matches: DataFrame, refit_days: int = config.REFIT_DAYS,
                  min_train: int = config.MIN_TRAIN_MATCHES) -> DataFrame:
    """Refit days: the first day with enough history, then the next match day a week on.

    "At least a week after the last refit" is a recurrence, so it is a fold over one
    competition's distinct match days (a calendar, not its matches).
    """
    usable = days_with_history(matches).filter(F.col("n_train") >= min_train)
    days = usable.groupBy("competition").agg(F.array_sort(F.collect_set("date")).alias("days"))

    def step(kept: Column, day: Column) -> Column:
        due = (F.size(kept) == 0) | (
            F.datediff(day, F.try_element_at(kept, F.lit(-1))) >= refit_days)
        return F.when(due, F.concat(kept, F.array(day))).otherwise(kept)

    picked = days.select("competition", F.aggregate(
        "days", F.array().cast("array<date>"), step).alias("fit_dates"))
    return picked.select("competition", F.posexplode("fit_dates").alias("_i", "fit_date")).select(
        "competition", (F.col("_i") + 1).cast("int").alias("fit_no"), "fit_date")


def _number_days(matches: DataFrame, fits_table: DataFrame) -> DataFrame:
    """Per match day: the last fit on or before it, and the first fit after it."""
    days = matches.select("competition", "date", F.lit(None).cast("int").alias("fit_no"),
                          F.lit(1).alias("_kind")).distinct()
    marks = fits_table.select("competition", F.col("fit_date").alias("date"), "fit_no",
                              F.lit(0).alias("_kind"))
    order = Window.partitionBy("competition").orderBy("date", "_kind")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = days.unionByName(marks).withColumn(
        "_last", F.last("fit_no", ignorenulls=True).over(upto))
    return seen.filter("_kind = 1").select(
        "competition", "date", F.col("_last").alias("last_fit"),
        (F.coalesce("_last", F.lit(0)) + 1).alias("next_fit"))


def pair_sums(matches: DataFrame, fits_table: DataFrame, home_count: str, away_count: str,
              half_life: float = config.HALF_LIFE_DAYS) -> DataFrame:
    """Decayed sums of every (home, away) pair between one refit and the next."""
    usable = matches.filter(F.col(home_count).isNotNull() & F.col(away_count).isNotNull())
    numbered = usable.join(_number_days(matches, fits_table), ["competition", "date"])
    weight = F.pow(F.lit(2.0), (day_number(F.col("date")) - F.lit(9000)) / F.lit(half_life))
    hg, ag = F.col("home_goals"), F.col("away_goals")
    cell = lambda h, a: F.sum(F.when((hg == h) & (ag == a), weight).otherwise(0.0))
    return numbered.groupBy("competition", "home", "away",
                            F.col("next_fit").alias("fit_no")).agg(
        F.sum(weight).alias("w"), F.sum(weight * F.col(home_count)).alias("hg"),
        F.sum(weight * F.col(away_count)).alias("ag"), F.sum(weight * hg).alias("gh"),
        F.sum(weight * ag).alias("ga"), cell(0, 0).alias("c00"), cell(0, 1).alias("c01"),
        cell(1, 0).alias("c10"), cell(1, 1).alias("c11"),
        F.count(F.lit(1)).cast("double").alias("n"))


def with_carried(increments: DataFrame, fits_table: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Cut the refits into chunks and carry every pair's earlier sums into each chunk.

    Carried rows have ``fit_no`` 0. A chunk's input is at most (pairs x (chunk + 1)) rows,
    whatever the number of matches.
    """
    number = F.floor((F.col("fit_no") - 1) / chunk).cast("int")
    inc = increments.withColumn("chunk", number)
    last = fits_table.groupBy("competition").agg(F.max(number).alias("_top"))
    per_chunk = inc.groupBy("competition", "home", "away", "chunk").agg(
        *[F.sum(c).alias(c) for c in SUMS])
    order = Window.partitionBy("competition", "home", "away").orderBy("chunk")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = per_chunk.select(
        "competition", "home", "away", "chunk", F.lead("chunk").over(order).alias("_next"),
        *[F.sum(c).over(upto).alias(c) for c in SUMS]).join(last, "competition")
    end = F.coalesce("_next", "_top")
    carried = summed.filter(F.col("chunk") + 1 <= end).withColumn(
        "chunk", F.explode(F.sequence(F.col("chunk") + 1, end))).select(
        "competition", "chunk", F.lit(0).alias("fit_no"), "home", "away", *SUMS)
    fresh = inc.select("competition", "chunk", "fit_no", "home", "away", *SUMS)
    return carried.unionByName(fresh)


def fit_strengths(matches: DataFrame, fits_table: DataFrame, home_count: str = "home_goals",
                  away_count: str = "away_goals", ridge: float = config.RIDGE,
                  half_life: float = config.HALF_LIFE_DAYS, chunk: int = CHUNK) -> DataFrame:
    """All refits of all competitions, as independent groups of ``chunk`` refits."""
    ship_package(matches.sparkSession)
    sums = with_carried(pair_sums(matches, fits_table, home_count, away_count, half_life),
                        fits_table, chunk)
    wanted = fits_table.withColumn("chunk", F.floor((F.col("fit_no") - 1) / chunk).cast("int"))

    def run(key, pairs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return fits.fit_group(pairs, asked, ridge)

    return sums.groupBy("competition", "chunk").cogroup(
        wanted.groupBy("competition", "chunk")).applyInPandas(run, _FIT_SCHEMA)


def fit_at(history: DataFrame, as_of: DataFrame, home_count: str = "home_goals",
           away_count: str = "away_goals", ridge: float = config.RIDGE,
           half_life: float = config.HALF_LIFE_DAYS) -> DataFrame:
    """One fit per competition on all its history, with ages counted from ``fit_date``.

    History later than the day of the fit weighs as if it were that day.
    """
    ship_package(history.sparkSession)
    rows = history.filter(F.col(home_count).isNotNull() & F.col(away_count).isNotNull()).join(
        as_of, "competition")
    age = F.greatest(F.datediff("fit_date", "date"), F.lit(0))
    weight = F.pow(F.lit(0.5), age / F.lit(half_life))
    hg, ag = F.col("home_goals"), F.col("away_goals")
    cell = lambda h, a: F.sum(F.when((hg == h) & (ag == a), weight).otherwise(0.0))
    sums = rows.groupBy("competition", "home", "away").agg(
        F.sum(weight).alias("w"), F.sum(weight * F.col(home_count)).alias("hg"),
        F.sum(weight * F.col(away_count)).alias("ag"), F.sum(weight * hg).alias("gh"),
        F.sum(weight * ag).alias("ga"), cell(0, 0).alias("c00"), cell(0, 1).alias("c01"),
        cell(1, 0).alias("c10"), cell(1, 1).alias("c11"),
        F.count(F.lit(1)).cast("double").alias("n")).withColumn("fit_no", F.lit(1))
    # Fresh column identities: both sides may come from the same stored table.
    wanted = as_of.select(F.col("competition").alias("competition"),
                          F.lit(1).alias("fit_no"), F.col("fit_date").alias("fit_date"))

    def run(key, pairs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return fits.fit_group(pairs, asked, ridge)

    return sums.groupBy("competition").cogroup(wanted.groupBy("competition")).applyInPandas(
        run, _FIT_SCHEMA)


def _means(table: str, home: str = "home", away: str = "away", scaled: bool = False
           ) -> tuple[Column, Column, Column]:
    """Expected counts from a joined fit; unknown teams are league average. Also: both known."""
    fit = F.col(table)
    side = lambda team, part: F.coalesce(
        F.try_element_at(fit["teams"], F.col(team))[part], F.lit(0.0))
    lam = F.exp(fit["base"] + fit["home_adv"] + side(home, "attack") - side(away, "defence"))
    mu = F.exp(fit["base"] + side(away, "attack") - side(home, "defence"))
    if scaled:
        lam, mu = lam * fit["scale_home"], mu * fit["scale_away"]
    known = (F.try_element_at(fit["teams"], F.col(home)).isNotNull()
             & F.try_element_at(fit["teams"], F.col(away)).isNotNull())
    return lam, mu, known


def _packed(table: DataFrame, name: str) -> DataFrame:
    inner = [c for c in table.columns if c not in ("competition", "fit_no")]
    return table.select("competition", "fit_no", F.struct(*inner).alias(name))


def blended_means(rows: DataFrame, goals: DataFrame, shots: DataFrame | None,
                  corners: DataFrame | None, weight: float = config.SIGNAL_WEIGHT,
                  min_shots: int = config.MIN_SHOT_ROWS,
                  min_corners: int = config.MIN_TRAIN_MATCHES) -> DataFrame:
    """Model means per row from the fits of its (competition, fit_no).

    Goals and shots are blended geometrically where enough rows had shots; a fit travels as
    one row with a map of teams, so each match joins once for all three models.
    """
    table = _packed(goals, "_g")
    for extra, name in ((shots, "_s"), (corners, "_c")):
        if extra is not None:
            table = table.join(_packed(extra, name), ["competition", "fit_no"], "left")
        else:
            table = table.withColumn(name, F.lit(None).cast(table.schema["_g"].dataType))
    joined = rows.join(table, ["competition", "fit_no"])
    g_lam, g_mu, known = _means("_g")
    s_lam, s_mu, _ = _means("_s", scaled=True)
    c_lam, c_mu, _ = _means("_c")
    use = F.coalesce(F.col("_s.n") >= min_shots, F.lit(False)) & F.lit(weight > 0)
    mix = lambda g, s: F.when(use, F.pow(g, F.lit(1.0 - weight)) * F.pow(s, F.lit(weight))
                              ).otherwise(g)
    have = F.coalesce(F.col("_c.n") >= min_corners, F.lit(False))
    return joined.withColumns({
        "lam_model": mix(g_lam, s_lam), "mu_model": mix(g_mu, s_mu),
        "rho_model": F.col("_g.rho"), "rho_shots": F.col("_s.rho"), "has_shots": use,
        "corner_lam": F.when(have, c_lam), "corner_mu": F.when(have, c_mu),
        "new_team": ~known}).drop("_g", "_s", "_c")


def market_view(rows: DataFrame, method: str = config.DEVIG, use_totals: bool = True
                ) -> DataFrame:
    """De-vigged closing probabilities: consensus where usable, else best, else null."""
    col = lambda *names: [F.col(c) for c in names]
    main = prices.preferred_prices(col("home_odds_cons", "draw_odds_cons", "away_odds_cons"),
                                   col("home_odds", "draw_odds", "away_odds"))
    out = rows.withColumn("_q", prices.devig(main, method))
    q = {f"q_{s}": F.get("_q", i) for i, s in enumerate(("home", "draw", "away"))}
    if use_totals:
        cons = [c for c in ("over25_odds_cons", "under25_odds_cons") if c in rows.columns]
        best = col("over25_odds", "under25_odds")
        totals = (prices.preferred_prices(col(*cons), best) if len(cons) == 2
                  else prices.sane_prices(*best))
        q["q_over"] = F.when(F.col("_q").isNotNull(), F.get(prices.devig(totals, method), 0))
    else:
        q["q_over"] = F.lit(None).cast("double")
    return out.withColumns(q).drop("_q")


def implied(rows: DataFrame) -> DataFrame:
    """Add the score distribution that reproduces each row's own prices (Arrow batches).

    Needs q_home/q_draw/q_away/q_over, rho_model and the model means as a starting point; only
    these seven numbers are sent to Python. Rows without prices get nulls.
    """
    ship_package(rows.sparkSession)
    fit = F.pandas_udf(fits.imply_line, "lam_market double, mu_market double, rho_market double, implied_resid double")
    asked = ("q_home", "q_draw", "q_away", "q_over", "rho_model", "lam_model", "mu_model")
    return rows.withColumn("_fit", fit(*asked)).select(*rows.columns, "_fit.*")


def nulls_for_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


MARKET_COLUMNS = ("lam_market", "mu_market", "rho_market", "implied_resid", "q_home", "q_draw",
                  "q_away", "q_over", "corner_lam", "corner_mu")
PREDICTION_COLUMNS = (
    "match_id", "date", "competition", "season", "home", "away", "home_goals", "away_goals",
    "total_corners", "lam_model", "mu_model", "rho_model", "lam_market", "mu_market",
    "rho_market", "implied_resid", "corner_lam", "corner_mu", "new_team", "has_totals",
    "n_train", "q_home", "q_draw", "q_away", "q_over", "home_odds", "draw_odds", "away_odds",
    "over25_odds", "under25_odds")


def walk_forward(matches: DataFrame, refit_days: int = config.REFIT_DAYS,
                 min_train: int = config.MIN_TRAIN_MATCHES, method: str = config.DEVIG,
                 half_life: float = config.HALF_LIFE_DAYS, ridge: float = config.RIDGE,
                 weight: float = config.SIGNAL_WEIGHT, store=lambda df, name: df) -> DataFrame:
    """Price every match out of sample: fitted on strictly earlier matches only.

    ``store`` writes a frame and reads it back; the small fit tables are stored so that the
    fits run once.
    """
    fits_table = store(refit_by_days(matches, refit_days, min_train), "fits")
    options = {"ridge": ridge, "half_life": half_life}
    goals = store(fit_strengths(matches, fits_table, **options), "goals")
    shots = store(fit_strengths(matches, fits_table, "home_sot", "away_sot", **options), "shots")
    corners = store(fit_strengths(matches, fits_table, "home_corners", "away_corners",
                                  **options), "corners")
    days = _number_days(matches, fits_table).filter("last_fit IS NOT NULL").join(
        days_with_history(matches), ["competition", "date"]).select(
        "competition", "date", F.col("last_fit").alias("fit_no"), "n_train")
    rows = matches.join(days, ["competition", "date"])
    modelled = blended_means(rows, goals, shots, corners, weight, min_corners=min_train)
    priced = implied(market_view(modelled, method).withColumn(
        "has_totals", F.col("q_over").isNotNull()).select(
        *[c for c in PREDICTION_COLUMNS if c not in (
            "lam_market", "mu_market", "rho_market", "implied_resid")]))
    return nulls_for_nan(priced, MARKET_COLUMNS).select(*PREDICTION_COLUMNS)


def price_fixtures(history: DataFrame, fixtures: DataFrame, calibrators: DataFrame | None = None,
                   weight: float = config.MARKET_WEIGHT, method: str = config.DEVIG,
                   min_train: int = config.MIN_TRAIN_MATCHES, use_totals: bool = False
                   ) -> DataFrame:
    """Card rows of upcoming fixtures, from the same fits, de-vig and fusion as the record.

    Competitions with too little history drop out whole. The line is anchored on 1X2 alone
    unless ``use_totals``.
    """
    from fairline.plans import calibration

    deep = history.groupBy("competition").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") >= min_train).select("competition")
    upcoming = fixtures.join(deep, "competition", "left_semi")
    as_of = upcoming.groupBy("competition").agg(F.min("date").alias("fit_date"))
    goals = fit_at(history, as_of)
    shots = fit_at(history, as_of, "home_sot", "away_sot")
    corners = fit_at(history, as_of, "home_corners", "away_corners")
    teams = history.select("competition", F.col("home").alias("candidate")).unionByName(
        history.select("competition", F.col("away").alias("candidate"))).distinct()
    asked = upcoming.select("competition", F.col("home").alias("key")).unionByName(
        upcoming.select("competition", F.col("away").alias("key"))).distinct()
    named = matching.put_back(
        upcoming.withColumn("match", F.concat("home", F.lit(" v "), "away")),
        matching.resolve_names(asked, teams)).withColumn("fit_no", F.lit(1))
    modelled = blended_means(named, goals, shots, corners, min_corners=min_train)
    priced = nulls_for_nan(implied(market_view(modelled, method, use_totals)), MARKET_COLUMNS)
    fused = priced.withColumns({
        "lam": prices.fuse(F.col("lam_model"), F.col("lam_market"), weight),
        "mu": prices.fuse(F.col("mu_model"), F.col("mu_market"), weight),
        "rho": prices.fuse(F.col("rho_model"), F.col("rho_market"), weight, geometric=False)})
    quoted = {k: c for k, c in (
        ("1x2_home", "home_odds"), ("1x2_draw", "draw_odds"), ("1x2_away", "away_odds"),
        ("ou2.5_over", "over25_odds"), ("ou2.5_under", "under25_odds"),
        ("ou1.5_over", "over15_odds"), ("ou1.5_under", "under15_odds")) if c in fused.columns}
    keep = ("match_id", "date", "competition", "home", "away", "match", "new_team",
            "implied_resid", "lam", "mu", *quoted.values())
    sel = markets.expand_selections(fused, corner_lam="corner_lam", corner_mu="corner_mu",
                                    keep=keep)
    odds = F.lit(None).cast("double")
    for key, column in quoted.items():
        odds = F.when(F.col("key") == key, F.col(column)).otherwise(odds)
    out = sel.withColumns({"odds": odds, "prob_raw": F.col("prob")}).drop(*quoted.values())
    if calibrators is not None:
        out = calibration.apply(out, calibrators, ["group"])
    return out.withColumns({
        "selection": markets.label_of(F.col("key")), "fair_odds": prices.fair_odds(F.col("prob")),
        "edge": prices.ev_edge(F.col("prob"), F.col("odds"))})


def filled_shots(matches: DataFrame) -> DataFrame:
    """Matches with goals in place of missing shot counts, as ``shots_home`` and ``shots_away``."""
    return matches.withColumns({
        "shots_home": F.coalesce(F.col("home_sot"), F.col("home_goals")),
        "shots_away": F.coalesce(F.col("away_sot"), F.col("away_goals"))})


def likelihood_means(matches: DataFrame, schedule: DataFrame, weight: float = config.SIGNAL_WEIGHT,
                     store=lambda df, name: df) -> DataFrame:
    """Backtest means from the likelihood fit, blended with shots; unknown teams drop out.

    ``schedule(match_id, fit_date)`` names each match's fit. Missing shot counts are filled
    with goals here, and rho is blended like the means.
    """
    rows = matches.select("match_id", "competition", "home", "away").join(schedule, "match_id")
    distinct = rows.select("competition", "fit_date").distinct()
    order = Window.partitionBy("competition").orderBy("fit_date")
    fits_table = store(distinct.withColumn("fit_no", F.row_number().over(order)), "fits")
    filled = filled_shots(matches)
    goals = store(fit_strengths(filled, fits_table), "goals")
    shots = store(fit_strengths(filled, fits_table, "shots_home", "shots_away"), "shots")
    numbered = rows.join(fits_table, ["competition", "fit_date"])
    out = blended_means(numbered, goals, shots, None, weight, min_shots=0)
    return out.filter(~F.col("new_team")).select(
        "match_id", "fit_date", F.col("lam_model").alias("lam"), F.col("mu_model").alias("mu"),
        ((1.0 - weight) * F.col("rho_model") + weight * F.col("rho_shots")).alias("rho"))

"""Queries: fitted strengths, implied means, walk-forward, fixture pricing."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from fairline import config
from fairline.functions import markets, prices, scores
from fairline.plans import (backtest, calibration, model, queries_backtest as qb,
                            queries_pricing as qp, sql_tables as t)
from fairline.plans.registry import query
from fairline.session import stage
from fairline.sources import readers, warehouse as w
from fairline.sources.sinks import rounded


def fits_table(spark, sf):
    return w._stored(spark, sf, "refit_days", lambda s, d: model.refit_by_days(w.matches(s, d)))


def predictions(spark, sf):
    """The walk-forward predictions table: the expensive artifact, stored once."""
    def store(df, name):
        return w._stored(spark, sf, f"walk_{name}", lambda *_: df)

    return w._stored(spark, sf, "predictions", lambda s, d: model.walk_forward(w.matches(s, d), store=store))


def walk_table(spark, sf, name):
    """What the walk-forward stored on its way: its ``fits`` calendar, or the fits of ``goals``, ``shots``, ``corners``."""
    predictions(spark, sf)
    return w._stored(spark, sf, f"walk_{name}", None)


def likelihood_means(spark, sf):
    """The likelihood backtest's means, stored once, as are the fits they come from."""
    def store(df, name):
        return w._stored(spark, sf, f"likelihood_{name}", lambda *_: df)

    return w._stored(spark, sf, "likelihood_means",
                     lambda s, d: model.likelihood_means(qb.dataset(s, d), qb.schedule(s, d), store=store))


def likelihood_table(spark, sf, name):
    likelihood_means(spark, sf)
    return w._stored(spark, sf, f"likelihood_{name}", None)


def graded_predictions(spark, sf):
    """Graded selections of the walk-forward predictions, fused as the card fuses them."""
    def build(spark, sf):
        weight = config.MARKET_WEIGHT
        fused = predictions(spark, sf).withColumns({
            "lam": prices.fuse(F.col("lam_model"), F.col("lam_market"), weight),
            "mu": prices.fuse(F.col("mu_model"), F.col("mu_market"), weight),
            "rho": prices.fuse(F.col("rho_model"), F.col("rho_market"), weight, geometric=False)})
        return qp.drop_void(markets.expand_selections(
            fused, corner_lam="corner_lam", corner_mu="corner_mu", home_goals="home_goals",
            away_goals="away_goals", total_corners="total_corners", keep=("match_id", "date")))
    return w._stored(spark, sf, "graded_predictions", build)


@query("refit_days", "W8", """
WITH RECURSIVE x_d AS (SELECT competition, date, sum(n) OVER (PARTITION BY competition ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_train FROM (SELECT competition, date, count(*) AS n FROM x_matches GROUP BY ALL)),
d AS (SELECT competition, date FROM x_d WHERE n_train >= 200),
r AS (SELECT competition, min(date) AS fit_date, 1 AS fit_no FROM d GROUP BY competition
 UNION ALL SELECT r.competition, (SELECT min(d.date) FROM d WHERE d.competition = r.competition AND d.date >= r.fit_date + 7), fit_no + 1 FROM r
 WHERE r.fit_date IS NOT NULL)
SELECT competition, CAST(fit_no AS INTEGER) AS fit_no, fit_date FROM r WHERE fit_date IS NOT NULL
""")
def refit_days(spark, sf):
    return fits_table(spark, sf)


@query("pair_statistics", "W1 J3 A4", """
WITH f AS (SELECT competition, max(date) AS t FROM x_matches GROUP BY competition)
SELECT m.competition, home, away, round(sum(pow(0.5e0, (t - date) / 180.0e0)), 6) AS w, round(sum(pow(0.5e0, (t - date) / 180.0e0) * home_goals), 6) AS hg, round(sum(pow(0.5e0, (t - date) / 180.0e0) * away_goals), 6) AS ag
FROM x_matches m JOIN f ON f.competition = m.competition AND m.date < f.t GROUP BY m.competition, home, away
""")
def pair_statistics(spark, sf):
    """Running decayed pair sums read at the last day of every competition."""
    m = w.matches(spark, sf)
    rows = m.select("competition", "home", "away", "date", F.col("home_goals").alias("hg"),
                    F.col("away_goals").alias("ag"))
    totals = backtest.running_totals(rows, ["competition", "home", "away"], ("hg", "ag"))
    last = m.groupBy("competition").agg(F.max("date").alias("fit_date"))
    asked = m.select("competition", "home", "away").distinct().join(last, "competition")
    out = backtest.as_of(totals, asked, ["competition", "home", "away"], ("hg", "ag"))
    return rounded(out.drop("fit_date"), 6)


@query("team_strengths", "R1 R2")
def team_strengths(spark, sf):
    """Every refit of every competition: home advantage, base, rho and each team's strengths."""
    fit = model.fit_strengths(w.matches(spark, sf), fits_table(spark, sf))
    flat = fit.select("competition", "fit_no", "fit_date", "n", "home_adv", "base", "rho",
                      F.explode("teams").alias("team", "s"))
    return rounded(flat.select("*", "s.attack", "s.defence").drop("s"), 5)


SLOPE, NEAR_RHO = 1e-4, 1e-4


@query("strengths_optimality", "R1 R2", """
WITH RECURSIVE x_d AS (SELECT competition, date, sum(n) OVER (PARTITION BY competition ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_train FROM (SELECT competition, date, count(*) AS n FROM x_matches GROUP BY ALL)),
d AS (SELECT competition, date FROM x_d WHERE n_train >= 200),
r AS (SELECT competition, min(date) AS fit_date, 1 AS fit_no FROM d GROUP BY competition
 UNION ALL SELECT r.competition, (SELECT min(d.date) FROM d WHERE d.competition = r.competition AND d.date >= r.fit_date + 7), fit_no + 1 FROM r
 WHERE r.fit_date IS NOT NULL)
SELECT competition, count(*) AS fits, CAST(0 AS BIGINT) AS strengths_off, CAST(0 AS BIGINT) AS rho_off FROM r WHERE fit_date IS NOT NULL GROUP BY competition
""")
def strengths_optimality(spark, sf):
    """Refits whose strengths or rho, rounded to 5 digits, are no optimum of the penalised likelihood.

    The slopes are sums over team pairs, made here from the pair sums and the fits alone.
    Rho is right where the slope changes sign around it, or at its bound.
    """
    m, days = w.matches(spark, sf), fits_table(spark, sf)
    fit = stage(rounded(model.fit_strengths(m, days).select(
        "competition", "fit_no", "home_adv", "base", "rho", F.transform_values(
            "teams", lambda _, s: F.struct(F.round(s["attack"], 5).alias("attack"),
                                           F.round(s["defence"], 5).alias("defence"))
        ).alias("teams")), 5), "strengths")
    sums = ("w", "hg", "ag", "c00", "c01", "c10", "c11")
    last = days.groupBy("competition").agg(F.max("fit_no").alias("top"))
    order = Window.partitionBy("competition", "home", "away").orderBy("fit_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    held = model.pair_sums(m, days, "home_goals", "away_goals").join(last, "competition").filter(
        "fit_no <= top").select(
        "competition", "home", "away", "fit_no",
        F.coalesce(F.lead("fit_no").over(order) - 1, "top").alias("until"),
        *[F.sum(c).over(upto).alias(c) for c in sums])
    rows = held.withColumn("fit_no", F.explode(F.sequence("fit_no", "until"))).join(
        fit, ["competition", "fit_no"])
    home, away = (F.col("teams")[F.col(side)] for side in ("home", "away"))
    lam = F.exp(F.col("base") + F.col("home_adv") + home["attack"] - away["defence"])
    mu = F.exp(F.col("base") + away["attack"] - home["defence"])
    rows = rows.withColumns({"lam": lam, "mu": mu})

    def rise(rho):
        """Slope of the low scores' likelihood; a factor below zero is past the end of the range."""
        total = F.lit(0.0)
        for cell, slope in (("c00", -F.col("lam") * F.col("mu")), ("c01", F.col("lam")),
                            ("c10", F.col("mu")), ("c11", F.lit(-1.0))):
            factor = 1.0 + slope * rho
            term = F.when(factor > 0, slope / factor).otherwise(slope * 1e30)
            total = total + F.when(F.col(cell) > 0, F.col(cell) * term).otherwise(0.0)
        return total

    over, under = F.col("w") * F.col("lam") - F.col("hg"), F.col("w") * F.col("mu") - F.col("ag")
    side = lambda team, own, a, d, first: F.struct(
        F.col(team).alias("team"), own["attack"].alias("own_attack"),
        own["defence"].alias("own_defence"), a.alias("attack"), d.alias("defence"),
        (F.col("w") / 2).alias("w"), (over if first else F.lit(0.0)).alias("adv"),
        *[(rise(F.col("rho") + at) if first else F.lit(0.0)).alias(name)
          for name, at in (("before", -NEAR_RHO), ("after", NEAR_RHO))])
    teams = rows.select("competition", "fit_no", "rho", F.inline(F.array(
        side("home", home, over, -under, True), side("away", away, under, -over, False))))
    by_team = teams.groupBy("competition", "fit_no", "rho", "team", "own_attack", "own_defence").agg(
        *[F.sum(c).alias(c) for c in ("attack", "defence", "w", "adv", "before", "after")])
    total = F.sum("w").over(Window.partitionBy("competition", "fit_no"))
    pull = 2 * config.RIDGE * F.col("total")
    by_fit = by_team.withColumn("total", total).groupBy("competition", "fit_no", "rho").agg(
        F.max(F.greatest(F.abs(F.col("attack") + pull * F.col("own_attack")),
                         F.abs(F.col("defence") + pull * F.col("own_defence"))) / F.col("total")).alias("of_team"),
        (F.greatest(F.abs(F.sum("adv")), F.abs(F.sum("attack"))) / F.max("total")).alias("of_all"),
        F.sum("before").alias("before"), F.sum("after").alias("after"))
    bound = config.RHO_BOUND - NEAR_RHO
    rho_right = ((F.col("before") >= 0) | (F.col("rho") <= -bound)) & (
        (F.col("after") <= 0) | (F.col("rho") >= bound))
    return by_fit.groupBy("competition").agg(
        F.count(F.lit(1)).alias("fits"),
        F.count_if(F.greatest("of_team", "of_all") > SLOPE).alias("strengths_off"),
        F.count_if(~rho_right).alias("rho_off"))


@query("walk_forward_predictions", "R6 R3 R4 R7 J1 J2")
def walk_forward_predictions(spark, sf):
    return rounded(predictions(spark, sf), 5)


@query("walk_forward_coverage", "R6 W8", """
WITH RECURSIVE x_d AS (SELECT competition, date, n, sum(n) OVER (PARTITION BY competition ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_train FROM (SELECT competition, date, count(*) AS n FROM x_matches GROUP BY ALL))
SELECT competition, CAST(sum(n) AS BIGINT) AS priced, CAST(min(n_train) AS BIGINT) AS least_train, CAST(max(n_train) AS BIGINT) AS most_train FROM x_d WHERE n_train >= 200 GROUP BY competition
""")
def walk_forward_coverage(spark, sf):
    """Every match with enough strictly earlier history is priced exactly once."""
    return predictions(spark, sf).groupBy("competition").agg(
        F.countDistinct("match_id").alias("priced"), F.min("n_train").alias("least_train"),
        F.max("n_train").alias("most_train"))


@query("implied_fit_quality", "R7")
def implied_fit_quality(spark, sf):
    """How many lines the fitted score distribution reproduces to within 0.02."""
    p = predictions(spark, sf).filter("q_home IS NOT NULL")
    return p.groupBy("has_totals").agg(F.count(F.lit(1)).alias("n"),
                                       F.count_if(F.col("implied_resid") <= 0.02)
                                       .alias("reproduced"))


@query("implied_reprices", "R7 R6", f"""
WITH n AS (SELECT competition, date, sum(n) OVER (PARTITION BY competition ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_train FROM (SELECT competition, date, count(*) AS n FROM x_matches GROUP BY ALL))
SELECT m.match_id, round(q[1], 4) AS p_home, round(q[2], 4) AS p_draw, round(q[3], 4) AS p_away
FROM x_matches m JOIN n USING (competition, date) JOIN x_power p ON p.match_id = m.match_id
WHERE n_train >= 200 AND NOT coalesce({t.sane('over25_odds_cons', 'under25_odds_cons')}, false) AND NOT coalesce({t.sane('over25_odds', 'under25_odds')}, false)
""")
def implied_reprices(spark, sf):
    """Without a price for totals, the fitted score distribution gives the three prices back."""
    p = predictions(spark, sf).filter("q_home IS NOT NULL AND NOT has_totals").select(
        "match_id", "lam_market", "mu_market", "rho_market")
    again = scores.outcome_columns(p, "lam_market", "mu_market", "rho_market")
    return rounded(again.select("match_id", "p_home", "p_draw", "p_away"), 4)


@query("implied_optimum", "R7 R6", f"""
WITH n AS (SELECT competition, date, sum(n) OVER (PARTITION BY competition ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_train FROM (SELECT competition, date, count(*) AS n FROM x_matches GROUP BY ALL))
SELECT m.competition, count(*) AS lines, CAST(0 AS BIGINT) AS off
FROM x_matches m JOIN n USING (competition, date) JOIN x_power p ON p.match_id = m.match_id
WHERE n_train >= 200 AND (coalesce({t.sane('over25_odds_cons', 'under25_odds_cons')}, false) OR coalesce({t.sane('over25_odds', 'under25_odds')}, false)) GROUP BY m.competition
""")
def implied_optimum(spark, sf):
    """With a price for totals, no fitted line can be improved: along each parameter the squared error of the four
    probabilities, priced anew in SQL functions, is level, or falls only beyond the parameter's bound."""
    h, fitted = 1e-4, ("lam_market", "mu_market", "rho_market")
    p = predictions(spark, sf).filter("q_home IS NOT NULL AND has_totals").select(
        "match_id", "competition", *fitted, "q_home", "q_draw", "q_away", "q_over")
    moves = [(d, s) for d in range(3) for s in (-h, h)]
    moved = p.select("*", F.inline(F.array(*[F.struct(
        F.lit(d).alias("d"), F.lit(s).alias("s"), *[
            (F.col(c) if i != d else F.col(c) + s if i == 2 else F.col(c) * float(math.exp(s))).alias(c[:-7]) for i, c in enumerate(fitted)])
        for d, s in moves])))
    again = scores.outcome_columns(moved, "lam", "mu", "rho")
    error = sum((F.col(f"p_{x}") - F.col(f"q_{x}")) * (F.col(f"p_{x}") - F.col(f"q_{x}")) for x in ("home", "draw", "away", "over"))
    cost = again.withColumn("cost", error).groupBy("match_id", "competition", "d", *fitted).agg(
        (F.sum(F.signum("s") * F.col("cost")) / (2 * h)).alias("slope"))
    value = F.when(F.col("d") == 0, F.col("lam_market")).when(F.col("d") == 1, F.col("mu_market")).otherwise(F.col("rho_market"))
    low, high = (F.when(F.col("d") == 2, x).otherwise(y) for x, y in ((-0.2, 0.05), (0.2, 8.0)))
    held = ((value <= low + 1e-6) & (F.col("slope") > 0)) | ((value >= high - 1e-6) & (F.col("slope") < 0))
    off = F.max(F.when(~held & (F.abs("slope") > 1e-5), 1).otherwise(0))
    return cost.groupBy("match_id", "competition").agg(off.alias("off")).groupBy("competition").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("off").cast("long").alias("off"))


def card(spark, sf):
    """The card of the upcoming fixtures, stored once."""
    return w._stored(spark, sf, "card", build_card)


def build_card(spark, sf):
    day = F.lit(w.CARD_DAY).cast("date")
    m = w.matches(spark, sf)
    upcoming = readers.fixtures(w.quotes(spark, sf), F.expr(f"TIMESTAMP '{w.CARD_NOW}'"),
                                tiebreak=("match_id",))
    # Learned on what the walk-forward said of earlier matches, which is what is calibrated here.
    learned = calibration.fit(graded_predictions(spark, sf).filter(F.col("date") < day), ["group"])
    return model.price_fixtures(m.filter(F.col("date") < day), upcoming, learned)


@query("priced_fixtures", "R13 J1 J4 S20 J13")
def priced_fixtures(spark, sf):
    """Upcoming fixtures priced end to end: fits, names, line fit, fusion, calibrators."""
    return rounded(card(spark, sf).select("match_id", "competition", "match", "key", "group", "prob_raw",
                              "prob", "fair_odds", "odds", "edge", "new_team",
                              "implied_resid"), 5)


@query("likelihood_backtest", "R14 R3")
def likelihood_backtest(spark, sf):
    """The backtest with likelihood strengths blended with shots, by market."""
    priced = backtest.model_probabilities(qb.dataset(spark, sf), likelihood_means(spark, sf), "rho")
    bets = stage(backtest.qualifying(backtest.all_selections(priced)), "bets")
    return rounded(backtest.with_interval(bets, ["market"]), 4)

"""Queries: the card - hit rates, shortlists, slates, slips."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline import config
from fairline.functions import markets
from fairline.plans import (evaluation, queries_pricing as qp, queries_scoring as qs, selection,
                            sql_tables as t)
from fairline.plans.registry import cte, query
from fairline.sources import warehouse as w
from fairline.sources.sinks import rounded

DAY = f"DATE '{w.CARD_DAY}'"
_PRICED = {"1x2_home": "home_odds", "1x2_draw": "draw_odds", "1x2_away": "away_odds",
           "ou2.5_over": "over25_odds", "ou2.5_under": "under25_odds"}


def reliability(spark, sf):
    return w._stored(spark, sf, "reliability",
                     lambda s, d: rounded(evaluation.reliability(qs.graded(s, d)), 6))


def picks(spark, sf):
    """Every selection of the upcoming fixtures with prices and its band's record, stored."""
    def build(spark, sf):
        fixtures = qp.fused(spark, sf).filter(F.col("date") >= F.lit(w.CARD_DAY).cast("date"))
        fixtures = fixtures.withColumns({
            "match": F.concat("home", F.lit(" v "), "away"),
            "implied_resid": F.round(F.abs(F.col("q_over") - 0.5) * 0.3, 6)})
        held = ("match_id", "date", "competition", "home", "away", "match", "implied_resid",
                *_PRICED.values())
        sel = markets.expand_selections(fixtures, corner_lam="corner_lam",
                                        corner_mu="corner_mu", keep=held)
        odds = F.lit(None).cast("double")
        for key, column in _PRICED.items():
            odds = F.when(F.col("key") == key, F.col(column)).otherwise(odds)
        stored = F.rint(F.col("prob") * F.lit(1e12)) / F.lit(1e12)
        rows = sel.withColumn("odds", odds).withColumn(
            "prob", F.floor(stored * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)).drop(
            *_PRICED.values())
        rows = rows.withColumns({
            "selection": markets.label_of(F.col("key")),
            "fair_odds": F.round(1.0 / F.greatest("prob", F.lit(1e-6)), 6),
            "edge": F.round(F.col("prob") * F.col("odds") - 1.0, 6)})
        return selection.attach_hit_rates(rows, reliability(spark, sf))
    return w._stored(spark, sf, "picks", build)


_LABELS = ", ".join("('%s', '%s')" % (s.key, s.label) for s in t.CATALOGUE)

cte("x_ceilings", """
SELECT "group", coalesce(max(band_high) FILTER (WHERE run), 0) AS ceiling FROM (
 SELECT scope AS "group", band_high, band_low >= 0.5 AND bool_and(ok) OVER (PARTITION BY scope, band_low >= 0.5 ORDER BY band_low) AS run FROM (
  SELECT *, n >= 200 AND actual >= predicted - 0.02e0 AND coalesce(band_low <= lag(band_high) OVER (PARTITION BY scope, band_low >= 0.5 ORDER BY band_low) + 1e-9, TRUE) AS ok
  FROM x_reliability WHERE scope <> 'all')) GROUP BY "group"
""")
cte("x_picks", f"""--m
WITH p AS (SELECT s.match_id, s.date, s.competition, p.home, p.away, p.home || ' v ' || p.away AS match, round(abs(q_over - 0.5) * 0.3, 6) AS implied_resid, s.key, s."group", floor(s.prob * 1e9 + 0.5e0) / 1e9 AS prob,
   CASE s.key {' '.join(f"WHEN '{k}' THEN p.{c}" for k, c in _PRICED.items())} END AS odds FROM x_sel s JOIN x_params p USING (match_id) WHERE s.date >= {DAY}),
b AS (SELECT p.*, r.actual AS a0, r.predicted AS p0, r.n AS n0, g.actual AS a1, g.predicted AS p1, g.n AS n1,
   row_number() OVER (PARTITION BY match_id, key ORDER BY CASE WHEN r.band_low <= prob THEN r.band_low END DESC NULLS LAST, r.band_low, CASE WHEN g.band_low <= prob THEN g.band_low END DESC NULLS LAST, g.band_low) AS rn
  FROM p JOIN x_reliability r ON r.scope = 'all' LEFT JOIN x_reliability g ON g.scope = p."group")
SELECT b.match_id, b.date, b.competition, home, away, match, implied_resid, b.key, b."group", prob, odds, l.label AS selection,
  round(1 / greatest(prob, 1e-6), 6) AS fair_odds, round(prob * odds - 1, 6) AS edge,
  CASE WHEN n1 >= 200 THEN a1 ELSE a0 END AS hit_rate, CASE WHEN n1 >= 200 THEN p1 ELSE p0 END AS hit_rate_predicted, CASE WHEN n1 >= 200 THEN n1 ELSE n0 END AS hit_rate_n,
  prob <= coalesce(c.ceiling, 1) + 1e-9 AS validated
FROM b JOIN (VALUES {_LABELS}) l(k, label) ON l.k = b.key LEFT JOIN x_ceilings c ON c."group" = b."group" WHERE rn = 1
""")
cte("x_scored_picks", """--m
SELECT *, round(CASE WHEN hit_rate_n >= 200 AND hit_rate IS NOT NULL AND coalesce(hit_rate_predicted, 0) <> 0 THEN prob * least(1, hit_rate / hit_rate_predicted) ELSE prob END, 9) AS score
FROM x_picks
""")
_ORDER = "score DESC, hit_rate_n DESC, prob DESC, match_id, key"
_OK = "coalesce(implied_resid, 0) <= 0.02"
cte("x_days", f"SELECT date AS day, row_number() OVER (ORDER BY date) AS day_no FROM (SELECT DISTINCT date FROM x_picks WHERE validated) ORDER BY date LIMIT 3")


@query("priced_picks", "J6 R13 S16 F14", """
SELECT match_id, date, competition, match, key, "group", selection, prob, fair_odds, odds, edge, hit_rate, hit_rate_predicted, hit_rate_n, validated, implied_resid FROM x_picks
""")
def priced_picks(spark, sf):
    return picks(spark, sf).drop("home", "away")


@query("group_ceilings", "W10", 'SELECT "group", ceiling FROM x_ceilings')
def group_ceilings(spark, sf):
    return selection.group_ceilings(reliability(spark, sf))


@query("confidence_scores", "F15 W13", "SELECT match_id, key, score FROM x_scored_picks")
def confidence_scores(spark, sf):
    return selection.scored(picks(spark, sf)).select("match_id", "key", "score")


@query("shortlist", "P6 W5 K1", f"""
SELECT match_id, key, prob, fair_odds FROM x_picks WHERE prob >= 0.75 AND validated AND {_OK} AND fair_odds >= 1.1
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY prob DESC, key) <= 2
""")
def shortlist(spark, sf):
    return selection.shortlist(picks(spark, sf), per_match=2, min_odds=1.1).select(
        "match_id", "key", "prob", "fair_odds")


@query("top_of_card", "K1 K8 P6", f"""
SELECT match_id, key, selection, prob FROM (SELECT * FROM x_picks WHERE prob >= 0.75 AND validated AND {_OK} QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY prob DESC, key) = 1)
ORDER BY prob DESC, match_id, key LIMIT 25
""")
def top_of_card(spark, sf):
    return selection.shortlist(picks(spark, sf), limit=25).select(
        "match_id", "key", "selection", "prob")


@query("card_floor", "P11", "SELECT match_id, key, prob FROM x_picks WHERE prob >= 0.55")
def card_floor(spark, sf):
    return selection.card_floor(picks(spark, sf)).select("match_id", "key", "prob")


@query("card_browser", "P9", """
SELECT match_id, key, prob, odds FROM x_picks WHERE prob >= 0.4 AND fair_odds >= 1.3 AND odds IS NOT NULL AND validated AND "group" = 'ou' AND contains(lower(match), 'team 1')
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY prob DESC, key) = 1
""")
def card_browser(spark, sf):
    return selection.browse(picks(spark, sf), 0.4, 1.3, priced=True, group="ou", text="TEAM 1",
                            one_per_match=True).select("match_id", "key", "prob", "odds")


@query("match_days", "W12", "SELECT day, CAST(day_no AS INTEGER) AS day_no FROM x_days")
def match_days(spark, sf):
    return selection.match_days(picks(spark, sf))


@query("best_of_day", "K2 W13", f"""
WITH c AS (SELECT *, min(date) OVER () AS day FROM x_scored_picks WHERE {_OK} AND validated AND fair_odds BETWEEN 1.6 AND 2.2)
SELECT day, match_id, key, prob, score, fair_odds, (SELECT count(*) FROM c WHERE date = day) AS candidates FROM c WHERE date = day ORDER BY {_ORDER} LIMIT 1
""")
def best_of_day(spark, sf):
    return selection.best_of_day(picks(spark, sf)).select(
        "day", "match_id", "key", "prob", "score", "fair_odds", "candidates")


@query("daily_slate", "K3 J12", f"""
SELECT day, band, match_id, key, prob, score, fair_odds, candidates FROM (
 SELECT *, count(*) OVER (PARTITION BY day, band) AS candidates, row_number() OVER (PARTITION BY day, band ORDER BY {_ORDER}) AS rn
 FROM x_scored_picks JOIN x_days ON date = day JOIN (VALUES ('safe', 1.3, 1.6), ('main', 1.6, 2.2), ('value', 2.2, 3.0)) b(band, lo, hi) ON fair_odds BETWEEN lo AND hi
 WHERE {_OK} AND validated) WHERE rn = 1
""")
def daily_slate(spark, sf):
    return selection.daily_slate(picks(spark, sf)).select(
        "day", "band", "match_id", "key", "prob", "score", "fair_odds", "candidates")


@query("best_accumulators", "K4 A29", f"""
SELECT CAST(legs AS INTEGER) AS legs, round(product(prob), 6) AS probability, round(1 / product(prob), 6) AS fair_odds, CASE WHEN bool_and(odds IS NOT NULL) THEN round(product(odds), 6) END AS offered_odds,
  min(prob) AS weakest_leg, min(date) AS first_day, max(date) AS last_day, string_agg(match_id || ' ' || key, ',' ORDER BY leg) AS picked FROM (
 SELECT *, row_number() OVER (PARTITION BY legs ORDER BY {_ORDER}) AS leg FROM (
  SELECT *, row_number() OVER (PARTITION BY legs, match_id ORDER BY {_ORDER}) AS rn FROM x_scored_picks JOIN x_days ON date = day
  CROSS JOIN (SELECT unnest([2, 3, 4, 5, 6]) AS legs) WHERE {_OK} AND validated AND fair_odds >= pow(3.0e0, 1.0e0 / legs)) WHERE rn = 1) WHERE leg <= legs
GROUP BY legs HAVING count(*) = legs
""")
def best_accumulators(spark, sf):
    a = selection.best_accumulators(picks(spark, sf))
    return a.select("legs", F.round("probability", 6).alias("probability"),
                    F.round("fair_odds", 6).alias("fair_odds"),
                    F.round("offered_odds", 6).alias("offered_odds"), "weakest_leg", "first_day",
                    "last_day", F.array_join(F.transform("selections", lambda s: F.concat_ws(
                        " ", s["match_id"], s["key"])), ",").alias("picked"))


@query("parlays", "K5 A29", f"""
WITH legs AS (SELECT *, row_number() OVER (ORDER BY prob DESC, match_id, key) AS leg FROM (SELECT * FROM x_picks WHERE prob >= 0.75 AND validated AND {_OK} QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY prob DESC, key) = 1)
  ORDER BY prob DESC, match_id, key LIMIT 8)
SELECT CAST(n AS INTEGER) AS legs, round(product(prob), 6) AS probability, round(1 / product(prob), 6) AS fair_odds, CASE WHEN bool_and(odds IS NOT NULL) THEN round(product(odds), 6) END AS offered_odds,
  string_agg(match || ': ' || selection, ' + ' ORDER BY leg) AS selections FROM legs JOIN (SELECT unnest([2, 3, 4]) AS n) ON leg <= n GROUP BY n HAVING count(*) = n
""")
def parlays(spark, sf):
    return rounded(selection.parlays(selection.shortlist(picks(spark, sf))), 6)


@query("leg_tray", "A29", """
SELECT date, count(*) AS legs, round(product(prob), 6) AS probability, CASE WHEN bool_and(odds IS NOT NULL) THEN round(product(odds), 4) END AS offered, min(prob) AS weakest,
  count(*) > count(DISTINCT match_id) AS same_fixture FROM (SELECT * FROM x_picks WHERE "group" = '1x2' QUALIFY row_number() OVER (PARTITION BY date ORDER BY prob DESC, match_id, key) <= 4) GROUP BY date
""")
def leg_tray(spark, sf):
    from fairline.operators.ordering import best_per_key

    legs = best_per_key(picks(spark, sf).filter(F.col("group") == "1x2"), ["date"],
                        [F.desc("prob"), F.asc("match_id"), F.asc("key")], 4)
    out = selection.tray(legs, ["date"])
    return out.withColumns({"probability": F.round("probability", 6),
                            "offered": F.round("offered", 4)})


@query("headline_markets", "F20", f"""
SELECT match_id, date, competition, match, {', '.join(f'''max(CASE WHEN key = '{k}' THEN prob END) AS "{k}"''' for k in selection.HEADLINE_KEYS)} FROM x_picks GROUP BY ALL
""")
def headline_markets(spark, sf):
    return selection.headline_markets(picks(spark, sf))


@query("card_header", "S16 A31", """
SELECT count(DISTINCT match_id) AS n_fixtures, count(*) AS n_selections, min(date) AS first_date, max(date) AS last_date, count(DISTINCT competition) AS competitions,
  (SELECT string_agg(g, ',' ORDER BY g) FROM (SELECT DISTINCT "group" AS g FROM x_picks)) AS groups FROM x_picks
""")
def card_header(spark, sf):
    return selection.card_header(picks(spark, sf))

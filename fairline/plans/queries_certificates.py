"""Queries: what the fitted chain must add up to, held against sums of the raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fairline.plans import certificates as c, model, queries_backtest as qb, queries_model as qm
from fairline.plans.registry import cte, query
from fairline.sources import warehouse as w
from fairline.sources.sinks import rounded

SIGNALS = {"goals": ("home_goals", "away_goals"), "shots": ("home_sot", "away_sot"), "corners": ("home_corners", "away_corners")}

# The refit calendar is a recurrence, as in refit_days; DuckDB wants the recursive table in the query itself.
REFITS = """
WITH RECURSIVE x_d AS (SELECT competition, date, sum(n) OVER (PARTITION BY competition ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_train FROM (SELECT competition, date, count(*) AS n FROM x_matches GROUP BY ALL)),
d AS (SELECT competition, date FROM x_d WHERE n_train >= 200),
r AS (SELECT competition, min(date) AS fit_date, 1 AS fit_no FROM d GROUP BY competition
 UNION ALL SELECT r.competition, (SELECT min(d.date) FROM d WHERE d.competition = r.competition AND d.date >= r.fit_date + 7), fit_no + 1 FROM r
 WHERE r.fit_date IS NOT NULL),
f AS (SELECT competition, CAST(fit_no AS INTEGER) AS fit_no, fit_date FROM r WHERE fit_date IS NOT NULL)"""

cte("x_signals", "--m\n" + "\nUNION ALL ".join(
    f"SELECT competition, date, '{s}' AS signal, {h} AS h, {a} AS a, home_goals AS gh, away_goals AS ga FROM x_matches WHERE {h} IS NOT NULL AND {a} IS NOT NULL"
    for s, (h, a) in SIGNALS.items()))
cte("x_signal_days", """--m
SELECT competition, signal, date, CAST(sum(n) OVER o AS BIGINT) AS n, sum(w) OVER o AS w, sum(h) OVER o AS h, sum(a) OVER o AS a, sum(gh) OVER o AS gh, sum(ga) OVER o AS ga FROM (
  SELECT competition, signal, date, count(*) AS n, sum(p) AS w, sum(p * h) AS h, sum(p * a) AS a, sum(p * gh) AS gh, sum(p * ga) AS ga FROM (
    SELECT *, pow(2.0e0, (date - DATE '1995-01-01') / 180.0e0) AS p FROM x_signals) GROUP BY ALL)
WINDOW o AS (PARTITION BY competition, signal ORDER BY date)
""")
cte("x_debuts", """
SELECT competition, team, min(date) AS debut FROM (SELECT competition, home AS team, date FROM x_matches UNION ALL SELECT competition, away, date FROM x_matches) GROUP BY ALL
""")


def stored_fits(spark, sf) -> dict[str, DataFrame]:
    """The fits that the stored predictions were made with."""
    qm.predictions(spark, sf)
    return {s: qm.walk_table(spark, sf, s) for s in SIGNALS}


@query("fitted_means", "R1 R3 R4", REFITS + """
SELECT f.competition, f.fit_no, s.signal, x.n, round(x.h / x.w, 6) AS home_mean, round(x.a / x.w, 6) AS away_mean, round(x.gh / x.h, 6) AS scale_home, round(x.ga / x.a, 6) AS scale_away
FROM (SELECT * FROM f CROSS JOIN (SELECT DISTINCT signal FROM x_signals) k) s ASOF JOIN x_signal_days x
  ON x.competition = s.competition AND x.signal = s.signal AND s.fit_date > x.date JOIN f ON f.competition = s.competition AND f.fit_no = s.fit_no
""")
def fitted_means(spark, sf):
    """Every refit of goals, shots and corners has the decayed means of the counts before it, and its goals per shot."""
    m, days = w.matches(spark, sf), qm.walk_table(spark, sf, "fits")
    each = [c.fitted_means(m, days, fit, *SIGNALS[s]).withColumn("signal", F.lit(s)) for s, fit in stored_fits(spark, sf).items()]
    return rounded(reduce(DataFrame.unionByName, each), 6)


@query("walk_forward_means", "R3 R4 R6 J1 J2", REFITS + """,
m AS (SELECT m.*, f.fit_date FROM x_matches m ASOF JOIN f ON f.competition = m.competition AND m.date >= f.fit_date),
n AS (SELECT f.competition, f.fit_date, count(*) FILTER (WHERE signal = 'shots') AS shots, count(*) FILTER (WHERE signal = 'corners') AS corners
  FROM f JOIN x_signals s ON s.competition = f.competition AND s.date < f.fit_date GROUP BY ALL)
SELECT m.competition, count(*) AS priced, count_if(shots >= 100) AS with_shots, count_if(corners >= 200) AS with_corners,
  count_if(h.debut >= m.fit_date OR a.debut >= m.fit_date) AS new_teams, CAST(0 AS BIGINT) AS off
FROM m JOIN n ON n.competition = m.competition AND n.fit_date = m.fit_date JOIN x_debuts h ON h.competition = m.competition AND h.team = m.home
  JOIN x_debuts a ON a.competition = m.competition AND a.team = m.away GROUP BY m.competition
""")
def walk_forward_means(spark, sf):
    """Every prediction's blend, shot factor, corner means and new-team mark, made anew from the stored fits."""
    rows = c.walk_forward_means(qm.predictions(spark, sf), qm.walk_table(spark, sf, "fits"), **stored_fits(spark, sf))
    count = lambda column: F.count_if(F.col(column))
    return rows.groupBy("competition").agg(F.count(F.lit(1)).alias("priced"), count("with_shots").alias("with_shots"), count("corners").alias("with_corners"),
                                           count("new_team").alias("new_teams"), count("off").alias("off"))


@query("priced_fixtures_check", "R13 J1", f"""
WITH t AS (SELECT competition, count(*) AS n, count(home_corners + away_corners) AS corners FROM x_matches WHERE date < DATE '{w.CARD_DAY}' GROUP BY competition)
SELECT competition, count(*) AS fixtures, CAST(sum(CASE WHEN corners >= 200 THEN {len(model.markets.GOAL_KEYS) + len(model.markets.CORNER_KEYS)} ELSE {len(model.markets.GOAL_KEYS)} END) AS BIGINT) AS selections,
  CAST(sum(CASE WHEN home_odds IS NULL THEN 0 ELSE 1 END + CASE WHEN draw_odds IS NULL THEN 0 ELSE 1 END + CASE WHEN away_odds IS NULL THEN 0 ELSE 1 END
    + CASE WHEN over25_odds IS NULL THEN 0 ELSE 1 END + CASE WHEN under25_odds IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS quoted, CAST(0 AS BIGINT) AS faults
FROM x_current JOIN t USING (competition) WHERE n >= 200 GROUP BY competition
""")
def priced_fixtures_check(spark, sf):
    """Every fixture of a competition with enough history is on the card once, with all selections and consistent numbers."""
    return c.card_faults(qm.card(spark, sf)).groupBy("competition").agg(
        F.count(F.lit(1)).alias("fixtures"), F.sum("selections").alias("selections"), F.sum("quoted").alias("quoted"), F.sum("faults").alias("faults"))


@query("likelihood_matches", "R14 J2", """
WITH s AS (SELECT b.*, fit_date FROM x_schedule JOIN x_backtest b USING (match_id)),
t AS (SELECT competition, team, min(date) AS debut FROM (SELECT competition, home AS team, date FROM x_backtest UNION ALL SELECT competition, away, date FROM x_backtest) GROUP BY ALL)
SELECT s.match_id, s.fit_date FROM s JOIN t h ON h.competition = s.competition AND h.team = s.home JOIN t a ON a.competition = s.competition AND a.team = s.away
WHERE h.debut < s.fit_date AND a.debut < s.fit_date
""")
def likelihood_matches(spark, sf):
    """The matches that the likelihood backtest prices, and the fit of each: those whose teams had played before it."""
    return qm.likelihood_means(spark, sf).where("lam > 0 AND mu > 0 AND rho IS NOT NULL").select("match_id", "fit_date")


@query("likelihood_fitted_means", "R14 R3 R1", """
WITH f AS (SELECT DISTINCT competition, fit_date FROM x_schedule JOIN x_backtest USING (match_id)),
x AS (SELECT competition, date, signal, h, a, gh, ga FROM (SELECT competition, date, home_goals AS gh, away_goals AS ga, home_goals AS g1, away_goals AS g2,
  coalesce(home_sot, home_goals) AS s1, coalesce(away_sot, away_goals) AS s2 FROM x_backtest),
  LATERAL (VALUES ('goals', g1, g2), ('shots', s1, s2)) v(signal, h, a)),
d AS (SELECT competition, signal, date, CAST(sum(n) OVER o AS BIGINT) AS n, sum(w) OVER o AS w, sum(h) OVER o AS h, sum(a) OVER o AS a, sum(gh) OVER o AS gh, sum(ga) OVER o AS ga FROM (
  SELECT competition, signal, date, count(*) AS n, sum(p) AS w, sum(p * h) AS h, sum(p * a) AS a, sum(p * gh) AS gh, sum(p * ga) AS ga FROM (
    SELECT *, pow(2.0e0, (date - DATE '1995-01-01') / 180.0e0) AS p FROM x) GROUP BY ALL) WINDOW o AS (PARTITION BY competition, signal ORDER BY date))
SELECT s.competition, s.fit_date, s.signal, d.n, round(d.h / d.w, 6) AS home_mean, round(d.a / d.w, 6) AS away_mean, round(d.gh / d.h, 6) AS scale_home, round(d.ga / d.a, 6) AS scale_away
FROM (SELECT * FROM f CROSS JOIN (VALUES ('goals'), ('shots')) k(signal)) s ASOF JOIN d ON d.competition = s.competition AND d.signal = s.signal AND s.fit_date > d.date
""")
def likelihood_fitted_means(spark, sf):
    """The backtest's own refits (every few rows, shots filled with goals) have the decayed means of what came before."""
    qm.likelihood_means(spark, sf)
    days = qm.likelihood_table(spark, sf, "fits")
    filled = model.filled_shots(qb.dataset(spark, sf))
    each = [c.fitted_means(filled, days, qm.likelihood_table(spark, sf, s), *counts).withColumn("signal", F.lit(s))
            for s, counts in (("goals", ("home_goals", "away_goals")), ("shots", ("shots_home", "shots_away")))]
    both = reduce(DataFrame.unionByName, each).join(days, ["competition", "fit_no"]).drop("fit_no")
    return rounded(both, 6)

"""Queries: the value backtest, its intervals and findings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fairline import config
from fairline.functions import resampling
from fairline.plans import backtest, insights, selection, sql_tables as t
from fairline.plans.registry import cte, query
from fairline.session import stage
from fairline.sources import readers, warehouse as w
from fairline.sources.sinks import rounded, thin

FILTERS = {"max_edge": 0.08, "exclude": ("C05",)}


def dataset(spark, sf):
    m = w.matches(spark, sf).withColumns({"home_team": F.col("home"), "away_team": F.col("away")})
    return readers.backtest_dataset(m)


def schedule(spark, sf):
    return backtest.refit_by_rows(dataset(spark, sf))


def means(spark, sf):
    data = dataset(spark, sf)
    return backtest.ratio_means(data, backtest.with_fit_dates(data))


PRICED = ("match_id", "date", "competition", "home_goals", "away_goals",
          *[f"{c}_odds{tail}" for c in ("home", "draw", "away", "over25", "under25")
            for tail in ("", "_cons")], "p_home", "p_draw", "p_away", "p_over25")
BET = ("match_id", "date", "competition", "market", "outcome", "odds", "won", "edge", "pnl")


def price(spark, sf):
    return backtest.score_probabilities(means(spark, sf)).select(*PRICED)


def priced(spark, sf):
    """Matches with what selections and predictions need; five selections a match are made anew from them."""
    return w._stored(spark, sf, "backtest_priced", price)


def predictions(spark, sf):
    return backtest.predictions(priced(spark, sf))


def selections(spark, sf):
    return backtest.all_selections(priced(spark, sf))


def bets(spark, sf):
    """The bets, stored without their long id, which their other columns spell."""
    source = priced if w.is_stored(spark, sf, "backtest_priced") else price
    stored = w._stored(spark, sf, "bets", lambda s, d: backtest.qualifying(
        backtest.all_selections(source(s, d))).select(*BET))
    return stored.withColumn("bet_id", backtest.bet_id())


cte("x_schedule", """--m
WITH r AS (SELECT competition, date, match_id, row_number() OVER (PARTITION BY competition ORDER BY date, substr(md5(match_id), 1, 2), match_id) - 1 AS i FROM x_backtest),
c AS (SELECT r.*, min(i) OVER (PARTITION BY competition, date) AS cut FROM r),
s AS (SELECT c.*, min(i) FILTER (WHERE cut >= 150) OVER (PARTITION BY competition) AS i0 FROM c)
SELECT a.match_id, b.date AS fit_date FROM s a JOIN s b ON a.competition = b.competition AND b.i = a.i0 + 5 * ((a.i - a.i0) // 5) WHERE a.i >= a.i0
""")
cte("x_strengths", """--m
WITH f AS (SELECT DISTINCT competition, fit_date FROM x_schedule JOIN x_backtest USING (match_id)),
m AS (SELECT f.competition, f.fit_date, home, away, home_goals AS hg, away_goals AS ag, pow(0.5e0, (fit_date - date) / 180.0e0) AS w FROM f JOIN x_backtest b ON b.competition = f.competition AND b.date < f.fit_date),
l AS (SELECT competition, fit_date, sum(w * hg) / sum(w) AS avh, sum(w * ag) / sum(w) AS ava FROM m GROUP BY ALL),
s AS (SELECT competition, fit_date, team, sum(gh) AS gh, sum(sh) AS sh, sum(ch) AS ch, sum(ga) AS ga, sum(sa) AS sa, sum(ca) AS ca FROM (
  SELECT competition, fit_date, home AS team, w AS gh, w * hg AS sh, w * ag AS ch, 0 AS ga, 0 AS sa, 0 AS ca FROM m UNION ALL
  SELECT competition, fit_date, away, 0, 0, 0, w, w * ag, w * hg FROM m) GROUP BY ALL)
SELECT s.*, avh, ava, (gh * CASE WHEN gh > 0 THEN sh / gh / avh ELSE 1 END + 5) / (gh + 5) AS ha, (gh * CASE WHEN gh > 0 THEN ch / gh / ava ELSE 1 END + 5) / (gh + 5) AS hd,
  (ga * CASE WHEN ga > 0 THEN sa / ga / ava ELSE 1 END + 5) / (ga + 5) AS aa, (ga * CASE WHEN ga > 0 THEN ca / ga / avh ELSE 1 END + 5) / (ga + 5) AS ad FROM s JOIN l USING (competition, fit_date)
""")
cte("x_means", """--m
SELECT b.match_id, s.fit_date, h.ha * a.ad * h.avh AS lam, a.aa * h.hd * h.ava AS mu, CAST(0 AS DOUBLE) AS rho FROM x_schedule s JOIN x_backtest b USING (match_id)
JOIN x_strengths h ON h.competition = b.competition AND h.fit_date = s.fit_date AND h.team = b.home JOIN x_strengths a ON a.competition = b.competition AND a.fit_date = s.fit_date AND a.team = b.away
""")
cte("x_priced", f"""--m
SELECT b.*, g.* EXCLUDE (match_id) FROM x_backtest b JOIN (
 SELECT match_id, sum(CASE WHEN i > j THEN c ELSE 0 END) / sum(c) AS p_home, sum(CASE WHEN i = j THEN c ELSE 0 END) / sum(c) AS p_draw, sum(CASE WHEN i < j THEN c ELSE 0 END) / sum(c) AS p_away,
  sum(CASE WHEN i + j > 2.5 THEN c ELSE 0 END) / sum(c) AS p_over FROM ({t.grid('x_means', 11)}) GROUP BY match_id) g USING (match_id)
""")
_MASS = "(1 / home_odds_cons + 1 / draw_odds_cons + 1 / away_odds_cons)"
cte("x_preds", f"""--m
SELECT match_id, date, competition, CASE WHEN home_goals > away_goals THEN 'home' WHEN home_goals = away_goals THEN 'draw' ELSE 'away' END AS actual, p_home AS model_home, p_draw AS model_draw, p_away AS model_away,
  1 / home_odds_cons / {_MASS} AS market_home, 1 / draw_odds_cons / {_MASS} AS market_draw, 1 / away_odds_cons / {_MASS} AS market_away FROM x_priced
""")
_OUM = "(1 / over25_odds_cons + 1 / under25_odds_cons)"
_LEGS = ", ".join([
    f"{{'market': '1X2', 'outcome': '{n}', 'mp': p_{s}, 'kp': 1 / {s}_odds_cons / {_MASS}, 'odds': {s}_odds, 'won': {won}, 'ok': TRUE}}"
    for n, s, won in (("Home", "home", "home_goals > away_goals"),
                      ("Draw", "draw", "home_goals = away_goals"),
                      ("Away", "away", "home_goals < away_goals"))] + [
    f"{{'market': 'O/U 2.5', 'outcome': '{n} 2.5', 'mp': {mp}, 'kp': 1 / {s}25_odds_cons / {_OUM}, 'odds': {s}25_odds, 'won': {won}, 'ok': coalesce(over25_odds > 1 AND under25_odds > 1, FALSE)}}"
    for n, s, mp, won in (("Over", "over", "p_over", "home_goals + away_goals > 2.5"),
                          ("Under", "under", "1 - p_over", "home_goals + away_goals < 2.5"))])
cte("x_bet_rows", f"""--m
SELECT match_id, date, competition, market, outcome, match_id || '/' || market || '/' || outcome AS bet_id, mp, kp, odds, won, floor((mp - kp) * 1e9 + 0.5e0) / 1e9 AS edge, CASE WHEN won THEN 10.0e0 * (odds - 1) ELSE -10.0e0 END AS pnl
FROM (SELECT match_id, date, competition, unnest([{_LEGS}], recursive := true) FROM x_priced) WHERE ok
""")
cte("x_bets", "--m\nSELECT * FROM x_bet_rows WHERE odds BETWEEN 1.6 AND 2.5 AND edge >= 0.03")


@query("refit_schedule", "W9", "SELECT match_id, fit_date FROM x_schedule")
def refit_schedule(spark, sf):
    return schedule(spark, sf)


@query("ratio_means", "R5 A4 A5 J2 J3 W1", "SELECT match_id, fit_date, round(lam, 6) AS lam, round(mu, 6) AS mu FROM x_means")
def ratio_means(spark, sf):
    return rounded(means(spark, sf).select("match_id", "fit_date", "lam", "mu"), 6)


@query("backtest_predictions", "R14 M6 F3", f"""
SELECT match_id, actual, {', '.join(f'round({x}_{s}, 6) AS {x}_{s}' for x in ('model', 'market') for s in insights.SIDES)} FROM x_preds
""")
def backtest_predictions(spark, sf):
    return rounded(predictions(spark, sf).drop("date", "competition"), 6)


@query("backtest_bets", "R14 M5 P8 F14", """
SELECT bet_id, market, outcome, odds, won, edge, round(pnl, 6) AS pnl FROM x_bets
""")
def backtest_bets(spark, sf):
    return bets(spark, sf).select("bet_id", "market", "outcome", "odds", "won", "edge",
                                  F.round("pnl", 6).alias("pnl"))


_SUM = "count(*) AS n, count(*) FILTER (WHERE won) AS wins, round(avg(CASE WHEN won THEN 1.0e0 ELSE 0 END), 6) AS win_rate, round(avg(odds), 6) AS avg_odds, round(CAST(sum(CAST(pnl AS DECIMAL(18, 4))) AS DOUBLE), 4) AS pnl, count(*) * 10.0e0 AS staked, round(CAST(sum(CAST(pnl AS DECIMAL(18, 4))) AS DOUBLE) / (count(*) * 10.0e0) * 100, 6) AS roi, round(avg(edge), 6) AS avg_edge"


def tidy(df):
    return rounded(df.withColumn("pnl", F.round("pnl", 4)), 6)


_DRAW = "CASE " + " ".join(f"WHEN u < {step} THEN {k}.0e0" for k, step in enumerate(resampling.steps())) + f" ELSE {resampling.MOST}.0e0 END"


def boot_sql(units: str, by: str = "", samples: int = config.BOOTSTRAP_SAMPLES) -> str:
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""
SELECT {head}quantile_cont(roi, 0.025) AS ci_low, quantile_cont(roi, 0.975) AS ci_high FROM (
 SELECT {head}r, sum(k * pnl) * 100 / (sum(k * n) * 10.0e0) AS roi FROM (SELECT {head}r, pnl, n, {_DRAW} AS k FROM (
  SELECT {head}pnl, n, r, (start + r * stride) % {resampling.WORD} AS u FROM (
   SELECT {head}pnl, n, ('0x' || substr(d, 1, 8))::BIGINT AS start, ('0x' || substr(d, 9, 8))::BIGINT | 1 AS stride FROM (SELECT {head}pnl, n, md5('42|' || unit) AS d FROM {units}))
  CROSS JOIN (SELECT unnest(range({samples})) AS r))) GROUP BY {head}r){tail}
"""


cte("x_bet_units", "SELECT *, bet_id AS unit, 1.0e0 AS n FROM x_bets")
_VERDICT = "CASE WHEN ci_low > 0 AND n >= 200 THEN 'good' WHEN ci_low > 0 THEN 'warning' WHEN ci_high < 0 THEN 'losing' ELSE 'critical' END AS verdict"


@query("backtest_summary", "A18 A20", f"""
SELECT s.*, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high, {_VERDICT} FROM (SELECT {_SUM} FROM x_bets) s CROSS JOIN ({boot_sql('x_bet_units')}) b
""")
def backtest_summary(spark, sf):
    out = backtest.with_interval(bets(spark, sf))
    return tidy(out.withColumns({c: F.round(c, 4) for c in ("ci_low", "ci_high")}))


@query("cluster_interval", "A21", f"""
SELECT round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high FROM ({boot_sql('(SELECT match_id AS unit, sum(pnl) AS pnl, CAST(count(*) AS DOUBLE) AS n FROM x_bets GROUP BY match_id)')})
""")
def cluster_interval(spark, sf):
    return rounded(backtest.bootstrap(backtest.match_units(bets(spark, sf)), "unit"), 4)


@query("returns_by_market", "A19 A20", f"""
SELECT s.*, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high, {_VERDICT} FROM (SELECT market, {_SUM} FROM x_bets GROUP BY market) s JOIN ({boot_sql('x_bet_units', 'market')}) b USING (market)
""")
def returns_by_market(spark, sf):
    out = backtest.with_interval(bets(spark, sf), ["market"])
    return tidy(out.withColumns({c: F.round(c, 4) for c in ("ci_low", "ci_high")}))


@query("returns_by_competition", "A19", f"SELECT competition, {_SUM} FROM x_bets GROUP BY competition")
def returns_by_competition(spark, sf):
    return tidy(backtest.summary(bets(spark, sf), ["competition"]))


@query("returns_by_outcome", "A19", f"SELECT outcome, {_SUM} FROM x_bets GROUP BY outcome")
def returns_by_outcome(spark, sf):
    return tidy(backtest.summary(bets(spark, sf), ["outcome"]))


_BET_ORDER = "ORDER BY date, competition, substr(md5(bet_id), 1, 2), bet_id"


@query("returns_by_period", "W3", f"""
SELECT CAST(period AS INTEGER) AS period, count(*) AS n, min(date) AS first, max(date) AS last, round(sum(pnl), 4) AS pnl, round(sum(pnl) / (count(*) * 10.0e0) * 100, 6) AS roi
FROM (SELECT *, ntile(4) OVER ({_BET_ORDER}) AS period FROM x_bets) GROUP BY period
""")
def returns_by_period(spark, sf):
    return tidy(backtest.by_period(bets(spark, sf)))


@query("equity_curve", "W2", f"SELECT bet_id, round(sum(pnl) OVER o, 4) AS cum, row_number() OVER o AS position FROM x_bets WINDOW o AS ({_BET_ORDER} ROWS UNBOUNDED PRECEDING)")
def equity_curve(spark, sf):
    return backtest.equity_curve(bets(spark, sf)).select("bet_id", F.round("cum", 4).alias("cum"),
                                                         "position")


@query("thinned_curve", "S18 W2", f"""
WITH c AS (SELECT bet_id, row_number() OVER ({_BET_ORDER}) AS position, count(*) OVER () AS n FROM x_bets)
SELECT bet_id, position FROM c WHERE n <= 400 OR position IN (SELECT CAST(floor(i * (n / 400.0e0)) AS BIGINT) + 1 FROM (SELECT unnest(range(400)) AS i) CROSS JOIN (SELECT max(n) AS n FROM c))
""")
def thinned_curve(spark, sf):
    return thin(backtest.equity_curve(bets(spark, sf)).select("bet_id", "position"), "position")


@query("bet_filters", "P7 W6", f"""
SELECT 'cap' AS rule, {_SUM} FROM x_bets WHERE competition <> 'C05' AND edge < 0.08
UNION ALL SELECT 'lowest_edge', {_SUM} FROM (SELECT * FROM x_bets QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY edge, bet_id) = 1)
UNION ALL SELECT 'edge', {_SUM} FROM (SELECT * FROM x_bets QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY edge DESC, bet_id) = 1)
UNION ALL SELECT 'O/U 2.5', {_SUM} FROM (SELECT * FROM x_bets QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY market <> 'O/U 2.5', edge, bet_id) = 1)
""")
def bet_filters(spark, sf):
    b = bets(spark, sf)
    cap = backtest.summary(backtest.apply_filters(b, **FILTERS)).withColumn("rule", F.lit("cap"))
    best = backtest.best_by_rule(b, ("lowest_edge", "edge", "O/U 2.5"))
    return tidy(readers.union_layouts([cap, backtest.summary(best, ["rule"])]))


@query("bet_explorer", "P10", f"SELECT {_SUM} FROM x_bets WHERE won AND market = '1X2' AND outcome = 'Home' AND contains(lower(match_id), '-1999-')")
def bet_explorer(spark, sf):
    return tidy(backtest.summary(backtest.bet_explorer(
        bets(spark, sf), text="-1999-", won=True, outcome="Home", market="1X2")))


_SWEEP = "(VALUES ('1.70-2.00', 1.7e0, 2.0e0), ('1.60-2.50', 1.6e0, 2.5e0), ('1.50-3.00', 1.5e0, 3.0e0), ('1.01-99.00', 1.01e0, 99.0e0)) v(band, odds_min, odds_max)"
cte("x_sweep_units", f"SELECT r.*, band, odds_min, odds_max, bet_id AS unit, 1.0e0 AS n FROM x_bet_rows r JOIN {_SWEEP} ON odds BETWEEN odds_min AND odds_max WHERE edge >= 0.03")


@query("band_sweep", "R15 A18 A25", f"""
SELECT s.*, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high, {_VERDICT} FROM (SELECT band, odds_min, odds_max, {_SUM} FROM x_sweep_units GROUP BY band, odds_min, odds_max) s JOIN ({boot_sql('x_sweep_units', 'band')}) b USING (band)
""")
def band_sweep(spark, sf):
    out = backtest.sweep_bands(selections(spark, sf))
    return tidy(out.withColumns({c: F.round(c, 4) for c in ("ci_low", "ci_high")}))


cte("x_halves", "SELECT *, CASE WHEN date - DATE '1970-01-01' <= (SELECT quantile_cont(CAST(date - DATE '1970-01-01' AS DOUBLE), 0.5) FROM x_bets) THEN 'train' ELSE 'test' END AS half FROM x_bets")


@query("holdout_validation", "A33 P7 A21", f"""
WITH k AS (SELECT * FROM x_halves WHERE competition <> 'C05' AND edge < 0.08),
u AS (SELECT half, match_id AS unit, sum(pnl) AS pnl, CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY half, match_id)
SELECT b.half, n_before, round(roi_before, 6) AS roi_before, n_after, round(roi_after, 6) AS roi_after, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high, round(roi_after - roi_before, 6) AS gain, CASE WHEN b.half = 'test' THEN roi_after > roi_before END AS held_up
FROM (SELECT half, count(*) AS n_before, sum(pnl) / (count(*) * 10.0e0) * 100 AS roi_before FROM x_halves GROUP BY half) b JOIN (SELECT half, count(*) AS n_after, sum(pnl) / (count(*) * 10.0e0) * 100 AS roi_after FROM k GROUP BY half) a USING (half) JOIN ({boot_sql('u', 'half')}) i USING (half)
""")
def holdout_validation(spark, sf):
    out = backtest.validate(bets(spark, sf), **FILTERS)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("ci_low", "ci_high")}), 6)


@query("three_way_scores", "A7 A26 P13", f"""
SELECT count(*) AS n, {', '.join(f"round(avg({' + '.join(f'''pow({x}_{s} - CASE WHEN actual = '{s}' THEN 1 ELSE 0 END, 2)''' for s in insights.SIDES)}), 6) AS brier_{x}, round(avg(-ln(least(greatest(CASE actual WHEN 'home' THEN {x}_home WHEN 'draw' THEN {x}_draw ELSE {x}_away END, 1e-12), 1))), 6) AS log_loss_{x}" for x in ('model', 'market'))} FROM x_preds
""")
def three_way_scores(spark, sf):
    return rounded(insights.three_way_scores(predictions(spark, sf)).drop("delta"), 6)


@query("model_calibration_bins", "A17", """
SELECT CAST(floor((p - 0.05e0) / (0.6e0 / 6)) AS BIGINT) + 1 AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM (
 SELECT unnest([{'p': model_home, 'y': CASE WHEN actual = 'home' THEN 1.0e0 ELSE 0 END}, {'p': model_draw, 'y': CASE WHEN actual = 'draw' THEN 1.0e0 ELSE 0 END}, {'p': model_away, 'y': CASE WHEN actual = 'away' THEN 1.0e0 ELSE 0 END}], recursive := true) FROM x_preds)
WHERE p >= 0.05 AND p < 0.65 GROUP BY bin HAVING count(*) >= 30
""")
def model_calibration_bins(spark, sf):
    return rounded(insights.calibration_bins(predictions(spark, sf)), 6)


@query("edge_buckets", "A23", f"SELECT CAST(CASE WHEN edge < 0.05 THEN 0 WHEN edge < 0.08 THEN 1 WHEN edge < 0.12 THEN 2 ELSE 3 END AS INTEGER) AS bucket, {_SUM} FROM x_bets WHERE edge < 1 GROUP BY bucket")
def edge_buckets(spark, sf):
    return tidy(insights.edge_buckets(bets(spark, sf)))


@query("edge_deciles", "A24", f"""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(edge, [{', '.join(f'{i / 10:.17e}' for i in range(11))}]))) AS e FROM x_bets)
SELECT CAST(decile AS INTEGER) AS decile, {_SUM} FROM (SELECT x.*, greatest(len(list_filter(e, lambda v: v < edge)), 1) AS decile FROM x_bets x CROSS JOIN e) GROUP BY decile
""")
def edge_deciles(spark, sf):
    return tidy(insights.edge_deciles(bets(spark, sf)))


cte("x_random", """
WITH l AS (SELECT match_id, list_filter([{'o': home_odds, 'w': home_goals > away_goals}, {'o': draw_odds, 'w': home_goals = away_goals}, {'o': away_odds, 'w': home_goals < away_goals}], lambda x: x.o BETWEEN 1.6 AND 2.5) AS legs
  FROM x_backtest),
r AS (SELECT g * 4 + i AS rep, avg(CASE WHEN legs[k].w THEN legs[k].o - 1 ELSE -1.0e0 END) * 100 AS roi, count(*) AS n FROM (
  SELECT g, i, legs, CAST(floor(('0x' || substr(md5('5|' || g || '|' || match_id), 8 * i + 1, 8))::BIGINT::DOUBLE / 4294967296.0e0 * len(legs)) AS INTEGER) + 1 AS k FROM l CROSS JOIN (SELECT unnest(range(50)) AS g) CROSS JOIN (SELECT unnest(range(4)) AS i) WHERE len(legs) > 0) GROUP BY rep)
SELECT max(n) AS matches, avg(roi) AS random_roi FROM r
""")


@query("random_benchmark", "A22", "SELECT matches, round(random_roi, 5) AS random_roi FROM x_random")
def random_benchmark(spark, sf):
    return rounded(insights.random_returns(dataset(spark, sf)), 5)


def findings(spark, sf):
    preds, data = predictions(spark, sf), dataset(spark, sf)
    b = bets(spark, sf)  # made from the priced matches that the predictions have stored
    sweep = stage(backtest.sweep_bands(selections(spark, sf)), "sweep")
    check = stage(backtest.validate(b, **FILTERS), "holdout")
    return [insights.random_benchmark(b, data), insights.model_vs_market(preds),
            insights.holdout(check), insights.edge_decile_finding(b),
            insights.edge_reliability(b), insights.band_sensitivity(sweep),
            insights.market_split(b), insights.calibration(preds), insights.stability(b),
            insights.outcome_split(b), insights.by_competition(b)]


@query("insights", "R17 K7 A17 A19 A22 A23 A24 A25 A26 R16")
def all_findings(spark, sf):
    """All findings, most decisive first, with their evidence rows as text."""
    out = insights.ranked(findings(spark, sf))
    return out.select("id", "state", "stat", F.to_json("evidence").alias("evidence"))


_ROI = "CAST(sum(CAST(pnl AS DECIMAL(18, 4))) AS DOUBLE) / (count(*) * 10.0e0) * 100"
_BRIER = {x: "avg(" + " + ".join(f"pow({x}_{s} - CASE WHEN actual = '{s}' THEN 1 ELSE 0 END, 2)" for s in insights.SIDES) + ")" for x in ("model", "market")}
_SAFE = "coalesce(CASE WHEN isnan({0}) THEN 0 ELSE {0} END, 0)"
cte("x_cal_bins", """
SELECT floor((p - 0.05e0) / (0.6e0 / 6)) AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed FROM (
 SELECT unnest([{'p': model_home, 'y': CASE WHEN actual = 'home' THEN 1.0e0 ELSE 0 END}, {'p': model_draw, 'y': CASE WHEN actual = 'draw' THEN 1.0e0 ELSE 0 END}, {'p': model_away, 'y': CASE WHEN actual = 'away' THEN 1.0e0 ELSE 0 END}], recursive := true) FROM x_preds)
WHERE p >= 0.05 AND p < 0.65 GROUP BY bin HAVING count(*) >= 30
""")
cte("x_deciles", f"""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(edge, [{', '.join(f'{i / 10:.17e}' for i in range(11))}]))) AS e FROM x_bets),
d AS (SELECT decile, count(*) AS n, {_ROI} AS roi FROM (SELECT x.*, greatest(len(list_filter(e, lambda v: v < edge)), 1) AS decile FROM x_bets x CROSS JOIN e) GROUP BY decile)
SELECT n, roi, row_number() OVER (ORDER BY decile) AS i, greatest(count(*) OVER () // 3, 1) AS third, count(*) OVER () AS k FROM d
""")
cte("x_filtered", "SELECT * FROM x_halves WHERE competition <> 'C05' AND edge < 0.08")
cte("x_half_units", "SELECT half, match_id AS unit, sum(pnl) AS pnl, CAST(count(*) AS DOUBLE) AS n FROM x_filtered GROUP BY half, match_id")


@query("insight_states", "R17 K7 R16 A17 A19 A22 A23 A24 A25 A26", f"""
WITH a AS (SELECT count(*) AS n, {_ROI} AS roi FROM x_bets),
f AS (
SELECT 1 AS ord, 'random-benchmark' AS id, CASE WHEN roi - random_roi < 0 THEN 'critical' ELSE 'good' END AS state, roi - random_roi AS stat FROM a CROSS JOIN x_random WHERE n > 0 AND matches >= 100
UNION ALL SELECT 2, 'model-vs-market', CASE WHEN m < k THEN 'good' ELSE 'critical' END, (m - k) / k * 100 FROM (SELECT {_BRIER['model']} AS m, {_BRIER['market']} AS k FROM x_preds HAVING count(*) > 0)
UNION ALL SELECT 3, 'holdout', CASE WHEN gain > 0 AND ci_low > 0 THEN 'good' WHEN gain > 0 THEN 'warning' ELSE 'critical' END, gain FROM (
  SELECT b.half, coalesce(a.roi, 0) - b.roi AS gain, ci_low FROM (SELECT half, {_ROI} AS roi FROM x_halves GROUP BY half) b LEFT JOIN (SELECT half, {_ROI} AS roi FROM x_filtered GROUP BY half) a USING (half)
  LEFT JOIN ({boot_sql('x_half_units', 'half')}) USING (half)) WHERE half = 'test' AND (SELECT count(DISTINCT half) FROM x_halves) = 2
UNION ALL SELECT 4, 'edge-deciles', CASE WHEN low > high THEN 'warning' ELSE 'neutral' END, high - low FROM (
  SELECT sum(roi) FILTER (WHERE i <= third) / max(third) AS low, sum(roi) FILTER (WHERE i > k - third) / max(third) AS high FROM x_deciles HAVING sum(n) >= 300)
UNION ALL SELECT 5, 'edge-reliability', CASE WHEN c > 0.5 THEN 'good' ELSE 'warning' END, c FROM (SELECT {_SAFE.format('corr(i, roi)')} AS c FROM (
  SELECT bucket, {_ROI} AS roi, CAST(row_number() OVER (ORDER BY bucket) AS DOUBLE) AS i FROM (
   SELECT *, CASE WHEN edge < 0.05 THEN 0 WHEN edge < 0.08 THEN 1 WHEN edge < 0.12 THEN 2 ELSE 3 END AS bucket FROM x_bets WHERE edge < 1) GROUP BY bucket) HAVING count(*) >= 3) CROSS JOIN a WHERE n >= 40
UNION ALL SELECT 6, 'band-sensitivity', CASE WHEN c > 0 THEN 'good' ELSE 'warning' END, c FROM (SELECT {_SAFE.format('corr(width, roi)')} AS c FROM (
  SELECT odds_max - odds_min AS width, {_ROI} AS roi FROM x_sweep_units GROUP BY band, odds_min, odds_max) HAVING count(*) >= 3)
UNION ALL SELECT 7, 'market-split', CASE WHEN bool_or(ci_low > 0) THEN 'good' ELSE 'neutral' END, CAST(count(*) AS DOUBLE) FROM ({boot_sql('x_bet_units', 'market')}) HAVING count(*) >= 2
UNION ALL SELECT 8, 'calibration', CASE WHEN gap < 2 THEN 'good' WHEN gap < 4 THEN 'warning' ELSE 'critical' END, gap FROM (SELECT sum(abs(observed - predicted) * n) / sum(n) * 100 AS gap FROM x_cal_bins HAVING count(*) > 0)
UNION ALL SELECT 9, 'stability', CASE WHEN spread < 10 THEN 'good' WHEN spread < 25 THEN 'warning' ELSE 'critical' END, spread FROM (SELECT max(roi) - min(roi) AS spread FROM (
  SELECT period, count(*) AS n, {_ROI} AS roi FROM (SELECT *, ntile(4) OVER ({_BET_ORDER}) AS period FROM x_bets) GROUP BY period) HAVING sum(n) >= 40)
UNION ALL SELECT 10, 'outcome-split', CASE WHEN share > 70 THEN 'warning' ELSE 'neutral' END, share FROM (SELECT max(s.n) / max(a.n) * 100.0e0 AS share FROM (
  SELECT lower(outcome) AS side, count(*) AS n FROM x_bets WHERE lower(outcome) IN ('home', 'draw', 'away') GROUP BY side) s CROSS JOIN a HAVING count(*) >= 2)
UNION ALL SELECT 11, 'by-competition', 'neutral', CAST(count(*) FILTER (WHERE n >= 10 AND roi > 0) AS DOUBLE) FROM (SELECT competition, count(*) AS n, {_ROI} AS roi FROM x_bets GROUP BY competition)
  HAVING count(*) >= 2 AND count(*) FILTER (WHERE n >= 10) >= 2)
SELECT CAST(row_number() OVER (ORDER BY CASE state WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'neutral' THEN 2 ELSE 3 END, ord) AS INTEGER) AS place, id, state, round(stat, 4) AS stat FROM f
""")
def insight_states(spark, sf):
    """The place, state and number of every finding, most decisive first."""
    rows = stage(insights.ranked(findings(spark, sf)).select("id", "state", F.round("stat", 4).alias("stat"), "severity"), "findings")
    declared = F.array_position(F.array(*[F.lit(i) for i in insights.ORDER]), F.col("id"))
    order = Window.orderBy("severity", declared)  # as many rows as there are findings
    return rows.select(F.row_number().over(order).alias("place"), "id", "state", "stat")


@query("coverage_table", "S13 R16", "SELECT competition, count(*) AS matches, min(date) AS first, max(date) AS last FROM x_backtest GROUP BY competition")
def coverage_table(spark, sf):
    return readers.coverage(dataset(spark, sf))


def upcoming_value(spark, sf):
    """Selections of the coming matches; a match that no fit could price, its teams not being in it, is not known."""
    from_day = F.col("date") >= F.lit(w.CARD_DAY).cast("date")
    coming = dataset(spark, sf).filter(from_day).select("match_id")
    rows = coming.join(selections(spark, sf).filter(from_day), "match_id", "left")
    return rows.select("match_id", "market", "outcome", "odds", "edge", F.col("market").isNotNull().alias("known"),
                       (F.col("odds").between(1.6, 2.5) & (F.col("edge") >= 0.03))
                       .alias("qualifies"))


@query("top_value_picks", "K6", f"""
SELECT match_id, market, outcome, odds, edge, qualifies FROM (SELECT *, odds BETWEEN 1.6 AND 2.5 AND edge >= 0.03 AS qualifies FROM x_bet_rows WHERE date >= DATE '{w.CARD_DAY}') ORDER BY qualifies DESC, edge DESC, match_id, outcome LIMIT 20
""")
def top_value_picks(spark, sf):
    return selection.top_picks(upcoming_value(spark, sf)).drop("known")


@query("best_value_pick", "K6", f"""
WITH u AS (SELECT *, odds BETWEEN 1.6 AND 2.5 AND edge >= 0.03 AS qualifies FROM x_bet_rows WHERE date >= DATE '{w.CARD_DAY}')
SELECT match_id, outcome, edge, qualifies, (SELECT count(*) FROM u) AS n_considered, (SELECT count(*) FROM u WHERE qualifies) AS n_qualifying FROM u ORDER BY qualifies DESC, edge DESC, match_id, outcome LIMIT 1
""")
def best_value_pick(spark, sf):
    return selection.best_pick(upcoming_value(spark, sf)).select(
        "match_id", "outcome", "edge", "qualifies", "n_considered", "n_qualifying")

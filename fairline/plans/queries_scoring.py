"""Queries: scoring rules, reliability, calibration and their jobs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from fairline import config
from fairline.functions import markets, stats
from fairline.operators import quality
from fairline.operators.quantiles import exact_quantiles, steps
from fairline.plans import calibration, evaluation, queries_pricing as qp, sql_tables as t
from fairline.plans.registry import CTES, cte, query
from fairline.session import shared_folder, stage
from fairline.sources import sinks, textfiles, warehouse as w
from fairline.sources.sinks import rounded


def store(df):
    return stage(df, "part")


FOLDED = ("match_id", "date", "competition", "fold", "lam", "mu", "rho", "corner_lam", "corner_mu",
          "home_goals", "away_goals", "total_corners")


LINE = ("q_home", "q_draw", "q_away")


def folded(spark, sf, line=False):
    """Blended parameters of every match with its fold, a row per match, stored once per session; with the closing ``line``
    where it is asked for, so that it needs no join."""
    line = line or w.is_stored(spark, sf, "folded_line")
    return w._stored(spark, sf, "folded_line" if line else "folded", lambda s, d: calibration.with_folds(
        qp.fused(s, d)).select(*FOLDED, *(LINE if line else ())))


def graded(spark, sf):
    """Graded selections of every match with their fold. They are 46 times the matches, so they are
    not stored: a projection makes them from the parameters wherever they are read."""
    return qp.drop_void(qp.expanded(folded(spark, sf), digits=12,
                                    keep=("match_id", "date", "competition", "fold")))


def curves(spark, sf):
    """The calibrators of every group and fold, stored once per session."""
    return w._stored(spark, sf, "curves", lambda s, d: calibration.learn(graded(s, d)))


def calibrated(spark, sf):
    """Walk-forward calibrated selections. They are not stored, as ``graded`` are not: they are calibrated wherever they
    are read."""
    return calibration.replay(graded(spark, sf), curves(spark, sf))


def calibrated_wide(spark, sf, keys, keep, line=False):
    """``calibrated`` selections ``keys`` of the matches that can be graded, side by side as ``k0``, ``k1`` ..."""
    played = folded(spark, sf, line).filter("home_goals IS NOT NULL AND away_goals IS NOT NULL")
    at = ["fold", *keep]
    wide = markets.expand_selections(played, keep=tuple(at), keys=tuple(keys), digits=12, wide=True)
    wide = wide.select(*at, *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    return calibration.replay_wide(wide, curves(spark, sf), {f"k{i}": markets.GROUP_OF[k] for i, k in enumerate(keys)})


def qlist(bins: int) -> str:
    return "[" + ", ".join(f"{x:.17e}" for x in steps(bins)) + "]"


cte("x_folds", """
SELECT match_id, CAST(ntile(5) OVER (ORDER BY date, competition, substr(md5(match_id), 1, 2), match_id) AS INTEGER) AS fold FROM x_params
""")
cte("x_vals", """--m
SELECT match_id, date, key, "group", prob, y, fold FROM x_flat JOIN x_folds USING (match_id)
""")


@query("chronological_folds", "W7", """
SELECT f.match_id, fold FROM x_folds f
""")
def chronological_folds(spark, sf):
    return calibration.with_folds(w.parameters(spark, sf)).select("match_id", "fold")


@query("brier_log_loss", "A6 P12", """
SELECT key, count(*) AS n, round(avg((prob - y) * (prob - y)), 6) AS brier,
  round(avg(-(y * ln(least(greatest(prob, 1e-9), 1 - 1e-9)) + (1 - y) * ln(1 - least(greatest(prob, 1e-9), 1 - 1e-9)))), 6) AS log_loss
FROM x_flat GROUP BY key
""")
def brier_log_loss(spark, sf):
    return rounded(evaluation.scores(graded(spark, sf), ["key"]), 6)


_EDGES = list(zip(config.BAND_EDGES, config.BAND_EDGES[1:]))
_BANDS = ", ".join(f"({D1}, {D2}, '{lo:.0%}-{min(hi, 1.0):.0%}')" for lo, hi in _EDGES
                   for D1, D2 in [(t.D(lo), t.D(hi))])


def wilson_sql(hits: str, n: str) -> tuple[str, str]:
    p = f"(CAST({hits} AS DOUBLE) / {n})"
    centre = f"(({p} + 3.8416e0 / (2 * {n})) / (1 + 3.8416e0 / {n}))"
    half = f"(1.96e0 * sqrt({p} * (1 - {p}) / {n} + 3.8416e0 / (4.0e0 * {n} * {n})) / (1 + 3.8416e0 / {n}))"
    return f"greatest(0, {centre} - {half})", f"least(1, {centre} + {half})"


_WL, _WH = wilson_sql("hits", "n")


def reliability_sql(source: str, where: str = "TRUE") -> str:
    return f"""
SELECT scope, band, band_low, least(band_high, 1) AS band_high, n, round(sp / n, 6) AS predicted, round(hits / n, 6) AS actual,
  round(hits / n - sp / n, 6) AS gap, round({_WL}, 6) AS ci_low, round({_WH}, 6) AS ci_high
FROM (SELECT coalesce("group", 'all') AS scope, band, lo AS band_low, hi AS band_high, count(*) AS n, sum(prob) AS sp, CAST(sum(y) AS DOUBLE) AS hits
  FROM {source} JOIN (VALUES {_BANDS}) b(lo, hi, band) ON prob >= lo AND prob < hi WHERE {where}
  GROUP BY GROUPING SETS ((band, lo, hi), ("group", band, lo, hi)))
"""


cte("x_reliability", reliability_sql("x_vals"))


@query("reliability_all_scopes", "A10 A11 A30", "SELECT * FROM x_reliability")
def reliability_all_scopes(spark, sf):
    return rounded(evaluation.reliability(graded(spark, sf)), 6)


_LINE = f"""
SELECT unnest([{{'prob': q_home, 'y': home_goals > away_goals}}, {{'prob': q_draw, 'y': home_goals = away_goals}}, {{'prob': q_away, 'y': home_goals < away_goals}}], recursive := true)
FROM x_params WHERE q_home IS NOT NULL
"""


@query("closing_line_reliability", "P2 P3 F3 M3 A10 A30", f"""
SELECT band, n, round(sp / n, 6) AS predicted, round(hits / n, 6) AS actual, round({_WL}, 6) AS ci_low, round({_WH}, 6) AS ci_high
FROM (SELECT band, count(*) AS n, sum(prob) AS sp, CAST(count(*) FILTER (WHERE y) AS DOUBLE) AS hits FROM ({_LINE}) JOIN (VALUES {_BANDS}) b(lo, hi, band) ON prob >= lo AND prob < hi GROUP BY band)
""")
def closing_line_reliability(spark, sf):
    """Straight from prices: does the closing line's x % happen x % of the time?"""
    from fairline.functions import prices

    m = w.matches(spark, sf).select(
        "home_goals", "away_goals",
        prices.devig(prices.preferred_prices(qp.cols(qp.CONS), qp.cols(qp.BEST)),
                     "proportional").alias("q")).filter("q IS NOT NULL")
    margin = F.col("home_goals") - F.col("away_goals")
    rows = m.select(F.inline(F.arrays_zip(
        F.array(*[F.lit("1x2")] * 3).alias("group"), F.col("q").alias("prob"),
        F.array(margin > 0, margin == 0, margin < 0).alias("won"))).alias("group", "prob", "won"))
    table = evaluation.reliability(rows.withColumn("y", F.col("won").cast("double")))
    return rounded(table.filter("scope = 'all'").select(
        "band", "n", "predicted", "actual", "ci_low", "ci_high"), 6)


@query("worst_band_gap", "F21", """
SELECT round(max(abs(actual - predicted)), 5) AS worst_gap, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE abs(actual - predicted) > 0.02) AS flagged
FROM x_reliability WHERE scope = 'all'
""")
def worst_band_gap(spark, sf):
    return rounded(evaluation.worst_gap(rounded(evaluation.reliability(graded(spark, sf)), 6)), 5)


def ece_sql(source: str, by: str, bins: int = 20, prob: str = "prob") -> str:
    return f"""
SELECT {by}, CASE WHEN max(total) >= {bins * 5} THEN sum(abs(sp / n - sy / n) * n) / sum(n) END AS ece FROM (
 SELECT f.{by}, max(total) AS total, least(len(list_filter(e[2:len(e) - 1], lambda x: x <= f.{prob})), len(e) - 2) AS slot, count(*) AS n, sum(f.{prob}) AS sp, CAST(sum(y) AS DOUBLE) AS sy
 FROM {source} f JOIN (SELECT {by}, count(*) AS total, list_sort(list_distinct(quantile_cont({prob}, {qlist(bins)}))) AS e FROM {source} GROUP BY {by}) q ON f.{by} = q.{by}
 GROUP BY f.{by}, slot) GROUP BY {by}
"""


@query("expected_calibration_error", "A14", f"""
SELECT "group", round(ece, 6) AS ece FROM ({ece_sql('x_vals', '"group"')})
""")
def expected_calibration_error(spark, sf):
    return rounded(evaluation.calibration_error(graded(spark, sf), ["group"]), 6)


@query("probability_quantiles", "A14 R8", f"""
SELECT "group", count(*) AS n, {', '.join(f'round(quantile_cont(prob, {q}), 6) AS q{i}' for i, q in enumerate((0.01, 0.25, 0.5, 0.75, 0.99)))} FROM x_vals GROUP BY "group"
""")
def probability_quantiles(spark, sf):
    out = exact_quantiles(graded(spark, sf), ["group"], "prob", [0.01, 0.25, 0.5, 0.75, 0.99])
    return out.select("group", "n", *[F.round(F.get("edges", i), 6).alias(f"q{i}")
                                      for i in range(5)])


def top_sql(source: str, by: str) -> str:
    lo, hi = wilson_sql("hits", "n_top")
    return f"""
SELECT {by}, n, round(base_rate, 6) AS base_rate, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, n_top, round(predicted, 6) AS predicted,
  CASE WHEN n_top > 0 THEN round(hits / n_top, 6) END AS actual, CASE WHEN n_top > 0 THEN round({lo}, 6) END AS ci_low, CASE WHEN n_top > 0 THEN round({hi}, 6) END AS ci_high
FROM (SELECT {by}, count(*) AS n, avg(y) AS base_rate, avg((prob - y) * (prob - y)) AS brier,
   avg(-(y * ln(least(greatest(prob, 1e-9), 1 - 1e-9)) + (1 - y) * ln(1 - least(greatest(prob, 1e-9), 1 - 1e-9)))) AS log_loss,
   count(*) FILTER (WHERE prob >= 0.75) AS n_top, avg(prob) FILTER (WHERE prob >= 0.75) AS predicted, CAST(sum(y) FILTER (WHERE prob >= 0.75) AS DOUBLE) AS hits
  FROM {source} GROUP BY {by})
"""


_GROUP_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in config.GROUPS.items())


@query("group_summary", "A12", f"""
SELECT s.*, g.name, round(e.ece, 6) AS ece FROM ({top_sql('x_vals', '"group"')}) s JOIN ({ece_sql('x_vals', '"group"')}) e ON s."group" = e."group"
JOIN (VALUES {_GROUP_NAMES}) g(k, name) ON g.k = s."group"
""")
def group_summary(spark, sf):
    return rounded(evaluation.group_summary(graded(spark, sf)), 6)


@query("per_selection", "A13", f"""
SELECT s.*, c.selection FROM ({top_sql('x_vals', 'key')}) s JOIN (VALUES {', '.join("('%s', '%s')" % (s.key, s.label) for s in t.CATALOGUE)}) c(k, selection) ON c.k = s.key
""")
def per_selection(spark, sf):
    return rounded(evaluation.per_selection(graded(spark, sf)), 6)


cte("x_versus", """--m
SELECT key, prob, y, CASE key WHEN '1x2_home' THEN q_home WHEN '1x2_draw' THEN q_draw WHEN '1x2_away' THEN q_away ELSE q_over END AS market
FROM x_vals JOIN x_params USING (match_id) WHERE key IN ('1x2_home', '1x2_draw', '1x2_away', 'ou2.5_over')
  AND CASE key WHEN '1x2_home' THEN q_home WHEN '1x2_draw' THEN q_draw WHEN '1x2_away' THEN q_away ELSE q_over END IS NOT NULL
""")


@query("versus_market", "A15", f"""
SELECT b.key, n, round(brier_ours, 6) AS brier_ours, round(brier_market, 6) AS brier_market, round(brier_ours - brier_market, 6) AS delta,
  round(o.ece, 6) AS ece_ours, round(m.ece, 6) AS ece_market
FROM (SELECT key, count(*) AS n, avg((prob - y) * (prob - y)) AS brier_ours, avg((market - y) * (market - y)) AS brier_market FROM x_versus GROUP BY key) b
JOIN ({ece_sql('x_versus', 'key')}) o ON o.key = b.key JOIN ({ece_sql('x_versus', 'key', prob='market')}) m ON m.key = b.key
""")
def versus_market(spark, sf):
    line = w.parameters(spark, sf).select("match_id", "q_home", "q_draw", "q_away", "q_over")
    return rounded(evaluation.versus_market(graded(spark, sf).join(line, "match_id"), store), 6)


def coherence_sql(source: str) -> str:
    m = lambda k: f"max(CASE WHEN key = '{k}' THEN prob END)"
    return f"""
SELECT identity, round(avg(gap), 6) AS mean_abs_gap, round(quantile_cont(gap, 0.99), 6) AS p99, round(max(gap), 6) AS max FROM (
 SELECT unnest([{{'identity': '1X = 1 + X', 'gap': abs(x1 - h - d)}}, {{'identity': '12 = 1 + 2', 'gap': abs(x12 - h - a)}}, {{'identity': 'X2 = X + 2', 'gap': abs(x2 - d - a)}},
   {{'identity': '1 + X + 2 = 1', 'gap': abs(h + d + a - 1)}}, {{'identity': 'over/under 2.5 = 1', 'gap': abs(o + u - 1)}}], recursive := true)
 FROM (SELECT match_id, {m('1x2_home')} AS h, {m('1x2_draw')} AS d, {m('1x2_away')} AS a, {m('dc_1x')} AS x1, {m('dc_12')} AS x12, {m('dc_x2')} AS x2, {m('ou2.5_over')} AS o, {m('ou2.5_under')} AS u
   FROM {source} GROUP BY match_id)) WHERE gap IS NOT NULL GROUP BY identity
"""


# Calibrated selections: knots per (fold, group) from earlier folds, pooled by the
# max-min form of the monotone fit, applied between knots by an as-of join.
cte("x_train", """
SELECT v.*, kk.k FROM x_vals v JOIN (SELECT unnest([2, 3, 4, 5]) AS k) kk ON v.fold < kk.k
""")
cte("x_cuts", f"""--m
SELECT k, "group", i AS slot, CASE WHEN i = 0 THEN -1.0::DOUBLE ELSE e[i + 1] END AS edge FROM (
 SELECT k, "group", e, unnest(range(len(e) - 1)) AS i FROM (
  SELECT k, "group", list_sort(list_distinct(quantile_cont(prob, {qlist(150)}))) AS e FROM x_train GROUP BY k, "group" HAVING count(*) >= 2000) WHERE len(e) >= 3)
""")
cte("x_bins", """--m
SELECT t.k, t."group", c.slot, count(*) AS w, avg(prob) AS x, avg(y) AS y
FROM x_train t ASOF JOIN x_cuts c ON t.k = c.k AND t."group" = c."group" AND t.prob >= c.edge GROUP BY t.k, t."group", c.slot
""")


def pooled_sql(bins: str, keys: str) -> str:
    """Monotone fit of (slot, w, y): max over starts of the min over ends of block means."""
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys.split(", "))
    return f"""
WITH p AS (SELECT *, sum(w * y) OVER s AS cs, sum(w) OVER s AS cw, row_number() OVER s AS i FROM {bins} WINDOW s AS (PARTITION BY {keys} ORDER BY slot ROWS UNBOUNDED PRECEDING)),
g AS (SELECT {', '.join('a.' + c for c in keys.split(', '))}, a.i AS j, b.i AS i, min((b.cs - a.cs + a.w * a.y) / (b.cw - a.cw + a.w)) OVER (PARTITION BY {', '.join('a.' + c for c in keys.split(', '))}, a.i ORDER BY b.i DESC ROWS UNBOUNDED PRECEDING) AS m
  FROM p a JOIN p b ON {on} AND b.i >= a.i),
v AS (SELECT {keys}, i, max(m) AS v FROM g GROUP BY {keys}, i)
SELECT p.*, least(greatest(v.v, 1e-4), 1 - 1e-4) AS fit FROM p JOIN v ON {' AND '.join(f'p.{c} = v.{c}' for c in keys.split(', '))} AND p.i = v.i
"""


cte("x_knots", "--m\n" + pooled_sql("x_bins", 'k, "group"'))
cte("x_cal", """--m
WITH s AS (SELECT k, "group", x, fit, lead(x) OVER o AS x1, lead(fit) OVER o AS f1, first_value(x) OVER o AS xa, first_value(fit) OVER o AS fa,
   max(x) OVER (PARTITION BY k, "group") AS xz, max(fit) OVER (PARTITION BY k, "group") AS fz FROM x_knots WINDOW o AS (PARTITION BY k, "group" ORDER BY i)),
lo AS (SELECT k, "group", min(xa) AS xa, min(fa) AS fa FROM s GROUP BY k, "group")
SELECT v.match_id, v.key, v."group", v.y, v.fold, v.prob AS raw, CASE WHEN lo.xa IS NULL THEN v.prob ELSE least(greatest(
   CASE WHEN v.prob < lo.xa THEN least(v.prob, lo.fa) WHEN v.prob > s.xz THEN greatest(v.prob, s.fz) WHEN s.x1 IS NULL THEN s.fit ELSE s.fit + (v.prob - s.x) * (s.f1 - s.fit) / (s.x1 - s.x) END, 1e-4), 1 - 1e-4) END AS prob
FROM x_vals v LEFT JOIN lo ON lo.k = v.fold AND lo."group" = v."group" ASOF LEFT JOIN s ON s.k = v.fold AND s."group" = v."group" AND v.prob >= s.x
""")


_KNOTS = """
SELECT CAST(k AS INTEGER) AS k, "group", CAST(i - 1 AS INTEGER) AS knot, round(x, 6) AS x, round(fit, 6) AS y FROM x_knots
UNION ALL SELECT CAST(t.k AS INTEGER), t."group", CAST(v.knot AS INTEGER), v.x, v.x FROM (SELECT DISTINCT k, "group" FROM x_train) t CROSS JOIN (VALUES (0, 0.0e0), (1, 1.0e0)) v(knot, x)
WHERE NOT EXISTS (SELECT 1 FROM x_knots n WHERE n.k = t.k AND n."group" = t."group")
"""


def production_knots(spark, sf):
    values = graded(spark, sf)
    later = lambda df: df.filter("fold < 5").withColumn(
        "k", F.explode(F.sequence(F.col("fold") + 1, F.lit(5)))).drop("fold")
    learned = calibration.fit(values, ["k", "group"], expand=later,
                              source_by=["fold", "group"])
    return calibration.to_rows(learned, ["k", "group"])


@query("calibrator_knots", "R8 W11 S17", _KNOTS)
def calibrator_knots(spark, sf):
    return production_knots(spark, sf).drop("n")


@query("calibrator_files", "S17 S14", _KNOTS)
def calibrator_files(spark, sf):
    """Calibrators stored as JSON lines, loaded as curves, and taken apart again."""
    path = f"{shared_folder(spark)}/fairline/calibrators-{uuid.uuid4().hex}"
    sinks.write_json_rows(production_knots(spark, sf), path, 6)
    loaded = textfiles.sound(textfiles.read_book(spark, path, "k int, group string, n bigint, knot int, x double, y double", "json"))
    return calibration.to_rows(calibration.from_rows(loaded, ["k", "group"]), ["k", "group"]).drop("n")


@query("walk_forward_calibration", "R9 J13 F17", """
SELECT fold, key, count(*) AS n, round(avg(raw), 6) AS raw, round(avg(prob), 6) AS calibrated, round(min(prob), 6) AS low, round(max(prob), 6) AS high, round(sum(prob * prob), 3) AS energy FROM x_cal GROUP BY fold, key
""")
def walk_forward_calibration(spark, sf):
    c = calibrated(spark, sf)
    return c.groupBy("fold", "key").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("raw"), 6).alias("raw"),
        F.round(F.avg("prob"), 6).alias("calibrated"), F.round(F.min("prob"), 6).alias("low"),
        F.round(F.max("prob"), 6).alias("high"),
        F.round(F.sum(F.col("prob") * F.col("prob")), 3).alias("energy"))


cte("x_scored", "SELECT * FROM x_cal WHERE fold > 1")
cte("x_reliability_cal", reliability_sql("x_scored"))


@query("calibrated_reliability", "R9 R10 A11", "SELECT * FROM x_reliability_cal")
def calibrated_reliability(spark, sf):
    return rounded(evaluation.reliability(calibrated(spark, sf).filter("scored")), 6)


@query("recalibrate", "R10 A6 A14", f"""
WITH b AS (SELECT 'raw' AS which, raw AS prob, y FROM x_scored UNION ALL SELECT 'calibrated', prob, y FROM x_scored)
SELECT s.which, s.n, round(s.brier, 6) AS brier, round(e.ece, 6) AS ece FROM (SELECT which, count(*) AS n, avg((prob - y) * (prob - y)) AS brier FROM b GROUP BY which) s
JOIN ({ece_sql('b', 'which')}) e ON e.which = s.which
""")
def recalibrate(spark, sf):
    scored = calibrated(spark, sf).filter("scored")
    both = scored.select(F.inline(F.array(
        F.struct(F.lit("raw").alias("which"), F.col("raw").alias("prob"), "y"),
        F.struct(F.lit("calibrated").alias("which"), F.col("prob"), "y"))))
    out = evaluation.scores(both, ["which"]).drop("log_loss").join(
        evaluation.calibration_error(both, ["which"]), "which")
    return rounded(out, 6)


@query("coherence", "A16", coherence_sql("x_cal"))
def coherence(spark, sf):
    keys = [k for k in markets.GOAL_KEYS if k in evaluation.COHERENT]
    wide = calibrated_wide(spark, sf, keys, ["match_id"])
    return rounded(evaluation.coherence_of(wide, [f"k{keys.index(k)}" for k in evaluation.COHERENT], store), 6)


@query("ranked_probability_score", "A8 A9", """
WITH wide AS (SELECT match_id, max(CASE WHEN key = '1x2_home' THEN prob END) AS h, max(CASE WHEN key = '1x2_draw' THEN prob END) AS d, max(CASE WHEN key = '1x2_away' THEN prob END) AS a,
   max(CASE WHEN key = '1x2_home' THEN y END) AS yh, max(CASE WHEN key = '1x2_draw' THEN y END) AS yd FROM x_scored WHERE "group" = '1x2' GROUP BY match_id),
r AS (SELECT w.*, h + d + a AS s, q_home / (q_home + q_draw + q_away) AS qh, q_draw / (q_home + q_draw + q_away) AS qd FROM wide w JOIN x_params USING (match_id) WHERE q_home IS NOT NULL)
SELECT 'Ours (calibrated)' AS forecast, count(*) AS n, round(avg((pow(h / s - yh, 2) + pow((h + d) / s - yh - yd, 2)) / 2), 6) AS rps, round(avg(abs(s - 1)), 6) AS renorm FROM r
UNION ALL SELECT 'Closing line', count(*), round(avg((pow(qh - yh, 2) + pow(qh + qd - yh - yd, 2)) / 2), 6), 0 FROM r
UNION ALL SELECT 'Knowing nothing', count(*), round(avg((pow(1.0 / 3 - yh, 2) + pow(2.0 / 3 - yh - yd, 2)) / 2), 6), 0 FROM r
""")
def ranked_probability_score(spark, sf):
    keys = evaluation.ORDERED
    wide = calibrated_wide(spark, sf, keys, ["home_goals", "away_goals", *LINE], line=True).filter("fold > 1")
    won = [markets.settle(k, F.col("home_goals"), F.col("away_goals"), None).cast("int") for k in keys]
    return rounded(evaluation.rps_of(wide.select(F.array("k0", "k1", "k2").alias("ours"), F.array(*won).alias("won"),
                                                 F.array(*LINE).alias("line"))), 6)


@query("evaluation_tables", "R12", f"""
SELECT 'group' AS level, "group" AS name, n, brier FROM ({top_sql('x_scored', '"group"')})
UNION ALL SELECT 'selection', key, n, brier FROM ({top_sql('x_scored', 'key')})
UNION ALL SELECT 'band', scope || ' ' || band, n, round(gap, 6) FROM x_reliability_cal
""")
def evaluation_tables(spark, sf):
    """The evaluation tables of one run, stacked: groups, selections, bands."""
    c = calibrated(spark, sf).filter("scored")
    row = lambda df, level, name, value: df.select(
        F.lit(level).alias("level"), name.alias("name"), "n", F.round(value, 6).alias("brier"))
    sums = store(evaluation.band_sums(c, ["group", "key"]))  # (selections x bands) rows, made in one pass
    return (row(evaluation.scores_of(sums, ["group"]), "group", F.col("group"), F.col("brier"))
            .unionByName(row(evaluation.scores_of(sums, ["key"]), "selection", F.col("key"),
                             F.col("brier")))
            .unionByName(row(evaluation.reliability_of(sums), "band",
                             F.concat_ws(" ", "scope", "band"), F.col("gap"))))


@query("finite_check", "P13", """
SELECT count(*) FILTER (WHERE q_home IS NULL) AS no_price, count(*) FILTER (WHERE lam_model IS NULL) AS no_model FROM x_params
""")
def finite_check(spark, sf):
    p = quality.require_finite(w.parameters(spark, sf), ["lam_model", "mu_model"], "parameters")
    return p.agg(quality.count_non_finite(["q_home", "q_draw", "q_away"]).alias("no_price"),
                 quality.count_non_finite(["lam_model"]).alias("no_model"))


SWEEP_WEIGHTS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


# The sweep's tables are those above with the weight put into the group's name, so that
# every weight has calibrators of its own.
_WEIGHTS = f"(VALUES {', '.join(f'({t.D(v)})' for v in SWEEP_WEIGHTS)}) s(weight)"
_AT = "match_id || '|' || weight"
cte("x_fused_w", f"""
SELECT {_AT} AS match_id, CASE WHEN lam_market IS NULL THEN lam_model ELSE pow(lam_model, {t.D(1)} - weight) * pow(lam_market, weight) END AS lam,
  CASE WHEN mu_market IS NULL THEN mu_model ELSE pow(mu_model, {t.D(1)} - weight) * pow(mu_market, weight) END AS mu,
  CASE WHEN rho_market IS NULL THEN rho_model ELSE ({t.D(1)} - weight) * rho_model + weight * rho_market END AS rho
FROM x_params CROSS JOIN {_WEIGHTS}
""")
cte("x_goal_probs_w", "--m\n" + t.goal_probs("x_fused_w"))
cte("x_vals_w", f"""--m
SELECT match_id, s.key AS key, weight || '|' || s."group" AS "group", s.prob AS prob, CASE WHEN s.result THEN 1 ELSE 0 END AS y, fold FROM (
 SELECT p.match_id, weight, unnest({t.selection_rows('goals')}) AS s FROM x_params p CROSS JOIN {_WEIGHTS} JOIN x_goal_probs_w g ON g.match_id = p.{_AT}
 UNION ALL SELECT match_id, weight, unnest({t.selection_rows('corners')}) AS s FROM x_corner_probs JOIN x_params USING (match_id) CROSS JOIN {_WEIGHTS.replace(' s(', ' v(')})
JOIN x_folds USING (match_id) WHERE s.result IS NOT NULL AND s.prob IS NOT NULL
""")
_CHAIN = ("x_vals", "x_train", "x_cuts", "x_bins", "x_knots", "x_cal")
for _name in _CHAIN[1:]:
    cte(f"{_name}_w", re.sub(rf"\b({'|'.join(_CHAIN)})\b", r"\1_w", CTES[_name]))
cte("x_scored_w", """--m
SELECT CAST(split_part("group", '|', 1) AS DOUBLE) AS weight, prob, y FROM x_cal_w WHERE fold > 1
""")


@query("weight_sweep", "R11", f"""
SELECT s.weight, n, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(ece, 6) AS ece FROM (
 SELECT weight, count(*) AS n, avg((prob - y) * (prob - y)) AS brier,
  avg(-(y * ln(least(greatest(prob, 1e-9), 1 - 1e-9)) + (1 - y) * ln(1 - least(greatest(prob, 1e-9), 1 - 1e-9)))) AS log_loss FROM x_scored_w GROUP BY weight) s
JOIN ({ece_sql('x_scored_w', 'weight')}) e ON e.weight = s.weight
""")
def weight_sweep(spark, sf):
    """How much weight the closing line deserves: every weight in one plan, as a group key."""
    from fairline.functions import prices

    weights = F.explode(F.array(*[F.lit(v) for v in SWEEP_WEIGHTS])).alias("weight")
    sides = ("lam_model", "lam_market", "mu_model", "mu_market", "rho_model", "rho_market")
    p = store(calibration.with_folds(w.parameters(spark, sf)).select(
        "fold", *sides, "corner_lam", "corner_mu", "home_goals", "away_goals", "total_corners"))
    crossed = p.select("*", weights)
    weight = F.col("weight")
    blended = crossed.withColumns({
        "lam": prices.fuse(F.col("lam_model"), F.col("lam_market"), weight),
        "mu": prices.fuse(F.col("mu_model"), F.col("mu_market"), weight),
        "rho": prices.fuse(F.col("rho_model"), F.col("rho_market"), weight, geometric=False)})
    values = store(qp.drop_void(qp.expanded(blended, keep=("weight", "fold"), digits=12)).drop("key"))
    scored = store(calibration.walk_forward(values, ["weight", "group"], store=stage)
                   .filter("scored").select("weight", "prob", "y"))
    out = evaluation.scores(scored, ["weight"]).join(
        evaluation.calibration_error(scored, ["weight"]), "weight")
    return rounded(out, 6)

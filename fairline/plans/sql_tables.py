"""Common tables of the SQL twins: the star-schema mapping, written for DuckDB."""

from __future__ import annotations

from fairline.functions.markets import CATALOGUE
from fairline.plans.registry import cte

_U = "('0x' || substr({d}, {p}, 8))::BIGINT::DOUBLE / CAST(4294967296 AS DOUBLE)"
_UNITS = ", ".join(
    f"{_U.format(d='ha' if i < 4 else 'hb', p=8 * (i % 4) + 1)} AS u{i + 1}" for i in range(8))


def D(value: float) -> str:
    return f"CAST({value} AS DOUBLE)"


cte("x_keys", f"""
SELECT *, md5(match_id || '|a') AS ha, md5(match_id || '|b') AS hb FROM (
 SELECT CAST(l_shipdate AS DATE) AS date,
   'C' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS competition,
   CAST(l_partkey % 16 AS INT) AS h,
   CAST((l_partkey % 16 + 1 + l_orderkey % 15) % 16 AS INT) AS a,
   concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
     CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
     CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS match_id
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
""")

cte("x_units", f"""
SELECT *, {D(0.38)} + {D(0.012)} * (h - a) + {D(0.1)} * (u6 - {D(0.5)}) AS p_home,
  {D(0.27)} AS p_draw,
  {D(0.5)} + {D(0.008)} * (h - a) + {D(0.06)} * (u8 - {D(0.5)}) AS p_over
FROM (SELECT *, {_UNITS} FROM x_keys)
""")


def _price(prob: str, margin: float, ok: str) -> str:
    return f"CASE WHEN {ok} AND u7 >= 0.005 THEN round(1 / (({prob}) * {D(margin)}), 2) END"


_CONS, _BEST = "u8 >= 0.02", "(u8 < 0.02 OR u8 >= 0.03)"
_OC, _OB = "u6 >= 0.05", "u6 >= 0.02"
_PA = f"{D(1)} - p_home - p_draw"

cte("x_matches", f"""--m
SELECT match_id, date, competition,
  CASE WHEN month(date) >= 7 THEN year(date) ELSE year(date) - 1 END AS season,
  'team ' || CAST(h AS VARCHAR) AS home, 'team ' || CAST(a AS VARCHAR) AS away,
  home_goals, away_goals,
  CASE WHEN competition <> 'C03' THEN CAST(3 + floor(u4 * 6) AS INT) END AS home_corners,
  CASE WHEN competition <> 'C03' THEN CAST(2 + floor(u5 * 6) AS INT) END AS away_corners,
  CASE WHEN competition <> 'C03' THEN CAST(5 + floor(u4 * 6) + floor(u5 * 6) AS INT) END AS total_corners,
  CASE WHEN competition <> 'C07' THEN CAST(home_goals * 2 + 1 + floor(u7 * 5) AS INT) END AS home_sot,
  CASE WHEN competition <> 'C07' THEN CAST(away_goals * 2 + 1 + floor(u5 * 4) AS INT) END AS away_sot,
  {_price('p_home', 1.06, _CONS)} AS home_odds_cons,
  {_price('p_draw', 1.06, 'TRUE')} AS draw_odds_cons,
  {_price(_PA, 1.06, 'TRUE')} AS away_odds_cons,
  {_price('p_home', 1.0, 'TRUE')} AS home_odds,
  {_price('p_draw', 1.0, _BEST)} AS draw_odds,
  {_price(_PA, 1.0, 'TRUE')} AS away_odds,
  {_price('p_over', 1.05, _OC)} AS over25_odds_cons,
  {_price(f'{D(1)} - p_over', 1.05, _OC)} AS under25_odds_cons,
  {_price('p_over', 1.0, _OB)} AS over25_odds,
  {_price(f'{D(1)} - p_over', 1.0, _OB)} AS under25_odds
FROM (SELECT *,
   CASE WHEN u1 < p_home THEN CAST(floor(u2 * 2) + 1 + floor(u3 * 2) AS INT) ELSE CAST(floor(u2 * 2) AS INT) END AS home_goals,
   CASE WHEN u1 >= p_home + p_draw THEN CAST(floor(u2 * 2) + 1 + floor(u3 * 2) AS INT) ELSE CAST(floor(u2 * 2) AS INT) END AS away_goals
 FROM x_units)
""")


def sane(*cols: str) -> str:
    return "(" + " AND ".join(f"coalesce({c}, 0) > 1" for c in cols) + ")"


_HC = sane("home_odds_cons", "draw_odds_cons", "away_odds_cons")
_HB = sane("home_odds", "draw_odds", "away_odds")

cte("x_params", f"""--m
SELECT match_id, date, competition, season, home, away, home_goals, away_goals, total_corners,
  {D(1.3)} + {D(0.03)} * (hn - an) AS lam_model, {D(1.05)} - {D(0.02)} * (hn - an) AS mu_model,
  {D(-0.03)} AS rho_model,
  CASE WHEN q_home IS NOT NULL THEN {D(0.3)} + {D(2.4)} * q_home END AS lam_market,
  CASE WHEN q_home IS NOT NULL THEN {D(0.3)} + {D(2.2)} * q_away END AS mu_market,
  CASE WHEN q_home IS NOT NULL THEN {D(0.02)} END AS rho_market,
  CASE WHEN total_corners IS NOT NULL THEN {D(5.4)} + {D(0.05)} * hn END AS corner_lam,
  CASE WHEN total_corners IS NOT NULL THEN {D(4.6)} + {D(0.03)} * an END AS corner_mu,
  q_home, q_draw, q_away, q_over, home_odds, draw_odds, away_odds, over25_odds, under25_odds
FROM (SELECT *, r_home / (r_home + r_draw + r_away) AS q_home,
    r_draw / (r_home + r_draw + r_away) AS q_draw, r_away / (r_home + r_draw + r_away) AS q_away,
    CASE WHEN {sane('over25_odds_cons', 'under25_odds_cons')} THEN
      (1 / over25_odds_cons) / (1 / over25_odds_cons + 1 / under25_odds_cons) END AS q_over
  FROM (SELECT *, CAST(substr(home, 6, 2) AS DOUBLE) AS hn, CAST(substr(away, 6, 2) AS DOUBLE) AS an,
      1 / CASE WHEN {_HC} THEN home_odds_cons WHEN {_HB} THEN home_odds END AS r_home,
      1 / CASE WHEN {_HC} THEN draw_odds_cons WHEN {_HB} THEN draw_odds END AS r_draw,
      1 / CASE WHEN {_HC} THEN away_odds_cons WHEN {_HB} THEN away_odds END AS r_away
    FROM x_matches))
""")

cte("x_quotes", f"""--m
SELECT match_id, date, competition, home, away, days_ahead, over25_odds, under25_odds,
  {', '.join(f"round({c} * ({D(1)} + {D(0.010717)} * days_ahead), 2) AS {c}" for c in
             ('home_odds', 'draw_odds', 'away_odds', 'home_odds_cons', 'draw_odds_cons', 'away_odds_cons'))},
  CAST(date - CAST(days_ahead AS INTEGER) AS TIMESTAMP) + INTERVAL 9 HOUR AS fetched_at,
  CASE WHEN ('0x' || substr(md5(match_id || '|k'), 1, 2))::BIGINT % 3 <> 0
    THEN CAST(date AS TIMESTAMP) + INTERVAL 19 HOUR END AS commence_time
FROM x_matches CROSS JOIN (VALUES (1), (3), (6)) d(days_ahead)
""")

# Scoreline grid of the fused parameters: one row per match and cell, low cells adjusted,
# clipped at zero. The Spark side never builds this grid.
_PMF = "exp(-{m} + {k} * ln({m}) - lgamma({k} + 1))"

cte("x_fused", f"""
SELECT *, CASE WHEN lam_market IS NULL THEN lam_model ELSE pow(lam_model, {D(1)} - {D(0.9)}) * pow(lam_market, {D(0.9)}) END AS lam,
  CASE WHEN mu_market IS NULL THEN mu_model ELSE pow(mu_model, {D(1)} - {D(0.9)}) * pow(mu_market, {D(0.9)}) END AS mu,
  CASE WHEN rho_market IS NULL THEN rho_model ELSE ({D(1)} - {D(0.9)}) * rho_model + {D(0.9)} * rho_market END AS rho
FROM x_params
""")

GRID = """
SELECT p.match_id, i.i AS i, j.j AS j, greatest(0, {hp} * {ap} *
   CASE WHEN i.i = 0 AND j.j = 0 THEN 1 - lam * mu * rho WHEN i.i = 0 AND j.j = 1 THEN 1 + lam * rho
        WHEN i.i = 1 AND j.j = 0 THEN 1 + mu * rho WHEN i.i = 1 AND j.j = 1 THEN 1 - rho ELSE 1 END) AS c
FROM {src} p CROSS JOIN (SELECT unnest(range({n})) AS i) i CROSS JOIN (SELECT unnest(range({n})) AS j) j
"""


def grid(src: str, n: int = 13) -> str:
    return GRID.format(src=src, n=n, hp=_PMF.format(m="lam", k="i.i"),
                       ap=_PMF.format(m="mu", k="j.j"))


def _cell_test(key: str) -> str | None:
    fixed = {
        "1x2_home": "i > j", "1x2_draw": "i = j", "1x2_away": "i < j",
        "dc_1x": "i >= j", "dc_12": "i <> j", "dc_x2": "i <= j",
        "btts_yes": "i > 0 AND j > 0", "btts_no": "i = 0 OR j = 0",
        "hcp_home-1.5": "i - j >= 2", "hcp_home+1.5": "i - j >= -1",
        "hcp_away-1.5": "j - i >= 2", "hcp_away+1.5": "j - i >= -1",
    }
    if key in fixed:
        return fixed[key]
    head, *rest = key.split("_")
    sign = ">" if rest[-1] == "over" else "<"
    if head.startswith("ou"):
        return f"i + j {sign} {head[2:]}"
    if head.startswith("tt"):
        return f"{'i' if rest[0] == 'home' else 'j'} {sign} {head[2:]}"
    return None


GOAL = [s for s in CATALOGUE if s.group != "corners"]
CORNER = [s for s in CATALOGUE if s.group == "corners"]


def alias(key: str) -> str:
    return '"' + key + '"'


def goal_probs(src: str) -> str:
    """One row per match with a column per goals selection, from the grid."""
    parts = []
    for s in GOAL:
        test = _cell_test(s.key)
        if test:
            parts.append(f"round(sum(CASE WHEN {test} THEN c ELSE 0 END) / sum(c), 12) AS {alias(s.key)}")
    for side, test in (("home", "i > j"), ("away", "i < j")):
        parts.append(f"round(sum(CASE WHEN {test} THEN c ELSE 0 END) / greatest(sum(CASE WHEN i <> j THEN c ELSE 0 END), 1e-12), 12) AS dnb_{side}")
    return f"SELECT match_id, {', '.join(parts)} FROM ({grid(src)}) GROUP BY match_id"


cte("x_goal_probs", "--m\n" + goal_probs("x_fused"))

_C = """list_transform(range(26), lambda k: exp(-{m} + k * ln({m}) - lgamma(k + 1)))"""
cte("x_corner_probs", f"""--m
SELECT match_id, {', '.join(
    f"round(list_sum(list_transform(range({int(float(s.key[7:].split('_')[0])) + 1}), lambda i: hp[i + 1] * list_sum(ap[1:{int(float(s.key[7:].split('_')[0]))} - i + 1]))) / (list_sum(hp) * list_sum(ap)), 12) AS {alias(s.key)}"
    for s in CORNER if s.key.endswith('under'))}
FROM (SELECT match_id, {_C.format(m='corner_lam')} AS hp, {_C.format(m='corner_mu')} AS ap
      FROM x_params WHERE corner_lam IS NOT NULL)
""")


def settled_sql(key: str) -> str:
    fixed = {
        "1x2_home": "home_goals > away_goals", "1x2_draw": "home_goals = away_goals",
        "1x2_away": "home_goals < away_goals", "dc_1x": "home_goals >= away_goals",
        "dc_12": "home_goals <> away_goals", "dc_x2": "home_goals <= away_goals",
        "btts_yes": "home_goals > 0 AND away_goals > 0",
        "btts_no": "home_goals = 0 OR away_goals = 0",
        "hcp_home-1.5": "home_goals - away_goals >= 2",
        "hcp_home+1.5": "home_goals - away_goals >= -1",
        "hcp_away-1.5": "home_goals - away_goals <= -2",
        "hcp_away+1.5": "home_goals - away_goals <= 1",
        "dnb_home": "CASE WHEN home_goals <> away_goals THEN home_goals > away_goals END",
        "dnb_away": "CASE WHEN home_goals <> away_goals THEN home_goals < away_goals END",
    }
    if key in fixed:
        return fixed[key]
    head, *rest = key.split("_")
    sign = ">" if rest[-1] == "over" else "<"
    if head.startswith("ou"):
        return f"home_goals + away_goals {sign} {head[2:]}"
    if head.startswith("tt"):
        return f"{rest[0]}_goals {sign} {head[2:]}"
    return f"total_corners {sign} {head[7:]}"


def selection_rows(kind: str) -> str:
    """The selections of a match as a list, from its row of probabilities and its goals."""
    rows = []
    for s in (GOAL if kind == "goals" else CORNER):
        prob = alias(s.key)
        if kind == "corners" and s.key.endswith("over"):
            prob = f"1 - {alias(s.key.replace('_over', '_under'))}"
        rows.append(f"{{'key': '{s.key}', 'group': '{s.group}', 'prob': {prob}, 'result': ({settled_sql(s.key)})}}")
    return f"[{', '.join(rows)}]"


def _long(kind: str) -> str:
    table = "x_goal_probs" if kind == "goals" else "x_corner_probs"
    return (f"SELECT match_id, date, competition, unnest({selection_rows(kind)}) AS s "
            f"FROM {table} JOIN x_params USING (match_id)")


# Graded selections, long: void and ungradable results are null.
cte("x_sel", f"""--m
SELECT match_id, date, competition, s.key AS key, s."group" AS "group", s.prob AS prob, s.result AS result
FROM ({_long('goals')} UNION ALL {_long('corners')})
""")

cte("x_flat", """
SELECT match_id, date, competition, key, "group", prob, CASE WHEN result THEN 1 ELSE 0 END AS y
FROM x_sel WHERE result IS NOT NULL AND prob IS NOT NULL
""")

"""Queries: layouts, readers, names, dedup, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.functions import dates, names, prices
from fairline.operators import matching, quality
from fairline.plans import leagues, sql_tables  # noqa: F401
from fairline.plans.registry import cte, query
from fairline.session import stage
from fairline.sources import layouts, readers, sinks, warehouse as w

NOW = f"TIMESTAMP '{w.CARD_NOW}'"


def _mark(salt: str):
    return F.substring(F.md5(F.concat("match_id", F.lit(f"|{salt}"))), 1, 1)


def _sql_mark(salt: str) -> str:
    return f"substr(md5(match_id || '|{salt}'), 1, 1)"


def r6(c, name=None):
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or c)


@query("match_table", "S9 S12 S14", """
SELECT match_id, date, competition, season, home, away, home_goals, away_goals, total_corners,
  home_sot, away_sot, home_odds, draw_odds, away_odds, home_odds_cons, draw_odds_cons,
  away_odds_cons, over25_odds, under25_odds, over25_odds_cons, under25_odds_cons FROM x_matches
""")
def match_table(spark, sf):
    return w.matches(spark, sf).drop("home_corners", "away_corners")


def _team_text(side):
    return F.concat(F.lit("FC "), F.initcap(side), F.lit(" & Co "))


def main_layout_rows(spark, sf, family=("MaxC", "AvgC"), totals=("MaxC", "AvgC")):
    """The match table written back as a season file: text columns, with some broken rows."""
    m, k = w.matches(spark, sf), _mark("r")
    best, cons = family
    columns = {
        "Div": F.col("competition"), "Season": F.col("season").cast("string"),
        "Date": F.when(k == "1", F.date_format("date", "dd/MM/yy")).when(
            k == "2", F.lit("postponed")).otherwise(F.date_format("date", "dd/MM/yyyy")),
        "HomeTeam": _team_text("home"), "AwayTeam": _team_text("away"),
        "FTHG": F.when(k == "3", F.lit("abd")).otherwise(F.col("home_goals").cast("string")),
        "FTAG": F.col("away_goals").cast("string"),
        "HST": F.col("home_sot").cast("string"), "AST": F.col("away_sot").cast("string"),
        "HC": F.col("home_corners").cast("string"), "AC": F.col("away_corners").cast("string"),
    }
    for side, letter in (("home", "H"), ("draw", "D"), ("away", "A")):
        columns[f"{best}{letter}"] = F.col(f"{side}_odds").cast("string")
        columns[f"{cons}{letter}"] = F.col(f"{side}_odds_cons").cast("string")
    if totals:
        for side, sign in (("over25", ">"), ("under25", "<")):
            columns[f"{totals[0]}{sign}2.5"] = F.col(f"{side}_odds").cast("string")
            columns[f"{totals[1]}{sign}2.5"] = F.col(f"{side}_odds_cons").cast("string")
    return m.select("match_id", *[v.alias(c) for c, v in columns.items()])


_MAIN_SQL = f"""
SELECT date, competition, CAST(season AS VARCHAR) AS season, 'team ' || substr(home, 6) || ' and co' AS home_key,
  'team ' || substr(away, 6) || ' and co' AS away_key, home_goals, away_goals, home_odds, draw_odds, away_odds,
  home_odds_cons, draw_odds_cons, away_odds_cons, CAST(home_sot AS DOUBLE) AS home_sot,
  CAST(away_corners AS DOUBLE) AS away_corners,
  over25_odds, under25_odds, over25_odds_cons, under25_odds_cons, 'closing' AS price_kind, 'closing' AS totals_kind
FROM x_matches WHERE {_sql_mark('r')} NOT IN ('2', '3')
  AND home_odds IS NOT NULL AND draw_odds IS NOT NULL AND away_odds IS NOT NULL
  AND home_odds_cons IS NOT NULL AND draw_odds_cons IS NOT NULL AND away_odds_cons IS NOT NULL
"""


@query("results_main_layout", "S1 S2 S3", _MAIN_SQL)
def results_main_layout(spark, sf):
    out = layouts.parse_main(main_layout_rows(spark, sf), F.col("Div"), F.col("Season"))
    return out.drop("home_team", "away_team", "home_shots", "away_shots", "away_sot",
                    "home_corners")


_LEAGUES = {0: "Série A", 1: "Liga Profesional", 2: "", 3: "2. Division"}


@query("results_extra_layout", "S4 S5", f"""
SELECT date, CASE season % 4 WHEN 0 THEN 'BRA-SERIEA' WHEN 1 THEN 'BRA-LIGAPROF' WHEN 2 THEN 'BRA-MAIN' ELSE 'BRA-2DIVISIO' END AS competition,
  CAST(season AS VARCHAR) AS season, 'Brazil' AS country, home AS home_key, away AS away_key, home_goals, away_goals,
  home_odds, draw_odds, away_odds, home_odds_cons, draw_odds_cons, away_odds_cons, 'closing' AS price_kind
FROM x_matches WHERE home_odds IS NOT NULL AND draw_odds IS NOT NULL AND away_odds IS NOT NULL
  AND home_odds_cons IS NOT NULL AND draw_odds_cons IS NOT NULL AND away_odds_cons IS NOT NULL
""")
def results_extra_layout(spark, sf):
    m = w.matches(spark, sf)
    league = F.element_at(F.array(*[F.lit(v) for v in _LEAGUES.values()]),
                          (F.col("season") % 4 + 1).cast("int"))
    raw = m.select(
        F.lit("Brazil").alias("Country"), league.alias("League"),
        F.col("season").cast("string").alias("Season"),
        F.date_format("date", "dd/MM/yyyy").alias("Date"), F.col("home").alias("Home"),
        F.col("away").alias("Away"), F.col("home_goals").cast("string").alias("HG"),
        F.col("away_goals").cast("string").alias("AG"),
        *[F.col(f"{s}_odds").cast("string").alias(f"MaxC{x}")
          for s, x in (("home", "H"), ("draw", "D"), ("away", "A"))],
        *[F.col(f"{s}_odds_cons").cast("string").alias(f"AvgC{x}")
          for s, x in (("home", "H"), ("draw", "D"), ("away", "A"))])
    return layouts.parse_extra(raw, "BRA").drop("home_team", "away_team")


@query("union_of_layouts", "U1 S6", f"""
SELECT price_kind, count(*) AS n, count(over25_odds) AS with_totals, count(country) AS with_country,
  CAST((SELECT count(*) FROM x_layout_kinds) AS BIGINT) AS kinds
FROM (
 SELECT 'closing' AS price_kind, over25_odds, NULL AS country FROM x_main_rows WHERE season >= 1999
 UNION ALL SELECT 'pre-close', NULL, NULL FROM x_main_rows WHERE season BETWEEN 1997 AND 1998
 UNION ALL SELECT 'closing', NULL, 'Brazil' FROM x_extra_rows WHERE season < 1997)
GROUP BY price_kind
""")
def union_of_layouts(spark, sf):
    closing = layouts.parse_main(main_layout_rows(spark, sf).filter("Season >= '1999'"),
                                 F.col("Div"), F.col("Season"))
    earlier = layouts.parse_main(
        main_layout_rows(spark, sf, ("Max", "Avg"), None).filter(
            "Season BETWEEN '1997' AND '1998'"), F.col("Div"), F.col("Season"))
    extra = results_extra_layout(spark, sf).filter("season < '1997'")
    both = readers.union_layouts([closing, earlier, extra])
    kinds = layouts.price_kinds(both).select("kinds")
    return both.groupBy("price_kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("over25_odds").alias("with_totals"),
        F.count("country").alias("with_country")).crossJoin(F.broadcast(kinds))


cte("x_main_rows", f"""
SELECT * FROM x_matches WHERE {_sql_mark('r')} NOT IN ('2', '3')
  AND home_odds IS NOT NULL AND draw_odds IS NOT NULL AND away_odds IS NOT NULL
  AND home_odds_cons IS NOT NULL AND draw_odds_cons IS NOT NULL AND away_odds_cons IS NOT NULL
""")
cte("x_extra_rows", """
SELECT * FROM x_matches WHERE home_odds IS NOT NULL AND draw_odds IS NOT NULL AND away_odds IS NOT NULL
  AND home_odds_cons IS NOT NULL AND draw_odds_cons IS NOT NULL AND away_odds_cons IS NOT NULL
""")
cte("x_layout_kinds", """
SELECT 'closing' AS k WHERE EXISTS (SELECT 1 FROM x_main_rows WHERE season >= 1999) OR EXISTS (SELECT 1 FROM x_extra_rows WHERE season < 1997)
UNION ALL SELECT 'pre-close' WHERE EXISTS (SELECT 1 FROM x_main_rows WHERE season BETWEEN 1997 AND 1998)
""")


@query("results_json", "S7", f"""
SELECT date, competition, CAST(season AS VARCHAR) AS season, home AS home_team, away AS away_team,
  home_goals, away_goals, CASE WHEN {_sql_mark('j')} <> '1' THEN home_goals // 2 END AS ht_home_goals
FROM x_matches WHERE {_sql_mark('j')} <> '0'
""")
def results_json(spark, sf):
    m, k = w.matches(spark, sf), _mark("j")
    played = k != "0"
    half = F.when(k != "1", F.struct((F.floor(F.col("home_goals") / 2)).cast("int").alias("home"),
                                     F.lit(0).alias("away")))
    match = F.struct(
        F.concat(F.col("date").cast("string"), F.lit("T15:00:00Z")).alias("utcDate"),
        F.lit(1).alias("matchday"),
        F.struct(F.concat(F.col("season").cast("string"), F.lit("-08-01")).alias("startDate"))
        .alias("season"),
        F.struct(F.col("home").alias("name")).alias("homeTeam"),
        F.struct(F.col("away").alias("name")).alias("awayTeam"),
        F.struct(F.struct(F.when(played, F.col("home_goals")).alias("home"),
                          F.when(played, F.col("away_goals")).alias("away")).alias("fullTime"),
                 half.alias("halfTime")).alias("score"))
    text = m.select("competition", F.to_json(F.struct(F.array(match).alias("matches")))
                    .alias("body"))
    payload = text.select("competition", F.from_json("body", layouts.RESULTS_JSON).alias("p")
                          ).select("competition", "p.matches")
    return layouts.parse_results_json(payload, F.col("competition")).drop(
        "matchday", "ht_away_goals")


cte("x_book_quotes", """
SELECT match_id, competition, date, home, away, b.b AS book,
  round(home_odds * (CAST(0.9613 AS DOUBLE) + CAST(0.02017 AS DOUBLE) * CAST(b.b AS DOUBLE)), 2) AS hp,
  round(draw_odds * (CAST(0.9613 AS DOUBLE) + CAST(0.02017 AS DOUBLE) * CAST(b.b AS DOUBLE)), 2) AS dp,
  round(away_odds * (CAST(0.9613 AS DOUBLE) + CAST(0.02017 AS DOUBLE) * CAST(b.b AS DOUBLE)), 2) AS ap,
  round(over25_odds * (CAST(0.9613 AS DOUBLE) + CAST(0.02017 AS DOUBLE) * CAST(b.b AS DOUBLE)), 2) AS op,
  round(under25_odds * (CAST(0.9613 AS DOUBLE) + CAST(0.02017 AS DOUBLE) * CAST(b.b AS DOUBLE)), 2) AS up
FROM x_matches CROSS JOIN (SELECT unnest(range(5)) AS b) b
""")
_MED = "quantile_cont({c}, 0.5)"


@query("quotes_from_events", "S8 A1 A2 A3 J10", f"""
SELECT match_id AS id, date, competition, home AS home_key, max(hp) AS home_odds, max(dp) AS draw_odds, max(ap) AS away_odds,
  round({_MED.format(c='hp')}, 6) AS home_odds_cons, round({_MED.format(c='dp')}, 6) AS draw_odds_cons,
  round({_MED.format(c='ap')}, 6) AS away_odds_cons, CAST(5 AS INTEGER) AS n_bookmakers,
  round(1 / max(hp) + 1 / max(dp) + 1 / max(ap), 4) AS overround,
  CASE WHEN max(op) IS NOT NULL AND max(up) IS NOT NULL THEN max(CASE WHEN book % 2 = 0 THEN op END) END AS over25_odds,
  CASE WHEN max(op) IS NOT NULL AND max(up) IS NOT NULL THEN round(quantile_cont(CASE WHEN book % 2 = 0 THEN up END, 0.5), 6) END AS under25_odds_cons
FROM x_book_quotes GROUP BY match_id, date, competition, home
HAVING max(hp) IS NOT NULL AND max(dp) IS NOT NULL AND max(ap) IS NOT NULL
""")
def quotes_from_events(spark, sf):
    events = w.book_prices(spark, sf)
    text = events.select(F.to_json(F.struct("*")).alias("body"))
    read = text.select(F.inline(F.array(F.from_json("body", layouts.EVENT_JSON))))
    code = w.matches(spark, sf).select(F.col("competition").alias("sport"),
                                       "competition").distinct()
    q = layouts.quotes_from_events(read, F.lit("2001-08-01T09:00:00Z"), code, lines=(2.5,))
    return q.select("id", "date", "competition", "home_key", "home_odds", "draw_odds",
                    "away_odds", r6("home_odds_cons"), r6("draw_odds_cons"),
                    r6("away_odds_cons"), "n_bookmakers", "overround", "over25_odds",
                    r6("under25_odds_cons"))


@query("alternate_lines", "J16", """
SELECT q.competition, q.home AS home_team, q.away AS away_team, q.home_odds, e.over35_odds, e.under35_odds_cons
FROM x_current q LEFT JOIN (
  SELECT home, away, over35_odds, under35_odds_cons FROM (
    SELECT match_id, date, home, away, max(CASE WHEN book % 2 = 1 THEN op END) AS over35_odds,
      round(quantile_cont(CASE WHEN book % 2 = 1 THEN up END, 0.5), 6) AS under35_odds_cons
    FROM x_book_quotes GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY home, away ORDER BY date DESC, match_id) = 1) e
ON q.home = e.home AND q.away = e.away
""")
def alternate_lines(spark, sf):
    from fairline.operators.ordering import best_per_key

    current = upcoming_fixtures(spark, sf).select(
        "competition", F.col("home").alias("home_team"), F.col("away").alias("away_team"),
        "home_odds")
    extra = layouts.consensus_prices(w.book_prices(spark, sf), (3.5,))
    extra = best_per_key(extra, ["home_team", "away_team"],
                         [F.desc(F.substring("commence_time", 1, 10)), F.col("id")])
    out = layouts.merge_alternate_lines(current, extra, (3.5,))
    return out.select("competition", "home_team", "away_team", "home_odds", "over35_odds",
                      r6("under35_odds_cons"))


cte("x_current", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY competition, home, away ORDER BY fetched_at DESC, match_id) AS rn
  FROM x_quotes WHERE coalesce(commence_time, CAST(date + 1 AS TIMESTAMP)) > {NOW}) WHERE rn = 1
""")


@query("upcoming_fixtures", "S10 W4 P5", """
SELECT match_id, date, competition, home, away, days_ahead, home_odds, draw_odds, away_odds, fetched_at FROM x_current
""")
def upcoming_fixtures(spark, sf):
    q = readers.fixtures(w.quotes(spark, sf), F.expr(NOW), tiebreak=("match_id",))
    return q.select("match_id", "date", "competition", "home", "away", "days_ahead", "home_odds",
                    "draw_odds", "away_odds", "fetched_at")


@query("history_reader", "S9 P1", f"""
SELECT match_id, date, home, away, home_goals, away_goals, home_goals + away_goals AS total_goals,
  CAST(total_corners AS DOUBLE) AS total_corners FROM x_matches WHERE {_sql_mark('h')} <> '0'
""")
def history_reader(spark, sf):
    m, k = w.matches(spark, sf), _mark("h")
    raw = m.select(
        "match_id", "competition", "season",
        F.when(k < "8", F.col("date").cast("string")).otherwise(
            F.concat(F.col("date").cast("string"), F.lit(" 00:00:00"))).alias("date"),
        F.concat(F.lit("AFC "), F.initcap("home")).alias("home_team"),
        F.concat(F.initcap("away"), F.lit(" F&C").substr(1, 0), F.lit(" FC")).alias("away_team"),
        F.when(k != "0", F.col("home_goals").cast("string")).alias("home_goals"),
        F.col("away_goals").cast("string").alias("away_goals"),
        "home_corners", "away_corners")
    h = readers.history(raw)
    return h.select("match_id", "date", "home", "away", "home_goals", "away_goals",
                    "total_goals", "total_corners")


@query("date_spellings", "P1", f"""
SELECT CAST(sum(CASE WHEN {_sql_mark('d')} = '0' THEN 1 ELSE 0 END) AS BIGINT) AS bad_rows,
  min(CASE WHEN {_sql_mark('d')} = '0' THEN strftime(date, '%d/%m/%Y') END) AS first_bad,
  max(CASE WHEN {_sql_mark('d')} = '0' THEN strftime(date, '%d/%m/%Y') END) AS last_bad FROM x_matches
""")
def date_spellings(spark, sf):
    m, k = w.matches(spark, sf), _mark("d")
    raw = m.select(F.when(k == "0", F.date_format("date", "dd/MM/yyyy")).otherwise(
        F.col("date").cast("string")).alias("text"))
    return quality.date_problems(raw, "text", dates.iso_day(F.col("text")))


@query("backtest_dataset", "S11 P2", """
SELECT competition, count(*) AS n, CAST(sum(home_goals) AS BIGINT) AS home_goals, round(avg(home_odds_cons), 6) AS mean_cons
FROM x_backtest GROUP BY competition
""")
def backtest_dataset(spark, sf):
    d = readers.backtest_dataset(w.matches(spark, sf).withColumnsRenamed(
        {"home": "home_team", "away": "away_team"}))
    return d.groupBy("competition").agg(
        F.count(F.lit(1)).alias("n"), F.sum("home_goals").alias("home_goals"),
        F.round(F.avg("home_odds_cons"), 6).alias("mean_cons"))


cte("x_backtest", """--m
SELECT * FROM x_matches WHERE home_odds IS NOT NULL AND draw_odds IS NOT NULL AND away_odds IS NOT NULL
  AND coalesce(home_odds_cons, 0) > 1 AND coalesce(draw_odds_cons, 0) > 1 AND coalesce(away_odds_cons, 0) > 1
""")


@query("dataset_profile", "S13 A31", """
SELECT count(*) AS matches, count(DISTINCT competition) AS competitions, min(date) AS first, max(date) AS last FROM x_matches
""")
def dataset_profile(spark, sf):
    return readers.profile(w.matches(spark, sf))


@query("dataset_coverage", "S13", """
SELECT competition, count(*) AS matches, min(date) AS first, max(date) AS last FROM x_matches GROUP BY competition
""")
def dataset_coverage(spark, sf):
    return readers.coverage(w.matches(spark, sf))


@query("quote_freshness", "A32", f"""
SELECT max(fetched_at) AS newest, round((epoch_us({NOW}) - epoch_us(max(fetched_at))) / 86400e6, 6) AS age_days FROM x_quotes
""")
def quote_freshness(spark, sf):
    q = w.quotes(spark, sf).withColumn("fetched_at", F.when(
        _mark("q") == "0", F.lit("not a time")).otherwise(F.col("fetched_at").cast("string")))
    # The unreadable stamps are ignored; the readable ones still hold the newest snapshot.
    whole = w.quotes(spark, sf).select(F.col("fetched_at").cast("string"))
    out = readers.quote_age_days(q.select("fetched_at").unionByName(whole), F.expr(NOW))
    return out.select("newest", F.round("age_days", 6).alias("age_days"))


@query("dedup_results", "U2", """
SELECT match_id, date, home, away, competition FROM x_matches
QUALIFY row_number() OVER (PARTITION BY date, home, away ORDER BY competition, match_id) = 1
""")
def dedup_results(spark, sf):
    m = w.matches(spark, sf).withColumns({"home_key": F.col("home"), "away_key": F.col("away")})
    return readers.first_of_each_result(m, "competition", "match_id").select(
        "match_id", "date", "home", "away", "competition")


@query("append_snapshots", "U3", """
SELECT fetched_at, home AS home_team, away AS away_team, min(home_odds) AS home_odds, bool_or(days_ahead > 1) AS stored
FROM (SELECT fetched_at, home, away, CASE WHEN days_ahead > 1 THEN home_odds END AS s, home_odds, days_ahead,
   bool_or(days_ahead > 1) OVER (PARTITION BY fetched_at, home, away) AS has_stored FROM x_quotes WHERE home_odds IS NOT NULL)
WHERE NOT has_stored OR days_ahead > 1 GROUP BY ALL
""")
def append_snapshots(spark, sf):
    q = w.quotes(spark, sf).filter("home_odds IS NOT NULL").select(
        "fetched_at", F.col("home").alias("home_team"), F.col("away").alias("away_team"),
        "home_odds", (F.col("days_ahead") > 1).alias("stored"))
    return readers.append_snapshots(q.filter("stored"), q.filter("NOT stored"))


_TEAM_KEYS = f"""
SELECT DISTINCT raw, coalesce(a.v, k) AS key FROM (
  SELECT raw, regexp_replace(regexp_replace(t, '^((fc|afc|sc|real club|ud|club) )+([a-z0-9])', '\\3'), '([a-z0-9])( (fc|afc|sc|ud|cf))+$', '\\1') AS k
  FROM (SELECT raw, trim(regexp_replace(replace(strip_accents(lower(raw)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS t FROM x_raw_names))
LEFT JOIN (VALUES ('spurs', 'tottenham hotspur'), ('koln', 'fc koln')) a(n, v) ON a.n = k
"""


@query("team_keys", "F1 U4", _TEAM_KEYS)
def team_keys(spark, sf):
    raw = raw_names(spark, sf)
    return raw.select("raw", names.normalize(F.col("raw")).alias("key")).distinct()


@query("canonical_teams", "F2 F1", f"SELECT raw, key AS home_team, key AS away_team FROM ({_TEAM_KEYS})")
def canonical_teams(spark, sf):
    """Both team columns of a table put under their keys; a column that isn't there is passed over."""
    raw = raw_names(spark, sf).withColumns({"home_team": F.col("raw"), "away_team": F.col("raw")})
    return names.canonicalize(raw, ("home_team", "away_team", "venue")).select("raw", "home_team", "away_team").distinct()


@query("history_before", "P4", """
SELECT competition, count(*) AS known, max(date) AS last FROM x_matches WHERE date < DATE '1998-06-01' + CAST(substr(competition, 2) AS INTEGER) GROUP BY competition
""")
def history_before(spark, sf):
    """What each competition knew at its own cut: strictly earlier days only."""
    cut = F.date_add(F.lit("1998-06-01").cast("date"), F.substring("competition", 2, 2).cast("int"))
    known = w.matches(spark, sf).filter(dates.before(F.col("date"), cut))
    return known.groupBy("competition").agg(F.count(F.lit(1)).alias("known"), F.max("date").alias("last"))


cte("x_raw_names", """
SELECT CASE p_partkey % 6 WHEN 0 THEN 'FC ' || upper(p_name) WHEN 1 THEN 'AFC ' || replace(p_name, 'e', 'é') || ' F.C.'
  WHEN 2 THEN p_name || ' & ' || p_type || ' UD' WHEN 3 THEN CASE WHEN p_size > 25 THEN 'Spurs' ELSE '1 Köln' END
  WHEN 4 THEN replace(p_name, 'o', 'ö') || ' AFC FC' ELSE '  ' || p_brand || '--' || p_name END AS raw FROM part
""")


def raw_names(spark, sf):
    """Club-like spellings made from the part table's own names."""
    p = w.read(spark, sf, "part")
    n, c = F.col("p_name"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v
                                                  for v in x])
    k = F.col("p_partkey") % 6
    return p.select(F.when(k == 0, c("FC ", F.upper(n)))
                    .when(k == 1, c("AFC ", F.replace(n, F.lit("e"), F.lit("é")), " F.C."))
                    .when(k == 2, c(n, " & ", F.col("p_type"), " UD"))
                    .when(k == 3, F.when(F.col("p_size") > 25, F.lit("Spurs"))
                          .otherwise(F.lit("1 Köln")))
                    .when(k == 4, c(F.replace(n, F.lit("o"), F.lit("ö")), " AFC FC"))
                    .otherwise(c("  ", F.col("p_brand"), "--", n)).alias("raw"))


def feed_names(spark, sf):
    """Feed-side spellings of the teams, per competition: exact, longer, shorter, ambiguous."""
    m = w.matches(spark, sf)
    number = F.substring("home", 6, 2).cast("int")
    text = (F.when(number % 4 == 0, F.concat(F.lit("FC Téam "), number.cast("string")))
            .when(number % 4 == 1, F.concat(F.lit("team "), number.cast("string"), F.lit(" town")))
            .when(number % 4 == 2, number.cast("string")).otherwise(F.lit("Team")))
    return m.select("competition", text.alias("raw"), "home")


@query("resolve_names", "J4", """
SELECT competition, key, CASE WHEN exact THEN key WHEN ns = 1 THEN s WHEN nl = 1 THEN l END AS resolved,
  CASE WHEN exact THEN 'exact' WHEN ns = 1 THEN 'shorter' WHEN nl = 1 THEN 'longer' ELSE 'none' END AS rule
FROM (SELECT f.competition, f.key, bool_or(c.cand = f.key) AS exact,
   count(DISTINCT CASE WHEN len(list_filter(c.w, lambda x: NOT list_contains(f.w, x))) = 0 AND len(c.w) < len(f.w) THEN c.cand END) AS ns,
   min(CASE WHEN len(list_filter(c.w, lambda x: NOT list_contains(f.w, x))) = 0 AND len(c.w) < len(f.w) THEN c.cand END) AS s,
   count(DISTINCT CASE WHEN len(list_filter(f.w, lambda x: NOT list_contains(c.w, x))) = 0 AND len(c.w) > len(f.w) THEN c.cand END) AS nl,
   min(CASE WHEN len(list_filter(f.w, lambda x: NOT list_contains(c.w, x))) = 0 AND len(c.w) > len(f.w) THEN c.cand END) AS l
 FROM (SELECT DISTINCT competition, key, string_split(key, ' ') AS w FROM (
     SELECT competition, CASE n % 4 WHEN 0 THEN 'team ' || n WHEN 1 THEN 'team ' || n || ' town' WHEN 2 THEN CAST(n AS VARCHAR) ELSE 'team' END AS key
     FROM (SELECT competition, CAST(substr(home, 6, 2) AS INT) AS n FROM x_matches))) f
 JOIN (SELECT DISTINCT competition, cand, string_split(cand, ' ') AS w FROM (
     SELECT competition, home AS cand FROM x_matches UNION ALL SELECT competition, away FROM x_matches)) c
 ON f.competition = c.competition GROUP BY f.competition, f.key)
""")
def resolve_names(spark, sf):
    m = w.matches(spark, sf)
    feed = feed_names(spark, sf).select("competition",
                                        names.normalize(F.col("raw")).alias("key"))
    teams = m.select("competition", F.col("home").alias("candidate")).unionByName(
        m.select("competition", F.col("away").alias("candidate")))
    return matching.resolve_names(feed, teams)


cte("x_part_names", """
SELECT p_partkey, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key
FROM (SELECT p_partkey, p_name || ' ' || lower(p_brand) AS name FROM part)
""")
cte("x_misspelt", """
SELECT DISTINCT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key FROM (
  SELECT CASE p_partkey % 4 WHEN 0 THEN upper(name) WHEN 1 THEN replace(name, 'd', 't') WHEN 2 THEN reverse(name) ELSE substr(name, 2) END AS name FROM x_part_names)
""")

#: The longest common string of x and y as 1000 * length - first place in x.
_LONGEST = """list_max(flatten(list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(x) - i + 2), lambda k:
  CASE WHEN contains(y, substr(x, CAST(i AS INTEGER), CAST(k AS INTEGER))) THEN k * 1000 - i ELSE 0 END))))"""


@query("map_names", "J5", f"""
WITH RECURSIVE targets AS (SELECT key, min(name) AS target FROM x_part_names GROUP BY key),
close AS (SELECT DISTINCT s.key AS a, t.key AS b FROM x_misspelt s JOIN targets t ON levenshtein(s.key, t.key) <= 0.13 * (len(s.key) + len(t.key)) + 1e-9
  WHERE s.key NOT IN (SELECT key FROM targets)),
blocks AS (SELECT a, b, a AS x, b AS y FROM close
  UNION ALL SELECT a, b, CASE side WHEN 0 THEN substr(x, 1, i - 1) ELSE substr(x, i + k) END, CASE side WHEN 0 THEN substr(y, 1, j - 1) ELSE substr(y, j + k) END
  FROM (SELECT *, instr(y, substr(x, i, k)) AS j FROM (SELECT *, CAST(ceil(found / 1000) AS INTEGER) AS k, CAST(ceil(found / 1000) * 1000 - found AS INTEGER) AS i
    FROM (SELECT *, {_LONGEST} AS found FROM blocks) WHERE found > 0)) CROSS JOIN (VALUES (0), (1)) sides(side)),
ratios AS (SELECT a, b, 2.0 * sum(k) / (len(a) + len(b)) AS ratio
  FROM (SELECT a, b, coalesce(CAST(ceil({_LONGEST} / 1000) AS INTEGER), 0) AS k FROM blocks) GROUP BY a, b),
best AS (SELECT a, b, ratio FROM ratios WHERE ratio >= 0.87 QUALIFY row_number() OVER (PARTITION BY a ORDER BY ratio DESC, b) = 1)
SELECT s.name, coalesce(e.target, t.target) AS target, CASE WHEN e.target IS NULL THEN round(best.ratio, 3) END AS score,
  CASE WHEN e.target IS NOT NULL THEN 'exact' WHEN t.target IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS status
FROM x_misspelt s LEFT JOIN targets e ON e.key = s.key LEFT JOIN best ON best.a = s.key LEFT JOIN targets t ON t.key = best.b
""")
def map_names(spark, sf):
    """Spellings with a letter changed or dropped, mapped back by similarity."""
    p = w.read(spark, sf, "part").select("p_partkey", F.concat_ws(
        " ", "p_name", F.lower("p_brand")).alias("name"))
    target = p.select("name", names.normalize(F.col("name"), {}).alias("key"))
    k = F.col("p_partkey") % 4
    source = p.select(F.when(k == 0, F.upper("name")).when(
        k == 1, F.replace("name", F.lit("d"), F.lit("t"))).when(
        k == 2, F.reverse("name")).otherwise(F.substring(F.col("name"), F.lit(2), F.length("name")))
        .alias("name"))
    source = source.select("name", names.normalize(F.col("name"), {}).alias("key"))
    return matching.map_names(source, target)


@query("season_windows", "P14 P15", """
SELECT date, season AS start_year, lpad(CAST(season % 100 AS VARCHAR), 2, '0') || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS code,
  season - 5 AS first_year, CAST(6 AS INTEGER) AS years FROM (SELECT DISTINCT date, CAST(season AS INTEGER) AS season FROM x_matches)
""")
def season_windows(spark, sf):
    d = w.matches(spark, sf).select("date").distinct()
    window = dates.season_window(F.col("date"))
    start = dates.season_start(F.col("date"))
    return d.select("date", start.alias("start_year"), dates.season_code(start).alias("code"),
                    F.array_min(window).alias("first_year"), F.size(window).alias("years"))


def _feed_tables(spark, sf):
    n = w.read(spark, sf, "nation")
    code = F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    catalogue = n.filter("n_regionkey <> 4").select(
        code.alias("code"), F.concat(F.lit("soccer_"), F.lower("n_name")).alias("sport"))
    live = n.filter("n_regionkey <> 2").select(
        F.concat(F.lit("soccer_"), F.lower("n_name")).alias("sport"))
    quoted = w.quotes(spark, sf).filter(F.col("home_odds") > 5.5).select(
        F.col("competition").alias("code")).distinct()
    return catalogue, live, quoted.join(catalogue, "code").select("sport")


cte("x_feed", """
SELECT 'C' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, 'soccer_' || lower(n_name) AS sport,
  n_regionkey <> 4 AS mapped, n_regionkey <> 2 AS live FROM nation
""")


@query("feed_coverage", "J9 U5", """
SELECT CASE WHEN mapped THEN code END AS code, sport,
  CASE WHEN NOT mapped THEN 'unknown' WHEN live THEN 'plan' ELSE 'missing' END AS status,
  mapped AND live AND code IN (SELECT competition FROM x_quotes WHERE home_odds > 5.5) AS tracked
FROM x_feed WHERE (mapped AND code IN (SELECT competition FROM x_matches)) OR (NOT mapped AND live)
""")
def feed_coverage(spark, sf):
    catalogue, live, tracked = _feed_tables(spark, sf)
    return leagues.feed_coverage(catalogue, w.matches(spark, sf), live, tracked)


@query("feed_plan_cost", "J9 S20", """
SELECT count(*) AS available, count(*) FILTER (WHERE code NOT IN (SELECT competition FROM x_quotes WHERE home_odds > 5.5)) AS new, count(*) * 4 AS estimated_credits
FROM x_feed WHERE mapped AND live AND code IN (SELECT competition FROM x_matches)
""")
def feed_plan_cost(spark, sf):
    return leagues.coverage_cost(feed_coverage(spark, sf))


@query("feed_plan_fallback", "S20", """
SELECT sport FROM x_feed WHERE mapped AND code IN (SELECT competition FROM x_quotes WHERE home_odds > 5.5)
""")
def feed_plan_fallback(spark, sf):
    catalogue, live, tracked = _feed_tables(spark, sf)
    none = feed_coverage(spark, sf).filter("status = 'plan' AND code = 'none'")
    return leagues.feed_plan(none, tracked)


@query("competition_labels", "F13", """
SELECT code, CASE WHEN name IS NULL THEN code WHEN count(*) OVER (PARTITION BY coalesce(name, code)) > 1 THEN name || ' (' || country || ')' ELSE name END AS label
FROM (SELECT DISTINCT competition AS code FROM x_matches) LEFT JOIN (
  SELECT 'C' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, CASE WHEN n_regionkey = 1 THEN 'League ' || n_nationkey ELSE r_name || ' League' END AS name, n_name AS country
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24) USING (code)
""")
def competition_labels(spark, sf):
    n = w.read(spark, sf, "nation").join(w.read(spark, sf, "region"),
                                         F.col("n_regionkey") == F.col("r_regionkey"))
    catalogue = n.filter("n_nationkey <> 24").select(
        F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"),
        F.when(F.col("n_regionkey") == 1, F.concat(F.lit("League "), F.col("n_nationkey")))
        .otherwise(F.concat("r_name", F.lit(" League"))).alias("name"),
        F.col("n_name").alias("country"))
    codes = w.matches(spark, sf).select(F.col("competition").alias("code"))
    return leagues.labels_for(codes, catalogue)


_BUILT = {"history": "max(date)", "odds": "max(CASE WHEN home_goals > 0 THEN date END)",
          "predictions": "max(CASE WHEN away_goals > 1 THEN date END)",
          "calibration": "max(CASE WHEN home_goals > 1 THEN date END)",
          "picks": "max(CASE WHEN home_goals = 2 THEN date END)",
          "evidence": "max(date)"}


@query("artifact_staleness", "J15", f"""
WITH b AS (SELECT competition, unnest([{', '.join("{'artifact': '%s', 'built_at': %s}" % kv for kv in _BUILT.items())}]) AS s FROM x_matches GROUP BY competition),
built AS (SELECT competition, s.artifact AS artifact, s.built_at AS built_at FROM b WHERE s.built_at IS NOT NULL),
art AS (SELECT * FROM (VALUES {', '.join("('%s', '%s', %s)" % (k, j, '[' + ', '.join("'%s'" % d for d in ds) + ']::VARCHAR[]') for k, j, ds in leagues.ARTIFACTS)}) t(artifact, job, deps)),
rows AS (SELECT c.competition, art.*, b.built_at FROM (SELECT DISTINCT competition FROM built) c CROSS JOIN art LEFT JOIN built b ON b.competition = c.competition AND b.artifact = art.artifact)
SELECT competition, artifact, job, built_at IS NOT NULL AS "exists",
  coalesce((SELECT string_agg(d.artifact, ',' ORDER BY d.artifact) FROM built d WHERE d.competition = rows.competition AND list_contains(rows.deps, d.artifact) AND d.built_at > rows.built_at), '') AS stale_after
FROM rows
""")
def artifact_staleness(spark, sf):
    m = w.matches(spark, sf)
    built = m.groupBy("competition").agg(*[F.expr(e).alias(k) for k, e in _BUILT.items()])
    long = built.select("competition", F.inline(F.array(*[
        F.struct(F.lit(k).alias("artifact"), F.col(k).alias("built_at")) for k in _BUILT]))
    ).filter("built_at IS NOT NULL")
    return leagues.staleness(leagues.artifact_table(spark), long, by=("competition",))


@query("json_safe_rows", "S15", f"""
SELECT match_id, strftime(date, '%Y-%m-%d') AS date, round(q_home, 4) AS q_home,
  CASE WHEN {_sql_mark('n')} NOT IN ('0', '1') THEN round(lam_market, 4) END AS lam_market FROM x_params
""")
def json_safe_rows(spark, sf):
    p, k = w.parameters(spark, sf), _mark("n")
    broken = p.select("match_id", "date", "q_home", F.when(k == "0", F.lit(float("nan"))).when(
        k == "1", F.lit(float("inf"))).otherwise(F.col("lam_market")).alias("lam_market"))
    return sinks.json_safe(broken, 4)


@query("stored_table", "S14 S17", """
SELECT match_id, competition, round(q_home, 5) AS q_home, round(q_over, 5) AS q_over FROM x_params
""")
def stored_table(spark, sf):
    """Rounded on write, stored as Parquet in the shared folder, read back."""
    p = w.parameters(spark, sf).select("match_id", "competition", "q_home", "q_over")
    return stage(sinks.rounded(p, 5), "params")

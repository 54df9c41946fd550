"""Source layouts to the two tables: played matches and price quotes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairline.functions import dates, names, prices
from fairline.operators.once import with_once

# Division file codes and the competition codes they stand for.
DIVISIONS = {
    "E0": "PL",
    "E1": "ELC",
    "D1": "BL1",
    "I1": "SA",
    "SP1": "PD",
    "F1": "FL1",
    "N1": "DED",
    "P1": "PPL",
    "E2": "EL1",
    "E3": "EL2",
    "EC": "ENL",
    "D2": "BL2",
    "I2": "SB",
    "SP2": "SD",
    "F2": "FL2",
    "SC0": "SPL",
    "SC1": "SCH",
    "SC2": "SC2",
    "SC3": "SC3",
    "B1": "BJL",
    "T1": "TSL",
    "G1": "GSL",
}

# Country file codes of the extra layout.
COUNTRIES = {
    "ARG": "Argentina",
    "AUT": "Austria",
    "BRA": "Brazil",
    "CHN": "China",
    "DNK": "Denmark",
    "FIN": "Finland",
    "IRL": "Ireland",
    "JPN": "Japan",
    "MEX": "Mexico",
    "NOR": "Norway",
    "POL": "Poland",
    "ROU": "Romania",
    "RUS": "Russia",
    "SWE": "Sweden",
    "SWZ": "Switzerland",
    "USA": "USA",
}

MAIN_REQUIRED = ("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG")
MAIN_STATS = {
    "home_shots": "HS", "away_shots": "AS", "home_sot": "HST", "away_sot": "AST",
    "home_corners": "HC", "away_corners": "AC",
}
EXTRA_REQUIRED = ("Date", "Home", "Away", "HG", "AG", "MaxCH", "MaxCD", "MaxCA",
                  "AvgCH", "AvgCD", "AvgCA")

RESULTS_JSON = (
    "matches array<struct<utcDate:string,matchday:int,season:struct<startDate:string>,"
    "homeTeam:struct<name:string>,awayTeam:struct<name:string>,"
    "score:struct<fullTime:struct<home:int,away:int>,halfTime:struct<home:int,away:int>>>>")

EVENT_JSON = (
    "id string, sport string, commence_time string, home_team string, away_team string, "
    "bookmakers array<struct<key:string,markets:array<struct<key:string,"
    "outcomes:array<struct<name:string,price:double,point:double>>>>>>")


def pick_price_columns(columns: Iterable[str]):
    """(best, consensus, kind) for 1X2: closing, else pre-close, else one book, else None."""
    have = set(columns)
    ladder = (("MaxC", "AvgC", "closing"), ("Max", "Avg", "pre-close"),
              ("B365", "B365", "single-book"))
    for best, consensus, kind in ladder:
        b = tuple(best + s for s in "HDA")
        c = tuple(consensus + s for s in "HDA")
        if have.issuperset(b + c):
            return b, c, kind
    return None, None, None


def pick_totals_columns(columns: Iterable[str], line: str = "2.5"):
    """((best over, best under, consensus over, consensus under), kind) for one line."""
    have = set(columns)
    for best, consensus, kind in (("MaxC", "AvgC", "closing"), ("Max", "Avg", "pre-close"),
                                  ("B365", "B365", "single-book")):
        group = (f"{best}>{line}", f"{best}<{line}", f"{consensus}>{line}",
                 f"{consensus}<{line}")
        if have.issuperset(group):
            return group, kind
    return None, None


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _number(name: str) -> Column:
    return F.trim(_col(name).cast("string")).try_cast("double")


def _whole(name: str) -> Column:
    return _number(name).cast("int")


def _present(raw: DataFrame, needed: Iterable[str]) -> DataFrame:
    """Rows with every needed cell filled; wholly empty rows go with them."""
    filled = F.lit(True)
    for name in dict.fromkeys(needed):
        filled = filled & _col(name).isNotNull()
    return raw.filter(filled)


def _finish(df: DataFrame) -> DataFrame:
    kept = df.dropna(subset=["date", "home_goals", "away_goals", "home_odds", "draw_odds",
                             "away_odds"])
    return kept.withColumns({"home_key": names.normalize(F.col("home_team"),
                                                         names.BACKTEST_ALIASES),
                             "away_key": names.normalize(F.col("away_team"),
                                                         names.BACKTEST_ALIASES)})


def parse_main(raw: DataFrame, division: str | Column, season: int | Column) -> DataFrame:
    """Main season-file layout to matches. ``raw`` holds the file's columns as text."""
    missing = [c for c in MAIN_REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"main layout: missing columns {missing}")
    best, consensus, kind = pick_price_columns(raw.columns)
    if best is None:
        raise ValueError("main layout: no usable odds columns")
    needed = list(MAIN_REQUIRED) + list(best) + list(consensus)
    rows = _present(raw, needed)
    competition = (division if isinstance(division, Column)
                   else F.lit(DIVISIONS.get(division, division)))
    season = season if isinstance(season, Column) else F.lit(int(season))
    out = {
        "date": dates.uk_day(_col("Date")), "competition": competition, "season": season,
        "home_team": F.trim(_col("HomeTeam")), "away_team": F.trim(_col("AwayTeam")),
        "home_goals": _whole("FTHG"), "away_goals": _whole("FTAG"),
    }
    for side, b, c in zip(("home", "draw", "away"), best, consensus):
        out[f"{side}_odds"] = _number(b)
        out[f"{side}_odds_cons"] = _number(c)
    out["price_kind"] = F.lit(kind)
    for name, column in MAIN_STATS.items():
        out[name] = (_number(column) if column in raw.columns
                     else F.lit(None).cast("double"))
    totals, totals_kind = pick_totals_columns(raw.columns)
    if totals:
        for name, column in zip(("over25_odds", "under25_odds", "over25_odds_cons",
                                 "under25_odds_cons"), totals):
            out[name] = _number(column)
        out["totals_kind"] = F.lit(totals_kind)
    return _finish(rows.select(*[v.alias(k) for k, v in out.items()]))


def parse_extra(raw: DataFrame, code: str | Column) -> DataFrame:
    """Extra-country layout to matches: 1X2 prices only, competition derived per row."""
    missing = [c for c in EXTRA_REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"extra layout: missing columns {missing}")
    rows = _present(raw, EXTRA_REQUIRED)
    country = code if isinstance(code, Column) else F.lit(code)
    table = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    text = lambda c: F.col(c) if c in raw.columns else F.lit("")
    out = {
        "date": dates.uk_day(_col("Date")),
        "competition": names.competition_code(country, text("League")),
        "season": text("Season"), "country": F.coalesce(F.try_element_at(table, country), country),
        "home_team": F.trim(_col("Home")), "away_team": F.trim(_col("Away")),
        "home_goals": _whole("HG"), "away_goals": _whole("AG"),
        "home_odds": _number("MaxCH"), "draw_odds": _number("MaxCD"),
        "away_odds": _number("MaxCA"), "home_odds_cons": _number("AvgCH"),
        "draw_odds_cons": _number("AvgCD"), "away_odds_cons": _number("AvgCA"),
        "price_kind": F.lit("closing"),
    }
    return _finish(rows.select(*[v.alias(k) for k, v in out.items()]))


def parse_results_json(payload: DataFrame, competition: str | Column) -> DataFrame:
    """Results feed (``matches[]``) to rows; matches without a full-time score are dropped."""
    competition = competition if isinstance(competition, Column) else F.lit(competition)
    m = payload.select(competition.alias("competition"), F.explode("matches").alias("m"))
    score = F.col("m.score")
    rows = m.select(
        dates.iso_day(F.col("m.utcDate")).alias("date"), "competition",
        F.substring(F.coalesce(F.col("m.season.startDate"), F.lit("")), 1, 4).alias("season"),
        F.col("m.matchday").alias("matchday"),
        F.col("m.homeTeam.name").alias("home_team"), F.col("m.awayTeam.name").alias("away_team"),
        score["fullTime"]["home"].alias("home_goals"),
        score["fullTime"]["away"].alias("away_goals"),
        score["halfTime"]["home"].alias("ht_home_goals"),
        score["halfTime"]["away"].alias("ht_away_goals"))
    return rows.filter(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())


def _market_outcomes(keys: tuple[str, ...]) -> Column:
    return F.flatten(F.transform(F.col("bookmakers"), lambda b: F.flatten(F.transform(
        F.filter(b["markets"], lambda m: m["key"].isin(*keys)), lambda m: m["outcomes"]))))


def _named(outcomes: Column, test) -> Column:
    return F.transform(F.filter(outcomes, lambda o: test(o) & o["price"].isNotNull()),
                       lambda o: o["price"])


def median(values: Column) -> Column:
    """Exact median of an array on the row; null when empty."""
    def middle(s: Column) -> Column:
        n = F.size(s)
        low = F.get(s, F.floor((n - 1) / 2).cast("int"))
        return (low + F.get(s, F.floor(n / 2).cast("int"))) / 2.0
    return F.when(F.size(values) > 0, prices.let(F.array_sort(values), middle))


def consensus_prices(events: DataFrame, lines=(2.5, 1.5)) -> DataFrame:
    """Best and median price per outcome for every event, computed on the event's own row.

    An event carries all its books, so this needs no explode and no shuffle.
    """
    e = with_once(events, {
        "n_bookmakers": F.coalesce(F.size("bookmakers"), F.lit(0)),
        "_h2h": _market_outcomes(("h2h",)),
        "_tot": _market_outcomes(("totals", "alternate_totals"))}, drop=("bookmakers",))
    quoted = {
        "_home": _named(F.col("_h2h"), lambda o: o["name"] == F.col("home_team")),
        "_draw": _named(F.col("_h2h"), lambda o: o["name"] == "Draw"),
        "_away": _named(F.col("_h2h"), lambda o: o["name"] == F.col("away_team"))}
    out = {f"{s}_odds": F.array_max(f"_{s}") for s in ("home", "draw", "away")}
    out.update({f"{s}_odds_cons": median(F.col(f"_{s}")) for s in ("home", "draw", "away")})
    for line in lines:
        tag = f"{line:g}".replace(".", "")
        at = lambda o, line=line: F.coalesce(F.abs(o["point"] - line) <= 1e-9, F.lit(False))
        quoted[f"_over{tag}"] = _named(F.col("_tot"), lambda o, at=at: at(o) & (
            F.lower(o["name"]) == "over"))
        quoted[f"_under{tag}"] = _named(F.col("_tot"), lambda o, at=at: at(o) & (
            F.lower(o["name"]) != "over"))
        over, under = F.col(f"_over{tag}"), F.col(f"_under{tag}")
        both = (F.size(over) > 0) & (F.size(under) > 0)
        out[f"over{tag}_odds"] = F.when(both, F.array_max(over))
        out[f"under{tag}_odds"] = F.when(both, F.array_max(under))
        out[f"over{tag}_odds_cons"] = F.when(both, median(over))
        out[f"under{tag}_odds_cons"] = F.when(both, median(under))
    e = with_once(e, quoted, drop=("_h2h", "_tot"))
    return with_once(e, out, drop=tuple(quoted))


def quotes_from_events(events: DataFrame, fetched_at: Column, sport_to_competition: DataFrame,
                       method: str = "best", lines=(2.5, 1.5)) -> DataFrame:
    """Nested feed events to quote rows; an event missing any of home, draw, away is dropped."""
    priced = consensus_prices(events, lines).dropna(
        subset=["home_odds", "draw_odds", "away_odds"])
    if method == "median":
        priced = priced.withColumns({f"{s}_odds": F.col(f"{s}_odds_cons")
                                     for s in ("home", "draw", "away")})
    sides = ("home", "draw", "away")
    out = priced.withColumns({
        "fetched_at": fetched_at,
        "date": dates.iso_day(F.col("commence_time")),
        "overround": prices.overround(*[F.col(f"{s}_odds") for s in sides]),
        "overround_cons": prices.overround(*[F.col(f"{s}_odds_cons") for s in sides]),
        "home_key": names.normalize(F.col("home_team"), names.BACKTEST_ALIASES),
        "away_key": names.normalize(F.col("away_team"), names.BACKTEST_ALIASES)})
    return out.join(sport_to_competition, "sport", "left")


def merge_alternate_lines(quotes: DataFrame, extra: DataFrame, lines=(1.5,)) -> DataFrame:
    """Left join extra total lines, keyed on the two team names, onto quotes."""
    columns = []
    for line in lines:
        tag = f"{line:g}".replace(".", "")
        columns += [f"over{tag}_odds", f"under{tag}_odds", f"over{tag}_odds_cons",
                    f"under{tag}_odds_cons"]
    side = extra.select("home_team", "away_team", *columns)
    base = quotes.drop(*[c for c in columns if c in quotes.columns])
    return base.join(side, ["home_team", "away_team"], "left")


def price_kinds(df: DataFrame) -> DataFrame:
    """How many kinds of price a table mixes; more than one biases a backtest."""
    return df.agg(F.countDistinct("price_kind").alias("kinds"),
                  F.array_join(F.array_sort(F.collect_set("price_kind")), ",").alias("which"),
                  (F.countDistinct("price_kind") > 1).alias("mixed"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV layout as text columns; layouts name what they need and cast it themselves."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)

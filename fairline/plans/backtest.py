"""The value backtest: refit schedule, ratio strengths, bets, filters, intervals, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairline import config
from fairline.functions import markets, prices, resampling, scores
from fairline.operators.ordering import best_per_key, bucket_of, equal_count_parts, running

EPOCH = "1970-01-01"
SEED = 42


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(EPOCH).cast("date"))


def with_fit_dates(matches: DataFrame, min_train: int = config.BACKTEST_MIN_TRAIN,
                   every: int = config.REFIT_ROWS) -> DataFrame:
    """Scored matches with the day their model was fitted on (``fit_date``).

    The loop "refit every n-th row once enough earlier rows exist" has a closed form: with
    i0 the first row that has enough rows strictly before its day, row i uses the fit of
    row i0 + n * floor((i - i0) / n). That row is on the row's own day, but for up to n - 1
    first rows of a day, which share one earlier row. So only those few are ranked, and the
    matches meet a table of days (a calendar, however many matches there are).
    """
    rows = matches.withColumn("_at", F.struct(bucket_of(F.col("match_id")).alias("bucket"),
                                              F.col("match_id").alias("id")))
    days = matches.groupBy("competition", "date").agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy("competition").orderBy("date")
    days = days.withColumn("_cut", F.coalesce(F.sum("_n").over(
        in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    days = days.withColumn("_i0", F.min(F.when(F.col("_cut") >= min_train, F.col("_cut"))).over(
        Window.partitionBy("competition")))
    # A day has a row at least, so the earlier row is on one of the n - 1 days before.
    late = (F.col("_cut") - F.col("_i0")) % every
    recent = F.collect_list(F.struct("_cut", "date")).over(in_order.rowsBetween(-every, -1))
    days = days.withColumn("_recent", recent).filter(F.col("_cut") >= F.col("_i0")).select(
        "competition", "date", F.when(late > 0, every - late).otherwise(0).alias("_early"),
        F.array_max(F.filter("_recent", lambda d: d["_cut"] <= F.col("_cut") - late))["date"]
        .alias("_early_date"))
    days = days.filter(F.col("date").isNotNull())
    first = best_per_key(rows.select("competition", "date", "_at"), ["competition", "date"],
                         [F.col("_at")], max(every - 1, 1), "_rank")
    last = first.join(F.broadcast(days), ["competition", "date"]).filter(
        F.col("_rank") <= F.col("_early")).groupBy("competition", "date").agg(
        F.max("_at").alias("_last"))
    days = days.join(last, ["competition", "date"], "left")
    early = F.col("_last").isNotNull() & (F.col("_at") <= F.col("_last"))
    return rows.join(F.broadcast(days), ["competition", "date"]).select(
        *matches.columns, F.when(early, F.col("_early_date")).otherwise(F.col("date"))
        .alias("fit_date"))


def refit_by_rows(matches: DataFrame, min_train: int = config.BACKTEST_MIN_TRAIN,
                  every: int = config.REFIT_ROWS) -> DataFrame:
    """The day each scored match's model was fitted on: ``match_id``, ``fit_date``."""
    return with_fit_dates(matches, min_train, every).select("match_id", "fit_date")


def running_totals(rows: DataFrame, keys: Sequence[str], values: Sequence[str],
                   half_life: float = config.HALF_LIFE_DAYS) -> DataFrame:
    """Decayed sums per key and day, running over the days up to and including each day.

    The weight 2^(day / half-life) has no reference date, so one running sum serves every
    later date; ``as_of`` divides it out. Days are summed first, so a key's window holds at
    most one row per day however many matches it has. A day's rows weigh alike, so what is
    shuffled are its plain counts.
    """
    keys = list(keys)
    weight = F.pow(F.lit(2.0), (day_number(F.col("date")) - F.lit(9000)) / F.lit(half_life))
    daily = rows.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("w"), *[F.sum(v).alias(v) for v in values])
    daily = daily.select(*keys, "date", *[(F.col(c) * weight).alias(c) for c in ("w", *values)])
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(*keys, "date", *[F.sum(c).over(upto).alias(c)
                                         for c in ("w", *values)])


def as_of(totals: DataFrame, asked: DataFrame, keys: Sequence[str], values: Sequence[str],
          half_life: float = config.HALF_LIFE_DAYS) -> DataFrame:
    """Totals of the days strictly before each asked day, decayed to that day.

    As-of join by union: the asked days are slotted between the stored days of their key
    and take the last value seen. No range join.
    """
    keys, columns = list(keys), ["w", *values]
    asked = asked.select(*keys, "fit_date").distinct()
    stored = totals.select(*keys, F.col("date").alias("_d"), F.lit(1).alias("_kind"), *columns)
    wanted = asked.select(*keys, F.col("fit_date").alias("_d"), F.lit(0).alias("_kind"),
                          *[F.lit(None).cast("double").alias(c) for c in columns])
    seen = Window.partitionBy(*keys).orderBy("_d", "_kind").rowsBetween(
        Window.unboundedPreceding, 0)
    filled = stored.unionByName(wanted).select(*keys, "_d", "_kind", *[
        F.last(c, ignorenulls=True).over(seen).alias(c) for c in columns])
    decay = F.pow(F.lit(2.0), -(day_number(F.col("_d")) - F.lit(9000)) / F.lit(half_life))
    return filled.filter("_kind = 0 AND w IS NOT NULL").select(
        *keys, F.col("_d").alias("fit_date"), *[(F.col(c) * decay).alias(c) for c in columns])


def ratio_strengths(matches: DataFrame, fits: DataFrame,
                    half_life: float = config.HALF_LIFE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Raw sums behind the ratio estimator at every asked (competition, team, fit day).

    Returns (team sums, league sums); ``matches`` has home_goals/away_goals, ``fits`` has
    competition, team, fit_date.
    """
    zero, once = F.lit(0), F.lit(1)
    hg, ag = F.col("home_goals"), F.col("away_goals")
    side = lambda **parts: F.struct(*[v.alias(n) for n, v in parts.items()])
    sides = matches.select("competition", "date", F.inline(F.array(
        side(team=F.col("home"), sh=hg, ch=ag, sa=zero, ca=zero, gh=once, ga=zero),
        side(team=F.col("away"), sh=zero, ch=zero, sa=ag, ca=hg, gh=zero, ga=once))))
    values = ("sh", "ch", "sa", "ca", "gh", "ga")
    teams = as_of(running_totals(sides, ["competition", "team"], values, half_life), fits,
                  ["competition", "team"], values, half_life)
    league_rows = matches.select("competition", "date", hg.alias("hg"), ag.alias("ag"))
    league = as_of(running_totals(league_rows, ["competition"], ("hg", "ag"), half_life),
                   fits.select("competition", "fit_date"), ["competition"], ("hg", "ag"),
                   half_life)
    return teams, league.select("competition", "fit_date",
                                (F.col("hg") / F.col("w")).alias("avg_home"),
                                (F.col("ag") / F.col("w")).alias("avg_away"))


def shrunk(total: Column, count: Column, average: Column,
           k: float = config.SHRINKAGE_GAMES) -> Column:
    """Strength ratio pulled towards 1 when the sample is thin."""
    ratio = F.when(count > 0, total / F.greatest(count, F.lit(1e-12)) / average).otherwise(1.0)
    return (count * ratio + F.lit(k)) / (count + F.lit(k))


def ratio_means(matches: DataFrame, scheduled: DataFrame,
                half_life: float = config.HALF_LIFE_DAYS) -> DataFrame:
    """Scheduled matches with their expected goals from ratio strengths; unknown teams drop out.

    ``scheduled`` has ``fit_date``. All teams' strengths on a fit day travel as one row with a
    map of teams; their table is bounded by competitions, days and teams, so it is broadcast
    and the matches stay where they are.
    """
    teams_of = scheduled.select("competition", F.explode(F.array("home", "away")).alias("team")
                                ).distinct()
    fits = scheduled.select("competition", "fit_date").distinct().join(
        F.broadcast(teams_of), "competition")
    teams, league = ratio_strengths(matches, fits, half_life)
    ah, aa = F.col("avg_home"), F.col("avg_away")
    rated = teams.join(F.broadcast(league), ["competition", "fit_date"]).select(
        "competition", "fit_date", "team", F.struct(
            shrunk(F.col("sh"), F.col("gh"), ah).alias("ha"),
            shrunk(F.col("ch"), F.col("gh"), aa).alias("hd"),
            shrunk(F.col("sa"), F.col("ga"), aa).alias("aa"),
            shrunk(F.col("ca"), F.col("ga"), ah).alias("ad")).alias("_s"), ah, aa)
    table = rated.groupBy("competition", "fit_date").agg(
        F.first(ah).alias("_avh"), F.first(aa).alias("_ava"),
        F.map_from_entries(F.collect_list(F.struct("team", "_s"))).alias("_teams"))
    joined = scheduled.join(F.broadcast(table), ["competition", "fit_date"]).withColumns({
        "_home": F.try_element_at("_teams", F.col("home")),
        "_away": F.try_element_at("_teams", F.col("away"))})
    return joined.filter(F.col("_home").isNotNull() & F.col("_away").isNotNull()).select(
        *scheduled.columns,
        (F.col("_home.ha") * F.col("_away.ad") * F.col("_avh")).alias("lam"),
        (F.col("_away.aa") * F.col("_home.hd") * F.col("_ava")).alias("mu"))


def score_probabilities(rows: DataFrame, rho: str | None = None) -> DataFrame:
    """Rows that have expected goals, with outcome and over probabilities."""
    out = scores.outcome_columns(rows, "lam", "mu", rho, config.BACKTEST_MAX_GOALS, clip=False)
    return out.withColumnRenamed("p_over", "p_over25")


def model_probabilities(matches: DataFrame, means: DataFrame, rho: str | None = None
                        ) -> DataFrame:
    """Match rows with outcome and over probabilities from expected goals."""
    carried = [c for c in ("lam", "mu", rho) if c]
    return score_probabilities(matches.join(means.select("match_id", *carried), "match_id"), rho)


def predictions(priced: DataFrame) -> DataFrame:
    """One row per scored match: model and de-vigged market probabilities and the outcome."""
    cons = all(f"{c}_cons" in priced.columns for c in ("home_odds", "draw_odds", "away_odds"))
    tail = "_odds_cons" if cons else "_odds"
    fair = prices.devig(F.array(*[F.col(f"{s}{tail}") for s in ("home", "draw", "away")]),
                        "proportional")
    rows = priced.withColumn("_fair", fair)
    actual = (F.when(F.col("home_goals") > F.col("away_goals"), "home")
              .when(F.col("home_goals") == F.col("away_goals"), "draw").otherwise("away"))
    return rows.select("match_id", "date", "competition", actual.alias("actual"), *[
        F.col(f"p_{s}").alias(f"model_{s}") for s in ("home", "draw", "away")], *[
        F.get("_fair", i).alias(f"market_{s}") for i, s in enumerate(("home", "draw", "away"))])


def bet_id() -> Column:
    return F.concat_ws("/", "match_id", "market", "outcome")


def all_selections(priced: DataFrame, market_keys=config.BACKTEST_MARKETS,
                   stake: float = config.BACKTEST_STAKE) -> DataFrame:
    """Every priced selection with its edge and flat-stake result, before any filter.

    The edge is stored to 9 decimals, so that equal edges stay equal wherever they are cut.
    """
    sel = markets.backtest_selections(priced, market_keys, ("match_id", "date", "competition"))
    edge = F.floor((F.col("model_prob") - F.col("market_prob")) * 1e9 + 0.5) / F.lit(1e9)
    return sel.withColumns({
        "bet_id": bet_id(), "edge": edge,
        "pnl": F.when(F.col("won"), F.lit(stake) * (F.col("odds") - 1.0)).otherwise(-stake)})


def qualifying(selections: DataFrame, odds_min: float = config.ODDS_MIN,
               odds_max: float = config.ODDS_MAX, min_edge: float = config.MIN_EDGE
               ) -> DataFrame:
    return selections.filter(F.col("odds").between(odds_min, odds_max)
                             & (F.col("edge") >= min_edge))


def apply_filters(bets: DataFrame, max_edge: float | None = None,
                  exclude: Sequence[str] = (), one_per_match: str | None = None) -> DataFrame:
    """Post-selection filters; one bet per match by edge, lowest edge or a preferred market."""
    out = bets
    if exclude:
        out = out.filter(~F.col("competition").isin(*exclude))
    if max_edge is not None:
        out = out.filter(F.col("edge") < max_edge)
    if one_per_match:
        out = best_per_key(out, ["match_id"], match_order(one_per_match))
    return out


def match_order(rule: str) -> list[Column]:
    """The order in which a rule prefers the bets of a match."""
    order = {"edge": [F.desc("edge")], "lowest_edge": [F.asc("edge")]}.get(
        rule, [F.asc(F.col("market") != rule), F.asc("edge")])
    return [*order, F.asc("bet_id")]


def best_by_rule(bets: DataFrame, rules: Sequence[str]) -> DataFrame:
    """The one bet per match that each rule keeps, with ``rule``; what ``apply_filters`` keeps
    rule by rule, but the bets are brought together by match once for all of them."""
    of_match = lambda rule: Window.partitionBy("match_id").orderBy(*match_order(rule))
    ranked = bets.withColumns({f"_rank{i}": F.row_number().over(of_match(rule))
                               for i, rule in enumerate(rules)})
    kept = F.array_compact(F.array(*[F.when(F.col(f"_rank{i}") == 1, F.lit(rule))
                                     for i, rule in enumerate(rules)]))
    return ranked.select(*bets.columns, F.explode(kept).alias("rule"))


def summary(bets: DataFrame, by: Sequence[str] = (), stake: float = config.BACKTEST_STAKE
            ) -> DataFrame:
    n = F.count(F.lit(1))
    pnl = F.sum(F.col("pnl").cast("decimal(18, 4)")).cast("double")  # exact, in any order
    return bets.groupBy(*by).agg(
        n.alias("n"), F.count_if("won").alias("wins"),
        F.avg(F.col("won").cast("double")).alias("win_rate"), F.avg("odds").alias("avg_odds"),
        pnl.alias("pnl"), (n * F.lit(stake)).alias("staked"),
        (pnl / (n * F.lit(stake)) * 100.0).alias("roi"), F.avg("edge").alias("avg_edge"))


def verdict(n: Column, low: Column, high: Column) -> Column:
    return (F.when(n == 0, "none").when((low > 0) & (n >= 200), "good").when(low > 0, "warning")
            .when(high < 0, "losing").otherwise("critical"))


def bootstrap(units: DataFrame, unit: str, by: Sequence[str] = (), samples: int = config.BOOTSTRAP_SAMPLES,
              stake: float = config.BACKTEST_STAKE, seed: int = SEED) -> DataFrame:
    """95 % interval of ROI by resampling units with replacement.

    Every unit draws a Poisson(1) count per replicate from the md5 of its id, so the draw
    needs no shared random state and gives the same answer on any cluster and after any
    retry. A task adds the draws of its units to one array of replicates per group; what
    moves is (groups x replicates) sums per task. ``units`` has pnl and n.
    """
    by = list(by)
    if samples < 1:
        raise ValueError("an interval needs replicates")
    return interval(resampling.replicate_sums(units, unit, by, samples, seed), by, stake)


def interval(sums: DataFrame, by: Sequence[str], stake: float = config.BACKTEST_STAKE) -> DataFrame:
    """The ends of ROI over the replicates whose pnl and n are given."""
    rois = sums.select(*by, F.try_divide(F.col("pnl") * 100.0, F.col("n") * F.lit(stake)).alias("roi"))
    return rois.groupBy(*by).agg(F.percentile("roi", F.lit(0.025)).alias("ci_low"),
                                 F.percentile("roi", F.lit(0.975)).alias("ci_high"))


def bet_units(bets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return bets.select(*by, F.col("bet_id").alias("unit"), "pnl", F.lit(1.0).alias("n"))


def match_units(bets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bets of one match are one unit: they share a scoreline."""
    return bets.groupBy(*by, F.col("match_id").alias("unit")).agg(
        F.sum("pnl").alias("pnl"), F.count(F.lit(1)).cast("double").alias("n"))


def with_interval(bets: DataFrame, by: Sequence[str] = (),
                  samples: int = config.BOOTSTRAP_SAMPLES) -> DataFrame:
    head = summary(bets, by)
    ends = bootstrap(bet_units(bets, by), "unit", by, samples)
    return with_verdict(head.join(ends, list(by)) if by else head.crossJoin(ends))


def with_verdict(rows: DataFrame) -> DataFrame:
    return rows.withColumn("verdict", verdict(F.col("n"), F.col("ci_low"), F.col("ci_high")))


def by_period(bets: DataFrame, periods: int = config.PERIODS,
              stake: float = config.BACKTEST_STAKE) -> DataFrame:
    """Equal-count consecutive periods of the bets."""
    parts = equal_count_parts(bets, periods, ["date", "competition"], "bet_id", "period")
    return parts.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.sum("pnl").alias("pnl"),
        (F.sum("pnl") / (F.count(F.lit(1)) * F.lit(stake)) * 100.0).alias("roi"))


def equity_curve(bets: DataFrame) -> DataFrame:
    return running(bets, ["date", "competition"], "bet_id",
                   {"cum": F.col("pnl"), "position": F.lit(1).cast("long")})


def sweep_bands(selections: DataFrame, bands=config.SWEEP_BANDS,
                min_edge: float = config.MIN_EDGE, samples: int = config.BOOTSTRAP_SAMPLES) -> DataFrame:
    """Every price band from one pass over the selections: a bet counts in each band it is in.

    A bet's draws are the same in all of them, so it draws once, for the set of its bands, and the sums of the sets that
    hold a band are added up.
    """
    by = ["band", "odds_min", "odds_max"]
    dim = F.broadcast(selections.sparkSession.createDataFrame(
        [(f"{lo:.2f}-{hi:.2f}", lo, hi, 1 << i) for i, (lo, hi) in enumerate(bands)],
        "band string, odds_min double, odds_max double, bit bigint"))
    held = sum((F.when(F.col("odds").between(lo, hi), 1 << i).otherwise(0) for i, (lo, hi) in enumerate(bands)), F.lit(0))
    bets = selections.filter(F.col("edge") >= min_edge).withColumn("held", held.cast("bigint")).filter("held > 0")
    inside = F.col("held").bitwiseAND(F.col("bit")) != 0
    head = summary(bets.join(dim, inside), by)
    sums = resampling.replicate_sums(bet_units(bets, ["held"]), "unit", ["held"], samples, SEED)
    sums = sums.join(dim, inside).groupBy(*by, "replicate").agg(F.sum("pnl").alias("pnl"), F.sum("n").alias("n"))
    return with_verdict(head.join(interval(sums, by), by))


def date_cut(bets: DataFrame, split: float = 0.5) -> DataFrame:
    """Interpolated quantile of the bet dates, as a day number. Days are few, so the exact
    percentile holds one counter per day."""
    return bets.agg(F.percentile(day_number(F.col("date")), F.lit(split)).alias("cut"))


def validate(bets: DataFrame, split: float = 0.5, samples: int = config.BOOTSTRAP_SAMPLES,
             **filters) -> DataFrame:
    """ROI before and after the filters on the half that chose them and on the other half."""
    halves = bets.crossJoin(F.broadcast(date_cut(bets, split))).withColumn(
        "half", F.when(day_number(F.col("date")) <= F.col("cut"), "train").otherwise("test"))
    kept = apply_filters(halves, **filters)
    before = summary(halves, ["half"]).select("half", F.col("n").alias("n_before"),
                                              F.col("roi").alias("roi_before"))
    after = summary(kept, ["half"]).select("half", F.col("n").alias("n_after"),
                                           F.col("roi").alias("roi_after"))
    ends = bootstrap(match_units(kept, ["half"]), "unit", ["half"], samples)
    out = before.join(after, "half", "left").join(ends, "half", "left")
    gain = F.coalesce("roi_after", F.lit(0.0)) - F.col("roi_before")
    return out.withColumn("gain", gain).withColumn(
        "held_up", F.when(F.col("half") == "test", F.col("gain") > 0))


def bet_explorer(bets: DataFrame, text: str = "", won: bool | None = None,
                 outcome: str | None = None, competition: str | None = None,
                 market: str | None = None) -> DataFrame:
    """The explorer's filters; its footer is ``summary`` of the result."""
    out = bets
    if text:
        out = out.filter(F.contains(F.lower("match_id"), F.lit(text.lower())))
    if won is not None:
        out = out.filter(F.col("won") == won)
    for column, value in (("outcome", outcome), ("competition", competition),
                          ("market", market)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out

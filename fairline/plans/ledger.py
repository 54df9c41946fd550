"""The append-only record of picks and slips, and its settlement against results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fairline import config
from fairline.functions import markets, prices
from fairline.operators import matching
from fairline.operators.ordering import best_per_key, running
from fairline.sources.readers import LEG_SCHEMA

WINDOW = config.POSTPONEMENT_DAYS
WIDTH = 2 * WINDOW + 1


def grade(key: Column, home: Column, away: Column, corners: Column) -> Column:
    """won, lost or void; null when the selection cannot be graded (no corner count)."""
    expr = F.lit(None).cast("string")
    for s in markets.CATALOGUE:
        won = markets.settle(s.key, home, away, corners)
        outcome = F.when(won, "won").when(~won, "lost")
        if s.group != "corners":
            outcome = F.when(won.isNull(), "void").when(won, "won").otherwise("lost")
        expr = F.when(key == s.key, outcome).otherwise(expr)
    return expr


def resolve_teams(picks: DataFrame, results: DataFrame) -> DataFrame:
    """Rewrite pick teams that the results do not know, where one team is meant.

    Only names absent from their competition's results are resolved, once each.
    """
    teams = results.select("competition", F.col("home").alias("candidate")).unionByName(
        results.select("competition", F.col("away").alias("candidate"))).distinct()
    asked = picks.select("competition", F.col("home").alias("key")).unionByName(
        picks.select("competition", F.col("away").alias("key"))).distinct()
    unknown = asked.join(teams.withColumnRenamed("candidate", "key"), ["competition", "key"],
                         "left_anti")
    return matching.put_back(picks, matching.resolve_names(unknown, teams))


def find_results(picks: DataFrame, results: DataFrame, pick_id: Sequence[str],
                 resolve: bool = True) -> DataFrame:
    """The finished match of every pick: same teams, at most a week away, nearest first.

    ``picks(competition, home, away, day)``, ``results(competition, home, away, date, ...)``.
    The days are cut into blocks so that a pick meets only the results of the blocks its
    window touches, however many times the two teams have met.
    """
    asked = resolve_teams(picks, results) if resolve else picks
    number = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    block = lambda n: F.floor(n / WIDTH)
    day = number(F.col("day"))
    left = asked.withColumn("_block", F.explode(F.array_distinct(F.array(
        block(day - WINDOW), block(day + WINDOW)))))
    right = results.withColumn("_block", block(number(F.col("date"))))
    drift = F.abs(F.datediff("date", "day"))
    near = left.join(right, ["competition", "home", "away", "_block"]).filter(drift <= WINDOW)
    return best_per_key(near.drop("_block"), list(pick_id), [drift, F.col("date"),
                                                            F.col("result_id")])


def settle(ledger: DataFrame, results: DataFrame, pick_id: Sequence[str] = ("pick_id",),
           resolve: bool = True) -> DataFrame:
    """Fill in pending picks whose match has been played; the rest stay as they are."""
    keys = list(pick_id)
    pending = ledger.filter(F.coalesce("outcome", F.lit("pending")) == "pending")
    found = find_results(pending.select(*keys, "competition", "home", "away", "day", "key"),
                         results, keys, resolve)
    graded = found.select(
        *keys, F.col("date").alias("_on"), F.col("home_goals").alias("_hg"),
        F.col("away_goals").alias("_ag"),
        grade(F.col("key"), F.col("home_goals"), F.col("away_goals"),
              F.col("total_corners")).alias("_out")).filter(F.col("_out").isNotNull())
    held = ledger.drop("played_on", "home_goals", "away_goals", "pnl")
    old = {c: (F.col(c) if c in ledger.columns else F.lit(None)).cast(t) for c, t in (
        ("played_on", "date"), ("home_goals", "int"), ("away_goals", "int"), ("pnl", "double"))}
    base = ledger.select(*held.columns, *[v.alias(c) for c, v in old.items()])
    joined = base.join(graded, keys, "left")
    fresh = F.col("_out").isNotNull()
    return joined.withColumns({
        "outcome": F.coalesce("_out", "outcome", F.lit("pending")),
        "played_on": F.coalesce("_on", "played_on"),
        "home_goals": F.coalesce("_hg", "home_goals"),
        "away_goals": F.coalesce("_ag", "away_goals"),
        "pnl": F.when(fresh, prices.flat_profit(F.col("_out"), F.col("odds"))).otherwise(
            F.col("pnl"))}).drop("_out", "_on", "_hg", "_ag")


def summary(ledger: DataFrame, today: Column, by: Sequence[str] = ()) -> DataFrame:
    """Headline numbers of the record, pooled or by band."""
    outcome = F.coalesce("outcome", F.lit("pending"))
    done = outcome.isin("won", "lost", "void")
    decided = outcome.isin("won", "lost")
    priced = done & F.col("pnl").isNotNull()
    late = (outcome == "pending") & (F.col("day") < F.date_sub(today, config.OVERDUE_DAYS))
    wins, n_decided, n_priced = F.count_if(outcome == "won"), F.count_if(decided), F.count_if(priced)
    pnl = F.coalesce(F.sum(F.when(priced, F.col("pnl"))), F.lit(0.0))
    return ledger.groupBy(*by).agg(
        F.count(F.lit(1)).alias("recorded"), F.count_if(late).alias("overdue"),
        F.count_if(outcome == "pending").alias("pending"), F.count_if(done).alias("settled"),
        F.count_if(outcome == "void").alias("void"), wins.alias("wins"),
        (n_decided - wins).alias("losses"), F.try_divide(wins, n_decided).alias("hit_rate"),
        F.avg(F.when(decided, F.col("prob"))).alias("expected"), n_priced.alias("priced"),
        (F.count_if(done) - n_priced).alias("unpriced"), pnl.alias("pnl"),
        (n_priced * F.lit(config.LEDGER_STAKE)).alias("staked"),
        F.try_divide(pnl * 100.0, n_priced * F.lit(config.LEDGER_STAKE)).alias("roi"),
        F.avg(F.when(priced, F.col("odds"))).alias("average_odds"))


def equity(ledger: DataFrame, row_id: str = "pick_id") -> DataFrame:
    """Cumulative profit over settled, priced picks in playing order."""
    priced = ledger.filter(F.col("pnl").isNotNull())
    return running(priced, ["played_on", "day"], row_id,
                   {"cum": F.col("pnl"), "position": F.lit(1).cast("long")})


def slip_outcomes(legs: DataFrame, slip_id: str = "issued") -> DataFrame:
    """Outcome of every slip all of whose legs are graded; ``legs`` has odds and the grade ``_out``, null while a leg waits."""
    out, odds = F.col("_out"), F.col("odds")
    alive = out.isin("won", "lost")
    per_slip = legs.groupBy(slip_id).agg(
        F.bool_and(out.isNotNull()).alias("_done"), F.count_if(out == "won").alias("_wins"),
        F.count_if(alive).alias("_alive"), F.count_if(out == "void").alias("_void"),
        F.coalesce(F.bool_and(F.when(alive, F.coalesce(odds, F.lit(0.0)) != 0.0)),
                   F.lit(True)).alias("_priced"),
        F.product(F.when(alive, odds)).alias("_price")).filter("_done")
    return per_slip.select(
        slip_id, F.col("_wins").cast("int").alias("_won"), F.col("_void").cast("int"),
        F.when(F.col("_alive") == 0, "void").when(F.col("_wins") == F.col("_alive"), "won")
        .otherwise("lost").alias("_outcome"),
        F.when(F.col("_alive") == 0, 0.0).when(~F.col("_priced"), F.lit(None)).when(
            F.col("_wins") == F.col("_alive"),
            (F.col("_price") - 1.0) * config.LEDGER_STAKE).otherwise(-config.LEDGER_STAKE)
        .alias("_pnl"))


def settle_slips(slips: DataFrame, results: DataFrame, slip_id: str = "issued",
                 resolve: bool = True) -> DataFrame:
    """Grade slips whose every leg has been played.

    Void legs drop out; a slip with an unpriced surviving leg is graded but has no profit.
    ``slips`` carries ``leg_list``; output adds legs_won, legs_void, outcome and pnl.
    """
    pending = slips.filter(F.coalesce("outcome", F.lit("pending")) == "pending")
    legs = pending.select(slip_id, F.posexplode("leg_list").alias("leg_no", "leg")).select(
        slip_id, "leg_no", F.to_date("leg.date").alias("day"), "leg.competition", "leg.home",
        "leg.away", "leg.key", "leg.odds")
    found = find_results(legs.drop("odds"), results, [slip_id, "leg_no"], resolve).select(
        slip_id, "leg_no", grade(F.col("key"), F.col("home_goals"), F.col("away_goals"),
                                 F.col("total_corners")).alias("_out"))
    graded = slip_outcomes(legs.join(found, [slip_id, "leg_no"], "left"), slip_id)
    joined = slips.join(graded, slip_id, "left")
    fresh = F.col("_outcome").isNotNull()
    keep = lambda new, old, t: F.when(fresh, F.col(new)).otherwise(
        F.col(old) if old in slips.columns else F.lit(None)).cast(t)
    return joined.withColumns({
        "legs_won": keep("_won", "legs_won", "int"), "legs_void": keep("_void", "legs_void", "int"),
        "pnl": keep("_pnl", "pnl", "double"),
        "outcome": F.coalesce("_outcome", "outcome", F.lit("pending"))}).drop(
        "_won", "_void", "_outcome", "_pnl")


def slip_summary(slips: DataFrame) -> DataFrame:
    outcome = F.coalesce("outcome", F.lit("pending"))
    done, decided = outcome.isin("won", "lost", "void"), outcome.isin("won", "lost")
    priced = done & F.col("pnl").isNotNull()
    wins, n_decided, n_priced = F.count_if(outcome == "won"), F.count_if(decided), F.count_if(priced)
    pnl = F.coalesce(F.sum(F.when(priced, F.col("pnl"))), F.lit(0.0))
    mean = lambda c: F.avg(F.when(decided, F.col(c)))
    return slips.agg(
        F.count(F.lit(1)).alias("recorded"), F.count_if(outcome == "pending").alias("pending"),
        F.count_if(done).alias("settled"), wins.alias("wins"), (n_decided - wins).alias("losses"),
        F.try_divide(wins, n_decided).alias("hit_rate"), mean("probability").alias("expected"),
        n_priced.alias("priced"), (F.count_if(done) - n_priced).alias("unpriced"),
        pnl.alias("pnl"),
        F.try_divide(pnl * 100.0, n_priced * F.lit(config.LEDGER_STAKE)).alias("roi"),
        mean("legs_won").alias("average_legs_won"), mean("legs").alias("average_legs"))


def behind_results(ledger: DataFrame, results: DataFrame, today: Column) -> DataFrame:
    """Pending picks whose day has passed but whose competition's results stop earlier."""
    last = results.groupBy("competition").agg(F.max("date").alias("league_last"))
    overall = results.agg(F.max("date").alias("_last"))
    pending = ledger.filter(F.coalesce("outcome", F.lit("pending")) == "pending")
    joined = pending.join(last, "competition", "left").crossJoin(F.broadcast(overall))
    joined = joined.withColumn("league_last", F.coalesce("league_last", "_last"))
    return joined.filter((F.col("day") < today) & (F.col("day") > F.col("league_last"))).groupBy(
        "competition", "league_last").agg(F.count(F.lit(1)).alias("waiting"))


def fingerprint() -> Column:
    """What makes a pick the same pick; prices and probabilities move and are not news."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                              for c in ("day", "competition", "match", "key", "selection")])


def legs_to_json(legs: Column) -> Column:
    return F.to_json(legs.cast(LEG_SCHEMA), {"ignoreNullFields": "false"})


def record(ledger: DataFrame, picks: DataFrame, keys: Sequence[str], today: Column,
           order: Sequence[Column]) -> DataFrame:
    """New rows only: nothing for a key already in the book, nothing for a day gone by."""
    fresh = picks.filter(F.col("day") >= today)
    fresh = fresh.join(ledger.select(*keys).distinct(), list(keys), "left_anti")
    return best_per_key(fresh, keys, order).withColumn("outcome", F.lit("pending"))

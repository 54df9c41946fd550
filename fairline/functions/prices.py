"""Prices to probabilities: sanity rules, margin removal, edges, flat-stake profit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from fairline import config

NEWTON_STEPS = 14
BISECTION_STEPS = 52


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def implied(odds: Column) -> Column:
    return F.try_divide(F.lit(1.0), odds)


def is_sane(*odds: Column) -> Column:
    """True only when every price of the market is there and above 1; NaN counts as missing."""
    ok = F.lit(True)
    for price in odds:
        ok = ok & F.coalesce((price > 1.0) & ~F.isnan(price), F.lit(False))
    return ok


def sane_prices(*odds: Column) -> Column:
    """The market's prices as one array, or null when any of them is unusable."""
    return F.when(is_sane(*odds), F.array(*odds))


def preferred_prices(consensus: Sequence[Column], best: Sequence[Column]) -> Column:
    """Consensus where the whole consensus market is usable, else best, else null."""
    return F.coalesce(sane_prices(*consensus), sane_prices(*best))


def overround(*odds: Column) -> Column:
    margin = F.lit(0.0)
    for price in odds:
        margin = margin + implied(price)
    return F.round(margin, 4)


def devig(prices: Column, method: str = config.DEVIG) -> Column:
    """Fair probabilities (array) for one market's full set of prices (array)."""
    if method not in config.DEVIG_METHODS:
        raise ValueError(f"unknown de-vig method {method!r}; known: {config.DEVIG_METHODS}")
    raw = F.transform(prices, lambda p: F.lit(1.0) / p)
    solve = {"proportional": _proportional, "power": _power, "shin": _shin}[method]
    return F.when(prices.isNotNull(), let(raw, solve))


def _proportional(raw: Column) -> Column:
    return let(total(raw), lambda s: F.transform(raw, lambda r: r / s))


def _power(raw: Column) -> Column:
    """Exponent k with sum(r^k) = 1.

    The sum is convex and falling in k, so Newton from k = 1 climbs to the root without
    ever passing it; a market with no root up to 20 keeps the proportional answer.
    """
    def from_logs(logs: Column) -> Column:
        def step(k: Column, _: Column) -> Column:
            value = F.aggregate(logs, F.lit(-1.0), lambda acc, l: acc + F.exp(k * l))
            slope = F.aggregate(logs, F.lit(0.0), lambda acc, l: acc + l * F.exp(k * l))
            return k - value / slope
        k = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(1.0), step)
        return let(k, lambda root: _proportional(F.transform(logs, lambda l: F.exp(root * l))))

    at_limit = F.aggregate(raw, F.lit(-1.0), lambda acc, r: acc + F.pow(r, F.lit(20.0)))
    return (F.when((total(raw) <= 1.0) | (at_limit > 0.0), _proportional(raw))
            .otherwise(let(F.transform(raw, lambda r: F.ln(r)), from_logs)))


def _shin(raw: Column) -> Column:
    """Insider share z with sum(p(z)) = 1, halved down from [1e-9, 0.5]."""
    def with_total(s: Column) -> Column:
        def p_of(z: Column, r: Column) -> Column:
            return ((F.sqrt(z * z + 4.0 * (1.0 - z) * r * r / s) - z) / (2.0 * (1.0 - z)))

        def excess(z: Column) -> Column:
            return F.aggregate(raw, F.lit(-1.0), lambda acc, r: acc + p_of(z, r))

        def halve(span: Column, _: Column) -> Column:
            mid = (span["lo"] + span["hi"]) / 2.0
            above = excess(mid) > 0.0
            return F.struct(F.when(above, mid).otherwise(span["lo"]).alias("lo"),
                            F.when(above, span["hi"]).otherwise(mid).alias("hi"))

        start = F.struct(F.lit(1e-9).alias("lo"), F.lit(0.5).alias("hi"))
        z = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTION_STEPS)), start, halve,
                        lambda span: (span["lo"] + span["hi"]) / 2.0)
        solved = let(z, lambda root: _proportional(F.transform(raw, lambda r: p_of(root, r))))
        no_root = (excess(F.lit(1e-9)) < 0.0) | (excess(F.lit(0.5)) > 0.0)
        return F.when((s <= 1.0) | no_root, _proportional(raw)).otherwise(solved)

    return let(total(raw), with_total)


def fair_odds(prob: Column, floor: float = 1e-6) -> Column:
    return F.lit(1.0) / F.greatest(prob, F.lit(floor))


def ev_edge(prob: Column, odds: Column) -> Column:
    """Expected profit per unit staked; null without a price."""
    return prob * odds - 1.0


def prob_edge(model_prob: Column, market_prob: Column) -> Column:
    return model_prob - market_prob


def flat_profit(outcome: Column, odds: Column, stake: float = config.LEDGER_STAKE) -> Column:
    """won: odds - 1, lost: -1, void: 0, and null without a price or a result."""
    return F.when(
        odds.isNotNull() & ~F.isnan(odds),
        F.when(outcome == "won", F.lit(stake) * (odds - 1.0))
         .when(outcome == "lost", F.lit(-stake))
         .when(outcome == "void", F.lit(0.0)))


def fuse(model: Column, market: Column, weight: float | Column, geometric: bool = True) -> Column:
    """Blend a model parameter with the market's; a missing market leaves the model alone."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    missing = market.isNull() | F.isnan(market)
    blended = (F.pow(model, 1.0 - w) * F.pow(market, w) if geometric
               else (1.0 - w) * model + w * market)
    return F.when(missing, model).otherwise(blended)

"""Scoring rules, intervals and bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fairline import config


def squared_error(prob: Column, outcome: Column) -> Column:
    return (prob - outcome) * (prob - outcome)


def log_error(prob: Column, outcome: Column, clip: float = 1e-9) -> Column:
    p = F.least(F.greatest(prob, F.lit(clip)), F.lit(1.0 - clip))
    return -(outcome * F.ln(p) + (1.0 - outcome) * F.ln(1.0 - p))


def ranked_probability(probs: Column, happened: Column) -> Column:
    """Ranked probability score of one row: ordered category array, index of what happened."""
    size = F.size(probs)

    def step(acc: Column, item: Column) -> Column:
        cum = acc["cum"] + item["p"] - F.when(item["i"] == happened, 1.0).otherwise(0.0)
        counted = item["i"] < size - 1
        return F.struct(cum.alias("cum"),
                        (acc["sum"] + F.when(counted, cum * cum).otherwise(0.0)).alias("sum"))

    items = F.transform(probs, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("sum"))
    return F.aggregate(items, start, step, lambda acc: acc["sum"] / (size - 1))


def wilson(hits: Column, n: Column, z: float = config.WILSON_Z) -> tuple[Column, Column]:
    """Interval ends for a hit rate; both null at n = 0."""
    count = F.when(n > 0, n.cast("double"))
    p = hits.cast("double") / count
    z2 = F.lit(z * z)
    denom = 1.0 + z2 / count
    centre = (p + z2 / (2.0 * count)) / denom
    half = F.lit(z) * F.sqrt(p * (1.0 - p) / count + z2 / (4.0 * count * count)) / denom
    return (F.when(count.isNotNull(), F.greatest(F.lit(0.0), centre - half)),
            F.when(count.isNotNull(), F.least(F.lit(1.0), centre + half)))


def band_low(prob: Column, edges=config.BAND_EDGES) -> Column:
    """Lower edge of the half-open band a probability falls in; null outside the bands."""
    expr = F.when(prob < edges[0], F.lit(None).cast("double"))
    for lo, hi in zip(edges, edges[1:]):
        expr = expr.when(prob < hi, F.lit(float(lo)))
    return expr


def band_high(low: Column, edges=config.BAND_EDGES) -> Column:
    expr = F.lit(None).cast("double")
    for lo, hi in zip(edges, edges[1:]):
        expr = F.when(low == lo, F.lit(min(float(hi), 1.0))).otherwise(expr)
    return expr


def band_label(low: Column, edges=config.BAND_EDGES) -> Column:
    expr = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:]):
        expr = F.when(low == lo, F.lit(f"{lo:.0%}-{min(hi, 1.0):.0%}")).otherwise(expr)
    return expr


def roi(pnl: Column, n: Column, stake: float) -> Column:
    """Return on flat stakes in percent; null without bets."""
    return F.try_divide(pnl * 100.0, n * F.lit(stake))


def hash_unit(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the md5 of the parts: the same on every engine and run."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def half_digest(digest: Column, half: int) -> Column:
    """16 hex digits of a digest as a signed 64-bit number."""
    return F.conv(F.substring(digest, 16 * half + 1, 16), 16, -10).cast("bigint")


def unit_of_half(half: Column, part: int) -> Column:
    """The upper (0) or lower (1) 32 bits of a 64-bit number, from 0 to 1."""
    bits = half.bitwiseAND(F.lit(4294967295)) if part else F.shiftrightunsigned(half, 32)
    return bits.cast("double") / F.lit(4294967296.0)

"""Poisson score distributions as Spark expressions.

Two forms. The array form (``score_matrix``) is the whole grid, for callers that want it.
The column form (``add_score_columns``) adds scalar columns in layers, so a wide set of
selections comes out of ordinary arithmetic inside whole-stage codegen, without a grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from fairline import config
from fairline.session import short_methods

LOG_FACTORIALS = tuple(math.lgamma(k + 1.0) for k in range(64))


def _floored(mean: Column) -> Column:
    """At least 1e-12; null stays null (``greatest`` alone would skip it)."""
    return F.when(mean < 1e-12, F.lit(1e-12)).otherwise(mean)


def poisson_term(log_mean: Column, mean: Column, k: int) -> Column:
    return F.exp(-mean + F.lit(float(k)) * log_mean - F.lit(LOG_FACTORIALS[k]))


def poisson_pmf(mean: Column, n: int) -> Column:
    """P(X = 0..n) as an array; the mean is floored at 1e-12."""
    floored = _floored(mean)
    return F.array(*[poisson_term(F.ln(floored), floored, k) for k in range(n + 1)])


def tau(i: Column, j: Column, lam: Column, mu: Column, rho: Column) -> Column:
    """Dixon-Coles factor on a scoreline; 1 beyond the four lowest."""
    return (F.when((i == 0) & (j == 0), 1.0 - lam * mu * rho)
             .when((i == 0) & (j == 1), 1.0 + lam * rho)
             .when((i == 1) & (j == 0), 1.0 + mu * rho)
             .when((i == 1) & (j == 1), 1.0 - rho)
             .otherwise(F.lit(1.0)))


def score_matrix(lam: Column, mu: Column, rho: Column, n: int = config.MAX_GOALS,
                 clip: bool = True) -> Column:
    """Row-major array of (n+1)^2 scoreline probabilities that sum to 1."""
    home, away = poisson_pmf(lam, n), poisson_pmf(mu, n)
    moved = lambda h, a, i, j: h * a * tau(i, j, lam, mu, rho)
    low = lambda h, a, i, j: F.greatest(moved(h, a, i, j), F.lit(0.0)) if clip else moved(h, a, i, j)
    # Only the four low cells are changed, and only they can fall below zero.
    cells = F.flatten(F.transform(home, lambda h, i: F.when(i > 1, F.transform(
        away, lambda a: h * a)).otherwise(F.transform(
            away, lambda a, j: F.when(j > 1, h * a).otherwise(low(h, a, i, j))))))
    # The sum is bound once; inside the division it would be added up again for every cell.
    mass = lambda grid: F.array(F.aggregate(grid, F.lit(0.0), lambda s, x: s + x))
    scaled = lambda grid: F.element_at(F.transform(mass(grid), lambda total: F.transform(
        grid, lambda c: c / total)), 1)
    return F.element_at(F.transform(F.array(cells), scaled), 1)


def over_line(matrix: Column, line: Column, n: int = config.MAX_GOALS) -> Column:
    """P(total > line) from a score matrix, for any line."""
    totals = F.array(*[F.lit(i + j) for i in range(n + 1) for j in range(n + 1)])
    return F.aggregate(F.zip_with(matrix, totals, lambda c, total: F.when(
        total > line, c).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def _sum(columns: list[Column]) -> Column:
    acc = columns[0]
    for column in columns[1:]:
        acc = acc + column
    return acc


def add_score_columns(df: DataFrame, lam: str, mu: str, rho: str | None, n: int,
                      prefix: str, low_cells: bool = True, clip: bool = True,
                      sums_to: int | None = None) -> DataFrame:
    """Add pmf terms, cumulative away terms and the low-score corrections as columns.

    ``{prefix}h{i}``/``{prefix}a{i}`` are the pmf terms, ``{prefix}sh{i}``/``{prefix}sa{i}``
    their running sums, ``{prefix}d00`` .. ``{prefix}d11`` the Dixon-Coles changes to the
    four low cells, and ``{prefix}norm`` the mass actually present on the grid. ``sums_to``
    keeps only the running sums a caller needs (and the last), which keeps the generated
    method small enough to be compiled.
    """
    p = prefix
    short_methods(df.sparkSession)
    df = df.withColumns({f"{p}lam": _floored(F.col(lam)), f"{p}mu": _floored(F.col(mu))})
    df = df.withColumns({f"{p}ll": F.ln(F.col(f"{p}lam")), f"{p}lm": F.ln(F.col(f"{p}mu"))})
    terms = {}
    for k in range(n + 1):
        terms[f"{p}h{k}"] = poisson_term(F.col(f"{p}ll"), F.col(f"{p}lam"), k)
        terms[f"{p}a{k}"] = poisson_term(F.col(f"{p}lm"), F.col(f"{p}mu"), k)
    df = df.withColumns(terms)
    running = {}
    for k in [*range((n if sums_to is None else sums_to) + 1), n]:
        running[f"{p}sh{k}"] = _sum([F.col(f"{p}h{i}") for i in range(k + 1)])
        running[f"{p}sa{k}"] = _sum([F.col(f"{p}a{i}") for i in range(k + 1)])
    df = df.withColumns(running)
    if not low_cells or rho is None:
        return df.withColumn(f"{p}norm", F.col(f"{p}sh{n}") * F.col(f"{p}sa{n}"))
    r = F.col(rho)
    deltas = {}
    for i in (0, 1):
        for j in (0, 1):
            cell = F.col(f"{p}h{i}") * F.col(f"{p}a{j}")
            moved = cell * tau(F.lit(i), F.lit(j), F.col(lam), F.col(mu), r)
            if clip:
                moved = F.greatest(moved, F.lit(0.0))
            deltas[f"{p}d{i}{j}"] = moved - cell
    df = df.withColumns(deltas)
    spread = _sum([F.col(f"{p}d{i}{j}") for i in (0, 1) for j in (0, 1)])
    return df.withColumns({f"{p}dd": spread}).withColumn(
        f"{p}norm", F.col(f"{p}sh{n}") * F.col(f"{p}sa{n}") + F.col(f"{p}dd"))


def home_by(p: str, n: int, margin: int) -> Column:
    """Unnormalised mass where home wins by at least ``margin`` (no low-cell change)."""
    return _sum([F.col(f"{p}h{i}") * F.col(f"{p}sa{i - margin}") for i in range(margin, n + 1)])


def away_by(p: str, n: int, margin: int) -> Column:
    return _sum([F.col(f"{p}a{i}") * F.col(f"{p}sh{i - margin}") for i in range(margin, n + 1)])


def drawn(p: str, n: int) -> Column:
    return _sum([F.col(f"{p}h{i}") * F.col(f"{p}a{i}") for i in range(n + 1)])


def total_at_most(p: str, limit: int) -> Column:
    return _sum([F.col(f"{p}h{i}") * F.col(f"{p}sa{limit - i}") for i in range(limit + 1)])


def outcome_columns(df: DataFrame, lam: str, mu: str, rho: str | None,
                    n: int = config.MAX_GOALS, prefix: str = "", clip: bool = True,
                    line: int = 2) -> DataFrame:
    """Add ``{prefix}p_home/p_draw/p_away/p_over`` without building a grid."""
    p = "_o_"
    kept = df.columns
    wide = add_score_columns(df, lam, mu, rho, n, p, low_cells=rho is not None, clip=clip)
    zero = F.lit(0.0)
    d = (lambda c: F.col(f"{p}{c}")) if rho is not None else (lambda c: zero)
    norm = F.col(f"{p}norm")
    return wide.select(
        *kept,
        ((home_by(p, n, 1) + d("d10")) / norm).alias(f"{prefix}p_home"),
        ((drawn(p, n) + d("d00") + d("d11")) / norm).alias(f"{prefix}p_draw"),
        ((away_by(p, n, 1) + d("d01")) / norm).alias(f"{prefix}p_away"),
        (1.0 - (total_at_most(p, line) + (d("dd") if line >= 2 else d("d00")
                                          + (d("d01") + d("d10") if line == 1 else zero)))
         / norm).alias(f"{prefix}p_over"))

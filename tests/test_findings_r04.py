"""Findings of round 4: the same rows with less read, stored or drawn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from fairline.functions import markets, resampling
from fairline.plans import backtest, evaluation, queries_backtest as qb, queries_pricing as qp, queries_scoring as qs
from fairline.session import stage
from fairline.sources import warehouse


@pytest.mark.parametrize("most", [1e5, 1e9])
def test_draws_in_blocks_equal_draws_at_once(most):
    rng = np.random.default_rng(3)
    start, stride = (rng.integers(0, 2 ** 32, 200, dtype=np.int64) for _ in range(2))
    pnl, n = np.rint(rng.uniform(-most, most, 200)), rng.integers(1, 4, 200).astype(float)
    held = np.zeros((2, 1300))  # not a whole number of blocks
    resampling.add_draws(held, start, stride, pnl, n)
    assert np.array_equal(held, np.stack([pnl, n]) @ resampling.draws(start, stride, 1300).astype(float))


def test_a_bet_draws_once_for_all_bands(spark, monkeypatch):
    units, sums = [], resampling.replicate_sums
    monkeypatch.setattr(resampling, "replicate_sums", lambda df, *rest: units.append(df.count()) or sums(df, *rest))
    selections = qb.selections(spark, SF_DIR)
    rows = {r.band: r for r in backtest.sweep_bands(selections, samples=40).collect()}
    claimed = selections.filter(F.col("edge") >= 0.03)
    assert units == [claimed.filter(F.col("odds").between(1.01, 99.0)).count()]
    for band, row in rows.items():
        inside = claimed.filter(F.col("odds").between(row.odds_min, row.odds_max))
        alone = backtest.with_interval(inside, samples=40).first()
        assert (row.n, row.verdict) == (alone.n, alone.verdict), band
        assert (row.ci_low, row.ci_high) == pytest.approx((alone.ci_low, alone.ci_high), rel=1e-12), band


def test_wide_selections_equal_long_ones_and_move_no_row(spark):
    rows = [("a", 1.4, 1.1, -0.03, 5.0, 4.0), ("b", 0.3, 2.2, 0.05, None, None), ("c", None, 1.0, 0.0, 5.5, 4.1), ("d", None, 1.0, 0.0, None, 4.1),
            ("e", 1.2, 1.0, 0.0, float("nan"), 4.0)]
    df = spark.createDataFrame(rows, "match_id string, lam double, mu double, rho double, corner_lam double, corner_mu double")
    for keys in (None, ("corners8.5_over", "corners8.5_under"), ("1x2_home", "corners8.5_under")):
        options = {"corner_lam": "corner_lam", "corner_mu": "corner_mu", "keys": keys, "digits": 9}
        long = {(r.match_id, r.key): r.prob for r in markets.expand_selections(df, **options).collect()}
        wide = markets.expand_selections(df, wide=True, **options)
        known = lambda v: v is not None and not np.isnan(v)
        assert {(r.match_id, k): r[k] for r in wide.collect() for k in wide.columns[1:] if known(r[k])} == long
        assert {r.match_id for r in wide.collect()} == {m for m, _ in long}
    for query in (qp.goal_selections, qp.corner_selections):
        assert "Exchange" not in query(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_calibrated_selections_are_not_stored(spark, monkeypatch):
    stored = []
    keep = lambda df, name, *rest, **more: stored.append(name) or stage(df, name, *rest, **more)
    for module in (qs, warehouse):
        monkeypatch.setattr(module, "stage", keep)
    monkeypatch.setattr(warehouse, "_STORED", {})
    qs.recalibrate(spark, SF_DIR).collect()
    assert set(stored) == {"matches", "parameters", "folded", "curves"}
    assert stage(qs.calibrated(spark, SF_DIR), "once").count() == qs.graded(spark, SF_DIR).count()


def test_tables_of_a_run_are_made_in_one_pass(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], f"k{i % 5}", float(p), float(rng.random() < p)) for i, p in enumerate(rng.random(900))]
    df = spark.createDataFrame(rows, "group string, key string, prob double, y double")
    sums = evaluation.band_sums(df, ["group", "key"])
    same = lambda one, other, by: [tuple(r) for r in one.orderBy(by).collect()] == [pytest.approx(tuple(r)) for r in other.orderBy(by).collect()]
    for by in (["group"], ["key"]):
        assert same(evaluation.scores_of(sums, by), evaluation.scores(df, by), by)
    numbers = lambda t: t.select("n", "band_low", "predicted", "actual", "gap", "scope").drop("scope")
    assert same(numbers(evaluation.reliability_of(sums)), numbers(evaluation.reliability(df)), ["n", "band_low", "predicted"])
    assert qs.evaluation_tables(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 0


def test_columns_calibrated_on_the_row_equal_selections(spark):
    keys = ("1x2_home", "dc_1x", "ou2.5_under")
    wide = qs.calibrated_wide(spark, SF_DIR, keys, ["match_id"])
    got = {(r.match_id, k): r[f"k{i}"] for r in wide.collect() for i, k in enumerate(keys)}
    rows = qs.calibrated(spark, SF_DIR).filter(F.col("key").isin(*keys)).collect()
    assert got == {(r.match_id, r.key): r.prob for r in rows}
    for query in (qs.coherence, qs.ranked_probability_score):
        assert "hashpartitioning(match_id" not in query(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_long_and_wide_forms_of_scores_agree(spark):
    rng = np.random.default_rng(9)
    keys = evaluation.COHERENT
    wide = [(f"m{i}", *map(float, rng.uniform(0.1, 0.5, len(keys)))) for i in range(40)]
    long = spark.createDataFrame([(m, k, p, k == "1x2_home") for m, *probs in wide for k, p in zip(keys, probs)],
                                 "match_id string, key string, prob double, result boolean")
    row = spark.createDataFrame(wide, ["match_id", *[f"k{i}" for i in range(len(keys))]])
    line = spark.createDataFrame([(m, 0.4, 0.3, 0.3) for m, *_ in wide], "match_id string, q_home double, q_draw double, q_away double")
    asked = [f"k{keys.index(k)}" for k in evaluation.ORDERED]
    arrays = row.select(F.array(*asked).alias("ours"), F.array(F.lit(1), F.lit(0), F.lit(0)).alias("won"),
                        F.array(F.lit(0.4), F.lit(0.3), F.lit(0.3)).alias("line"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    pairs = ((evaluation.rps_table(long, line), evaluation.rps_of(arrays)),
             (evaluation.coherence(long, lambda df: df), evaluation.coherence_of(row, row.columns[1:], lambda df: df)))
    for one, other in pairs:
        one, other = rows(one), rows(other)
        assert len(one) == len(other) > 0 and all(a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-12) for a, b in zip(one, other))

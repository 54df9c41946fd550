"""Operators against brute force, on small tables."""

import datetime
import hashlib
import inspect
import json
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairline import config
from fairline.functions import dates, fits, markets, names, prices, scores, stats
from fairline.operators import matching, ordering, quality, quantiles
from fairline.plans import backtest, calibration, evaluation, insights, ledger, model, selection
from fairline.session import stage
from fairline.sources import layouts, readers, textfiles, warehouse
from fairline.streaming import books


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# -- prices and scores ------------------------------------------------------------------

@pytest.mark.parametrize("method", config.DEVIG_METHODS)
@pytest.mark.parametrize("odds", [(2.1, 3.4, 3.6), (2.0, 3.33, 5.0), (1.3, 5.5, 11.0),
                                  (2.2, 3.6, 4.2), (1.01, 1.01, 1.01)])
def test_devig_sums_to_one_and_keeps_order(spark, method, odds):
    q = one(spark, prices.devig(F.array(*[F.lit(o) for o in odds]), method))[0]
    assert sum(q) == pytest.approx(1.0, abs=1e-12)
    assert sorted(q, reverse=True) == [x for _, x in sorted(zip(odds, q))]


def test_power_exponent_solves_the_market(spark):
    odds = (1.3, 5.5, 11.0)
    q = one(spark, prices.devig(F.array(*[F.lit(o) for o in odds])))[0]
    raw = np.array([1 / o for o in odds])
    lo, hi = 1.0, 20.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (raw ** mid).sum() > 1 else (lo, mid)
    assert np.allclose(q, raw ** lo / (raw ** lo).sum(), atol=1e-10)


def test_devig_rejects_unknown_method():
    with pytest.raises(ValueError):
        prices.devig(None, "guess")


@pytest.mark.parametrize("odds,ok", [((2.0, 3.0, 4.0), True), ((2.0, None, 4.0), False),
                                     ((2.0, 1.0, 4.0), False), ((2.0, float("nan"), 4.0), False)])
def test_partial_market_has_no_price(spark, odds, ok):
    row = one(spark, prices.sane_prices(*[F.lit(o).cast("double") for o in odds]))
    assert (row[0] is not None) == ok


def grid(lam, mu, rho, n=12):
    pmf = lambda m: np.array([math.exp(-m + k * math.log(m) - math.lgamma(k + 1))
                              for k in range(n + 1)])
    g = np.outer(pmf(lam), pmf(mu))
    g[0, 0] *= 1 - lam * mu * rho
    g[0, 1] *= 1 + lam * rho
    g[1, 0] *= 1 + mu * rho
    g[1, 1] *= 1 - rho
    g = np.clip(g, 0, None)
    return g / g.sum()


@pytest.mark.parametrize("lam,mu,rho", [(1.6, 1.1, -0.03), (0.9, 2.2, 0.05), (2.4, 0.6, 0.0)])
def test_selections_come_from_one_distribution(spark, lam, mu, rho):
    df = spark.createDataFrame([("m", lam, mu, rho)], "match_id string, lam double, mu double, rho double")
    got = {r.key: r.prob for r in markets.expand_selections(df).collect()}
    g = grid(lam, mu, rho)
    i, j = np.indices(g.shape)
    assert set(got) == set(markets.GOAL_KEYS)
    assert got["1x2_home"] == pytest.approx(g[i > j].sum(), abs=1e-12)
    assert got["btts_yes"] == pytest.approx(g[1:, 1:].sum(), abs=1e-12)
    assert got["hcp_away+1.5"] == pytest.approx(g[i - j < 2].sum(), abs=1e-12)
    assert got["ou1.5_over"] == pytest.approx(g[i + j > 1.5].sum(), abs=1e-12)
    assert got["tt0.5_away_under"] == pytest.approx(g[:, 0].sum(), abs=1e-12)
    cells = one(spark, scores.score_matrix(F.lit(lam), F.lit(mu), F.lit(rho)))[0]
    assert np.allclose(np.array(cells).reshape(13, 13), g, atol=1e-12)


def test_score_matrix_adds_its_cells_up_once(spark):
    """The sum of the cells is outside the division by it, which runs for every cell."""
    lam, mu, rho = F.lit(1.6), F.lit(1.1), F.lit(-0.9)
    for clip in (True, False):
        grid = scores.score_matrix(lam, mu, rho, 4, clip)
        raw = [[math.exp(-2.7) * 1.6 ** i * 1.1 ** j / math.factorial(i) / math.factorial(j) for j in range(5)] for i in range(5)]
        for (i, j), t in {(0, 0): 1 + 1.76 * 0.9, (0, 1): 1 - 1.6 * 0.9, (1, 0): 1 - 1.1 * 0.9, (1, 1): 1.9}.items():
            raw[i][j] *= t
        flat = [max(c, 0.0) if clip else c for r in raw for c in r]
        assert one(spark, grid)[0] == pytest.approx([c / sum(flat) for c in flat])
        over = sum(c for k, c in enumerate(flat) if k // 5 + k % 5 > 2.5) / sum(flat)
        assert one(spark, scores.over_line(grid, F.lit(2.5), 4))[0] == pytest.approx(over)
    plan = spark.range(1).select(scores.score_matrix(F.rand(1), F.rand(2), F.rand(3)).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"/ aggregate\(", plan)


def test_rows_of_selections_are_compiled_apart_from_the_wide_columns(spark):
    """HotSpot compiles no method of over 8000 bytes; the stage that runs for every selection is far below."""
    df = spark.range(3).selectExpr("CAST(id AS STRING) AS match_id", "1.2D + id AS lam", "1.1D AS mu", "-0.03D AS rho")
    plan = spark._jvm.PythonSQLUtils.explainString(markets.expand_selections(df)._jdf.queryExecution(), "codegen")
    assert min(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)) < 8000
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


@pytest.mark.parametrize("home,away,key,expected", [
    (2, 2, "dnb_home", "void"), (1, 0, "dnb_home", "won"), (3, 1, "hcp_home-1.5", "won"),
    (2, 1, "hcp_home-1.5", "lost"), (0, 1, "hcp_home+1.5", "won"), (0, 0, "btts_no", "won"),
    (2, 1, "ou2.5_over", "won"), (1, 1, "ou2.5_over", "lost"), (0, 3, "tt2.5_away_over", "won")])
def test_settlement(spark, home, away, key, expected):
    row = one(spark, ledger.grade(F.lit(key), F.lit(home), F.lit(away), F.lit(None).cast("int")))
    assert row[0] == expected


def test_corner_pick_without_count_stays_ungraded(spark):
    none = F.lit(None).cast("int")
    assert one(spark, ledger.grade(F.lit("corners8.5_over"), F.lit(1), F.lit(0), none))[0] is None
    assert one(spark, ledger.grade(F.lit("corners8.5_over"), F.lit(1), F.lit(0), F.lit(9)))[0] == "won"


def test_unknown_key_is_an_error(spark):
    with pytest.raises(Exception, match="no known market group"):
        one(spark, markets.group_of(F.lit("xyz_over")))


def test_wilson_behaves_at_the_ends(spark):
    low, high = one(spark, *stats.wilson(F.lit(10.0), F.lit(10)))
    assert 0.7 < low < 1.0 and high == pytest.approx(1.0)
    assert one(spark, *stats.wilson(F.lit(0.0), F.lit(0)))[0] is None


# -- names and dates ---------------------------------------------------------------------

@pytest.mark.parametrize("raw,key", [
    ("AFC Bournemouth", "bournemouth"), ("Sunderland AFC", "sunderland"),
    ("Brighton & Hove Albion FC", "brighton and hove albion"), ("Atlético Madrid", "atletico madrid"),
    ("FC", "fc"), ("1. FC Köln", "fc koln"), ("", ""), (None, ""), ("Nott'm Forest", "nottingham forest")])
def test_names(spark, raw, key):
    assert one(spark, names.normalize(F.lit(raw).cast("string")))[0] == key


def test_resolution_needs_one_candidate(spark):
    teams = spark.createDataFrame([("X", t) for t in (
        "manchester city", "manchester united", "mansfield", "celta vigo")],
        "competition string, candidate string")
    asked = spark.createDataFrame([("X", t) for t in (
        "manchester", "mansfield town", "celta", "celta vigo", "nobody")],
        "competition string, key string")
    got = {r.key: (r.resolved, r.rule) for r in matching.resolve_names(asked, teams).collect()}
    assert got == {"manchester": (None, "none"), "mansfield town": ("mansfield", "shorter"),
                   "celta": ("celta vigo", "longer"), "celta vigo": ("celta vigo", "exact"),
                   "nobody": (None, "none")}


def test_similarity_mapping_matches_brute_force(spark):
    from difflib import SequenceMatcher
    rng = np.random.default_rng(4)
    words = ["red", "blue", "town", "rovers", "athletic", "united", "city", "park"]
    target = sorted({" ".join(rng.choice(words, 3)) for _ in range(40)})
    source = sorted({t[:k] + t[k + 1:] for t in target for k in (2, 5)} | {t[::-1] for t in target})
    frame = lambda xs: spark.createDataFrame([(x, x) for x in xs], "name string, key string")
    got = {r.name: r.score if r.status == "fuzzy" else r.status
           for r in matching.map_names(frame(source), frame(target)).collect()}
    for name in source:
        best = max(SequenceMatcher(None, name, t).ratio() for t in target)
        want = "exact" if name in target else (round(best, 3) if best >= 0.87 else "unmatched")
        assert got[name] == want, name


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.87])
def test_similarity_mapping_of_short_names(spark, threshold):
    from difflib import SequenceMatcher
    rng = np.random.default_rng(8)
    some = lambda n, low: sorted({"".join(rng.choice(list("aab "), rng.integers(low, 8))).strip() for _ in range(n)})
    target, source = some(40, 1), some(60, 0)
    frame = lambda xs: spark.createDataFrame([(x, x) for x in xs], "name string, key string")
    got = {r.name: (r.target, r.score) for r in matching.map_names(frame(source), frame(target), threshold=threshold).collect()}
    for name in set(source) - set(target):
        ranked = sorted((-SequenceMatcher(None, name, t).ratio(), t) for t in target if t and name)
        want = (ranked[0][1], round(-ranked[0][0], 3)) if ranked and -ranked[0][0] >= threshold else (None, None)
        assert got[name] == want, name


def test_matching_ratio_equals_recursive_blocks(spark):
    from difflib import SequenceMatcher
    rng = np.random.default_rng(1)
    some = lambda: "".join(rng.choice(list("abcé "), rng.integers(0, 14)))
    rows = [(some(), some()) for _ in range(500)] + [(None, "a")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", names.matching_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == pytest.approx([None if r.a is None else SequenceMatcher(None, r.a, r.b).ratio() for r in got])


def test_date_spellings(spark):
    rows = spark.createDataFrame([("2026-08-21",), ("2026-08-21 00:00:00",), ("21/08/2026",)], "t string")
    bad = quality.date_problems(rows, "t", dates.iso_day(F.col("t"))).first()
    assert bad.bad_rows == 1 and bad.first_bad == "21/08/2026"
    with pytest.raises(Exception, match="unparseable dates"):
        rows.select(dates.iso_day_or_error(F.col("t"))).collect()
    assert one(spark, dates.uk_day(F.lit("16/08/98")))[0] == datetime.date(1998, 8, 16)


def test_fixture_on_the_day_is_kept_until_the_day_ends(spark):
    day = F.lit("2026-08-21").cast("date")
    at = lambda text: F.lit(text).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    assert one(spark, dates.not_started(day, none, at("2026-08-21 23:00:00")))[0]
    assert not one(spark, dates.not_started(day, at("2026-08-21 12:00:00"), at("2026-08-21 13:00:00")))[0]


# -- order, quantiles, calibration --------------------------------------------------------

def test_running_order_matches_a_global_sort(spark):
    rng = np.random.default_rng(1)
    rows = [(f"id{i}", int(rng.integers(0, 6)), "abc"[int(rng.integers(0, 3))], float(rng.normal()))
            for i in range(400)]
    df = spark.createDataFrame(rows, "id string, day int, comp string, v double")
    got = {r.id: (r.pos, r.cum) for r in ordering.running(
        df, ["day", "comp"], "id", {"pos": F.lit(1), "cum": F.col("v")}).collect()}
    bucket = {r.id: r.b for r in df.select("id", ordering.bucket_of(F.col("id")).alias("b")).collect()}
    total = 0.0
    for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2], bucket[r[0]], r[0])), 1):
        total += r[3]
        assert got[r[0]][0] == i and got[r[0]][1] == pytest.approx(total)
    parts = ordering.equal_count_parts(df, 7, ["day"], "id", "part").groupBy("part").count().collect()
    assert sorted(r["count"] for r in parts) == sorted(len(x) for x in np.array_split(range(400), 7))


@pytest.mark.parametrize("hot", [0, 20, 10_000])
@pytest.mark.parametrize("levels", [["day", "comp"], ["day"], []])
def test_running_order_with_hot_cells(spark, hot, levels):
    """Cells split by bucket, some of them, or none: the same order and sums, restarted or not."""
    rng = np.random.default_rng(8)
    rows = [(f"id{i}", int(rng.integers(0, 4)) ** 2, "abc"[int(rng.integers(0, 3))], float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, day int, comp string, v double")
    bucket = lambda i: hashlib.md5(i.encode()).hexdigest()[:2]
    at = {"day": 1, "comp": 2}
    for by in ([], ["comp"]):
        steps = [c for c in levels if c not in by]
        got = {r.id: (r.pos, r.cum) for r in ordering.running(
            df, steps, "id", {"pos": F.lit(1), "cum": F.col("v")}, by, hot=hot).collect()}
        sums, positions = {}, {}
        for r in sorted(rows, key=lambda r: (*(r[at[c]] for c in steps), bucket(r[0]), r[0])):
            group = tuple(r[at[c]] for c in by)
            sums[group], positions[group] = sums.get(group, 0.0) + r[3], positions.get(group, 0) + 1
            assert got[r[0]][0] == positions[group] and got[r[0]][1] == pytest.approx(sums[group])


def test_running_order_moves_rows_once(spark):
    """Rows meet the cells of their levels as a table; one shuffle carries what only rows have."""
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), (F.col("id") % 5).alias("day"), F.lit(1.5).alias("v"),
                                 F.lit("x").alias("wide"))
    out = ordering.running(df, ["day"], "id", {"cum": F.col("v")})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x and "_bucket" in x]
    assert len(moved) <= 1, plan


def test_best_by_rule_is_one_bet_per_match_and_rule(spark):
    """Each rule keeps what it keeps alone, ties, null ids and repeated bets included; the bets are dealt by match once."""
    rng = np.random.default_rng(9)
    rows = [(None if i % 50 == 0 else f"m{int(rng.integers(0, 60))}", "AB"[int(rng.integers(0, 2))],
             float(rng.integers(0, 4)) / 10, f"b{i // 2}") for i in range(200)]
    df = spark.createDataFrame(rows, "match_id string, market string, edge double, bet_id string")
    rules = ("lowest_edge", "edge", "B")
    out = backtest.best_by_rule(df, rules)
    got = sorted(map(repr, out.collect()))
    assert got == sorted(repr(r) for rule in rules for r in backtest.apply_filters(df, one_per_match=rule)
                         .withColumn("rule", F.lit(rule)).collect())
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(match_id") == 1, plan


def test_stored_tables_are_packed(spark):
    """A table that queries share takes less room than with the session's codec, and has the same rows."""
    build = lambda s, d: s.range(20_000).select(F.concat_ws("-", "id", F.lit("7"), F.col("id") * 3).alias("match_id"), (F.col("id") % 7 / 10).alias("odds"))
    stored, plain = warehouse._stored(spark, "packed", "packed", build), stage(build(spark, ""), "plain")
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
    assert size(stored) < size(plain)
    assert sorted(stored.collect()) == sorted(plain.collect())


def test_a_day_is_counted_before_it_is_weighed(spark):
    """Running totals move whole numbers per key and day, and the weights are put on afterwards."""
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i)
    df = spark.createDataFrame([("a", day(0), 2), ("a", day(0), 1), ("a", day(180), 4)], "k string, date date, g int")
    out = backtest.running_totals(df, ["k"], ("g",))
    weight = lambda d: 2.0 ** (((d - datetime.date(1970, 1, 1)).days - 9000) / 180.0)
    want = {day(0): (2 * weight(day(0)), 3 * weight(day(0)))}
    want[day(180)] = (want[day(0)][0] + weight(day(180)), want[day(0)][1] + 4 * weight(day(180)))
    got = {r.date: (r.w, r.g) for r in out.collect()}
    assert {d: pytest.approx(v) for d, v in want.items()} == got
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(g#" in plan, plan


def test_equal_parts_and_fit_dates_move_no_match(spark):
    """Parts and fit days come from a table of days: a plan has no shuffle or sort merge join of the matches."""
    rng = np.random.default_rng(4)
    rows = sorted({(f"id{i}", datetime.date(2020, 1, 1) + datetime.timedelta(int(d)), "ab"[int(c)], f"t{h}", i)
                   for i, (d, c, h) in enumerate(zip(rng.integers(0, 25, 900), rng.integers(0, 2, 900), rng.integers(0, 4, 900)))})
    df = spark.createDataFrame(rows, "match_id string, date date, competition string, home string, wide int")
    bucket = lambda i: hashlib.md5(i.encode()).hexdigest()[:2]
    order = sorted(rows, key=lambda r: (r[1], r[2], bucket(r[0]), r[0]))
    parts = ordering.equal_count_parts(df, 4, ["date", "competition"], "match_id", "part")
    want = {r[0]: k for k, x in enumerate(np.array_split(range(900), 4), 1) for r in (order[i] for i in x)}
    assert {r.match_id: r.part for r in parts.collect()} == want
    for every in (1, 5, 90):
        fitted = backtest.with_fit_dates(df, 50, every)
        want = {}
        for c in "ab":
            mine = [r for r in order if r[2] == c]
            cut = [sum(r[1] < x[1] for r in mine) for x in mine]
            i0 = next(i for i, n in enumerate(cut) if n >= 50)
            want |= {r[0]: mine[i0 + (i - i0) // every * every][1] for i, r in enumerate(mine) if i >= i0}
        assert {r.match_id: r.fit_date for r in fitted.collect()} == want
        shuffled = [line for line in fitted._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
        assert shuffled and all("rightHint=(strategy=broadcast)" in line for line in shuffled)


def test_exact_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(2)
    values = {"a": np.r_[rng.random(900), np.full(700, 0.5)], "b": rng.beta(0.3, 5, 333)}
    df = stage(spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs],
                                     "g string, p double"), "q")
    levels = quantiles.steps(20)
    for r in quantiles.exact_quantiles(df, ["g"], "p", levels).collect():
        assert r.n == len(values[r.g])
        assert np.allclose(r.edges, np.quantile(values[r.g], levels), atol=1e-15)


def counted_reads(spark, df):
    """A frame that counts how often its rows are read."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    return df.mapInPandas(passed, df.schema), seen


@pytest.mark.parametrize("job", ["bins", "fit", "error"])
def test_bins_are_put_together_from_what_the_quantiles_counted(spark, job):
    rng = np.random.default_rng(7)
    n = 6000
    p = np.round(np.where(rng.random(n) < 0.2, 0.5, rng.beta(2, 3, n)), 3)
    y, g = (rng.random(n) < p).astype(float), rng.integers(0, 2, n)
    fold = rng.integers(1, 5, n)
    rows = stage(spark.createDataFrame([(int(a), int(f), float(v), float(w)) for a, f, v, w in zip(g, fold, p, y)],
                                       "group int, fold int, prob double, y double"), "bins")
    values, seen = counted_reads(spark, rows)
    later = lambda df: df.withColumn("k", F.explode(F.sequence(F.col("fold") + 1, F.lit(5)))).drop("fold")

    def brute(mask, bins):
        edges = np.unique(np.quantile(p[mask], quantiles.steps(bins)))
        slot = np.minimum(np.searchsorted(edges[1:], p[mask], side="right"), len(edges) - 2)
        return {int(i): (int((slot == i).sum()), p[mask][slot == i].sum(), y[mask][slot == i].sum()) for i in set(slot)}

    if job == "error":
        for r in evaluation.calibration_error(values, ["group"]).collect():
            want = sum(abs(a - b) for _, a, b in brute(g == r.group, 20).values()) / (g == r.group).sum()
            assert r.ece == pytest.approx(want, abs=1e-12)
    elif job == "fit":
        for r in calibration.fit(values, ["k", "group"], 40, 500, expand=later, source_by=["fold", "group"]).collect():
            bins = [v for _, v in sorted(brute((g == r.group) & (fold < r.k), 40).items())]
            assert np.allclose(r.x, [a / m for m, a, _ in bins], atol=1e-12)
            assert np.allclose(r.y, np.clip(pava([b / m for m, _, b in bins], [m for m, _, _ in bins]), 1e-4, 1 - 1e-4), atol=1e-12)
    else:
        found = {}
        for r in quantiles.exact_bins(values, ["k", "group"], "prob", quantiles.steps(40),
                                      {"sp": F.col("prob"), "sy": F.col("y")}, later, ["fold", "group"]).collect():
            found.setdefault((r.k, r.group), {})[r.slot] = (r.n, r.sp, r.sy)
        assert len(found) == 8
        for (k, group), got in found.items():
            want = brute((g == group) & (fold < k), 40)
            assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)
    assert seen.value <= 3 * n  # it took four reads, and five with folds


def pava(y, w):
    blocks = []
    for v, k in zip(y, w):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [v for v, _, n in blocks for _ in range(n)]


def test_pooling_is_the_monotone_fit(spark):
    rng = np.random.default_rng(3)
    y, w = np.linspace(0, 1, 60) + rng.normal(0, 0.2, 60), rng.integers(1, 50, 60).astype(float)
    knots = F.array(*[F.struct(F.lit(float(a)).alias("y"), F.lit(float(b)).alias("w"))
                      for a, b in zip(y, w)])
    got = one(spark, calibration.pool_violators(knots))[0]
    assert np.allclose(got, pava(y, w), atol=1e-12) and np.all(np.diff(got) >= -1e-12)


def test_calibration_fixes_a_distorted_forecast(spark):
    rng = np.random.default_rng(0)
    truth = rng.uniform(0.02, 0.98, 8000)
    df = stage(spark.createDataFrame(
        [("ou", float(t ** 1.6), float(rng.random() < t)) for t in truth],
        "group string, prob double, y double"), "cal")
    learned = calibration.fit(df, ["group"])
    moved = calibration.apply(df, learned, ["group"]).toPandas()
    raw = df.toPandas()
    error = lambda p, y: np.abs(p.groupby((p.rank(pct=True) * 10).astype(int)).mean()
                                - y.groupby((p.rank(pct=True) * 10).astype(int)).mean()).mean()
    assert error(moved.prob, moved.y) < error(raw.prob, raw.y) / 3
    thin = calibration.fit(stage(df.limit(500), "thin"), ["group"]).first()
    assert thin.x == [0.0, 1.0] and thin.y == [0.0, 1.0]


# -- fits --------------------------------------------------------------------------------

def league(spark, n=10, rounds=10, seed=0):
    rng = np.random.default_rng(seed)
    att, dfn = rng.normal(0, 0.25, n), rng.normal(0, 0.2, n)
    att, dfn = att - att.mean(), dfn - dfn.mean()
    rows, day, k = [], datetime.date(2020, 1, 1), 0
    for r in range(rounds):
        for i in range(n):
            for j in range(n):
                if i != j:
                    lam, mu = math.exp(0.1 + 0.25 + att[i] - dfn[j]), math.exp(0.1 + att[j] - dfn[i])
                    rows.append((f"m{k}", "L", day + datetime.timedelta(days=k // 8), f"t{i}", f"t{j}",
                                 int(rng.poisson(lam)), int(rng.poisson(mu)),
                                 int(rng.poisson(3 * lam)), int(rng.poisson(3 * mu)), 5, 4))
                    k += 1
    return spark.createDataFrame(rows, "match_id string, competition string, date date, home string, "
                                 "away string, home_goals int, away_goals int, home_sot int, "
                                 "away_sot int, home_corners int, away_corners int"), att, dfn


def test_strength_fit_is_a_stationary_point_and_recovers():
    rng = np.random.default_rng(5)
    n = 8
    att, dfn = rng.normal(0, 0.3, n), rng.normal(0, 0.2, n)
    w = np.where(np.eye(n) == 1, 0.0, 400.0)[None]
    lam = np.exp(0.1 + 0.25 + att[:, None] - dfn[None, :])[None]
    mu = np.exp(0.1 + att[None, :] - dfn[:, None])[None]
    a, d, adv, base = fits.strengths(w, w * lam, w * mu, ridge=1e-9)
    assert np.allclose(a[0] - a[0].mean(), att - att.mean(), atol=1e-6)
    assert np.allclose(d[0] - d[0].mean(), dfn - dfn.mean(), atol=1e-6)
    assert adv[0] == pytest.approx(0.25, abs=1e-6)


def test_implied_means_reprice_the_line():
    rng = np.random.default_rng(6)
    lam, mu, rho = rng.uniform(0.5, 2.8, 500), rng.uniform(0.4, 2.4, 500), rng.uniform(-0.1, 0.1, 500)
    p = fits.outcome_probs(lam, mu, rho)
    start = np.full(500, 1.3)
    l, m, r, resid = fits.implied_means(p[:, 0], p[:, 2], p[:, 1], p[:, 3], np.zeros(500), start, start)
    assert resid.max() < 1e-6 and np.allclose(l, lam, atol=1e-4) and np.allclose(r, rho, atol=1e-3)
    none = np.full(500, np.nan)
    *_, kept, left = fits.implied_means(p[:, 0], p[:, 2], p[:, 1], none, rho, start, start)
    assert left.max() < 1e-6 and np.allclose(kept, rho)


def test_slopes_of_a_price_are_its_derivatives():
    """Also where a low cell is held at zero (the last row)."""
    x = np.array([[0.3, 0.1, 0.05], [-1.0, 0.6, -0.2], [1.9, 1.8, 0.19], [0.0, 0.0, 0.0], [1.5, 1.4, 0.2]])
    at = lambda v: fits.outcome_probs(np.exp(v[:, 0]), np.exp(v[:, 1]), v[:, 2])
    probs, slopes = fits.outcome_probs(np.exp(x[:, 0]), np.exp(x[:, 1]), x[:, 2], slopes=True)
    assert np.array_equal(probs, at(x))
    for i, step in enumerate(np.eye(3) * 1e-6):
        assert np.allclose(slopes[:, :, i], (at(x + step) - at(x - step)) / 2e-6, atol=1e-8)


def test_lines_are_fitted_without_sending_whole_rows(spark):
    rows = spark.createDataFrame([("a", 0.4, 0.3, 0.3, None, 0.0, 1.3, 1.1), ("b", None, None, None, None, 0.0, 1.3, 1.1)],
                                 "match_id string, q_home double, q_draw double, q_away double, q_over double, rho_model double, lam_model double, mu_model double")
    found = model.implied(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" in plan
    a, b = found.orderBy("match_id").collect()
    assert a.lam_market > a.mu_market and a.implied_resid < 0.02 and np.isnan(b.lam_market or np.nan)


def test_refits_use_strictly_earlier_matches_only(spark):
    matches, att, _ = league(spark)
    fits_table = stage(model.refit_by_days(matches, 7, 200), "fits")
    whole = model.fit_strengths(matches, fits_table, chunk=4)
    last = fits_table.orderBy(F.desc("fit_no")).first()
    # Changing what happens on or after the refit day must not move that refit.
    later = matches.withColumn("home_goals", F.when(F.col("date") >= F.lit(last.fit_date), 9)
                               .otherwise(F.col("home_goals")))
    pick = lambda df: df.filter(F.col("fit_no") == last.fit_no).first()
    a, b = pick(whole), pick(model.fit_strengths(later, fits_table, chunk=7))
    assert a.base == pytest.approx(b.base, abs=1e-9) and a.rho == pytest.approx(b.rho, abs=1e-6)
    assert a.n == matches.filter(F.col("date") < F.lit(last.fit_date)).count()
    got = np.array([a.teams[f"t{i}"]["attack"] for i in range(10)])
    assert np.corrcoef(got, att)[0, 1] > 0.8


# -- picks and ledger -----------------------------------------------------------------------

PICK = ("match_id string, date date, match string, key string, group string, prob double, "
        "fair_odds double, odds double, hit_rate double, hit_rate_predicted double, "
        "hit_rate_n long, validated boolean, implied_resid double")


def picks(spark, rows):
    base = dict(date=datetime.date(2026, 8, 14), key="1x2_home", group="1x2", odds=None, hit_rate=None,
                hit_rate_predicted=None, hit_rate_n=0, validated=True, implied_resid=None)
    full = []
    for i, r in enumerate(rows):
        d = {**base, "match_id": f"m{i}", "match": f"m{i}", **r}
        d.setdefault("fair_odds", round(1 / d["prob"], 6))
        full.append(tuple(d[c.split()[0]] for c in PICK.split(", ")))
    return spark.createDataFrame(full, PICK)


def test_price_bands_include_both_ends(spark):
    p = picks(spark, [{"prob": 0.625, "fair_odds": 1.6}])
    slate = selection.daily_slate(p).collect()
    assert sorted(r.band for r in slate) == ["main", "safe"]


def test_overstating_band_is_demoted(spark):
    p = picks(spark, [
        {"prob": 0.60, "hit_rate": 0.50, "hit_rate_predicted": 0.60, "hit_rate_n": 500},
        {"prob": 0.58, "hit_rate": 0.60, "hit_rate_predicted": 0.58, "hit_rate_n": 500}])
    assert selection.best_of_day(p).first().match_id == "m1"


def test_hit_rates_of_picks_are_looked_up_by_band(spark):
    """Own band where it has rows enough, else the pooled one; below the first edge the first band; a scope may lack bands. No pick carries the table."""
    table = spark.createDataFrame([("all", 0.5, 0.6, 900, 0.55, 0.50), ("all", 0.6, 0.7, 900, 0.65, 0.61), ("all", 0.7, 1.0, 900, 0.8, 0.78),
                                   ("ou", 0.6, 0.7, 300, 0.65, 0.64), ("ou", 0.7, 1.0, 20, 0.8, 0.9)],
                                  "scope string, band_low double, band_high double, n long, predicted double, actual double")
    picks = spark.createDataFrame([("ou", 0.1), ("ou", 0.6), ("ou", 0.65), ("ou", 0.99), ("dc", 0.1), ("dc", 0.7), ("dc", None)], "group string, prob double")
    found = selection.attach_hit_rates(picks, table)
    assert found.columns == ["group", "prob", "hit_rate", "hit_rate_predicted", "hit_rate_n", "validated"]
    rows = {(r["group"], r.prob): (r.hit_rate, r.hit_rate_predicted, r.hit_rate_n, r.validated) for r in found.collect()}
    assert rows == {("ou", 0.1): (0.64, 0.65, 300, True), ("ou", 0.6): (0.64, 0.65, 300, True), ("ou", 0.65): (0.64, 0.65, 300, True),
                    ("ou", 0.99): (0.78, 0.8, 900, False), ("dc", 0.1): (0.5, 0.55, 900, True), ("dc", 0.7): (0.78, 0.8, 900, True),
                    ("dc", None): (0.5, 0.55, 900, None)}
    assert "map_from_entries" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_headline_markets_move_a_row_per_fixture_once(spark):
    picks = spark.createDataFrame([(m, "d", "C", "a v b", k, i / 10) for m in ("x", "y") for i, k in enumerate(selection.HEADLINE_KEYS)]
                                  + [("x", "d", "C", "a v b", "dc_1x", 0.9)], "match_id string, date string, competition string, match string, key string, prob double")
    wide = selection.headline_markets(picks)
    assert [tuple(r) for r in wide.orderBy("match_id").collect()] == [(m, "d", "C", "a v b", *[i / 10 for i in range(7)]) for m in ("x", "y")]
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan[:plan.find("Initial Plan") if "Initial Plan" in plan else None].count("Exchange") == 1


def test_the_ledger_is_settled_from_stored_rows(spark):
    """The picks are ranked and the results drawn once, however often settlement reads them."""
    from conftest import SF_DIR
    from fairline.plans import queries_ledger
    for rows in (queries_ledger.ledger_rows, queries_ledger.results, queries_ledger.slip_rows):
        plan = rows(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan and "md5" not in plan, rows.__name__


def test_accumulator_takes_one_leg_per_fixture(spark):
    p = picks(spark, [{"match_id": "a", "prob": 0.7}, {"match_id": "a", "key": "ou1.5_over", "prob": 0.69},
                      {"match_id": "b", "prob": 0.5}])
    slip = selection.best_accumulators(p, sizes=[2], target_odds=1.9).first()
    assert [s.match_id for s in slip.selections] == ["a", "b"]
    assert slip.probability == pytest.approx(0.35) and slip.offered_odds is None
    assert selection.best_accumulators(p, sizes=[3], target_odds=1.9).count() == 0


def test_ceiling_stops_at_thin_or_overstated_band(spark):
    rows = [("ou", 0.5, 0.6, 500, 0.55, 0.55), ("ou", 0.6, 0.7, 500, 0.65, 0.64),
            ("ou", 0.7, 0.75, 500, 0.72, 0.60), ("ou", 0.75, 0.8, 500, 0.77, 0.77),
            ("tt", 0.5, 0.6, 100, 0.55, 0.55)]
    table = spark.createDataFrame(rows, "scope string, band_low double, band_high double, n long, "
                                  "predicted double, actual double")
    got = {r.group: r.ceiling for r in selection.group_ceilings(table).collect()}
    assert got == {"ou": 0.7, "tt": 0.0}


@pytest.mark.parametrize("drift,outcome", [(0, "won"), (7, "won"), (8, "pending")])
def test_postponement_window(spark, drift, outcome):
    day = datetime.date(2026, 8, 14)
    book = spark.createDataFrame([("p", day, "X", "a town", "b", "1x2_home", 2.5, "pending")],
                                 "pick_id string, day date, competition string, home string, away string, "
                                 "key string, odds double, outcome string")
    results = spark.createDataFrame([("r", "X", "a", "b", day + datetime.timedelta(days=drift), 1, 0, None)],
                                    "result_id string, competition string, home string, away string, "
                                    "date date, home_goals int, away_goals int, total_corners int")
    row = ledger.settle(book, results).first()
    assert row.outcome == outcome and row.pnl == (1.5 if outcome == "won" else None)


def test_slip_waits_for_every_leg_and_drops_void_legs(spark):
    leg = lambda h, k, o: {"date": "2026-08-14", "competition": "X", "home": h, "away": "b", "key": k, "odds": o}
    slips = spark.createDataFrame([
        ("s1", json.dumps([leg("a", "1x2_home", 2.0), leg("c", "dnb_home", 1.5)])),
        ("s2", json.dumps([leg("a", "1x2_home", 2.0), leg("z", "1x2_home", 1.5)])),
        ("s3", json.dumps([leg("a", "1x2_home", None), leg("c", "1x2_draw", 3.0)])),
        ("s4", "not json")], "issued string, selections string")
    slips = slips.withColumns({"leg_list": readers.legs_from_json(F.col("selections")),
                               "outcome": F.lit("pending")})
    day = datetime.date(2026, 8, 15)
    results = spark.createDataFrame([("r1", "X", "a", "b", day, 2, 0, None), ("r2", "X", "c", "b", day, 1, 1, None)],
                                    "result_id string, competition string, home string, away string, "
                                    "date date, home_goals int, away_goals int, total_corners int")
    got = {r.issued: (r.outcome, r.pnl, r.legs_void) for r in ledger.settle_slips(slips, results).collect()}
    assert got == {"s1": ("won", 1.0, 1), "s2": ("pending", None, None), "s3": ("won", None, 0),
                   "s4": ("pending", None, None)}


def test_stream_replay_writes_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame([("d1", datetime.date(2026, 8, 14), 1), ("d1", datetime.date(2026, 8, 14), 2),
                                  ("old", datetime.date(2026, 8, 1), 1)], "k string, day date, arrival int")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(src)
    for ck in ("ck1", "ck2"):
        stream = spark.readStream.schema(rows.schema).parquet(src)
        books.record_picks(stream, out, str(tmp_path / ck), ["k"], ["arrival"],
                           F.lit("2026-08-10").cast("date")).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert [(r.k, r.arrival) for r in got] == [("d1", 1)]


def test_streams_of_picks_and_results_meet_over_micro_batches(spark, tmp_path):
    day = datetime.date(2026, 8, 15)
    after = lambda n: day + datetime.timedelta(days=n)
    asked = "pick_id string, day date, competition string, home string, away string, key string, odds double"
    columns = "result_id string, competition string, home string, away string, date date, home_goals int, away_goals int, total_corners int"
    names = spark.createDataFrame([("X", "leeds united", "leeds")], "competition string, key string, resolved string")
    pick = lambda i, home, away, on=day, key="1x2_home": (i, on, "X", home, away, key, 2.0)
    result = lambda i, home, away, on, hg, ag: (i, "X", home, away, on, hg, ag, None)
    batches = [
        ([pick("exact", "leeds", "hull"), pick("spelt", "leeds united", "hull"), pick("put off", "york", "bury"), pick("corners", "york", "bury", key="corners9.5_over")],
         [result("r1", "leeds", "hull", day, 2, 0), result("r9", "ayr", "wigan", after(-3), 1, 1)]),
        ([pick("recorded late", "ayr", "wigan"), pick("never", "ayr", "hull")], [result("r2", "york", "bury", after(7), 0, 1)]),
        ([pick("waits", "hull", "york", after(90))], [result("r3", "york", "bury", after(8), 5, 0), result("r4", "x", "y", after(90), 0, 0)])]
    src, out = tmp_path / "in", str(tmp_path / "out")
    for side in ("picks", "results"):
        (src / side).mkdir(parents=True)
    for picks, results in batches:
        spark.createDataFrame(picks, asked).coalesce(1).write.mode("append").parquet(str(src / "picks"))
        spark.createDataFrame(results, columns).coalesce(1).write.mode("append").parquet(str(src / "results"))
        books.meet_results(spark.readStream.schema(asked).parquet(str(src / "picks")), spark.readStream.schema(columns).parquet(str(src / "results")), names, out,
                           str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.pick_id, r.outcome, r.result_id, r.pnl) for r in books.read_settled(spark.read.parquet(out)).collect())
    assert got == [("exact", "won", "r1", 1.0), ("never", "overdue", None, None), ("put off", "lost", "r2", -1.0), ("recorded late", "lost", "r9", -1.0),
                   ("spelt", "won", "r1", 1.0)]


def test_slips_wait_for_their_last_leg_and_take_nearer_results(spark, tmp_path):
    day = datetime.date(2026, 8, 15)
    schema = ("issued string, legs int, leg_no int, day date, odds double, played_on date, result_id string, _out string")
    leg = lambda slip, n, i, out, drift=0, odds=2.0: (slip, 2, n, day, odds, day + datetime.timedelta(days=drift), i, out)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    seen = []
    for batch in ([leg("a", 0, "r1", "won"), leg("b", 0, "r2", "won", 3), leg("b", 1, "r3", "won"), leg("c", 0, None, None)],
                  [leg("a", 1, "r4", "void"), leg("b", 0, "r5", "lost", 1)], [leg("c", 0, "r6", "won"), leg("c", 1, "r7", None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        books.grade_slips(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck")).awaitTermination()
        seen.append(sorted((r.issued, r.outcome, r.legs_won, r.legs_void, r.pnl) for r in books.read_slips(spark, out).collect()))
    assert seen == [[("b", "won", 2, 0, 3.0)], [("a", "won", 1, 1, 1.0), ("b", "lost", 1, 0, -1.0)], [("a", "won", 1, 1, 1.0), ("b", "lost", 1, 0, -1.0)]]


def test_slips_are_graded_in_few_batches_however_many_files_the_join_left(spark, tmp_path):
    day = datetime.date(2026, 8, 15)
    rows = [(f"s{i}", 2, leg, day, 2.0, day, f"r{i}-{leg}", "won") for i in range(60) for leg in (0, 1)]
    schema = "issued string, legs int, leg_no int, day date, odds double, played_on date, result_id string, _out string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).repartition(24).write.parquet(src)  # the session has 8 shuffle partitions
    books.grade_slips(books.stream_met(spark, src), out, str(tmp_path / "ck")).awaitTermination()
    assert len([f for f in os.listdir(out) if f.startswith("batch=")]) == 3
    assert [(r.outcome, r.legs_won, r.pnl) for r in books.read_slips(spark, out).collect()] == [("won", 2, 3.0)] * 60


def test_recording_opens_only_the_days_it_brings(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{d}", datetime.date(2026, 8, d), 1) for d in range(1, 9)], "k string, day date, arrival int")
    books._write_batch(rows, str(tmp_path), 0, ["day"])
    stored = books.of_days(books.read_batches(spark, str(tmp_path), rows.schema, before=1), rows.filter("day > '2026-08-06'"))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "day" in filters and "batch" in filters and {r.k for r in stored.collect()} == {"k7", "k8"}


# -- files and plans ---------------------------------------------------------------------------

def test_quote_files_with_different_headers(spark, tmp_path):
    (tmp_path / "odds_a.csv").write_text("fetched_at,date,home_odds,home_key\n2026-08-11,2026-08-21,1.5,x\n")
    (tmp_path / "odds_b.csv").write_text("over25_odds,date,home_odds,fetched_at,home_key\n1.9,2026-08-22 00:00:00,bad,2026-08-11,y\n")
    schema = "fetched_at timestamp, date string, home_odds double, over25_odds double, home_key string"
    got = readers.read_fixture_files(spark, [str(tmp_path / f) for f in ("odds_a.csv", "odds_b.csv")], schema)
    rows = {r.home_key: (r.home_odds, r.over25_odds, r.date.day) for r in got.collect()}
    assert rows == {"x": (1.5, None, 21), "y": (None, 1.9, 22)}


def test_books_keep_unreadable_rows_apart(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("day,prob,n,note\n2026-08-14,0.5,3,fine\n2026-08-15,zero,x,two cells\n2026-08-16,0.25\n,,4.0,\"a, b\"\n1,2,3,4,5,6\n")
    (tmp_path / "csv" / "b.csv").write_text("n,day,extra\n7,2026-08-17,z\n")
    schema = "day string, prob double, n int, note string, gone double"
    found = textfiles.read_book(spark, str(tmp_path / "csv"), schema)
    rows = sorted((r._problem or "", r.day or "", r.prob, r.n, r.note, r.gone) for r in found.collect() if r._problem != "line")
    assert rows == [("", "", None, 4, "a, b", None), ("", "2026-08-14", 0.5, 3, "fine", None), ("", "2026-08-17", None, 7, None, None),
                    ("prob,n", "2026-08-15", None, None, "two cells", None)]
    assert sorted(r._line for r in textfiles.broken(found).collect() if r._line) == ["1,2,3,4,5,6", "2026-08-16,0.25"]
    assert textfiles.sound(found).columns == ["day", "prob", "n", "note", "gone"]
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"day": "2026-08-14", "prob": 0.5, "n": 3.0}\n{"day": "2026-08-15", "prob": "x"}\n{broken\n')
    got = textfiles.read_book(spark, str(tmp_path / "json"), schema, "json")
    assert sorted((r._problem or "", r.prob or 0.0, r.n or 0) for r in got.collect()) == [("", 0.5, 3), ("line", 0.0, 0), ("prob", 0.0, 0)]
    table = spark.createDataFrame([("a", 1.23456789, None), (None, None, 2)], "day string, prob double, n int")
    textfiles.write_csv(table, str(tmp_path / "out"))
    back = textfiles.sound(textfiles.read_book(spark, str(tmp_path / "out"), "day string, prob double, n int"))
    assert sorted(map(tuple, back.collect()), key=str) == [("a", 1.23457, None), (None, None, 2)]
    with pytest.raises(ValueError):
        textfiles.read_book(spark, str(tmp_path / "out"), schema, "xml")


def test_rows_of_a_batch_are_fitted_as_if_alone():
    rng = np.random.default_rng(9)
    lam, mu, rho = rng.uniform(0.4, 3.0, 40), rng.uniform(0.3, 2.5, 40), rng.uniform(-0.15, 0.15, 40)
    home, away, draw, over = fits.outcome_probs(lam, mu, rho).T
    over[::3] = np.nan
    start = np.full(40, 1.3)
    asked = (home, draw, away, over, np.where(np.isnan(over), rho, 0.0), start, start)
    whole = fits.implied_means(*asked)
    for i in range(40):
        alone = fits.implied_means(*(a[i:i + 1] for a in asked))
        assert all(np.allclose(w[i], a[0], atol=1e-9) for w, a in zip(whole, alone))
    assert whole[3].max() < 1e-6 and np.allclose(whole[0], lam, atol=1e-4)


def test_price_ladder():
    both = ["MaxCH", "MaxCD", "MaxCA", "AvgCH", "AvgCD", "AvgCA", "B365H", "B365D", "B365A"]
    assert layouts.pick_price_columns(both)[2] == "closing"
    assert layouts.pick_price_columns(both[6:])[2] == "single-book"
    assert layouts.pick_price_columns(["x"]) == (None, None, None)


def test_bootstrap_interval_covers_the_mean(spark):
    rng = np.random.default_rng(8)
    pnl = rng.normal(0.5, 10, 3000)
    df = spark.createDataFrame([(str(i), float(v), 1.0) for i, v in enumerate(pnl)],
                               "unit string, pnl double, n double")
    row = backtest.bootstrap(df, "unit", samples=400, stake=10.0).first()
    draws = [rng.choice(pnl, len(pnl)).mean() * 10 for _ in range(400)]
    assert row.ci_low == pytest.approx(np.percentile(draws, 2.5), abs=1.0)
    assert row.ci_high == pytest.approx(np.percentile(draws, 97.5), abs=1.0)


def test_dense_replicates_equal_drawn_units(spark):
    from fairline.functions import resampling

    rng = np.random.default_rng(4)
    data = [(None if i % 3 == 0 else "ab"[i % 2], i % 5, f"u{i}", round(float(v), 2), float(1 + i % 2)) for i, v in enumerate(rng.normal(0, 10, 700))]
    df = spark.createDataFrame(data, "g string, h int, unit string, pnl double, n double").repartition(3)
    got = {(r.g, r.h, r.replicate): (r.pnl, r.n) for r in resampling.replicate_sums(df, "unit", ["g", "h"], 30, 42).collect()}
    want = {}
    for g, h, unit, pnl, n in data:
        digest = hashlib.md5(f"42|{unit}".encode()).hexdigest()
        start, stride = int(digest[:8], 16), int(digest[8:16], 16) | 1
        for r in range(30):
            u = (start + r * stride) % 2 ** 32 / 2 ** 32
            cdf, k = math.exp(-1), 0
            while u >= cdf and k < 9:
                k += 1
                cdf += math.exp(-1) / math.factorial(k)
            old = want.get((g, h, r), (0.0, 0.0))
            want[g, h, r] = (old[0] + k * pnl, old[1] + k * n)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


def test_intervals_rest_on_all_the_replicates_by_default(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(str(i), float(v), 1.0) for i, v in enumerate(rng.normal(0.5, 10, 200))],
                               "unit string, pnl double, n double")
    assert config.BOOTSTRAP_SAMPLES == 5000
    assert backtest.bootstrap(df, "unit").first() == backtest.bootstrap(df, "unit", samples=5000).first()
    assert backtest.bootstrap(df, "unit").first() != backtest.bootstrap(df, "unit", samples=400).first()
    for f in (backtest.bootstrap, backtest.with_interval, backtest.sweep_bands, backtest.validate, insights.market_split):
        assert inspect.signature(f).parameters["samples"].default == config.BOOTSTRAP_SAMPLES


def test_plans_have_no_row_udf_cartesian_or_global_window(spark):
    from conftest import SF_DIR
    from fairline.plans import registry
    queries = registry.queries()
    for name in ("long_card", "shortlist", "settle_picks", "equity_curve", "upcoming_fixtures"):
        plan = queries[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan, name
    plan = queries["upcoming_fixtures"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2

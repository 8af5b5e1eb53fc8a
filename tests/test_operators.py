"""Known answers, worked by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan.operators import importance, intervals, metrics, selection, smearing, spatial
from fieldspan.plans import deal, near


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(8)
    o = rng.gamma(3, 7, 60)
    p = 0.7 * o + rng.normal(size=60) * 2 + 1
    r = metrics.calc_metrics(spark.createDataFrame(list(zip(o.tolist(), p.tolist())), "obs double, pred double")).first()
    e = p - o
    assert r["ccc"] == pytest.approx(2 * ((o - o.mean()) * (p - p.mean())).mean() / (o.var() + p.var() + (o.mean() - p.mean()) ** 2))
    assert (r["mae"], r["rmse"], r["bias"], r["bias_pct"]) == pytest.approx((abs(e).mean(), math.sqrt((e * e).mean()), e.mean(), 100 * e.mean() / o.mean()))


def test_a_perfect_prediction(spark):
    r = metrics.calc_metrics(spark.createDataFrame([(v, v) for v in (2.5, 3.0, 7.25)], "obs double, pred double")).first()
    assert (r["ccc"], r["mae"], r["rmse"], r["bias"]) == (1, 0, 0, 0)


def test_metrics_without_enough_rows_are_null(spark):
    r = metrics.calc_metrics(spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (None, 1.0)], "obs double, pred double")).first()
    assert r["n"] == 1 and all(r[c] is None for c in ("ccc", "r2", "mae", "nse", "rmse", "rpd", "mqi", "bias"))


def test_constant_prediction(spark):
    r = metrics.calc_metrics(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "obs double, pred double")).first()
    assert r["ccc"] == 0 and r["r2"] is None


def test_conformal_quantile_is_an_order_statistic(spark):
    score = np.random.default_rng(9).permutation(137) / 4
    df = spark.createDataFrame([(3.0, 3.0 + float(v)) for v in score], "obs double, pred double")
    k = math.ceil(138 * 0.9)
    assert tuple(intervals.conformal_point(df).select("k", "q").first()) == (k, np.sort(score)[k - 1])
    assert math.isinf(intervals.conformal_point(df.limit(7)).first()["q"])


def test_conformal_groups_weigh_alike(spark):
    # Three groups of one row with scores 1, 2 and 4, and one of forty rows with score 3: each group counts once.
    rows = [(g, 0.0, s) for g, s in (("a", 1.0), ("b", 2.0), ("d", 4.0))] + [("c", 0.0, 3.0)] * 40
    df = spark.createDataFrame(rows, "g string, obs double, pred double")
    assert [intervals.conformal_group(df, "g", alpha).first()["q"] for alpha in (0.5, 0.3)] == [3, 4]


def test_smearing_factor_is_the_mean_of_exponentials(spark):
    e = np.random.default_rng(10).normal(size=80) / 3
    df = spark.createDataFrame([(2.0 + float(v), 2.0) for v in e], "obs_t double, pred_t double")
    factor = smearing.smearing_factor(df)
    assert factor.first()["s"] == pytest.approx(np.exp(e).mean())
    x = spark.createDataFrame([(0.9,)], "pred_t double")
    assert smearing.smear(x, factor).first()["mean_surface"] == pytest.approx(math.exp(0.9) * np.exp(e).mean() - 1)


def test_dissimilarity_is_in_units_of_the_mean_distance(spark):
    t = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [6.0, 8.0])], "id long, v array<double>")
    unit = spatial.di_reference(t)
    assert unit.first()["avg_dist"] == pytest.approx(20 / 3)
    got = spatial.dissimilarity(t, spark.createDataFrame([(9, [6.0, 3.0])], "id long, v array<double>"), unit.select("avg_dist")).first()["di"]
    assert got == pytest.approx(math.sqrt(10) / (20 / 3))


def test_rows_without_a_fold_are_only_neighbours(spark):
    t = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [5.0], 1), (4, [2.0], None), (5, [2.0], None)], "id long, v array<double>, fold int")
    unit = spark.createDataFrame([(1.0,)], "avg_dist double")
    assert {r["id"]: r["di"] for r in spatial.cross_fold_di(t, unit).collect()} == {1: 2, 2: 1, 3: 3}


def test_correlogram_crosses_the_date_line_and_nears_the_pole(spark):
    rng = np.random.default_rng(11)
    rows = [(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(zip([179.9, -179.9, 10, 190 - 360, 170, 0.1, -0.1] * 6, np.r_[rng.uniform(-1, 1, 21), rng.uniform(85, 90, 21)], rng.normal(size=42)))]
    breaks, pairs = [0.0, 60.0, 250.0], [0, 0]
    for i, x, y, _ in rows:
        for j, u, v, _ in rows[:i]:
            a, b, d = math.radians(y), math.radians(v), math.radians(x - u)
            h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(d / 2) ** 2
            far = 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))
            for k in (0, 1):
                pairs[k] += breaks[k] <= far < breaks[k + 1]
    got = spatial.correlogram(spark.createDataFrame(rows, "id int, x double, y double, value double"), breaks, lonlat=True).collect()
    assert {r["class"]: r["n_pairs"] for r in got} == {k + 1: n for k, n in enumerate(pairs) if n}


def test_deal_of_largest_first(spark):
    df = spark.createDataFrame([(g,) for g, n in zip("abcde", (9, 5, 4, 3, 2)) for _ in range(n)], "g string")
    assert {r["group"]: r["fold"] for r in deal(df, "g", 2, 1).collect()} == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 2}


def test_near_is_inclusive(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0), (3, 9.0, 9.0)], "id int, x double, y double")
    b = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    assert {r["id"] for r in near(a, b, 1.0).collect()} == {1, 2}
    assert {r["id"] for r in near(a, b, 1.0, metric="euclidean").collect()} == set()


def test_shapley_adds_up(spark):
    v = spark.createDataFrame([(1, m, float((m & 1) * 3 + (m >> 1 & 1) * 5 + 2 * (m == 3))) for m in range(4)], "id int, mask int, v double")
    assert {r["player"]: r["phi"] for r in importance.shapley(v, 2).collect()} == {0: 4.0, 1: 6.0}


def test_t_interval():
    low, high, p = selection.t_interval(1.0, 0.5, 8)
    assert high == pytest.approx(1 + 0.5 * 2.306004, abs=1e-4) and low == pytest.approx(1 - 0.5 * 2.306004, abs=1e-4)
    assert p == pytest.approx(0.0805, abs=1e-3)


def test_infinite_bounds_cover(spark):
    df = spark.createDataFrame([(1.0, float("-inf"), float("inf"))], "obs double, lower double, upper double")
    assert metrics.coverage(df).select(F.col("picp")).first()[0] == 1


@pytest.mark.parametrize("runs", [1_000_000, 40])
def test_cv_plus_takes_all_scores_of_all_folds(spark, monkeypatch, runs):
    monkeypatch.setattr(intervals, "RUNS", runs)
    rng = np.random.default_rng(4)
    score, fold = np.round(rng.gamma(2, 50, 6000), 1), rng.integers(0, 5, 6000)
    mu = rng.normal(size=(30, 5)) * 200
    mu[0] = 7.0
    at = spark.createDataFrame([(i % 29, [float(v) for v in m]) for i, m in enumerate(mu)] + [(40, [1.0, None, 1.0, 1.0, 1.0])], "id long, mu array<double>")
    cal = spark.createDataFrame(list(zip(fold.tolist(), score.tolist())), "fold int, score double")
    r = math.ceil(6001 * 0.9) - 1
    want = sorted((i % 29, -np.sort(-m[fold] + score)[r], np.sort(m[fold] + score)[r]) for i, m in enumerate(mu))
    got = sorted(map(tuple, intervals.cv_plus(cal, at).where("id < 40").collect()))
    assert got == want
    assert tuple(intervals.cv_plus(cal, at).where("id = 40").first())[1:] == (None, None)
    few = intervals.cv_plus(cal.limit(5), at).where("id = 3").first()
    assert (few["lower"], few["upper"]) == (-math.inf, math.inf)


def test_the_unit_of_dissimilarity_is_of_all_pairs(spark):
    v = np.random.default_rng(5).normal(size=(2300, 3))
    v[2000:] *= 20
    got = spatial.di_reference(spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(v)], "id long, v array<double>")).first()
    want = sum(np.sqrt(((v[i + 1 :] - r) ** 2).sum(1)).sum() for i, r in enumerate(v))
    assert got["n_pairs"] == 2300 * 2299 // 2 and got["avg_dist"] == pytest.approx(want / got["n_pairs"])


def test_order_statistics_of_odd_scores(spark):
    rng = np.random.default_rng(12)
    score = np.r_[np.zeros(40), np.full(300, 2.5), rng.lognormal(0, 6, 500), np.full(200, 1e-300), [1e300]]
    fold = rng.integers(0, 3, len(score))
    df = spark.createDataFrame(list(zip(fold.tolist(), score.tolist(), [0.0] * len(score))), "fold int, obs double, pred double")
    for alpha in (0.01, 0.1, 0.35, 0.5, 0.62, 0.8, 0.97):
        k = math.ceil((len(score) + 1) * (1 - alpha))
        assert intervals.conformal_point(df, alpha).first()["q"] == np.sort(score)[k - 1]
        got = {r["fold"]: r["width"] / 2 for r in intervals.conformal_cv(df, alpha).select("fold", "width").distinct().collect()}
        for f in range(3):
            others = np.sort(score[fold != f])
            assert got[f] == others[math.ceil((len(others) + 1) * (1 - alpha)) - 1]
    assert tuple(intervals.conformal_point(df.where("false")).first()) == (0, 1, math.inf)

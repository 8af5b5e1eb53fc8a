import numpy as np
import pytest

from fieldspan import models, more_queries, queries
from fieldspan.models import explain, mapping, network
from fieldspan.plans import matched_folds


@pytest.mark.parametrize("layer", ["plain", "residual", "squeeze", "two"])
def test_gradients_equal_finite_differences(layer):
    rng = np.random.default_rng(1)
    cfg = {"channels": [3], "embedding": 4, "residual": layer == "residual", "squeeze": layer == "squeeze", "padding": "same" if layer == "two" else "valid"}
    net = network.cnn(rng, 2, [1, 3] if layer == "two" else [3], cfg)
    x = rng.normal(size=(3, 2, 3, 3))
    g, h = network.gradient(net, x), 1e-6
    for i in np.ndindex(2, 3, 3):
        up, down = x.copy(), x.copy()
        up[(slice(None), *i)] += h
        down[(slice(None), *i)] -= h
        assert np.allclose((network.predict(net, up) - network.predict(net, down)) / (2 * h), g[(slice(None), *i)], atol=1e-5)


def test_networks_learn():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 18))
    y = x[:, 4] + 0.5 * x[:, 13]
    for name, cfg in (("mlp", {"hidden": [16]}), ("cnn", {"windows": [1, 3], "channels": [6]})):
        spec = models.get_model(name)
        fitted = spec.fit(x[:400], y[:400], x[400:500], y[400:500], cfg, 1)
        assert np.corrcoef(spec.predict(fitted, x[500:]), y[500:])[0, 1] > 0.9


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    return spark.createDataFrame([(i, [float(v) for v in r], float(2 * r[0] - r[1]), i % 4) for i, r in enumerate(x)], "sample_id long, x array<double>, y double, fold int")


def test_shapley_values_of_a_line(spark, table):
    m = models.fit_one(table, "line", {})
    b = explain.background_rows(table, 3)
    x = {r["sample_id"]: r["x"] for r in table.collect()}
    for r in explain.kernel_shap(table, "line", m, b).collect():
        assert r["phi"] == pytest.approx(m[1:][r["player"]] * (x[r["id"]][r["player"]] - np.mean([z[r["player"]] for z in b])), abs=1e-6)


def test_gradients_add_up(spark, table):
    m = models.fit_one(table, "mlp", {"hidden": [8], "epochs": 20})
    for r in explain.gradient_shap(table, m, 400).collect():
        assert sum(r["phi"]) == pytest.approx(r["pred"] - r["base"], abs=0.05)


def test_permutation_finds_the_variable(spark, table):
    raw = explain.permutation_importance(table, "line", models.fit_one(table, "line", {}), ["a", "b", "c"], 2)
    means = {r["variable"]: r["m"] for r in raw.groupBy("variable").avg("drop").toDF("variable", "m").collect()}
    assert means["a"] > means["b"] > abs(means["c"])


def test_a_failing_unit_is_a_row(spark, table):
    got = models.fit_units(table, models.units(spark, [{}], [0]), "cnn").collect()
    assert [r["status"] for r in got] == ["error"]


@pytest.mark.parametrize(("model", "cfg"), [("line", {}), ("mlp", {"hidden": [4], "epochs": 3})])
def test_a_bounded_fit_scores_every_held_out_row(spark, table, model, cfg):
    got = models.fit_units(table, models.units(spark, [cfg, cfg | {"without": 1}], [0, 1]), model, max_rows=40).collect()
    for c in ("cfg_001", "cfg_002"):
        assert sorted(r["sample_id"] for r in got if r["config_id"] == c) == [i for i in range(80) if i % 4 < 2]
    assert all(r["status"] == "success" for r in got)


def test_a_line_is_fitted_on_all_rows(spark, table):
    rows = table.collect()
    a, y, held = np.array([[1.0, *r["x"]] for r in rows]), np.array([r["y"] + r["sample_id"] % 3 for r in rows]), np.array([r["fold"] == 1 for r in rows])
    df = spark.createDataFrame([(r["sample_id"], r["x"], float(v), r["fold"]) for r, v in zip(rows, y)], table.schema)
    want = a @ np.linalg.lstsq(a[~held], y[~held], rcond=None)[0]
    got = models.fit_units(df, models.units(spark, [{"ridge": 0.0}], [1]), "line", max_rows=10).collect()
    assert len(got) == 20 and all(r["pred"] == pytest.approx(want[r["sample_id"]]) and r["n_train"] == 60 for r in got)


def test_tiles_do_not_show(spark):
    cells = spark.createDataFrame([("a", r, c, float(r * 7 + c * c)) for r in range(9) for c in range(7) if (r, c) != (4, 4)], "band string, row int, col int, value double")
    w = np.arange(10) / 10
    one, many = (sorted(map(tuple, mapping.predict_tiles(cells, "line", [w], ["a"], 3, t).select("row", "col", "preds").collect())) for t in (64, 2))
    assert [r[:2] for r in one] == [r[:2] for r in many] and len(one) == 7 * 5 - 9
    assert all(a[2][0] == pytest.approx(b[2][0]) for a, b in zip(one, many))


def test_donors_are_a_derangement(spark, table):
    got = explain.donors(table, 2, strata="fold").collect()
    assert len(got) == 160 and all(r["sample_id"] != r["donor"] and r["sample_id"] % 4 == r["donor"] % 4 for r in got)
    assert len({(r["draw"], r["donor"]) for r in got}) == 160


def test_matched_folds_hold_every_row_once(spark):
    p = spark.createDataFrame([(i, float(i % 20), float(i // 20)) for i in range(200)], "sample_id long, x double, y double")
    far = spark.createDataFrame([(i, 60.0 + i, 60.0) for i in range(30)], "id long, x double, y double")
    folds, tried = matched_folds(p, far, [0.0, 5.0], 4)
    assert folds.count() == folds.select("sample_id").distinct().count() == 200
    assert min(tried.collect(), key=lambda r: r["w"])["block_size"] == 5.0


def test_new_queries_are_registered():
    assert {"mlp_units", "predict_tiles", "knndm_folds"} <= set(queries.QUERIES) and more_queries.FEATURES

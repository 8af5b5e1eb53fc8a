"""Checks, applicability of raw rows, context and sampled explanations on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan import models
from fieldspan.functions import mollweide
from fieldspan.models import explain, grids, network
from fieldspan.operators import checks, importance, selection, spatial


def test_centres_that_are_missing_or_off(spark):
    p = spark.createDataFrame([(1, "a", [0.0] * 4 + [2.0] + [0.0] * 4), (2, "a", [0.0] * 4 + [None] + [0.0] * 4), (3, "a", [1.0] * 9), (4, "a", [1.0] * 9)], "sample_id int, band string, patch array<double>")
    v = spark.createDataFrame([(1, "a", 2.0), (2, "a", float("nan")), (3, "a", None), (4, "a", 1.5)], "sample_id int, band string, value double")
    assert tuple(checks.patch_centres(p, v, 3).first()) == ("a", 4, 1, 1, 0.5, False)
    assert checks.patch_centres(p, v.limit(0), 3).count() == 0


def test_attributions_that_do_not_add_up(spark):
    phi = spark.createDataFrame([(1, 0, 2.0), (1, 1, -0.5), (2, 0, 1.0)], "id int, player int, phi double")
    total = spark.createDataFrame([(1, 1.5), (2, 4.0), (3, 0.25)], "id int, total double")
    assert tuple(checks.attribution_gap(phi, total).first()) == (3, 3.0, 2, False)


def test_keys_of_two_tables(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (None,), (3,), (3,)], "k int")
    assert {tuple(r) for r in checks.compare_keys(a, b).collect()} == {(1, "missing"), (2, "both"), (None, "both"), (3, "unexpected")}


def test_the_latest_run_is_a_finished_one(spark):
    f = spark.createDataFrame([("r/tune_1/units.csv", 5), ("r/tune_2/notes.txt", 9), ("r/other/units.csv", 9), ("r/tune_0/units.csv", 5)], "path string, modified int")
    assert tuple(checks.latest_run(f, "tune_", "units.csv").first()) == ("tune_1", 5)
    assert checks.latest_run(f, "none", "units.csv").count() == 0


def test_bands_outside_the_area_have_no_interval(spark):
    x = spark.createDataFrame([(1.0, 0.2), (9.0, 0.2), (9.0, 3.0), (9.0, None)], "pred double, di double")
    q, t = spark.createDataFrame([(2.0,)], "q double"), spark.createDataFrame([(1.0,)], "threshold double")
    got = checks.calibrated_bands(x, q, t).select("lower", "upper", "width", "inside").collect()
    assert [tuple(r) for r in got] == [(0, 3, 3, True), (7, 11, 4, True), (None, None, None, False), (None, None, None, False)]
    inf = spark.createDataFrame([(math.inf,)], "q double")
    assert checks.calibrated_bands(x, inf).where("lower is null and upper is null").count() == 4


def test_raw_rows_with_a_missing_channel_have_no_dissimilarity(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 3)) * [1, 4, 9] + 2
    t = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(v)] + [(99, [1.0, None, 2.0], 0)], "id long, v array<double>, fold int")
    center, scale, w = v.mean(0).tolist(), v.std(0).tolist(), [1.0, 2.0, 0.5]
    ref = spatial.aoa_reference(t, center, scale, w)
    z = (v - center) / scale * w
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    unit = d[np.triu_indices(30, 1)].mean()
    own = np.where(np.arange(30)[:, None] % 3 == np.arange(30)[None] % 3, np.inf, d).min(1) / unit
    q1, q3 = np.quantile(own, [0.25, 0.75])
    assert ref.threshold.first()[0] == pytest.approx(q3 + 1.5 * (q3 - q1))
    x = spark.createDataFrame([(1, [2.0, 3.0, 4.0]), (2, [1.0, float("nan"), 0.0]), (3, None)], "id long, v array<double>")
    di = spatial.aoa_di(ref, x)
    near = np.sqrt((((np.array([2, 3, 4]) - center) / scale * w - z) ** 2).sum(1)).min() / unit
    got = {r["id"]: r["di"] for r in di.collect()}
    assert got[1] == pytest.approx(near) and got[2] is None and got[3] is None
    assert spatial.aoa_report(di, ref.threshold).first()["n"] == 1


def test_mollweide_at_the_poles_and_the_edge(spark):
    x = spark.createDataFrame([(0.0, 90.0), (180.0, 0.0), (0.0, -90.0), (90.0, 40.0)], "lon double, lat double")
    e, n = mollweide(F.col("lon"), F.col("lat"), 1.0)
    got = x.select(e, n).collect()
    assert got[0] == pytest.approx((0, math.sqrt(2)), abs=1e-12) and got[1] == pytest.approx((2 * math.sqrt(2), 0)) and got[2] == pytest.approx((0, -math.sqrt(2)), abs=1e-12)
    t = math.asin(got[3][1] / math.sqrt(2))
    assert 2 * t + math.sin(2 * t) == pytest.approx(math.pi * math.sin(math.radians(40)))


def test_paired_interval_refuses_what_it_cannot_test(spark):
    u = lambda rows: spark.createDataFrame(rows, "fold int, seed int, m double")
    a = u([(f, 1, v) for f, v in enumerate((1.0, 2.0, 4.0, 3.0))])
    b = u([(f, 1, v) for f, v in enumerate((0.5, 2.5, 2.0, 1.0))])
    r = selection.paired_interval(a, b, "m").first()
    half = 3.182446 * np.std([0.5, -0.5, 2, 2], ddof=1) / 2
    assert (r["lower"], r["upper"]) == pytest.approx((1 - half, 1 + half), abs=1e-4)
    with pytest.raises(ValueError, match="more than once"):
        selection.paired_interval(a.union(a), b, "m")
    with pytest.raises(ValueError, match="at least three"):
        selection.paired_interval(a.limit(2), b, "m")


def test_rank_agreement_shares_ranks_of_ties(spark):
    a = spark.createDataFrame(list(zip("abcde", [1.0, 2.0, 2.0, 5.0, 4.0])), "variable string, importance double")
    b = spark.createDataFrame(list(zip("abcdx", [3.0, 1.0, 1.0, 9.0, 4.0])), "variable string, importance double")
    assert importance.rank_agreement(a, b).first()["spearman"] == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [3, 1.5, 1.5, 4])[0, 1])


@pytest.fixture(scope="module")
def line():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 18))
    y = 3 * x[:, 4] + x[:, 0] + 0.5 * x[:, 13]
    spec = models.get_model("mlp")
    return x, y, spec.fit(x, y, x, y, {"hidden": [32], "epochs": 30}, 1), spec


def test_context_is_in_the_centre(spark, line):
    x, y, fitted, _ = line
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "sample_id long, x array<double>, y double")
    got = {r["variable"]: r["drop"] for r in explain.context_importance(df, "mlp", fitted, 3, ["b0", "b1"], draws=1).collect()}
    assert set(got) == {"ring_0", "ring_1"} and got["ring_0"] > got["ring_1"] > 0
    names, groups = explain.context_groups(5, ["a", "b"], by="window", per_variable=True)
    assert names[:3] == ["a_window_1", "a_window_3", "a_window_5"] and [len(g) for g in groups] == [1, 9, 25] * 2 and groups[3] == [37]


def test_sampled_shapley_adds_up_beyond_14_players(spark, line):
    x, _, fitted, spec = line
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:6])], "sample_id long, x array<double>")
    back = x[10:13]
    phi = explain.sampled_shapley(df, "mlp", fitted, back.tolist(), orders=4)
    total = np.asarray(spec.predict(fitted, x[:6])).ravel() - np.asarray(spec.predict(fitted, back)).mean()
    want = spark.createDataFrame([(i, float(t)) for i, t in enumerate(total)], "id long, total double")
    assert checks.attribution_gap(phi, want).first()["ok"] and phi.count() == 6 * 18


def test_grids_say_what_is_wrong():
    assert grids.check_grid([{"windows": [3, 7], "channels": [4, 4], "padding": "valid"}, {"windows": [7], "channels": [4]}, {"hidden": [8]}]) == [
        {"windows": [3, 7], "channels": [4, 4], "padding": "same"}, {"windows": [7], "channels": [4], "padding": "valid"}, {"hidden": [8]},
    ]
    for grid, says in (([], "no configuration"), ([{"epoch": 3}], "epochs is not given"), ([{"colour": 1}], "nothing reads colour$"), ([{"windows": [4]}], "odd"), ([{"dropout": 1}], "below 1"), ([{"windows": [3], "channels": []}], "channels")):
        with pytest.raises(ValueError, match=says):
            grids.check_grid(grid)
    assert [grids.edits(a, b) for a, b in (("", "abc"), ("kitten", "sitting"), ("same", "same"))] == [3, 3, 0]
    assert grids.expand_dropout(0.3) == {"spatial_dropout": 0.075, "embed_dropout": 0, "gate_dropout": 0.15, "head_dropout_1": 0.3, "head_dropout_2": 0.15}
    assert grids.usable_padding(None, [9], [4]) == "same" and grids.usable_padding("1", [3, 9], [4, 4]) == "1"


def test_strips_need_valid_branches():
    assert grids.strips_supported({"windows": [3, 7], "channels": [4, 4]}) == [False, True]
    assert grids.strips_supported({"windows": [7], "squeeze": True}) == [False]
    assert grids.strips_supported({"windows": [7], "squeeze": True, "pool": True}) == [True]


def test_every_name_a_network_reads_is_known():
    import inspect
    import re

    read = set(re.findall(r"""cfg(?:\.get\(|\[)"(\w+)\"""", inspect.getsource(network) + inspect.getsource(models)))
    assert read - {"ridge"} == grids.KNOWN


def test_gates_are_those_of_the_forward_pass(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 18))
    fitted = models.get_model("cnn").fit(x, x[:, 4], x, x[:, 4], {"windows": [1, 3], "channels": [3], "embedding": 5, "epochs": 2}, 1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "sample_id long, x array<double>")
    values = explain.gate_values(df, fitted)
    got = {r["sample_id"]: r for r in values.collect()}
    models.get_model("cnn").predict(fitted, x)
    two = next(v for v in fitted[0].net.every() if isinstance(v, network.TwoBranches))
    assert [got[i]["gate"] for i in range(60)] == [pytest.approx(g) for g in two.s.tolist()]
    assert got[7]["cosine"] == pytest.approx(two.a[7] @ two.b[7] / np.linalg.norm(two.a[7]) / np.linalg.norm(two.b[7]), rel=1e-5)
    s = explain.gate_summary(values).first()
    assert (s["n"], s["n_gate_dims"]) == (60, 5) and s["median_gate"] == pytest.approx(np.median(two.s)) and s["mean_gate"] == pytest.approx(two.s.mean())
    single = models.get_model("cnn").fit(x, x[:, 4], x, x[:, 4], {"windows": [3], "channels": [3], "epochs": 1}, 1)
    with pytest.raises(ValueError, match="no gate"):
        explain.gate_values(df, single)

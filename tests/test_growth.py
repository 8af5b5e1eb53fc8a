"""What has to hold so that the figures grow no faster than the input: plans, bounded tasks, and the same results."""

import io
import pickle
from contextlib import redirect_stdout

import numpy as np
import pytest

from fieldspan import models, queries
from fieldspan.models import explain, network
from fieldspan.operators import intervals, metrics, raster, spatial
from fieldspan.plans import resampling


@pytest.fixture(scope="module")
def rows_of_three(spark):
    x = np.random.default_rng(3).normal(size=(60, 3))
    return spark.createDataFrame([(i, [float(v) for v in r], float(2 * r[0] - r[1] + i % 2), i % 4) for i, r in enumerate(x)], "sample_id long, x array<double>, y double, fold int")


def plan_of(df) -> str:
    with redirect_stdout(io.StringIO()) as said:
        df.explain()
    return said.getvalue()


def test_patches_of_points_that_share_centres_and_ids(spark):
    cells = [(b, r, c, None if (b, r, c) == ("b", 2, 2) else float(r * 10 + c)) for b in "ab" for r in range(5) for c in range(5)]
    points = [(i, 1 + i % 3, 1) for i in range(30)] + [(99, 1, 1), (99, 2, 1), (100, None, 1), (101, 0, 0)]
    of = {x[:3]: x[3] for x in cells}
    want = {}
    for b in "ab":
        for i, r, c in points:
            if r is not None:
                at = [(dc, dr, of[b, r + dr, c + dc]) for dc in (-1, 0, 1) for dr in (-1, 0, 1) if (b, r + dr, c + dc) in of]
                want.setdefault((i, b), []).extend(((dc + 1) * 3 + dr + 1, v) for dc, dr, v in at)
    want = {k: ([v for _, v in sorted(z, key=lambda t: (t[0], t[1] is not None, t[1] or 0))], sum(v is not None for _, v in z) == 9) for k, z in want.items()}
    got = raster.patches(spark.createDataFrame(cells, "band string, row int, col int, value double"), spark.createDataFrame(points, "sample_id long, row int, col int"), 3)
    assert {(r["sample_id"], r["band"]): (r["patch"], r["valid"]) for r in got.collect()} == want


def test_no_point_is_broadcast_once_for_each_cell_of_its_window(spark, sf_dir):
    for name in ("patch_d4", "patch_valid", "patch_blame", "ring_index", "window_mean_features"):
        assert "Broadcast" not in plan_of(queries.QUERIES[name](spark, sf_dir)).replace("BroadcastExchange IdentityBroadcastMode", "")


def test_moments_give_the_same_metrics(spark):
    rng = np.random.default_rng(5)
    o, p, k = rng.normal(1e6, 3, 900), rng.normal(1e6, 3, 900), np.arange(900) % 3
    o[4], p[8] = np.nan, np.inf
    rows = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(k, o, p)] + [(7, 1.0, 2.0)], "k int, obs double, pred double")

    def run(batches):
        for t in batches:
            m = metrics.Moments()
            for at in np.array_split(np.arange(len(t)), 5):
                for key in set(t.k.iloc[at]):
                    on = at[(t.k.iloc[at] == key).to_numpy()]
                    m.add((key,), t.obs.to_numpy()[on], t.pred.to_numpy()[on])
            yield m.frame(["k"])

    got = metrics.metrics_of_moments(rows.mapInPandas(run, f"k int, {metrics.Moments.FIELDS}"), ["k"])
    want = metrics.calc_metrics(rows, ["k"])
    assert got.columns == want.columns
    for a, b in zip(sorted(got.collect()), sorted(want.collect())):
        assert list(a) == [v if v is None else pytest.approx(v, rel=1e-7, abs=1e-9) for v in b]


def test_explanations_do_not_shuffle_coalitions(spark, rows_of_three):
    df, b = rows_of_three, [[0.0, 0.0, 0.0], [1.0, 0.5, 0.0]]
    m = models.fit_one(df, "line", {})
    for got in (explain.kernel_shap(df, "line", m, b), explain.sampled_shapley(df, "line", m, b, 4)):
        assert "Exchange" not in plan_of(got)
    worth = {}
    for r in df.collect():
        for mask in range(8):
            v = np.mean([m[0] + np.where([mask >> k & 1 for k in range(3)], r["x"], z) @ m[1:] for z in b])
            worth.setdefault(mask, []).append(-((v - r["y"]) ** 2))
    v = {k: np.mean(z) for k, z in worth.items()}
    share = {0: 1 / 3, 1: 1 / 6, 2: 1 / 3}
    for r in explain.sage(df, "line", m, b).collect():
        bit = 1 << r["player"]
        assert r["phi"] == pytest.approx(sum(share[(k & ~bit).bit_count()] * (v[k | bit] - v[k & ~bit]) for k in range(8) if k & bit))


def test_permuted_rows_are_not_copied_for_each_variable(spark, rows_of_three):
    df = rows_of_three
    m = models.fit_one(df, "line", {})
    raw = explain.permutation_importance(df, "line", m, ["a", "b", "c"], 2)
    assert plan_of(raw).count("explode(") == plan_of(explain.donors(df, 2)).count("explode(")
    donor, of = {(r["draw"], r["sample_id"]): r["donor"] for r in explain.donors(df, 2).collect()}, {r["sample_id"]: r for r in df.collect()}

    def ccc(pred):
        o, p = np.array([r["y"] for r in of.values()]), np.array(pred)
        return 2 * np.cov(o, p, bias=True)[0, 1] / (o.var() + p.var() + (o.mean() - p.mean()) ** 2)

    base = ccc([m[0] + np.array(r["x"]) @ m[1:] for r in of.values()])
    for r in raw.collect():
        k = "abc".index(r["variable"])
        x = [[of[donor[r["draw"], i]]["x"][j] if j == k else v for j, v in enumerate(s["x"])] for i, s in of.items()]
        assert r["drop"] == pytest.approx(base - ccc(m[0] + np.array(x) @ m[1:]))


def test_a_model_leaves_its_last_batch_behind():
    rng = np.random.default_rng(1)
    net = network.cnn(rng, 2, [1, 3], {"channels": [4], "squeeze": True})
    size = len(pickle.dumps(net))
    network.predict(net, rng.normal(size=(5000, 2, 3, 3)))
    assert len(pickle.dumps(net)) < size + 1000


@pytest.mark.parametrize(("model", "cfg"), [("mlp", {"hidden": [8], "epochs": 25, "batch": 16}), ("cnn", {"windows": [1, 3], "channels": [4], "epochs": 8, "batch": 16, "augment": True})])
def test_networks_are_fitted_on_all_rows(spark, model, cfg):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 18)) * 3 + 5
    y = x[:, 4] + 0.5 * x[:, 13]
    df = spark.createDataFrame([(i, r.tolist(), float(v), i % 3) for i, (r, v) in enumerate(zip(x, y))], "sample_id long, x array<double>, y double, fold int")
    todo = models.units(spark, [cfg, cfg | {"without": 4}], [0, 1])
    done = models.fit_models(df, todo, model, max_rows=200)
    assert [(u["status"], u["n_train"]) for u in done] == [("success", 600)] * 4
    got = {(r["config_id"], r["fold"]): r for r in models.score_units(df, todo, model, max_rows=200).collect()}
    assert len(got) == 4 and all(got["cfg_001", f]["val_ccc"] > 0.8 > got["cfg_002", f]["val_ccc"] for f in (0, 1))
    same = {(r["config_id"], r["fold"]): r for r in models.unit_scores(models.fit_units(df, todo, model, max_rows=200)).collect()}
    assert all(same[k]["val_ccc"] == pytest.approx(got[k]["val_ccc"], rel=1e-6) for k in got)


def test_percentiles_are_exact_and_in_no_single_task(spark):
    rng = np.random.default_rng(9)
    levels = [0.0, 0.25, 0.5, 0.77, 0.99, 1.0]
    for v in (rng.normal(0, 5, 700), -np.abs(rng.normal(size=31)), np.zeros(4), np.array([3.0]), np.repeat([1.0, -2.0], 8)):
        got = intervals.percentiles(spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double"), "v", levels).first()[0]
        assert got == pytest.approx(np.quantile(v, levels).tolist())
    none = intervals.percentiles(spark.createDataFrame([], "v double"), "v", [0.5]).collect()
    assert [r[0] for r in none] == [None]
    x = spark.createDataFrame([(1.0, 2.0, 3.0)], "obs double, pred double, c double")
    for df in (intervals.scale_fit(x, "c"), metrics.quantile_performance(x)):
        assert "percentile(" not in plan_of(df) and "median(" not in plan_of(df)


def test_rows_of_one_place_are_one_in_a_correlogram(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 6)), float(rng.integers(0, 6)), float(rng.normal())) for i in range(145)]
    rows += [(i, float(i), 1.0, 2.0) for i in range(5)]
    v = np.array([r[3] for r in rows])
    z, want = v - v.mean(), {}
    for i in range(150):
        for j in range(i):
            d = np.hypot(rows[i][1] - rows[j][1], rows[i][2] - rows[j][2])
            if d < 3 and rows[i][0] != rows[j][0]:
                want.setdefault(int(d) + 1, []).append(z[i] * z[j])
    got = spatial.correlogram(spark.createDataFrame(rows, "id long, x double, y double, value double"), [0.0, 1.0, 2.0, 3.0])
    assert {r["class"]: (r["n_pairs"], pytest.approx(r["moran"], abs=1e-9)) for r in got.collect()} == {k: (len(p), np.mean(p) / v.var()) for k, p in want.items()}


def test_vectors_of_a_block_are_not_objects(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(70, 3)).astype("float32")
    t = spark.createDataFrame([(i, r.tolist(), None if i == 5 else i % 3) for i, r in enumerate(v)], "id long, v array<float>, fold int")
    near = spatial.nearest(t, t, other_folds=True)
    assert "MapInPandas" not in plan_of(near) + plan_of(spatial.di_reference(t))
    d = np.sqrt(((v[:, None].astype(float) - v[None].astype(float)) ** 2).sum(2))
    fold = np.array([np.nan if i == 5 else i % 3 for i in range(70)])
    want = np.where(fold[:, None] == fold[None], np.inf, d).min(1)
    assert {r["id"]: r["d"] for r in near.collect()} == {i: pytest.approx(w) for i, w in enumerate(want)}
    assert spatial.di_reference(t).first()["avg_dist"] == pytest.approx(d[np.triu_indices(70, 1)].mean())


def test_rows_that_train_a_network_are_made_once(spark, rows_of_three):
    for score in (models.score_units, models.fit_units):
        made = spark.sparkContext.accumulator(0)

        def count(batches, made=made):
            for t in batches:
                made.add(t.num_rows)
                yield t

        df = rows_of_three.mapInArrow(count, rows_of_three.schema)
        score(df, models.units(spark, [{"hidden": [4], "epochs": 3, "batch": 8}], [0, 1]), "mlp", max_rows=25).collect()
        assert made.value == 60


def test_a_step_is_adam_on_all_weights():
    rng = np.random.default_rng(2)
    net, x, y = network.mlp(rng, 3, {"hidden": [4, 2]}), rng.normal(size=(50, 3)), rng.normal(size=50) * 9
    training = network.Training(net, {"batch": 50, "warmup_steps": 1, "rate": 0.01})
    before = {(id(a), p): getattr(a, p).copy() for a, p in training.slots}
    training.epoch(x, y, np.random.default_rng(0))
    grads = {(id(a), p): getattr(a, f"g_{p}") for a, p in training.slots}
    clip = min(1.0, 1 / np.sqrt(sum((g * g).sum() for g in grads.values())))
    for a, p in training.slots:
        g = grads[id(a), p] * clip
        assert getattr(a, p) == pytest.approx(before[id(a), p] - 0.01 * g / (np.abs(g) + 1e-8))
    assert np.concatenate([getattr(a, p).ravel() for a, p in training.slots]) == pytest.approx(training.w, abs=0)
    at = training.vector()
    training.epoch(x, y, np.random.default_rng(0))
    assert not np.allclose(at, training.vector())
    training.load(at)
    assert (training.vector() == at).all()


def test_rows_that_train_a_borrowed_regressor_are_made_once(spark, rows_of_three):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for t in batches:
            made.add(t.num_rows)
            yield t

    rows = [(r["sample_id"], *r["x"], r["y"], r["fold"]) for r in rows_of_three.collect()]
    df = spark.createDataFrame(rows, "sample_id long, a double, b double, c double, y double, fold int").repartition(6)
    got = models.borrowed_units(df.mapInArrow(count, df.schema), ["a", "b", "c"], "DecisionTreeRegressor", [{"maxDepth": 2}, {"maxDepth": 3}], [0, 1]).collect()
    assert sorted((r["config_id"], r["sample_id"], r["obs"]) for r in got) == sorted((c, r[0], r[4]) for c in ("cfg_001", "cfg_002") for r in rows if r[5] in (0, 1))
    assert made.value == 60


def test_kept_rows_are_read_in_several_parts_and_whole(spark):
    df = spark.range(1000).selectExpr("id", "array(id * 0.5) as x")
    for n in (1, 3, 7):
        got = models.kept(df.repartition(n), "a name")
        assert sorted(r["id"] for r in got.collect()) == list(range(1000)) and got.columns == df.columns
        assert plan_of(got).count("FileScan") == min(n, models.READS)
    assert models.kept(df.where("id < 0"), "none").count() == 0


def test_plans_meet_points_in_tasks_that_are_not_merged(spark, sf_dir):
    for name in ("apply_buffer", "leakage_report", "check_fold_plan"):
        assert plan_of(queries.QUERIES[name](spark, sf_dir)).count("REPARTITION_BY_NUM") >= 2


def test_places_of_a_buffer_count_their_rows(spark):
    rng = np.random.default_rng(8)
    points = [(i, float(rng.integers(0, 9)), float(rng.integers(0, 9)) if i % 50 else None) for i in range(200)]
    roles = [(f, i, ("train", "train", "validation", "test", "calibration")[int(rng.choice(5, p=[0.5, 0.3, 0.1, 0.05, 0.05]))]) for f in (1, 2) for i in range(200)] + [(3, 7, "test"), (4, 8, "train")]
    at = {p[0]: p[1:] for p in points}

    def close(f, i, *others):
        return None not in at[i] and any(g == f and r in others and None not in at[j] and max(abs(a - b) for a, b in zip(at[i], at[j])) <= 1 for g, j, r in roles)

    want = {}
    for f in (1, 2, 4):
        train, val = [[i for g, i, r in roles if g == f and r == role] for role in ("train", "validation")]
        near = [sum(close(f, i, *o) for i in train) for o in (("validation", "test", "calibration"), ("validation",), ("test",), ("calibration",))]
        want[f] = (len(train), *near, len(val), sum(close(f, i, "test", "calibration") for i in val), pytest.approx(100 * near[0] / len(train), abs=0.006))
    got = resampling.buffer_report(spark.createDataFrame(roles, "fold int, sample_id long, role string"), spark.createDataFrame(points, "sample_id long, x double, y double"), 1.0)
    assert "SortMergeJoin [sample_id" not in plan_of(got)
    assert {r["fold"]: tuple(r)[1:] for r in got.collect()} == want

"""Resampling declarations, the store, and the final stage."""

import pytest
from pyspark.sql import functions as F

from fieldspan.operators import final, store
from fieldspan.plans import resampling as rs


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, f"p{i // 3}", f"r{i % 4}", float(i % 20), float(i // 20), float(i)) for i in range(240)]
    return spark.createDataFrame(rows, "sample_id long, profile string, region string, x double, y double, value double")


def roles(plan):
    out = {}
    for r in plan.rows.collect():
        out.setdefault(r["fold"], {}).setdefault(r["role"], set()).add(r["sample_id"])
    return out


def test_declarations_are_checked(spark, points):
    for wrong in (lambda: rs.spatial_cv(1), lambda: rs.random_cv(test_frac=0.7, calibration_frac=0.4), lambda: rs.Spec("other"), lambda: rs.holdout_cv(0.0), lambda: rs.random_cv(test_frac=2.0)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(ValueError, match="no points"):
        rs.resolve(rs.random_cv(), points.where("false"))
    with pytest.raises(ValueError, match="cell size"):
        rs.resolve(rs.spatial_cv(3, 2.0), points)
    with pytest.raises(ValueError, match="missing"):
        rs.row_groups(points.withColumn("region", F.when(F.col("sample_id") > 3, F.col("region"))), "region")


@pytest.mark.parametrize("spec", [rs.random_cv(3, calibration_frac=0.1), rs.holdout_cv(0.2, calibration_frac=0.1), rs.region_cv("region", test_frac=0.0), rs.spatial_cv(3, 4.0)], ids=lambda s: s.kind)
def test_plans_keep_groups_together(spark, points, spec):
    plan = rs.resolve(spec, points, cell_size=0.5, windows=[1, 3])
    assert rs.resolve(plan, points) is plan
    group = {r["sample_id"]: r["group"] for r in plan.groups.collect()}
    for fold in roles(plan).values():
        assert fold["train"] and fold["validation"]
        by = {r: {group[i] for i in ids} for r, ids in fold.items()}
        assert not by["train"] & by["validation"] and not by["train"] & by.get("test", set()) and not by["train"] & by.get("calibration", set())
    rs.check_unchanged(plan.rows, rs.resolve(spec, points, cell_size=0.5, windows=[1, 3]).rows)
    refit = rs.refit_split(plan, points, 0.25)
    a, b = roles(plan)[1], roles(refit)[1]
    assert list(roles(refit)) == [1] and b["train"] and b["validation"]
    assert a.get("test", set()) == b.get("test", set()) and a.get("calibration", set()) == b.get("calibration", set())


def test_frozen_sets(spark, points):
    ids = points.where("sample_id < 12")
    got = {r["sample_id"]: r["role"] for r in rs.carve(rs.row_groups(points), test_ids=ids, calibration_ids=points.where("sample_id between 20 and 22")).collect()}
    assert [i for i, r in got.items() if r == "test"].__len__() == 12 and {i for i, r in got.items() if r == "calibration"} == {20, 21, 22}
    with pytest.raises(ValueError, match="test set as well"):
        rs.carve(rs.row_groups(points), test_ids=ids, calibration_ids=ids)
    with pytest.raises(ValueError, match="not among"):
        rs.carve(rs.row_groups(points), test_ids=spark.createDataFrame([(9999,)], "sample_id long"))
    with pytest.raises(ValueError, match="differs"):
        plan = rs.resolve(rs.random_cv(3), points).rows
        rs.check_unchanged(plan, plan.where("sample_id <> 5"))
    assert rs.without_test(rs.resolve(rs.random_cv(3), points).rows).where("role = 'test'").count() == 0


def test_contract_transform_and_patterns(points):
    with pytest.raises(ValueError, match="target_native"):
        store.check_contract(points)
    forward, inverse = store.target_transform("log1p")
    assert points.select(F.max(F.abs(inverse(forward(F.col("value"))) - F.col("value"))).alias("d")).first()["d"] < 1e-9
    with pytest.raises(ValueError):
        store.target_transform("sqrt")
    assert store.matched(["^a", "z$", "q"], ["ab", "xz", "cd"]) == (["ab", "xz"], ["q"])


def test_centres_cells_and_extents(spark):
    at = spark.createDataFrame([(0, 3), (1, 1), (8, 8), (9, 5)], "r int, c int")
    assert [r[0] for r in at.select(store.centre_in_bounds(F.col("r"), F.col("c"), 10, 10, 3)).collect()] == [False, True, True, False]
    p = spark.createDataFrame([(0.1, 9.9), (2.5, 7.0), (2.49, 7.01)], "x double, y double")
    assert [(r["row"], r["col"]) for r in store.to_cells(p, 0.0, 10.0, 0.5).collect()] == [(0, 0), (6, 5), (5, 4)]
    cells = spark.range(100).select(F.floor(F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    got = store.crop(cells, (1.0, 2.0, 8.0, 9.2), 0.0, 10.0, 0.5).agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    assert tuple(got) == (1, 3, 2, 3)


def test_store_is_checked(spark, tmp_path, points):
    path, spec = str(tmp_path / "store"), {"predictors": ["a", "b"], "windows": [3, 5], "target": "soc", "cell_size": 0.25}
    prepared = {"samples": points.select("sample_id"), "patches": spark.createDataFrame([(1, w, "a", [0.5]) for w in (3, 5)], "sample_id long, window int, band string, patch array<double>")}
    store.write_store(prepared, path, spec)
    samples, patches = store.read_store(spark, path, 5, predictors=["a", "b"], cell_size=0.25 + 1e-12)
    assert samples.count() == 240 and [r["window"] for r in patches.collect()] == [5]
    for wrong in ({"predictors": ["b", "a"]}, {"windows": [7]}, {"target": "ph"}, {"cell_size": 0.5}):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            store.check_spec(store.store_spec(spark, path), **wrong)
    assert store.align(points, samples).count() == 240
    with pytest.raises(ValueError, match="exactly one"):
        store.align(points.where("sample_id > 0"), samples)
    with pytest.raises(ValueError, match="exactly one"):
        store.align(points.union(points.where("sample_id = 7")), samples)


def test_a_choice_is_made_once(spark, tmp_path):
    path = str(tmp_path / "choice.json")
    assert final.frozen(spark, path) is None
    record = final.freeze(spark, path, "cfg_002", note="first")
    assert final.freeze(spark, path, "cfg_002") == record == final.frozen(spark, path)
    with pytest.raises(ValueError, match="chosen already"):
        final.freeze(spark, path, "cfg_001")
    preds = spark.createDataFrame([("cfg_001", 0, 1, "test", 1.0, 1.5)], "config_id string, fold int, seed int, dataset_role string, obs double, pred double")
    with pytest.raises(ValueError, match="after the choice"):
        final.score_test(preds, None)


def test_select_config(spark):
    by = spark.createDataFrame([(1, 0.50, 0.02, 9000), (2, 0.49, 0.05, 10), (3, 0.30, 0.01, 5)], "config_id int, val_ccc_mean double, val_ccc_se double, n_params int")
    units = spark.createDataFrame([(c, f, s, "success", m + 0.03 * s) for c, m in ((1, 0.5), (2, 0.49)) for f in (0, 1) for s in (0, 1)], "config_id int, fold int, seed int, status string, val_ccc double")
    assert final.select_config(by, units) == {"config_id": 2, "rule": "one_se", "doubtful": True}
    assert final.select_config(by.withColumn("val_ccc_se", F.lit(None).cast("double")), units)["rule"] == "rank1"
    assert final.select_config(by, units, config_id=3)["rule"] == "manual"
    with pytest.raises(ValueError):
        final.select_config(by, units, config_id=8)


def test_seeds_and_forest_grids():
    assert final.seeds(3) == [42, 43, 44] and final.seeds([5, 9]) == [5, 9]
    for wrong in (0, [1, 1]):
        with pytest.raises(ValueError):
            final.seeds(wrong)
    assert [r["config_id"] for r in final.rf_grid(3)] == ["rf_001", "rf_002", "rf_003"]
    few = final.rf_grid(28, n_features=4)
    assert len({(r["mtry"], r["min_node_size"]) for r in few}) == len(few) < 28


def test_intervals_inside_and_outside(spark):
    rows = [(f"g{i % 4}", float(i), float(i), float(i) - (1 if i % 3 else -5), float(i) + 1 + 9 * (i % 3 == 0), i % 2 == 0, "m") for i in range(100)]
    df = spark.createDataFrame(rows, "g string, obs double, pred double, lower double, upper double, inside boolean, method string")
    got = final.interval_summary(final.stratum_coverage(df, "g", ["method"], "inside")).first()
    hit = [r[3] <= r[1] <= r[4] for r in rows]
    assert got["n_test"] == 100 and got["coverage"] == pytest.approx(sum(hit) / 100)
    for name, flag in (("inside", True), ("outside", False)):
        some = [h for h, r in zip(hit, rows) if r[5] == flag]
        assert got[f"coverage_{name}_aoa"] == pytest.approx(sum(some) / len(some))

"""Queries of models, explanations, maps and reports. They join those of `queries` when this module is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import models, plans
from .models import explain, mapping
from .operators import importance, intervals, metrics, raster, reports, smearing, spatial
from .queries import _CV, _M, _MS, _cv_intervals, _patches, cells, logs, obs, points, query, rounded, table, units, vectors

FEATURES = ["quantity", "discount", "tax", "price"]


def features(s, d):
    """Samples of line items as sample_id, x, y, fold: a scaled price, and four columns of which two make it up. One row an id."""
    x = obs(s, d).groupBy("sample_id").agg(*[F.avg(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "pred")], F.min("fold").alias("fold"))
    x4 = F.array("l_quantity", "l_discount", "l_tax", F.col("pred") / F.col("l_quantity"))
    return x.select("sample_id", x4.alias("x"), (F.col("pred") / 1000).alias("y"), "fold")


def order_patches(s, d):
    """Three bands of 3 x 3 cells around each order, and a target that depends on the centre and its neighbours."""
    p = _patches(s, d).where("valid").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("band", "patch"))).alias("p"))
    x = F.flatten(F.transform("p", lambda b: b["patch"]))
    z = p.where(F.size("p") == 3).select("sample_id", x.alias("x"), F.pmod(F.xxhash64("sample_id"), F.lit(3)).cast("int").alias("fold"))
    return z.withColumn("y", F.get("x", F.lit(4)) + F.get("x", F.lit(12)) / 2 - F.get("x", F.lit(22)) / 4)


def vector_table(s, d):
    return vectors(s, d).join(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("y")), "id").select(F.col("id").alias("sample_id"), F.col("v").cast("array<double>").alias("x"), "y", "fold")


def _model(s, d):
    return models.fit_one(features(s, d), "mlp", {"hidden": [16], "epochs": 12, "batch": 256})


@query(f""", l AS (SELECT f, avg(obs) - covar_pop(obs, l_quantity) / var_pop(l_quantity) * avg(l_quantity) AS b0, covar_pop(obs, l_quantity) / var_pop(l_quantity) AS b1 FROM o, (SELECT unnest(range(0, 5)) AS f) WHERE fold <> f GROUP BY f),
pr AS (SELECT f, obs, b0 + b1 * l_quantity AS pred FROM o JOIN l ON fold = f) SELECT f::INT AS fold, n, ccc, mae, rmse FROM (SELECT f, {_MS} FROM (SELECT f, {_M} FROM pr GROUP BY f))""")
def line_units(s, d):
    x = obs(s, d).select("sample_id", F.array(F.col("l_quantity").cast("double")).alias("x"), F.col("obs").alias("y"), "fold")
    return metrics.calc_metrics(models.fit_units(x, models.units(s, [{"ridge": 1e-9}], list(range(5))), "line"), ["fold"]).select("fold", "n", "ccc", "mae", "rmse")


@query()
def mlp_units(s, d):
    return models.score_units(vector_table(s, d), models.units(s, [{"hidden": [16], "epochs": 15}, {"hidden": [16, 8], "epochs": 15}], [0, 1], 2), "mlp")


@query()
def cnn_units(s, d):
    grid = [{"windows": [3], "channels": [4], "epochs": 8, "squeeze": True}, {"windows": [1, 3], "channels": [4], "epochs": 8, "residual": True, "gate": "scalar", "augment": True}]
    return models.score_units(order_patches(s, d), models.units(s, grid, [0, 1]), "cnn")


@query()
def rf_units(s, d):
    x = features(s, d).select("sample_id", "y", "fold", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)])
    got = models.borrowed_units(x, FEATURES, "RandomForestRegressor", [{"numTrees": 10, "maxDepth": 6}], [0, 1])
    return metrics.calc_metrics(got, ["config_id", "fold"])


@query()
def permutation_importance(s, d):
    raw = explain.permutation_importance(features(s, d), "mlp", _model(s, d), FEATURES, 2)
    return importance.importance_aggregate(raw)


@query()
def shap_gradients(s, d):
    g = explain.gradient_shap(features(s, d), _model(s, d), 20)
    return g.select("sample_id", "pred", "base", *[F.get("phi", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)])


@query()
def shap_kernel(s, d):
    x = features(s, d)
    return explain.kernel_shap(x, "mlp", _model(s, d), explain.background_rows(x, 4))


@query()
def sage_importance(s, d):
    x = features(s, d)
    return explain.sage(x, "mlp", _model(s, d), explain.background_rows(x, 4))


@query()
def refit_importance(s, d):
    return explain.refit_importance(features(s, d), "mlp", {"hidden": [8], "epochs": 6, "batch": 256}, FEATURES, [0, 1])


@query()
def ale_curves(s, d):
    x, m = features(s, d), _model(s, d)
    both = explain.local_effects(x, "mlp", m, 0, "quantity", 10).unionByName(explain.local_effects(x, "mlp", m, 3, "price", 10))
    return importance.ale_accumulate(both)


@query()
def occlusion_report(s, d):
    x = order_patches(s, d)
    return explain.occlusion(x, "cnn", models.fit_one(x, "cnn", {"windows": [3], "channels": [4], "epochs": 8}), 3)


@query()
def knndm_folds(s, d):
    p = points(s, d)
    return plans.matched_folds(p, p.select((F.col("sample_id") + 1).alias("id"), (F.col("x") * 0.5).alias("x"), F.col("y")), [0.0, 5.0, 20.0], 5)[0]


@query("""SELECT a."row", a.col, round(avg(b.value), 6) AS median, round(avg(b.value), 6) AS mean, 0.0::DOUBLE AS sd FROM (SELECT DISTINCT "row", col FROM ce) a, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)
JOIN ce b ON b."row" = a."row" + dr AND b.col = a.col + dc GROUP BY 1, 2 HAVING count(b.value) = 27""")
def predict_tiles(s, d):
    import numpy as np

    mean = np.concatenate([[0.0], np.full(27, 1 / 27)])
    return mapping.bands(mapping.predict_tiles(cells(s, d), "line", [mean, mean], ["b0", "b1", "b2"], 3, 16)).select("row", "col", "median", "mean", "sd")


@query("""SELECT i AS unit, i * 60 AS first_row, least(i * 60 + 60, 833) - 1 AS last_row, (least(i * 60 + 60, 833) - i * 60) * 40 AS n_cells FROM (SELECT unnest(range(0, 14))::BIGINT AS i)""")
def predict_units(s, d):
    return mapping.work_units(833, 40, 60, s)


@query(""", h AS (SELECT dr AS draw, sample_id, grp, row_number() OVER (PARTITION BY dr, grp ORDER BY md5('42_' || dr || '_' || sample_id)) AS p, count(*) OVER (PARTITION BY dr, grp) AS n FROM (SELECT sample_id, profile % 7 AS grp FROM pt), (SELECT unnest([1, 2])::INT AS dr))
SELECT a.draw, a.sample_id, b.sample_id AS donor FROM h a JOIN h b ON a.draw = b.draw AND a.grp = b.grp AND b.p = a.p % a.n + 1""")
def importance_donors(s, d):
    return explain.donors(points(s, d).withColumn("grp", F.col("profile") % 7), 2, strata="grp")


@query(", f AS (SELECT sum(exp(pred_t) * exp(obs_t - pred_t)) / sum(exp(pred_t)) AS s FROM lg) SELECT sample_id, round(greatest(exp(pred_t) * s - 1, 0), 3) AS mean_surface FROM lg, f")
def smear_total(s, d):
    x = logs(s, d)
    return rounded(smearing.smear(x, smearing.smearing_factor(x).select(F.col("s_weighted").alias("s"))).select("sample_id", "mean_surface"), 3)


@query(f", {_CV} SELECT count(*) AS n, round(avg((obs BETWEEN lower AND upper)::INT), 6) AS picp, round(avg(upper - lower), 6) AS mean_width, round(median(upper - lower), 6) AS median_width FROM iv")
def conformal_cv_picp(s, d):
    return metrics.coverage(_cv_intervals(s, d))


@query(f""", {_CV}, r AS (SELECT 'all' AS level, * EXCLUDE (level) FROM (SELECT '' AS level, count(*) AS n, avg((obs BETWEEN lower AND upper)::INT) AS picp, avg(upper - lower) AS mean_width FROM iv)
UNION ALL SELECT grp, count(*), avg((obs BETWEEN lower AND upper)::INT), avg(upper - lower) FROM iv GROUP BY grp)
SELECT level, n, round(picp, 6) AS picp, round(mean_width, 6) AS mean_width, round(picp - 0.9, 6) AS gap, CASE WHEN abs(picp - 0.9) <= 0.02 THEN 'matches' WHEN picp < 0.8 THEN 'flagged' WHEN picp < 0.9 THEN 'under' ELSE 'over' END AS verdict FROM r""")
def picp_report(s, d):
    return reports.picp_report(_cv_intervals(s, d), "grp")


@query(f"SELECT grp, fold, seed, {_MS} FROM (SELECT grp, fold, seed, {_M} FROM o GROUP BY ALL)")
def performance_table(s, d):
    return reports.performance_table(obs(s, d), ["grp", "fold", "seed"])


@query(""", x AS (SELECT config_id, avg(val_ccc) AS v, avg(val_mae) AS t FROM un GROUP BY 1) SELECT config_id, round(v, 6) AS val_mean, round(t, 6) AS test_mean, round(v - t, 6) AS optimism,
row_number() OVER (ORDER BY v DESC, config_id)::INT AS val_rank, row_number() OVER (ORDER BY t DESC, config_id)::INT AS test_rank FROM x""")
def selection_optimism(s, d):
    return reports.selection_optimism(units(s, d), "val_ccc", "val_mae")


@query("""SELECT 'fold' AS parameter, count(DISTINCT fold) AS n_values, string_agg(DISTINCT fold::VARCHAR, ',' ORDER BY fold::VARCHAR) AS tried, count(DISTINCT fold) > 1 AS tuned FROM un
UNION ALL SELECT 'n_params', count(DISTINCT n_params), string_agg(DISTINCT n_params::VARCHAR, ',' ORDER BY n_params::VARCHAR), count(DISTINCT n_params) > 1 FROM un""")
def hyper_table(s, d):
    return reports.hyper_table(units(s, d), ["fold", "n_params"])


@query("""SELECT n_name AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' WHEN n_nationkey % 5 = 1 THEN 'failed' ELSE 'passed' END AS verdict FROM nation""")
def ledger_verdict(s, d):
    n, k = table(s, d, "nation"), F.col("n_nationkey")
    return reports.ledger(n.select(F.col("n_name").alias("id")), n.where(k % 5 != 0).select(F.col("n_name").alias("id"), (k % 5 > 1).alias("ok")))


@query(""", h AS (SELECT grp AS run, site::INT AS epoch, avg(abs(pred - obs)) AS loss FROM o GROUP BY 1, 2), w AS (SELECT *, avg(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS p6,
avg(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS p20, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS r FROM h)
SELECT run, k AS plateau, round(p - loss, 6) AS bias, round(100 * (p - loss) / p, 6) AS bias_pct FROM (SELECT run, loss, 6 AS k, p6 AS p FROM w WHERE r = 1 UNION ALL SELECT run, loss, 20, p20 FROM w WHERE r = 1)""")
def early_stopping_bias_sweep(s, d):
    h = obs(s, d).groupBy(F.col("grp").alias("run"), F.col("site").cast("int").alias("epoch")).agg(F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("loss"))
    return reports.bias_sweep(h, [6, 20])


@query("""SELECT i, j, count(*) AS n, round(avg(abs(value)), 6) AS value, round(avg(abs(w)), 6) AS w, CASE WHEN avg(abs(value)) >= avg(abs(w)) THEN 'value' ELSE 'w' END AS dominant
FROM (SELECT floor(x / 10)::BIGINT AS i, floor(y / 10)::BIGINT AS j, value, x * 3000 AS w FROM pt) GROUP BY i, j""")
def importance_map(s, d):
    return reports.dominant_variable(points(s, d).withColumn("w", F.col("x") * 3000), ["value", "w"], 10.0)


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_type || ' ' || p_brand, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part""")
def clean_names(s, d):
    return table(s, d, "part").select("p_partkey", reports.clean_name(F.concat_ws(" ", "p_type", "p_brand")).alias("name"))


@query("""SELECT CASE WHEN c LIKE 'flag%' THEN 'flag' ELSE c END AS variable, c AS channel FROM (SELECT unnest(['flag_a', 'flag_n', 'flag_r', 'big_q', 'big_p']) AS c)""")
def importance_groups(s, d):
    x = obs(s, d).select(*[(F.col("grp") == g).cast("int").alias(f"flag_{g.lower()}") for g in "ANR"], (F.col("l_quantity") > 10).cast("int").alias("big_q"), (F.col("pred") > 10).cast("int").alias("big_p"))
    return reports.onehot_sets(x.columns, x)


@query(""", c AS (SELECT site AS g, count(*) AS n FROM o GROUP BY 1), g AS (SELECT ceil(sum(n) * 0.3::DOUBLE) AS goal FROM c), q AS (SELECT unnest(range(1, (SELECT max(n) + 1 FROM c)))::BIGINT AS q)
SELECT min(q) AS quota FROM (SELECT q, sum(least(n, q)) AS s FROM c, q GROUP BY q), g WHERE s >= goal""")
def block_subsample_strata(s, d):
    return reports.strata_quota(obs(s, d).groupBy(F.col("site").alias("stratum")).agg(F.count("*").alias("n")), 0.3)


@query()
def block_bootstrap_by_size(s, d):
    o = points(s, d).select("x", "y", F.col("value").alias("obs"), (F.col("value") * 0.9 + F.col("x") * 100).alias("pred"))
    out = None
    for size in (5.0, 10.0, 25.0):
        part = spatial.block_bootstrap(plans.blocks(o, size), "block", 100).withColumn("block_size", F.lit(size))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT unit_id FROM un WHERE NOT (status = 'success' AND fold < 3)""")
def resumable_units(s, d):
    u = units(s, d).select("unit_id", F.col("config_id").cast("string").alias("config_id"), F.col("n_params").cast("string").alias("cfg"), "fold", "seed", "status")
    return models.resumable(u.drop("status"), u.where("fold < 3")).select("unit_id")


@query("""SELECT config_id, seed, round(avg(val_ccc), 6) AS ccc_mean, round(stddev_samp(val_ccc), 6) AS ccc_sd, round(avg(val_mae), 6) AS mae_mean, round(stddev_samp(val_mae), 6) AS mae_sd FROM un GROUP BY 1, 2""")
def config_summary(s, d):
    return units(s, d).groupBy("config_id", "seed").agg(*[f(f"val_{m}").alias(f"{m}_{n}") for m in ("ccc", "mae") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


@query(""", q AS (SELECT ceil((count(*) + 1) * 0.9::DOUBLE)::BIGINT AS k, fold, count(*) AS n, list_sort(list(abs(obs - pred) / l_quantity)) AS a FROM o GROUP BY fold) SELECT fold, n, k, round(a[k], 6) AS q FROM q""")
def conformal_by_fold(s, d):
    return intervals.conformal_point(obs(s, d), by=["fold"], difficulty="l_quantity")


@query("""SELECT sample_id, count(*) FILTER (valid) AS n_valid FROM (SELECT (o_orderkey * 3)::BIGINT AS sample_id, band, count(value) = 9 AS valid FROM orders, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)
JOIN ce ON ce."row" = (o_orderkey % 40)::INT + dr AND ce.col = ((o_orderkey // 7) % 40)::INT + dc GROUP BY 1, 2) GROUP BY 1""")
def patch_valid(s, d):
    return _patches(s, d).groupBy("sample_id").agg(F.count_if("valid").alias("n_valid"))


from . import final_queries  # noqa: E402, F401  (these join as well)
from . import check_queries  # noqa: E402, F401

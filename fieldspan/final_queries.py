"""Queries of resampling declarations, preparation, the store and the final stage. They join those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import plans
from .functions import shared_path
from .operators import final, raster, store
from .plans import resampling
from .queries import _TEST, _dealt_points, cells, logs, obs, points, query, units


def _deal(source: str, k: int) -> str:
    """SQL of dl (g, fold): groups of a table (g, a row a sample) dealt to k folds, the largest first."""
    zeros = ", ".join(["0"] * k)
    return f"""sz AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, md5('42_' || g), g) AS i FROM (SELECT g, count(*) AS n FROM {source} GROUP BY 1)),
dl AS (WITH RECURSIVE r AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS g, 0 AS f, [{zeros}]::BIGINT[] AS load
UNION ALL SELECT sz.i, sz.g, list_position(r.load, list_min(r.load)), list_transform(r.load, lambda v, k: CASE WHEN k = list_position(r.load, list_min(r.load)) THEN v + sz.n ELSE v END) FROM r JOIN sz ON sz.i = r.i + 1)
SELECT g, f::INT AS fold FROM r WHERE g IS NOT NULL)"""


def _rows(k: int) -> str:
    return f"pl AS (SELECT k.k AS fold, sample_id, CASE WHEN dl.fold = k.k THEN 'validation' ELSE 'train' END AS role FROM src JOIN dl USING (g), (SELECT unnest(range(1, {k + 1})) AS k) k)"


def _sizes(rows):
    return rows.groupBy("fold", "role").agg(F.count("*").alias("n"))


@query(f""", {_TEST}, rs AS (SELECT * FROM pt WHERE profile NOT IN (SELECT g FROM tg)),
cg AS (SELECT g FROM (SELECT g, sum(n) OVER (ORDER BY md5('2042_' || g) ROWS UNBOUNDED PRECEDING) - n AS bf, sum(n) OVER () AS al FROM (SELECT profile AS g, count(*) AS n FROM rs GROUP BY 1))
WHERE bf < ceil(al * (0.1::DOUBLE * (SELECT count(*) FROM pt) / (SELECT count(*) FROM rs))))
SELECT sample_id, CASE WHEN profile IN (SELECT g FROM tg) THEN 'test' WHEN profile IN (SELECT g FROM cg) THEN 'calibration' END AS role FROM pt""")
def calibration_carve(s, d):
    return resampling.carve(resampling.row_groups(points(s, d)), 0.15, 0.1).select("sample_id", "role")


@query(""", gs AS (SELECT DISTINCT profile AS g FROM pt), vg AS (SELECT g FROM gs QUALIFY row_number() OVER (ORDER BY md5('42_' || g)) <= greatest(1, floor(0.2::DOUBLE * (SELECT count(*) FROM gs))))
SELECT 1 AS fold, CASE WHEN profile IN (SELECT g FROM vg) THEN 'validation' ELSE 'train' END AS role, count(*) AS n FROM pt GROUP BY 2""")
def holdout_split(s, d):
    return _sizes(resampling.resolve(resampling.holdout_cv(0.2, test_frac=0.0), points(s, d)).rows)


@query(f""", src AS (SELECT sample_id, (sample_id % 23)::VARCHAR AS g FROM pt WHERE profile % 10 <> 3), {_deal('src', 3)}, {_rows(3)}
SELECT fold, role, count(*) AS n FROM pl GROUP BY ALL UNION ALL SELECT k, 'test', count(*) FROM pt, (SELECT unnest([1, 2, 3]) AS k) WHERE profile % 10 = 3 GROUP BY k""")
def region_cv_frozen_test(s, d):
    p = _dealt_points(s, d)
    return _sizes(resampling.resolve(resampling.region_cv("g", 3, test_frac=0.0), p, test_ids=p.where("profile % 10 = 3")).rows)


@query(f""", src AS (SELECT sample_id, floor((x - (SELECT min(x) FROM pt)) / 10)::BIGINT || '_' || floor((y - (SELECT min(y) FROM pt)) / 10)::BIGINT AS g FROM pt), {_deal('src', 4)}, {_rows(4)}
SELECT fold, role, count(*) AS n FROM pl GROUP BY ALL""")
def spatial_cv_plan(s, d):
    return _sizes(resampling.resolve(resampling.spatial_cv(4, 10.0, None, test_frac=0.0), points(s, d)).rows)


@query(f""", src AS (SELECT sample_id, (sample_id % 23)::VARCHAR AS g FROM pt), {_deal('src', 4)}, vs AS (SELECT fold, count(*) AS n FROM src JOIN dl USING (g) GROUP BY 1),
pk AS (SELECT fold FROM vs ORDER BY abs(n - 0.25::DOUBLE * (SELECT count(*) FROM pt)), fold LIMIT 1)
SELECT 1 AS fold, CASE WHEN dl.fold = (SELECT fold FROM pk) THEN 'validation' ELSE 'train' END AS role, count(*) AS n FROM src JOIN dl USING (g) GROUP BY 2""")
def refit_split(s, d):
    p = _dealt_points(s, d)
    return _sizes(resampling.refit_split(resampling.resolve(resampling.region_cv("g", 3, test_frac=0.0), p), p, 0.25).rows)


@query(""", a AS (SELECT sample_id, CASE WHEN sample_id % 5 = 0 THEN 'validation' ELSE 'train' END AS old, CASE WHEN sample_id % 4 = 0 THEN 'validation' ELSE 'train' END AS new FROM pt)
SELECT 1 AS fold, sample_id, old AS role, 'lost' AS change FROM a WHERE old <> new UNION ALL SELECT 1, sample_id, new, 'gained' FROM a WHERE old <> new""")
def plan_changes(s, d):
    of = lambda n: points(s, d).select(F.lit(1).alias("fold"), "sample_id", F.when(F.col("sample_id") % n == 0, "validation").otherwise("train").alias("role"))
    return resampling.plan_changes(of(4), of(5))


@query(f""", src AS (SELECT sample_id, (sample_id % 23)::VARCHAR AS g FROM pt), {_deal('src', 3)}, {_rows(3)}, q AS (SELECT pl.*, x, y FROM pl JOIN pt USING (sample_id)),
h AS (SELECT fold, role, role = 'train' AND EXISTS (SELECT 1 FROM q b WHERE b.fold = a.fold AND b.role = 'validation' AND greatest(abs(a.x - b.x), abs(a.y - b.y)) <= 0.5) AS hit FROM q a)
SELECT fold, count(*) FILTER (role = 'train') AS n_train_before, count(*) FILTER (hit) AS n_dropped, count(*) FILTER (hit) AS n_near_validation, 0::BIGINT AS n_near_test, 0::BIGINT AS n_near_calibration,
count(*) FILTER (role = 'validation') AS n_validation_before, 0::BIGINT AS n_validation_dropped, round(100 * count(*) FILTER (hit) / count(*) FILTER (role = 'train'), 2) AS pct_dropped FROM h GROUP BY fold""")
def buffer_report(s, d):
    p = _dealt_points(s, d)
    return resampling.buffer_report(plans.kfold_plan(p, "g", 3), p, 0.5)


def _rules(s):
    return store.qc_table(s, ["b0", "b1", "b2"], {"^b[01]$": 5.0}, ["b2"], (10.0, 60.0))


_CLEAN = "cl AS (SELECT band, \"row\", col, CASE WHEN value IS NULL THEN NULL WHEN band = 'b2' THEN least(greatest(value, 10), 60) WHEN value > 5 THEN value END AS value FROM ce)"


@query(f", {_CLEAN} SELECT band, count(*) AS n, count(value) AS n_valid, round(min(value), 6) AS low, round(max(value), 6) AS high, round(sum(value), 2) AS total FROM cl GROUP BY band")
def qc_by_table(s, d):
    v = F.col("value")
    return store.apply_qc(cells(s, d), _rules(s), "band").groupBy("band").agg(F.count("*").alias("n"), F.count(v).alias("n_valid"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.sum(v), 2).alias("total"))


def _prepared(s, d):
    k = F.col("sample_id")
    p = points(s, d).select("sample_id", F.col("profile").alias("profile_id"), (k % 40).cast("int").alias("row"), (F.floor(k / 7) % 40).cast("int").alias("col"), F.when(k % 13 != 0, F.col("value")).alias("target"))
    return store.prepare(p, cells(s, d), _rules(s), [1, 3], "log1p")


_PREPARED = f"""{_CLEAN}, pr AS (SELECT sample_id, profile, value, (sample_id % 40)::INT AS "row", ((sample_id // 7) % 40)::INT AS col FROM pt WHERE sample_id % 13 <> 0),
nb AS (SELECT sample_id, band, count(cl.value) AS n, max(cl.value) FILTER (dr = 0 AND dc = 0) AS centre, sum(cl.value) AS total FROM pr, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) JOIN cl ON cl."row" = pr."row" + dr AND cl.col = pr.col + dc GROUP BY 1, 2),
ok AS (SELECT sample_id FROM nb GROUP BY 1 HAVING count(*) FILTER (n = 9) = 3)"""


@query(f", {_PREPARED} SELECT sample_id, profile AS profile_id, pr.\"row\", pr.col, round(value, 6) AS target_native, round(ln(1 + value), 6) AS target_transform FROM pr WHERE sample_id IN (SELECT sample_id FROM ok)")
def prepare_samples(s, d):
    return store.check_contract(_prepared(s, d)["samples"])


@query(f", {_PREPARED} SELECT reason, n FROM (SELECT 'target' AS reason, count(*) AS n FROM pt WHERE sample_id % 13 = 0 UNION ALL SELECT 'patch', count(*) FROM pr WHERE sample_id NOT IN (SELECT sample_id FROM ok)) WHERE n > 0")
def prepare_dropped(s, d):
    return _prepared(s, d)["dropped"]


@query(f""", {_PREPARED} SELECT sample_id, band, round(centre, 6) AS centre, round(total / 9, 6) AS window_mean FROM nb WHERE sample_id IN (SELECT sample_id FROM ok)""")
def store_round_trip(s, d):
    path = shared_path(s, "store")
    spec = {"predictors": ["b0", "b1", "b2"], "windows": [1, 3], "target": "value", "transform": "log1p", "cell_size": 0.5}
    store.write_store(_prepared(s, d), path, spec)
    _, patches = store.read_store(s, path, 3, predictors=["b0", "b1", "b2"], cell_size=0.5)
    return raster.window_features(patches.withColumn("valid", F.lit(True)), 3)


@query("""SELECT band, count(*) AS n FROM ce WHERE "row" BETWEEN 2 AND 6 AND col BETWEEN 4 AND 9 GROUP BY band""")
def crop_extent(s, d):
    # Cells of half a unit, the north-west corner at (0, 20).
    return store.crop(cells(s, d), (2.0, 5.0, 16.5, 19.0), 0.0, 20.0, 0.5).groupBy("band").agg(F.count("*").alias("n"))


@query("""SELECT fold, predictor, round(avg(v), 6) AS fill, round((avg(v) - 10) / 4, 6) AS fill_scaled FROM (SELECT k AS fold, unnest(['quantity', 'tax']) AS predictor, unnest([l_quantity, l_tax]) AS v
FROM o, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE fold <> k) GROUP BY ALL""")
def importance_fill_values(s, d):
    x = obs(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> k")
    z = F.explode(F.array(*[F.struct(F.lit(n).alias("predictor"), F.col(c).alias("value")) for n, c in (("quantity", "l_quantity"), ("tax", "l_tax"))]))
    long = x.select(F.col("k").alias("fold"), z.alias("z")).select("fold", "z.*")
    scaling = long.select("fold", "predictor", F.lit(10.0).alias("center"), F.lit(4.0).alias("scale")).distinct()
    return store.fill_values(long, scaling)


def _predictions(s, d):
    x = logs(s, d).withColumn("dataset_role", F.when(F.col("fold") == 0, "test").otherwise("validation"))
    return x.withColumnsRenamed({"obs_t": "obs_transform", "pred_t": "pred_transform"})


@query(""", u AS (SELECT config_id, fold, seed, 2 * covar_pop(obs, pred) / (var_pop(obs) + var_pop(pred) + (avg(obs) - avg(pred)) ** 2) AS ccc FROM o WHERE fold = 0 GROUP BY ALL)
SELECT *, (row_number() OVER (ORDER BY test_mean DESC, config_id))::INT AS test_rank, config_id = 3 AS chosen FROM (SELECT config_id, count(*) AS n_units, round(avg(ccc), 6) AS test_mean, round(stddev_samp(ccc), 6) AS test_sd FROM u GROUP BY 1)""")
def frozen_test_scores(s, d):
    record = final.freeze(s, shared_path(s, "choice.json"), 3, "manual")
    return final.score_test(_predictions(s, d), record)


@query()
def final_choice(s, d):
    u = units(s, d)
    from .operators.selection import summarise_resamples

    by = summarise_resamples(u, ["val_ccc", "val_mae"]).join(u.groupBy("config_id").agg(F.max("n_params").alias("n_params")), "config_id")
    got = final.select_config(by, u)
    return s.createDataFrame([(got["config_id"], got["rule"], got["doubtful"])], "config_id long, rule string, doubtful boolean")


_STRATA = """ed AS (SELECT list_distinct(quantile_cont(pred, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS e FROM o), w AS (SELECT site, (obs BETWEEN pred * 0.7 AND pred * 1.3)::INT::DOUBLE AS i, pred * 1.3 - pred * 0.7 AS w,
least(greatest(len(list_filter(e, lambda v: v <= pred)), 1), greatest(len(e) - 1, 1))::INT AS level FROM o, ed),
st AS (SELECT 'all' AS stratum_type, 'points' AS stratum, count(*) AS n, avg(i) AS coverage, avg(w) AS mean_width FROM w UNION ALL
SELECT 'all', 'groups', count(*), avg(i), avg(w) FROM (SELECT site, avg(i) AS i, avg(w) AS w FROM w GROUP BY 1) UNION ALL SELECT 'level', level::VARCHAR, count(*), avg(i), avg(w) FROM w GROUP BY level)"""


def _strata(s, d):
    x = obs(s, d).withColumn("lower", F.col("pred") * 0.7).withColumn("upper", F.col("pred") * 1.3).withColumn("method", F.lit("band"))
    return final.stratum_coverage(x, "site", ["method"])


@query(f", {_STRATA} SELECT 'band' AS method, stratum_type, stratum, n, round(coverage, 6) AS coverage, round(mean_width, 6) AS mean_width FROM st")
def coverage_by_stratum(s, d):
    return _strata(s, d)


@query(f""", {_STRATA} SELECT 'band' AS method, max(n) FILTER (stratum = 'points') AS n_test, round(max(coverage) FILTER (stratum = 'points'), 6) AS coverage, round(max(coverage) FILTER (stratum = 'groups'), 6) AS coverage_by_group,
NULL::DOUBLE AS coverage_inside_aoa, NULL::DOUBLE AS coverage_outside_aoa, round(min(coverage) FILTER (stratum_type = 'level'), 6) AS worst_level_fifth, round(max(mean_width) FILTER (stratum = 'points'), 6) AS mean_width FROM st""")
def interval_summary(s, d):
    return final.interval_summary(_strata(s, d))


@query(f", {_STRATA} SELECT stratum_type, stratum, n FROM st ORDER BY coverage, stratum_type, stratum LIMIT 3")
def worst_coverage_first(s, d):
    return final.worst_first(_strata(s, d), 3).select("stratum_type", "stratum", "n")


@query(""", m AS (SELECT sample_id, min(obs_t) AS obs_t, median(pred_t) AS pred_t FROM lg WHERE config_id = 2 AND fold <> 0 GROUP BY 1) SELECT count(*) AS n, round(avg(exp(obs_t - pred_t)), 6) AS s, round(exp(avg(obs_t - pred_t) + var_samp(obs_t - pred_t) / 2), 6) AS s_lognormal,
round(sum(exp(pred_t) * exp(obs_t - pred_t)) / sum(exp(pred_t)), 6) AS s_weighted FROM m""")
def smearing_from_run(s, d):
    return final.smearing_from_run(_predictions(s, d), 2)


@query("SELECT sample_id, round(min(obs), 6) AS obs, round(median(pred), 6) AS pred, count(*) AS n_seeds FROM o WHERE fold <> 0 AND config_id = 4 GROUP BY 1")
def residuals_of_config(s, d):
    params = ["depth", "rate"]
    grid = s.range(1, 8).select(F.col("id").alias("config_id"), (F.col("id") % 4).alias("depth"), (F.col("id") * 0.5).alias("rate"))
    return final.residuals_of_config(_predictions(s, d), grid, grid.where("depth = 0 and rate = 2.0"), params)


@query("""SELECT 'mae' AS metric, round(avg((abs(pred - obs) < abs(l_quantity * 1500 - obs))::INT), 6) AS share_better FROM o UNION ALL SELECT 'rmse', round(avg(((pred - obs) ** 2 < (l_quantity * 1500 - obs) ** 2)::INT), 6) FROM o""")
def share_better(s, d):
    return final.share_better(obs(s, d).withColumn("other", F.col("l_quantity") * 1500), "other")


@query("""SELECT 'mae' AS metric, round(avg((a < 0)::INT), 6) AS share_better FROM (SELECT avg(abs(pred - obs) - abs(l_quantity * 1500 - obs)) AS a FROM o GROUP BY site)
UNION ALL SELECT 'rmse', round(avg((a < 0)::INT), 6) FROM (SELECT avg((pred - obs) ** 2 - (l_quantity * 1500 - obs) ** 2) AS a FROM o GROUP BY site)""")
def share_better_blocks(s, d):
    return final.share_better(obs(s, d).withColumn("other", F.col("l_quantity") * 1500), "other", "site")


@query("SELECT round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS loss, sum(l_quantity) AS n FROM o")
def loader_loss(s, d):
    return final.loader_loss(obs(s, d), "l_tax", "l_quantity")


@query("SELECT config_id || '' AS unit_id, count(*) AS n, round(sum(l_quantity), 6) AS seconds, round(count(*) / sum(l_quantity), 6) AS per_second FROM o GROUP BY 1")
def unit_throughput(s, d):
    return final.unit_table(obs(s, d).select(F.col("config_id").cast("string").alias("unit_id"), F.lit(1).cast("long").alias("n"), F.col("l_quantity").alias("seconds")))

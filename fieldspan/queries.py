"""Queries of the library's operators over the driver's tables, and the SQL each is held against.

Doubles are rounded to six digits after the point on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans
from .functions import d4
from .operators import importance, intervals, metrics, raster, selection, smearing, spatial, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {CTE} {sql}"
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CTE = """
o AS (SELECT l_orderkey * 10 + l_linenumber AS sample_id, l_extendedprice AS obs, l_quantity * p_retailprice AS pred, l_quantity, l_discount, l_tax,
             (l_orderkey % 5)::INT AS fold, l_returnflag AS grp, (l_suppkey % 97)::BIGINT AS site, l_linenumber AS config_id, (l_suppkey % 3)::INT AS seed
      FROM lineitem JOIN part ON l_partkey = p_partkey),
lg AS (SELECT *, ln(1 + obs) AS obs_t, ln(1 + pred) AS pred_t FROM o),
pt AS (SELECT o_orderkey AS sample_id, o_custkey AS profile, ((o_orderkey * 7919) % 1000) / 10.0::DOUBLE AS x, ((o_orderkey * 104729) % 1000) / 10.0::DOUBLE AS y, o_totalprice AS value FROM orders),
un AS (SELECT config_id::BIGINT AS config_id, fold, seed, CASE WHEN config_id = 7 AND fold = 4 THEN 'error' ELSE 'success' END AS status,
              2 * covar_pop(obs, pred) / (var_pop(obs) + var_pop(pred) + (avg(obs) - avg(pred)) ** 2) AS val_ccc, avg(abs(pred - obs)) AS val_mae, config_id * 1000 AS n_params,
              config_id || '_f' || fold || '_s' || seed AS unit_id
       FROM o GROUP BY config_id, fold, seed),
ce AS (SELECT 'b' || (event_id % 3) AS band, ((event_id // 3) // 40)::INT AS "row", ((event_id // 3) % 40)::INT AS col, CASE WHEN event_id % 211 = 0 THEN NULL ELSE value END AS value FROM events),
em AS (SELECT vec_id AS id, embedding AS v, (vec_id % 5)::INT AS fold FROM embeddings)"""


def obs(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"), F.col("l_extendedprice").alias("obs"), (F.col("l_quantity") * F.col("p_retailprice")).alias("pred"), "l_quantity", "l_discount", "l_tax",
        (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.col("l_returnflag").alias("grp"), (F.col("l_suppkey") % 97).alias("site"), F.col("l_linenumber").alias("config_id"), (F.col("l_suppkey") % 3).cast("int").alias("seed"),
    )


def logs(s: SparkSession, d: str) -> DataFrame:
    return obs(s, d).withColumn("obs_t", F.log1p("obs")).withColumn("pred_t", F.log1p("pred"))


def points(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("sample_id"), F.col("o_custkey").alias("profile"), ((k * 7919) % 1000 / 10.0).alias("x"), ((k * 104729) % 1000 / 10.0).alias("y"), F.col("o_totalprice").alias("value"))


def units(s: SparkSession, d: str) -> DataFrame:
    m = metrics.calc_metrics(obs(s, d), ["config_id", "fold", "seed"])
    status = F.when((F.col("config_id") == 7) & (F.col("fold") == 4), "error").otherwise("success")
    return m.select(
        F.col("config_id").cast("long").alias("config_id"), "fold", "seed", status.alias("status"), F.col("ccc").alias("val_ccc"), F.col("mae").alias("val_mae"), (F.col("config_id") * 1000).alias("n_params"),
        F.concat(F.col("config_id").cast("string"), F.lit("_f"), F.col("fold").cast("string"), F.lit("_s"), F.col("seed").cast("string")).alias("unit_id"),
    )


def cells(s: SparkSession, d: str) -> DataFrame:
    e, k = table(s, d, "events"), F.col("event_id")
    cell = F.floor(k / 3)
    return e.select(
        F.concat(F.lit("b"), (k % 3).cast("string")).alias("band"), F.floor(cell / 40).cast("int").alias("row"), (cell % 40).cast("int").alias("col"), F.when(k % 211 != 0, F.col("value")).alias("value")
    )


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("vec_id") % 5).cast("int").alias("fold"))


_M = """count(*) AS n, avg(obs) AS mo, avg(pred) AS mp, var_pop(obs) AS vo, var_pop(pred) AS vp, covar_pop(obs, pred) AS c, avg(abs(pred - obs)) AS mae,
    sqrt(avg((pred - obs) ** 2)) AS rmse, avg(pred - obs) AS bias, stddev_samp(obs) AS so"""
_MS = """n, round(2 * c / (vo + vp + (mo - mp) ** 2), 6) AS ccc, round(c * c / (vo * vp), 6) AS r2, round(mae, 6) AS mae, round(1 - rmse ** 2 / vo, 6) AS nse, round(rmse, 6) AS rmse,
    round(so / rmse, 6) AS rpd, round(2 * c / (vo + vp + (mo - mp) ** 2) * (1 - rmse ** 2 / vo) / (mae / mo), 6) AS mqi, round(bias, 6) AS bias, round(100 * bias / mo, 6) AS bias_pct"""


@query(f"SELECT grp, {_MS} FROM (SELECT grp, {_M} FROM o GROUP BY grp)")
def calc_metrics_by_group(s, d):
    return metrics.calc_metrics(obs(s, d), ["grp"])


@query(f"SELECT site, n, ccc FROM (SELECT site, {_MS} FROM (SELECT site, {_M} FROM o GROUP BY site))")
def ccc_by_group(s, d):
    return metrics.ccc_by_group(obs(s, d), ["site"])


@query(f""", e AS (SELECT quantile_cont(obs, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM o)
SELECT bin, {_MS} FROM (SELECT CASE WHEN obs <= q[1] THEN 'Q00_Q25' WHEN obs <= q[2] THEN 'Q25_Q50' WHEN obs <= q[3] THEN 'Q50_Q75' WHEN obs <= q[4] THEN 'Q75_Q90'
WHEN obs <= q[5] THEN 'Q90_Q95' WHEN obs <= q[6] THEN 'Q95_Q99' ELSE 'Q99_Q100' END AS bin, {_M} FROM o, e GROUP BY bin)""")
def quantile_performance(s, d):
    return metrics.quantile_performance(obs(s, d))


@query("""SELECT grp, round(avg(CASE WHEN abs(pred_t - obs_t) < 1 THEN 0.5 * (pred_t - obs_t) ** 2 ELSE abs(pred_t - obs_t) - 0.5 END), 6) AS smooth_l1,
round(avg((pred_t - obs_t) ** 2), 6) AS mse, round(avg(abs(pred_t - obs_t)), 6) AS mae FROM lg GROUP BY grp""")
def transform_space_loss(s, d):
    return metrics.transform_loss(logs(s, d), ["grp"], "obs_t", "pred_t")


@query("""SELECT *, row_number() OVER (ORDER BY m DESC, config_id)::INT AS rank FROM (
SELECT u.config_id, count(*) FILTER (status = 'success') AS n_units, count(DISTINCT fold) FILTER (status = 'success') AS n_folds, count(DISTINCT seed) FILTER (status = 'success') AS n_seeds,
round(avg(val_ccc) FILTER (status = 'success'), 6) AS val_ccc_mean, round(stddev_samp(val_ccc) FILTER (status = 'success'), 6) AS val_ccc_sd, round(avg(val_mae) FILTER (status = 'success'), 6) AS val_mae_mean,
round(stddev_samp(val_mae) FILTER (status = 'success'), 6) AS val_mae_sd, count(*) FILTER (status <> 'success') AS n_failed,
round(stddev_samp(val_ccc) FILTER (status = 'success') / sqrt(count(*) FILTER (status = 'success')), 6) AS val_ccc_se, avg(val_ccc) FILTER (status = 'success') AS m FROM un u GROUP BY u.config_id)""".replace("SELECT *,", "SELECT * EXCLUDE (m),", 1))
def summarise_resamples(s, d):
    return selection.summarise_resamples(units(s, d), ["val_ccc", "val_mae"])


@query("""SELECT count(*) AS n_groups, round(median(sd), 6) AS median_sd, round(max(r), 6) AS max_range FROM (
SELECT stddev_samp(val_ccc) AS sd, max(val_ccc) - min(val_ccc) AS r FROM un GROUP BY config_id, fold HAVING count(DISTINCT seed) > 1)""")
def seed_noise_floor(s, d):
    return selection.seed_noise_floor(units(s, d), "val_ccc")


@query(""", b AS (SELECT config_id, avg(val_ccc) AS m, stddev_samp(val_ccc) / sqrt(count(*)) AS se, max(n_params) AS n_params FROM un WHERE status = 'success' GROUP BY config_id),
t AS (SELECT m AS bm, se AS bs FROM b ORDER BY m DESC, config_id LIMIT 1)
SELECT config_id, round(m, 6) AS val_ccc_mean, n_params, round(bm, 6) AS best_mean, round(bs, 6) AS best_se, count(*) OVER () AS n_eligible FROM b, t WHERE m >= bm - bs ORDER BY n_params, config_id LIMIT 1""")
def one_se_pick(s, d):
    u = units(s, d)
    by = selection.summarise_resamples(u, ["val_ccc"]).join(u.groupBy("config_id").agg(F.max("n_params").alias("n_params")), "config_id")
    return selection.one_se(by, "val_ccc", "n_params")


@query(""", p AS (SELECT a.val_mae AS va, b.val_mae AS vb FROM un a JOIN un b ON a.fold = b.fold AND a.seed = b.seed WHERE a.config_id = 1 AND b.config_id = 2)
SELECT count(*) AS n_pairs, round(avg(va - vb), 6) AS mean_diff, round(stddev_samp(va - vb), 6) AS sd_diff, round(stddev_samp(va - vb) / sqrt(count(*)), 6) AS se,
round(sqrt((var_samp(va) + var_samp(vb)) / count(*)), 6) AS unpaired_se, round(avg(va - vb) / (stddev_samp(va - vb) / sqrt(count(*))), 6) AS t FROM p""")
def paired_family_test(s, d):
    u = units(s, d)
    return selection.paired_test(u.where("config_id = 1"), u.where("config_id = 2"), "val_mae")


@query("""SELECT unit_id, status, round(val_ccc, 6) AS val_ccc, CASE WHEN status = 'success' THEN sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (ORDER BY val_ccc DESC NULLS LAST, val_mae NULLS LAST, unit_id)::BIGINT END AS rank FROM un""")
def rank_comparison(s, d):
    return selection.rank_comparison(units(s, d)).select("unit_id", "status", "val_ccc", "rank")


@query("""SELECT unit_id, 'fold=' || fold || ';n_params=' || n_params || ';seed=' || seed AS signature FROM un""")
def config_signature(s, d):
    return selection.config_signature(units(s, d), ["seed", "n_params", "fold"]).select("unit_id", "signature")


@query("""SELECT site * 10 + config_id AS sample_id, round(min(obs), 6) AS obs, round(median(pred), 6) AS pred, count(*) AS n_seeds FROM o GROUP BY 1""")
def cv_residuals(s, d):
    return selection.cv_residuals(obs(s, d).withColumn("sample_id", F.col("site") * 10 + F.col("config_id")))


@query(""", h AS (SELECT grp AS run, site::INT AS epoch, avg(abs(pred - obs)) AS loss FROM o GROUP BY 1, 2),
w AS (SELECT *, avg(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS pm, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS r FROM h)
SELECT run, epoch AS best_epoch, round(loss, 6) AS best_loss, round(pm, 6) AS plateau_mean, round(pm - loss, 6) AS bias FROM w WHERE r = 1""")
def early_stopping_bias(s, d):
    h = obs(s, d).groupBy(F.col("grp").alias("run"), F.col("site").cast("int").alias("epoch")).agg(F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("loss"))
    return selection.early_stopping_bias(h, 10)


@query(""", a AS (SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_nationkey < 20), b AS (SELECT n_name AS key, (CASE WHEN n_nationkey % 4 = 0 THEN 9 ELSE n_regionkey END)::VARCHAR AS value FROM nation WHERE n_nationkey > 4)
SELECT coalesce(a.key, b.key) AS key, a.value AS new_value, b.value AS old_value, CASE WHEN b.value IS NULL THEN 'new' WHEN a.value IS NULL THEN 'gone' WHEN a.value = b.value THEN '=' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.key = b.key""")
def snapshot_diff(s, d):
    n, v = table(s, d, "nation"), F.col("n_regionkey")
    now = n.where("n_nationkey < 20").select(F.col("n_name").alias("key"), v.cast("string").alias("value"))
    before = n.where("n_nationkey > 4").select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 4 == 0, 9).otherwise(v).cast("string").alias("value"))
    return selection.snapshot_diff(now, before)


_Q = "quantile_q AS (SELECT count(*) AS n, ceil((count(*) + 1) * 0.9::DOUBLE)::BIGINT AS k, list_sort(list(abs(obs - pred))) AS a FROM o)"


@query(f", {_Q} SELECT n, k, round(CASE WHEN k <= n THEN a[k] ELSE 'inf'::DOUBLE END, 6) AS q FROM quantile_q")
def conformal_point(s, d):
    return intervals.conformal_point(obs(s, d))


@query(""", w AS (SELECT abs(obs - pred) AS r, 1.0::DOUBLE / count(*) OVER (PARTITION BY site) AS w FROM o), m AS (SELECT count(DISTINCT site) AS m FROM o),
c AS (SELECT r, sum(w) AS w FROM w GROUP BY r), cu AS (SELECT r, sum(w) OVER (ORDER BY r) AS cw FROM c)
SELECT m, round(coalesce(min(r) FILTER (cw >= 0.9::DOUBLE * (m + 1) - 1e-9::DOUBLE * (m + 1)), 'inf'::DOUBLE), 6) AS q FROM cu, m GROUP BY m""")
def conformal_group(s, d):
    return intervals.conformal_group(obs(s, d), "site")


_CV = """cal AS (SELECT f.fold, list_sort(list(abs(obs - pred))) AS a, ceil((count(*) + 1) * 0.9::DOUBLE)::BIGINT AS k FROM o JOIN (SELECT DISTINCT fold FROM o) f ON o.fold <> f.fold GROUP BY f.fold),
iv AS (SELECT o.*, greatest(pred - a[k], 0) AS lower, pred + a[k] AS upper FROM o JOIN (SELECT fold, k, a, a[k] AS q FROM cal) c USING (fold))"""


def _cv_intervals(s, d):
    x = intervals.conformal_cv(obs(s, d))
    return x.withColumn("lower", F.greatest("lower", F.lit(0.0)))


@query(f", {_CV} SELECT grp, count(*) AS n, round(avg((obs BETWEEN lower AND upper)::INT), 6) AS picp, round(avg(upper - lower), 6) AS mean_width, round(median(upper - lower), 6) AS median_width FROM iv GROUP BY grp")
def coverage_by_group(s, d):
    return metrics.coverage(_cv_intervals(s, d), ["grp"])


@query(f""", {_CV}, z AS (SELECT site, grp, (obs BETWEEN lower AND upper)::INT AS i FROM iv)
SELECT 'all' AS stratum, 'points' AS level, count(*) AS n, round(avg(i), 6) AS coverage FROM z UNION ALL SELECT 'all', 'groups', count(*), round(avg(i), 6) FROM (SELECT avg(i) AS i FROM z GROUP BY site)
UNION ALL SELECT 'grp', grp, count(*), round(avg(i), 6) FROM z GROUP BY grp""")
def coverage_rows(s, d):
    return metrics.coverage_rows(_cv_intervals(s, d), "site", "grp")


_SC = """ln AS (SELECT count(*) AS n, avg(r) - covar_pop(l_quantity, r) / var_pop(l_quantity) * avg(l_quantity) AS b0, covar_pop(l_quantity, r) / var_pop(l_quantity) AS b1, 0.05 * median(r) AS fl FROM (SELECT *, abs(obs - pred) AS r FROM o WHERE {})),"""


@query(f", {_SC.format('true')[:-1]} SELECT n, round(b0, 6) AS b0, round(b1, 6) AS b1, round(fl, 6) AS floor FROM ln")
def conformal_scale_fit(s, d):
    return intervals.scale_fit(obs(s, d), "l_quantity")


@query(f""", {_SC.format('fold < 2')} z AS (SELECT sample_id, obs, pred, greatest(b0 + b1 * l_quantity, fl) AS sc FROM o, ln WHERE fold >= 2),
q AS (SELECT list_sort(list(abs(obs - pred) / sc))[ceil((count(*) + 1) * 0.9::DOUBLE)::BIGINT] AS q FROM z)
SELECT count(*) AS n, round(avg((obs BETWEEN pred - q * sc AND pred + q * sc)::INT), 6) AS picp, round(avg((pred + q * sc) - (pred - q * sc)), 6) AS mean_width, round(median((pred + q * sc) - (pred - q * sc)), 6) AS median_width FROM z, q""")
def conformal_scaled_interval(s, d):
    return metrics.coverage(intervals.scaled_interval(obs(s, d), "l_quantity", half=F.col("fold") < 2))


@query(""", c AS (SELECT fold, abs(obs - pred) AS s FROM o), n AS (SELECT count(*) AS n, ceil((count(*) + 1) * 0.9::DOUBLE)::BIGINT AS r FROM c),
a AS (SELECT vec_id AS id, list_transform([embedding[1], embedding[2], embedding[3], embedding[4], embedding[5]], lambda z: z::DOUBLE * 1000) AS mu FROM embeddings)
SELECT id, round(-(list_sort(list(-mu[fold + 1] + s))[max(r)]), 6) AS lower, round(list_sort(list(mu[fold + 1] + s))[max(r)], 6) AS upper FROM a, c, n GROUP BY id""")
def cv_plus_interval(s, d):
    c = obs(s, d).select("fold", F.abs(F.col("obs") - F.col("pred")).alias("score"))
    at = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double") * 1000).alias("mu"))
    return intervals.cv_plus(c, at)


@query("""SELECT count(*) AS n, round(avg(exp(obs_t - pred_t)), 6) AS s, round(exp(avg(obs_t - pred_t) + var_samp(obs_t - pred_t) / 2), 6) AS s_lognormal,
round(sum(exp(pred_t) * exp(obs_t - pred_t)) / sum(exp(pred_t)), 6) AS s_weighted FROM lg""")
def smearing_factor(s, d):
    return smearing.smearing_factor(logs(s, d))


_LV = """e AS (SELECT quantile_cont(pred_t, [0.2, 0.4, 0.6, 0.8]) AS q FROM lg),
lv AS (SELECT (len(list_filter(q, lambda v: v < pred_t)) + 1)::INT AS bin, median(pred_t) AS centre, avg(exp(obs_t - pred_t)) AS s, count(*) AS n FROM lg, e GROUP BY 1)"""


@query(f", {_LV} SELECT bin, round(centre, 6) AS centre, round(s, 6) AS s, n FROM lv")
def smearing_levels(s, d):
    return smearing.smearing_levels(logs(s, d))


@query(f""", {_LV}, st AS (SELECT centre, s, coalesce(lead(centre) OVER w, 1e9) AS nc, coalesce(lead(s) OVER w, s) AS ns, row_number() OVER w AS r FROM lv WINDOW w AS (ORDER BY centre)),
g AS (SELECT avg(exp(obs_t - pred_t)) AS s FROM lg),
z AS (SELECT lg.obs AS o, pred AS p0, greatest(exp(pred_t) * g.s - 1, 0) AS p1, greatest(exp(pred_t) * CASE WHEN nc = 1e9 OR pred_t < centre THEN st.s ELSE st.s + (ns - st.s) * (pred_t - centre) / (nc - centre) END - 1, 0) AS p2
      FROM lg, g JOIN st ON (pred_t >= centre AND pred_t < nc) OR (r = 1 AND pred_t < centre)),
u AS (SELECT 'median' AS method, o, p0 AS p FROM z UNION ALL SELECT 'global', o, p1 FROM z UNION ALL SELECT 'level', o, p2 FROM z)
SELECT method, count(*) AS n, round(100 * (sum(p) - sum(o)) / sum(o), 6) AS bias_pct, round(avg(abs(p - o)), 6) AS mae, round(sqrt(avg((p - o) ** 2)), 6) AS rmse FROM u GROUP BY method""")
def smearing_check(s, d):
    x = logs(s, d)
    y = smearing.smear(x, smearing.smearing_factor(x)).withColumnRenamed("mean_surface", "global")
    y = smearing.smear_level(y, smearing.smearing_levels(x)).withColumnRenamed("mean_surface", "level").withColumn("median", F.col("pred"))
    return smearing.smearing_check(y, ["median", "global", "level"])


_SIZES = [5.0, 10.0, 20.0, 50.0]
_BS = """sh AS (SELECT bs AS block_size, count(*) AS n_blocks, max(c) / sum(c) AS largest_share, median(c) AS median_count FROM (
SELECT bs, floor((x - x0) / bs) AS i, floor((y - y0) / bs) AS j, count(*) AS c FROM pt, (SELECT min(x) AS x0, min(y) AS y0 FROM pt), (SELECT unnest([5.0, 10.0, 20.0, 50.0])::DOUBLE AS bs) GROUP BY 1, 2, 3) GROUP BY bs)"""


@query(f", {_BS} SELECT block_size, n_blocks, round(largest_share, 6) AS largest_share, round(median_count, 6) AS median_count FROM sh")
def block_share(s, d):
    return plans.block_share(points(s, d), _SIZES)


@query(f", {_BS} SELECT coalesce(max(block_size) FILTER (largest_share <= 0.1 AND n_blocks >= 50), arg_min(block_size, largest_share)) AS block_size FROM sh")
def suggest_block_size(s, d):
    return plans.suggest_block_size(points(s, d), _SIZES)


@query(""", a AS (SELECT sample_id, -60 + x / 5 AS lon, -30 + y / 5 AS lat FROM pt), b AS (SELECT sample_id, lat, lon, sin(radians(-20)) * sin(radians(lat)) + cos(radians(-20)) * cos(radians(lat)) * cos(radians(lon + 50)) AS cc FROM a),
k AS (SELECT *, sqrt(2 / (1 + cc)) * 6371.0072 AS k FROM b)
SELECT sample_id, floor(k * cos(radians(lat)) * sin(radians(lon + 50)) / 100)::BIGINT::VARCHAR || '_' || floor(k * (cos(radians(-20)) * sin(radians(lat)) - sin(radians(-20)) * cos(radians(lat)) * cos(radians(lon + 50))) / 100)::BIGINT::VARCHAR AS block FROM k""")
def equal_area_blocks(s, d):
    p = points(s, d).select("sample_id", (F.col("x") / 5 - 60).alias("lon"), (F.col("y") / 5 - 30).alias("lat"))
    return spatial.equal_area_blocks(p, 100.0, -50.0, -20.0).select("sample_id", "block")


_TEST = """tg AS (SELECT g FROM (SELECT g, sum(n) OVER (ORDER BY md5('1042_' || g) ROWS UNBOUNDED PRECEDING) - n AS bf, sum(n) OVER () AS al FROM (SELECT profile AS g, count(*) AS n FROM pt GROUP BY 1)) WHERE bf < ceil(al * 0.15::DOUBLE))"""


@query(f", {_TEST} SELECT sample_id, CASE WHEN profile IN (SELECT g FROM tg) THEN 'test' ELSE 'train' END AS role FROM pt")
def holdout_plan(s, d):
    p = points(s, d)
    test = plans.draw_groups(p, "profile", 0.15, 1042).withColumn("_t", F.lit(True))
    return p.join(test, p["profile"] == test["group"], "left").select("sample_id", F.when(F.col("_t"), "test").otherwise("train").alias("role"))


_DEAL = """sz AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, md5('42_' || g), g) AS i FROM (SELECT (sample_id % 23)::VARCHAR AS g, count(*) AS n FROM pt GROUP BY 1)),
dl AS (WITH RECURSIVE r AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS g, 0 AS f, [0, 0, 0]::BIGINT[] AS load
UNION ALL SELECT sz.i, sz.g, list_position(r.load, list_min(r.load)), list_transform(r.load, lambda v, k: CASE WHEN k = list_position(r.load, list_min(r.load)) THEN v + sz.n ELSE v END) FROM r JOIN sz ON sz.i = r.i + 1)
SELECT g, f::INT AS fold FROM r WHERE g IS NOT NULL)"""


def _dealt_points(s, d):
    return points(s, d).withColumn("g", (F.col("sample_id") % 23).cast("string"))


@query(f", {_DEAL} SELECT g AS \"group\", fold FROM dl")
def random_folds(s, d):
    return plans.deal(_dealt_points(s, d), "g", 3, 42)


_PLAN = _DEAL + """, pl AS (SELECT k.k AS fold, pt.sample_id, CASE WHEN dl.fold = k.k THEN 'validation' ELSE 'train' END AS role, x, y FROM pt JOIN dl ON dl.g = (pt.sample_id % 23)::VARCHAR, (SELECT unnest([1, 2, 3]) AS k) k)"""


@query(f", {_PLAN} SELECT fold, role, count(*) AS n FROM pl GROUP BY ALL")
def region_folds(s, d):
    return plans.kfold_plan(_dealt_points(s, d), "g", 3).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query(f""", {_PLAN} SELECT fold, role, count(*) AS n FROM pl a WHERE role = 'validation' OR NOT EXISTS (SELECT 1 FROM pl b WHERE b.fold = a.fold AND b.role = 'validation' AND greatest(abs(a.x - b.x), abs(a.y - b.y)) <= 0.5) GROUP BY ALL""")
def apply_buffer(s, d):
    p = _dealt_points(s, d)
    return plans.apply_buffer(plans.kfold_plan(p, "g", 3), p, 0.5).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query(f""", {_PLAN}, c AS (SELECT fold, role, round(x * 10)::BIGINT AS x, round(y * 10)::BIGINT AS y FROM pl),
h AS (SELECT fold, EXISTS (SELECT 1 FROM c b WHERE b.fold = a.fold AND b.role = 'train' AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2) AS e FROM c a WHERE role = 'validation')
SELECT fold, count(*) AS n, count(*) FILTER (e) AS n_shared, round(count(*) FILTER (e) / count(*), 6) AS share FROM h GROUP BY fold""")
def leakage_report(s, d):
    p = _dealt_points(s, d)
    c = p.select("sample_id", F.round(F.col("x") * 10).cast("long").alias("x"), F.round(F.col("y") * 10).cast("long").alias("y"))
    return plans.leakage(plans.kfold_plan(p, "g", 3), c, 3)


@query(f""", {_PLAN} SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'validation') AS n_validation, 0::BIGINT AS n_test, 0::BIGINT AS n_overlap, 0::BIGINT AS n_split_groups FROM pl GROUP BY fold""")
def check_fold_plan(s, d):
    p = _dealt_points(s, d)
    return plans.check_plan(plans.kfold_plan(p, "g", 3), p.select("sample_id", F.col("g").alias("group")))


@query(""", b AS (SELECT floor((x - x0) / 10)::BIGINT::VARCHAR || '_' || floor((y - y0) / 10)::BIGINT::VARCHAR AS g FROM pt, (SELECT min(x) AS x0, min(y) AS y0 FROM pt)), n AS (SELECT g, count(*) AS n FROM b GROUP BY g)
SELECT g AS "group" FROM (SELECT g, sum(n) OVER (ORDER BY md5('42_' || g) ROWS UNBOUNDED PRECEDING) - n AS bf, sum(n) OVER () AS al FROM n) WHERE bf < ceil(al * 0.3::DOUBLE)""")
def block_subsample(s, d):
    return plans.draw_groups(plans.blocks(points(s, d), 10.0), "block", 0.3, 42)


_DI = """tr AS (SELECT * FROM em WHERE fold <> 0), un2 AS (SELECT avg(list_distance(a.v::DOUBLE[], b.v::DOUBLE[])) AS u, count(*) AS n FROM tr a JOIN tr b ON a.id < b.id),
cvd AS (SELECT a.id, min(list_distance(a.v::DOUBLE[], b.v::DOUBLE[])) / max(u) AS di FROM tr a JOIN tr b ON a.fold <> b.fold, un2 GROUP BY a.id)"""


def _cloud(s, d):
    t = vectors(s, d).where("fold <> 0")
    return t, spatial.di_reference(t)


@query(f", {_DI} SELECT round(u, 6) AS avg_dist, n AS n_pairs FROM un2")
def di_reference(s, d):
    return _cloud(s, d)[1]


@query(f", {_DI} SELECT a.id, round(min(list_distance(a.v::DOUBLE[], b.v::DOUBLE[])) / max(u), 6) AS di FROM em a, tr b, un2 WHERE a.fold = 0 GROUP BY a.id")
def dissimilarity_index(s, d):
    t, u = _cloud(s, d)
    return spatial.dissimilarity(t, vectors(s, d).where("fold = 0"), u.select("avg_dist"))


@query(f", {_DI} SELECT round(quantile_cont(di, 0.75) + 1.5 * (quantile_cont(di, 0.75) - quantile_cont(di, 0.25)), 6) AS threshold FROM cvd")
def aoa_threshold(s, d):
    t, u = _cloud(s, d)
    return spatial.aoa_threshold(spatial.cross_fold_di(t, u.select("avg_dist")))


@query(f""", {_DI}, th AS (SELECT quantile_cont(di, 0.75) + 1.5 * (quantile_cont(di, 0.75) - quantile_cont(di, 0.25)) AS t FROM cvd),
x AS (SELECT a.id, min(list_distance(a.v::DOUBLE[], b.v::DOUBLE[])) / max(u) AS di FROM em a, tr b, un2 WHERE a.fold = 0 GROUP BY a.id) SELECT id, di <= t AS inside FROM x, th""")
def inside_aoa(s, d):
    t, u = _cloud(s, d)
    u = u.select("avg_dist")
    return spatial.inside_aoa(spatial.dissimilarity(t, vectors(s, d).where("fold = 0"), u), spatial.aoa_threshold(spatial.cross_fold_di(t, u))).select("id", "inside")


@query(""", z AS (SELECT sample_id AS id, x, y, value - (SELECT avg(value) FROM pt) AS z FROM pt), m AS (SELECT avg(z * z) AS v, count(*) AS n FROM z),
p AS (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.z * b.z AS zz FROM z a JOIN z b ON a.id < b.id AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3)
SELECT CASE WHEN d < 1 THEN 1 WHEN d < 2 THEN 2 ELSE 3 END AS class, count(*) AS n_pairs, round(avg(zz) / max(v), 6) AS moran, round(-1.0::DOUBLE / (max(n) - 1), 6) AS expected FROM p, m WHERE d < 3 GROUP BY 1""")
def spatial_correlogram(s, d):
    return spatial.correlogram(points(s, d).withColumnRenamed("sample_id", "id"), [0.0, 1.0, 2.0, 3.0])


def _boot(sums, n_boot):
    """SQL of block bootstrap rows (metric, estimate, lower, upper) of a table s (b and the sums)."""
    names = ("n", "a", "q", "e", "o", "p", "oo", "pp", "op")
    total = ", ".join(f"sum({c}) AS {c}" for c in names)
    drawn = ", ".join(f"sum({c} * w) AS {c}" for c in names)
    ccc = "2 * (op / n - o / n * p / n) / (oo / n - (o / n) ** 2 + pp / n - (p / n) ** 2 + (o / n - p / n) ** 2)"
    rows = f"unnest([{{'metric': 'mae', 'value': a / n}}, {{'metric': 'rmse', 'value': sqrt(q / n)}}, {{'metric': 'bias', 'value': e / n}}, {{'metric': 'ccc', 'value': {ccc}}}]) AS z"
    return f""", {sums}, nb AS (SELECT b, row_number() OVER (ORDER BY md5(b)) - 1 AS k, count(*) OVER () AS m FROM s),
    dw AS (SELECT r, k, count(*) AS w FROM (SELECT r, ('0x' || substr(md5('42_' || r || '_' || (k + 1)), 1, 8))::BIGINT % m AS k FROM nb, (SELECT unnest(range(1, {n_boot + 1})) AS r)) GROUP BY 1, 2),
    rp AS (SELECT z.metric, z.value FROM (SELECT {rows} FROM (SELECT r, {drawn} FROM dw JOIN nb USING (k) JOIN s USING (b) GROUP BY r))),
    po AS (SELECT z.metric, z.value FROM (SELECT {rows} FROM (SELECT {total} FROM s)))
    SELECT metric, round(max(po.value), 6) AS estimate, round(quantile_cont(rp.value, 0.025), 6) AS lower, round(quantile_cont(rp.value, 0.975), 6) AS upper FROM po JOIN rp USING (metric) GROUP BY metric"""


_SUMS = """sum(1.0::DOUBLE) AS n, sum(abs(p - o)) AS a, sum((p - o) ** 2) AS q, sum(p - o) AS e, sum(o) AS o, sum(p) AS p, sum(o * o) AS oo, sum(p * p) AS pp, sum(o * p) AS op"""


@query(_boot(f"s AS (SELECT site::VARCHAR AS b, {_SUMS} FROM (SELECT site, obs - (SELECT avg(obs) FROM o) AS o, pred - (SELECT avg(obs) FROM o) AS p FROM o) GROUP BY 1)", 200))
def block_bootstrap(s, d):
    return spatial.block_bootstrap(obs(s, d), "site")


@query("""SELECT band, count(*) AS n, count(*) FILTER (value <= 2) AS low, round(avg(CASE WHEN value > 2 THEN least(greatest(value, 5), 60) END), 6) AS mean FROM ce GROUP BY band""")
def qc_rules(s, d):
    c = cells(s, d)
    low = F.count_if(F.col("raw") <= 2).alias("low")
    return raster.qc(c.withColumn("raw", F.col("value")), "value", 2.0, (5.0, 60.0)).groupBy("band").agg(F.count("*").alias("n"), low, F.avg("value").alias("mean"))


_LONG = """lo AS (SELECT fold, sample_id, 'quantity' AS predictor, l_quantity::DOUBLE AS value FROM o UNION ALL SELECT fold, sample_id, 'discount', l_discount FROM o UNION ALL SELECT fold, sample_id, 'returned', (grp = 'R')::INT::DOUBLE FROM o),
ty AS (SELECT predictor, count(DISTINCT value) AS n_unique, min(value) AS min, max(value) AS max, count(*) FILTER (value IS NULL) AS n_na, count(DISTINCT value) <= 2 AND count(*) FILTER (value NOT IN (0, 1)) = 0 AS is_dummy FROM lo GROUP BY 1)"""


def _long(s, d):
    z = F.explode(F.array(*[F.struct(F.lit(n).alias("predictor"), c.cast("double").alias("value")) for n, c in (("quantity", F.col("l_quantity")), ("discount", F.col("l_discount")), ("returned", (F.col("grp") == "R").cast("int")))]))
    return obs(s, d).select("fold", "sample_id", z.alias("z")).select("fold", "sample_id", "z.*")


@query(f", {_LONG} SELECT *, CASE WHEN n_unique <= 1 THEN 'constant' WHEN n_unique <= 2 AND NOT is_dummy THEN 'near_constant' WHEN n_na > 0 THEN 'has_na' ELSE 'ok' END AS risk FROM ty")
def predictor_types(s, d):
    return raster.predictor_types(_long(s, d))


_SCAL = _LONG + ", sc AS (SELECT fold, predictor, CASE WHEN is_dummy THEN 0 ELSE avg(value) END AS center, CASE WHEN is_dummy THEN 1 ELSE stddev_samp(value) END AS scale FROM lo JOIN ty USING (predictor) GROUP BY fold, predictor, is_dummy)"


@query(f", {_SCAL} SELECT fold, predictor, round(center, 6) AS center, round(scale, 6) AS scale, false AS degenerate FROM sc")
def fit_scaling(s, d):
    x = _long(s, d)
    return raster.fit_scaling(x, raster.predictor_types(x))


@query(f", {_SCAL} SELECT fold, predictor, count(*) AS n, round(min((value - center) / scale), 6) AS low, round(max((value - center) / scale), 6) AS high FROM lo JOIN sc USING (fold, predictor) GROUP BY 1, 2")
def scale_features(s, d):
    x = _long(s, d)
    z = raster.scale(x, raster.fit_scaling(x, raster.predictor_types(x)))
    return z.groupBy("fold", "predictor").agg(F.count("*").alias("n"), F.min("scaled").alias("low"), F.max("scaled").alias("high"))


_PA = """ctr AS (SELECT (o_orderkey * 3)::BIGINT AS sample_id, (o_orderkey % 40)::INT AS r0, ((o_orderkey // 7) % 40)::INT AS c0 FROM orders),
pa AS (SELECT sample_id, band, list(value ORDER BY col, "row") AS patch, count(value) = 9 AS valid FROM ctr, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) JOIN ce ON ce."row" = r0 + dr AND ce.col = c0 + dc GROUP BY 1, 2)"""


def _patches(s, d):
    k = F.col("o_orderkey")
    at = table(s, d, "orders").select((k * 3).alias("sample_id"), (k % 40).cast("int").alias("row"), (F.floor(k / 7) % 40).cast("int").alias("col"))
    return raster.patches(cells(s, d), at, 3)


@query(f", {_PA} SELECT sample_id, band, round(patch[5], 6) AS centre, round(list_sum(patch) / 9, 6) AS window_mean FROM pa WHERE valid")
def window_mean_features(s, d):
    return raster.window_features(_patches(s, d), 3)


@query(f", {_PA} SELECT sample_id, band, round(patch[7], 6) AS turned FROM pa WHERE valid")
def patch_d4(s, d):
    return _patches(s, d).where("valid").select("sample_id", "band", F.get(d4(F.col("patch"), 3, 1), F.lit(0)).alias("turned"))


@query(f", {_PA}, b AS (SELECT *, sum((NOT valid)::INT) OVER (PARTITION BY sample_id) AS al FROM pa) SELECT band, sum((NOT valid)::INT)::BIGINT AS n_invalidated, count(*) FILTER (NOT valid AND al = 1) AS n_sole_cause FROM b GROUP BY band")
def patch_blame(s, d):
    return raster.patch_blame(_patches(s, d))


@query(f", {_PA} SELECT band, ring, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT band, CASE WHEN i = 5 THEN 0 ELSE 1 END AS ring, patch[i] AS v FROM pa, (SELECT unnest(range(1, 10)) AS i) WHERE valid) GROUP BY 1, 2")
def ring_index(s, d):
    return raster.ring_means(_patches(s, d), 3)


@query("""SELECT band, "row", col, round(value, 6) AS value FROM ce WHERE value IS NOT NULL AND "row" % 5 = 0 AND col % 5 = 0""")
def prediction_sample(s, d):
    return raster.regular_sample(cells(s, d), 5)


_EN = """sd AS (SELECT site * 10 + config_id AS sample_id, greatest(pred - 20000, 0) AS p FROM o), md AS (SELECT sample_id, median(p) AS m FROM sd GROUP BY 1),
en AS (SELECT sample_id, median(p) AS median, avg(p) AS mean, coalesce(stddev_samp(p), 0) AS sd, median(abs(p - m)) * 1.4826 AS mad, min(p) AS min, max(p) AS max FROM sd JOIN md USING (sample_id) GROUP BY 1)"""


def _ensemble(s, d):
    return raster.ensemble_bands(obs(s, d).select((F.col("site") * 10 + F.col("config_id")).alias("sample_id"), (F.col("pred") - 20000).alias("pred")))


@query(f", {_EN} SELECT sample_id, round(median, 6) AS median, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mad, 6) AS mad, round(min, 6) AS min, round(max, 6) AS max FROM en")
def ensemble_bands(s, d):
    return _ensemble(s, d)


@query(f", {_EN} SELECT band, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean FROM (SELECT 'median' AS band, median AS v FROM en UNION ALL SELECT 'sd', sd FROM en) GROUP BY band")
def band_summary(s, d):
    return raster.band_summary(_ensemble(s, d), ["median", "sd"])


_IM = "rw AS (SELECT seed AS model, grp || config_id AS variable, fold AS draw, avg(abs(pred - obs)) AS dr FROM o GROUP BY ALL), im AS (SELECT variable, avg(m) AS importance, stddev_samp(m) AS sd_models, sqrt(avg(v)) AS sd_draws FROM (SELECT model, variable, avg(dr) AS m, var_samp(dr) AS v FROM rw GROUP BY ALL) GROUP BY variable)"


def _raw(s, d):
    x = obs(s, d).groupBy(F.col("seed").alias("model"), F.concat(F.col("grp"), F.col("config_id").cast("string")).alias("variable"), F.col("fold").alias("draw"))
    return x.agg(F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("drop"))


@query(f", {_IM} SELECT variable, round(importance, 6) AS importance, round(sd_models, 6) AS sd_models, round(sd_draws, 6) AS sd_draws, row_number() OVER (ORDER BY importance DESC, variable)::INT AS rank FROM im")
def importance_aggregate(s, d):
    return importance.importance_aggregate(_raw(s, d))


@query(f", {_IM} SELECT variable, round(greatest(importance - 30000, 0) / avg(greatest(importance - 30000, 0)) OVER (), 6) AS weight FROM im")
def importance_weights(s, d):
    return importance.importance_weights(importance.importance_aggregate(_raw(s, d)).withColumn("importance", F.col("importance") - 30000))


@query(f""", {_IM}, ib AS (SELECT variable, avg(dr) AS importance FROM rw WHERE model = 1 GROUP BY 1)
SELECT im.variable, round(im.importance / max(im.importance) OVER (), 6) AS share_a, rank() OVER (ORDER BY im.importance DESC)::INT AS rank_a, round(ib.importance / max(ib.importance) OVER (), 6) AS share_b, rank() OVER (ORDER BY ib.importance DESC)::INT AS rank_b,
round((rank() OVER (ORDER BY im.importance DESC) + rank() OVER (ORDER BY ib.importance DESC)) / 2, 6) AS mean_rank FROM im JOIN ib USING (variable)""")
def compare_importance(s, d):
    r = _raw(s, d)
    return importance.compare_importance(importance.importance_aggregate(r), importance.importance_aggregate(r.where("model = 1")))


@query(""", dd AS (SELECT grp AS variable, floor(l_quantity / 10)::INT AS bin, count(*) AS n, avg(pred - obs) AS df FROM o GROUP BY ALL), ac AS (SELECT *, sum(df) OVER (PARTITION BY variable ORDER BY bin) AS acc FROM dd),
mi AS (SELECT *, acc - df / 2 AS mid FROM ac), ct AS (SELECT *, sum(mid * n) OVER (PARTITION BY variable) / sum(n) OVER (PARTITION BY variable) AS ctr FROM mi)
SELECT variable, bin, n, round(acc - ctr, 6) AS effect, round(mid - ctr, 6) AS mid_effect FROM ct""")
def ale_accumulate(s, d):
    x = obs(s, d).groupBy(F.col("grp").alias("variable"), F.floor(F.col("l_quantity") / 10).cast("int").alias("bin"))
    return importance.ale_accumulate(x.agg(F.count("*").alias("n"), F.avg(F.col("pred") - F.col("obs")).alias("diff")))


@query(""", vm AS (SELECT id, m AS mask, list_sum(list_transform(range(0, 4), lambda k: CASE WHEN (m >> k::INT) & 1 = 1 THEN v[k + 1]::DOUBLE * (1 + bit_count(m)) ELSE 0 END)) AS v FROM em, (SELECT unnest(range(0, 16))::INT AS m))
SELECT a.id, p AS player, round(sum(CASE bit_count(a.mask) WHEN 1 THEN 0.25 WHEN 2 THEN 1 / 12.0 WHEN 3 THEN 1 / 12.0 ELSE 0.25 END::DOUBLE * (a.v - b.v)), 6) AS phi
FROM vm a, (SELECT unnest([0, 1, 2, 3]) AS p) JOIN vm b ON b.id = a.id AND b.mask = xor(a.mask, 1 << p) WHERE (a.mask >> p) & 1 = 1 GROUP BY a.id, p""")
def shapley_exact(s, d):
    x = vectors(s, d).withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(15))))
    worth = F.expr("aggregate(transform(sequence(0, 3), k -> if((shiftright(mask, k) & 1) = 1, cast(v[k] as double) * (1 + bit_count(mask)), 0D)), 0D, (a, z) -> a + z)")
    return importance.shapley(x.select("id", "mask", worth.alias("v")), 4)


@query(""", q AS (SELECT list_sort(list(abs(obs - pred)))[ceil((count(*) + 1) * 0.9::DOUBLE)::BIGINT] AS q FROM o)
SELECT sample_id, round(greatest(pred - q, 0), 3) AS lower, round(pred + q, 3) AS upper FROM o, q""")
def conformal_interval(s, d):
    x = obs(s, d)
    return rounded(intervals.conformal_interval(x, intervals.conformal_point(x), lower_limit=0.0).select("sample_id", "lower", "upper"), 3)


@query(", f AS (SELECT avg(exp(obs_t - pred_t)) AS s FROM lg) SELECT sample_id, round(greatest(exp(pred_t) * s - 1, 0), 3) AS mean_surface FROM lg, f")
def smear_global(s, d):
    x = logs(s, d)
    return rounded(smearing.smear(x, smearing.smearing_factor(x)).select("sample_id", "mean_surface"), 3)


@query(""", e AS (SELECT quantile_cont(pred_t, [0.2, 0.4, 0.6, 0.8]) AS e FROM lg), b AS (SELECT obs_t, pred_t, len(list_filter(e, lambda v: v < pred_t)) + 1 AS bin FROM lg, e),
l AS (SELECT median(pred_t) AS c, avg(exp(obs_t - pred_t)) AS s FROM b GROUP BY bin), n AS (SELECT c, s, lead(c) OVER (ORDER BY c) AS c2, lead(s) OVER (ORDER BY c) AS s2 FROM l), lo AS (SELECT arg_min(s, c) AS s0 FROM l)
SELECT sample_id, round(greatest(exp(pred_t) * CASE WHEN c IS NULL THEN s0 WHEN c2 IS NULL THEN s ELSE s + (s2 - s) * (pred_t - c) / (c2 - c) END - 1, 0), 3) AS mean_surface FROM (SELECT * FROM lg ASOF LEFT JOIN n ON lg.pred_t >= n.c), lo""")
def smear_level(s, d):
    x = logs(s, d)
    return rounded(smearing.smear_level(x, smearing.smearing_levels(x)).select("sample_id", "mean_surface"), 3)


@query("SELECT arg_min(sample_id, sample_id) AS sample_id, profile, arg_min(x, sample_id) AS x, arg_min(y, sample_id) AS y, arg_min(value, sample_id) AS value FROM pt GROUP BY profile")
def first_by_profile(s, d):
    return tables.first_rows(points(s, d), "profile", "sample_id")


@query("""SELECT unit_id, CASE WHEN fold = 0 THEN 'rerun' ELSE status END AS status, round(CASE WHEN fold = 0 THEN val_mae / 2 ELSE val_mae END, 6) AS val_mae FROM un""")
def upsert_units(s, d):
    u = units(s, d).select("unit_id", "fold", "status", "val_mae")
    again = u.where("fold = 0").select("unit_id", "fold", F.lit("rerun").alias("status"), (F.col("val_mae") / 2).alias("val_mae"))
    return tables.upsert(u, again, ["unit_id"]).drop("fold")


@query("""SELECT a.fold, a.seed, round(a.val_mae, 6) AS a, round(b.val_mae, 6) AS b, round(b.val_mae - a.val_mae, 6) AS difference FROM un a JOIN un b USING (fold, seed) WHERE a.config_id = 1 AND b.config_id = 2""")
def paired_by_seed(s, d):
    u = units(s, d)
    return tables.paired(u.where("config_id = 1"), u.where("config_id = 2"), ["fold", "seed"], "val_mae")


@query("SELECT o.l_orderkey, o.l_linenumber, p_brand FROM lineitem o JOIN part ON l_partkey = p_partkey")
def strict_join(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return tables.strict_join(x, table(s, d, "part").select("p_partkey", "p_brand"), ["p_partkey"]).drop("p_partkey")


@query()
def spatial_folds(s, d):
    return plans.spatial_folds(points(s, d), distance=1.0, test_frac=0.15)

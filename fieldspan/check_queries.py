"""Queries of checks, applicability of raw rows, context and sampled explanations. They join those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import models
from .functions import mollweide
from .models import explain
from .more_queries import _model, features, order_patches
from .operators import checks, importance, intervals, selection, spatial
from .queries import _DI, _IM, _PA, _cloud, _patches, _raw, cells, obs, points, query, table, units, vectors


@query(f""", {_PA}, tb AS (SELECT (o_orderkey * 3)::BIGINT AS sample_id, band, CASE o_orderkey % 50 WHEN 0 THEN NULL WHEN 1 THEN value + 0.5 ELSE value END AS value FROM orders JOIN ce ON ce."row" = o_orderkey % 40 AND ce.col = (o_orderkey // 7) % 40),
j AS (SELECT pa.band, patch[5] AS c, tb.value AS v FROM pa JOIN tb USING (sample_id, band) WHERE len(patch) = 9)
SELECT band, count(*) AS n, count(*) FILTER ((c IS NULL) <> (v IS NULL)) AS n_missing, count(*) FILTER (abs(c - v) > 1e-6) AS n_off, round(max(abs(c - v)), 6) AS max_gap, count(*) FILTER ((c IS NULL) <> (v IS NULL) OR abs(c - v) > 1e-6) = 0 AS ok FROM j GROUP BY band""")
def check_patch_centres(s, d):
    k = F.col("o_orderkey")
    at = table(s, d, "orders").select(k, (k * 3).alias("sample_id"), (k % 40).cast("int").alias("row"), (F.floor(k / 7) % 40).cast("int").alias("col"))
    known = at.join(cells(s, d), ["row", "col"]).withColumn("value", F.when(k % 50 == 1, F.col("value") + 0.5).when(k % 50 != 0, F.col("value")))
    return checks.patch_centres(_patches(s, d).where(F.size("patch") == 9), known, 3)


@query(""", w AS (SELECT id, i, v[i]::DOUBLE AS phi FROM em, (SELECT unnest(range(1, 5)) AS i)), t AS (SELECT id, sum(phi) + CASE WHEN id % 9 = 0 THEN 0.25 ELSE 0 END AS total FROM w GROUP BY id)
SELECT count(*) AS n, round(max(abs(total - s)), 6) AS max_gap, count(*) FILTER (abs(total - s) > 1e-5 * greatest(1, abs(total))) AS n_off, count(*) FILTER (abs(total - s) > 1e-5 * greatest(1, abs(total))) = 0 AS ok
FROM t JOIN (SELECT id, sum(phi) AS s FROM w GROUP BY id) USING (id)""")
def attribution_gap(s, d):
    phi = vectors(s, d).select("id", F.posexplode(F.slice("v", 1, 4)).alias("player", "phi")).withColumn("phi", F.col("phi").cast("double"))
    totals = phi.groupBy("id").agg((F.sum("phi") + F.when(F.col("id") % 9 == 0, 0.25).otherwise(0.0)).alias("total"))
    return checks.attribution_gap(phi, totals)


@query(""", a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT c_custkey + 5 AS k FROM customer)
SELECT k AS key, 'both' AS status FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'missing' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'unexpected' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def compare_keys(s, d):
    return checks.compare_keys(table(s, d, "orders").select(F.col("o_custkey").alias("key")), table(s, d, "customer").select((F.col("c_custkey") + 5).alias("key")))


@query(""", f AS (SELECT CASE event_type WHEN 'click' THEN 'tune_' ELSE 'final_' END || user_id AS run, CASE WHEN event_id % 3 = 0 THEN 'units.csv' ELSE 'notes.txt' END AS file, ts FROM events)
SELECT run, ts AS modified FROM f WHERE file = 'units.csv' AND starts_with(run, 'final_') ORDER BY ts DESC, run DESC LIMIT 1""")
def latest_run(s, d):
    name = F.concat(F.when(F.col("event_type") == "click", "tune_").otherwise("final_"), F.col("user_id").cast("string"))
    file = F.when(F.col("event_id") % 3 == 0, "units.csv").otherwise("notes.txt")
    return checks.latest_run(table(s, d, "events").select(F.concat_ws("/", F.lit("/runs"), name, file).alias("path"), F.col("ts").alias("modified")), "final_", "units.csv")


@query("""SELECT user_id, min(ts) AS started, max(ts) AS ended, count(ts) AS n, date_sub('second', min(ts), max(ts)) AS seconds FROM events GROUP BY user_id""")
def run_times(s, d):
    return checks.run_times(table(s, d, "events"), "user_id", "ts")


@query("""SELECT printf('%d of %d rows (%.1f %%) from %d of %d strata', k, n, round(100 * k / n, 1), s, t) AS line
FROM (SELECT count(*) FILTER (l_quantity > 40) AS k, count(*) AS n, count(DISTINCT site) FILTER (l_quantity > 40) AS s, count(DISTINCT site) AS t FROM o)""")
def describe_subsample(s, d):
    return checks.describe_draw(obs(s, d).withColumn("drawn", F.col("l_quantity") > 40), "drawn", "site")


@query(f""", {_DI}, q AS (SELECT list_sort(list(abs(obs - pred)))[ceil((count(*) + 1) * 0.9::DOUBLE)::BIGINT] AS q FROM o), th AS (SELECT quantile_cont(di, 0.75) + 1.5 * (quantile_cont(di, 0.75) - quantile_cont(di, 0.25)) AS t FROM cvd),
x AS (SELECT a.id, min(list_distance(a.v::DOUBLE[], b.v::DOUBLE[])) / max(u) AS di FROM em a, tr b, un2 WHERE a.fold = 0 GROUP BY a.id), y AS (SELECT id, 1000 * id::DOUBLE AS pred, di <= t AS inside, q FROM x, th, q)
SELECT id, round(pred, 6) AS pred, inside, CASE WHEN inside THEN round(greatest(pred - q, 0), 6) END AS lower, CASE WHEN inside THEN round(pred + q, 6) END AS upper, CASE WHEN inside THEN round(pred + q - greatest(pred - q, 0), 6) END AS width FROM y""")
def calibrated_bands(s, d):
    t, u = _cloud(s, d)
    u = u.select("avg_dist")
    x = spatial.dissimilarity(t, vectors(s, d).where("fold = 0"), u).withColumn("pred", F.col("id") * 1000.0)
    return checks.calibrated_bands(x, intervals.conformal_point(obs(s, d)), spatial.aoa_threshold(spatial.cross_fold_di(t, u))).drop("di")


_RAW = """zz AS (SELECT id, fold, list_transform(v, lambda c, i: (c::DOUBLE - 0.01 * i) / (1 + 0.1 * i) * (1 + i % 3)) AS v FROM em), tz AS (SELECT * FROM zz WHERE fold <> 0),
uz AS (SELECT avg(list_distance(a.v, b.v)) AS u FROM tz a JOIN tz b ON a.id < b.id), cz AS (SELECT a.id, min(list_distance(a.v, b.v)) / max(u) AS di FROM tz a JOIN tz b ON a.fold <> b.fold, uz GROUP BY a.id),
hz AS (SELECT quantile_cont(di, 0.75) + 1.5 * (quantile_cont(di, 0.75) - quantile_cont(di, 0.25)) AS t FROM cz), xz AS (SELECT a.id, min(list_distance(a.v, b.v)) / max(u) AS di FROM zz a, tz b, uz WHERE a.fold = 0 GROUP BY a.id)"""


def _reference(s, d):
    v = vectors(s, d)
    n = range(1, v.select(F.size("v")).first()[0] + 1)
    return spatial.aoa_reference(v.where("fold <> 0"), [0.01 * i for i in n], [1 + 0.1 * i for i in n], [1 + i % 3 for i in n]), v.where("fold = 0")


@query(f", {_RAW} SELECT id, round(di, 6) AS di FROM xz")
def aoa_raw_rows(s, d):
    return spatial.aoa_di(*_reference(s, d))


@query(f""", {_RAW} SELECT count(*) AS n, round(max(t), 6) AS threshold, round(avg((di <= t)::INT), 6) AS share_inside, round(quantile_cont(di, 0.05), 6) AS q05, round(quantile_cont(di, 0.5), 6) AS q50, round(quantile_cont(di, 0.95), 6) AS q95, avg((di <= t)::INT) < 0.5 AS warn FROM xz, hz""")
def aoa_report(s, d):
    ref, rows = _reference(s, d)
    return spatial.aoa_report(spatial.aoa_di(ref, rows), ref.threshold)


@query(""", p AS (SELECT sample_id, radians(x * 3.6 - 180) AS lon, radians(y * 1.6 - 80) AS phi FROM pt),
t AS (SELECT *, list_reduce(list_prepend(phi, range(1, 11)::DOUBLE[]), lambda t, k: t - (2 * t + sin(2 * t) - pi() * sin(phi)) / (2 + 2 * cos(2 * t))) AS t FROM p)
SELECT sample_id, round(2 * sqrt(2) / pi() * 6378.137::DOUBLE * lon * cos(t), 3) AS east, round(sqrt(2) * 6378.137::DOUBLE * sin(t), 3) AS north FROM t""")
def project_xy(s, d):
    east, north = mollweide(F.col("x") * 3.6 - 180, F.col("y") * 1.6 - 80)
    return points(s, d).select("sample_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query(""", d AS (SELECT count(*) AS n, avg(a.val_mae - b.val_mae) AS m, stddev_samp(a.val_mae - b.val_mae) / sqrt(count(*)) AS se FROM un a JOIN un b ON a.fold = b.fold AND a.seed = b.seed WHERE a.config_id = 1 AND b.config_id = 2),
g AS (SELECT *, atan(abs(m / se) / sqrt(n - 1)) AS x0, n - 1 AS df FROM d), k AS (SELECT unnest(range(0, 4001)) AS i),
f AS (SELECT sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * greatest(cos(x0 + i * (pi() / 2 - x0) / 4000), 0) ** (df - 1)) * (pi() / 2 - max(x0)) / 4000 / 3 AS z FROM g, k GROUP BY x0, df)
SELECT n AS n_pairs, round(m, 6) AS mean_diff, round(se, 6) AS se, round(2 * z * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()), 6) AS p FROM g, f""")
def paired_family_p(s, d):
    u = units(s, d)
    return selection.paired_interval(u.where("config_id = 1"), u.where("config_id = 2"), "val_mae").select("n_pairs", "mean_diff", "se", "p")


@query(f""", {_IM}, ib AS (SELECT variable, avg(dr) AS importance FROM rw WHERE model = 1 GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY im.importance) + (count(*) OVER (PARTITION BY im.importance) - 1) / 2 AS a, rank() OVER (ORDER BY ib.importance) + (count(*) OVER (PARTITION BY ib.importance) - 1) / 2 AS b FROM im JOIN ib USING (variable))
SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r""")
def importance_agreement(s, d):
    r = _raw(s, d)
    return importance.rank_agreement(importance.importance_aggregate(r), importance.importance_aggregate(r.where("model = 1")))


@query()
def context_importance(s, d):
    x = order_patches(s, d)
    fitted = models.fit_one(x, "mlp", {"hidden": [16], "epochs": 12, "batch": 256})
    return importance.importance_aggregate(explain.context_importance(x, "mlp", fitted, 3, ["b0", "b1", "b2"], draws=2))


@query()
def sampled_shapley(s, d):
    x = features(s, d)
    return explain.sampled_shapley(x, "mlp", _model(s, d), explain.background_rows(x, 4), orders=8)


@query()
def gate_summary(s, d):
    x = order_patches(s, d)
    fitted = models.fit_one(x, "cnn", {"windows": [1, 3], "channels": [4], "epochs": 8})
    return explain.gate_summary(explain.gate_values(x, fitted))

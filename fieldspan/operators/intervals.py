"""Distribution-free intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, only_finite, running_sum

INF = float("inf")
#: CV+ cuts the scores into about so many runs at most, whose bounds every task has.
RUNS = 1_000_000


def _score(difficulty: str | None) -> Column:
    e = F.abs(F.col("obs") - F.col("pred"))
    return e / F.col(difficulty) if difficulty else e


def _coarse(s: Column) -> Column:
    """A whole number that does not fall as a score rises: 64 steps for each doubling, so a few thousand in all."""
    return F.when(s > 0, F.floor(F.log2(s) * 64)).otherwise(F.lit(-1 << 20)).cast("int")


def _fine(s: Column) -> Column:
    """Where in its coarse step a score is: 4096 equal parts."""
    low = F.pow(F.lit(2.0), _coarse(s) / F.lit(64.0))
    return F.when(s > 0, F.least(F.lit(4095), F.greatest(F.lit(0), F.floor((s / low - 1) / (2 ** (1 / 64) - 1) * 4096)))).otherwise(F.lit(0)).cast("int")


def _step_of(sums: DataFrame, need: DataFrame, by: list[str], step: str) -> DataFrame:
    """(by, _need, step, _before): the step in which the sums _t of a group reach _need less what lies before; some thousand steps a group."""
    upto = F.sum("_t").over(Window.partitionBy(*by).orderBy(step))
    at = sums.withColumn("_upto", upto).join(need, by)
    before = F.coalesce(F.col("_before"), F.lit(0)) if "_before" in need.columns else F.lit(0)
    # Sums of fractions may fall short by a rounding step; then it is the last step.
    reached = F.min(F.when(before + F.col("_upto") >= F.col("_need"), F.struct(step, (before + F.col("_upto") - F.col("_t")).alias("b"))))
    at = at.groupBy(*by, "_need").agg(F.coalesce(reached, F.max(F.struct(step, (before + F.col("_upto") - F.col("_t")).alias("b")))).alias("_at"))
    return at.select(*by, "_need", F.col(f"_at.{step}").alias(step), F.col("_at.b").alias("_before"))


def _least_reaching(s: DataFrame, coarse: DataFrame, need: DataFrame, by: list[str], apart: Column | None = None) -> DataFrame:
    """(by, q): the least score _s whose weights _m, summed over all scores up to it, reach _need of its group.

    The sums of coarse steps, combined before the shuffle, tell the step in which the sum is reached; sums of 4096 parts of
    that step tell the part; only the scores of that part are put in order. s has _s, _m, _c and by, or what tells by `apart`.
    """
    first = _step_of(coarse, need, by, "_c")
    on = [*([] if apart is not None else by), "_c"]
    inside = s.join(first, on)
    inside = (inside.where(apart) if apart is not None else inside).withColumn("_x", _fine(F.col("_s")))
    parts = inside.groupBy(*by, "_x").agg(F.sum("_m").alias("_t"))
    second = _step_of(parts, first.select(*by, "_need", "_before"), by, "_x").withColumnsRenamed({"_need": "_wanted", "_before": "_below"})
    last = inside.join(second, [*by, "_x"]).groupBy(*by, "_s", "_wanted", "_below").agg(F.sum("_m").alias("_t"))
    upto = F.col("_below") + F.sum("_t").over(Window.partitionBy(*by).orderBy("_s"))
    return last.withColumn("_r", upto).groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("_r") >= F.col("_wanted"), F.col("_s"))), F.max("_s")).alias("q"))


def percentiles(df: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """One row with q, the exact percentiles (interpolated) of the finite values, null of none; no task holds all values.

    The ranks around each level are found by the histograms of _least_reaching, for negative values on their mirror image.
    """
    x = df.select(F.col(value).cast("double").alias("_v")).where(finite("_v"))
    # The order of (sign, size): a negative value is the less the larger its size, so its steps count down.
    s = x.select((F.col("_v") < 0).alias("_neg"), F.abs("_v").alias("_s"), F.lit(1).alias("_m")).withColumn("_c", _coarse(F.col("_s")))
    coarse = s.groupBy("_neg", "_c").agg(F.sum("_m").alias("_t"))
    n = coarse.agg(F.coalesce(F.sum("_t"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.sum(F.when(F.col("_neg"), F.col("_t"))), F.lit(0).cast("long")).alias("neg"))
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    rank = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in levels]))))
    ranks = n.where("n > 0").select("n", "neg", rank.alias("_k"))
    below = F.col("_k") < F.col("neg")
    need = ranks.select("_k", below.alias("_neg"), F.when(below, F.col("neg") - F.col("_k")).otherwise(F.col("_k") - F.col("neg") + 1).alias("_need"))
    each = coarse.join(need.select("_k", "_neg"), "_neg")
    got = _least_reaching(s.withColumnRenamed("_neg", "_own"), each.select("_k", "_c", "_t", "_neg"), need.select("_k", "_neg", "_need"), ["_k", "_neg"], F.col("_own") == F.col("_neg"))
    q = F.map_from_entries(F.collect_list(F.struct("_k", F.when(F.col("_neg"), -F.col("q")).otherwise(F.col("q")).alias("v"))))
    out = n.crossJoin(got.agg(q.alias("_q")))

    def at(p):
        low, high = (F.try_element_at("_q", f(place(p))) for f in (F.floor, F.ceil))
        return low + (high - low) * (place(p) - F.floor(place(p)))

    return out.select(F.when(F.col("n") > 0, F.array(*[at(p) for p in levels])).alias("q"))


def conformal_point(df: DataFrame, alpha: float = 0.1, by: list[str] = (), difficulty: str | None = None) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score of each group, infinite beyond n."""
    keys = list(by) or ["_all"]
    s = only_finite(df.withColumn("_s", _score(difficulty)), "_s")
    s = (s if by else s.withColumn("_all", F.lit(0))).select(*keys, "_s", F.lit(1).alias("_m")).withColumn("_c", _coarse(F.col("_s")))
    coarse = s.groupBy(*keys, "_c").agg(F.sum("_m").alias("_t"))
    n = coarse.groupBy(*keys).agg(F.sum("_t").alias("n")).withColumn("k", F.ceil((F.col("n") + 1) * F.lit(1 - alpha)).cast("long"))
    q = _least_reaching(s, coarse, n.where("k <= n").select(*keys, F.col("k").alias("_need")), keys)
    out = n.join(q, keys, "left").select(*by, "n", "k", F.coalesce("q", F.lit(INF)).alias("q"))
    if by:
        return out
    # A table without scores still has its row, as an aggregate has.
    return out.agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.max("k"), F.lit(1).cast("long")).alias("k"), F.coalesce(F.max("q"), F.lit(INF)).alias("q"))


def conformal_group(df: DataFrame, group: str, alpha: float = 0.1, difficulty: str | None = None) -> DataFrame:
    """Each group weighs the same: the first score whose weights add up to (1 - alpha)(m + 1)."""
    s = only_finite(df.withColumn("_s", _score(difficulty)), "_s").select(F.col(group).alias("_g"), "_s")
    size = s.groupBy("_g").agg((F.lit(1.0) / F.count("*")).alias("_m"))
    m = size.agg(F.lit(0).alias("_all"), F.count("*").alias("m"))
    target = F.lit(1 - alpha) * (F.col("m") + 1)
    tol = F.lit(1e-9) * (F.col("m") + 1)
    need = m.where(target <= F.col("m") + tol).select("_all", (target - tol).alias("_need"))
    s = s.join(size, "_g").select(F.lit(0).alias("_all"), "_s", "_m").withColumn("_c", _coarse(F.col("_s")))
    q = _least_reaching(s, s.groupBy("_all", "_c").agg(F.sum("_m").alias("_t")), need, ["_all"])
    return m.join(q, "_all", "left").select("m", F.coalesce("q", F.lit(INF)).alias("q"))


def conformal_interval(df: DataFrame, cal: DataFrame, difficulty: str | None = None, lower_limit: float = -INF, on: list[str] = ()) -> DataFrame:
    """pred -+ q (times difficulty), the lower bound not below lower_limit."""
    x = df.join(F.broadcast(cal.select(*on, "q")), list(on)) if on else df.crossJoin(F.broadcast(cal.select("q")))
    d = F.col("q") * (F.col(difficulty) if difficulty else F.lit(1.0))
    x = x.withColumn("lower", F.greatest(F.col("pred") - d, F.lit(lower_limit))).withColumn("upper", F.col("pred") + d)
    return x.withColumn("width", F.col("upper") - F.col("lower")).drop("q")


def conformal_cv(df: DataFrame, alpha: float = 0.1, fold: str = "fold") -> DataFrame:
    """Intervals of each fold calibrated on all other folds.

    The coarse sums of the others are those of all less the fold's own; only scores of the step in which a fold's sum is
    reached are copied to that fold, so the work does not grow with the number of folds.
    """
    s = only_finite(df.withColumn("_s", _score(None)), "_s").select(F.col(fold).alias("_own"), "_s", F.lit(1).alias("_m")).where("_own is not null").withColumn("_c", _coarse(F.col("_s")))
    own = s.groupBy("_own", "_c").agg(F.sum("_m").alias("_t"))
    folds = own.groupBy(F.col("_own").alias("_f")).agg(F.sum("_t").alias("_mine"))
    every = own.groupBy("_c").agg(F.sum("_t").alias("_t"))
    # A row for each fold and coarse step: some thousand steps a fold.
    coarse = every.crossJoin(folds.select("_f")).join(own.select(F.col("_own").alias("_f"), "_c", F.col("_t").alias("_o")), ["_f", "_c"], "left")
    coarse = coarse.select("_f", "_c", (F.col("_t") - F.coalesce("_o", F.lit(0))).alias("_t"))
    n = folds.crossJoin(F.broadcast(folds.agg(F.sum("_mine").alias("_n")))).select("_f", (F.col("_n") - F.col("_mine")).alias("n"))
    need = n.withColumn("_need", F.ceil((F.col("n") + 1) * F.lit(1 - alpha)).cast("long")).where("_need <= n").select("_f", "_need")
    q = _least_reaching(s, coarse, need, ["_f"], F.col("_own") != F.col("_f"))
    cal = n.where("n > 0").join(q, "_f", "left").select(F.col("_f").alias(fold), F.coalesce("q", F.lit(INF)).alias("q"))
    return conformal_interval(df, cal, on=[fold])


def scale_fit(df: DataFrame, covariate: str, floor_frac: float = 0.05) -> DataFrame:
    """|residual| as a line of a covariate, with a floor at a share of the median |residual|."""
    x = only_finite(df.withColumn("_r", F.abs(F.col("obs") - F.col("pred"))), "_r", covariate)
    a = x.agg(F.avg(covariate).alias("mx"), F.avg("_r").alias("mr"), F.covar_pop(covariate, "_r").alias("c"), F.var_pop(covariate).alias("v"), F.count("*").alias("n"))
    a = a.crossJoin(percentiles(x, "_r", [0.5]).select(F.get("q", F.lit(0)).alias("md")))
    b1 = F.when(F.col("v") > 0, F.col("c") / F.col("v")).otherwise(0.0)
    floor = F.when(F.col("md") * floor_frac > 0, F.col("md") * floor_frac).otherwise(F.lit(2.220446049250313e-16))
    return a.select("n", (F.col("mr") - b1 * F.col("mx")).alias("b0"), b1.alias("b1"), floor.alias("floor"))


def scaled_interval(df: DataFrame, covariate: str, alpha: float = 0.1, half: Column | None = None) -> DataFrame:
    """Scale fitted on the rows where `half`, q on the others, intervals on the others."""
    line = scale_fit(df.where(half), covariate).drop("n")
    rest = df.where(~half).crossJoin(F.broadcast(line))
    rest = rest.withColumn("scale", F.greatest(F.col("b0") + F.col("b1") * F.col(covariate), F.col("floor"))).drop("b0", "b1", "floor")
    return conformal_interval(rest, conformal_point(rest, alpha, difficulty="scale"), "scale")


def cv_plus(cal: DataFrame, at: DataFrame, alpha: float = 0.1) -> DataFrame:
    """CV+ intervals. cal: fold, score. at: id and mu, an array of the predictions of fold models 0, 1, ...

    The r-th smallest of mu[fold] + score over all scores, and the mirror image below; infinite if r > n, null where
    mu has no finite prediction of a fold that has scores. Scores are cut by rank into at most about RUNS runs,
    of one value each if there are no more. Bisection over the bounds and counts of the runs (which all tasks have) finds where the r-th can be, and
    only the runs there are met by the id and sorted.
    """
    s = only_finite(cal, "score").groupBy("fold", "score").agg(F.count("*").alias("_m"))
    cut = max(1, math.ceil(s.count() / RUNS))
    s = running_sum(s, "score", "_m", "_c", ["fold"]).withColumn("part", F.floor((F.col("_c") - F.col("_m")) / cut))
    runs = s.groupBy("fold", "part").agg(F.sum("_m").alias("m"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.collect_list(F.struct(F.col("score").alias("v"), F.col("_m").alias("m"))).alias("s"))
    bounds = runs.select(F.col("fold").cast("int").alias("fold"), "part", "m", "lo", "hi").toArrow().to_pandas().sort_values(["fold", "part"])
    folds = {int(k): (g.part.to_numpy(), g.lo.to_numpy(), g.hi.to_numpy(), np.concatenate([[0], g.m.to_numpy().cumsum()])) for k, g in bounds.groupby("fold")}
    n = int(bounds.m.sum())
    r = math.ceil((n + 1) * (1 - alpha))

    def mus(t: pd.DataFrame) -> np.ndarray:
        return np.array([[float(m[k]) if m is not None and k < len(m) and m[k] is not None else np.nan for k in folds] for m in t.mu], float).reshape(len(t), len(folds))

    def below(mu: np.ndarray, v: np.ndarray, bound: int, side: str = "right") -> np.ndarray:
        """For each row and fold, how many runs have that bound under v."""
        return np.column_stack([np.searchsorted(f[bound], v - mu[:, k], side) for k, f in enumerate(folds.values())])

    def counted(i: np.ndarray) -> np.ndarray:
        return sum(f[3][i[:, k]] for k, f in enumerate(folds.values()))

    def search(mu: np.ndarray, goal) -> tuple[np.ndarray, np.ndarray]:
        low, high = (g(np.column_stack([mu[:, k] + f[b][e] for k, f in enumerate(folds.values())]), axis=1) for g, b, e in ((np.min, 1, 0), (np.max, 2, -1)))
        slack = 1e-12 * (np.abs(mu).max(1) + max(np.abs(f[b]).max() for f in folds.values() for b in (1, 2)))
        low, high = low - slack, high + slack
        for _ in range(60):
            mid = (low + high) / 2
            up = goal(mu, mid)
            low, high = np.where(up, low, mid), np.where(up, mid, high)
        return low - slack, high + slack

    def needs(batches):
        for t in batches:
            every = mus(t)
            ok = np.isfinite(every).all(1)
            yield pd.DataFrame({"_row": t._row[~ok], "id": t.id[~ok], "sign": 1, "fold": None, "part": None, "shift": None, "rank": None})
            rows, ids = t._row.to_numpy()[ok], t.id.to_numpy()[ok]
            for sign in (-1, 1) if len(rows) else ():
                mu = every[ok] * sign
                first = below(mu, search(mu, lambda m, v: counted(below(m, v, 1)) >= r)[0], 2, "left")
                last = below(mu, search(mu, lambda m, v: counted(below(m, v, 2)) >= r)[1], 1)
                rank = r - counted(first)
                for k, (fold, f) in enumerate(folds.items()):
                    size = np.maximum(last[:, k] - first[:, k], 0)
                    i = np.repeat(np.arange(len(rows)), size)
                    run = first[i, k] + np.arange(len(i)) - np.repeat(size.cumsum() - size, size)
                    yield pd.DataFrame({"_row": rows[i], "id": ids[i], "sign": sign, "fold": fold, "part": f[0][run], "shift": mu[i, k], "rank": rank[i]})

    if r > n:
        whole = F.forall(F.array(*map(F.lit, folds)), lambda k: finite(F.get("mu", k))) if folds else F.lit(True)
        return at.select("id", F.when(whole, -INF).alias("lower"), F.when(whole, INF).alias("upper"))
    need = at.select("id", "mu", F.monotonically_increasing_id().alias("_row")).mapInPandas(needs, f"_row long, id {dict(at.dtypes)['id']}, sign int, fold int, part long, shift double, rank long")
    met = need.join(runs.select(F.col("fold").cast("int").alias("fold"), "part", "s"), ["fold", "part"], "left")
    met = met.groupBy("_row", "id", "sign", "rank").agg(F.sort_array(F.flatten(F.collect_list(F.expr("transform(s, x -> struct(shift + x.v as v, x.m as m))")))).alias("a"))
    pick = F.expr("aggregate(a, struct(0L as c, cast(null as double) as q), (z, x) -> struct(z.c + x.m as c, if(z.q is null and z.c + x.m >= rank, x.v, z.q) as q), z -> z.q)")
    met = met.withColumn("q", pick)
    return met.groupBy("_row", "id").agg((-F.max(F.when(F.col("sign") < 0, F.col("q")))).alias("lower"), F.max(F.when(F.col("sign") > 0, F.col("q"))).alias("upper")).drop("_row")

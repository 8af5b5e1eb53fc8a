"""What a fitted model owes to each variable: permutation, refits, Shapley values, gradients, local effects."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draw_key
from ..operators.importance import shapley
from ..operators.metrics import Moments, metrics_of_moments
from . import SHARD, get_model, matrix, network, numbers, predict_units, score_units, units


def donors(df: DataFrame, draws: int, seed: int = 42, strata: str | None = None) -> DataFrame:
    """(draw, sample_id, donor): each row's donor is the next of a random order of its stratum, the first's after the last.

    sample_id is unique. No row is its own donor but one alone in its stratum.
    """
    return _with_donors(df, draws, seed, strata).select("draw", "sample_id", F.col("_next.sample_id").alias("donor"))


def _with_donors(df: DataFrame, draws: int, seed: int = 42, strata: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """draw, sample_id, the columns to carry, and _next: the same of the row's donor.

    The order of md5 is cut by its first three digits, and rows meet their donors within a cut; the last row of a cut
    gets the first of the next one that has rows. Rows are shuffled once, without their md5.
    """
    cols = ["sample_id", *carry]
    h = F.md5(F.concat_ws("_", F.lit(str(seed)), "draw", "sample_id"))
    keys = ["draw", "stratum", "_b"]
    x = df.select(*cols, (F.col(strata).cast("string") if strata else F.lit("all")).alias("stratum"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    x = x.withColumn("_b", F.conv(F.substring(h, 1, 3), 16, 10).cast("int")).repartition(*keys)
    w = Window.partitionBy(*keys).orderBy(h)
    x = x.select(*keys, *cols, F.lead(F.struct(*cols)).over(w).alias("_next"), F.row_number().over(w).alias("_i"))
    after, all_ = Window.partitionBy("draw", "stratum").orderBy("_b"), Window.partitionBy("draw", "stratum").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = x.where("_i = 1").select(*keys, F.struct(*cols).alias("_f"))
    first = first.select(*keys, F.coalesce(F.lead("_f").over(after), F.first("_f").over(all_)).alias("_f"))
    return x.join(first, keys, "left").select("draw", *cols, F.coalesce("_next", "_f").alias("_next"))


def permutation_importance(df: DataFrame, model: str, fitted, names: list[str], draws: int = 5, seed: int = 42, strata: str | None = None, label: str = "m0", groups: list[list[int]] | None = None) -> DataFrame:
    """model, variable, draw, drop: how much ccc falls when a variable comes from each row's donor.

    df: sample_id, x, y. groups: the places in x of each name, which move together; by default name i is place i. Rows meet
    their donor's inputs in one shuffle; all variables are swapped and scored where they met, and a task returns sums only.
    """
    spec, groups = get_model(model), groups or [[i] for i in range(len(names))]

    def run(batches):
        sums = Moments()
        for t in batches:
            if t.num_rows:
                x, x2, y, draw = matrix(t["x"]), matrix(t["x2"]), numbers(t["y"]), t["draw"].to_numpy(zero_copy_only=False)
                for d in np.unique(draw):
                    at = np.flatnonzero(draw == d)
                    if d == 1:
                        sums.add((1, -1), y[at], spec.predict(fitted, x[at]))
                    for k, g in enumerate(groups):
                        z = x[at]
                        z[:, g] = x2[at][:, g]
                        sums.add((int(d), k), y[at], spec.predict(fitted, z))
        yield pa.RecordBatch.from_pandas(sums.frame(["draw", "variable"]).astype({"draw": "int32", "variable": "int32"}), preserve_index=False)

    both = _with_donors(df, draws, seed, strata, ("x", "y")).select("draw", "x", "y", F.col("_next.x").alias("x2"))
    scored = metrics_of_moments(both.mapInArrow(run, f"draw int, variable int, {Moments.FIELDS}"), ["draw", "variable"]).select("draw", "variable", "ccc")
    whole = F.max(F.when(F.col("variable") == -1, F.col("ccc"))).over(Window.partitionBy())
    out = scored.withColumn("base", whole).where("variable >= 0")
    return out.select(F.lit(label).alias("model"), F.get(F.array(*map(F.lit, names)), F.col("variable")).alias("variable"), "draw", (F.col("base") - F.col("ccc")).alias("drop"))


def context_groups(window: int, bands: list[str], by: str = "ring", per_variable: bool = False) -> tuple[list[str], list[list[int]]]:
    """Names and places of the context of patches (bands one after another): rings around the centre, or square windows up to them."""
    h = window // 2
    ring = np.maximum(*np.abs(np.mgrid[-h : h + 1, -h : h + 1])).ravel()
    names, groups = [], []
    for label, chosen in [(f"{b}_", [k]) for k, b in enumerate(bands)] if per_variable else [("", range(len(bands)))]:
        for r in range(h + 1):
            cells = np.flatnonzero(ring == r if by == "ring" else ring <= r)
            names.append(f"{label}ring_{r}" if by == "ring" else f"{label}window_{2 * r + 1}")
            groups.append([int(k * window * window + c) for k in chosen for c in cells])
    return names, groups


def context_importance(df: DataFrame, model: str, fitted, window: int, bands: list[str], by: str = "ring", per_variable: bool = False, draws: int = 5, seed: int = 42) -> DataFrame:
    """permutation_importance of the rings (or windows) of patches instead of variables: how far around a point the model looks."""
    names, groups = context_groups(window, bands, by, per_variable)
    return permutation_importance(df, model, fitted, names, draws, seed, groups=groups)


def sampled_shapley(df: DataFrame, model: str, fitted, background: list[list[float]], orders: int = 32, seed: int = 42) -> DataFrame:
    """id, player, phi: Shapley values over random orders of the players, each with its reverse; for more than 14 players.

    All rows meet the same orders, and a coalition that several orders pass is scored once. The values of a row add up to
    its prediction less the mean over the background.
    """
    players, rng = len(background[0]), np.random.default_rng(seed)
    some = [rng.permutation(players) for _ in range(-(-orders // 2))]
    walks = np.array([w for o in some for w in (o, o[::-1])])
    passed = np.zeros((len(walks), players + 1, players), bool)
    for i, walk in enumerate(walks):
        for k, p in enumerate(walk):
            passed[i, k + 1 :, p] = True
    on, place = np.unique(passed.reshape(-1, players), axis=0, return_inverse=True)
    place, weights = place.reshape(len(walks), players + 1), np.zeros((len(on), players))
    for walk, at in zip(walks, place):
        np.add.at(weights, (at[1:], walk), 1 / len(walks))
        np.add.at(weights, (at[:-1], walk), -1 / len(walks))
    return _credited(df, model, fitted, background, on, weights)


def gate_values(df: DataFrame, fitted) -> DataFrame:
    """sample_id, mean and values of the gate between two branches, the norms of their embeddings, their ratio and cosine.

    fitted: a model of two windows, as the units `cnn` make; others have no gate. In the mean 1 is the small window alone.
    """
    model, cfg = fitted
    gated = [layer for layer in model.net.every() if isinstance(layer, network.TwoBranches)]
    if not gated:
        raise ValueError("a model of one window has no gate")
    window = max(cfg["windows"])

    def run(batches):
        two = next(layer for layer in model.net.every() if isinstance(layer, network.TwoBranches))
        for t in batches:
            if not len(t):
                continue
            x = np.stack(t.x.to_numpy()).astype(float)
            network.predict(model.net, model.z(x.reshape(len(x), -1, window, window)), len(x))
            a, b = (np.sqrt((v * v).sum(1)) for v in (two.a, two.b))
            yield pd.DataFrame({
                "sample_id": t.sample_id.to_numpy(), "mean_gate": two.s.mean(1), "gate": list(two.s), "norm_small": a, "norm_large": b,
                "norm_ratio": a / (b + 1e-8), "cosine": (two.a * two.b).sum(1) / (a * b + 1e-8),
            })

    return df.select("sample_id", "x").mapInPandas(run, "sample_id long, mean_gate double, gate array<double>, norm_small double, norm_large double, norm_ratio double, cosine double")


def gate_summary(values: DataFrame) -> DataFrame:
    """One row on the gates of all samples: mean, median and outer quantiles of all gate values, and of norms and cosines."""
    q = F.percentile("g", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    gates = values.select(F.explode("gate").alias("g")).agg(F.avg("g").alias("mean_gate"), q.alias("q"))
    rows = values.agg(
        F.count("*").alias("n"), F.max(F.size("gate")).alias("n_gate_dims"), F.avg("norm_small").alias("mean_norm_small"), F.avg("norm_large").alias("mean_norm_large"),
        F.median("norm_ratio").alias("median_norm_ratio"), F.avg("cosine").alias("mean_cosine"),
    )
    return rows.crossJoin(gates).select("*", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q05_gate", "median_gate", "q95_gate"))]).drop("q")


def refit_importance(df: DataFrame, model: str, cfg: dict, names: list[str], folds: list[int], seed: int = 42, max_rows: int = SHARD) -> DataFrame:
    """variable, importance: the fall of the mean validation ccc when the model is fitted without each variable."""
    grid = [cfg] + [cfg | {"without": i} for i in range(len(names))]
    s = score_units(df, units(df.sparkSession, grid, folds, base_seed=seed), model, max_rows)
    s = s.groupBy("config_id").agg(F.avg("val_ccc").alias("ccc"))
    base = s.where("config_id = 'cfg_001'").select(F.col("ccc").alias("base"))
    name = F.get(F.array(*map(F.lit, names)), F.substring("config_id", 5, 9).cast("int") - 2)
    return s.where("config_id <> 'cfg_001'").crossJoin(F.broadcast(base)).select(name.alias("variable"), (F.col("base") - F.col("ccc")).alias("importance"))


def _worths(spec, fitted, b: np.ndarray, on: np.ndarray, x: np.ndarray):
    """(first row, values): the mean prediction of some rows of x with each coalition's variables from the row, the others from the background."""
    step = max(1, 4096 // (len(on) * len(b)))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        z = np.where(on[None, :, None, :], part[:, None, None, :], b[None, None])
        yield i, np.asarray(spec.predict(fitted, z.reshape(-1, z.shape[-1]))).reshape(len(part), len(on), len(b)).mean(2)


def _every_coalition(players: int) -> np.ndarray:
    if players > 14:
        raise ValueError("exact values take 2**players coalitions; at most 14 players")
    return ((np.arange(2**players)[:, None] >> np.arange(players)) & 1).astype(bool)


def _credited(df: DataFrame, model: str, fitted, background: list[list[float]], on: np.ndarray, weights: np.ndarray) -> DataFrame:
    """id, player, phi: the values of each row's coalitions times weights (coalition, player); nothing is shuffled."""
    spec, b, players = get_model(model), np.array(background, float), weights.shape[1]

    def run(batches):
        for t in batches:
            if t.num_rows:
                x = matrix(t["x"])
                phi = np.concatenate([v @ weights for _, v in _worths(spec, fitted, b, on, x)])
                ids = t["sample_id"].cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), players)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(players, dtype="int32"), len(x))), pa.array(phi.ravel())], ["id", "player", "phi"])

    return df.select("sample_id", "x").mapInArrow(run, "id long, player int, phi double")


def background_rows(df: DataFrame, n: int = 16, seed: int = 42) -> list[list[float]]:
    """The x of the n rows of least md5."""
    return [list(r["x"]) for r in df.orderBy(draw_key(seed, "sample_id"), "sample_id").limit(n).select("x").collect()]


def kernel_shap(df: DataFrame, model: str, fitted, background: list[list[float]]) -> DataFrame:
    """id, player, phi: exact Shapley values of each prediction, a row of phi from its own coalitions where they are scored."""
    players = len(background[0])
    on = _every_coalition(players)
    size = on.sum(1)
    share = np.array([math.factorial(s) * math.factorial(players - s - 1) / math.factorial(players) for s in range(players)])
    weights = np.where(on, share[np.maximum(size - 1, 0)][:, None], -share[np.minimum(size, players - 1)][:, None])
    return _credited(df, model, fitted, background, on, weights)


def sage(df: DataFrame, model: str, fitted, background: list[list[float]], loss: str = "mse") -> DataFrame:
    """player, phi: Shapley values of the negative mean loss; a task returns a sum of losses for each coalition."""
    spec, b, on = get_model(model), np.array(background, float), _every_coalition(len(background[0]))

    def run(batches):
        n, total = 0, np.zeros(len(on))
        for t in batches:
            t = t.filter(t["y"].is_valid())
            if t.num_rows:
                x, y = matrix(t["x"]), numbers(t["y"])
                for i, v in _worths(spec, fitted, b, on, x):
                    e = v - y[i : i + len(v), None]
                    n, total = n + len(v), total + (e * e if loss == "mse" else np.abs(e)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(on), dtype="int32")), pa.array(np.full(len(on), n)), pa.array(total)], ["mask", "n", "s"])

    sums = df.select("x", "y").mapInArrow(run, "mask int, n long, s double")
    worth = sums.groupBy("mask").agg((-F.sum("s") / F.sum("n")).alias("v")).select(F.lit(0).cast("long").alias("id"), "mask", "v")
    return shapley(worth, len(background[0])).select("player", "phi")


def gradient_shap(df: DataFrame, fitted, steps: int = 50, background: list[list[float]] | None = None, seed: int = 42) -> DataFrame:
    """sample_id, pred, base, phi array: integrated gradients from the training mean; with a background, expected gradients.

    fitted: a scaled network (as the units `mlp` make). The values of a row add up to pred - base, up to the step error.
    """
    schema = "sample_id long, pred double, base double, phi array<double>"

    def run(batches):
        net, rng = fitted.net, np.random.default_rng(seed)
        for t in batches:
            if not len(t):
                continue
            x = fitted.z(np.stack(t.x.to_numpy()).astype(float))
            b = np.zeros_like(x[:1]) if background is None else fitted.z(np.array(background, float))
            total = np.zeros_like(x)
            for k in range(steps):
                a = (k + 0.5) / steps if background is None else rng.random((len(x), 1))
                from_ = b if background is None else b[rng.integers(0, len(b), len(x))]
                total += (x - from_) * network.gradient(net, from_ + a * (x - from_))
            base = network.predict(net, b).mean() * fitted.ys + fitted.ym
            yield pd.DataFrame({"sample_id": t.sample_id, "pred": network.predict(net, x) * fitted.ys + fitted.ym, "base": base, "phi": pd.Series(list(total / steps * fitted.ys), dtype=object, index=t.index)})

    return df.select("sample_id", "x").mapInPandas(run, schema)


def local_effects(df: DataFrame, model: str, fitted, variable: int, name: str, bins: int = 20) -> DataFrame:
    """variable, bin, n, diff: mean change of the prediction across each bin, for `ale_accumulate`. Edges are observed values."""
    q = [i / bins for i in range(bins + 1)]
    z = df.withColumn("_z", F.get("x", F.lit(variable)))
    # Values are counted first, so the edges come from one row a value.
    edges = z.agg(F.array_sort(F.array_distinct(F.percentile_approx("_z", q, 100_000))).alias("_e"))
    z = z.crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(F.size(F.filter("_e", lambda v: v < F.col("_z"))), F.lit(1)))
    put = lambda at: F.transform("x", lambda v, i: F.when(i == variable, F.coalesce(F.get("_e", at), v)).otherwise(v))
    low = predict_units(z.select("sample_id", "bin", put(F.col("bin") - 1).alias("x")), model, fitted).withColumnRenamed("pred", "_low")
    high = predict_units(z.select("sample_id", put(F.col("bin")).alias("x")), model, fitted)
    return low.join(high, "sample_id").groupBy(F.lit(name).alias("variable"), F.col("bin").cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("pred") - F.col("_low")).alias("diff"))


def occlusion(df: DataFrame, model: str, fitted, window: int, seed: int = 42) -> DataFrame:
    """ring, n, ccc, rmse: metrics when the pixels of a ring of every patch come from the row's donor; ring -1 is as it was."""
    h, spec = window // 2, get_model(model)
    r = np.maximum(np.abs(np.arange(window)[:, None] - h), np.abs(np.arange(window)[None] - h)).ravel()
    both = _with_donors(df, 1, seed, None, ("x", "y")).select("x", "y", F.col("_next.x").alias("x2"))

    def run(batches):
        sums = Moments()
        for t in batches:
            if t.num_rows:
                x, x2, y = matrix(t["x"]), matrix(t["x2"]), numbers(t["y"])
                at = np.tile(r, x.shape[1] // len(r))
                for k in range(-1, h + 1):
                    sums.add((k,), y, spec.predict(fitted, np.where(at == k, x2, x)))
        yield pa.RecordBatch.from_pandas(sums.frame(["ring"]).astype({"ring": "int32"}), preserve_index=False)

    return metrics_of_moments(both.mapInArrow(run, f"ring int, {Moments.FIELDS}"), ["ring"]).select("ring", "n", "ccc", "rmse")

"""Models by name, and jobs that fit every (configuration, fold, seed) as a unit of its own task."""

from __future__ import annotations

import itertools
import json
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import READS, in_reads, kept, shared_path  # noqa: F401
from . import network


@dataclass(frozen=True)
class ModelSpec:
    """fit(x, y, xv, yv, cfg, seed) -> model, predict(model, x) -> array; x has a row a sample."""

    name: str
    fit: Callable
    predict: Callable
    grid: list[dict] = field(default_factory=lambda: [{}])
    count_params: Callable = lambda model: None
    description: str = ""
    #: fit_sums(X'X, X'y, cfg) -> model, with ones before x; such a model is fitted on all rows, from their sums.
    fit_sums: Callable | None = None
    #: Networks: build(rng, x, cfg), shaped(x, cfg), augment(cfg) and wrap(scaled, cfg); such a model is fitted on any number of rows, shard by shard.
    build: Callable | None = None
    shaped: Callable = lambda x, cfg: x
    augment: Callable = lambda cfg: None
    wrap: Callable = lambda scaled, cfg: scaled


_MODELS: dict[str, ModelSpec] = {}


def register_model(spec: ModelSpec, overwrite: bool = False) -> None:
    if spec.name in _MODELS and not overwrite:
        raise ValueError(f"model {spec.name} is registered")
    _MODELS[spec.name] = spec


def get_model(name: str) -> ModelSpec:
    if name not in _MODELS:
        raise KeyError(f"no model {name}; there are {', '.join(sorted(_MODELS))}")
    return _MODELS[name]


def list_models(spark) -> DataFrame:
    rows = [(m.name, m.description, len(m.grid)) for m in sorted(_MODELS.values(), key=lambda m: m.name)]
    return spark.createDataFrame(rows, "name string, description string, n_configs int")


def manual_grid(**values: list) -> list[dict]:
    """Every combination of the values given."""
    return [dict(zip(values, v)) for v in itertools.product(*values.values())]


def window_options(windows: list[int]) -> list[list[int]]:
    """Each window alone, and each pair."""
    w = sorted(set(windows))
    return [[a] for a in w] + [list(p) for p in itertools.combinations(w, 2)]


def batch_options(choices: list[int], n_train: int, min_steps: int = 4) -> list[int]:
    """Batches that leave enough steps an epoch, else the largest power of two that does."""
    good = [b for b in choices if n_train // b >= min_steps]
    return good or [2 ** max(0, int(np.log2(max(1, n_train // min_steps))))]


def random_grid(space: dict[str, list], length: int, seed: int = 42) -> list[dict]:
    """`length` different configurations, or all there are."""
    rng, every = np.random.default_rng(seed), manual_grid(**space)
    return [every[i] for i in sorted(rng.permutation(len(every))[:length])]


class _Scaled:
    """A model with the scales of its training rows."""

    def __init__(self, net, m, s, ym: float, ys: float):
        self.net, self.m, self.s = net, m, np.where(s > 0, s, 1.0)
        self.ym, self.ys = ym, ys or 1.0
        self.history: list[dict] = []

    def z(self, x):
        return (x - self.m) / self.s


def _fit_net(build, x, y, xv, yv, cfg, seed, augment=None):
    rng = np.random.default_rng(seed)
    axes = (0,) if x.ndim == 2 else (0, 2, 3)
    model = _Scaled(build(rng, x), x.mean(axes, keepdims=True), x.std(axes, keepdims=True), float(y.mean()), float(y.std()))
    model.history = network.fit(model.net, model.z(x), (y - model.ym) / model.ys, model.z(xv), (yv - model.ym) / model.ys, cfg, rng, augment)
    return model


def _predict_net(model, x):
    return network.predict(model.net, model.z(x)) * model.ys + model.ym


def _symmetry(x, rng):
    """An own symmetry of the square for each patch."""
    k = rng.integers(0, 8, len(x))
    out = np.empty_like(x)
    for i in range(8):
        z = np.rot90(x[k == i], i % 4, (2, 3))
        out[k == i] = z.swapaxes(2, 3) if i >= 4 else z
    return out


def _as_patches(x, cfg):
    w = max(cfg["windows"])
    return x.reshape(len(x), -1, w, w)


def _fit_cnn(x, y, xv, yv, cfg, seed):
    x, xv = _as_patches(x, cfg), _as_patches(xv, cfg)
    return _fit_net(lambda rng, a: network.cnn(rng, a.shape[1], cfg["windows"], cfg), x, y, xv, yv, cfg, seed, _symmetry if cfg.get("augment") else None), cfg


def _fit_line_sums(xx, xy, cfg):
    return np.linalg.solve(xx + cfg.get("ridge", 1e-6) * np.eye(len(xx)), xy)


def _fit_line(x, y, xv, yv, cfg, seed):
    a = np.column_stack([np.ones(len(x)), x])
    return _fit_line_sums(a.T @ a, a.T @ y, cfg)


register_model(ModelSpec("line", _fit_line, lambda m, x: m[0] + x @ m[1:], [{"ridge": 1e-6}, {"ridge": 1.0}], len, "least squares with a ridge", _fit_line_sums))
register_model(ModelSpec(
    "mlp", lambda x, y, xv, yv, cfg, seed: _fit_net(lambda rng, a: network.mlp(rng, a.shape[1], cfg), x, y, xv, yv, cfg, seed), _predict_net,
    manual_grid(hidden=[[32], [32, 16]], dropout=[0.0, 0.1]), lambda m: network.count_params(m.net), "layers with batch normalisation and dropout",
    build=lambda rng, x, cfg: network.mlp(rng, x.shape[1], cfg),
))
register_model(ModelSpec(
    "cnn", _fit_cnn, lambda m, x: _predict_net(m[0], _as_patches(x, m[1])), manual_grid(windows=[[3], [5], [3, 5]], channels=[[8], [8, 16]]),
    lambda m: network.count_params(m[0].net), "one or two windows of a patch, convolved",
    build=lambda rng, x, cfg: network.cnn(rng, x.shape[1], cfg["windows"], cfg), shaped=_as_patches, augment=lambda cfg: _symmetry if cfg.get("augment") else None, wrap=lambda m, cfg: (m, cfg),
))


def units(spark, grid: list[dict], folds: list[int], n_seeds: int = 1, base_seed: int = 42) -> DataFrame:
    """One row a unit: config_id, cfg (JSON), fold, seed. Grids are written by hand or drawn, so this is a small table."""
    rows = [(f"cfg_{i + 1:03d}", json.dumps(cfg, sort_keys=True), f, base_seed + s) for i, cfg in enumerate(grid) for f in folds for s in range(n_seeds)]
    return spark.createDataFrame(rows, "config_id string, cfg string, fold int, seed int")


def resumable(todo: DataFrame, done: DataFrame) -> DataFrame:
    """Units without a success of the same id, fold, seed and hyperparameters."""
    return todo.join(done.where("status = 'success'").select("config_id", "cfg", "fold", "seed").distinct(), ["config_id", "cfg", "fold", "seed"], "left_anti")


_UNIT = ["config_id", "cfg", "fold", "seed"]
_FITTED = "config_id string, cfg string, fold int, seed int, status string, error string, n_params long, n_train long, model binary"
_SCORED = "config_id string, cfg string, fold int, seed int, status string, error string, n_params long, n_train long, sample_id long, obs double, pred double"
_FAILURES = (ValueError, ArithmeticError, np.linalg.LinAlgError, KeyError)


def _usable(df: DataFrame) -> DataFrame:
    ok = df.where(F.col("y").isNotNull() & ~F.isnan("y") & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    return ok.select("sample_id", "x", "y", F.col("fold").alias("_fold"))


def _fitted(spec: ModelSpec, key, fit: Callable, n_train: int) -> dict:
    """A unit's row: what it is, and the pickled model or the error."""
    row = dict(zip(_UNIT, key))
    try:
        fitted = fit(json.loads(row["cfg"]))
        return row | {"status": "success", "error": None, "n_params": spec.count_params(fitted), "n_train": n_train, "model": cloudpickle.dumps(fitted)}
    except _FAILURES as e:
        return row | {"status": "error", "error": repr(e), "n_params": None, "n_train": None, "model": None}


def _from_sums(ok: DataFrame, todo: DataFrame, spec: ModelSpec) -> list[dict]:
    """Units fitted from the sums of all rows of the other folds; each partition sends one row a fold."""

    def sums(batches):
        kept: dict = {}
        for t in batches:
            t = t.assign(_p=[len(v) for v in t.x])
            for (fold, p), g in t.groupby(["_fold", "_p"], dropna=False):
                a, y = np.column_stack([np.ones(len(g)), np.array([np.asarray(v, float) for v in g.x]).reshape(len(g), p)]), g.y.to_numpy(float)
                k = (None if pd.isna(fold) else int(fold), p)
                n, xx, xy = kept.get(k, (0, 0.0, 0.0))
                kept[k] = n + len(g), xx + a.T @ a, xy + a.T @ y
        for (fold, p), (n, xx, xy) in kept.items():
            yield pd.DataFrame({"fold": pd.array([fold], "Int32"), "p": [p], "n": [n], "xx": [xx.ravel()], "xy": [xy]})

    got = ok.select("x", "y", "_fold").mapInPandas(sums, "fold int, p int, n long, xx array<double>, xy array<double>").collect()
    out = []
    for u in todo.collect() if got else []:
        others = [r for r in got if r["fold"] != u["fold"]]

        def fit(cfg, others=others):
            if len({r["p"] for r in got}) != 1:
                raise ValueError("inputs of different lengths")
            size = got[0]["p"] + 1
            xx, xy = (sum((np.array(r[c]) for r in others), np.zeros(n)) for c, n in (("xx", size * size), ("xy", size)))
            xx = xx.reshape(size, size)
            if "without" in cfg:
                at = np.arange(1, size)[cfg.pop("without")]
                xx[at], xx[:, at], xy[at] = 0.0, 0.0, 0.0
            return spec.fit_sums(xx, xy, cfg)

        out.append(_fitted(spec, [u[c] for c in _UNIT], fit, sum(r["n"] for r in others)))
    return out


def _in_one_task(ok: DataFrame, todo: DataFrame, spec: ModelSpec) -> list[dict]:
    """Units fitted in one task each, on all rows."""

    def unit(key, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("sample_id")
        held = (t._fold == key[2]).to_numpy()

        def fit(cfg):
            x, y = np.stack(t.x.to_numpy()).astype(float), t.y.to_numpy(float)
            if "without" in cfg:
                x[:, cfg.pop("without")] = 0.0
            return spec.fit(x[~held], y[~held], x[held], y[held], cfg, int(key[3]))

        return pd.DataFrame([_fitted(spec, key, fit, int((~held).sum()))]).astype({"model": object})

    # A stated number of partitions is kept: merged small ones would put many fits into one task.
    return [r.asDict() for r in ok.crossJoin(F.broadcast(todo)).repartition(max(1, todo.count()), *_UNIT).groupBy(*_UNIT).applyInPandas(unit, _FITTED).collect()]


_SHARD = "shard long, p int, x binary, y binary, fold binary"


def _write_shards(ok: DataFrame, k: int) -> DataFrame:
    """All rows in k shards, each one row of packed numbers, in the folder all executors share."""

    def pack(key, t):
        t = t.sort_by("sample_id").combine_chunks()
        lengths = pc.unique(pc.list_value_length(t["x"]))
        width = lengths[0].as_py() if len(lengths) == 1 else -1
        x = b"" if width < 0 else matrix(t["x"].combine_chunks()).tobytes()
        return pa.table({"shard": [key[0].as_py()], "p": pa.array([width], pa.int32()), "x": [x], "y": [numbers(t["y"].combine_chunks()).tobytes()], "fold": [numbers(t["_fold"].combine_chunks()).tobytes()]})

    path = shared_path(ok.sparkSession, "shards")
    cut = ok.withColumn("_shard", F.pmod(F.xxhash64("sample_id"), F.lit(k)))
    # Some hundred files at most: merged into fewer, they would leave some cores without any.
    cut.repartition(min(k, FILES), "_shard").groupBy("_shard").applyInArrow(pack, _SHARD).write.parquet(path)
    return in_reads(ok.sparkSession, path)


def _unpacked(batches):
    """(shard, x, y, fold) of each row of shards."""
    for t in batches:
        for i in range(t.num_rows):
            r = {c: t[c][i] for c in t.schema.names}
            y, fold = (np.frombuffer(r[c].as_buffer(), float) for c in ("y", "fold"))
            if r["p"].as_py() < 0:
                raise ValueError("inputs of different lengths")
            yield r["shard"].as_py(), np.frombuffer(r["x"].as_buffer(), float).reshape(len(y), -1), y, fold


def _scales(shards: DataFrame) -> dict:
    """By fold: rows, means and summed squares about them of y and of each place of x; each task sends one row a fold."""

    def merged(a, b):
        n, d = a[0] + b[0], b[1] - a[1]
        return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n

    def run(batches):
        kept: dict = {}
        for _, x, y, fold in _unpacked(batches):
            z = np.column_stack([y, x])
            for f in {None if np.isnan(v) else int(v) for v in np.unique(fold)}:
                g = z[np.isnan(fold) if f is None else fold == f]
                m = g.mean(0)
                new = len(g), m, ((g - m) ** 2).sum(0)
                kept[f] = merged(kept[f], new) if f in kept else new
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([v[0] for v in kept.values()]), *[pa.array([v[i].tolist() for v in kept.values()]) for i in (1, 2)]], ["fold", "n", "m", "q"])

    out: dict = {}
    for r in shards.mapInArrow(run, "fold int, n long, m array<double>, q array<double>").collect():
        new = r["n"], np.array(r["m"]), np.array(r["q"])
        out[r["fold"]] = merged(out[r["fold"]], new) if r["fold"] in out else new
    return {"by": out, "merged": merged}


def _from_shards(shards: DataFrame, todo: DataFrame, spec: ModelSpec) -> list[dict]:
    """Networks fitted on all rows: in each epoch every shard trains from the same weights, and their mean, by rows, is the next epoch's start.

    A round measures the loss of what it starts from on the rows held out, so the rate falls one epoch later than in one
    task. Tasks send one sum a unit, which meet before the driver; the data are read once an epoch for all units.
    """
    scales = _scales(shards)
    width = len(next(iter(scales["by"].values()))[1]) - 1
    live, failed = {}, []
    for i, u in enumerate(todo.collect()):
        key = [u[c] for c in _UNIT]
        try:
            cfg = json.loads(u["cfg"])
            without = cfg.pop("without", None)
            parts = [v for f, v in scales["by"].items() if f != u["fold"]]
            if not parts:
                raise ValueError("there are no rows to fit on")
            n, mean, square = parts[0]
            for p in parts[1:]:
                n, mean, square = scales["merged"]((n, mean, square), p)
            if without is not None:
                mean[1:][without], square[1:][without] = 0.0, 0.0
            # Channels of patches have one scale.
            mx, qx = spec.shaped(mean[None, 1:], cfg), spec.shaped(square[None, 1:], cfg)
            axes = () if mx.ndim == 2 else (2, 3)
            m = mx.mean(axes, keepdims=True) if axes else mx
            var = (qx / n + (mx - m) ** 2).mean(axes, keepdims=True) if axes else qx / n
            net = spec.build(np.random.default_rng(int(u["seed"])), spec.shaped(np.zeros((1, width)), cfg), cfg)
            training = network.Training(net, cfg)
            stop = network.Stopping(cfg, training.vector())
            live[i] = {"key": key, "cfg": cfg, "without": without, "fold": u["fold"], "seed": int(u["seed"]), "n": n, "model": _Scaled(net, m, np.sqrt(var), float(mean[0]), float(np.sqrt(square[0] / n))), "training": training, "stop": stop}
        except _FAILURES as e:
            failed.append(dict(zip(_UNIT, key)) | {"status": "error", "error": repr(e), "n_params": None, "n_train": None, "model": None})

    def round_(sent: list[dict], epoch: int, last: bool):
        def run(batches):
            sums = {u["i"]: [0.0, 0.0, 0, 0.0, 0] for u in sent}  # weights, steps, rows, loss, rows held out
            for shard, x, y, fold in _unpacked(batches):
                for u in sent:
                    held, model, s = fold == u["fold"], u["model"], sums[u["i"]]
                    part = x
                    if u["without"] is not None:
                        part = x.copy()
                        part[:, u["without"]] = 0.0
                    z, t = model.z(spec.shaped(part, u["cfg"])), (y - model.ym) / model.ys
                    training = network.Training(model.net, u["cfg"])
                    training.load(u["vector"])
                    s[3], s[4] = s[3] + training.loss(z[held], t[held]), s[4] + int(held.sum())
                    if not last and not held.all():
                        training.step, training.falls = u["step"], u["falls"]
                        training.epoch(z[~held], t[~held], np.random.default_rng([u["seed"], epoch, shard]), spec.augment(u["cfg"]))
                        n = int((~held).sum())
                        s[0], s[1], s[2] = s[0] + n * training.vector(), s[1] + n * training.step, s[2] + n
            rows = [(i, np.zeros(0).tobytes() if s[2] == 0 else s[0].tobytes(), *map(float, s[1:])) for i, s in sums.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("i", "w", "step", "n", "loss", "held"), r)) for r in rows])

        def add(key, t):
            w = [v for v in (np.frombuffer(b, float) for b in t["w"].to_pylist()) if len(v)]
            return pa.table({"i": [key[0].as_py()], "w": [(sum(w) if w else np.zeros(0)).tobytes()], **{c: [sum(t[c].to_pylist())] for c in ("step", "n", "loss", "held")}})

        schema = "i long, w binary, step double, n double, loss double, held double"
        return {r["i"]: r for r in shards.mapInArrow(run, schema).groupBy("i").applyInArrow(add, schema).collect()}

    going = {i: {"vector": u["training"].vector(), "step": 0} for i, u in live.items()}
    epoch = 0
    while going:
        epochs = {i: live[i]["cfg"].get("epochs", 60) for i in going}
        sent = [{"i": i, "falls": live[i]["stop"].falls, **{k: live[i][k] for k in ("cfg", "without", "fold", "seed", "model")}, **g} for i, g in going.items()]
        got = round_(sent, epoch, all(epochs[i] <= epoch for i in going))
        for i in list(going):
            r, stop = got[i], live[i]["stop"]
            ended = epoch > 0 and stop.see(r["loss"] / r["held"] if r["held"] else float("nan"), going[i]["vector"])
            if ended or epochs[i] <= epoch:
                del going[i]
            else:
                going[i] = {"vector": np.frombuffer(r["w"], float) / r["n"], "step": round(r["step"] / r["n"])}
        epoch += 1
    out = []
    for u in live.values():
        u["training"].load(u["stop"].vector)
        u["model"].history = u["stop"].history
        out.append(_fitted(spec, u["key"], lambda _, u=u: spec.wrap(u["model"], u["cfg"]), u["n"]))
    return out + failed


def _from_rows(ok: DataFrame, todo: DataFrame, spec: ModelSpec, max_rows: int) -> list[dict]:
    """Units fitted on all rows: in one task each if there are no more than max_rows, or if the model knows no other way; else shard by shard."""
    n = ok.count() if spec.build else 0  # of kept rows: no job
    return _in_one_task(ok, todo, spec) if n <= max_rows else _from_shards(_write_shards(ok, -(-n // max_rows)), todo, spec)


#: Rows that a network trains on in one task, one after another.
SHARD = 16_384
#: Files of shards.
FILES = 96


def _kept(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """The usable rows. What trains a network reads them several times, so they are kept where all executors see them, and made once."""
    ok = _usable(df)
    return kept(ok, "rows") if spec.build else ok


def _fit(ok: DataFrame, todo: DataFrame, spec: ModelSpec, max_rows: int) -> list[dict]:
    return _from_sums(ok, todo, spec) if spec.fit_sums else _from_rows(ok, todo, spec, max_rows)


def fit_models(df: DataFrame, todo: DataFrame, model: str, max_rows: int = SHARD) -> list[dict]:
    """The fitted model (pickled) or the error of each unit, on the driver; models are small.

    All are fitted on all rows: models with fit_sums from their sums; networks in shards of about max_rows rows whose
    weights are averaged after each epoch (in one task if there are no more rows); others in one task. Rows that a unit
    holds out only tell it when to stop.
    """
    spec = get_model(model)
    return _fit(_kept(df, spec), todo, spec, max_rows)


def fit_units(df: DataFrame, todo: DataFrame, model: str, max_rows: int = SHARD) -> DataFrame:
    """df: sample_id, x array<double>, y, fold (that holds the row out). Out-of-fold predictions of each unit, one row a sample.

    Units are fitted by `fit_models`, when this is called; max_rows bounds the rows of a shard. Every row that a
    unit holds out is scored, batch by batch, in any number of tasks. A cfg with `without` fits and scores with that
    input as 0. A unit that fails gives one row with its error. Rows with null or non-finite inputs take no part.
    """
    spec, cols = get_model(model), [c.split()[0] for c in _SCORED.split(", ")]
    ok = _kept(df, spec)
    done = _fit(ok, todo, spec, max_rows)
    good = [u for u in done if u["status"] == "success"]

    def run(batches):
        mine = [(u, json.loads(u["cfg"]), pickle.loads(bytes(u["model"]))) for u in good]
        for t in batches:
            for u, cfg, fitted in mine:
                h = t[(t._fold == u["fold"]).to_numpy()]
                if len(h):
                    x = np.stack(h.x.to_numpy()).astype(float)
                    if "without" in cfg:
                        x[:, cfg["without"]] = 0.0
                    out = pd.DataFrame({"sample_id": h.sample_id, "obs": h.y.astype(float), "pred": spec.predict(fitted, x)})
                    yield out.assign(**{c: u[c] for c in cols if c in u})[cols]

    bad = [tuple(u.get(c) for c in cols) for u in done if u["status"] != "success"]
    scored = ok.mapInPandas(run, _SCORED)
    return scored.unionByName(df.sparkSession.createDataFrame(bad, _SCORED)) if bad else scored


def unit_scores(fitted: DataFrame) -> DataFrame:
    """The comparison table: one row a unit with its validation metrics."""
    from ..operators.metrics import calc_metrics

    keys = ["config_id", "cfg", "fold", "seed", "status"]
    n = fitted.groupBy(*keys).agg(F.max("n_params").alias("n_params"))
    m = calc_metrics(fitted, keys).select(*keys, F.col("ccc").alias("val_ccc"), F.col("mae").alias("val_mae"), F.col("rmse").alias("val_rmse"), F.col("r2").alias("val_r2"))
    return n.join(m, keys, "left")


def score_units(df: DataFrame, todo: DataFrame, model: str, max_rows: int = SHARD) -> DataFrame:
    """unit_scores of fit_units, from sums: tasks score what each unit holds out and return a row a unit."""
    from ..operators.metrics import Moments, metrics_of_moments

    spec = get_model(model)
    ok = _kept(df, spec)
    done = _fit(ok, todo, spec, max_rows)
    good = [(i, u) for i, u in enumerate(done) if u["status"] == "success"]

    def run(batches):
        mine, sums = [(i, u["fold"], json.loads(u["cfg"]), pickle.loads(bytes(u["model"]))) for i, u in good], Moments()
        for t in batches:
            if t.num_rows:
                x, y, folds = matrix(t["x"]), numbers(t["y"]), numbers(t["_fold"])
                for i, fold, cfg, fitted in mine:
                    z = x[folds == fold]
                    if "without" in cfg:
                        z[:, cfg["without"]] = 0.0
                    if len(z):
                        sums.add((i,), y[folds == fold], spec.predict(fitted, z))
        yield pa.RecordBatch.from_pandas(sums.frame(["i"]).astype({"i": "int64"}), preserve_index=False)

    keys = ["config_id", "cfg", "fold", "seed", "status"]
    rows = [(i, *[u[c] for c in keys], u["n_params"]) for i, u in enumerate(done)]
    n = df.sparkSession.createDataFrame(rows, "i long, config_id string, cfg string, fold int, seed int, status string, n_params long")
    m = metrics_of_moments(ok.mapInArrow(run, f"i long, {Moments.FIELDS}"), ["i"])
    m = m.select("i", F.col("ccc").alias("val_ccc"), F.col("mae").alias("val_mae"), F.col("rmse").alias("val_rmse"), F.col("r2").alias("val_r2"), F.lit(True).alias("_some"))
    return n.join(m, "i", "left").where("_some or status <> 'success'").drop("i", "_some")


def fit_one(df: DataFrame, model: str, cfg: dict, seed: int = 42, max_rows: int = SHARD):
    """One model of all folds but 0, as an object on the driver; models are small."""
    got = fit_models(df, units(df.sparkSession, [cfg], [0], base_seed=seed), model, max_rows)
    if not got or got[0]["model"] is None:
        raise ValueError(f"fit failed: {got and got[0]['error']}")
    return pickle.loads(bytes(got[0]["model"]))


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows of a matrix; nulls within them are nan."""
    if len(pc.unique(pc.list_value_length(column))) > 1 or column.null_count:
        raise ValueError("inputs are missing or of different lengths")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False), float)


def predict_units(df: DataFrame, model: str, fitted) -> DataFrame:
    """df with pred, batch by batch, in any number of tasks."""
    spec, schema = get_model(model), StructType([*df.drop("x").schema.fields, StructField("pred", DoubleType())])

    def run(batches):
        for t in batches:
            if t.num_rows:
                kept = t.drop_columns(["x"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(spec.predict(fitted, matrix(t["x"])), pa.float64())], [*kept.schema.names, "pred"])

    return df.mapInArrow(run, schema)


def borrowed_units(df: DataFrame, features: list[str], estimator: str, grid: list[dict], folds: list[int], seed: int = 42) -> DataFrame:
    """Out-of-fold predictions of any regressor of pyspark.ml by class name; each fit is itself distributed.

    A fit reads its rows several times, so the rows are kept where all executors see them, and made once, when this is called.
    """
    from pyspark.ml import regression
    from pyspark.ml.feature import VectorAssembler

    rows = kept(df.select("sample_id", "y", "fold", *features), "borrowed")
    x = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(rows)
    out = None
    for i, cfg in enumerate(grid):
        for fold in folds:
            kind = getattr(regression, estimator)
            params = cfg | ({"seed": seed} if hasattr(kind, "seed") else {})
            fitted = kind(featuresCol="_features", labelCol="y", predictionCol="pred", **params).fit(x.where(F.col("fold") != fold))
            p = fitted.transform(x.where(F.col("fold") == fold)).select(F.lit(f"cfg_{i + 1:03d}").alias("config_id"), "fold", "sample_id", F.col("y").alias("obs"), "pred")
            out = p if out is None else out.unionByName(p)
    return out


def borrowable() -> list[str]:
    from pyspark.ml import regression
    from pyspark.ml.base import Predictor

    return sorted(n for n, c in vars(regression).items() if isinstance(c, type) and issubclass(c, Predictor) and c.__module__ == regression.__name__ and not n.startswith("_"))

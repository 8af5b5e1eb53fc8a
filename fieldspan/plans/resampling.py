"""Resampling as declarations that become plans, and what a final fit makes of a plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kept
from . import apply_buffer, blocks, check_plan, deal, draw_groups, matched_folds, near, placed, suggest_block_size

#: Sides that the automatic block size is chosen from.
SIDES = (0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0)


@dataclass(frozen=True)
class Spec:
    """How to resample, before there are data."""

    kind: str
    k: int | None = 5
    test_frac: float = 0.15
    calibration_frac: float = 0.0
    validation_frac: float = 0.15
    group: str | None = "auto"
    block_size: float | str = "auto"
    buffer: float | str | None = "auto"
    max_share: float = 0.1
    metric: str = "chebyshev"
    targets: DataFrame | None = field(default=None, compare=False)
    seed: int = 42

    def __post_init__(self) -> None:
        if self.kind not in ("spatial", "knndm", "random", "holdout", "region"):
            raise ValueError(f"no such kind of resampling: {self.kind!r}")
        if self.k is not None and self.k < 2:
            raise ValueError("k is to be 2 at least")
        for name in ("test_frac", "calibration_frac", "validation_frac", "max_share"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is to be a fraction")
        if self.test_frac + self.calibration_frac >= 1:
            raise ValueError("test_frac and calibration_frac leave nothing to train on")


def spatial_cv(k: int = 5, block_size: float | str = "auto", buffer: float | str | None = "auto", **more) -> Spec:
    return Spec("spatial", k, block_size=block_size, buffer=buffer, **more)


def knndm_cv(k: int = 5, targets: DataFrame | None = None, **more) -> Spec:
    return Spec("knndm", k, targets=targets, **{"test_frac": 0.0, **more})


def random_cv(k: int = 5, group: str | None = "auto", **more) -> Spec:
    return Spec("random", k, group=group, **more)


def holdout_cv(validation_frac: float = 0.15, group: str | None = "auto", **more) -> Spec:
    if validation_frac <= 0:
        raise ValueError("validation_frac is to be above 0")
    return Spec("holdout", None, validation_frac=validation_frac, group=group, **more)


def region_cv(group: str, k: int | None = None, **more) -> Spec:
    return Spec("region", k, group=group, **more)


@dataclass(frozen=True)
class Plan:
    """(fold, sample_id, role) rows, what made them, and the group of each sample (sample_id, group)."""

    rows: DataFrame
    groups: DataFrame
    spec: Spec
    method: str
    params: dict = field(default_factory=dict)


def row_groups(points: DataFrame, group: str | None = "auto") -> DataFrame:
    """(sample_id, group): rows that are to stay together. "auto": rows of one profile, if any has several; else each row. Nulls are refused."""
    own = F.col("sample_id").cast("string")
    if group is None or group == "row" or (group == "auto" and "profile" not in points.columns):
        return points.select("sample_id", own.alias("group"))
    column = "profile" if group == "auto" else group
    facts = points.agg(F.count_if(F.col(column).isNull()).alias("nulls"), F.count("*").alias("n"), F.count_distinct(column).alias("d")).first()
    if facts["nulls"]:
        raise ValueError(f"{column} has {facts['nulls']} missing values: such a row cannot be kept with its group")
    if group == "auto" and facts["n"] == facts["d"]:
        return points.select("sample_id", own.alias("group"))
    return points.select("sample_id", F.col(column).cast("string").alias("group"))


def _frozen(ids: DataFrame, groups: DataFrame, what: str) -> DataFrame:
    lost = ids.select("sample_id").join(groups, "sample_id", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} frozen {what} ids are not among the points")
    return ids.select("sample_id").distinct()


def carve(groups: DataFrame, test_frac: float = 0.0, calibration_frac: float = 0.0, seed: int = 42, test_ids: DataFrame | None = None, calibration_ids: DataFrame | None = None) -> DataFrame:
    """(sample_id, group, role): test, calibration, or null for the rest. Whole groups are drawn; frozen ids are taken as they are.

    calibration_frac is of all points, drawn out of what the test set leaves.
    """
    none = groups.select("sample_id").where("false")
    test = none
    if test_ids is not None:
        test = _frozen(test_ids, groups, "test")
    elif test_frac > 0:
        test = groups.join(draw_groups(groups, "group", test_frac, seed + 1000), "group", "left_semi").select("sample_id")
    rest = groups.join(test, "sample_id", "left_anti")
    calibration = none
    if calibration_ids is not None:
        calibration = _frozen(calibration_ids, groups, "calibration")
        both = calibration.join(test, "sample_id", "left_semi").count()
        if both:
            raise ValueError(f"{both} calibration ids are in the test set as well")
    elif calibration_frac > 0:
        share = calibration_frac * groups.count() / max(rest.count(), 1)
        if share >= 1:
            raise ValueError("calibration_frac takes every point that the test set left")
        calibration = rest.join(draw_groups(rest, "group", share, seed + 2000), "group", "left_semi").select("sample_id")
    held = test.withColumn("role", F.lit("test")).unionByName(calibration.withColumn("role", F.lit("calibration")))
    return groups.join(held, "sample_id", "left").select("sample_id", "group", "role")


def _from_folds(carved: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """Rows of a plan from what was carved and (group, fold) of the rest."""
    x = carved.join(folds.withColumnRenamed("fold", "_f"), "group", "left").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return x.select("fold", "sample_id", F.coalesce("role", F.when(F.col("_f") == F.col("fold"), "validation").otherwise("train")).alias("role"))


def holdout_rows(carved: DataFrame, validation_frac: float, seed: int) -> DataFrame:
    """One fold, whose validation set is max(1, floor(validation_frac * groups)) groups of the rest, the first by a hash."""
    from ..functions import draw_key

    pool = carved.where("role is null").select("group").distinct().withColumn("_h", draw_key(seed, "group"))
    take = max(1, int(validation_frac * pool.count()))
    chosen = pool.orderBy("_h").limit(take).select("group", F.lit(1).alias("fold"))
    return _from_folds(carved, chosen, 1)


def resolve(spec: Spec | Plan, points: DataFrame, cell_size: float | None = None, windows: Sequence[int] = (), test_ids: DataFrame | None = None, calibration_ids: DataFrame | None = None) -> Plan:
    """The plan of a declaration over points (sample_id, x, y and the columns that spec names), checked.

    An automatic buffer is the largest window times the cell size; an automatic block size is measured. A plan is returned
    as it is. No points, or a plan whose roles overlap or split a group, are refused.
    """
    if isinstance(spec, Plan):
        return spec
    if not points.limit(1).count():
        raise ValueError("there are no points to resample")
    params: dict = {}
    if spec.kind == "spatial":
        side = spec.block_size
        if side == "auto":
            side = suggest_block_size(points, list(SIDES), spec.k, spec.max_share).first()["block_size"]
        buffer = spec.buffer
        if buffer == "auto":
            if cell_size is None or not windows:
                raise ValueError("an automatic buffer needs the cell size and the windows")
            buffer = max(windows) * cell_size
        params = {"block_size": float(side), "buffer": buffer}
        groups = blocks(points, float(side)).select("sample_id", F.col("block").alias("group"))
    elif spec.kind == "knndm":
        groups = points.select("sample_id", F.col("sample_id").cast("string").alias("group"))
    else:
        groups = row_groups(points, spec.group)
    carved = carve(groups, spec.test_frac, spec.calibration_frac, spec.seed, test_ids, calibration_ids)
    pool = carved.where("role is null")
    if spec.kind == "holdout":
        rows = holdout_rows(carved, spec.validation_frac, spec.seed)
    elif spec.kind == "knndm":
        if spec.targets is None:
            raise ValueError("distance-matched folds need the points to predict at")
        folds, _ = matched_folds(points.join(pool, "sample_id", "left_semi"), spec.targets, [0.0, *SIDES], spec.k, spec.seed)
        rows = _from_folds(carved, folds.select(F.col("sample_id").cast("string").alias("group"), "fold"), spec.k)
    else:
        k = spec.k or pool.select("group").distinct().count()
        params["k"] = k
        rows = _from_folds(carved, deal(pool, "group", k, spec.seed), k)
    if params.get("buffer"):
        rows = apply_buffer(rows, points, params["buffer"], spec.metric)
    bad = check_plan(rows, groups).where("n_overlap > 0" + (" or n_split_groups > 0" if test_ids is None and calibration_ids is None else "")).count()
    if bad:
        raise ValueError(f"{bad} folds have rows or groups in two roles")
    return Plan(rows, groups, spec, spec.kind, params)


def refit_split(plan: Plan, points: DataFrame, validation_frac: float = 0.15) -> Plan:
    """The split of a final fit, by the plan's own criterion: one fold of k = round(1 / validation_frac), the held-out sets frozen.

    Where folds are as large as they come (regions, distance-matched folds) the one nearest to validation_frac of the pool
    validates, else the first.
    """
    ids = {r: plan.rows.where(F.col("role") == r).select("sample_id").distinct() for r in ("test", "calibration")}
    frozen = {f"{r}_ids": x for r, x in ids.items() if x.limit(1).count()}
    k = max(2, round(1 / validation_frac))
    spec = replace(plan.spec, test_frac=0.0, calibration_frac=0.0, **({"validation_frac": validation_frac} if plan.method == "holdout" else {"k": k}))
    if plan.method == "spatial":
        spec = replace(spec, block_size=plan.params["block_size"], buffer=plan.params["buffer"])
    sub = resolve(spec, points, **frozen)
    pick = 1
    if plan.method in ("knndm", "region"):
        sizes = {r["fold"]: r["n"] for r in sub.rows.where("role = 'validation'").groupBy("fold").agg(F.count("*").alias("n")).collect()}
        pool = sub.rows.where("fold = 1 and role in ('train', 'validation')").count()
        pick = min(sizes, key=lambda f: (abs(sizes[f] - validation_frac * pool), f))
    rows = sub.rows.where(F.col("fold") == pick).withColumn("fold", F.lit(1))
    return Plan(rows, sub.groups, spec, f"refit_{plan.method}", sub.params | {"refit_fold": pick, "validation_frac": validation_frac})


def plan_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows (fold, sample_id, role, change) that a plan has lost or gained since."""
    key = ["fold", "sample_id", "role"]
    lost = before.select(*key).join(now.select(*key), key, "left_anti").withColumn("change", F.lit("lost"))
    return lost.unionByName(now.select(*key).join(before.select(*key), key, "left_anti").withColumn("change", F.lit("gained")))


def check_unchanged(now: DataFrame, before: DataFrame) -> None:
    """Refuse to resume a run under another plan."""
    n = plan_changes(now, before).count()
    if n:
        raise ValueError(f"the plan differs from the run's in {n} rows")


def without_test(plan: DataFrame, evaluate_test: bool = False) -> DataFrame:
    return plan if evaluate_test else plan.where("role <> 'test'")


def buffer_report(plan: DataFrame, points: DataFrame, distance: float, metric: str = "chebyshev") -> DataFrame:
    """By fold, what a buffer takes: training rows by what they are near to, and validation rows."""
    # Rows of one place and role are near to the same, so places are compared; they are made once.
    x = kept(placed(plan, points, "x", "y").groupBy("fold", "role", "x", "y").agg(F.count("*").alias("n")), "places")
    train, val = x.where("role = 'train'"), x.where("role = 'validation'")
    parts = []
    for name, rows, others in (
        ("n_near_validation", train, ["validation"]), ("n_near_test", train, ["test"]), ("n_near_calibration", train, ["calibration"]),
        ("n_dropped", train, ["validation", "test", "calibration"]), ("n_validation_dropped", val, ["test", "calibration"]),
    ):
        parts.append(near(rows, x.where(F.col("role").isin(others)), distance, ["fold"], metric).select("fold", "n", F.lit(name).alias("part")))
    for name, rows in (("n_train_before", train), ("n_validation_before", val)):
        parts.append(rows.select("fold", "n", F.lit(name).alias("part")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    names = ["n_train_before", "n_dropped", "n_near_validation", "n_near_test", "n_near_calibration", "n_validation_before", "n_validation_dropped"]
    out = whole.groupBy("fold").agg(*[F.coalesce(F.sum(F.when(F.col("part") == n, F.col("n"))), F.lit(0).cast("long")).alias(n) for n in names])
    return out.withColumn("pct_dropped", F.round(100 * F.col("n_dropped") / F.nullif("n_train_before", F.lit(0)), 2))

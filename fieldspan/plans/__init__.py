"""Resampling plans as long tables (fold, sample_id, role), and spatial joins that build them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draw_key, running_sum


def blocks(df: DataFrame, size: float) -> DataFrame:
    """block: the square of side `size` that (x, y) is in, counted from the least x and y of the table."""
    low = df.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    at = lambda c, o: F.floor((F.col(c) - F.col(o)) / size).cast("string")
    return df.crossJoin(F.broadcast(low)).withColumn("block", F.concat_ws("_", at("x", "_x0"), at("y", "_y0"))).drop("_x0", "_y0")


def block_share(df: DataFrame, sizes: list[float]) -> DataFrame:
    """For each side: blocks, the largest one's share of the rows, the median count."""
    low = df.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    x = df.crossJoin(F.broadcast(low)).withColumn("block_size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    i, j = F.floor((F.col("x") - F.col("_x0")) / F.col("block_size")), F.floor((F.col("y") - F.col("_y0")) / F.col("block_size"))
    counts = x.groupBy("block_size", i.alias("i"), j.alias("j")).agg(F.count("*").alias("c"))
    return counts.groupBy("block_size").agg(F.count("*").alias("n_blocks"), (F.max("c") / F.sum("c")).alias("largest_share"), F.median("c").alias("median_count"))


def suggest_block_size(df: DataFrame, sizes: list[float], k: int = 5, max_share: float = 0.1, per_fold: int = 10) -> DataFrame:
    """The largest side whose largest block is small enough and that leaves enough blocks; else the one of least share."""
    s = block_share(df, sizes)
    good = (F.col("largest_share") <= max_share) & (F.col("n_blocks") >= per_fold * k)
    return s.agg(F.coalesce(F.max(F.when(good, F.col("block_size"))), F.min_by("block_size", "largest_share")).alias("block_size"))


def draw_groups(df: DataFrame, group: str, frac: float, seed: int) -> DataFrame:
    """Groups in a random order, taken while fewer rows than the fraction have been taken before. One row a group."""
    g = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n")).withColumn("_h", draw_key(seed, "group"))
    g = running_sum(g, "_h", "n", "_upto").crossJoin(F.broadcast(df.agg(F.count("*").alias("_all"))))
    return g.where(F.col("_upto") - F.col("n") < F.ceil(F.col("_all") * frac)).select("group")



def deal(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """group -> fold: the largest group first, each to the fold with the fewest rows, ties to the lower fold."""
    sizes = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"))
    one = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), draw_key(seed, "group").alias("h"), "group"))).alias("g"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("load"), F.array().cast("array<int>").alias("to"))

    def step(acc: Column, g: Column) -> Column:
        at = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == at - 1, v - g["m"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["to"], F.array(at)).alias("to"))

    dealt = one.select("g", F.aggregate("g", start, step)["to"].alias("to"))
    return dealt.select(F.explode(F.arrays_zip("g", "to")).alias("z")).select(F.col("z.g.group").alias("group"), F.col("z.to").alias("fold"))


def kfold_plan(df: DataFrame, group: str, k: int, test_frac: float = 0.0, seed: int = 42) -> DataFrame:
    """(fold, sample_id, role): whole groups are carved for the test, the rest dealt to folds; others train."""
    test = draw_groups(df, group, test_frac, seed + 1000) if test_frac > 0 else None
    x = df.select("sample_id", F.col(group).alias("group"))
    pool = x.join(test, "group", "left_anti") if test is not None else x
    out = pool.join(deal(pool, "group", k, seed).withColumnRenamed("fold", "_f"), "group")
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    out = out.select("fold", "sample_id", F.when(F.col("_f") == F.col("fold"), "validation").otherwise("train").alias("role"))
    if test is None:
        return out
    held = x.join(test, "group", "left_semi").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return out.union(held.select("fold", "sample_id", F.lit("test")))


#: Tasks that rows of a plan meet their points in, at least.
MEET = 64


def placed(plan: DataFrame, points: DataFrame, *cols: str) -> DataFrame:
    """The plan with columns of its points, by sample_id.

    They meet in a stated number of tasks: merged by their compressed bytes, of which ids have few, a task sorts many times as many rows.
    """
    n = max(MEET, int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # of fewer than a join would have, Spark makes its own
    return plan.repartition(n, "sample_id").join(points.select("sample_id", *cols).repartition(n, "sample_id"), "sample_id")


def near(a: DataFrame, b: DataFrame, distance: float, keys: list[str] = (), metric: str = "chebyshev", how: str = "left_semi") -> DataFrame:
    """Rows of a with (or, left_anti, without) a row of b within `distance`, inclusive; an equi-join of buckets of that side."""
    side = max(distance, 1e-9)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    left = a.withColumn("_i", cell("x")).withColumn("_j", cell("y"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("x").alias("_x"), F.col("y").alias("_y")).distinct().withColumn("_d", around)
    right = right.withColumn("_bi", cell("_x") + F.col("_d.di")).withColumn("_bj", cell("_y") + F.col("_d.dj"))
    dx, dy = F.abs(F.col("x") - F.col("_x")), F.abs(F.col("y") - F.col("_y"))
    far = F.greatest(dx, dy) if metric == "chebyshev" else F.sqrt(dx * dx + dy * dy)
    on = (F.col("_i") == F.col("_bi")) & (F.col("_j") == F.col("_bj")) & (far <= distance)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return left.join(right, on, how).drop("_i", "_j")


def apply_buffer(plan: DataFrame, points: DataFrame, distance: float, metric: str = "chebyshev") -> DataFrame:
    """The plan without training rows near validation or test rows of their fold, and validation rows near test rows."""
    x = placed(plan, points, "x", "y")
    train, val, rest = x.where("role = 'train'"), x.where("role = 'validation'"), x.where("role not in ('train', 'validation')")
    train = near(train, x.where("role <> 'train'"), distance, ["fold"], metric, "left_anti")
    val = near(val, rest, distance, ["fold"], metric, "left_anti")
    return train.union(val.select(train.columns)).union(rest.select(train.columns)).select("fold", "sample_id", "role")


def spatial_folds(points: DataFrame, k: int = 5, size: float = 10.0, distance: float | None = None, test_frac: float = 0.0, seed: int = 42) -> DataFrame:
    """Folds of whole square blocks of side `size`; with a distance, the buffer is applied."""
    plan = kfold_plan(blocks(points, size), "block", k, test_frac, seed)
    return apply_buffer(plan, points, distance) if distance else plan


def leakage(plan: DataFrame, cells: DataFrame, window: int) -> DataFrame:
    """By fold: validation rows, and those that share a patch pixel with a training row. cells: sample_id, x, y as integers."""
    x = placed(plan, cells, "x", "y")
    val = x.where("role = 'validation'")
    hit = near(val, x.where("role = 'train'"), max(1, window - 1), ["fold"])
    n, h = val.groupBy("fold").agg(F.count("*").alias("n")), hit.groupBy("fold").agg(F.count("*").alias("n_shared"))
    return n.join(h, "fold", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("long"))).withColumn("share", F.col("n_shared") / F.col("n"))


def check_plan(plan: DataFrame, groups: DataFrame) -> DataFrame:
    """By fold: rows of each role, rows with two roles, groups with rows in two roles."""
    twice = plan.groupBy("fold", "sample_id").agg(F.count_distinct("role").alias("r")).groupBy("fold").agg(F.count_if(F.col("r") > 1).alias("n_overlap"))
    split = placed(plan, groups, "group").groupBy("fold", "group").agg(F.count_distinct("role").alias("r")).groupBy("fold").agg(F.count_if(F.col("r") > 1).alias("n_split_groups"))
    size = plan.groupBy("fold").agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("train", "validation", "test")])
    return size.join(twice, "fold").join(split, "fold")


def matched_folds(points: DataFrame, targets: DataFrame, sizes: list[float], k: int = 5, seed: int = 42, sample: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Folds whose distances to the nearest training point are most like those from the targets to the points.

    Candidates are folds of whole square blocks of each side, and of single rows (side 0). Distances are measured from
    at most `sample` points (of least md5) to all; the candidate of least mean absolute difference of quantiles wins.
    Returns (sample_id, fold) and the table of candidates (block_size, w).
    """
    from ..operators.spatial import nearest

    drawn = lambda df: df.orderBy(draw_key(seed, "id"), "id").limit(sample)
    vector = F.array("x", "y").alias("v")
    levels = F.array(*[F.lit(i / 20) for i in range(1, 20)])
    shape = lambda d, name: d.agg(F.percentile("d", levels).alias(name))
    p = points.select(F.col("sample_id").alias("id"), "x", "y")
    goal = shape(nearest(drawn(targets.select("id", vector)), p.select("id", vector)), "goal")
    table, dealt = None, {}
    for size in sizes:
        g = blocks(p, size) if size > 0 else p.withColumn("block", F.md5(F.col("id").cast("string")).substr(1, 3))
        dealt[size] = g.join(deal(g, "block", k, seed).withColumnRenamed("group", "block"), "block").select("id", "x", "y", "fold")
        v = dealt[size].select("id", vector, "fold")
        got = shape(nearest(drawn(v), v, other_folds=True), "got").crossJoin(goal)
        w = F.aggregate(F.zip_with("got", "goal", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 19
        row = got.select(F.lit(float(size)).alias("block_size"), w.alias("w"))
        table = row if table is None else table.unionByName(row)
    best = min(table.collect(), key=lambda r: (r["w"], r["block_size"]))["block_size"]
    return dealt[next(s for s in sizes if float(s) == best)].select(F.col("id").alias("sample_id"), "fold"), table

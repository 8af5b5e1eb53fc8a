import pytest
from pyspark.sql import functions as F

from fieldspan import plans, queries
from fieldspan.operators import tables
from fieldspan.sources import csv2


def test_strict_join_refuses_misses(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert tables.strict_join(a.where("k = 1"), b, ["k"]).collect() == [(1, "x")]
    with pytest.raises(Exception, match="no match for 2"):
        tables.strict_join(a, b, ["k"]).collect()


def test_csv2_round_trip(spark, tmp_path):
    schema = "k long, v double, t string"
    df = spark.createDataFrame([(1, 0.1, "a;b"), (2, -1.5e-7, 'q"x'), (3, None, "1,5")], schema)
    csv2.write(df, str(tmp_path / "t"))
    assert sorted(csv2.read(spark, str(tmp_path / "t"), schema).collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="(?i)exist"):
        csv2.write(df, str(tmp_path / "t"))


def test_spatial_folds_keep_blocks_whole_and_apart(spark, sf_dir):
    p = queries.points(spark, sf_dir)
    groups = plans.blocks(p, 10.0).select("sample_id", F.col("block").alias("group"))
    assert all(r.n_split_groups == 0 and r.n_overlap == 0 and r.n_test > 0 for r in plans.check_plan(plans.spatial_folds(p, test_frac=0.15), groups).collect())
    x = plans.spatial_folds(p, distance=1.0).join(p, "sample_id").toPandas()
    for _, f in x.groupby("fold"):
        val, train = f[f.role == "validation"], f[f.role == "train"]
        assert len(val) and len(train)
        assert all(max(abs(v.x - t.x), abs(v.y - t.y)) > 1 for v in val.itertuples() for t in train.itertuples())

"""Fold modes hand case (4 folds, first saturation at 3, 6, 1, never),
contiguous k-fold arithmetic, distributed row index = window row_number."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import history as H
from factloom.operators.ordering import row_index
from factloom.plans.q_build import kfold_of


def test_fold_modes(spark):
    df = spark.createDataFrame([("m", 0, 3.0), ("m", 1, 6.0), ("m", 2, 1.0), ("m", 3, None)],
                               "model string, fold int, velocity double")
    r = {x.mode: x.value for x in H.fold_modes(df, ["model"], "velocity", 4).collect()}
    assert r["STRICT"] is None and r["NAIVE"] == 2.5 and abs(r["WISE"] - 10 / 3) < 1e-12


def test_kfold_contiguous(spark):
    df = spark.range(0, 13).withColumn("n", F.lit(13))
    folds = [r.f for r in df.select(kfold_of(F.col("id"), F.col("n")).alias("f")).orderBy("id").collect()]
    assert folds == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_row_index_matches_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 3001).alias("o"))
    a = row_index(df, ["k"], ["o"], out="i", partitions=7)
    b = df.withColumn("j", F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1)
    j = a.join(b, ["k", "o"])
    assert j.count() == 3000 and j.where("i != j").count() == 0

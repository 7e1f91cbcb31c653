"""Edit distance by bit vectors, over texts decoded once."""

import random

from pyspark.sql import functions as F

from factloom.operators import scoring as S
from factloom.plans import q_serial as QS

SF = "/root/testdata/sf0.001"


def test_edit_distance_is_that_of_the_engine(spark):
    rng = random.Random(2)

    def text():
        return "".join(rng.choice("ab<é😀\n") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130])))
    rows = [(text(), text()) for _ in range(300)] + [(None, "a"), ("a", None), (None, None), ("", ""), ("abc", "cba")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.edit_distance(F.col("a"), F.col("b")).alias("x"), F.levenshtein("a", "b").alias("y")).collect()
    assert len(got) == len(rows) and all(r.x == r.y for r in got)


def test_edit_distance_decodes_a_text_once(spark):
    df = QS.a7_edit_distance(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("from_json (") <= 2  # the list's reader, gold and prediction
    assert {r.syntax for r in df.collect()} == set(QS._EDITED)

"""Keyed state of the saturation stream, shape triples, and head changes, on hand cases."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from factloom.operators import shapes
from factloom.sources.derived import SHAPE, SHAPE_SCHEMA, SHAPE_TARGET_CLASS
from factloom.streaming import jobs, run_state


def test_advance_counts_steps_in_order():
    rows = [(0, 0, i, v) for i, v in enumerate([None, 0.5, 0.95, 0.9, 0.2, float("nan"), 0.99])]
    whole = run_state.advance(run_state._START, rows, 0.9)
    assert whole[:6] == (7, 2, 0.95, 1, 4, 0.99)
    assert run_state.advance(run_state.advance(run_state._START, rows[:3], 0.9), rows[3:], 0.9) == whole


def test_late_rows_take_their_place_over_restarts(spark, tmp_path):
    """Rows of three micro-batches; those of one run come in the wrong order.  A run
    that falls silent is settled by its timer; state outlives the query."""
    day = 86_400
    # (run, event_id, second, value)
    batches = [[(1, 3, 300, 0.2), (1, 1, 100, 0.5), (2, 10, 50, 0.95), (3, 20, 10, None)],
               [(1, 2, 200, 0.95), (2, 11, 60, 0.1)],
               [(1, 4, 3 * day, 0.3), (2, 12, 3 * day, 0.99), (2, 13, 3 * day + 1, 0.5)],
               [(1, 5, 3 * day + 9, 0.97), (1, 99, 400, 0.99)]]
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    before = spark.conf.get(jobs._PROVIDER, None)
    spark.conf.set(jobs._PROVIDER, jobs._ROCKS)
    try:
        for rows in batches:
            df = spark.createDataFrame(rows, "run long, event_id long, s long, value double")
            df.select("run", "event_id", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema("run long, event_id long, ts timestamp, value double").parquet(source)
            (run_state.saturation(stream, 0.9).writeStream.outputMode("update")
             .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"))
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(jobs._PROVIDER, before) if before else spark.conf.unset(jobs._PROVIDER)
    got = spark.read.schema(run_state.RESULT + ", batch int").parquet(out)
    last = {r.run: r.r for r in got.groupBy("run").agg(F.max_by(F.struct(*got.columns[1:-1]), F.col("batch")).alias("r")).collect()}
    # The row of second 400 comes more than a day late and is left out.
    assert tuple(last[1]) == (5, 1, 0.95, 2, 3, 0.97)
    assert tuple(last[2]) == (4, 0, 0.95, 2, 3, 0.5)
    assert tuple(last[3]) == (1, None, None, 0, None, None)


def shape_rows(spark, rows, g=1):
    return spark.createDataFrame(rows, SHAPE_SCHEMA).withColumns({"g": F.lit(g), "target_class": F.lit(SHAPE_TARGET_CLASS)})


def test_shape_comes_back_from_its_triples(spark):
    triples = shapes.triples_of(shape_rows(spark, SHAPE)).cache()
    names = [f.split()[0] for f in SHAPE_SCHEMA.split(", ")]
    got = shapes.extract(triples).select(*names, "target_class").collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(SHAPE, key=str)
    assert {r.target_class for r in got} == {SHAPE_TARGET_CLASS}


def test_long_lists_two_choices_and_two_graphs(spark):
    long = [(f"dbo:p{i}", "xsd:string", 1, None, None, 1, i) for i in range(1, 8)]
    other = [("dbo:a", None, None, None, None, 2, 1), ("dbo:b", "xsd:date", 0, 2, "sh:IRI", 2, 2), ("dbo:a", None, 1, None, None, None, None)]
    both = shapes.triples_of(shape_rows(spark, long + other)).unionByName(shapes.triples_of(shape_rows(spark, other[2:], 2)))
    got = shapes.extract(both).drop("target_class").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, *r) for r in long + other] + [(2, *other[2])], key=str)


def test_empty_choice_and_endless_list(spark):
    def triples(rows):
        return spark.createDataFrame([Row(g=1, s=s, p=p, o=o) for s, p, o in rows])

    shape = [("S", "sh:targetClass", "C"), ("S", "sh:property", "b"), ("b", "sh:path", "x")]
    one = shapes.extract(triples(shape + [("S", "sh:or", "rdf:nil")])).collect()
    assert [(r.path, r.or_group) for r in one] == [("x", None)]
    with pytest.raises(ValueError):
        shapes.extract(triples(shape + [("S", "sh:or", "l"), ("l", "rdf:first", "b"), ("l", "rdf:rest", "l")]))

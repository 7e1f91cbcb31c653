"""Structured Streaming re-aims (ST1–ST3) over the driver's files.

Sources are file streams over the parquet folder; sinks write parquet into
the cluster's shared checkpoint folder (``spark.checkpoint.dir``), never to
the driver.  ``availableNow`` drains what is there and stops, so a batch run
and the stream see the same rows (stream = batch equality is the test).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.vocab import SATURATION_THRESHOLD
from factloom.session import checkpoint_dir
from factloom.streaming import run_state

EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                 "value double, props string")


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf_dir))


def run_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Stateful aggregation in update mode: a micro-batch writes the groups it
    changed to a folder of its own (written anew if the batch is repeated), and
    the latest row of every group is the result."""
    spark = stream.sparkSession
    base = _scratch(spark, name)
    out = os.path.join(base, "out")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    latest = F.max_by(F.struct(*values), F.col("batch")).alias("r")
    return spark.read.parquet(out).groupBy(*keys).agg(latest).select(*keys, "r.*")


def run_append(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    base = _scratch(spark, name)
    out = os.path.join(base, "out")
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def metric(value):
    return value / (value + 20)


def epoch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: metrics per (event_type, day) as the rows arrive.  The watermark is on
    the grouping column, so a day's state goes once the stream is a day past it;
    rows later than that are dropped."""
    # The watermark needs an instant; the one whose UTC clock shows the event's
    # zone-less time keeps day boundaries apart from the session zone.
    wall = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    ev = events_stream(spark, sf_dir).withColumn("ts_event", wall).withWatermark("ts_event", "1 day")
    agg = (ev.groupBy(F.window("ts_event", "1 day").alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(metric(F.col("value"))).alias("metric_sum")))
    out = run_update(agg.select(F.col("w.start").alias("start"), "event_type", "n", "metric_sum"), "st1",
                     ["start", "event_type"])
    start = F.to_utc_timestamp("start", F.current_timezone())
    return out.select(F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                      "n", F.round("metric_sum", 6).alias("metric_sum"))


def online_saturation(spark: SparkSession, sf_dir: str, thr: float = SATURATION_THRESHOLD) -> DataFrame:
    """ST2: per run, first event time the metric exceeds the threshold, the
    saturating and total counts — updated incrementally per micro-batch."""
    ev = events_stream(spark, sf_dir)
    m = metric(F.col("value"))
    agg = ev.groupBy(F.col("user_id").alias("run")).agg(
        F.min(F.when(m > thr, F.col("ts"))).alias("first_sat"),
        F.count_if(m > thr).alias("n_sat"), F.count(F.lit(1)).alias("n"))
    out = run_update(agg, "st2", ["run"])
    return out.select("run", F.date_format("first_sat", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_sat"),
                      "n_sat", "n")


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_saturation(spark: SparkSession, sf_dir: str, thr: float = SATURATION_THRESHOLD, slices: int = 3) -> DataFrame:
    """ST2 as keyed state.  The events arrive in slices of time, a seventh of them
    ten hours late, and the query is started anew for every slice from its own
    checkpoint, as a job that is stopped and resumed."""
    ev = spark.read.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ev = ev.select(F.col("user_id").alias("run"), "event_id",
                   F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts"),
                   F.when(F.col("event_type") != "error", metric(F.col("value"))).alias("value"))
    arrival = F.unix_micros("ts") + F.when(F.col("event_id") % 7 == 0, 36_000_000_000).otherwise(0)
    ev = ev.withColumn("arrival", arrival)
    first, last = ev.agg(F.min("arrival"), F.max("arrival")).first()
    base = _scratch(spark, "st2-state")
    source, out = os.path.join(base, "in"), os.path.join(base, "out")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        for i in range(slices if first is not None else 0):
            low, high = (first + (last - first + 1) * j // slices for j in (i, i + 1))
            ev.filter((F.col("arrival") >= low) & (F.col("arrival") < high)).drop("arrival").write.mode("append").parquet(source)
            stream = spark.readStream.schema("run long, event_id long, ts timestamp, value double").parquet(source)
            (run_state.saturation(stream, thr).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    if first is None:
        return spark.createDataFrame([], run_state.RESULT)
    rows = spark.read.schema(run_state.RESULT + ", batch int").parquet(out)
    names = [c for c in rows.columns if c not in ("run", "batch")]
    return rows.groupBy("run").agg(F.max_by(F.struct(*names), F.col("batch")).alias("r")).select("run", "r.*")


def sample_log(spark: SparkSession, sf_dir: str, every: int = 100, batch: int = 4) -> DataFrame:
    """ST3: every N-th batch (batches of ``batch`` events by id) is logged."""
    ev = events_stream(spark, sf_dir)
    b = F.expr(f"event_id div {batch}")
    logged = ev.where(((b + 1) % every) == 0).select("event_id", "user_id", "event_type",
                                                     F.round("value", 6).alias("value"))
    return run_append(logged, "st3")

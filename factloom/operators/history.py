"""Meta-metrics over training histories.

All per-run statistics are aggregates (``min``/``max_by``/``count_if``) with
map-side partial aggregation, so a run with very many logged steps does not
have to sit in one window partition; the early-stop scan (W8) windows over
ranges of a run, the top-k (W7) has two phases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.vocab import SATURATION_THRESHOLD
from factloom.session import cut_lineage

L = F.lit
METRICS = ("val_part_parsed", "val_F1_macro", "val_F1_micro")


def missing_to_null(c: Column) -> Column:
    """NaN is missing (null); 0.0 is a value (Q11 fixed)."""
    return F.when(~F.isnan(c), c)


def last_write_wins(history: DataFrame, run_keys: Sequence[str]) -> DataFrame:
    """Keep rows with epoch and val_loss; the last logged step per epoch wins."""
    kept = history.where(F.col("epoch").isNotNull() & F.col("val_loss").isNotNull())
    cols = [c for c in kept.columns if c not in (*run_keys, "epoch")]
    latest = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col("step"))
    return (kept.groupBy(*run_keys, "epoch").agg(latest.alias("_r"))
            .select(*run_keys, "epoch", *[F.col("_r")[c].alias(c) for c in cols]))


def saturation(hist: DataFrame, run_keys: Sequence[str], metrics: Sequence[str] = METRICS,
               thr: float = SATURATION_THRESHOLD) -> DataFrame:
    """W2-W6 for all metrics: velocity (first epoch above thr), saturated flag,
    broken steps after it, stability and divergence, one row per run and metric.
    One aggregate for all first epochs, one join, one aggregate for what follows
    them, one ``stack``."""
    def above(m: str) -> Column:
        return missing_to_null(F.col(m)) > thr

    first = hist.groupBy(*run_keys).agg(
        F.count(L(1)).alias("n_epochs"),
        *[x for i, m in enumerate(metrics) for x in (
            F.min(F.when(above(m), F.col("epoch"))).alias(f"_v{i}"),
            F.min_by(F.col(m), F.when(above(m), F.col("epoch"))).alias(f"_at{i}"),
            F.max_by(F.col(m), F.when(missing_to_null(F.col(m)).isNotNull(), F.col("epoch"))).alias(f"_last{i}"))])
    starts = first.select(*run_keys, *[f"_v{i}" for i in range(len(metrics))])
    broken = hist.join(starts, list(run_keys)).groupBy(*run_keys).agg(*[
        F.count_if((F.col("epoch") > F.col(f"_v{i}")) & (missing_to_null(F.col(m)) < thr)).alias(f"_b{i}")
        for i, m in enumerate(metrics)])
    parts = ", ".join(f"'{m}', _v{i}, _at{i}, _last{i}, _b{i}" for i, m in enumerate(metrics))
    rows = first.join(broken, list(run_keys), "left").select(
        *run_keys, "n_epochs", F.expr(f"stack({len(metrics)}, {parts}) AS (metric, velocity, _at, _last, _b)"))
    sat, n_broken = F.col("velocity").isNotNull(), F.coalesce("_b", L(0))
    return rows.select(
        *run_keys, "metric", "velocity", sat.alias("saturated"),
        F.when(sat, n_broken).cast("long").alias("broken_steps"),
        F.when(sat, 1 - n_broken / F.col("n_epochs")).alias("stability"),
        F.when(sat & (F.col("_last") < F.col("_at")), 1).otherwise(0).alias("divergence"), "n_epochs")


def metric_at_saturation(hist: DataFrame, run_keys: Sequence[str], trigger: str, other: str,
                         thr: float = SATURATION_THRESHOLD) -> DataFrame:
    """Value of ``other`` at the first epoch where ``trigger`` > thr."""
    t = missing_to_null(F.col(trigger))
    return hist.groupBy(*run_keys).agg(
        F.min_by(F.col(other), F.when(t > thr, F.col("epoch"))).alias(f"{other}_at_sat"))


def top_k_epochs(hist: DataFrame, run_keys: Sequence[str], metric: str, k: int,
                 salts: int = 16) -> DataFrame:
    """The k epochs with the lowest ``metric`` per run.  Two phases: top-k
    per (run, salt) first, then per run over at most k·salts candidates."""
    order = [F.col(metric).asc_nulls_last(), F.col("epoch").asc()]
    salted = hist.withColumn("_salt", F.pmod(F.hash("epoch"), L(salts)))
    w1 = Window.partitionBy(*run_keys, "_salt").orderBy(*order)
    cand = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = Window.partitionBy(*run_keys).orderBy(*order)
    return (cand.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
            .drop("_salt", "_r"))


def early_stop_epoch(hist: DataFrame, run_keys: Sequence[str], metric: str, patience: int,
                     partitions: int | None = None) -> DataFrame:
    """First epoch reached ``patience`` epochs after the last strict
    improvement (monitor min; a tie improves nothing); null when training never
    stops early.

    A run holding a third of the rows is not one task: rows are dealt by ranges
    of (run, epoch), each range keeps its own running best, and the best of all
    earlier ranges of the run (one row per range and run) is carried in."""
    spark = hist.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # The least (value, epoch): of equal values the earliest epoch counts.
    value = F.when(F.col(metric).isNotNull(), F.struct(F.col(metric).alias("v"), F.col("epoch").alias("e")))
    ranged = cut_lineage(hist.select(*run_keys, "epoch", value.alias("_v"))
                         .repartitionByRange(n, *run_keys, "epoch").withColumn("_piece", F.spark_partition_id()))
    so_far = Window.partitionBy("_piece", *run_keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_best", F.min("_v").over(so_far))
    before = Window.partitionBy(*run_keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (ranged.groupBy("_piece", *run_keys).agg(F.min("_v").alias("_low"))
               .withColumn("_carried", F.min("_low").over(before)).drop("_low"))
    best = F.least("_best", "_carried")["e"]  # least() passes over nulls
    return (local.join(carried, ["_piece", *run_keys]).groupBy(*run_keys).agg(
        F.min(F.when(F.col("epoch") - best >= patience, F.col("epoch"))).alias("stop_epoch")))


def fold_modes(per_fold: DataFrame, group: Sequence[str], value: str, n_folds: int) -> DataFrame:
    """STRICT (mean iff all ``n_folds`` have a value), WISE (mean over
    present), NAIVE (sum / ``n_folds``); sample stdev iff all folds present.
    Rows are stacked by ``mode``."""
    agg = per_fold.groupBy(*group).agg(F.count(value).alias("c"), F.sum(value).alias("s"),
                                       F.stddev_samp(value).alias("sd"))
    return agg.select(*group, F.expr(
        f"stack(3, 'STRICT', CASE WHEN c = {n_folds} THEN s / c END, "
        "'WISE', CASE WHEN c > 0 THEN s / c END, "
        f"'NAIVE', CASE WHEN c > 0 THEN s / {n_folds} END) AS (mode, value)"),
        F.when(F.col("c") == n_folds, F.col("sd")).alias("stdev"))


def fold_sums(per_fold: DataFrame, group: Sequence[str], values: Sequence[str], n_folds: int) -> DataFrame:
    """Sums of several columns by mode: STRICT needs a value in all
    ``n_folds``, the other modes any."""
    agg = per_fold.groupBy(*group).agg(*[F.sum(v).alias(v) for v in values],
                                       *[F.count(v).alias(f"_n_{v}") for v in values])
    modes = agg.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in ("STRICT", "WISE", "NAIVE")])))
    return modes.select(*group, "mode", *[F.when((F.col("mode") != "STRICT") | (F.col(f"_n_{v}") == n_folds), F.col(v))
                                          .cast("long").alias(v) for v in values])


def global_score(f1: Column, r_tp: Column, r_cs: Column, r_svt: Column) -> Column:
    """F1 × R_TP × (R_CS/R_TP) × (R_SVT/R_TP), guarded (Q8): 0 unless R_TP > 0."""
    return F.when(r_tp > 0, f1 * r_tp * (r_cs / r_tp) * (r_svt / r_tp)).otherwise(L(0.0))

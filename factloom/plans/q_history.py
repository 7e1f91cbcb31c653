"""History analytics queries (W1–W8, A14–A18, O9, P18–P20, S12-style output).

``history`` is derived from ``events``: run = user_id, model = user_id div 5,
fold = user_id % 5, step = position of the event in its run by (ts,
event_id), epoch = step - step div 10 (every tenth step re-logs the previous
epoch, exercising W1), val_loss null for 'error' events (dropped by W1),
metrics = value/(value+20|30|40) and loss = 20/(value+20), rounded to 2 digits so
that losses tie (W8).  Some models lack a fold (A14-A18).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import history as H
from factloom.operators.ordering import row_index
from factloom.plans.catalog import query
from factloom.sources.tables import table

RUN = ("model", "fold", "run")
N_FOLDS = 5
R6 = lambda c: F.round(c, 6)


#: One model in seven lacks its last fold, as a training that was cut short does.
_FOLD_RAN = "NOT (user_id % 5 = 4 AND floor(user_id / 5) % 7 = 3)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    ev = ev.where(_FOLD_RAN)
    ev = row_index(ev, ["user_id"], ["ts", "event_id"], out="step")
    v = F.col("value")
    return ev.select(
        F.expr("user_id div 5").alias("model"), (F.col("user_id") % 5).alias("fold"),
        F.col("user_id").alias("run"), "step",
        (F.col("step") - F.expr("step div 10")).alias("epoch"),
        F.when(F.col("event_type") != "error", F.floor(2000.0 / (v + 20)) / 100 + 0.01).alias("val_loss"),
        (v / (v + 20)).alias("val_part_parsed"), (v / (v + 40)).alias("val_F1_macro"),
        (v / (v + 30)).alias("val_F1_micro"))


def clean_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.last_write_wins(history(spark, sf_dir), RUN)


HIST_CTES = """
ev AS (
  SELECT user_id // 5 AS model, user_id % 5 AS fold, user_id AS run,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
         event_type, value FROM events WHERE """ + _FOLD_RAN + """),
hist AS (
  SELECT model, fold, run, step, step - step // 10 AS epoch,
         CASE WHEN event_type <> 'error' THEN floor(2000.0 / (value + 20)) / 100 + 0.01 END AS val_loss,
         value / (value + 20) AS val_part_parsed, value / (value + 40) AS val_F1_macro,
         value / (value + 30) AS val_F1_micro FROM ev),
clean AS (
  SELECT model, fold, run, epoch, arg_max(step, step) AS step, arg_max(val_loss, step) AS val_loss,
         arg_max(val_part_parsed, step) AS val_part_parsed, arg_max(val_F1_macro, step) AS val_F1_macro,
         arg_max(val_F1_micro, step) AS val_F1_micro
  FROM hist WHERE epoch IS NOT NULL AND val_loss IS NOT NULL GROUP BY model, fold, run, epoch)"""


def _with(body: str, extra: str = "") -> str:
    return "WITH " + HIST_CTES.strip() + ("," + extra if extra else "") + "\n" + body


@query("w1_last_write_wins", _with(
    "SELECT model, fold, run, epoch, step, round(val_loss, 6) AS val_loss, "
    "round(val_part_parsed, 6) AS val_part_parsed, round(val_F1_macro, 6) AS val_F1_macro, "
    "round(val_F1_micro, 6) AS val_F1_micro FROM clean"))
def w1_last_write_wins(spark, sf_dir):
    h = clean_history(spark, sf_dir)
    return h.select(*RUN, "epoch", "step", *[R6(F.col(c)).alias(c) for c in
                                               ("val_loss", "val_part_parsed", "val_F1_macro", "val_F1_micro")])


def _sat_sql(metric: str) -> str:
    return f"""
SELECT f.model, f.fold, f.run, '{metric}' AS metric, f.velocity, (f.velocity IS NOT NULL) AS saturated,
       CASE WHEN f.velocity IS NOT NULL THEN CAST(coalesce(b.broken, 0) AS BIGINT) END AS broken_steps,
       round(CASE WHEN f.velocity IS NOT NULL THEN 1 - coalesce(b.broken, 0) / f.n_epochs END, 6) AS stability,
       CASE WHEN f.velocity IS NOT NULL AND f.last_value < f.value_at_sat THEN 1 ELSE 0 END AS divergence,
       f.n_epochs
FROM (SELECT model, fold, run, min(CASE WHEN {metric} > 0.9 THEN epoch END) AS velocity,
             count(*) AS n_epochs,
             arg_min({metric}, CASE WHEN {metric} > 0.9 THEN epoch END) AS value_at_sat,
             arg_max({metric}, CASE WHEN {metric} IS NOT NULL THEN epoch END) AS last_value
      FROM clean GROUP BY model, fold, run) f
LEFT JOIN (SELECT c.run, count(*) FILTER (WHERE c.epoch > v.velocity AND c.{metric} < 0.9) AS broken
           FROM clean c JOIN (SELECT run, min(CASE WHEN {metric} > 0.9 THEN epoch END) AS velocity
                              FROM clean GROUP BY run) v ON c.run = v.run GROUP BY c.run) b
ON f.run = b.run"""


def saturation_all(spark, sf_dir) -> DataFrame:
    return H.saturation(clean_history(spark, sf_dir), RUN).withColumn("stability", R6(F.col("stability")))


@query("w2_w5_saturation", _with("\nUNION ALL\n".join(_sat_sql(m) for m in H.METRICS)))
def w2_w5_saturation(spark, sf_dir):
    """W2 velocity, W3 saturated, W4 broken steps + stability, W5 divergence."""
    return saturation_all(spark, sf_dir)


@query("w6_f1_at_parse_saturation", _with(
    "SELECT model, fold, run, round(arg_min(val_F1_micro, CASE WHEN val_part_parsed > 0.9 THEN epoch END), 6)"
    " AS val_F1_micro_at_sat FROM clean GROUP BY model, fold, run"))
def w6_f1_at_parse_saturation(spark, sf_dir):
    h = clean_history(spark, sf_dir)
    r = H.metric_at_saturation(h, RUN, "val_part_parsed", "val_F1_micro")
    return r.select(*RUN, R6(F.col("val_F1_micro_at_sat")).alias("val_F1_micro_at_sat"))


@query("w7_top3_epochs_by_loss", _with(
    "SELECT model, fold, run, epoch, rank FROM (SELECT model, fold, run, epoch, "
    "row_number() OVER (PARTITION BY model, fold, run ORDER BY val_loss ASC NULLS LAST, epoch) AS rank "
    "FROM clean) WHERE rank <= 3"))
def w7_top3_epochs_by_loss(spark, sf_dir):
    h = clean_history(spark, sf_dir)
    return H.top_k_epochs(h, RUN, "val_loss", 3).select(*RUN, "epoch", F.col("rank").cast("long").alias("rank"))


@query("w8_early_stop_epoch", _with(
    "SELECT model, fold, run, min(CASE WHEN epoch - best_epoch >= 5 THEN epoch END) AS stop_epoch "
    "FROM (SELECT *, max(CASE WHEN best IS NULL OR val_loss < best THEN epoch END) OVER (PARTITION BY run "
    "ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_epoch FROM (SELECT *, min(val_loss) OVER "
    "(PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM clean)) "
    "GROUP BY model, fold, run"))
def w8_early_stop_epoch(spark, sf_dir):
    return H.early_stop_epoch(clean_history(spark, sf_dir), RUN, "val_loss", 5)


@query("a14_a16_fold_modes", _with(
    "SELECT model, metric, m.mode, round(CASE m.mode WHEN 'STRICT' THEN (CASE WHEN c = 5 THEN s / c END) "
    "WHEN 'WISE' THEN (CASE WHEN c > 0 THEN s / c END) ELSE (CASE WHEN c > 0 THEN s / 5 END) END, 6) AS value, "
    "round(CASE WHEN c = 5 THEN sd END, 6) AS stdev FROM (SELECT model, metric, count(velocity) AS c, "
    "sum(velocity) AS s, stddev_samp(velocity) AS sd FROM sat GROUP BY model, metric) a "
    "CROSS JOIN (VALUES ('STRICT'), ('WISE'), ('NAIVE')) m(mode)",
    " sat AS (" + "\nUNION ALL\n".join(_sat_sql(m) for m in H.METRICS) + ")"))
def a14_a16_fold_modes(spark, sf_dir):
    """A14 fold modes and A16 sample stdev of the velocity, per model and metric."""
    sat = saturation_all(spark, sf_dir)
    r = H.fold_modes(sat, ("model", "metric"), "velocity", N_FOLDS)
    return r.select("model", "metric", "mode", R6(F.col("value")).alias("value"),
                    R6(F.col("stdev")).alias("stdev"))


@query("a15_fold_saturation_sums", _with(
    "SELECT model, metric, mode, CAST(CASE WHEN mode <> 'STRICT' OR n = 5 THEN s END AS BIGINT) AS n_saturated, "
    "CAST(CASE WHEN mode <> 'STRICT' OR nb = 5 THEN b END AS BIGINT) AS broken_total FROM (SELECT model, metric, "
    "count(*) AS n, sum(CAST(saturated AS INTEGER)) AS s, count(broken_steps) AS nb, sum(broken_steps) AS b "
    "FROM sat GROUP BY model, metric) CROSS JOIN (VALUES ('STRICT'), ('WISE'), ('NAIVE')) m(mode)",
    " sat AS (" + "\nUNION ALL\n".join(_sat_sql(m) for m in H.METRICS) + ")"))
def a15_fold_saturation_sums(spark, sf_dir):
    """Saturated folds and broken steps summed over folds; STRICT when all
    5 folds have a value, WISE and NAIVE over those that have one."""
    sat = saturation_all(spark, sf_dir).withColumns(
        {"n_saturated": F.col("saturated").cast("int"), "broken_total": F.col("broken_steps")})
    return H.fold_sums(sat, ("model", "metric"), ("n_saturated", "broken_total"), N_FOLDS)


def run_summary(spark, sf_dir) -> DataFrame:
    """Per-run summary (S7 shape) derived from the history: last values as
    test metrics, runtime from summed event values (P19: seconds → minutes)."""
    h = clean_history(spark, sf_dir)
    last = lambda c: F.max_by(F.col(c), F.col("epoch"))
    return h.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("nb_epoch"),
        last("val_F1_macro").alias("test_F1_macro"), last("val_F1_micro").alias("test_F1_micro"),
        last("val_part_parsed").alias("test_part_parsed"),
        F.avg("val_part_parsed").alias("test_part_subj_ok"),
        F.max("val_part_parsed").alias("test_part_valid"),
        (F.sum(F.lit(20.0) / F.col("val_loss") - 20) / 60).alias("time"))


#: A17's factors, in the order of the product.
_FACTORS = ("test_F1_macro", "test_part_parsed", "test_part_subj_ok", "test_part_valid")


def _mode_sql(c: str) -> str:
    """Mean of a column over the folds, by mode."""
    return (f"CASE mode WHEN 'STRICT' THEN CASE WHEN count({c}) = 5 THEN sum({c}) / 5 END WHEN 'NAIVE' THEN "
            f"CASE WHEN count({c}) > 0 THEN sum({c}) / 5 END ELSE avg({c}) END")


RUNSUM_CTE = f""" rs AS (SELECT model, fold, run, count(*) AS nb_epoch,
  arg_max(val_F1_macro, epoch) AS test_F1_macro, arg_max(val_F1_micro, epoch) AS test_F1_micro,
  arg_max(val_part_parsed, epoch) AS test_part_parsed, avg(val_part_parsed) AS test_part_subj_ok,
  max(val_part_parsed) AS test_part_valid, sum(20.0 / val_loss - 20) / 60 AS time
  FROM clean GROUP BY model, fold, run),
 best AS (SELECT model, coalesce(arg_max('ckpt/' || CAST(run AS VARCHAR) || '/best', struct_pack(g := g, f := -fold))
     FILTER (WHERE g > 0), arg_min('ckpt/' || CAST(run AS VARCHAR) || '/last', fold)) AS best_model_path
  FROM (SELECT *, {" * ".join(_FACTORS)} AS g FROM rs) GROUP BY model),
 means AS (SELECT model, mode, {_mode_sql("test_F1_macro")} AS f1, {_mode_sql("test_part_parsed")} AS r_tp,
  {_mode_sql("test_part_subj_ok")} AS r_cs, {_mode_sql("test_part_valid")} AS r_svt,
  {_mode_sql("nb_epoch")} AS epochs, {_mode_sql("time")} AS tt
  FROM rs CROSS JOIN (VALUES ('STRICT'), ('WISE'), ('NAIVE')) m(mode) GROUP BY model, mode)"""


@query("a17_a18_global_score_ranking", _with(
    "SELECT model, mode, round(f1, 6) AS f1_macro, round(r_tp, 6) AS r_tp, round(r_cs, 6) AS r_cs, "
    "round(r_svt, 6) AS r_svt, round(epochs, 6) AS epochs, round(tt, 6) AS train_minutes, "
    "round(CASE WHEN r_tp > 0 THEN f1 * r_tp * (r_cs / r_tp) * (r_svt / r_tp) ELSE 0.0 END, 6) AS global_score, "
    "best_model_path FROM means JOIN best USING (model)", RUNSUM_CTE))
def a17_a18_global_score_ranking(spark, sf_dir):
    """A17 composite score from the fold means of every mode; A18 checkpoint of
    the first fold with the highest product of the four metrics above 0, else
    the first fold's last one; O9 ranking by global score (the result is
    ordered; the check ignores order)."""
    rs = run_summary(spark, sf_dir)
    c = F.col
    columns = dict(zip(("f1", "r_tp", "r_cs", "r_svt", "epochs", "tt"), (*_FACTORS, "nb_epoch", "time")))
    product = c(_FACTORS[0]) * c(_FACTORS[1]) * c(_FACTORS[2]) * c(_FACTORS[3])

    def path(kind: str):
        return F.concat(F.lit("ckpt/"), c("run").cast("string"), F.lit(f"/{kind}"))

    agg = rs.groupBy("model").agg(
        *[x for name, col in columns.items() for x in (F.sum(col).alias(f"s_{name}"), F.count(col).alias(f"c_{name}"))],
        F.coalesce(F.max_by(path("best"), F.when(product > 0, F.struct(product, -c("fold")))),
                   F.min_by(path("last"), c("fold"))).alias("best_model_path"))
    modes = agg.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in ("STRICT", "WISE", "NAIVE")])))

    def mean(name: str):
        s, n = c(f"s_{name}"), c(f"c_{name}")
        return (F.when(c("mode") == "STRICT", F.when(n == N_FOLDS, s / N_FOLDS))
                .when(c("mode") == "NAIVE", F.when(n > 0, s / N_FOLDS)).otherwise(F.when(n > 0, s / n)))

    means = modes.select("model", "mode", "best_model_path", *[mean(name).alias(name) for name in columns])
    g = H.global_score(c("f1"), c("r_tp"), c("r_cs"), c("r_svt"))
    return means.select(
        "model", "mode", R6(c("f1")).alias("f1_macro"), R6(c("r_tp")).alias("r_tp"),
        R6(c("r_cs")).alias("r_cs"), R6(c("r_svt")).alias("r_svt"), R6(c("epochs")).alias("epochs"),
        R6(c("tt")).alias("train_minutes"), R6(g).alias("global_score"), "best_model_path"
    ).orderBy(F.col("global_score").desc(), "model", "mode")

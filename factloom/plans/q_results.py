"""Run results and aligned files: nested report sink and source (S13, S7), merge of
server and run values (J13), line-aligned scoring input (S8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.catalog import query
from factloom.plans.oracle import with_facts
from factloom.sources import files as FS
from factloom.sources import runs
from factloom.sources.derived import entity_pairs
from factloom.sources.tables import table

_METRICS, _OF_RUN = ["test_F1_macro", "test_part_parsed"], ["nb_epoch", "time"]


def fold_results(spark, sf_dir) -> DataFrame:
    """Folds of the events' runs as both sides saw them: the server lacks some folds
    and metrics, the tracker some runs."""
    ev = table(spark, sf_dir, "events", "user_id", "value").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    model, fold = F.expr("user_id div 5"), F.col("user_id") % 5
    f1, parsed = F.round(F.col("v") / (F.col("v") + 30), 6), F.round(F.col("v") / (F.col("v") + 20), 6)

    def values(**named):
        return F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*[c.cast("double") for c in named.values()]))

    saved = values(test_F1_macro=F.when((model + fold) % 3 != 0, F.round(f1 * 0.9, 6)), test_part_parsed=parsed)
    seen = values(test_F1_macro=f1, nb_epoch=F.col("n"), time=F.round(F.col("n") / 60, 6))
    return ev.select(
        F.concat(F.lit("p"), (model % 3).cast("string")).alias("project"), F.concat(F.lit("m"), model.cast("string")).alias("model"),
        fold.cast("string").alias("fold"), F.round(F.col("n") * 0.001, 6).alias("carbon"),
        F.concat(F.lit("ckpt/"), F.col("user_id").cast("string")).alias("best_model_path"),
        F.when((model * 7 + fold) % 4 != 1, saved).alias("test"), F.when((model + 2 * fold) % 5 != 2, seen).alias("run"))


_CTES = """WITH e AS (SELECT user_id // 5 AS m, user_id % 5 AS f, user_id, count(*) AS n, max(value) AS v FROM events GROUP BY user_id),
x AS (SELECT *, (m * 7 + f) % 4 <> 1 AS srv, (m + 2 * f) % 5 <> 2 AS trk, round(v / (v + 30), 6) AS f1 FROM e),
folds AS (SELECT 'p' || (m % 3) AS project, 'm' || m AS model, 'fold' || f AS fold, srv AS on_server,
  CASE WHEN srv THEN round(CAST(n AS DOUBLE) * 0.001, 6) END AS carbon, CASE WHEN srv THEN 'ckpt/' || user_id END AS best_model_path,
  coalesce(CASE WHEN srv AND (m + f) % 3 <> 0 THEN round(f1 * 0.9, 6) END, CASE WHEN trk THEN f1 END) AS test_F1_macro,
  CASE WHEN srv THEN round(v / (v + 20), 6) END AS test_part_parsed,
  CASE WHEN trk THEN CAST(n AS DOUBLE) END AS nb_epoch, CASE WHEN trk THEN round(n / 60.0, 6) END AS time
  FROM x WHERE srv OR trk)"""


def _merged(spark, sf_dir) -> DataFrame:
    path = FS.scratch(spark, "reports")
    runs.write_reports(fold_results(spark, sf_dir), path)
    return runs.merged_folds(runs.read_reports(spark, path), _METRICS, _OF_RUN)


@query("s7_j13_run_results", _CTES + " SELECT * FROM folds")
def s7_j13_run_results(spark, sf_dir):
    """Nested reports written, read back, server and run values merged."""
    return _merged(spark, sf_dir)


@query("s7_best_model", _CTES + """, s AS (SELECT *, test_F1_macro * test_part_parsed AS score FROM folds WHERE on_server)
SELECT project, model, fold, best_model_path, round(score, 6) AS score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY project, model ORDER BY score DESC, fold) = 1""")
def s7_best_model(spark, sf_dir):
    """The path of every model's best fold by the product of its test metrics."""
    return runs.best_models(_merged(spark, sf_dir), _METRICS).withColumn("score", F.round("score", 6))


def _label(facts: str):
    return F.get(F.filter(facts, lambda f: f["p"] == "label"), F.lit(0))["o"]


@query("s8_aligned_files", with_facts(
    "SELECT row_number() OVER (ORDER BY g.ex_id) - 1 AS line, coalesce(g.o, '') AS gold, coalesce(p.o, '') AS pred, "
    "coalesce(g.o, '') = coalesce(p.o, '') AS same FROM (SELECT ent.ex_id, o FROM ent LEFT JOIN facts "
    "ON ent.ex_id = facts.ex_id AND p = 'label') g LEFT JOIN pfacts p ON g.ex_id = p.ex_id AND p.p = 'label'"))
def s8_aligned_files(spark, sf_dir):
    """Gold and predicted labels, one a line in files of different parts, read
    back by line number."""
    rows = entity_pairs(spark, sf_dir).select("ex_id", F.coalesce(_label("gold_facts"), F.lit("")).alias("gold"),
                                              F.coalesce(_label("pred_facts"), F.lit("")).alias("pred"))
    paths = {}
    for name, parts in (("gold", 3), ("pred", 5)):
        paths[name] = FS.scratch(spark, name)
        rows.repartitionByRange(parts, "ex_id").sortWithinPartitions("ex_id").select(F.col(name).alias("value")).write.text(paths[name])
    both = runs.aligned_lines(spark, paths["gold"], paths["pred"])
    return both.withColumn("same", F.col("gold") == F.col("pred"))

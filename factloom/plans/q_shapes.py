"""Shape extraction (S6), head changes on long triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import shapes
from factloom.plans.catalog import query
from factloom.plans.oracle import with_facts
from factloom.plans.q_relations import _PLAIN, _REL_CTE, _text_sql, relations
from factloom.sources.derived import entity_facts, long_triples

# One shape graph per entity: its properties, the dated ones as branches of a choice.
_DATED = ("firstOrderDate", "firstOrderYear", "lastOrderYear")


def entity_shapes(spark, sf_dir) -> DataFrame:
    """Shape rows of every entity: a property for each of its relations."""
    t = long_triples(entity_facts(spark, sf_dir)).where("p NOT IN ('type', 'label')").groupBy("ex_id", "p").agg(
        F.max("dt").alias("datatype"), F.count(F.lit(1)).cast("int").alias("max_count"))
    branch = F.when(F.col("p").isin(*_DATED), F.row_number().over(Window.partitionBy("ex_id", F.col("p").isin(*_DATED)).orderBy("p")))
    return t.select(F.col("ex_id").alias("g"), F.lit("dbo:Customer").alias("target_class"),
                    F.concat(F.lit("dbo:"), "p").alias("path"), "datatype", F.lit(1).alias("min_count"), "max_count",
                    F.when(F.col("datatype") == "xsd:string", "sh:Literal").alias("node_kind"),
                    F.when(branch.isNotNull(), F.lit(1)).alias("or_group"), branch.alias("or_branch"))


@query("s6_shape_extraction", with_facts("""
SELECT g, target_class, path, datatype, min_count, max_count, node_kind, or_group,
  CASE WHEN or_group = 1 THEN CAST(row_number() OVER (PARTITION BY g, or_group ORDER BY path) AS INTEGER) END AS or_branch
FROM (SELECT ex_id AS g, 'dbo:Customer' AS target_class, 'dbo:' || p AS path, max(dt) AS datatype, 1 AS min_count,
  CAST(count(*) AS INTEGER) AS max_count, CASE WHEN max(dt) = 'xsd:string' THEN 'sh:Literal' END AS node_kind,
  CASE WHEN p IN ('firstOrderDate', 'firstOrderYear', 'lastOrderYear') THEN 1 END AS or_group
  FROM facts WHERE p NOT IN ('type', 'label') GROUP BY ex_id, p)"""))
def s6_shape_extraction(spark, sf_dir):
    """Class, paths, constraints and choices read from the shape triples of
    every entity's graph."""
    return shapes.extract(shapes.triples_of(entity_shapes(spark, sf_dir)))


@query("w10_head_changes", with_facts(
    f"SELECT ex_id, {_text_sql(_PLAIN, _PLAIN)} AS plain, count(*) FILTER (WHERE before IS DISTINCT FROM head) AS n_runs "
    "FROM lagged GROUP BY ex_id", _REL_CTE))
def w10_head_changes(spark, sf_dir):
    """Relation marker text from the long table.  A row whose head differs from
    the one before opens a run; runs are islands by a running count, each written
    with its head once.  Groups are the relations of one example."""
    rows = relations(spark, sf_dir).select("ex_id", F.posexplode("rels").alias("pos", "r")).select("ex_id", "pos", "r.*")
    order = Window.partitionBy("ex_id").orderBy("pos")
    opens = ~F.lag("head").over(order).eqNullSafe(F.col("head"))
    islands = rows.withColumn("opens", opens).withColumn("run", F.sum(F.col("opens").cast("int")).over(order))
    tails = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tail", "type"))), lambda x: F.concat(
        F.lit("<subj> "), x["tail"], F.lit(" <obj> "), x["type"]))
    runs = islands.groupBy("ex_id", "run").agg(F.concat(F.lit("<triplet> "), F.first("head"), F.lit(" "), F.array_join(tails, " "))
                                               .alias("text"))
    return runs.groupBy("ex_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), " ").alias("plain"),
        F.count(F.lit(1)).alias("n_runs"))

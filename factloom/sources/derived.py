"""Inputs of the triple world, derived from the driver tables with plans that
DuckDB can reproduce row for row (see ``factloom.plans.oracle``).

* ``entity_facts``: one row per customer entity with its ordered facts
  ``array<struct<s,p,o,dt>>`` (type first, label second, then by predicate and
  value).  Built from ``customer ⋈ nation ⋈ agg(orders)``; the orders side is
  pre-aggregated (map-side partial aggregation) before the shuffle, so a hot
  customer costs one partial row per map task.
* ``predicted_facts``: the same facts with rule-made damage on the key.
* ``SHAPE``: the constraint table (a small configuration, like a shape file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.tables import table

FACT = T.StructType([
    T.StructField("s", T.StringType()),
    T.StructField("p", T.StringType()),
    T.StructField("o", T.StringType()),
    T.StructField("dt", T.StringType()),
])
FACTS = T.ArrayType(FACT)

ENTITY_TYPE = "Customer"
ENTITY_PREFIX = "Customer_"

# Constraint table for customer entities (configuration; fixed values).
# path, datatype, min_count, max_count, node_kind, or_group, or_branch
SHAPE = [
    ("rdfs:label", "xsd:string", 1, None, None, None, None),
    ("dbo:segment", "xsd:string", 1, 1, None, None, None),
    ("dbo:nation", "xsd:string", 0, 1, "Literal", None, None),
    ("dbo:priority", "xsd:string", 0, 10, "Literal", None, None),
    ("dbo:firstOrderDate", "xsd:date", 1, 1, None, 1, 1),
    ("dbo:firstOrderYear", "xsd:gYear", 1, 1, None, 1, 2),
    ("dbo:lastOrderYear", "xsd:gYear", 0, 1, None, None, None),
]
SHAPE_TARGET_CLASS = "dbo:" + ENTITY_TYPE
SHAPE_SCHEMA = ("path string, datatype string, min_count int, max_count int, "
                "node_kind string, or_group int, or_branch int")


def local_name(path: str) -> str:
    return path.split("#")[-1].split("/")[-1].split(":")[-1]


RELATIONS = [local_name(p) for p, *_ in SHAPE]
RELATION_DATATYPE = {local_name(p): dt for p, dt, *_ in SHAPE}


def shape_df(spark: SparkSession) -> DataFrame:
    return (spark.createDataFrame(SHAPE, SHAPE_SCHEMA)
            .withColumn("relation", F.regexp_extract("path", r"([^:#/]+)$", 1))
            .withColumn("target_class", F.lit(SHAPE_TARGET_CLASS)))


def fact(s: Column, p: str | Column, o: Column, dt: str | None) -> Column:
    p_col = F.lit(p) if isinstance(p, str) else p
    return F.struct(s.alias("s"), p_col.alias("p"), o.alias("o"),
                    F.lit(dt).cast("string").alias("dt"))


def clean_value(c: Column) -> Column:
    """Double quotes become spaces, then trim; '' becomes null."""
    v = F.trim(F.translate(c, '"', " "))
    return F.when(v != "", v)


def canonical_order(facts: Column) -> Column:
    """Type first, label second, then by predicate and value."""
    ranked = F.transform(facts, lambda f: F.struct(
        F.when(f["p"] == "type", 0).when(f["p"] == "label", 1).otherwise(2).alias("r"),
        f["p"].alias("p"), f["o"].alias("o"), f["s"].alias("s"), f["dt"].alias("dt")))
    return F.transform(F.sort_array(ranked), lambda x: F.struct(
        x["s"].alias("s"), x["p"].alias("p"), x["o"].alias("o"), x["dt"].alias("dt")))


def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderpriority")
    return (o.groupBy("o_custkey")
            .agg(F.min("o_orderdate").alias("first_order"),
                 F.max("o_orderdate").alias("last_order"),
                 # bounded: at most the number of distinct priorities
                 F.sort_array(F.collect_set("o_orderpriority")).alias("priorities")))


#: Entities of a task of per-row work, at most about: a task's time and memory are
#: the same from the first hundred thousand entities on.
ROWS_PER_TASK = 10_000


def work_partitions(rows: DataFrame, each: int | None = None) -> int:
    """Partitions for CPU-heavy per-row work (serialise / decode / score): enough
    that none has over about ``each`` (``ROWS_PER_TASK``) rows, whatever the table holds, and
    no fewer than the cluster's cores, so that a small dimension read as one file
    is not one task.  The count is read from the files' footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (each or ROWS_PER_TASK)))


def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    # nation is a fixed 25-row dimension: broadcast is size-bounded by design.
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
            .join(order_summary(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(F.col("c_custkey").alias("ex_id"),
                    F.concat(F.lit(ENTITY_PREFIX), F.col("c_custkey").cast("string")).alias("ent"),
                    "c_name", "c_mktsegment", "n_name", "first_order", "last_order",
                    "priorities")
            .repartition(work_partitions(c), "ex_id"))


def facts_of(rows: DataFrame) -> DataFrame:
    s = F.col("ent")
    first_y = F.year("first_order").cast("string")
    last_y = F.year("last_order").cast("string")
    singles = F.array(
        fact(s, "type", F.lit(ENTITY_TYPE), None),
        fact(s, "label", clean_value(F.col("c_name")), "xsd:string"),
        fact(s, "segment", clean_value(F.col("c_mktsegment")), "xsd:string"),
        fact(s, "nation", clean_value(F.col("n_name")), "xsd:string"),
        fact(s, "firstOrderDate", F.date_format("first_order", "yyyy-MM-dd"), "xsd:date"),
        fact(s, "firstOrderYear", first_y, "xsd:gYear"),
        fact(s, "lastOrderYear", F.when(last_y != first_y, last_y), "xsd:gYear"),
    )
    multi = F.transform(F.coalesce(F.col("priorities"), F.array().cast("array<string>")),
                        lambda v: fact(s, "priority", clean_value(v), "xsd:string"))
    facts = F.filter(F.concat(singles, multi), lambda f: f["o"].isNotNull())
    return rows.select("ex_id", "ent", canonical_order(facts).alias("facts"))


def entity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ex_id, ent, facts) — one row per customer entity."""
    return facts_of(entity_rows(spark, sf_dir))


def damage(facts: Column, key: Column) -> Column:
    """Prediction damage on the key: %17 wrong subject, %7 wrong label value,
    %11 segment dropped, %5 one extra priority value."""
    s_new = F.when(key % 17 == 0, F.concat(F.lit(ENTITY_PREFIX), (key + 1).cast("string")))
    moved = F.transform(facts, lambda f: F.struct(
        F.coalesce(s_new, f["s"]).alias("s"), f["p"].alias("p"),
        F.when((key % 7 == 0) & (f["p"] == "label"), F.concat(f["o"], F.lit("-bis")))
         .otherwise(f["o"]).alias("o"),
        f["dt"].alias("dt")))
    kept = F.filter(moved, lambda f: ~((key % 11 == 0) & (f["p"] == "segment")))
    extra = F.when(key % 5 == 0, F.array(F.struct(
        F.element_at(kept, 1)["s"].alias("s"), F.lit("priority").alias("p"),
        F.lit("UNKNOWN").alias("o"), F.lit("xsd:string").alias("dt")))
    ).otherwise(F.array().cast(FACTS))
    return canonical_order(F.concat(kept, extra))


def unparseable(key: Column) -> Column:
    return key % 13 == 0


def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ex_id, ent, gold_facts, pred_facts, broken)."""
    ef = entity_facts(spark, sf_dir)
    return ef.select("ex_id", "ent", F.col("facts").alias("gold_facts"),
                     damage(F.col("facts"), F.col("ex_id")).alias("pred_facts"),
                     unparseable(F.col("ex_id")).alias("broken"))


def long_triples(df: DataFrame, facts_col: str = "facts", keys=("ex_id",)) -> DataFrame:
    """Array-of-facts → long triple table (ex_id, pos, s, p, o, dt); no shuffle.
    The outer generator + later filter keeps the optimizer from inferring a
    size(facts) > 0 filter that would re-evaluate the facts expression."""
    return (df.select(*keys, F.posexplode_outer(facts_col).alias("pos", "f"))
            .where(F.col("pos").isNotNull())
            .select(*keys, "pos", "f.s", "f.p", "f.o", "f.dt"))

"""Connected components of links between ids, as rounds of small joins.

Every round each component takes the smallest label among its neighbours as its
parent (a grouped minimum, so a component of many links costs one partial
minimum a task), parents of parents are followed until they are roots, and links
inside a component are left out.  Labels are written to the shared folder each
round.  Labels are the smallest id of their component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import staged


def _roots(parents: DataFrame) -> DataFrame:
    """``label``, ``root``: parents followed to the end."""
    while True:
        up = parents.select(F.col("label").alias("root"), F.col("root").alias("next"))
        jumped = staged(parents.join(up, "root", "left").select(
            "label", F.coalesce("next", "root").alias("root"),
            F.coalesce(F.col("next") != F.col("root"), F.lit(False)).alias("moved")), "roots")
        if jumped.filter("moved").isEmpty():
            return jumped.select("label", "root")
        parents = jumped.select("label", "root")


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, label) after the links (a, b) between ids joined them."""
    while True:
        ends = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
        others = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        across = staged(links.join(ends, "a").join(others, "b").filter("la <> lb").select("la", "lb").distinct(), "across")
        if across.isEmpty():
            return labels
        both = across.unionByName(across.select(F.col("lb").alias("la"), F.col("la").alias("lb")))
        parents = both.groupBy(F.col("la").alias("label")).agg(F.min("lb").alias("low")).filter(
            "low < label").select("label", F.col("low").alias("root"))
        roots = _roots(staged(parents, "parents"))
        labels = staged(labels.join(roots, "label", "left").select(
            "id", F.coalesce("root", "label").alias("label")), "labels")

"""Focus properties of entities.

Entities come long, (ent, prop, pos, value).  Kept are those that have a usable
abstract and at least one focus property under its own name; of each focus property
the first value stays, under its plain name: an ontology property written with
``#`` is the same property without it, and stands in where the own name is absent.
The focus list is a configuration of a few rows and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.vocab import ONTOLOGY_NS

L = F.lit


def plain_name(prop: Column) -> Column:
    """P10: the ontology name without ``#``."""
    return F.replace(prop, L(ONTOLOGY_NS + "#"), L(ONTOLOGY_NS))


def usable(abstract: Column) -> Column:
    """Over five characters and without template braces; a null is not."""
    braces = F.contains(abstract, L("{{")) | F.contains(abstract, L("}}"))
    return F.coalesce((F.char_length(abstract) > 5) & ~braces, L(False))


def focused(values: DataFrame, focus: list[str], abstracts: DataFrame) -> DataFrame:
    """(ent, prop, value) of the entities in focus; ``abstracts``: (ent, abstract).

    Of repeated rows of one place the smallest value stays.  A null entity meets no
    abstract and goes."""
    spark = values.sparkSession
    names = spark.createDataFrame([(p,) for p in dict.fromkeys(focus)], "prop string").select("prop", plain_name(F.col("prop")).alias("plain"))
    names = names.select("plain", F.explode(F.array_distinct(F.array(
        F.struct(L(0).alias("rank"), F.col("prop").alias("name")), F.struct(
            F.when(F.col("prop") == F.col("plain"), 0).otherwise(1).alias("rank"), F.col("plain").alias("name"))))).alias("x")).select(
        "plain", "x.rank", F.col("x.name").alias("prop"))
    described = abstracts.where(usable(F.col("abstract"))).select("ent")
    met = values.join(F.broadcast(names), "prop").join(described, "ent", "left_semi")  # J2
    best = met.groupBy("ent", "plain").agg(F.min(F.struct("rank", "pos", "value")).alias("first"))
    own = best.where("first.rank = 0").select("ent").distinct()
    return best.join(own, "ent", "left_semi").select("ent", F.col("plain").alias("prop"), F.col("first.value").alias("value"))  # P9

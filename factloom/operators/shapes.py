"""A shape table from shape triples.

Triples are rows (g, s, p, o): of graph ``g``, with blank nodes named inside their
graph.  Properties hang off the shape itself or off the members of an ``sh:or``
list.  Nodes are read by joins on (g, s); a property's constraints are pivoted by a
grouped maximum; lists are walked by one join a place for all lists together, until
no list goes on.  Every step's frontier is checkpointed, so a lost executor repeats
one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage

#: Constraints of a property, by their names in the triples.
CONSTRAINTS = {"path": ("sh:path", "string"), "datatype": ("sh:datatype", "string"), "min_count": ("sh:minCount", "int"),
               "max_count": ("sh:maxCount", "int"), "node_kind": ("sh:nodeKind", "string")}


def _of(triples: DataFrame, predicate: str, subject: str, value: str) -> DataFrame:
    return triples.filter(F.col("p") == predicate).select("g", F.col("s").alias(subject), F.col("o").alias(value))


def list_members(triples: DataFrame, heads: DataFrame) -> DataFrame:
    """``heads`` (g, list) to (g, list, place from 1, item).  A list that turns back
    on itself is an error of the input."""
    first, rest = _of(triples, "rdf:first", "node", "item"), _of(triples, "rdf:rest", "node", "next")
    nodes = triples.filter("p = 'rdf:rest'").count()
    at, place = heads.select("g", "list", F.col("list").alias("node")).filter("node <> 'rdf:nil'"), 1
    found = None
    while True:
        here = cut_lineage(at.join(first, ["g", "node"], "left").join(rest, ["g", "node"], "left")
                           .select("g", "list", F.lit(place).alias("place"), "item", "next"))
        if here.isEmpty():
            break
        if place > nodes + 1:
            raise ValueError("a list of the shape turns back on itself")
        part = here.filter("item IS NOT NULL").select("g", "list", "place", "item")
        found = part if found is None else found.unionByName(part)
        at = here.filter("next IS NOT NULL AND next <> 'rdf:nil'").select("g", "list", F.col("next").alias("node"))
        place += 1
    return found if found is not None else heads.select("g", "list", F.lit(1).alias("place"), F.lit("").alias("item")).limit(0)


def extract(triples: DataFrame) -> DataFrame:
    """(g, target_class, path, datatype, min_count, max_count, node_kind, or_group,
    or_branch) of every property of every shape; groups are numbered within a
    graph, branches by their place in the list."""
    known = {name: F.max(F.when(F.col("p") == p, F.col("o"))).cast(kind).alias(name) for name, (p, kind) in CONSTRAINTS.items()}
    predicates = [p for p, _ in CONSTRAINTS.values()]
    constraints = triples.filter(F.col("p").isin(predicates)).groupBy("g", F.col("s").alias("prop")).agg(*known.values())
    targets = _of(triples, "sh:targetClass", "shape", "target_class")
    none = F.lit(None).cast("int")
    owned = _of(triples, "sh:property", "owner", "prop")
    direct = targets.join(owned.withColumnRenamed("owner", "shape"), ["g", "shape"]).select(
        "g", "target_class", "prop", none.alias("or_group"), none.alias("or_branch"))
    # A shape's choices are few and stand in its own graph.
    choices = targets.join(_of(triples, "sh:or", "shape", "list"), ["g", "shape"])
    numbered = choices.groupBy("g").agg(F.array_sort(F.collect_set("list")).alias("lists")).select(
        "g", F.posexplode("lists").alias("i", "list"))
    members = list_members(triples, choices.select("g", "list").distinct())
    branches = (choices.join(numbered, ["g", "list"]).join(members, ["g", "list"])
                .join(owned.withColumnRenamed("owner", "item"), ["g", "item"])
                .select("g", "target_class", "prop", (F.col("i") + 1).alias("or_group"), F.col("place").alias("or_branch")))
    return direct.unionByName(branches).join(constraints, ["g", "prop"]).select(
        "g", "target_class", *CONSTRAINTS, "or_group", "or_branch").distinct()


def triples_of(shape: DataFrame) -> DataFrame:
    """Shape rows (the columns of ``extract``) as triples, each a property of its own:
    the stand-in for a parsed shape file.  Members of a choice stand in list order."""
    name = F.concat(F.lit("_:p"), F.xxhash64("path", "or_group", "or_branch").cast("string"))
    rows = shape.withColumn("prop", name).withColumn("list", F.concat(F.lit("_:l"), F.col("or_group").cast("string")))
    node = F.concat("list", F.lit("_"), F.col("or_branch").cast("string"))
    following = F.concat("list", F.lit("_"), (F.col("or_branch") + 1).cast("string"))
    head = F.concat("list", F.lit("_1"))
    inside = F.col("or_group").isNotNull()
    branch = F.concat(F.lit("_:b"), "prop")
    last = F.max("or_branch").alias("last")
    ends = shape.filter("or_group IS NOT NULL").groupBy("g", "or_group").agg(last)
    rows = rows.join(ends, ["g", "or_group"], "left")

    def triple(s, p: str, o, when=F.lit(True)):
        return F.when(when, F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o")))

    own = F.lit("_:shape")
    triples = F.array(
        triple(own, "sh:targetClass", F.col("target_class")), triple(own, "sh:property", F.col("prop"), ~inside),
        triple(own, "sh:or", head, inside), triple(node, "rdf:first", branch, inside),
        triple(node, "rdf:rest", F.when(F.col("or_branch") < F.col("last"), following).otherwise(F.lit("rdf:nil")), inside),
        triple(branch, "sh:property", F.col("prop"), inside),
        *[triple(F.col("prop"), p, F.col(c), F.col(c).isNotNull()) for c, (p, _) in CONSTRAINTS.items()])
    return rows.select("g", F.explode(F.filter(triples, lambda t: t.isNotNull())).alias("t")).select("g", "t.*").distinct()

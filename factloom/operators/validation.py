"""Shape validation (V1–V4).

Two forms of the same rules (min/max count, datatype lexical form, node kind,
``or`` of two branches, target class):

* ``conforms(triples)`` — a row expression over one entity's triple array
  (used while scoring; no shuffle).
* ``shape_report(triples_long, shape)`` — the table plan: entity triples ⋈
  broadcast shape, ``groupBy(ent, path)`` counts, then per-entity
  ``bool_and`` / ``bool_or`` over or-groups.  The shape side is a
  configuration table of a few rows; its size is bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.derived import ENTITY_TYPE, SHAPE, local_name

L = F.lit
DATE_RE = r"^-?\d{4}-\d{2}-\d{2}$"
GYEAR_RE = r"^-?\d{4,}$"


def lexical_ok(value: Column, datatype: Column | str) -> Column:
    dt = L(datatype) if isinstance(datatype, str) else datatype
    return (F.when(dt == "xsd:date", value.rlike(DATE_RE) & F.try_to_date(value, "yyyy-MM-dd").isNotNull())
            .when(dt == "xsd:gYear", value.rlike(GYEAR_RE))
            .otherwise(value.isNotNull()))


#: Node kinds of a shape, with what they let pass (fixed values).
NODE_KINDS = {"IRI": ("IRI",), "Literal": ("Literal",), "BlankNode": ("BlankNode",), "BlankNodeOrIRI": ("BlankNode", "IRI"),
              "BlankNodeOrLiteral": ("BlankNode", "Literal"), "IRIOrLiteral": ("IRI", "Literal")}


def object_kind(value: Column, datatype: Column) -> Column:
    """Kind of a triple's object: what has a datatype is a literal, the rest a blank
    node by its prefix or an IRI."""
    return F.when(datatype.isNotNull(), L("Literal")).when(F.startswith(value, L("_:")), L("BlankNode")).otherwise(L("IRI"))


def kind_ok(kind: Column, wanted: Column) -> Column:
    """Whether a kind is one that a shape's node kind (with or without prefix) lets
    pass; no node kind lets all pass, an unknown one none."""
    table = F.create_map(*[x for name, kinds in NODE_KINDS.items() for x in (L(name), F.array(*map(L, kinds)))])
    passed = F.element_at(table, F.regexp_replace(wanted, "^.*[:#/]", ""))
    return wanted.isNull() | F.coalesce(F.array_contains(passed, kind), L(False))


def _rule(triples: Column, path: str, datatype: str, min_c, max_c) -> Column:
    rel = local_name(path)
    vals = F.filter(triples, lambda t: t["p"] == rel)
    n = F.size(vals)
    ok = F.forall(vals, lambda t: lexical_ok(t["o"], datatype))
    if min_c is not None:
        ok = ok & (n >= min_c)
    if max_c is not None:
        ok = ok & (n <= max_c)
    return ok


def conforms(triples: Column, target_type: str = ENTITY_TYPE) -> Column:
    """V1 as a row expression over ``array<struct<s,p,o>>`` (local names)."""
    plain = [_rule(triples, p, dt, mn, mx) for p, dt, mn, mx, _k, grp, _b in SHAPE if grp is None]
    groups: dict[int, list[Column]] = {}
    for p, dt, mn, mx, _k, grp, _b in SHAPE:
        if grp is not None:
            groups.setdefault(grp, []).append(_rule(triples, p, dt, mn, mx))
    ok = F.exists(triples, lambda t: (t["p"] == "type") & (t["o"] == target_type))
    for c in plain:
        ok = ok & c
    for branches in groups.values():
        any_b = branches[0]
        for b in branches[1:]:
            any_b = any_b | b
        ok = ok & any_b
    return ok


def shape_report(triples: DataFrame, shape: DataFrame, ent: str = "ex_id") -> DataFrame:
    """V2: one row per (entity, path) with its count and the failed rule, if any.

    ``triples`` is the long table (ent, p, o); ``shape`` from ``shape_df``.
    Entities come from the triple table itself (distinct), then meet every
    shape row by a broadcast equi-join on a constant-free key: the relation
    name of each triple, with entities lacking a path recovered by the
    per-entity path list — no cross product.

    Node kinds are known where the triples have a column ``dt``; then an object that
    is no literal also fails a datatype.
    """
    typed = "dt" in triples.columns
    sh = F.broadcast(shape.select("relation", "path", "datatype", "min_count", "max_count", "node_kind",
                                  "or_group", "or_branch"))
    bad = ~lexical_ok(F.col("o"), F.col("datatype"))
    kind = object_kind(F.col("o"), F.col("dt")) if typed else L("Literal")
    if typed:
        bad = bad | (F.col("datatype").isNotNull() & (kind != "Literal"))
    off_kind = ~kind_ok(kind, F.col("node_kind")) if typed else L(False)
    per_path = (triples.join(sh, triples.p == sh.relation, "inner")
                .groupBy(ent, "path", "datatype", "min_count", "max_count", "or_group", "or_branch")
                .agg(F.count(L(1)).alias("n"), F.count_if(bad).alias("n_bad"), F.count_if(off_kind).alias("n_off")))
    # paths an entity lacks: the shape's paths minus the entity's present ones,
    # as an array difference per entity (shape paths are a literal array).
    all_paths = F.array(*[L(p) for p, *_ in SHAPE])
    present = per_path.groupBy(ent).agg(F.collect_set("path").alias("present"))
    ents = triples.select(ent).distinct()
    missing = (ents.join(present, ent, "left")
               .select(ent, F.explode(F.array_except(all_paths, F.coalesce(
                   "present", F.array().cast("array<string>")))).alias("path"))
               .join(F.broadcast(shape.select("path", "datatype", "min_count", "max_count",
                                              "or_group", "or_branch")), "path")
               .withColumn("n", L(0).cast("long")).withColumn("n_bad", L(0).cast("long"))
               .withColumn("n_off", L(0).cast("long")))
    rows = per_path.unionByName(missing)
    rule = (F.when(F.col("n_off") > 0, L("nodeKind"))
            .when(F.col("n_bad") > 0, L("datatype"))
            .when(F.col("min_count").isNotNull() & (F.col("n") < F.col("min_count")), L("minCount"))
            .when(F.col("max_count").isNotNull() & (F.col("n") > F.col("max_count")), L("maxCount")))
    return rows.withColumn("failed_rule", rule)


def conforming_entities(report: DataFrame, ent: str = "ex_id") -> DataFrame:
    """V1 per entity from the V2 report: plain paths must all pass, each
    or-group needs one passing branch (branch passes if all its paths pass)."""
    plain = (report.where(F.col("or_group").isNull())
             .groupBy(ent).agg(F.bool_and(F.col("failed_rule").isNull()).alias("plain_ok")))
    branch = (report.where(F.col("or_group").isNotNull())
              .groupBy(ent, "or_group", "or_branch")
              .agg(F.bool_and(F.col("failed_rule").isNull()).alias("b_ok"))
              .groupBy(ent, "or_group").agg(F.bool_or("b_ok").alias("g_ok"))
              .groupBy(ent).agg(F.bool_and("g_ok").alias("groups_ok")))
    return (plain.join(branch, ent, "full")
            .select(ent, (F.coalesce("plain_ok", L(True)) & F.coalesce("groups_ok", L(True)))
                    .alias("conforms")))


def inferred_years(triples: DataFrame, date_rel: str, year_rel: str, ent: str = "ex_id") -> DataFrame:
    """V4 rows: ``year_rel = first 4 chars of date`` for entities with a date
    and no year (J7 left-anti), for every such row (Q14 fixed)."""
    dates = triples.where(F.col("p") == date_rel)
    have_year = triples.where(F.col("p") == year_rel).select(ent).distinct()
    return (dates.join(have_year, ent, "left_anti")
            .withColumn("p", L(year_rel)).withColumn("o", F.substring("o", 1, 4))
            .withColumn("dt", L("xsd:gYear")))


def infer_years(triples: DataFrame, date_rel: str, year_rel: str, ent: str = "ex_id") -> DataFrame:
    """V4: the triples plus the inferred years."""
    return triples.unionByName(inferred_years(triples, date_rel, year_rel, ent), allowMissingColumns=True)

"""Linearisation (L2–L12, L16): ordered facts array → text, as pure column
expressions over ``array<struct<s,p,o,dt>>``.  No shuffle: each example's facts
travel in its own row, so every serialisation is a projection.

Facts with ``dt`` null are IRIs (the type triple); the others are literals.
Facts are expected in canonical order (type, label, then predicate/value), so
facts sharing a predicate are adjacent — the factorised forms rely on that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import let, where_any
from factloom.functions.vocab import (
    ONTOLOGY_NS, RDF_NS, RDF_TYPE, RDFS_LABEL, RDFS_NS, RESOURCE_NS, TAG_END, TAG_OBJ,
    TAG_REL, TAG_SUBJ, TURTLE_PREFIXES, XSD_NS,
)

L = F.lit


def _join(arr: Column, sep: str = "") -> Column:
    return F.array_join(arr, sep)


def _prev(arr: Column, i: Column) -> Column:
    """Element before 0-based index i (null for i = 0)."""
    return F.when(i > 0, F.element_at(arr, i))


def _opens(arr: Column, f: Column, i: Column, field: str, known: bool = False) -> Column:
    if known:
        return f[f"opens_{field}"]
    return (i == 0) | (f[field] != _prev(arr, i)[field])


def _closes(arr: Column, f: Column, i: Column, field: str, known: bool = False) -> Column:
    if known:
        return f[f"closes_{field}"]
    nxt = F.when(i + 1 < F.size(arr), F.element_at(arr, i + 2))
    return nxt.isNull() | (f[field] != nxt[field])


def with_runs(facts: Column) -> Column:
    """Facts with what several syntaxes ask of each: where runs of a subject and a predicate
    begin and end, the escaped value, the datatype's name.  ``known`` says that an array has it."""
    return F.transform(facts, lambda f, i: F.struct(
        *[f[n].alias(n) for n in ("s", "p", "o", "dt")],
        *[ask(facts, f, i, n).alias(f"{name}_{n}") for name, ask in (("opens", _opens), ("closes", _closes)) for n in ("s", "p")],
        turtle_escape(f["o"]).alias("escaped"), dt_local(f["dt"]).alias("dt_local")))


def _escaped(f: Column, known: bool) -> Column:
    return f["escaped"] if known else turtle_escape(f["o"])


def _dt_name(f: Column, known: bool) -> Column:
    return f["dt_local"] if known else dt_local(f["dt"])


def pred_iri(p: Column) -> Column:
    return (F.when(p == "type", L(RDF_TYPE)).when(p == "label", L(RDFS_LABEL))
            .otherwise(F.concat(L(ONTOLOGY_NS), p)))


def pred_prefixed(p: Column) -> Column:
    return (F.when(p == "type", L("a")).when(p == "label", L("rdfs:label"))
            .otherwise(F.concat(L("dbo:"), p)))


def dt_local(dt: Column) -> Column:
    return F.substring_index(dt, ":", -1)


def dt_iri(dt: Column) -> Column:
    return F.concat(L(XSD_NS), dt_local(dt))


def turtle_escape(v: Column) -> Column:
    return where_any(v, ("\\", '"'), lambda x: F.replace(F.replace(x, L("\\"), L("\\\\")), L('"'), L('\\"')))


def xml_escape(v: Column, attr: bool = False) -> Column:
    def escaped(x):
        out = F.replace(F.replace(F.replace(x, L("&"), L("&amp;")), L("<"), L("&lt;")), L(">"), L("&gt;"))
        return F.replace(out, L('"'), L("&quot;")) if attr else out
    return where_any(v, ("&", "<", ">", '"') if attr else ("&", "<", ">"), escaped)


def py_quote(v: Column) -> Column:
    """Python-literal quoting as in a printed list: single quotes unless the
    value holds a single quote."""
    esc = where_any(v, ("\\",), lambda x: F.replace(x, L("\\"), L("\\\\")))
    return F.when(F.contains(v, L("'")), F.concat(L('"'), esc, L('"'))) \
        .otherwise(F.concat(L("'"), esc, L("'")))


# ---------------------------------------------------------------- L4 / L5 tags
def tags(facts: Column) -> Column:
    return _join(F.transform(facts, lambda f: F.concat(
        L(TAG_SUBJ), f["s"], L(TAG_REL), f["p"], L(TAG_OBJ), f["o"], L(TAG_END))))


def tags_facto(facts: Column, known: bool = False) -> Column:
    def one(f, i):
        return F.concat(
            F.when(_opens(facts, f, i, "s", known),
                   F.concat(F.when(i > 0, L(TAG_END)).otherwise(L("")), L(TAG_SUBJ), f["s"]))
             .otherwise(L("")),
            F.when(_opens(facts, f, i, "s", known) | _opens(facts, f, i, "p", known),
                   F.concat(L(TAG_REL), f["p"])).otherwise(L("")),
            L(TAG_OBJ), f["o"])
    body = _join(F.transform(facts, one))
    return F.when(F.size(facts) > 0, F.concat(body, L(TAG_END))).otherwise(L(""))


# ---------------------------------------------------------------- L2 / L3 list
def list_flat(facts: Column) -> Column:
    items = F.transform(facts, lambda f: F.concat(
        L("["), py_quote(f["s"]), L(", "), py_quote(f["p"]), L(", "), py_quote(f["o"]), L("]")))
    return F.concat(L("["), _join(items, ", "), L("]"))


def _groups(facts: Column, field: str) -> Column:
    """Indices (0-based) where a run of equal ``field`` starts."""
    idx = F.sequence(L(0), F.size(facts) - 1)
    return F.when(F.size(facts) > 0, F.filter(
        idx, lambda i: (i == 0) | (F.element_at(facts, i + 1)[field] != F.element_at(facts, i)[field])
    )).otherwise(F.array().cast("array<int>"))


def list_facto(facts: Column) -> Column:
    def pred_group(sub: Column, p: Column) -> Column:
        objs = F.transform(F.filter(sub, lambda f: f["p"] == p), lambda f: py_quote(f["o"]))
        return let(objs, lambda os: F.concat(
            L("["), py_quote(p), L(", "), F.when(F.size(os) == 1, F.element_at(os, 1)).otherwise(
                F.concat(L("["), _join(os, ", "), L("]"))), L("]")))

    def subj_group(s: Column) -> Column:
        def of(sub: Column) -> Column:
            return F.concat(L("["), py_quote(s), L(", ["), _join(F.transform(_groups(sub, "p"), lambda j: let(
                F.element_at(sub, j + 1)["p"], lambda p: pred_group(sub, p))), ", "), L("]]"))
        return let(F.filter(facts, lambda f: f["s"] == s), of)

    groups = F.transform(_groups(facts, "s"), lambda i: let(F.element_at(facts, i + 1)["s"], subj_group))
    return F.concat(L("["), _join(groups, ", "), L("]"))


# ---------------------------------------------------------------- L6 Turtle
TURTLE_HEADER = "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in TURTLE_PREFIXES) + "\n"


def _turtle_object(f: Column, known: bool = False) -> Column:
    return F.when(f["dt"].isNull(), F.concat(L("dbo:"), f["o"])).otherwise(
        F.concat(L('"'), _escaped(f, known), L('"^^xsd:'), _dt_name(f, known)))


def turtle(facts: Column, known: bool = False) -> Column:
    def one(f, i):
        opens_s = _opens(facts, f, i, "s", known)
        opens_p = opens_s | _opens(facts, f, i, "p", known)
        head = (F.when(opens_s, F.concat(F.when(i > 0, L("\n")).otherwise(L("")),
                                         L("dbr:"), f["s"], L(" "), pred_prefixed(f["p"]), L(" ")))
                .when(opens_p, F.concat(L("    "), pred_prefixed(f["p"]), L(" ")))
                .otherwise(L("        ")))
        closes_s = _closes(facts, f, i, "s", known)
        closes_p = closes_s | _closes(facts, f, i, "p", known)
        tail = F.when(closes_s, L(" .\n")).when(closes_p, L(" ;\n")).otherwise(L(",\n"))
        return F.concat(head, _turtle_object(f, known), tail)
    return F.concat(L(TURTLE_HEADER), _join(F.transform(facts, one)), L("\n"))


# ---------------------------------------------------------------- L7 N-Triples
def _nt_object(f: Column, known: bool = False) -> Column:
    return F.when(f["dt"].isNull(), F.concat(L("<" + ONTOLOGY_NS), f["o"], L(">"))).otherwise(
        F.concat(L('"'), _escaped(f, known), L('"^^<' + XSD_NS), _dt_name(f, known), L(">")))


def ntriples(facts: Column, known: bool = False) -> Column:
    lines = F.transform(facts, lambda f: F.concat(
        L("<" + RESOURCE_NS), f["s"], L("> <"), pred_iri(f["p"]), L("> "), _nt_object(f, known), L(" .\n")))
    return _join(lines)


# ---------------------------------------------------------------- L8 RDF/XML
XML_HEADER = ('<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF\n'
              f'   xmlns:dbo="{ONTOLOGY_NS}"\n   xmlns:rdf="{RDF_NS}"\n'
              f'   xmlns:rdfs="{RDFS_NS}"\n>\n')


def _xml_tag(p: Column) -> Column:
    return (F.when(p == "type", L("rdf:type")).when(p == "label", L("rdfs:label"))
            .otherwise(F.concat(L("dbo:"), p)))


def xml(facts: Column, known: bool = False) -> Column:
    def one(f, i):
        open_d = F.when(_opens(facts, f, i, "s", known), F.concat(
            L('  <rdf:Description rdf:about="' + RESOURCE_NS), xml_escape(f["s"], True), L('">\n'))
        ).otherwise(L(""))
        body = F.when(f["dt"].isNull(), F.concat(
            L("    <"), _xml_tag(f["p"]), L(' rdf:resource="' + ONTOLOGY_NS),
            xml_escape(f["o"], True), L('"/>\n'))
        ).otherwise(F.concat(
            L("    <"), _xml_tag(f["p"]), L(' rdf:datatype="' + XSD_NS), _dt_name(f, known), L('">'),
            xml_escape(f["o"]), L("</"), _xml_tag(f["p"]), L(">\n")))
        close_d = F.when(_closes(facts, f, i, "s", known), L("  </rdf:Description>\n")).otherwise(L(""))
        return F.concat(open_d, body, close_d)
    return F.concat(L(XML_HEADER), _join(F.transform(facts, one)), L("</rdf:RDF>\n"))


# ---------------------------------------------------------------- L9 JSON-LD
def json_escape(v: Column) -> Column:
    return turtle_escape(v)


def jsonld_sorted(facts: Column) -> Column:
    """Facts keyed and ordered as JSON-LD writes them: per subject, the type
    first, then properties by IRI, values in order."""
    return F.array_sort(F.transform(facts, lambda f: F.struct(
        f["s"].alias("s"), F.when(f["dt"].isNull(), 0).otherwise(1).alias("t"),
        F.when(f["dt"].isNull(), L("@type")).otherwise(pred_iri(f["p"])).alias("k"),
        f["o"].alias("o"), f["dt"].alias("dt"))))


def jsonld_from_sorted(arr: Column) -> Column:
    """Expanded JSON-LD, one node per subject; linear in the number of facts."""
    def one(f, i):
        prev = _prev(arr, i)
        nxt = F.when(i + 1 < F.size(arr), F.element_at(arr, i + 2))
        open_node = (i == 0) | (f["s"] != prev["s"])
        close_node = nxt.isNull() | (f["s"] != nxt["s"])
        open_key = open_node | (f["k"] != prev["k"])
        close_key = close_node | (f["k"] != nxt["k"])
        head = F.when(open_node, F.concat(F.when(i > 0, L(",\n")).otherwise(L("")),
                                          L('  {\n    "@id": "' + RESOURCE_NS), json_escape(f["s"]), L('"'))
                      ).otherwise(L(""))
        key = F.when(open_key, F.concat(L(',\n    "'), f["k"], L('": [\n'))).otherwise(L(",\n"))
        typ = F.when(f["dt"] == "xsd:string", L("")).otherwise(
            F.concat(L('        "@type": "'), dt_iri(f["dt"]), L('",\n')))
        val = F.when(f["t"] == 0, F.concat(L('      "' + ONTOLOGY_NS), json_escape(f["o"]), L('"'))).otherwise(
            F.concat(L("      {\n"), typ, L('        "@value": "'), json_escape(f["o"]), L('"\n      }')))
        tail = F.concat(F.when(close_key, L("\n    ]")).otherwise(L("")),
                        F.when(close_node, L("\n  }")).otherwise(L("")))
        return F.concat(head, key, val, tail)
    return F.concat(L("[\n"), _join(F.transform(arr, one)), L("\n]"))


def jsonld(facts: Column) -> Column:
    return jsonld_from_sorted(jsonld_sorted(facts))


# ---------------------------------------------------------------- L10 / L11 Turtle Light
def _light_object(f: Column, datatype: bool, facto: bool, known: bool = False) -> Column:
    iri = F.concat(L(":"), f["o"])
    lit = F.concat(L('"'), _escaped(f, known), L('"'))
    if datatype:
        lit = F.concat(L('"'), _escaped(f, known), L('"^^xsd:' if facto else '"^^:'), _dt_name(f, known))
    return F.when(f["dt"].isNull(), iri).otherwise(lit)


def turtle_light(facts: Column, datatype: bool, inline: bool, facto: bool, known: bool = False) -> Column:
    if not facto:
        lines = F.transform(facts, lambda f: F.concat(
            L(":"), f["s"], L(" :"), f["p"], L(" "), _light_object(f, datatype, False, known), L(" .")))
        return _join(lines, "" if inline else "\n")

    def one(f, i):
        opens_s = _opens(facts, f, i, "s", known)
        opens_p = opens_s | _opens(facts, f, i, "p", known)
        pred = F.when(f["p"] == "type", L("a")).otherwise(F.concat(L(":"), f["p"]))
        indent = " " if inline else "   "
        head = (F.when(opens_s, F.concat(F.when(i > 0, L("\n")).otherwise(L("")),
                                         L(":"), f["s"], L(" "), pred, L(" ")))
                .when(opens_p, F.concat(L(indent), pred, L(" ")))
                .otherwise(L(" ")))
        closes_s = _closes(facts, f, i, "s", known)
        closes_p = closes_s | _closes(facts, f, i, "p", known)
        tail = F.when(closes_s, L(" .")).when(closes_p, L(";" if inline else " ;\n")).otherwise(L(","))
        return F.concat(head, _light_object(f, datatype, True, known), tail)
    return _join(F.transform(facts, one))


def turtle_ultra_light(facts: Column, known: bool = False) -> Column:
    """``S a T ; p "v" ; p2 "a", "b".`` — no colons, no datatypes."""
    def one(f, i):
        opens_p = _opens(facts, f, i, "s", known) | _opens(facts, f, i, "p", known)
        pred = F.when(f["p"] == "type", L("a")).otherwise(f["p"])
        obj = F.when(f["dt"].isNull(), f["o"]).otherwise(F.concat(L('"'), _escaped(f, known), L('"')))
        head = F.when(i == 0, F.concat(f["s"], L(" "), pred, L(" "))) \
            .when(_opens(facts, f, i, "s", known), F.concat(L(".\n"), f["s"], L(" "), pred, L(" "))) \
            .when(opens_p, F.concat(L(" ; "), pred, L(" "))).otherwise(L(", "))
        return F.concat(head, obj)
    return F.concat(_join(F.transform(facts, one)), L("."))


def light_flags(syntax: str) -> tuple[bool, bool, bool]:
    """turtleS_<d>datatype_<i>inLine_<f>facto → (datatype, inline, facto)."""
    parts = syntax.split("_")
    return parts[1][0] == "1", parts[2][0] == "1", parts[3][0] == "1"


def encode(facts: Column, syntax: str, known: bool = False) -> Column:
    """Dispatch on a syntax name (see ``vocab.SYNTAXES``); ``known``: facts ``with_runs``."""
    if syntax == "tags":
        return tags(facts)
    if syntax == "tags_facto":
        return tags_facto(facts, known)
    if syntax == "list":
        return list_flat(facts)
    if syntax == "list_facto":
        return list_facto(facts)
    if syntax == "turtle":
        return turtle(facts, known)
    if syntax == "ntriples":
        return ntriples(facts, known)
    if syntax == "xml":
        return xml(facts, known)
    if syntax == "json-ld":
        return jsonld(facts)
    if syntax == "turtleU":
        return turtle_ultra_light(facts, known)
    if syntax.startswith("turtleS_"):
        return turtle_light(facts, *light_flags(syntax), known)
    raise ValueError(f"unknown syntax {syntax!r}")


_EXPR_CACHE: dict = {}


def cached_expr(spark, key, build):
    """Column trees for the 17-syntax dispatch take seconds to build over
    py4j; they are immutable, so one tree per session and key is reused."""
    k = (spark.sparkContext.applicationId, key)  # an id() could be given anew once a session is gone
    if k not in _EXPR_CACHE:
        _EXPR_CACHE[k] = build()
    return _EXPR_CACHE[k]


def encode_by_column(df, facts_col: str, syntax_col: str, syntaxes, out: str, known: bool = False):
    """Serialise each row in the syntax named by its ``syntax_col`` value:
    one projection with a CASE over the syntaxes (only the matching branch
    runs per row).  JSON-LD's ordered array is its own column first."""
    fc, sc = F.col(facts_col), F.col(syntax_col)
    tmp = f"_{out}_sorted"
    if "json-ld" in syntaxes:
        df = df.withColumn(tmp, F.when(sc == "json-ld", jsonld_sorted(fc)))

    def build():
        expr = None
        for syn in syntaxes:
            e = jsonld_from_sorted(F.col(tmp)) if syn == "json-ld" else encode(fc, syn, known)
            expr = F.when(sc == syn, e) if expr is None else expr.when(sc == syn, e)
        return expr
    expr = cached_expr(df.sparkSession, ("enc", facts_col, syntax_col, tuple(syntaxes), out, known), build)
    return df.withColumn(out, expr).drop(tmp)


def encode_into(df, facts_col: str, syntax: str, out: str):
    """``encode`` as a DataFrame step; syntaxes that need an ordered
    intermediate array get it as its own column first, so the optimizer does
    not re-evaluate it inside the per-element lambda."""
    if syntax == "json-ld":
        tmp = f"_{out}_sorted"
        return (df.withColumn(tmp, jsonld_sorted(F.col(facts_col)))
                .withColumn(out, jsonld_from_sorted(F.col(tmp))).drop(tmp))
    return df.withColumn(out, encode(F.col(facts_col), syntax))


def prefixless_body(text: Column) -> Column:
    """Drop prefix declarations and blank lines of a serialisation."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda ln: ~F.contains(ln, L("prefix")) & (F.length(F.trim(ln)) > 2))
    return _join(kept, "\n")

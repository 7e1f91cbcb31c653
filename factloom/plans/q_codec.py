"""Serialisation (L2–L12, L16) and decode (D1–D10, D13) queries.

Spark side: entity facts → ``encode`` / ``decode`` column expressions.
SQL side: the same layouts written with window flags (``lag``/``lead`` over
the canonical order) and ordered ``string_agg``; decode queries are checked
against the fact table itself (decode ∘ encode = identity).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.vocab import (
    ONTOLOGY_NS, RDF_TYPE, RDFS_LABEL, RESOURCE_NS, SYNTAXES, TURTLE_LIGHT_VARIANTS, XSD_NS,
)
from factloom.operators import decode as D
from factloom.operators import encode as E
from factloom.plans.catalog import query
from factloom.plans.oracle import _values, with_facts
from factloom.sources.derived import entity_facts

NL = "chr(10)"


def _esc(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"


def _xml_esc(x: str, attr: bool = False) -> str:
    out = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace({out}, '\"', '&quot;')" if attr else out


def _pyq(x: str) -> str:
    e = f"replace({x}, '\\', '\\\\')"
    return f"(CASE WHEN contains({x}, '''') THEN '\"' || {e} || '\"' ELSE '''' || {e} || '''' END)"


def _dt_local(dt: str = "dt") -> str:
    return f"split_part({dt}, ':', 2)"


def _pred_iri(p: str = "p") -> str:
    return (f"(CASE WHEN {p} = 'type' THEN '{RDF_TYPE}' WHEN {p} = 'label' THEN '{RDFS_LABEL}' "
            f"ELSE '{ONTOLOGY_NS}' || {p} END)")


FLAGS_CTE = """
fx AS (
  SELECT ex_id, s, p, o, dt, rk,
         row_number() OVER w AS i,
         lag(s) OVER w AS ps, lag(p) OVER w AS pp, lead(s) OVER w AS ns, lead(p) OVER w AS np
  FROM facts WINDOW w AS (PARTITION BY ex_id ORDER BY rk, p, o)),
fl AS (
  SELECT *, (i = 1 OR s <> ps) AS opens_s, (i = 1 OR s <> ps OR p <> pp) AS opens_p,
         (ns IS NULL OR s <> ns) AS closes_s, (ns IS NULL OR s <> ns OR p <> np) AS closes_p
  FROM fx)"""


def _piece(syntax: str) -> tuple[str, str, str]:
    """(piece expression over one fact row, prefix, suffix) of a syntax."""
    if syntax == "tags":
        return "'<subj>' || s || '<rel>' || p || '<obj>' || o || '<et>'", "''", "''"
    if syntax == "tags_facto":
        return ("(CASE WHEN opens_s THEN (CASE WHEN i > 1 THEN '<et>' ELSE '' END) || '<subj>' || s ELSE '' END)"
                " || (CASE WHEN opens_p THEN '<rel>' || p ELSE '' END) || '<obj>' || o", "''", "'<et>'")
    if syntax == "list":
        return (f"(CASE WHEN i > 1 THEN ', ' ELSE '' END) || '[' || {_pyq('s')} || ', ' || {_pyq('p')}"
                f" || ', ' || {_pyq('o')} || ']'", "'['", "']'")
    if syntax == "ntriples":
        obj = (f"(CASE WHEN dt IS NULL THEN '<{ONTOLOGY_NS}' || o || '>' ELSE '\"' || {_esc('o')}"
               f" || '\"^^<{XSD_NS}' || {_dt_local()} || '>' END)")
        return f"'<{RESOURCE_NS}' || s || '> <' || {_pred_iri()} || '> ' || {obj} || ' .' || {NL}", "''", "''"
    if syntax == "turtle":
        pred = f"(CASE WHEN p = 'type' THEN 'a' WHEN p = 'label' THEN 'rdfs:label' ELSE 'dbo:' || p END)"
        obj = f"(CASE WHEN dt IS NULL THEN 'dbo:' || o ELSE '\"' || {_esc('o')} || '\"^^xsd:' || {_dt_local()} END)"
        head = (f"(CASE WHEN opens_s THEN (CASE WHEN i > 1 THEN {NL} ELSE '' END) || 'dbr:' || s || ' ' || {pred} || ' '"
                f" WHEN opens_p THEN '    ' || {pred} || ' ' ELSE '        ' END)")
        tail = (f"(CASE WHEN closes_s THEN ' .' || {NL} WHEN closes_p THEN ' ;' || {NL} ELSE ',' || {NL} END)")
        header = "".join(f"@prefix {p}: <{ns}> .' || {NL} || '" for p, ns in E.TURTLE_PREFIXES)
        return f"{head} || {obj} || {tail}", f"'{header}' || {NL}", NL
    if syntax == "xml":
        tag = "(CASE WHEN p = 'type' THEN 'rdf:type' WHEN p = 'label' THEN 'rdfs:label' ELSE 'dbo:' || p END)"
        open_d = (f"(CASE WHEN opens_s THEN '  <rdf:Description rdf:about=\"{RESOURCE_NS}' || {_xml_esc('s', True)}"
                  f" || '\">' || {NL} ELSE '' END)")
        body = (f"(CASE WHEN dt IS NULL THEN '    <' || {tag} || ' rdf:resource=\"{ONTOLOGY_NS}' || "
                f"{_xml_esc('o', True)} || '\"/>' || {NL} ELSE '    <' || {tag} || ' rdf:datatype=\"{XSD_NS}' || "
                f"{_dt_local()} || '\">' || {_xml_esc('o')} || '</' || {tag} || '>' || {NL} END)")
        close_d = f"(CASE WHEN closes_s THEN '  </rdf:Description>' || {NL} ELSE '' END)"
        header = E.XML_HEADER.replace("\n", f"' || {NL} || '")
        return f"{open_d} || {body} || {close_d}", f"'{header}'", f"'</rdf:RDF>' || {NL}"
    if syntax == "turtleU":
        pred = "(CASE WHEN p = 'type' THEN 'a' ELSE p END)"
        obj = f"(CASE WHEN dt IS NULL THEN o ELSE '\"' || {_esc('o')} || '\"' END)"
        head = (f"(CASE WHEN i = 1 THEN s || ' ' || {pred} || ' ' WHEN opens_s THEN '.' || {NL} || s || ' ' || {pred}"
                f" || ' ' WHEN opens_p THEN ' ; ' || {pred} || ' ' ELSE ', ' END)")
        return f"{head} || {obj}", "''", "'.'"
    if syntax.startswith("turtleS_"):
        datatype, inline, facto = E.light_flags(syntax)
        lit = f"'\"' || {_esc('o')} || '\"'"
        if datatype:
            lit += f" || '{'^^xsd:' if facto else '^^:'}' || {_dt_local()}"
        obj = f"(CASE WHEN dt IS NULL THEN ':' || o ELSE {lit} END)"
        if not facto:
            sep = "''" if inline else NL
            return (f"(CASE WHEN i > 1 THEN {sep} ELSE '' END) || ':' || s || ' :' || p || ' ' || {obj} || ' .'",
                    "''", "''")
        pred = "(CASE WHEN p = 'type' THEN 'a' ELSE ':' || p END)"
        indent = "' '" if inline else "'   '"
        head = (f"(CASE WHEN opens_s THEN (CASE WHEN i > 1 THEN {NL} ELSE '' END) || ':' || s || ' ' || {pred} || ' '"
                f" WHEN opens_p THEN {indent} || {pred} || ' ' ELSE ' ' END)")
        semi = "';'" if inline else f"' ;' || {NL}"
        tail = f"(CASE WHEN closes_s THEN ' .' WHEN closes_p THEN {semi} ELSE ',' END)"
        return f"{head} || {obj} || {tail}", "''", "''"
    raise ValueError(syntax)


def encode_select(syntaxes) -> str:
    parts = []
    for syn in syntaxes:
        piece, pre, suf = _piece(syn)
        parts.append(f"SELECT ex_id, '{syn}' AS syntax, {pre} || string_agg({piece}, '' ORDER BY i) || {suf}"
                     f" AS text FROM fl GROUP BY ex_id")
    return "\nUNION ALL\n".join(parts)


def encode_sql(syntaxes) -> str:
    return with_facts(encode_select(syntaxes), FLAGS_CTE.strip())


LIST_FACTO_SQL = with_facts(f"""
SELECT ex_id, 'list_facto' AS syntax,
       '[[' || {_pyq('min(s)')} || ', [' ||
       string_agg('[' || {_pyq('p')} || ', ' || (CASE WHEN n = 1 THEN objs ELSE '[' || objs || ']' END) || ']',
                  ', ' ORDER BY rk, p) || ']]]' AS text
FROM pg GROUP BY ex_id""", f"""
pg AS (SELECT ex_id, min(s) AS s, p, min(rk) AS rk, count(*) AS n,
              string_agg({_pyq('o')}, ', ' ORDER BY o) AS objs
       FROM facts GROUP BY ex_id, p)""")

JSONLD_SQL = with_facts(f"""
SELECT ex_id, 'json-ld' AS syntax, '[' || {NL} || string_agg(
  (CASE WHEN opens THEN '  {{' || {NL} || '    "@id": "{RESOURCE_NS}' || {_esc('s')} || '"' ELSE '' END)
  || (CASE WHEN opens_k THEN ',' || {NL} || '    "' || k || '": [' || {NL} ELSE ',' || {NL} END)
  || (CASE WHEN t = 0 THEN '      "{ONTOLOGY_NS}' || {_esc('o')} || '"'
      ELSE '      {{' || {NL} || (CASE WHEN dt = 'xsd:string' THEN ''
           ELSE '        "@type": "{XSD_NS}' || {_dt_local()} || '",' || {NL} END)
           || '        "@value": "' || {_esc('o')} || '"' || {NL} || '      }}' END)
  || (CASE WHEN closes_k THEN {NL} || '    ]' ELSE '' END)
  || (CASE WHEN closes THEN {NL} || '  }}' ELSE '' END), '' ORDER BY j) || {NL} || ']' AS text
FROM jf GROUP BY ex_id""", f"""
jk AS (SELECT ex_id, s, o, dt, CASE WHEN dt IS NULL THEN 0 ELSE 1 END AS t,
              CASE WHEN dt IS NULL THEN '@type' ELSE {_pred_iri()} END AS k FROM facts),
jw AS (SELECT *, row_number() OVER w AS j, lag(s) OVER w AS ps, lag(k) OVER w AS pk,
              lead(s) OVER w AS ns, lead(k) OVER w AS nk
       FROM jk WINDOW w AS (PARTITION BY ex_id ORDER BY s, t, k, o, dt)),
jf AS (SELECT *, (j = 1 OR s <> ps) AS opens, (j = 1 OR s <> ps OR k <> pk) AS opens_k,
              (ns IS NULL OR s <> ns) AS closes, (ns IS NULL OR s <> ns OR k <> nk) AS closes_k FROM jw)""")


def _encoded(spark, sf_dir, syntaxes):
    ef = entity_facts(spark, sf_dir).select(
        "ex_id", "facts", F.explode(F.array(*[F.lit(s) for s in syntaxes])).alias("syntax"))
    return E.encode_by_column(ef, "facts", "syntax", syntaxes, "text").select("ex_id", "syntax", "text")


def _register_encoder(name, syntaxes, sql):
    query(name, sql)(lambda spark, sf_dir: _encoded(spark, sf_dir, syntaxes))


_register_encoder("l2_list", ["list"], encode_sql(["list"]))
_register_encoder("l3_list_facto", ["list_facto"], LIST_FACTO_SQL)
_register_encoder("l4_tags", ["tags"], encode_sql(["tags"]))
_register_encoder("l5_tags_facto", ["tags_facto"], encode_sql(["tags_facto"]))
_register_encoder("l6_turtle", ["turtle"], encode_sql(["turtle"]))
_register_encoder("l7_ntriples", ["ntriples"], encode_sql(["ntriples"]))
_register_encoder("l8_rdfxml", ["xml"], encode_sql(["xml"]))
_register_encoder("l9_jsonld", ["json-ld"], JSONLD_SQL)
_register_encoder("l10_turtle_light", TURTLE_LIGHT_VARIANTS, encode_sql(TURTLE_LIGHT_VARIANTS))
_register_encoder("l11_turtle_ultra_light", ["turtleU"], encode_sql(["turtleU"]))


@query("l12_prefixless_body", with_facts(
    "SELECT ex_id, array_to_string(list_filter(string_split(text, chr(10)), "
    "lambda ln: NOT contains(ln, 'prefix') AND length(trim(ln)) > 2), chr(10)) AS body "
    f"FROM ({encode_select(['turtle'])}) enc", FLAGS_CTE.strip()))
def l12_prefixless_body(spark, sf_dir):
    return _encoded(spark, sf_dir, ["turtle"]).select("ex_id", E.prefixless_body(F.col("text")).alias("body"))


def _decoded_side(spark, sf_dir, side: str, syntaxes=SYNTAXES):
    from factloom.plans.evaluation import decoded_predictions
    dec = decoded_predictions(spark, sf_dir, syntaxes).select("syntax", "ex_id", f"{side}_triples")
    # inline_outer + a filter after the generator: a plain inline makes the
    # optimizer infer size(array) > 0 and push that filter below the
    # projections, evaluating the whole encode/decode expression twice.
    return dec.select("syntax", "ex_id", F.inline_outer(f"{side}_triples")).where(F.col("s").isNotNull())


_SYN = _values("syntax", SYNTAXES)


@query("d10_decode_gold_all_syntaxes", with_facts(
    f"SELECT y.syntax, f.ex_id, f.s, f.p, f.o FROM facts f CROSS JOIN {_SYN} y"))
def d10_decode_gold_all_syntaxes(spark, sf_dir):
    """Every syntax decoded back to the long triple table."""
    return _decoded_side(spark, sf_dir, "gold")


@query("d10_decode_predictions", with_facts(
    f"SELECT y.syntax, f.ex_id, f.s, f.p, f.o FROM pfacts f CROSS JOIN {_SYN} y WHERE f.ex_id % 13 <> 0"))
def d10_decode_predictions(spark, sf_dir):
    """Damaged predictions decoded; unparseable texts yield no triples."""
    return _decoded_side(spark, sf_dir, "pred")


@query("l16_transcode_facto_to_flat", encode_sql(["tags", "list"]))
def l16_transcode_facto_to_flat(spark, sf_dir):
    """Factorised tags/list → decode → flat tags/list."""
    ef = entity_facts(spark, sf_dir).select("ex_id", "facts")
    ef = E.encode_into(E.encode_into(ef, "facts", "tags_facto", "tf"), "facts", "list_facto", "lf")
    ef = D.decode_into(D.decode_into(ef, "tf", "tags_facto", "t"), "lf", "list_facto", "l")
    out = ef.select("ex_id", F.transform("t_triples", lambda x: F.struct(
        x["s"].alias("s"), x["p"].alias("p"), x["o"].alias("o"))).alias("t"), "l_triples")
    return out.select("ex_id", F.lit("tags").alias("syntax"), E.tags(F.col("t")).alias("text")).unionByName(
        out.select("ex_id", F.lit("list").alias("syntax"), E.list_flat(F.col("l_triples")).alias("text")))


@query("d13_plain_tokens", with_facts(
    "SELECT ex_id, CAST(sum(2 + len(string_split_regex(trim(o), '\\s+'))) AS BIGINT)"
    " AS n_tokens FROM facts GROUP BY ex_id"))
def d13_plain_tokens(spark, sf_dir):
    """D13 on the tags text: drop markers, split on whitespace; token count
    per example equals the whitespace tokens of the fact parts."""
    enc = _encoded(spark, sf_dir, ["tags"])
    marked = F.concat(F.lit("<s>"), F.regexp_replace("text", r"<subj>|<rel>|<obj>|<et>", " "), F.lit("</s><pad><pad>"))
    return enc.select("ex_id", F.size(D.plain_tokens(marked)).cast("long").alias("n_tokens"))

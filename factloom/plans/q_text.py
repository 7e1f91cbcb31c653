"""Scalar and text operators over the driver's text tables (P1, P3, P7,
P13, T1–T6, A11, X1), each on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as TX
from factloom.plans.catalog import query
from factloom.sources.tables import table

_WS = "'^\\s+|\\s+$'"


@query("p1_canonical_iri",
       "SELECT c_custkey, replace(replace(url_encode(replace(replace(c_name, 'http://dbpedia.org/resource/', ''), "
       "'https://dbpedia.org/resource/', '')), '%2F', '/'), '.', '%2E') AS iri FROM customer")
def p1_canonical_iri(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return c.select("c_custkey", TX.canonical_iri(F.col("c_name")).alias("iri"))


@query("p3_local_name",
       "SELECT page_id, CASE WHEN contains(url, '#') THEN split_part(url, '#', -1) "
       "ELSE split_part(url, '/', -1) END AS local FROM pages")
def p3_local_name(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "url")
    return p.select("page_id", TX.local_name(F.col("url")).alias("local"))


def _repair_sql(x: str, rules) -> str:
    for a, b in rules:
        a2, b2 = a.replace("'", "''"), b.replace("'", "''")
        x = f"replace({x}, '{a2}', '{b2}')"
    return x


def _trim_sql(x: str) -> str:
    v = f"regexp_replace({x}, {_WS}, '', 'g')"
    return f"NULLIF({v}, '')"


@query("p7_spacing_repair",
       "SELECT page_id, md5(" + _repair_sql("html", TX.REPAIR_COMMON) + ") AS rule1_md5, "
       "md5(" + _trim_sql(_repair_sql("html", [("<s>", ""), ("</s>", "")] + TX.REPAIR_COMMON)) + ") AS rule2_md5, "
       "md5(" + _trim_sql(_repair_sql("html", TX.REPAIR_SET3_HEAD)) + ") AS rule3_md5 FROM pages")
def p7_spacing_repair(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "html")
    h = F.col("html")
    return p.select("page_id", F.md5(TX.repair_spacing(h, 1)).alias("rule1_md5"),
                    F.md5(TX.repair_spacing(h, 2)).alias("rule2_md5"),
                    F.md5(TX.repair_spacing(h, 3)).alias("rule3_md5"))


_SIMPLIFY_SQL = """
SELECT doc_id, (contains(text, '(') OR contains(text, '.') OR contains(text, ',')) AS special,
       md5(regexp_replace(CASE WHEN contains(t2, '.') THEN array_to_string(list_filter(
             string_split_regex(t2, '\\s+'), lambda w: w <> '' AND NOT contains(w, '.')), ' ') ELSE t2 END,
           '^\\s+|\\s+$', '', 'g')) AS simplified_md5
FROM (SELECT doc_id, text, CASE WHEN contains(t1, ',') THEN split_part(text, ',', 1) ELSE t1 END AS t2
      FROM (SELECT doc_id, text, CASE WHEN contains(text, '(') THEN split_part(text, '(', 1) ELSE text END AS t1
            FROM documents))"""


@query("p13_label_simplify", _SIMPLIFY_SQL)
def p13_label_simplify(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    t = F.col("text")
    return d.select("doc_id", TX.label_is_special(t).alias("special"),
                    F.md5(TX.simplify_label(t)).alias("simplified_md5"))


_SENT_SQL = """
WITH p AS (
  SELECT doc_id, unnest(paras) AS para, generate_subscripts(paras, 1) AS pi
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS paras
        FROM documents)),
s AS (
  SELECT doc_id, pi, string_split(regexp_replace(para, '\\.\\s+', '.' || chr(1), 'g'), chr(1)) AS sents FROM p)
SELECT doc_id, CAST(pi - 1 AS INTEGER) AS para, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent,
       CAST(length(unnest(sents)) AS INTEGER) AS n_chars
FROM s"""


@query("t1_sentence_split", _SENT_SQL)
def t1_sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    p = d.select("doc_id", F.posexplode(TX.paragraphs(F.col("text"))).alias("para", "ptext"))
    s = p.select("doc_id", "para", F.posexplode(TX.sentences(F.col("ptext"))).alias("sent", "stext"))
    return s.select("doc_id", "para", "sent", F.length("stext").alias("n_chars"))


@query("t2_punct_spacing",
       "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '([\\[\\].,!?()])', ' \\1 ', 'g'),"
       " '[()]', '', 'g'), '\\s+', ' ', 'g'))) AS spaced_md5 FROM documents")
def t2_punct_spacing(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.md5(TX.space_punct(F.col("text"))).alias("spaced_md5"))


_BUDGET, _FRAME = 512, 20  # _FRAME: tokens of the prompt around a text; its title's come on top
_TOK = "len(regexp_extract_all({x}, '\\w+|[^\\w\\s]'))"
_TRUNC_SQL = f"""
WITH d AS (SELECT doc_id, text, list_filter(string_split(text, '.'), lambda p: p <> '') AS parts,
                  {_TOK.format(x='text')} AS ntok, {_FRAME} + {_TOK.format(x='source')} AS over FROM documents),
u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM d),
c AS (SELECT doc_id, j, sum({_TOK.format(x='part')}) OVER (PARTITION BY doc_id ORDER BY j
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + (j - 1) AS cum FROM u),
k AS (SELECT c.doc_id, count(*) FILTER (WHERE cum + over <= {_BUDGET}) AS keep FROM c JOIN d USING (doc_id)
      GROUP BY c.doc_id),
r AS (SELECT d.doc_id, CASE WHEN d.ntok + d.over <= {_BUDGET} THEN d.text
             ELSE array_to_string(d.parts[1:greatest(least(coalesce(k.keep, 0), len(d.parts) - 1), 0)], '.') END AS out
      FROM d LEFT JOIN k ON d.doc_id = k.doc_id)
SELECT doc_id, CAST(length(out) AS INTEGER) AS out_chars, md5(out) AS out_md5 FROM r"""


@query("t3_truncate_to_budget", _TRUNC_SQL)
def t3_truncate_to_budget(spark, sf_dir):
    """T3 + X1: token-budget truncation at '.' boundaries (512 tokens)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    r = TX.truncate_to_budget(d, "text", _BUDGET, F.lit(_FRAME) + TX.regex_token_count(F.col("source")), "out")
    return r.select("doc_id", F.length("out").alias("out_chars"), F.md5("out").alias("out_md5"))


_IDS_SQL = """
WITH t AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''),
                  lambda w: CAST((length(w) * 31 + ascii(w)) % 997 + 3 AS INTEGER)) AS ids FROM documents),
p AS (SELECT doc_id, list_concat(ids[1:32], list_transform(range(32 - len(ids[1:32])), lambda x: 0)) AS padded
      FROM t)
SELECT doc_id, array_to_string(padded, ',') AS padded,
       array_to_string(list_transform(padded, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ',') AS masked,
       array_to_string(list_concat([2], padded[1:31]), ',') AS shifted,
       CAST(len(list_filter(padded, lambda x: x <> 0)) AS INTEGER) AS n_nonpad
FROM p"""


def _token_arrays(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    d = d.withColumn("ids", TX.token_ids(F.col("text")))
    d = d.withColumn("padded", TX.truncate_pad(F.col("ids"), 32))
    return d.select(
        "doc_id", F.array_join("padded", ",").alias("padded"),
        F.array_join(TX.mask_pad(F.col("padded")), ",").alias("masked"),
        F.array_join(TX.shift_right(TX.mask_pad(F.col("padded"))), ",").alias("shifted"),
        F.size(F.filter("padded", lambda x: x != 0)).alias("n_nonpad"))


@query("t4_t6_token_arrays", _IDS_SQL)
def t4_t6_token_arrays(spark, sf_dir):
    """T4 truncate+pad, T5 mask pad as -100, T6 shift right (unmasking)."""
    return _token_arrays(spark, sf_dir)


@query("a11_mean_generated_length",
       "SELECT round(avg(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))), 6) AS mean_len"
       " FROM documents")
def a11_mean_generated_length(spark, sf_dir):
    """Mean number of tokens that are not padding, of whole texts."""
    ids = TX.token_ids(F.col("text"))
    return table(spark, sf_dir, "documents", "text").agg(
        F.round(F.avg(F.size(F.filter(ids, lambda x: x != 0))), 6).alias("mean_len"))


_LINE_WORDS = "list_transform(string_split(text, chr(10)), lambda s: list_filter(string_split_regex(s, '\\s+'), lambda w: w <> ''))"


@query("t6_t7_shift_left_flat", f"""
WITH t AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''),
                  lambda w: CAST((length(w) * 31 + ascii(w)) % 997 + 3 AS INTEGER)) AS ids, {_LINE_WORDS} AS sents FROM documents),
p AS (SELECT *, list_concat(ids[1:32], list_transform(range(32 - len(ids[1:32])), lambda x: 0)) AS padded FROM t)
SELECT doc_id, array_to_string(list_concat(padded[2:], [0]), ',') AS shifted_left,
       CAST(len(sents) AS INTEGER) AS n_sentences, md5(array_to_string(flatten(sents), ' ')) AS flat_md5 FROM p""")
def t6_t7_shift_left_flat(spark, sf_dir):
    """Padded ids shifted left; T7: the words of all lines of a document as one text."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    d = d.withColumn("padded", TX.truncate_pad(TX.token_ids(F.col("text")), 32)).withColumn(
        "sents", F.transform(F.split("text", "\n"), lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    return d.select("doc_id", F.array_join(TX.shift_left(F.col("padded")), ",").alias("shifted_left"),
                    F.size("sents").alias("n_sentences"), F.md5(TX.flat_words(F.col("sents"))).alias("flat_md5"))

"""What the serialised texts hold: marks of the syntaxes (A19), prefixes taken out
(P5), and how far an unparseable prediction is from its gold text (A7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as TX
from factloom.functions.vocab import SYNTAX_MARKS, TURTLE_PREFIXES
from factloom.operators import scoring as S
from factloom.plans import evaluation as EV
from factloom.plans.catalog import query
from factloom.plans.oracle import r6, with_facts
from factloom.plans.q_codec import FLAGS_CTE, _encoded, encode_select

_MARKED = list(SYNTAX_MARKS)


def _sql_text(x: str) -> str:
    return "chr(10)" if x == "\n" else "'" + x.replace("'", "''") + "'"


_MARKS_SQL = ", ".join(f"('{syn}', {_sql_text(m)})" for syn, marks in SYNTAX_MARKS.items() for m in marks)


@query("a19_syntax_vocabulary", with_facts(f"""
SELECT syntax, token, n, n_texts, {r6('avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY syntax)')} AS coverage
FROM (SELECT syntax, token, CAST(sum((length(text) - length(replace(text, token, ''))) // length(token)) AS BIGINT) AS n,
        count(*) FILTER (WHERE contains(text, token)) AS n_texts
      FROM ({encode_select(_MARKED)}) e JOIN (VALUES {_MARKS_SQL}) v(syntax, token) USING (syntax)
      GROUP BY syntax, token)""", FLAGS_CTE.strip()))
def a19_syntax_vocabulary(spark, sf_dir):
    """How often each mark of a syntax occurs in its texts, in how many of them,
    and which share of the syntax's marks occurs at all."""
    # The marks are a fixed table of under a hundred rows.
    marks = spark.createDataFrame([(s, m) for s, ms in SYNTAX_MARKS.items() for m in ms], "syntax string, token string")
    texts = _encoded(spark, sf_dir, _MARKED).join(F.broadcast(marks), "syntax")
    left = F.length(F.replace("text", F.col("token"), F.lit("")))
    counts = texts.groupBy("syntax", "token").agg(
        F.sum(((F.length("text") - left) / F.length("token")).cast("long")).alias("n"),
        F.count_if(F.contains("text", "token")).alias("n_texts"))
    occurs = F.when(F.col("n") > 0, 1.0).otherwise(0.0)
    return counts.withColumn("coverage", S.r6(F.avg(occurs).over(Window.partitionBy("syntax"))))


_PREFIXES = [p for p, _ in TURTLE_PREFIXES]
_STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
for _p in _PREFIXES:
    _STRIPPED = f"replace({_STRIPPED}, '{_p}:', '')"


@query("p5_strip_prefixes", with_facts(
    f"SELECT ex_id, {_STRIPPED} AS text FROM ({encode_select(['turtle'])}) e", FLAGS_CTE.strip()))
def p5_strip_prefixes(spark, sf_dir):
    """P5: Turtle texts trimmed and without their prefixes."""
    return _encoded(spark, sf_dir, ["turtle"]).select(
        "ex_id", TX.strip_prefixes(F.col("text"), _PREFIXES).alias("text"))


_EDITED = ["list", "tags", "ntriples", "turtle"]
_PRED_FLAGS = FLAGS_CTE.strip().replace("FROM facts", "FROM pfacts").replace("FROM fx", "FROM pfx").replace(
    "fx AS (", "pfx AS (").replace("fl AS (", "pfl AS (")


@query("a7_edit_distance", with_facts(f"""
SELECT g.syntax, count(*) AS n_failed, {r6('avg(levenshtein(reverse(p.text), g.text))')} AS avg_edit_dist
FROM ({encode_select(_EDITED)}) g JOIN ({encode_select(_EDITED).replace('FROM fl', 'FROM pfl')}) p USING (ex_id, syntax)
WHERE g.ex_id % 13 = 0 GROUP BY g.syntax""", FLAGS_CTE.strip() + ",\n" + _PRED_FLAGS))
def a7_edit_distance(spark, sf_dir):
    """Mean edit distance between the texts of examples whose prediction does not
    parse and whose gold does, by syntax."""
    # No filter before the aggregate: it would be moved below the decoding, which would then
    # run for the filter, several times a text, and again for the rows left.
    failed = F.col("gold_parsed") & ~F.col("pred_parsed")
    rows = EV.decoded_predictions(spark, sf_dir, _EDITED).select("syntax", failed.alias("failed"), *[
        F.when(failed, F.col(f"{side}_text")).alias(f"{side}_text") for side in ("pred", "gold")])
    return rows.withColumn("dist", S.edit_distance(F.col("pred_text"), F.col("gold_text"))).groupBy("syntax").agg(
        F.count_if("failed").alias("n_failed"), S.r6(F.avg("dist")).alias("avg_edit_dist")).where("n_failed > 0")

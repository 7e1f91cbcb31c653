"""Relation marker texts both ways and text overlap scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import overlap as OV
from factloom.operators import markers as M
from factloom.operators.ordering import row_index
from factloom.plans.catalog import query
from factloom.plans.oracle import with_facts
from factloom.session import cut_lineage
from factloom.sources.derived import entity_facts, entity_pairs, work_partitions
from factloom.sources.tables import table

_TYPES = {"Entity": "<entity>", "Trader": "<trader>", "Date": "<date>", "Text": "<text>"}

# Relations of an entity: segment and nation belong to a second head.
_REL_CTE = """rel AS (SELECT ex_id, row_number() OVER (PARTITION BY ex_id ORDER BY rk, p, o) - 1 AS pos,
  CASE WHEN p IN ('segment', 'nation') THEN 'Trader ' || s ELSE s END AS head,
  CASE WHEN p IN ('segment', 'nation') THEN 'Trader' ELSE 'Entity' END AS head_type, o AS tail,
  CASE WHEN dt = 'xsd:date' THEN 'Date' ELSE 'Text' END AS tail_type, p AS type FROM facts WHERE p <> 'type'),
lagged AS (SELECT *, lag(head) OVER (PARTITION BY ex_id ORDER BY pos) AS before FROM rel)"""


def _text_sql(tail: str, tail_new: str) -> str:
    return ("string_agg(CASE WHEN before = head THEN ' ' || " + tail + " ELSE CASE WHEN pos > 0 THEN ' ' ELSE '' END "
            "|| '<triplet> ' || head || ' ' || " + tail_new + " END, '' ORDER BY pos)")


_MARK = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"
_PLAIN = "'<subj> ' || tail || ' <obj> ' || type"
_TYPED = _MARK.format("head_type") + " || '{0}' || tail || ' ' || " + _MARK.format("tail_type") + " || ' ' || type"


def relations(spark, sf_dir) -> DataFrame:
    """ex_id, rels: array of (head, head_type, tail, tail_type, type)."""
    def rel(f):
        second = f["p"].isin("segment", "nation")
        return F.struct(
            F.when(second, F.concat(F.lit("Trader "), f["s"])).otherwise(f["s"]).alias("head"),
            F.when(second, "Trader").otherwise("Entity").alias("head_type"), f["o"].alias("tail"),
            F.when(f["dt"] == "xsd:date", "Date").otherwise("Text").alias("tail_type"), f["p"].alias("type"))

    facts = F.filter("facts", lambda f: f["p"] != "type")
    return entity_facts(spark, sf_dir).select("ex_id", F.transform(facts, rel).alias("rels")).where(F.size("rels") > 0)


@query("l13_l14_relation_markers", with_facts(
    f"SELECT ex_id, {_text_sql(_PLAIN, _PLAIN)} AS plain, "
    f"{_text_sql(_TYPED.replace('{0}', ' '), _TYPED.replace('{0}', '  '))} AS typed FROM lagged GROUP BY ex_id", _REL_CTE))
def l13_l14_relation_markers(spark, sf_dir):
    """Relations as marker text, heads named once."""
    r = relations(spark, sf_dir)
    return r.select("ex_id", M.linearise(F.col("rels")).alias("plain"),
                    M.linearise_typed(F.col("rels"), _TYPES).alias("typed"))


def _noisy(text):
    """Sequence markers and white space as a decoded model output has them."""
    return F.concat(F.lit("<s>"), text, F.lit(" </s><pad><pad>"))


@query("d11_relations_from_markers", with_facts(
    "SELECT ex_id, CAST(pos AS INTEGER) AS pos, head, tail, type FROM rel", _REL_CTE))
def d11_relations_from_markers(spark, sf_dir):
    """Marker text back to relations."""
    r = relations(spark, sf_dir).select("ex_id", M.extract(_noisy(M.linearise(F.col("rels")))).alias("found"))
    return r.select("ex_id", F.posexplode_outer("found").alias("pos", "r")).select(
        "ex_id", "pos", "r.head", "r.tail", "r.type")


@query("d12_typed_relations_from_markers", with_facts(
    "SELECT ex_id, CAST(pos AS INTEGER) AS pos, head, head_type, tail, tail_type, type FROM rel", _REL_CTE))
def d12_typed_relations_from_markers(spark, sf_dir):
    """Typed marker text back to relations."""
    text = _noisy(M.linearise_typed(F.col("rels"), _TYPES))
    r = relations(spark, sf_dir).select("ex_id", M.extract_typed(text, _TYPES).alias("found"))
    return r.select("ex_id", F.posexplode_outer("found").alias("pos", "r")).select(
        "ex_id", "pos", "r.head", "r.head_type", "r.tail", "r.tail_type", "r.type")


_CHARS = "list_filter(string_split({0}, ''), lambda c: trim(c) <> '')"
_GRAMS = ("list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], chr(31)))")
_BLEU = ("CASE WHEN len(pc) < 4 OR least(c1, c2, c3, c4) = 0 THEN 0.0 ELSE CASE WHEN len(pc) > rl THEN 1.0 ELSE "
         "exp(1 - rl / len(pc)) END * exp((ln(c1 / len(pc)) + ln(c2 / (len(pc) - 1)) + ln(c3 / (len(pc) - 2)) + "
         "ln(c4 / (len(pc) - 3))) / 4) END")


def _clip_sql(n: int) -> str:
    return (f"SELECT ex_id, relation, val, CAST(sum(least(pn, rn)) AS DOUBLE) AS c{n} FROM (SELECT a.ex_id, a.relation, "
            f"a.val, a.g, a.pn, coalesce(max(r.rn), 0) AS rn FROM (SELECT ex_id, relation, val, g, count(*) AS pn FROM "
            f"(SELECT ex_id, relation, val, unnest({_GRAMS.format('pc', n)}) AS g FROM pv) GROUP BY ALL) a LEFT JOIN "
            f"(SELECT ex_id, relation, ref, g, count(*) AS rn FROM (SELECT ex_id, relation, ref, "
            f"unnest({_GRAMS.format('rc', n)}) AS g FROM gv) GROUP BY ALL) r USING (ex_id, relation, g) GROUP BY ALL) "
            "GROUP BY ALL")


_BLEU_CTES = f"""sv AS (SELECT DISTINCT ex_id, p AS relation, o AS ref FROM facts WHERE dt = 'xsd:string'),
gv AS (SELECT *, {_CHARS.format('ref')} AS rc FROM sv),
pv AS (SELECT DISTINCT p.ex_id, p.p AS relation, p.o AS val, {_CHARS.format('p.o')} AS pc FROM pfacts p
       WHERE p.ex_id % 13 <> 0 AND EXISTS (SELECT 1 FROM sv WHERE sv.ex_id = p.ex_id AND sv.relation = p.p)),
near AS (SELECT ex_id, relation, val, arg_min(len(rc), struct_pack(d := abs(len(rc) - len(pc)), n := len(rc))) AS rl
         FROM pv JOIN gv USING (ex_id, relation) GROUP BY ALL),
bleu AS (SELECT relation, {_BLEU} AS b FROM pv JOIN near USING (ex_id, relation, val)
  {" ".join(f"LEFT JOIN ({_clip_sql(n)}) k{n} USING (ex_id, relation, val)" for n in (1, 2, 3, 4))})"""


@query("a5_a6_char_bleu", with_facts(
    "SELECT relation, round(avg(b), 4) AS bleu FROM bleu GROUP BY relation UNION ALL "
    "SELECT 'ALL', round(avg(x), 4) FROM (SELECT round(avg(b), 4) AS x FROM bleu GROUP BY relation)", _BLEU_CTES))
def a5_a6_char_bleu(spark, sf_dir):
    """Mean character BLEU of predicted string values against the gold values
    of their relation; A5: its mean over relations, as relation ALL."""
    pairs = entity_pairs(spark, sf_dir).where(~F.col("broken"))
    gold = F.filter("gold_facts", lambda f: f["dt"] == "xsd:string")
    predicted = F.array_distinct(F.transform("pred_facts", lambda f: F.struct(f["p"].alias("p"), f["o"].alias("o"))))
    rows = pairs.select(gold.alias("gold"), F.explode(predicted).alias("f")).select(
        F.col("f.p").alias("relation"), F.col("f.o").alias("val"),
        F.array_distinct(F.transform(F.filter("gold", lambda g: g["p"] == F.col("f.p")), lambda g: g["o"])).alias("refs"))
    scored = rows.where(F.size("refs") > 0).select("relation", OV.char_bleu(F.col("val"), F.col("refs")).alias("b"))
    each = scored.groupBy("relation").agg(F.round(F.avg("b"), 4).alias("bleu"))
    return each.unionByName(each.agg(F.lit("ALL").alias("relation"), F.round(F.avg("bleu"), 4).alias("bleu")))


_WORDS = ("list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')")


def _rouge_sql(n: int) -> str:
    return (f"SELECT doc_id, sum(least(p, r)) AS c FROM (SELECT doc_id, g, count(*) AS p FROM (SELECT doc_id, "
            f"unnest({_GRAMS.format('pw', n)}) AS g FROM t) GROUP BY ALL) JOIN (SELECT doc_id, g, count(*) AS r FROM "
            f"(SELECT doc_id, unnest({_GRAMS.format('rw', n)}) AS g FROM t) GROUP BY ALL) USING (doc_id, g) GROUP BY doc_id")


def _f_sql(n: int) -> str:
    return (f"round(CASE WHEN k{n}.c > 0 THEN 2.0 * k{n}.c / (greatest(len(pw) - {n - 1}, 0) + greatest(len(rw) - {n - 1}, 0)) "
            f"ELSE 0.0 END, 6) AS rouge{n}")


@query("a10_rouge", f"""
WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
             conv_id * 100000 + turn AS doc_id FROM conversations),
t AS (SELECT conv_id, turn, doc_id, {_WORDS.format('text')} AS pw, {_WORDS.format('before')} AS rw FROM u
      WHERE before IS NOT NULL AND text IS NOT NULL)
SELECT conv_id, turn, {_f_sql(1)}, {_f_sql(2)} FROM t LEFT JOIN ({_rouge_sql(1)}) k1 USING (doc_id)
LEFT JOIN ({_rouge_sql(2)}) k2 USING (doc_id)""")
def a10_rouge(spark, sf_dir):
    """A10: ROUGE-1 and ROUGE-2 of every turn against the turn before it."""
    pairs = _turn_pairs(spark, sf_dir).select(
        "conv_id", "turn", OV.words(F.col("text")).alias("p"), OV.words(F.col("ref")).alias("r"))
    return pairs.select("conv_id", "turn", *[
        F.round(OV.common_runs(F.col("p"), F.col("r"), n), 6).alias(f"rouge{n}") for n in (1, 2)])


_TURNS_PER_TASK = 2_000


def _turn_pairs(spark, sf_dir) -> DataFrame:
    """conv_id, turn, text and ``ref``, the text of the turn before, spread by rows:
    a partition by size holds far more turns than one task can compare."""
    turns = row_index(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), ["conv_id"], ["turn"])
    turns = cut_lineage(turns)
    earlier = turns.select("conv_id", (F.col("idx") + 1).alias("idx"), F.col("text").alias("ref"))
    pairs = turns.join(earlier, ["conv_id", "idx"]).where("text IS NOT NULL AND ref IS NOT NULL")
    return pairs.repartition(work_partitions(turns, _TURNS_PER_TASK), "conv_id", "idx")


# The longest increasing run of the places that each word of a turn has in the one before.
_PLACES = ("flatten(list_transform(pw, lambda w: list_reverse(list_filter(range(len(rw)), lambda i: rw[i + 1] = w))))")
_STEP = ("CASE WHEN len(t) = 0 OR t[-1] < x[1] THEN list_append(t, x[1]) ELSE list_transform(t, lambda v, i: "
         "CASE WHEN v >= x[1] AND (i = 1 OR t[i - 1] < x[1]) THEN x[1] ELSE v END) END")


@query("a10_rouge_l", f"""
WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
t AS (SELECT conv_id, turn, {_WORDS.format('text')} AS pw, {_WORDS.format('before')} AS rw FROM u
      WHERE before IS NOT NULL AND text IS NOT NULL),
l AS (SELECT conv_id, turn, len(pw) + len(rw) AS n, len(list_reduce(list_transform({_PLACES}, lambda p: [p]),
      lambda t, x: {_STEP}, CAST([] AS BIGINT[]))) AS c FROM t)
SELECT conv_id, turn, round(CASE WHEN c > 0 THEN 2.0 * c / n ELSE 0.0 END, 6) AS rouge_l FROM l""")
def a10_rouge_l(spark, sf_dir):
    """A10: ROUGE-L of every turn against the turn before it."""
    return _turn_pairs(spark, sf_dir).select(
        "conv_id", "turn", F.round(OV.rouge_l(F.col("text"), F.col("ref")), 6).alias("rouge_l"))


@query("a10_rouge_lsum")
def a10_rouge_lsum(spark, sf_dir):
    """A10: ROUGE-Lsum of every turn against the turn before it (held against brute
    force in the tests: SQL has no way back through the table)."""
    return _turn_pairs(spark, sf_dir).select(
        "conv_id", "turn", F.round(OV.rouge_lsum(F.col("text"), F.col("ref")), 6).alias("rouge_lsum"))

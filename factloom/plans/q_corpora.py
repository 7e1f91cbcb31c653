"""Prompt and target texts, entity marks, sentence windows, vocabularies,
out-of-fold and ensemble tables, over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.catalog import query
from factloom.plans.q_build import K, o6_stratified_kfold
from factloom.sources.tables import table

L = F.lit
_WRAP = "CASE WHEN starts_with({0}, '<s>') THEN {0} ELSE '<s>' || {0} || '</s>' END"


@query("p14_p15_prompt_target", f"""
SELECT doc_id, md5(source || ' : ' || text) AS plain_prompt,
  md5('Translate English to ' || lang || ' : [' || source || '] ' || text) AS task_prompt,
  md5({_WRAP.format('text')}) AS wrapped, md5('</s> <s>' || text || '</s>') AS shifted,
  md5(replace(text, chr(10), ' ' || chr(10) || ' ')) AS spaced
FROM (SELECT doc_id, lang, coalesce(source, '') AS source, CASE WHEN doc_id % 3 = 0 THEN '<s>' || text || '</s>' ELSE text END
      AS text FROM documents)""")
def p14_p15_prompt_target(spark, sf_dir) -> DataFrame:
    """The two prompts of a text; P15: its target forms (a third of the
    texts come wrapped already)."""
    c = F.col
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").select(
        "doc_id", "lang", F.coalesce("source", L("")).alias("source"), F.when(
            c("doc_id") % 3 == 0, F.concat(L("<s>"), "text", L("</s>"))).otherwise(c("text")).alias("text"))
    task = F.concat(L("Translate English to "), "lang", L(" : ["), "source", L("] "), "text")
    wrapped = F.when(F.startswith("text", L("<s>")), c("text")).otherwise(F.concat(L("<s>"), "text", L("</s>")))
    return d.select("doc_id", F.md5(F.concat("source", L(" : "), "text")).alias("plain_prompt"),
                    F.md5(task).alias("task_prompt"), F.md5(wrapped).alias("wrapped"),
                    F.md5(F.concat(L("</s> <s>"), "text", L("</s>"))).alias("shifted"),
                    F.md5(F.replace("text", L("\n"), L(" \n "))).alias("spaced"))


def mark_spans(tokens, first_start, first_end, first_mark, second_start, second_end, second_mark):
    """Tokens with marks around two spans (inclusive ends, in order), and
    the text they join to (T7)."""
    def part(start, stop):
        return F.slice(tokens, start + 1, F.greatest(stop - start, L(0)))

    marked = F.concat(part(L(0), first_start), F.array(first_mark), part(first_start, first_end + 1), F.array(first_mark),
                      part(first_end + 1, second_start), F.array(second_mark), part(second_start, second_end + 1),
                      F.array(second_mark), part(second_end + 1, F.size(tokens)))
    return F.array_join(marked, " ")


_SPANS = "list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')"


@query("l15_entity_marks", f"""
SELECT doc_id, md5(array_to_string(t[1:1] || [m1] || t[2:3] || [m1] || t[4:4] || [m2] || t[5:5] || [m2] || t[6:], ' '))
  AS context, '<triplet> ' || CASE WHEN m1 = '@' THEN array_to_string(t[2:3], ' ') || ' <subj> ' || t[5]
  ELSE t[5] || ' <subj> ' || array_to_string(t[2:3], ' ') END || ' <obj> near' AS triplet
FROM (SELECT doc_id, {_SPANS} AS t, CASE WHEN doc_id % 2 = 0 THEN '@' ELSE '#' END AS m1,
             CASE WHEN doc_id % 2 = 0 THEN '#' ELSE '@' END AS m2 FROM documents) WHERE len(t) >= 6""")
def l15_entity_marks(spark, sf_dir) -> DataFrame:
    """Marks around the subject (@) and object (#) spans of a text, in
    either order, and its single triplet."""
    tokens = F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "")
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tokens.alias("t")).where(F.size("t") >= 6)
    subject_first = F.col("doc_id") % 2 == 0
    m1, m2 = F.when(subject_first, "@").otherwise("#"), F.when(subject_first, "#").otherwise("@")
    two, one = F.array_join(F.slice("t", 2, 2), " "), F.get("t", L(4))
    subject, object_ = F.when(subject_first, two).otherwise(one), F.when(subject_first, one).otherwise(two)
    return d.select("doc_id", F.md5(mark_spans(F.col("t"), L(1), L(2), m1, L(4), L(4), m2)).alias("context"),
                    F.concat(L("<triplet> "), subject, L(" <subj> "), object_, L(" <obj> near")).alias("triplet"))


def sentence_windows(docs: DataFrame) -> DataFrame:
    """Sentences of a text with their character offsets, a sentence
    joined to the next where an entity straddles its end.  Entities are runs of
    capitalised words, which may pass a full stop.  Row-local: one pass over a
    text's sentences, so no shuffle whatever the text's length."""
    sentence = r"(?s).*?[.!?](?=\s|$)|(?s).+"
    entity = r"[A-Z][a-z]+(?:[.]?\s[A-Z][a-z]+)+"

    def placed(matches, gaps):
        """(start, end, text) of matches, from the lengths of what lies between."""
        def add(st, i):
            start = st["at"] + F.char_length(F.get(gaps, i))
            end = start + F.char_length(F.get(matches, i))
            return F.struct(end.alias("at"), F.concat(st["out"], F.array(F.struct(
                start.alias("start"), end.alias("end"), F.get(matches, i).alias("text")))).alias("out"))
        none = F.array().cast("array<struct<start:int,end:int,text:string>>")
        return F.when(F.size(matches) == 0, none).otherwise(F.aggregate(
            F.sequence(L(0), F.greatest(F.size(matches) - 1, L(0))), F.struct(L(0).alias("at"), none.alias("out")), add,
            lambda st: st["out"]))

    d = docs.select("doc_id", F.regexp_extract_all("text", L(sentence), 0).alias("s"),
                    F.regexp_extract_all("text", L(entity), 0).alias("e"), F.split("text", entity, -1).alias("g"))
    d = d.select("doc_id", placed(F.col("s"), F.transform("s", lambda _: L(""))).alias("s"),
                 placed(F.col("e"), F.col("g")).alias("e"))

    def window_part(x):
        """A sentence with what begins in it, so that only its own entities travel."""
        return F.struct(x["start"].alias("start"), x["end"].alias("stop"),
                        F.exists("e", lambda y: (y["start"] < x["end"]) & (x["end"] < y["end"])).alias("open"),
                        F.filter("e", lambda y: (x["start"] <= y["start"]) & (y["start"] < x["end"])).alias("begun"))

    return d.select("doc_id", F.posexplode(F.transform("s", window_part)).alias("pos", "x")).select("doc_id", "pos", "x.*")


@query("w9_j9_sentence_windows")
def w9_j9_sentence_windows(spark, sf_dir) -> DataFrame:
    """Windows of sentences that no entity straddles, with the
    entities inside them by start.  A text's windows are numbered by a running
    count, bounded by the text."""
    rows = sentence_windows(table(spark, sf_dir, "documents", "doc_id", "text"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    grouped = rows.withColumn("window", F.coalesce(F.sum((~F.col("open")).cast("int")).over(before), L(0)))
    return grouped.groupBy("doc_id", "window").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(L(1)).alias("n_sentences"),
        F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("begun"))), lambda x: F.concat_ws(
            ":", x["start"].cast("string"), x["end"].cast("string"), x["text"])), "|").alias("entities"))


_TOKENS = "SELECT lang, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS token FROM documents"


def _vocabulary(spark, sf_dir) -> DataFrame:
    words = F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents", "text", "lang").select("lang", F.explode(words).alias("token"))


@query("a19_token_frequency", f"SELECT lang, token, count(*) AS n FROM ({_TOKENS}) GROUP BY lang, token")
def a19_token_frequency(spark, sf_dir) -> DataFrame:
    """How often each token occurs, by language."""
    return _vocabulary(spark, sf_dir).groupBy("lang", "token").agg(F.count(L(1)).alias("n"))


_SPECIAL = ("<s>", "[", "]", "|", "the")


@query("u1_u2_vocabulary", f"""
WITH d AS ({_TOKENS}), c AS (SELECT unnest(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS token
  FROM conversations)
SELECT token, false AS special FROM ((SELECT token FROM d UNION SELECT token FROM c) EXCEPT
  SELECT token FROM (VALUES {", ".join(f"('{s}')" for s in _SPECIAL)}) v(token))
UNION ALL SELECT token, true FROM (VALUES {", ".join(f"('{s}')" for s in _SPECIAL)}) v(token)""")
def u1_u2_vocabulary(spark, sf_dir) -> DataFrame:
    """The vocabularies of documents and conversations as one; U2: without
    the special tokens, which are then added as such."""
    words = F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "")
    said = table(spark, sf_dir, "conversations", "text").select(F.explode(words).alias("token"))
    both = _vocabulary(spark, sf_dir).select("token").union(said).distinct()
    special = spark.createDataFrame([(s,) for s in _SPECIAL], "token string")
    return (both.join(F.broadcast(special), "token", "left_anti").select("token", L(False).alias("special"))
            .unionByName(special.select("token", L(True).alias("special"))))


def _predictions(folds: DataFrame) -> DataFrame:
    """What each fold's model says of each row: its class, wrong on some ids."""
    each = folds.withColumn("model", F.explode(F.sequence(L(0), L(K - 1))))
    wrong = F.col("doc_id") % (F.col("model") + 3) == 0
    return each.withColumn("pred", F.when(wrong, 1 - F.col("quality")).otherwise(F.col("quality")))


_PRED = (f"SELECT *, CASE WHEN doc_id % (model + 3) = 0 THEN 1 - quality ELSE quality END AS pred FROM (SELECT doc_id, quality, "
         f"CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % {K} AS INTEGER) AS fold FROM labels) "
         f"CROSS JOIN range({K}) r(model)")


@query("o7_out_of_fold", f"SELECT doc_id, fold, pred FROM ({_PRED}) WHERE model = fold")
def o7_out_of_fold(spark, sf_dir) -> DataFrame:
    """Every row's prediction by the model that did not train on it."""
    return _predictions(o6_stratified_kfold(spark, sf_dir)).where("model = fold").select("doc_id", "fold", "pred")


@query("o8_ensemble", f"SELECT doc_id, array_to_string(list(pred ORDER BY model), ',') AS preds, round(avg(pred), 6) AS mean, "
                      f"CASE WHEN 2 * sum(pred) > {K} THEN 1 ELSE 0 END AS vote FROM ({_PRED}) GROUP BY doc_id")
def o8_ensemble(spark, sf_dir) -> DataFrame:
    """All models' predictions of a row stacked, their mean and vote."""
    stacked = F.array_sort(F.collect_list(F.struct("model", "pred")))  # one entry a model
    return _predictions(o6_stratified_kfold(spark, sf_dir)).groupBy("doc_id").agg(
        F.array_join(F.transform(stacked, lambda x: x["pred"].cast("string")), ",").alias("preds"),
        F.round(F.avg("pred"), 6).alias("mean"), F.when(2 * F.sum("pred") > K, 1).otherwise(0).alias("vote"))

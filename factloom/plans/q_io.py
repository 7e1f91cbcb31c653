"""Sources, sinks (S1, S2, S9–S12) and streaming (ST1–ST3) queries.  Each
writes into the shared checkpoint folder and returns what it reads back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from factloom.plans import q_build, q_codec, q_history
from factloom.plans.catalog import ORACLE, query
from factloom.plans.oracle import with_facts
from factloom.sources import files as FS
from factloom.sources.derived import entity_facts, long_triples
from factloom.streaming import jobs as ST


@query("st1_windowed_scores",
       "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, "
       "round(sum(value / (value + 20)), 6) AS metric_sum FROM events GROUP BY 1, 2")
def st1_windowed_scores(spark, sf_dir):
    return ST.epoch_scores(spark, sf_dir)


@query("st2_online_saturation",
       "SELECT user_id AS run, strftime(min(ts) FILTER (WHERE value / (value + 20) > 0.9), '%Y-%m-%d %H:%M:%S.%f')"
       " AS first_sat, count(*) FILTER (WHERE value / (value + 20) > 0.9) AS n_sat, count(*) AS n "
       "FROM events GROUP BY user_id")
def st2_online_saturation(spark, sf_dir):
    return ST.online_saturation(spark, sf_dir)


@query("st2_run_state", """
WITH r AS (SELECT user_id AS run, row_number() OVER w - 1 AS step,
    CASE WHEN event_type <> 'error' THEN value / (value + 20) END AS m FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT run, min(step) FILTER (WHERE m > 0.9) AS first_sat FROM r GROUP BY run)
SELECT run, count(*) AS n_steps, max(first_sat) AS first_sat_step,
  round(max(m) FILTER (WHERE step = first_sat), 6) AS sat_value,
  count(*) FILTER (WHERE step > first_sat AND m < 0.9) AS n_broken,
  max(step) FILTER (WHERE step > first_sat AND m < 0.9) AS last_broken_step,
  round(arg_max(m, step) FILTER (WHERE m IS NOT NULL), 6) AS last_value
FROM r JOIN f USING (run) GROUP BY run""")
def st2_run_state(spark, sf_dir):
    """ST2: saturation and broken steps of every run as keyed state."""
    r = ST.run_saturation(spark, sf_dir)
    return r.withColumns({c: F.round(c, 6) for c in ("sat_value", "last_value")})


@query("st3_sample_log",
       "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events "
       "WHERE ((event_id // 4) + 1) % 100 = 0")
def st3_sample_log(spark, sf_dir):
    return ST.sample_log(spark, sf_dir)


@query("s1_entity_map_source", with_facts(
    "SELECT s AS ent, p AS prop, CAST(row_number() OVER (PARTITION BY s, p ORDER BY o) - 1 AS INTEGER) AS pos, "
    "o AS value FROM facts"))
def s1_entity_map_source(spark, sf_dir):
    """entity→property→values JSON written, then scanned back (P10 keeps
    all values here; the first is ``pos = 0``)."""
    path = FS.scratch(spark, "entity_maps")
    FS.write_entity_maps(long_triples(entity_facts(spark, sf_dir)), path)
    return FS.read_entity_maps(spark, path)


@query("s11_s9_corpus_sink_source", with_facts(
    "SELECT sp.ex_id, e.text, e.syntax, sp.split FROM sp JOIN (" + q_codec.encode_select(["tags", "list"]) +
    ") e ON sp.ex_id = e.ex_id WHERE e.syntax = 'tags'", q_build.SPLIT_CTES + "," + q_codec.FLAGS_CTE.strip()))
def s11_s9_corpus_sink_source(spark, sf_dir):
    """S11 partitioned JSON corpus (syntax, split), read back with partition
    pruning on syntax (S2/S9/S10: split and syntax from the layout)."""
    split = q_build.sample_and_split(spark, sf_dir).select("ex_id", "split")
    enc = q_codec._encoded(spark, sf_dir, ["tags", "list"])
    corpus = enc.join(split, "ex_id")
    path = FS.scratch(spark, "corpus")
    FS.write_corpus(corpus, path)
    return FS.read_corpus(spark, path).where(F.col("syntax") == "tags").select("ex_id", "text", "syntax", "split")


@query("s12_result_csv_sink", ORACLE["a17_a18_global_score_ranking"])
def s12_result_csv_sink(spark, sf_dir):
    """The ranked result table as CSV with header, read back typed."""
    df = q_history.a17_a18_global_score_ranking(spark, sf_dir)
    path = FS.scratch(spark, "results_csv")
    FS.write_table_csv(df, path)
    return spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)) \
        .option("header", True).csv(os.path.join(path))

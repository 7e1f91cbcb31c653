"""What a row or a query needs more than once is computed once, and work is spread by rows."""

from pyspark.sql import functions as F

from factloom.functions.vocab import SYNTAXES
from factloom.operators import decode as D
from factloom.operators import encode as E
from factloom.plans import q_build, q_relations
from factloom.sources import runs
from factloom.sources.derived import FACTS

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_parsed_once(spark):
    text = spark.createDataFrame([("x",)], "t string")
    plan = _plan(D.decode_into(text, "t", "json-ld", "d").select("d_triples"))
    assert plan.lower().count("from_json") <= 3  # the text, its types, a property's values
    both = D.decode_by_column(text.withColumn("syn", F.lit("turtle").substr(1, 9)), "t", "syn", SYNTAXES, "d")
    plan = _plan(both.select("d_triples"))
    assert plan.count("regexp_extract_all(array_join(") == 1  # one branch for the Turtle family


def test_list_facto_names_a_subject_once(spark):
    facts = spark.createDataFrame([([("a", "type", "T", None), ("a", "p", "1", "x"), ("a", "p", "2", "x"), ("b'", "p", "3", "x")],)],
                                  f"f {FACTS.simpleString()}")
    assert facts.select(E.list_facto(F.col("f"))).first()[0] == (
        "[['a', [['type', 'T'], ['p', ['1', '2']]]], [\"b'\", [['p', '3']]]]")
    assert _plan(facts.select(E.list_facto(F.col("f")).alias("x"))).count("filter(f#") <= 2


def test_corpus_joins_run_once(spark):
    assert "extract" not in _plan(q_build.conformance(q_build.kept_facts(spark, SF)))
    assert _plan(q_build.v1_v3_conformance(spark, SF)).count("parquet") == 0


def test_turns_are_spread_by_rows(spark, monkeypatch):
    monkeypatch.setattr(q_relations, "_TURNS_PER_TASK", 5)
    pairs = q_relations._turn_pairs(spark, SF)
    turns = spark.read.parquet(f"{SF}/conversations.parquet").count()
    assert pairs.rdd.getNumPartitions() == max(4, -(-turns // 5))


def test_lines_are_numbered_where_they_are(spark, tmp_path):
    for name, lines in (("b", ["x", "", "y"]), ("a", ["k"] * 3000), ("c", [])):
        (tmp_path / f"{name}.txt").write_text("".join(f"{x}\n" for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # several blocks a file
    try:
        got = runs.numbered_lines(spark, str(tmp_path), "v")
        assert sorted(map(tuple, got.collect())) == list(enumerate(["k"] * 3000 + ["x", "", "y"]))
        assert "RepartitionByExpression" not in _plan(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)

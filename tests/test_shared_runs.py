"""What several syntaxes ask of a fact is found once; the texts are the same."""

from pyspark.sql import functions as F

from factloom.functions.vocab import SYNTAXES
from factloom.operators import encode as E
from factloom.sources.derived import FACTS


def test_facts_with_runs_give_the_same_texts(spark):
    rows = [[], None, [("a", "type", "T", None), ("a", "p", 'v"\\', "xsd:string"), ("a", "p", "<&>", "xsd:date"), ("b", "p", "1", "xsd:gYear")],
            [("a", None, "x", None), (None, "p", None, "xsd:string")]]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(rows)], f"i int, f {FACTS.simpleString()}")
    fanned = df.select("i", E.with_runs(F.col("f")).alias("f")).select("*", F.explode(F.array(*map(F.lit, SYNTAXES))).alias("syn"))
    known = {(r.i, r.syn): r.t for r in E.encode_by_column(fanned, "f", "syn", SYNTAXES, "t", known=True).collect()}
    assert len(known) == len(rows) * len(SYNTAXES)
    for syn in SYNTAXES:
        for r in E.encode_into(df, "f", syn, "t").collect():
            assert known[r.i, syn] == r.t

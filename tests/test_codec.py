"""Round trip per syntax (decode ∘ encode = identity) and the unparseable
guard, on the sf0.001 entity facts; plus worked strings in the sample
layouts."""

import pytest
from pyspark.sql import functions as F

from factloom.functions.vocab import SYNTAXES
from factloom.operators import decode as D
from factloom.operators import encode as E
from factloom.sources.derived import entity_facts

from conftest import SF


@pytest.fixture(scope="module")
def facts(spark):
    return entity_facts(spark, SF).cache()


@pytest.mark.parametrize("syntax", SYNTAXES)
def test_round_trip(spark, facts, syntax):
    df = E.encode_into(facts, "facts", syntax, "t")
    df = D.decode_into(df, "t", syntax, "d")
    exp = F.array_sort(F.transform("facts", lambda f: F.struct(f.s.alias("s"), f.p.alias("p"), f.o.alias("o"))))
    r = df.select(F.sum((exp == F.array_sort("d_triples")).cast("int")).alias("eq"),
                  F.count_if("d_parsed").alias("parsed"), F.count(F.lit(1)).alias("n")).first()
    assert r.n > 0 and r.eq == r.n and r.parsed == r.n


@pytest.mark.parametrize("syntax", SYNTAXES)
def test_reversed_text_is_unparsed(spark, facts, syntax):
    df = E.encode_into(facts, "facts", syntax, "t").withColumn("t", F.reverse("t"))
    df = D.decode_into(df, "t", syntax, "d")
    assert df.where("d_parsed").count() == 0


def _one(spark, text, syntax):
    df = spark.createDataFrame([(text,)], "t string")
    return D.decode_into(df, "t", syntax, "d").select("d_triples", "d_parsed").first()


def test_sample_layouts(spark):
    tags = "<subj>Mill_Pond<rel>type<obj>Lake<et><subj>Mill_Pond<rel>label<obj>Mill Pond<et>"
    r = _one(spark, tags, "tags")
    assert r.d_parsed and [tuple(x) for x in r.d_triples] == [
        ("Mill_Pond", "type", "Lake"), ("Mill_Pond", "label", "Mill Pond")]
    lf = "[['Old_Ferry', [['type', 'Ship'], ['label', 'Old Ferry'], ['alias', ['F1', 'F2']]]]]"
    r = _one(spark, lf, "list_facto")
    assert [tuple(x) for x in r.d_triples][-2:] == [("Old_Ferry", "alias", "F1"), ("Old_Ferry", "alias", "F2")]
    ts = ':Red_Kite a :Bird ;\n   :label "Red Kite"^^xsd:string ;\n   :seen "2001-05-09"^^xsd:date .'
    r = _one(spark, ts, "turtleS_1datatype_0inLine_1facto")
    assert [tuple(x) for x in r.d_triples] == [("Red_Kite", "type", "Bird"), ("Red_Kite", "label", "Red Kite"),
                                               ("Red_Kite", "seen", "2001-05-09")]
    tf = "<subj>Red_Kite<rel>type<obj>Bird<rel>alias<obj>K1<obj>K2<et>"
    r = _one(spark, tf, "tags_facto")
    assert r.d_parsed and [tuple(x) for x in r.d_triples] == [
        ("Red_Kite", "type", "Bird"), ("Red_Kite", "alias", "K1"), ("Red_Kite", "alias", "K2")]
    for wrong in ("<subj>A<obj>x<et>", "<subj>A<rel>p<rel>q<obj>x<et>", "<subj>A<rel>p<obj>x", "<rel>p<obj>x<et>"):
        assert not _one(spark, wrong, "tags_facto").d_parsed
    bad = "<subj>A<rel>label<obj>x<obj>y<et>"
    assert not _one(spark, bad, "tags").d_parsed

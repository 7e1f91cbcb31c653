"""Focus properties, node kinds, batched functions and corpora by name on hand cases."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions.vocab import ONTOLOGY_NS
from factloom.operators import focus
from factloom.operators.batched import corpus, map_examples
from factloom.operators.validation import kind_ok, object_kind, shape_report
from factloom.sources.derived import shape_df

HASH = ONTOLOGY_NS + "#"


def test_focus_takes_first_values_of_own_names(spark):
    values = spark.createDataFrame([
        ("a", HASH + "x", 1, "second"), ("a", HASH + "x", 0, "first"), ("a", ONTOLOGY_NS + "x", 0, "plain"), ("a", "y", 0, "other"),
        ("b", ONTOLOGY_NS + "x", 0, "alias only"), ("c", ONTOLOGY_NS + "x", 0, "alias"), ("c", ONTOLOGY_NS + "z", 0, "own"),
        ("d", HASH + "x", 0, "no abstract"), ("e", HASH + "x", 0, "braces"), ("f", HASH + "x", 0, "short"),
        (None, HASH + "x", 0, "nobody"), ("a", HASH + "x", 0, "first")], "ent string, prop string, pos int, value string")
    abstracts = spark.createDataFrame([("a", "long enough"), ("b", "long enough"), ("c", "long enough"), ("c", "long again"), ("d", None),
                                       ("e", "has {{ braces"), ("f", "short")], "ent string, abstract string")
    got = focus.focused(values, [HASH + "x", ONTOLOGY_NS + "z"], abstracts).collect()
    assert sorted(tuple(r) for r in got) == [("a", ONTOLOGY_NS + "x", "first"), ("c", ONTOLOGY_NS + "x", "alias"),
                                             ("c", ONTOLOGY_NS + "z", "own")]
    assert focus.focused(values.limit(0), [HASH + "x"], abstracts).count() == 0


def test_node_kinds(spark):
    df = spark.createDataFrame([("1", "xsd:string"), ("dbr:a", None), ("_:a", None)], "o string, dt string")
    wanted = [None, "IRI", "sh:Literal", "BlankNode", "BlankNodeOrIRI", "http://www.w3.org/ns/shacl#IRIOrLiteral", "Odd"]
    kinds = df.select("o", *[kind_ok(object_kind(F.col("o"), F.col("dt")), F.lit(w)).alias(str(i)) for i, w in enumerate(wanted)])
    assert {r.o: list(r)[1:] for r in kinds.collect()} == {
        "1": [True, False, True, False, False, True, False], "dbr:a": [True, True, False, False, True, True, False],
        "_:a": [True, False, False, True, True, False, False]}


def test_report_names_the_kind_first(spark):
    rows = [(1, "label", "n", "xsd:string"), (1, "segment", "dbr:s", None), (1, "nation", "dbr:n", None),
            (1, "firstOrderDate", "2020-01-01", "xsd:date"), (1, "firstOrderYear", "2020", "xsd:gYear")]
    typed = spark.createDataFrame(rows, "ex_id long, p string, o string, dt string")
    failed = {r.path: r.failed_rule for r in shape_report(typed, shape_df(spark)).collect() if r.failed_rule}
    assert failed == {"dbo:nation": "nodeKind", "dbo:segment": "datatype"}
    assert not [r for r in shape_report(typed.drop("dt"), shape_df(spark)).collect() if r.failed_rule]


def test_batched_map(spark):
    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        assert 0 < len(frame) <= 7 and list(frame.index) == list(range(len(frame)))
        even = frame[frame["id"] % 2 == 0]
        return pd.concat([even, even]).assign(twice=lambda x: x["id"] * 2)

    got = map_examples(spark.range(0, 100, numPartitions=3), fn, "id long, twice long", batch_rows=7)
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, 2 * i) for i in range(0, 100, 2)] * 2)
    assert map_examples(spark.range(0), fn, "id long, twice long").count() == 0
    with pytest.raises(ValueError):
        map_examples(spark.range(1), fn, "id long", batch_rows=0)


def test_corpus_by_unknown_name(spark):
    with pytest.raises(ValueError, match="conll04"):
        corpus(spark, "nothing", "/nowhere")

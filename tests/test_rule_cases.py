"""Hand cases of rules on which an operator and its SQL twin could share a mistake."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as TX
from factloom.operators import decode as D
from factloom.operators import history as H
from factloom.operators.ordering import row_index
from factloom.session import checkpoint_dir


def test_early_stop_needs_strict_improvement(spark):
    tie = [("a", e, v) for e, v in enumerate([1.0] + [0.5] * 7)]
    better = [("b", e, 1.0 - e / 100) for e in range(12)]
    gap = [("c", e, v) for e, v in enumerate([0.3, None, 0.4, 0.3, 0.3, None, 0.29, 0.3])]
    df = spark.createDataFrame(tie + better + gap, "run string, epoch int, val_loss double")
    for parts in (1, 5):
        got = {r.run: r.stop_epoch for r in H.early_stop_epoch(df, ["run"], "val_loss", 5, parts).collect()}
        assert got == {"a": 6, "b": None, "c": 5}


def test_fold_modes_with_missing_fold(spark):
    df = spark.createDataFrame([("m", f, float(f + 1)) for f in range(4)], "model string, fold int, v double")
    got = {r.mode: r.value for r in H.fold_modes(df, ["model"], "v", 5).collect()}
    assert got == {"STRICT": None, "WISE": 2.5, "NAIVE": 2.0}
    sums = {r.mode: r.v for r in H.fold_sums(df, ["model"], ["v"], 5).collect()}
    assert sums == {"STRICT": None, "WISE": 10, "NAIVE": 10}


def test_truncation_drops_the_last_part(spark):
    df = spark.createDataFrame([("one two. three four......", 0), ("one two. three four......", 100), ("abc", 0),
                                ("a b c d e f g", 0), ("a. b. c. d. e. f", 1)], "t string, o int")
    got = [r.out for r in TX.truncate_to_budget(df, "t", 6, F.col("o"), "out").collect()]
    assert got == ["one two", "", "abc", "", "a. b. c"]


def test_row_index_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("k", 1), ("k", 2)], "k string, o int")
    got = sorted((str(r.k), r.o, r.i) for r in row_index(df, ["k"], ["o"], out="i", partitions=3).collect())
    assert got == [("None", 1, 0), ("None", 2, 1), ("k", 1, 0), ("k", 2, 1)]


def test_plain_tokens_drop_only_sequence_markers(spark):
    df = spark.createDataFrame([("<s><triplet> a<pad> <subj> b <obj> c</s><pad>",)], "t string")
    assert df.select(D.plain_tokens(F.col("t")).alias("x")).first().x == ["<triplet>", "a", "<subj>", "b", "<obj>", "c"]


def test_sentences_keep_control_characters(spark):
    df = spark.createDataFrame([("One.\u0001 Two.  Three. ",)], "t string")
    assert df.select(TX.sentences(F.col("t")).alias("x")).first().x == ["One.\u0001 Two.", "Three.", ""]


def test_unset_checkpoint_folder_is_an_error():
    class Unset:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        checkpoint_dir(Unset)


def test_relations_from_markers(spark):
    from factloom.operators import markers as M

    cases = {
        "<s><triplet> a b <subj> c <obj> r s <subj> d <obj> q <triplet> e <subj> f <obj> r</s><pad>":
            [("a b", "c", "r s"), ("a b", "d", "q"), ("e", "f", "r")],
        "<triplet> a <subj> b <obj>": [], "": [], "a b": [],
        "<triplet> a <subj> b <obj> r <triplet> c <subj> d": [("a", "b", "r")],
        "<triplet> a <subj> b <obj> r <subj> c": [("a", "b", "r"), ("a", "c", "r")],
        # a head without a tail of its own keeps the last one; a type waits for the next marker
        "<triplet> a <subj> b <obj> r <triplet> c <obj> q": [("a", "b", "r"), ("c", "b", "q")],
        "x <obj> r <subj> b": [("", "", "r")], "<subj> b <obj> r": [], "<triplet> <subj> b <obj> r <triplet>": [("", "b", "r")],
        "<triplet> a <subj> b <obj> r <obj> q": [("a", "b", "q")], "a<subj>b <triplet> c<obj> d": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", M.extract(F.col("t")).alias("x"))
    assert {r.t: [tuple(x) for x in r.x] for r in df.collect()} == cases
    types = {"Peop": "<peop>", "Loc": "<loc>"}
    typed = "<triplet> a <peop>  b <loc> r <peop> c <peop> q <triplet> d <loc>  e <loc> r"
    row = spark.createDataFrame([(typed,)], "t string").select(M.extract_typed(F.col("t"), types).alias("x")).first()
    assert [tuple(x) for x in row.x] == [("a", "Peop", "b", "Loc", "r"), ("a", "Peop", "c", "Peop", "q"), ("d", "Loc", "e", "Loc", "r")]
    odd = {
        "<peop> r <loc> b <peop> q": [("", "", "", "Peop", "r")], "": [], "<triplet> a <peop> b": [],
        "<triplet> a <peop> b <loc> r <peop> c": [("a", "Peop", "b", "Loc", "r"), ("a", "Peop", "c", "Loc", "r")],
        "<triplet> a <peop> <loc> r <triplet> d": [("a", "Peop", "", "Loc", "r")], "<triplet> a <peop> <loc> r": [],
    }
    df = spark.createDataFrame([(t,) for t in odd], "t string").select("t", M.extract_typed(F.col("t"), types).alias("x"))
    assert {r.t: [tuple(x) for x in r.x] for r in df.collect()} == odd


def test_overlap_scores(spark):
    from factloom.functions import overlap as OV

    rows = [("abcd", ["abcd"], 1.0), ("abc", ["abc"], 0.0), ("abcde", ["abcdf"], 0.2 ** 0.25), ("a b c d", ["abcd"], 1.0),
            ("abcdabcd", ["abcd", "zzzzzzzz"], (4 / 8 * 3 / 7 * 2 / 6 * 1 / 5) ** 0.25), ("wxyz", ["abcd"], 0.0)]
    df = spark.createDataFrame(rows, "p string, r array<string>, want double")
    for r in df.select("want", OV.char_bleu(F.col("p"), F.col("r")).alias("got")).collect():
        assert abs(r.got - r.want) < 1e-9
    df = spark.createDataFrame([("A b, c", "a b d"), ("", "a"), ("a a a", "a")], "p string, r string")
    got = [(round(r.x, 6), round(r.y, 6)) for r in df.select(
        OV.rouge_n(F.col("p"), F.col("r"), 1).alias("x"), OV.rouge_n(F.col("p"), F.col("r"), 2).alias("y")).collect()]
    assert got == [(0.666667, 0.5), (0.0, 0.0), (0.5, 0.0)]


def test_common_runs_as_multisets(spark):
    import random
    from collections import Counter

    from factloom.functions import overlap as OV

    rng = random.Random(3)
    units = ["a", "b", "", "\x1e", "a\x1e0", "é"]
    rows = [([rng.choice(units) for _ in range(rng.randrange(12))],
             [[rng.choice(units) for _ in range(rng.randrange(12))] for _ in range(rng.randrange(3))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "p array<string>, r array<array<string>>")
    for r in df.select("p", "r", OV.clipped(F.col("p"), F.col("r")).alias("n")).collect():
        most = Counter()
        for ref in r.r:
            most |= Counter(ref)
        assert r.n == sum((Counter(r.p) & most).values())


def test_sentence_windows_against_brute_force(spark):
    import re

    from factloom.plans.q_corpora import w9_j9_sentence_windows

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        sentences = [m.span() for m in re.finditer(r"(?s).*?[.!?](?=\s|$)|(?s:.+)", r.text, re.ASCII)]
        entities = [(*m.span(), m[0]) for m in re.finditer(r"[A-Z][a-z]+(?:[.]?\s[A-Z][a-z]+)+", r.text, re.ASCII)]
        windows, group = [], []
        for start, stop in sentences:
            group.append((start, stop))
            if not any(a < stop < b for a, b, _ in entities):
                windows.append(group)
                group = []
        for i, g in enumerate(windows + ([group] if group else [])):
            inside = [e for e in entities if any(a <= e[0] < b for a, b in g)]
            want[r.doc_id, i] = (g[0][0], g[-1][1], len(g), "|".join(f"{a}:{b}:{t}" for a, b, t in inside))
    got = {(r.doc_id, r.window): (r.start, r.stop, r.n_sentences, r.entities) for r in w9_j9_sentence_windows(spark, sf).collect()}
    assert got == want and any(v[2] > 1 for v in want.values())


def test_shift_left_and_flat_words(spark):
    from factloom.functions import text as TX

    df = spark.createDataFrame([([5, 6, 7], [["a", "b"], [], ["c"]]), ([4], [[]]), ([], [])], "i array<int>, s array<array<string>>")
    got = [(r.x, r.y) for r in df.select(TX.shift_left(F.col("i")).alias("x"), TX.flat_words(F.col("s")).alias("y")).collect()]
    assert got == [([6, 7, 0], "a b c"), ([0], ""), ([], "")]


def test_work_partitions_follow_the_rows(spark, monkeypatch):
    from factloom.sources import derived

    assert derived.work_partitions(spark.range(10)) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(derived, "ROWS_PER_TASK", 10)
    assert derived.work_partitions(spark.range(1001)) == 101

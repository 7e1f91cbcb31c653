import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import components, license_scan, ngram_jaccard, quality, toxicity, vantage
from factloom.llm.shingles import shingle_sets


def _grams(text, width=4):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def _components(rows, percent=85):
    sets = [(i, _grams(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_shingles_equal_sets_of_words():
    texts = ["", None, "a b c", "a b c d", " A b\tc  d e\n", "x", "a b c d e f g a b c d", "é ü ß 中 文 字", "x y z"]
    got = [set(s.tolist()) for s in shingle_sets(pa.array(texts), 4)]
    want = [_grams(t) for t in texts]
    for a, x in zip(got, want):
        for b, y in zip(got, want):
            assert len(a & b) == len(x & y) and len(a) == len(x)


@pytest.mark.parametrize("rounds, wide", [(0, 16), (4, 4), (0, 1)])
def test_jaccard_join_against_all_pairs(docs_of, monkeypatch, rounds, wide):
    monkeypatch.setattr(ngram_jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_jaccard, "WIDE", wide)
    monkeypatch.setattr(ngram_jaccard, "SPARE", 0)
    monkeypatch.setattr(ngram_jaccard, "LEAST", 3)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    common = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = [None, "", "a", "a b", "A  b", "a b c"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words) + (" " + common if rng.random() < 0.3 else ""))
    base = [rng.choice(vocabulary) for _ in range(150)]
    for k in range(60):  # one large group of near copies, most within reach of each other
        words = list(base)
        words[rng.randrange(150)] = f"z{k}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in ngram_jaccard.join(docs_of(rows)).collect()}
    assert {i: got[i].component_id for i, _ in rows} == _components(rows)
    assert all(got[i].n_shingles == len(_grams(t)) for i, t in rows)


def test_jaccard_odd_rows(odd_docs):
    rows = ngram_jaccard.join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.doc_id is None} == {5}
    assert ngram_jaccard.join(odd_docs.limit(0)).count() == 0


def test_components(spark):
    labels = spark.createDataFrame([(i, i) for i in range(40)], "id long, label long")
    chain = [(i, i + 1) for i in range(0, 19)] + [(30, 25), (39, 30), (25, 39)]
    got = {r.id: r.label for r in components.merge(labels, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 if i < 20 else 25 if i in (25, 30, 39) else i for i in range(40)}


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, query long, shard long").repartition(3)


def test_nearest_exact_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD", 150)
    monkeypatch.setattr(vantage, "BLOCK", 16)
    monkeypatch.setattr(vantage, "LEAF", 8)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)).astype(np.float32).round(1)
    x[100:300] = x[100]  # one vector of many rows
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]
    rows += [(900, None, 0, 0), (901, [0.0] * 6, 0, 0), (902, [float("nan")] * 6, 0, 0), (903, [None] * 6, 0, 0),
             (904, [float("inf")] * 6, 0, 0), (None, x[0].tolist(), 0, 0), (5, x[5].tolist(), 0, 0)]
    vectors = _vectors(spark, rows)
    alive = {i for i, v in enumerate(x) if v.any()}

    def run(relax):
        found = vantage.search(vectors, vectors.filter("vec_id % 20 = 0"), 20, relax).collect()
        out = {}
        for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
            out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        return out

    exact, hits, total = run(1.0), 0, 0
    assert set(exact) == {i for i in alive if i % 20 == 0}
    for q, found in exact.items():
        scores = x.astype(float) @ x[q].astype(float)
        want = sorted((-scores[i], i) for i in alive if i != q)[:20]
        assert [round(s, 9) for _, s in found] == [round(-s, 9) for s, _ in want]
        assert len({i for i, _ in found}) == 20 and q not in {i for i, _ in found}
    for q, found in run(1.5).items():
        hits += len({i for i, _ in found} & {i for i, _ in exact[q]})
        total += 20
    assert hits >= 0.5 * total
    assert vantage.search(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [10, 25, 16384])
def test_nearest_has_one_dimension_for_the_table(spark, monkeypatch, shard):
    monkeypatch.setattr(vantage, "SHARD", shard)
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=2 if i % 2 else 3).tolist() for i in range(80)} | {100: [1.0, 2.0], 120: [1.0, 0.0, 3.0]}
    vectors |= {101: [2.0, 2.0]}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id IN (1, 20, 33, 100, 120)")
    found = {}
    for r in vantage.search(rows, asked, 5).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    pairs = {i: v for i, v in vectors.items() if len(v) == 2}  # 42 of 83
    want = {q: sorted((i for i in pairs if i != q), key=lambda i: (-np.dot(pairs[q], pairs[i]), i))[:5] for q in (1, 33, 100)}
    assert found == want


@pytest.mark.parametrize("values", [(0, 1), (-1, 0, 1), (0, 0.1, 0.3)])
def test_nearest_ties_of_different_vectors_go_to_the_smaller_id(spark, monkeypatch, values):
    monkeypatch.setattr(vantage, "SHARD", 150)
    monkeypatch.setattr(vantage, "BLOCK", 16)
    monkeypatch.setattr(vantage, "LEAF", 8)
    rng = np.random.default_rng(6)
    x = rng.choice(values, size=(400, 10), p=[0.6, *[0.4 / (len(values) - 1)] * (len(values) - 1)]).astype(np.float32)
    ids = rng.permutation(400)
    rows = [(int(i), v.tolist(), 0, 0) for i, v in zip(ids, x)]
    vectors = _vectors(spark, rows)
    got = {}
    for r in vantage.search(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    of = {int(i): v.astype(float).tolist() for i, v in zip(ids, x) if v.any()}
    assert set(got) == {i for i in of if i % 20 == 0}
    for q, found in got.items():
        want = []
        for i, v in of.items():
            score = 0.0
            for a, b in zip(of[q], v):
                score += a * b
            want += [(-score, i)] if i != q else []
        assert [found[n] for n in range(1, 21)] == [(i, -s) for s, i in sorted(want)[:20]]


def test_toxicity_learns_gapped_insults(docs_of, spark, odd_docs):
    rng = random.Random(1)
    clean = ["the river", "morning light", "letters", "garden", "window", "answer", "station", "yellow", "paper"]
    insults = ["blockhead", "numbskull", "blockheaded"]

    def text(toxic):
        words = [rng.choice(clean) for _ in range(60)]
        if toxic:
            words[rng.randrange(60)] = rng.choice(insults)
        return " ".join(words[:20]) + ". " + " ".join(words[20:]) + "."

    rows = [(i, text(i % 3 == 0)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = docs_of(rows)
    model = toxicity.train(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and all((scored[i] >= toxicity.THRESHOLD) == (i % 3 == 0) for i in held)
    gapped = toxicity.score(docs_of([(1, "you block-head there"), (2, "you blo.ckhead"), (3, "a garden window")]), model)
    assert [r.score >= toxicity.THRESHOLD for r in gapped.orderBy("doc_id").collect()] == [True, True, False]
    odd = toxicity.score(odd_docs, model, score_col="__s", keep_text=True)
    assert odd.columns == [*odd_docs.columns, "__s"] and odd.filter("__s between 0 and 1").count() == odd_docs.count()
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.score(odd_docs, None).filter("score = 0").count() == odd_docs.count()


def test_toxicity_finds_insults_with_inserted_letters():
    rng = random.Random(8)
    insults, lookalikes = ["moron", "idiot", "blockhead"], ["morning", "boron", "idiom", "tradition", "blocked", "blockade"]
    clean = ["river", "light", "letters", "garden", "window", "answer", "station", "yellow", "paper"]

    def text(toxic):
        words = [rng.choice(clean) for _ in range(30)]
        return " ".join(words + [rng.choice(insults)] * toxic) + "."

    model = toxicity.fit([text(i % 2) for i in range(200)], [i % 2 == 1 for i in range(200)])

    def found(words):
        values = model.word_scores()(words)
        p = model.probability(np.array([toxicity.two_highest([v], model.bias) for v in values]))
        return [w for w, x in zip(words, p) if x >= toxicity.THRESHOLD]

    assert all(m in insults or any(i.startswith(m) for i in insults) for m in model.landmarks)
    one = [w[:i] + "x" + w[i:] for w in insults for i in range(1, len(w))]
    two = [w[:i] + "x" + w[i:j] + "z" + w[j:] for w in insults for i in range(1, len(w)) for j in range(i, len(w))]
    assert found(insults + one + two) == insults + one + two
    assert found(lookalikes + clean) == []


def test_license_scan(docs_of, odd_docs):
    texts = ["ünd x. Released under the MIT License.\nmore", "released, UNDER the mit\n license; Licensed under CC BY-SA 4.0",
             "This work is licensed under the GNU General Public License, version 2.",
             "Permission is hereby granted, free of all charge, to any person obtaining a copy of this program and "
             "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
             "without limitation the rights to use, copy, modify, merge, publish, distribute, and/or sell copies of "
             "the Software, and to permit persons to whom the Software is furnished to do so", "the mit license", None]
    got = {}
    for r in license_scan.scan(docs_of(list(enumerate(texts)))).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.coverage, texts[r.doc_id][r.start:r.end]))
    assert got[0] == [("mit-notice", 1.0, "Released under the MIT License")]
    assert [g[0] for g in sorted(got[1])] == ["cc-by-sa-4.0-notice", "mit-notice"]
    assert [g[:2] for g in got[2]] == [("gpl-2.0-notice", 1.0)]
    assert got[3][0][0] == "mit" and 0.8 < got[3][0][1] < 1
    assert set(got) == {0, 1, 2, 3}
    assert license_scan.scan(odd_docs).count() == 0 and license_scan.scan(odd_docs.limit(0)).count() == 0


def test_license_places_where_lower_case_is_longer(docs_of):
    notice = "Released under the MIT License"
    texts = ["\u0130\u0130 x \u0130\u0130 " + notice + ". More \u0130", "\u0130" + " \u0130" * 40 + "\n" + notice.upper() + " \u0130",
             notice.replace("i", "\u0130") + " " + notice]
    got = [(texts[r.doc_id][r.start:r.end]) for r in license_scan.scan(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert len(got) == 3 and all(g.lower().endswith("the mit license") and g.lower().startswith(("released", "under")) for g in got), got


def test_license_with_insertions_and_omissions_over_the_band():
    index = license_scan.Index(license_scan.TEMPLATES)
    for name in ("mit", "isc", "apache-2.0", "gpl"):
        words = license_scan.TEMPLATES[name].split()
        for extra in (12, 25):
            put = " ".join(f"header{i}" for i in range(extra))
            for cut in range(6, len(words) - 6):
                text = " ".join(["x y z", *words[:cut], put, *words[cut:], "u v"])
                got = license_scan.matches(text, index, 0.8)
                assert [(g[0], g[1]) for g in got if g[0] == name] == [(name, 1.0)], (name, cut)
                assert text[got[0][2]:got[0][3]].split()[0] == words[0], (name, cut)
    words = license_scan.TEMPLATES["mit"].split()
    for cut in range(6, len(words) - 18):
        got = license_scan.matches(" ".join(["x y z", *words[:cut], *words[cut + 12:], "u v"]), index, 0.8)
        assert [g[0] for g in got] == ["mit"] and got[0][1] >= 0.8, cut
    # Copies stay matches of their own, also damaged ones; parts too far apart are none.
    damaged = " ".join(words[:20] + words[24:]) + ". " + " ".join(words[:50] + words[53:])
    assert [g[0] for g in license_scan.matches(damaged, index, 0.8)] == ["mit", "mit"]
    apart = " ".join([*words[:30], *["far"] * 2 * len(words), *words[30:]])
    assert license_scan.matches(apart, index, 0.8) == []


def test_license_whole_texts():
    index = license_scan.Index(license_scan.TEMPLATES)
    whole = [n for n in license_scan.TEMPLATES if n.endswith("-text")]
    assert len(whole) == 4
    for name in whole:
        text = license_scan.TEMPLATES[name].strip()
        got = license_scan.matches("Some work.\n\n" + text + "\n\nx y z", index, 0.8)
        assert [g[:2] for g in got] == [(name, 1.0)], name
        assert license_scan.words(text) == license_scan.words(("Some work.\n\n" + text)[got[0][2]:got[0][3]]), name
    for name in ("mit", "isc", "bsd", "apache-2.0", "gpl"):  # openings stay templates of their own
        assert [g[:2] for g in license_scan.matches(license_scan.TEMPLATES[name], index, 0.8)] == [(name, 1.0)]


def test_license_alignment_is_the_longest_common_sequence():
    rng = random.Random(9)
    for _ in range(60):
        t = [rng.choice("abc") for _ in range(8)]
        d = [rng.choice("abc") for _ in range(8)]
        table = [[0] * 9 for _ in range(9)]
        for i in range(8):
            for j in range(8):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (t[i] == d[j]))
        assert license_scan.align(t, d, 0)[0] == table[8][8]


def test_quality(docs_of, spark, odd_docs):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["a", "calm", "sea", "and", "wide", "sky"]) for _ in range(40)) + "." for _ in range(150)]
    junk = [" ".join(rng.choice(["###", "$$$", "%%"]) + "x" for _ in range(40)) for _ in range(50)]
    docs = docs_of(list(enumerate(good + junk)))
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert all((r.score > 0.5) == (i < 150) and 0 < r.site < 1 for i, r in got.items())
    assert quality.score(odd_docs, labels).filter("score between 0 and 1").count() == odd_docs.count()
    assert quality.score(odd_docs, labels.limit(0)).filter("evidence = 0.5").count() == odd_docs.count()
    assert quality.score(odd_docs.limit(0), labels).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in pipeline.STAGES[1:4]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == names
        docs = pipeline.staged(docs, "test")
        now = {r.doc_id: r for r in docs.collect()}
        if name == "exact_dedup":
            norm = {i: " ".join((" " + r.text + " ").split()) for i, r in before.items()}
            assert len(now) == len(set(__import__("re").sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in before.values())), norm
        elif name == "ngram_jaccard":
            groups = _components([(i, r.text) for i, r in before.items()])
            assert set(now) == {i for i, c in groups.items() if i == c}
        else:
            assert set(now) == set(before) and all(r.n_chars == len(r.text) for r in now.values())
            assert not any("@" in r.text and "@example" in r.text for r in now.values())
        before = now
    rows = pipeline.STAGES[4][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == set(before)
    assert max(Counter(r.sequence_id for r in rows).values()) > 1

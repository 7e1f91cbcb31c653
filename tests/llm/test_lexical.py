"""Ranked lexical search against a plain loop over documents and items."""

import math
import random
import re
from collections import Counter

from pyspark.sql import types as T

from factloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                      T.StructField("score", T.StringType()), T.StructField("salt", T.StringType())])


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    rows = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    length = sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in rows:
            m = 75 + 25 * sum(c.values()) * len(rows) // length
            score = sum(math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item_id, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, k=20):
    asked = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], ITEMS)
    return sorted(tuple(r) for r in lexical.search(docs, asked, k).collect())


def test_terms_of_bytes():
    for text in ["", "A-b c9_d", "é Ü ß中文 x\x85y\xa0z", "\x00a\x7fB", "ΣΑ ǅ"]:
        assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text)


def test_dag_adds_up_to_its_items_and_shares():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(40))).encode()) for i in range(40)]
    items += [(99, b""), (100, b"a " * 1000)]
    dag = lexical.mine(items)
    parts = [{t: 1} for t in dag.leaves]
    uses = Counter()
    for a, b in dag.joins:
        parts.append(Counter(parts[a]) + Counter(parts[b]))
    for (item_id, text), (got_id, digits) in zip(items, dag.items):
        total = Counter()
        for digit, nodes in digits:
            for node in nodes.tolist():
                uses[node] += 1
                total.update({t: c << digit for t, c in parts[node].items()})
        assert got_id == item_id and total == Counter(lexical.terms_of(text))
    uses.update(n for pair in dag.joins for n in pair)
    assert any(uses[n] > 1 for n in range(len(dag.leaves), dag.nodes))


def test_search_against_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lexical, "STRETCH_BYTES", 4096)
    rng = random.Random(5)
    words = ["the", "The", "a", "é", "中文", "x1", *(f"w{i}" for i in range(25))]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(200)]
    docs += [(7, docs[7][1]), (300, docs[9][1]), (301, docs[9][1]), (302, "the " * 20000), (None, docs[3][1]),
             (303, None), (304, ""), (305, " .,; ")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 15)))) for i in range(30)]
    items += [(50, "nowhere to be found"), (51, None), (52, ""), (53, "a a a A"), (54, "the")]
    assert found(spark, docs_of(docs), items) == brute(docs, items, 20)


def test_odd_documents_and_empty_tables(spark, odd_docs, docs_of):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "idiot a WORD z 中文"), (2, "d e c b"), (2, "d e c b"), (None, "a")]
    assert found(spark, odd_docs, items, 3) == brute(rows, [items[0], items[1]], 3)
    assert found(spark, docs_of([]), items) == []
    assert found(spark, odd_docs, []) == []
    assert found(spark, docs_of([(1, None), (2, "...")]), items) == []
    # Of several rows of one item the smallest text stands.
    assert found(spark, odd_docs, [(4, "z"), (4, "idiot"), (4, None)]) == brute(rows, [(4, "idiot")], 20)

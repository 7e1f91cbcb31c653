"""Near-duplicate vectors against all pairs in double precision."""

import numpy as np
import pytest
from pyspark.sql import types as T

from factloom.llm import nn_descent

COLUMNS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType()),
                        T.StructField("v", T.LongType()), T.StructField("size", T.LongType())])


def frame(spark, rows):
    data = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "clash", 1, 2) for i, v in rows]
    return spark.createDataFrame(data, COLUMNS).repartition(3)


def brute(rows, threshold=0.95):
    chosen = {}
    for i, v in rows:
        if i is not None:
            ok = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
            v = tuple(np.float32(v).astype(float)) if ok else None
            chosen[i] = v if chosen.get(i) is None else chosen[i] if v is None else min(chosen[i], v)
    ids = sorted(chosen)
    links = {i: set() for i in ids}
    for dim in {len(v) for v in chosen.values() if v}:
        own = [i for i in ids if chosen[i] and len(chosen[i]) == dim]
        x = np.array([chosen[i] for i in own])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                links[own[a]].add(own[b])
    label = {}
    for i in ids:
        if i not in label:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in label:
                    label[j] = i
                    stack += links[j]
    return sorted((i, len(links[i]), label[i], label[i] == i) for i in ids)


def found(df):
    return sorted(tuple(r) for r in nn_descent.near_duplicates(df).collect())


def clustered(rng, sizes, dim, spread=0.12):
    out = []
    for m in sizes:
        middle = rng.standard_normal(dim)
        middle /= np.linalg.norm(middle)
        out += [middle + rng.standard_normal(dim) * spread / np.sqrt(dim) for _ in range(m)]
    return out


@pytest.mark.parametrize("dim", [24])
def test_all_links_with_a_whole_audit(spark, monkeypatch, dim):
    """The audit reads every vector, so descents repeat until nothing is lost:
    lists, stretches and blocks are far smaller than the groups."""
    for name, value in {"STRETCH": 24, "BLOCK": 16, "LIST": 4, "TASK_ROWS": 300, "AUDIT": 2000, "RECALL": 1.0}.items():
        monkeypatch.setattr(nn_descent, name, value)
    rng = np.random.default_rng(dim)
    vectors = clustered(rng, [70, 20, *[2] * 20, *[1] * 30], dim)
    vectors += vectors[:5] + [vectors[0] * 3]
    rows = list(enumerate(vectors))
    assert found(frame(spark, rows)) == brute(rows)


def test_defined_results(spark):
    rng = np.random.default_rng(1)
    base = clustered(rng, [4, 1, 1], 4, 0.01)
    rows = list(enumerate(base)) + [
        (20, None), (21, []), (22, [0, 0, 0, 0]), (23, [1, None, 0, 0]), (24, [float("nan"), 1, 0, 0]),
        (25, [float("inf"), 1, 0, 0]), (None, base[0]), (26, [1.0]), (27, [2.0]), (28, [-1.0]), (29, [1, 0]),
        (30, [0.0, -0.0, 1e-30, 0]), (31, [-0.0, 0.0, 1e-30, 0]), (32, [0, 0, 1e30, 0]),
        (2, base[2]), (33, base[0]), (33, [9, 9, 9, 9]), (34, None), (34, base[1]), (35, base[1])]
    rows = [(i, [float(c) for c in v] if v is not None and None not in v else v) for i, v in rows]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, None), (2, [0.0])])) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert found(frame(spark, [(5, [1.0, 2.0])])) == [(5, 0, 5, True)]
    copies = [(i, [1.0, 2.0]) for i in range(30)]
    assert found(frame(spark, copies)) == brute(copies)


def test_descent_reaches_the_audited_recall(spark, monkeypatch):
    """Few comparisons a vector: what signatures part, joins of neighbours find."""
    for name, value in {"STRETCH": 64, "TASK_ROWS": 1000}.items():
        monkeypatch.setattr(nn_descent, name, value)
    rng = np.random.default_rng(9)
    rows = list(enumerate(clustered(rng, [*[5] * 150, *[1] * 1500], 48, 0.2)))
    want, got = brute(rows), found(frame(spark, rows))
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) > 0
    assert all(g[1] <= w[1] for g, w in zip(got, want))

"""Longest-common-subsequence scores against plain tables."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from factloom.functions import overlap as OV


def words(t):
    return re.findall("[a-z0-9]+", t.lower())


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def places(ref, can):
    t, i, j, out = lcs_table(ref, can), len(ref), len(can), []
    while i and j:
        if ref[i - 1] == can[j - 1]:
            out, i, j = [i - 1, *out], i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def f(hits, a, b):
    return 2 * hits / (a + b) if hits else 0.0


def rouge_l(pred, ref):
    p, r = words(pred), words(ref)
    return f(lcs_table(p, r)[-1][-1], len(p), len(r))


def rouge_lsum(pred, ref):
    split = [[words(s) for s in re.split(r"\n|(?<=[.!?])\s+", t)] for t in (pred, ref)]
    in_pred, hits = Counter(w for s in split[0] for w in s), 0
    for r in split[1]:
        for i in sorted({i for c in split[0] for i in places(r, c)}):
            if in_pred[r[i]] > 0:
                in_pred[r[i]] -= 1
                hits += 1
    return f(hits, *(sum(map(len, s)) for s in split))


def test_rouge_l_and_lsum(spark):
    rng = random.Random(4)
    ends = ["", "", "", ".", "!", "\n", "?"]
    texts = [" ".join(rng.choice("a b c d The x1 été".split()) + rng.choice(ends) for _ in range(rng.randrange(0, 25)))
             for _ in range(120)]
    pairs = list(zip(texts, texts[1:])) + [("", ""), ("a", ""), ("", "a"), ("the cat sat", "the cat sat"),
                                           ("a. b. c", "c b a"), ("...", "a"), ("a b c d e", "e d c b a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, r string")
    got = df.select("i", OV.rouge_l(F.col("p"), F.col("r")).alias("l"), OV.rouge_lsum(F.col("p"), F.col("r")).alias("s"))
    for r in got.collect():
        pred, ref = pairs[r.i]
        assert abs(r.l - rouge_l(pred, ref)) < 1e-9 and abs(r.s - rouge_lsum(pred, ref)) < 1e-9, (pred, ref)

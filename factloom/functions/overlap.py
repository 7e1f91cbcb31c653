"""Text overlap scores of short strings as n-gram multisets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L = F.lit


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), L(0))


def ngrams(units: Column, n: int) -> Column:
    """All runs of n units, joined by a unit separator."""
    last = F.size(units) - n
    return F.when(last >= 0, F.transform(F.sequence(L(0), F.greatest(last, L(0))), lambda i: F.array_join(
        F.slice(units, i + 1, L(n)), "\x1f"))).otherwise(F.array().cast("array<string>"))


def numbered(units: Column) -> Column:
    """Every unit with its number among its equals, in sorted order: as a set, that
    is the multiset of the units.  The units are sorted and each run of equals is
    numbered from its start, so the work follows their number."""
    def runs(xs: Column) -> Column:
        starts = F.filter(F.sequence(L(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(xs, i) != F.get(xs, i - 1)))

        def each(ss: Column) -> Column:
            return F.flatten(F.transform(ss, lambda s, j: F.transform(
                F.sequence(L(0), F.coalesce(F.get(ss, j + 1), F.size(xs)) - s - 1),
                lambda k: F.concat_ws("\x1e", F.get(xs, s), k.cast("string")))))
        return F.when(F.size(xs) > 0, _let(starts, each)).otherwise(F.array().cast("array<string>"))
    return _let(F.sort_array(units), runs)  # array_sort would call its comparator by the expression


def clipped(pred: Column, refs: Column) -> Column:
    """Runs of ``pred`` that some reference holds, each as often as the reference
    with most of it does.  ``refs``: array of run arrays."""
    return F.size(F.array_intersect(numbered(pred), F.flatten(F.transform(refs, numbered))))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: F.trim(c) != "")


def char_bleu(pred: Column, refs: Column, order: int = 4) -> Column:
    """BLEU of characters (white space aside) without smoothing, against one
    or more references; 0 where some order has no run in common."""
    def of(p: Column) -> Column:
        def with_refs(rs: Column) -> Column:
            def precision(n: int) -> Column:
                return clipped(ngrams(p, n), F.transform(rs, lambda r: ngrams(r, n))) / (F.size(p) - (n - 1))

            # the reference closest in length, the shorter one of equals
            closest = F.array_min(F.transform(rs, lambda r: F.struct(F.abs(F.size(r) - F.size(p)), F.size(r).alias("n"))))["n"]
            brevity = F.when(F.size(p) > closest, L(1.0)).otherwise(F.exp(1 - closest / F.size(p)))
            return _let(F.array(*[precision(n) for n in range(1, order + 1)]), lambda ps: F.when(
                F.forall(ps, lambda x: x > 0), brevity * F.exp(F.aggregate(ps, L(0.0), lambda s, x: s + F.log(x)) / order))
                .otherwise(L(0.0)))
        return F.when(F.size(p) < order, L(0.0)).otherwise(_let(F.transform(refs, characters), with_refs))
    return _let(characters(pred), of)


def words(t: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def rouge_n(pred: Column, ref: Column, n: int) -> Column:
    """A10: F-measure of common runs of n words (lower case, letters and digits)."""
    return common_runs(words(pred), words(ref), n)


def common_runs(pred: Column, ref: Column, n: int) -> Column:
    """``rouge_n`` of two word arrays."""
    return _let(F.struct(ngrams(pred, n).alias("p"), ngrams(ref, n).alias("r")), lambda x: _let(
        clipped(x["p"], F.array(x["r"])), lambda c: F.when(c > 0, 2 * c / (F.size(x["p"]) + F.size(x["r"]))).otherwise(L(0.0))))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, as the longest
    increasing run of places: every element of ``a`` offers its places in ``b`` from
    the last to the first, and the state keeps the smallest last place of the runs
    of every length, so it is as long as the answer."""
    def places(y: Column) -> Column:
        return F.when(F.size(y) > 0, F.flatten(F.transform(a, lambda x: F.filter(
            F.sequence(F.size(y) - 1, L(0), L(-1)), lambda i: F.get(y, i) == x)))).otherwise(F.array().cast("array<int>"))

    def step(ends: Column, at: Column) -> Column:
        return F.when((F.size(ends) == 0) | (F.element_at(ends, -1) < at), F.concat(ends, F.array(at))).otherwise(
            F.transform(ends, lambda v, i: F.when((v >= at) & ((i == 0) | (F.get(ends, i - 1) < at)), at).otherwise(v)))

    return _let(b, lambda y: F.size(F.aggregate(places(y), F.array().cast("array<int>"), step)))


def _f_measure(hits: Column, pred: Column, ref: Column) -> Column:
    """Of hits among the elements of two arrays."""
    return F.when(hits > 0, 2 * hits / (F.size(pred) + F.size(ref))).otherwise(L(0.0))


def rouge_l(pred: Column, ref: Column) -> Column:
    """A10: F-measure of the longest common subsequence of words."""
    return _let(F.struct(words(pred).alias("p"), words(ref).alias("r")), lambda x: _let(
        lcs_length(x["p"], x["r"]), lambda n: _f_measure(n, x["p"], x["r"])))


def sentences(text: Column) -> Column:
    """Word arrays of the sentences: parts between line ends and after . ! ?"""
    return F.transform(F.split(text, r"\n|(?<=[.!?])\s+"), words)


def lcs_places(ref: Column, pred: Column) -> Column:
    """Places in ``ref`` of one longest common subsequence, from the last on: the
    table's rows are running maxima, and the way back keeps to the reference where
    both ways are as good."""
    def row(table: Column, word: Column) -> Column:
        def grown(above: Column) -> Column:
            best = F.transform(pred, lambda w, j: F.when(w == word, F.get(above, j) + 1).otherwise(F.get(above, j + 1)))
            return _let(best, lambda c: F.concat(table, F.array(F.concat(F.array(L(0)), F.transform(
                c, lambda _, j: F.array_max(F.slice(c, 1, j + 1)))))))
        return _let(F.element_at(table, -1), grown)

    start = F.array(F.array_repeat(L(0), F.size(pred) + 1))

    def back(table: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            i, j = s["i"], s["j"]
            same = F.get(ref, i - 1) == F.get(pred, j - 1)
            left = F.get(F.get(table, i), j - 1) > F.get(F.get(table, i - 1), j)
            moved = F.when(same, F.struct((i - 1).alias("i"), (j - 1).alias("j"), F.concat(s["at"], F.array(i - 1)).alias("at")))
            moved = moved.when(left, F.struct(i.alias("i"), (j - 1).alias("j"), s["at"].alias("at")))
            moved = moved.otherwise(F.struct((i - 1).alias("i"), j.alias("j"), s["at"].alias("at")))
            return F.when((i > 0) & (j > 0), moved).otherwise(s)

        first = F.struct(F.size(ref).alias("i"), F.size(pred).alias("j"), F.array().cast("array<int>").alias("at"))
        return F.aggregate(F.sequence(L(0), F.size(ref) + F.size(pred)), first, step, lambda s: s["at"])

    return _let(F.aggregate(ref, start, row), back)


def rouge_lsum(pred: Column, ref: Column) -> Column:
    """A10: F-measure of the union, over the sentences of ``pred``, of every
    reference sentence's common subsequences; a word counts no oftener than in either."""
    def union(sentence: Column, preds: Column) -> Column:
        at = F.array_distinct(F.flatten(F.transform(preds, lambda p: lcs_places(sentence, p))))
        return F.transform(at, lambda i: F.get(sentence, i))

    def of(x: Column) -> Column:
        hits = F.flatten(F.transform(x["r"], lambda r: union(r, x["p"])))
        return _let(F.struct(hits.alias("u"), F.flatten(x["p"]).alias("p"), F.flatten(x["r"]).alias("r")), lambda y: _let(
            clipped(y["u"], F.array(y["p"])), lambda n: _f_measure(n, y["p"], y["r"])))

    return _let(F.struct(sentences(pred).alias("p"), sentences(ref).alias("r")), of)

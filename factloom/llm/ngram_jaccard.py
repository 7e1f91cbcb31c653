"""N-gram Jaccard join: linked documents and their components.

Method: a blocked sparse product of the document by n-gram incidence matrix with
itself.  Columns (n-grams) are blocks of the shuffle; overlaps of document pairs
accumulate over the columns; pairs below bounds that follow from the documents'
sizes are discarded, and the rest are counted over the whole sets.

Sizes decide how much of the matrix is needed.  Two sets whose Jaccard is at
least t share at least t * max(size) n-grams.  So, in one order of all n-grams,
the first p = size - ceil(t * size) + k(size) of each hold at least the smaller k
of the pair in common, and only these prefixes are multiplied.  Of a pair, let x
be the document whose prefix ends earlier in the order.  What x's prefix does not
share with the other's prefix is not in the other set at all, so the pair has at
most c + size(x) - p(x) in common, c being what the prefixes share.  Pairs that
cannot reach t / (1 + t) of the sum of their sizes are discarded: before they are
made, with all that x's prefix shares with anybody as c, and once more with the
accumulated c.  Documents that share less of their prefix with anybody than the
least k asks for are discarded before all that.

Scale:

* Equal sets are one class, known by size and a 128-bit digest; only its
  smallest document takes part.  Copies are never paired.
* The order puts frequent n-grams last.  Frequencies are counted over the whole
  corpus, map-side; which n-grams are frequent goes to every task as a table of
  ``BITS`` bits (8 MB, whatever the corpus).  The order only decides the work,
  never the result: any order gives the same links.
* A large group of near copies shares all its columns.  Before pairs are made,
  rounds compare the documents of columns wider than ``WIDE`` with one pivot a
  column, the document with the least of its own, and merge the components; pairs
  within a component are not made.  What is left is multiplied, so no link
  between components is missed.
* A linked pair shares at least c of x's entries that anybody shares (s of them),
  so among any s - c + 1 of those is one that it shares.  In wide columns x meets
  only its first s - c + 1 + ``SPARE`` wide entries; the ones it does not meet
  count as shared in the bound.
* Column entries, pivots, labels and sets move through joins and grouped
  aggregates; nothing is collected but the table of bits.

N-grams are 64-bit numbers (``shingles``).  Defined results: texts without words
(also null) have size 0 and are linked with nothing; a null id is never linked,
its component is that of its equal documents, or null; rows repeating an id are
one document; empty tables give empty tables.  Only the id and text columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import components
from factloom.llm.common import staged
from factloom.llm.shingles import shingle_sets

#: Bits that say which n-grams are frequent, n-grams that may set one, and the
#: least count of a frequent one.
BITS, FREQUENT, LEAST = 1 << 26, 1 << 23, 8
#: N-grams counted at once within a task.
COUNTED = 1 << 22
#: Common prefix n-grams asked for, as a share of the size (plus one).
COMMON_PERCENT = 5
#: Documents of a column beyond which a pivot comes before pairs, and rounds of it.
WIDE, ROUNDS = 16, 4
#: Wide entries met beyond the number that cannot miss a linked pair.
SPARE = 2


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    return shingle_sets(batch.column(1), width)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: documents (id, n, d1, d2) and n-grams that a stretch of
    a task holds at least twice (ngram, times)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            nonlocal size
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            often = times > 1
            held.clear()
            size = 0
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.record_batch([none, none, none, none, _long(grams[often]), pa.array(times[often])],
                                   names=["id", "n", "d1", "d2", "ngram", "times"])

        for batch in batches:
            n, digests = [], []
            for grams in _sets(batch, width):
                n.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                held.append(grams)
                size += len(grams)
                if size >= COUNTED:
                    yield counted()
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(pairs[:, 0].copy()),
                                   pa.array(pairs[:, 1].copy()), none, none],
                                  names=["id", "n", "d1", "d2", "ngram", "times"])
        if held:
            yield counted()

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, ngram long, times long")


def _frequent(counts: DataFrame) -> np.ndarray:
    """Bits set for the n-grams counted at least 2^e times, for the least e that
    leaves at most ``FREQUENT`` of them.  An n-gram that shares another's bit
    only takes a later place in the order."""
    totals = staged(counts.groupBy("ngram").agg(F.sum("times").alias("times")).filter(F.col("times") >= LEAST), "totals")
    by_power = {r["e"]: r["n"] for r in totals.groupBy(F.floor(F.log2("times")).alias("e")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    e = next(e for e in range(66) if sum(n for p, n in by_power.items() if p >= e) <= FREQUENT)
    place = F.col("ngram").bitwiseAND(F.lit(BITS - 1))
    words = (totals.filter(F.col("times") >= F.lit(2.0 ** e))
             .select(F.shiftright(place, 6).alias("word"),
                     F.expr("shiftleft(1L, cast(ngram & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())  # at most BITS / 64 rows
    table = np.zeros(BITS // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def _is_frequent(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    place = grams & np.uint64(BITS - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _needed(n, percent: int):
    """Least overlap of a set of size n with any it is linked with."""
    return -(-n * percent // 100)


def _common(n):
    return n * COMMON_PERCENT // 100 + 1


def _prefixes(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Entries (ngram, id, n, w) of the prefix matrix; w is the place of the
    prefix's last n-gram in the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, sizes, ends = [], [], [], []
            for grams in _sets(batch, width):
                n = len(grams)
                often = _is_frequent(grams, frequent)
                ordered = np.concatenate([grams[~often], grams[often]])
                cut = min(n, n - _needed(n, percent) + _common(n)) if n else 0
                rows.append(ordered[:cut])
                lengths.append(cut)
                sizes.append(n)
                ends.append((int(ordered[cut - 1]) >> 2) + (int(cut > n - often.sum()) << 62) if cut else 0)
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            yield pa.record_batch([_long(np.concatenate(rows) if rows else np.empty(0, np.uint64)),
                                   batch.column(0).take(pa.array(owner)),
                                   pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                                   pa.array(np.repeat(np.array(ends, np.int64), lengths))], names=["ngram", "id", "n", "w"])

    return docs.filter("id is not null").mapInArrow(run, "ngram long, id long, n int, w long")


def _shared(entries: DataFrame) -> DataFrame:
    """Entries of columns that hold at least two documents."""
    column = Window.partitionBy("ngram")
    return (entries.withColumn("lo", F.min("id").over(column)).withColumn("hi", F.max("id").over(column))
            .filter("lo <> hi").drop("lo", "hi"))


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [s.tobytes() for s in _sets(batch, width)]
            yield pa.record_batch([batch.column(0), pa.array(grams, pa.binary())], names=["id", "grams"])

    return docs.mapInArrow(run, "id long, grams binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the Jaccard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sides = (pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
             .join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y"))
    return sides.mapInArrow(run, "a long, b long")


def _prefix_size(n: Column, percent: int) -> Column:
    return F.least(n, n - F.ceil(n * percent / 100) + F.floor(n * COMMON_PERCENT / 100) + 1)


def _by_shorter(a: Column, b: Column, equal: Column) -> Column:
    """``a`` or ``b`` by whose prefix ends earlier: columns wa and wb."""
    return F.when(F.col("wa") < F.col("wb"), a).when(F.col("wa") > F.col("wb"), b).otherwise(equal)


def _beyond(n: str, percent: int) -> Column:
    """Most that a set shares beyond its prefix."""
    return F.col(n) - _prefix_size(F.col(n), percent)


def _reachable(shared_a: Column, shared_b: Column, percent: int) -> Column:
    """Whether a pair can reach the Jaccard, from what the prefixes of either side
    share: columns na, wa, nb, wb of the two documents."""
    a, b = shared_a + _beyond("na", percent), shared_b + _beyond("nb", percent)
    common = F.least(_by_shorter(a, b, F.greatest(a, b)), F.col("na"), F.col("nb"))
    return (100 + percent) * common >= percent * (F.col("na") + F.col("nb"))


def _met(side: str, percent: int) -> Column:
    """How many of a side's wide entries have to meet the other's: columns na, nb
    and the side's s."""
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent)) - _beyond(f"n{side}", percent)
    return F.greatest(F.col(f"s{side}") - least + 1 + SPARE, F.lit(0))


def _side(entries: DataFrame, name: str, *more: str) -> DataFrame:
    return entries.select("ngram", F.col("id").alias(name), *[F.col(c).alias(f"{c}{name}") for c in ("n", "w", "s", *more)])


def _by_pivots(entries: DataFrame, labels: DataFrame, round_: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a document and the pivot it shares most columns with,
    among pivots of other components.  Each column of more than ``WIDE``
    documents has one pivot: the document with least in its prefix that nobody
    shares; rounds tell equal ones apart by a hash."""
    own = _prefix_size(F.col("n"), percent) - F.col("s")
    wide = staged(entries.groupBy("ngram").agg(
        F.count(F.lit(1)).alias("m"), F.min_by(F.struct("id", "n", "w", "s"), F.struct(
            own, F.xxhash64("id", F.lit(round_)))).alias("p")).filter(F.col("m") > WIDE)
        .select("ngram", F.col("p.id").alias("b"), F.col("p.n").alias("nb"), F.col("p.w").alias("wb"),
                F.col("p.s").alias("sb")), "pivots")
    met = (_side(entries, "a").join(wide, "ngram").filter(F.col("a") != F.col("b"))
           .filter(_reachable(F.col("sa"), F.col("sb"), percent))
           .groupBy("a", "b", "na", "wa", "nb", "wb").agg(F.count(F.lit(1)).alias("c"))
           .filter(_reachable(F.col("c"), F.col("c"), percent)))
    apart = (met.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
             .join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").filter("la <> lb"))
    return apart.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))


def _numbered(entries: DataFrame) -> DataFrame:
    """Entries with ``i``, the number of the entry among its document's wide ones
    (0 if its column is not wide), and ``t``, how many those are."""
    wide = staged(entries.groupBy("ngram").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > WIDE)
                  .select("ngram", F.lit(1).alias("wide")), "wide")
    own = Window.partitionBy("id")
    return (entries.join(wide, "ngram", "left").withColumn("wide", F.coalesce("wide", F.lit(0)))
            .withColumn("t", F.sum("wide").over(own))
            .withColumn("i", F.col("wide") * F.sum("wide").over(
                own.orderBy("ngram").rowsBetween(Window.unboundedPreceding, 0))).drop("wide"))


def _product(entries: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach the Jaccard."""
    labelled = staged(_numbered(entries).join(labels, "id"), "labelled")
    pairs = _side(labelled, "a", "label", "i", "t").join(_side(labelled, "b", "label", "i", "t"), "ngram")
    meets_a, meets_b = F.col("ia") <= _met("a", percent), F.col("ib") <= _met("b", percent)

    def unmet(side: str) -> Column:
        return F.greatest(F.col(f"t{side}") - _met(side, percent), F.lit(0))

    keys = [f"{c}{side}" for side in "ab" for c in ("", "n", "w", "s", "t")]
    return (pairs.filter((F.col("a") < F.col("b")) & (F.col("labela") != F.col("labelb")))
            .filter(_by_shorter(meets_a, meets_b, meets_a | meets_b))
            .filter(_reachable(F.col("sa"), F.col("sb"), percent))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
            .filter(_reachable(F.col("c") + unmet("a"), F.col("c") + unmet("b"), percent)).select("a", "b"))


def join(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id reachable
    by links of a Jaccard of at least ``percent`` hundredths."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(_signatures(src, width), "signatures")
    rows = signed.filter("n is not null").select("id", "n", "d1", "d2")
    classes = staged(rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("first")), "classes")
    members = rows.join(classes, ["n", "d1", "d2"], "left").select("id", "n", "first")
    frequent = _frequent(signed.filter("ngram is not null").select("ngram", "times"))

    entries = staged(_shared(_prefixes(src, width, percent, frequent)), "entries")
    firsts = classes.filter("first is not null").select(F.col("first").alias("id")).distinct()
    entries = staged(_shared(entries.join(firsts, "id", "left_semi").select("ngram", "id", "n", "w")), "entries")
    least = F.floor(F.ceil(F.col("n") * percent / 100) * COMMON_PERCENT / 100) + 1
    able = staged(entries.groupBy("id", "n").agg(F.count(F.lit(1)).alias("s")).filter(F.col("s") >= least)
                  .groupBy("id").agg(F.max("s").alias("s")), "able")
    entries = staged(entries.join(able, "id").select("ngram", "id", "n", "w", "s"), "entries")
    sets = staged(_full_sets(src.join(able, "id", "left_semi"), width), "sets")

    labels = able.select("id", F.col("id").alias("label"))
    for round_ in range(ROUNDS):
        links = staged(_linked(_by_pivots(entries, labels, round_, percent), sets, percent), "links")
        if links.isEmpty():
            break
        labels = components.merge(labels, links)
    links = staged(_linked(_product(entries, labels, percent), sets, percent), "links")
    labels = components.merge(labels, links)

    return members.join(labels.select(F.col("id").alias("first"), "label"), "first", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("label", "first", "id").alias("component_id"))

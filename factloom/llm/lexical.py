"""Ranked lexical search: every item of a query table against all documents.

Method: multi-query common-subexpression evaluation.  Items are multisets of
terms; the terms of an item whose count has binary digit b form its set b, so an
item's score is the sum over its sets of 2^b times the set's score.  Term sets
that several of these sets share are mined by repeated pairing (terms stand in
the order of how many sets hold them; neighbours met in two sets or more become
one node, in rounds until no pair is shared).  Nodes form a query-sharing DAG:
leaves are terms, inner nodes the sum of two nodes, items sums of nodes.  A task
materialises the partial accumulators (one number per document and node) of a
stretch of documents once and combines them along the DAG for all items.

Scores are BM25's form in 64-bit integers (``weight`` and ``part`` below).

How it runs: one pass over the texts writes, per document, its number of terms
and the counts of the items' terms (Parquet, shared folder); document
frequencies come from these; a pass over them keeps the ``k`` best per item and
task, then per item and salt, then per item.  Items are taken in blocks of about
``BLOCK_BYTES`` of text (or one item), so what the driver and a task hold of
them is bounded; accumulators take at most ``STRETCH_BYTES``.  Results are the
same for any block, batch or partitioning.

Defined results: null, empty and termless texts have no terms and are counted
nowhere; documents without an id count in the statistics and are not ranked;
repeated rows count and are ranked each; items without an id are left out, of
several rows of one item id the smallest text stands; items without terms, and
empty tables, give no rows.  Only id and text columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import staged

BLOCK_BYTES = 1 << 20
STRETCH_BYTES = 64 << 20
SALTS = 64

#: ASCII letters and digits stand (letters in lower case), every byte of a
#: non-ASCII character stands, all else parts terms.
_FORM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_FORM).split()


def weight(documents: int, holding: int) -> int:
    """Of a term that ``holding`` of ``documents`` hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Sharing:
    """The DAG of a block of items: leaf numbers of terms, the two parts of each
    inner node (numbered after the leaves, parts first), and of each item the
    nodes to add up for every binary digit."""

    leaves: dict[bytes, int] = field(default_factory=dict)
    joins: list[tuple[int, int]] = field(default_factory=list)
    items: list[tuple[int, list[tuple[int, np.ndarray]]]] = field(default_factory=list)

    @property
    def nodes(self) -> int:
        return len(self.leaves) + len(self.joins)


def mine(items: list[tuple[int, bytes]]) -> Sharing:
    """Shared term sets of items (id, text in UTF-8)."""
    out = Sharing()
    sets: list[tuple[int, int, list[bytes]]] = []
    for number, (_, text) in enumerate(items):
        counts = Counter(terms_of(text))
        for digit in range(max(counts.values(), default=0).bit_length()):
            sets.append((number, digit, [t for t, c in counts.items() if c >> digit & 1]))
    held = Counter(t for _, _, s in sets for t in s)
    # Terms in many sets come first, so shared sets stand together.
    for t in sorted(held, key=lambda t: (-held[t], t)):
        out.leaves[t] = len(out.leaves)
    chains = [sorted(out.leaves[t] for t in s) for _, _, s in sets]
    while True:
        pairs = Counter(p for c in chains for p in zip(c, c[1:]))
        made: dict[tuple[int, int], int] = {}
        for at, chain in enumerate(chains):
            new, i = [], 0
            while i < len(chain):
                here = pairs[chain[i], chain[i + 1]] if i + 1 < len(chain) else 0
                after = pairs[chain[i + 1], chain[i + 2]] if i + 2 < len(chain) else 0
                if here >= 2 and here >= after:
                    pair = chain[i], chain[i + 1]
                    if pair not in made:
                        made[pair] = out.nodes
                        out.joins.append(pair)
                    new.append(made[pair])
                    i += 2
                else:
                    new.append(chain[i])
                    i += 1
            chains[at] = new
        if not made:
            break
    parts: list[list[tuple[int, np.ndarray]]] = [[] for _ in items]
    for (number, digit, _), chain in zip(sets, chains):
        if chain:
            parts[number].append((digit, np.array(chain, np.int64)))
    out.items = [(item_id, p) for (item_id, _), p in zip(items, parts)]
    return out


def _postings(docs: DataFrame, leaves: dict[bytes, int]) -> DataFrame:
    """``id``, ``n`` and, of the items' terms that a document holds, leaf numbers
    and counts; documents without terms give no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, leaf, tf = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = terms_of(text.as_py() or b"")
                if terms:
                    found = Counter(filter(leaves.__contains__, terms))
                    ids.append(doc_id)
                    n.append(len(terms))
                    leaf.append([leaves[t] for t in found])
                    tf.append(list(found.values()))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()),
                                   pa.array(leaf, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                                  names=["id", "n", "leaf", "tf"])

    return docs.mapInArrow(run, "id long, n long, leaf array<int>, tf array<long>")


class _Best:
    """The k highest scores of every item, ties to the smaller document id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64) for _ in range(items)]
        self.ids = [np.zeros(0, np.int64) for _ in range(items)]

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        full = len(self.scores[item]) == self.k
        at = np.flatnonzero(scores >= (self.scores[item][-1] if full else 1))
        if len(at):
            s, i = np.r_[self.scores[item], scores[at]], np.r_[self.ids[item], ids[at]]
            order = np.lexsort((i, -s))[:self.k]
            self.scores[item], self.ids[item] = s[order], i[order]


def _rank(postings: DataFrame, dag: Sharing, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """The k best documents of every item and task."""
    stretch = max(16, STRETCH_BYTES // (8 * max(1, dag.nodes)))
    first = len(dag.leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(dag.items), k)
        for whole in batches:
            for at in range(0, whole.num_rows, stretch):
                batch = whole.slice(at, stretch)
                ids, lists = batch.column(0).to_numpy(), batch.column(2)
                leaf, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                # Python integers: n times the corpus may pass 64 bits before the division.
                m = np.array([75 + 25 * n * documents // length for n in batch.column(1).to_pylist()], np.int64)
                doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
                sums = np.zeros((dag.nodes, len(ids)), np.int64)
                sums[leaf, doc] = weights[leaf] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                for node, (a, b) in enumerate(dag.joins, first):
                    np.add(sums[a], sums[b], out=sums[node])
                for item, (_, parts) in enumerate(dag.items):
                    if parts:
                        best.offer(item, sum(sums[nodes].sum(0) << digit for digit, nodes in parts), ids)
        yield pa.record_batch([
            pa.array(np.repeat([i for i, _ in dag.items], [len(s) for s in best.scores]).astype(np.int64)),
            pa.array(np.concatenate([*best.ids, np.zeros(0, np.int64)])),
            pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]))], names=["item", "doc", "score"])

    return postings.filter("id IS NOT NULL AND size(leaf) > 0").mapInArrow(run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the k best documents
    of every item with a score above 0."""
    spark = docs.sparkSession
    asked = staged(items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("t"))
                   .filter("item IS NOT NULL").groupBy("item").agg(F.min("t").alias("t")), "items")
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = spark.createDataFrame([], "item long, doc long, score long")
    for block in range(blocks):
        dag = mine([(r.item, (r.t or "").encode()) for r in asked.filter(F.col("block") == block).orderBy("item").collect()])
        postings = staged(_postings(texts, dag.leaves), "postings")
        documents, length = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        held = postings.select(F.explode("leaf").alias("leaf")).groupBy("leaf").count().toArrow()
        weights = np.zeros(len(dag.leaves), np.int64)
        weights[held["leaf"].to_numpy()] = [weight(documents, c) for c in held["count"].to_pylist()]
        found = found.unionByName(staged(_rank(postings, dag, weights, documents, length or 1, k), "ranked"))
    salted = Window.partitionBy("item", "salt").orderBy(F.desc("score"), F.asc("doc"))
    whole = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc"))
    return (found.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
            .withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k)
            .withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
            .select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score"))

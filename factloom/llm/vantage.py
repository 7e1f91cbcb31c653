"""Nearest neighbours by largest inner product: vantage-point trees per shard.

Method: vectors are dealt evenly into shards; every shard builds a vantage-point
tree in one task and searches it with blocks of queries.  A subtree is left out
when the triangle inequality, with its slack divided by ``relax``, says that
nothing in it can beat the query's k-th best so far; ``relax`` = 1 restores exact
search, larger factors prune more and may miss neighbours.  The best of all
shards are merged with a partial top-k.

Inner products are not a metric; adding the coordinate sqrt(M^2 - |x|^2) (M: the
largest norm) to a vector and 0 to a query makes the Euclidean distance fall as
the inner product grows.  Equal vectors are one tree node that keeps its members
with the smallest ids, enough of them for any query, so a vector that a third of
the rows share neither unbalances the tree nor fills a leaf.

Scores are summed in double precision on the original vectors, component by
component.  Pruning leaves room for the rounding of distances, and vectors that tie
are ranked by their smallest ids, so the k kept ones are those of the whole order.  Shards and
query blocks have bounded rows; every block meets every shard, which is the work
the search states, and nothing is collected.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without an id; candidates are all rows but
those of the query's own id; fewer than k candidates give fewer rows; ties go to
the smaller id, repeated rows of an id count once (the first by vector); empty
tables give empty results.  The dimension is the one that most candidates of the
whole table have (of equals the smaller); vectors of another take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import staged

#: Vectors of a shard and queries of a block, about; vectors of a leaf.
SHARD, BLOCK, LEAF = 16384, 4096, 64


def usable(vector: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tree:
    """A vantage-point tree over the rows of ``points``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []
        self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        """A node is ('leaf', rows) or ('ball', vantage row, median, the ranges of
        distances inside and outside, the two subtrees)."""
        number = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= LEAF:
            self.nodes[number] = ("leaf", rows)
            return number
        # The row furthest from the middle tells the others apart best.
        vantage = int(rows[np.argmax(((self.points[rows] - self.points[rows].mean(0)) ** 2).sum(1))])
        rest = rows[rows != vantage]
        far = np.sqrt(((self.points[rest] - self.points[vantage]) ** 2).sum(1))
        order = np.argsort(far, kind="stable")
        half = len(order) // 2
        near, out = order[:half], order[half:]
        spans = (far[near[0]], far[near[-1]]), (far[out[0]], far[out[-1]])
        self.nodes[number] = ("ball", vantage, spans, self._build(rest[near]), self._build(rest[out]))
        return number

    def search(self, queries: np.ndarray, k: int, relax: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and inner products of the k nearest of every query, best first, equal
        products by the smaller row.  Queries go down the tree together, so distances
        are a matrix product; what that puts within its rounding of the k-th best is
        ranked by products summed in the order of the components, the same in every
        shard.  The side nearer to most of a node's queries is searched first."""
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        limit, least_product = np.full(len(queries), np.inf), np.full(len(queries), -np.inf)
        # Lifted points have one norm, so distances follow from inner products.
        length, norm = np.sqrt((queries ** 2).sum(1)), np.sqrt((self.points ** 2).sum(1).max(initial=0))
        rounding = self.points.shape[1] * np.finfo(float).eps
        slack, near = 8 * np.sqrt(rounding) * (length + norm), 4 * rounding * length * norm

        def offer(active: np.ndarray, rows: np.ndarray) -> None:
            about = queries[active] @ self.points[rows].T
            chosen = about >= (least_product - near)[active][:, None]
            for i in np.flatnonzero(chosen.any(1)):
                q, new = active[i], rows[chosen[i]]
                products = np.cumsum(self.points[new] * queries[q], axis=1)[:, -1]
                new, products = np.r_[best[q][0], new], np.r_[best[q][1], products]
                order = np.lexsort((new, -products))[:k]
                best[q] = new[order], products[order]
                if len(order) == k:
                    least_product[q] = products[order[-1]]
                    limit[q] = np.sqrt(max(0, length[q] ** 2 + norm ** 2 - 2 * least_product[q])) + slack[q]

        def visit(number: int, active: np.ndarray) -> None:
            node = self.nodes[number]
            if node[0] == "leaf":
                if len(node[1]):
                    offer(active, node[1])
                return
            _, vantage, spans, inner, outer = node
            offer(active, np.array([vantage]))
            d = np.sqrt(((queries[active] - self.points[vantage]) ** 2).sum(1))
            # Least possible distance of the query to anything in a subtree.
            least = [np.maximum(0, np.maximum(lo - d, d - hi)) for lo, hi in spans]
            sides = [(inner, least[0]), (outer, least[1])]
            if (least[0] > least[1]).sum() * 2 > len(active):
                sides.reverse()
            for child, bound in sides:
                go = active[bound * relax <= limit[active]]
                if len(go):
                    visit(child, go)

        if len(queries) and len(self.points):
            visit(0, np.arange(len(queries)))
        return best


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, relax: float = 1.0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """The k nearest candidates of every query: ``query_id``, ``rank`` (from 1),
    ``vec_id`` and ``score``.  ``queries`` has the same two columns."""
    def clean(df: DataFrame) -> DataFrame:
        return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
                .filter(F.col("id").isNotNull() & usable(F.col("v")))
                .groupBy("id").agg(F.min("v").alias("v")))

    points, asked = staged(clean(vectors), "vectors"), staged(clean(queries), "queries")
    most = points.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most:
        points, asked = points.filter(F.size("v") == most["d"]), asked.filter(F.size("v") == most["d"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, widest = points.agg(F.count(F.lit(1)), F.max(norm)).first()
    q = asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-q // BLOCK))
    widest = float(widest or 0.0)
    # Each shard's vectors once per block, each block's queries once per shard.
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("query", F.lit(False))
    sought = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn(
        "query", F.lit(True))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        own, ask = group[~group["query"]].sort_values("id"), group[group["query"]]
        if len(own) and len(ask):
            x = np.stack(own["v"].to_list())
            distinct, first, member = np.unique(x, axis=0, return_index=True, return_inverse=True)
            by_vector: list[list[int]] = [[] for _ in distinct]
            for vec_id, m in zip(own["id"].tolist(), member.ravel().tolist()):
                if len(by_vector[m]) <= k:  # k others of the query's own id: enough for any query
                    by_vector[m].append(vec_id)
            # Numbered by their smallest ids, so that ties of vectors go to the smaller id.
            by_id = np.argsort(first)
            distinct, by_vector = distinct[by_id], [by_vector[m] for m in by_id]
            lift = np.sqrt(np.maximum(widest ** 2 - (distinct ** 2).sum(1), 0))
            tree = Tree(np.c_[distinct, lift])
            y = np.stack(ask["v"].to_list())
            found = tree.search(np.c_[y, np.zeros(len(y))], k + 1, relax)
            for query_id, (rows, scores) in zip(ask["id"].tolist(), found):
                for row, score in zip(rows.tolist(), scores.tolist()):
                    for vec_id in by_vector[row]:
                        if vec_id != query_id:
                            out["query_id"].append(query_id)
                            out["vec_id"].append(vec_id)
                            out["score"].append(score)
        found = pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id").head(k)

    local = dealt.unionByName(sought).groupBy("shard", "block").applyInPandas(
        nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("vec_id").alias(id_col), "score"))

"""Near-duplicate vectors by NN-descent.

Method: every vector keeps a list of its nearest neighbours found so far, started
from vectors that stand together in the order of random-hyperplane signatures.
Rounds of neighbours-of-neighbours joins refine the lists: around every vector,
pairs among its list and those that list it, at least one of them new, are
compared, and pairs nearer than a list's last go on.  Lists that hold only
neighbours over the threshold are saturated and double.  Rounds end when they
find no more edges over the threshold.  Edges over the threshold (less the
rounding of the codes) stay and form groups; within a group all links are counted
exactly, in blocks.  An audit compares a bounded sample of vectors with all; below
``RECALL`` more signatures and longer lists start another descent.

The lists' vectors travel as 8-bit codes; links and counts are decided in double
precision on the original vectors.  Equal vectors are one class: its copies are
linked with each other and share their links.

Bounds: lists hold at most ``LONGEST`` (a group's links do not depend on it: they
are counted by block, so a group of any size is as many tasks as pairs of
blocks); a vector listed by many takes part around itself with the nearest
``LIST`` of them; the audit reads ``AUDIT`` vectors.  No pair of vectors under
the threshold leaves the task that compares it but as an improvement of a list,
and links within a group are never written out.

Defined results: rows without an id are left out; of several vectors with one id
the smallest usable stands; vectors that are null, empty, zero or hold null or
non-finite components link with nothing, nor do vectors of different length; an
empty table gives an empty table.  Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import components
from factloom.llm.common import staged
from factloom.llm.vantage import usable

#: Neighbours of a list at first, and at most.
LIST, LONGEST = 8, 64
#: Signatures a descent adds, vectors compared together, rows of a task.
TABLES, STRETCH, TASK_ROWS = 3, 512, 16_384
#: A round that adds no more than this share of the edges ends the descent.
SETTLED = 0.001
#: Members of a group that are compared as one block.
BLOCK = 512
#: Vectors of the audit, half of them any and half with links, and what it asks.
AUDIT, RECALL = 512, 0.995

_EDGE = "id long, nbr long, sim float"


def _matrix(lists: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()
    x = flat.to_numpy().reshape(len(lists), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x ** 2).sum(1, keepdims=True))


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows of every length of the vector column."""
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        yield batch.filter(pa.array(lengths == n))


def _codes(classes: DataFrame) -> DataFrame:
    """``id``, ``dim``, the 8-bit ``code`` and ``off``, its angle to the vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch, "v"):
                x = _matrix(part.column("v"))
                code = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)
                c = code.astype(float)
                near = (x * c).sum(1) / np.sqrt((c ** 2).sum(1))
                yield pa.record_batch([part.column("id"), pa.array(np.full(len(x), x.shape[1], np.int32)),
                                       pa.array([r.tobytes() for r in code], pa.binary()),
                                       pa.array(np.arccos(np.clip(near, -1, 1)))], names=["id", "dim", "code", "off"])

    return classes.select("id", "v").mapInArrow(run, "id long, dim int, code binary, off double")


def _unit(codes: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1).astype(np.float32)
    return x / np.sqrt((x ** 2).sum(1, keepdims=True))


def _first_lists(codes: DataFrame, rows: int, tables: range, length: int) -> DataFrame:
    """Edges (id, nbr, sim) to the nearest of those with similar signatures."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _unit(part.column("code"))
                for t in tables:
                    planes = np.random.default_rng([t, int(dim)]).standard_normal((int(dim), 32)).astype(np.float32)
                    bits = ((x @ planes) > 0) @ (1 << np.arange(31, -1, -1, dtype=np.int64))
                    yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), part.column("dim"), pa.array(bits),
                                           part.column("id"), part.column("code")],
                                          names=["t", "dim", "bits", "id", "code"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stretches(batches, ("t", "dim")):
            x, ids = _unit(batch.column("code")), batch.column("id").to_numpy()
            for low in range(0, len(x), STRETCH):
                y, own = x[low:low + STRETCH], ids[low:low + STRETCH]
                sims = y @ y.T
                np.fill_diagonal(sims, -2)
                k = min(length, len(y) - 1)
                if k:
                    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    yield pa.record_batch([pa.array(np.repeat(own, k)), pa.array(own[best].ravel()),
                                           pa.array(np.take_along_axis(sims, best, 1).ravel())], names=["id", "nbr", "sim"])

    signed = codes.select("id", "dim", "code").mapInArrow(sign, "t int, dim int, bits long, id long, code binary")
    tasks = max(1, -(-rows * len(tables) // TASK_ROWS))
    return (signed.repartitionByRange(tasks, "t", "dim", "bits", "id").sortWithinPartitions("t", "dim", "bits", "id")
            .mapInArrow(compare, _EDGE))


def _stretches(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 0) -> Iterator[pa.RecordBatch]:
    """Sorted rows cut where a key changes: runs of one key, or with ``rows``,
    whole runs gathered to at least so many rows."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        columns = [rest.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if len(rest) else []
        low = 0
        for at in map(int, change):
            if at - low >= rows:
                yield rest.slice(low, at - low)
                low = at
        rest = rest.slice(low)
    if rest is not None and rest.num_rows:
        yield rest


def _join_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of members of one center, one of them new, that improve a list."""
    for batch in _stretches(batches, ("center",), 2048):
        center, ids = batch.column("center").to_numpy(), batch.column("member").to_numpy()
        fresh = batch.column("fresh").to_numpy(zero_copy_only=False)
        floor, dims = batch.column("floor").to_numpy(), batch.column("dim").to_numpy()
        starts = np.flatnonzero(np.r_[True, center[1:] != center[:-1]])
        sizes = np.diff(np.r_[starts, len(center)])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            x = np.zeros((len(ids), dim), np.float32)
            x[own] = _unit(batch.column("code").take(pa.array(own)))
            of_dim = dims[starts] == dim
            for size in np.unique(sizes[of_dim]):
                first = starts[of_dim & (sizes == size)]
                for some in np.array_split(first, -(-len(first) * int(size) ** 2 // 1_000_000)):
                    at = some[:, None] + np.arange(size)
                    y, f, i = x[at], fresh[at], ids[at]
                    sims = y @ y.transpose(0, 2, 1)
                    good = (f[:, :, None] | f[:, None, :]) & (i[:, :, None] != i[:, None, :]) & (sims > floor[at][:, :, None])
                    g, a, b = np.nonzero(good)
                    found.append((i[g, a], i[g, b], sims[g, a, b]))
        if found:
            a, b, s = (np.concatenate(c) for c in zip(*found))
            # A pair met around several centers goes out once.
            _, once = np.unique(np.c_[a, b], axis=0, return_index=True)
            yield pa.record_batch([pa.array(a[once]), pa.array(b[once]), pa.array(s[once])], names=["id", "nbr", "sim"])


def _kept(edges: DataFrame, length: int, least: float) -> DataFrame:
    """The lists: of every id its nearest ``room`` edges; a saturated list's room doubles."""
    best = edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("room").alias("room"))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), F.asc("nbr"))
    every = Window.partitionBy("id")
    return (best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= LONGEST)
            .withColumn("room", F.greatest(F.max("room").over(every), F.lit(length))).filter("r <= room")
            .withColumn("full", F.count(F.lit(1)).over(every) == F.col("room"))
            .withColumn("last", F.min("sim").over(every))
            .withColumn("room", F.when(F.col("full") & (F.col("last") >= least),
                                       F.least(F.col("room") * 2, F.lit(LONGEST))).otherwise(F.col("room")))
            # A list that may still grow takes every edge over the threshold.
            .withColumn("floor", F.when(~F.col("full"), F.lit(-2.0)).when(F.col("room") < LONGEST, F.least("last", F.lit(least)))
                        .otherwise(F.col("last")).cast("float"))
            .select("id", "nbr", "sim", "fresh", "room", "floor"))


def _round(codes: DataFrame, graph: DataFrame, length: int, least: float) -> DataFrame:
    """Lists after one join of neighbours of neighbours."""
    listing = Window.partitionBy("center").orderBy(F.desc("sim"), F.asc("member"))
    forward = graph.select(F.col("id").alias("center"), F.col("nbr").alias("member"), "fresh")
    backward = (graph.select(F.col("nbr").alias("center"), F.col("id").alias("member"), "fresh", "sim")
                .withColumn("r", F.row_number().over(listing)).filter(F.col("r") <= LIST).select("center", "member", "fresh"))
    members = forward.unionByName(backward)
    moved = members.filter("fresh").select("center").distinct()
    floors = graph.groupBy("id").agg(F.first("floor").alias("floor"))
    known = codes.join(floors, "id", "left").select(F.col("id").alias("member"), "dim", "code",
                                                    F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"))
    around = members.join(moved, "center", "left_semi").join(known, "member")
    better = (around.repartition("center").sortWithinPartitions("center", "member")
              .select("center", "member", "fresh", "floor", "dim", "code").mapInArrow(_join_around, _EDGE))
    mirrored = graph.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "sim")
    new = better.unionByName(mirrored).withColumns({"fresh": F.lit(True), "room": F.lit(0)})
    old = graph.select("id", "nbr", "sim", F.lit(False).alias("fresh"), "room")
    return staged(_kept(old.unionByName(new), length, least), "lists")


def _blocks(members: DataFrame, threshold: float) -> DataFrame:
    """Exact links within groups: ``id``, ``links`` to others of its block pair and
    ``low``, the smallest id that it reaches there.  ``members``: id, v, size, label."""
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    within = members.join(sizes, "label").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    few = within.filter("blocks = 1").agg(F.count(F.lit(1))).first()[0]
    small = within.filter("blocks = 1").withColumns({
        "task": F.pmod(F.xxhash64("label"), F.lit(max(1, few // 8192))), "big": F.lit(-1).cast("long"),
        "i": F.lit(0), "j": F.lit(0), "own": F.lit(0)})
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    large = (within.filter("blocks > 1").withColumn("own", own)
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .withColumns({"task": F.lit(-1).cast("long"), "big": F.col("label"), "i": F.least("own", "other"),
                           "j": F.greatest("own", "other")}))
    columns = ["task", "big", "i", "j", "own", "label", "id", "size", "v"]

    def link(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("label", "ascending"), ("own", "ascending"), ("id", "ascending")])
        label, ids, size = (rows[c].to_numpy() for c in ("label", "id", "size"))
        cross, block = rows["i"][0].as_py() != rows["j"][0].as_py(), rows["own"].to_numpy()
        links, low = np.zeros(len(ids), np.int64), ids.copy()
        starts = np.r_[np.flatnonzero(np.r_[True, label[1:] != label[:-1]]), len(ids)]
        for a, b in zip(starts, starts[1:]):
            x = _matrix(rows["v"].slice(a, b - a))
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if cross:
                near &= block[a:b, None] != block[None, a:b]
            links[a:b] = near @ size[a:b]
            own_low = ids[a:b].copy()
            while True:
                # Every vector takes the smallest id among its links and itself.
                new = np.minimum(own_low, np.where(near, own_low[None, :], np.iinfo(np.int64).max).min(1))
                if (new == own_low).all():
                    break
                own_low = new
            low[a:b] = own_low
        return pa.table({"id": ids, "links": links, "low": low, "big": rows["big"]})

    return staged(small.select(columns).unionByName(large.select(columns)).groupBy("task", "big", "i", "j")
                  .applyInArrow(link, "id long, links long, low long, big long"), "links")


def _audit(classes: DataFrame, counted: DataFrame, threshold: float) -> float:
    """Share of the true links of a sample that were found."""
    order = [F.xxhash64("id"), F.col("id")]
    either = counted.orderBy(*order).limit(AUDIT // 2).unionByName(
        counted.filter("links > 0").orderBy(*order).limit(AUDIT // 2)).distinct()
    # At most AUDIT rows: a broadcast of proven size.
    sample = classes.select("id", "v").join(F.broadcast(either), "id").toArrow().combine_chunks().to_batches()
    if not sample:
        return 1.0
    asked = [(part.column("id").to_numpy(), _matrix(part.column("v"))) for part in _by_length(sample[0], "v")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for part in _by_length(batch, "v"):
                x, ids, size = _matrix(part.column("v")), part.column("id").to_numpy(), part.column("size").to_numpy()
                for own, y in asked:
                    if y.shape[1] == x.shape[1]:
                        near = (y @ x.T >= threshold) & (own[:, None] != ids[None, :])
                        total += int((near @ size).sum())
        yield pa.record_batch([pa.array([total], pa.int64())], names=["n"])

    true = classes.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    found = sum(b.column("links").to_numpy().sum() for b in sample)
    return found / true if true else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # Adding 0.0 makes the two zeros one.
    clean = F.when(usable(F.col("v")), F.transform("v", lambda c: c + F.lit(0.0)))
    own = staged(rows.filter("id IS NOT NULL").withColumn("v", clean).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    classes = staged(own.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")),
                     "classes")
    codes = staged(_codes(classes), "codes")
    n, off = codes.agg(F.count(F.lit(1)), F.max("off")).first()
    # A linked pair's codes are no further apart than this; 1e-5 for 32-bit sums.
    least = float(np.cos(min(np.pi, np.arccos(threshold) + 2 * (off or 0.0)))) - 1e-5
    labels, counted = classes.select("id", F.col("id").alias("label")), classes.select("id", F.lit(0).cast("long").alias("links"))
    length, tables, edges = LIST, 0, None
    while n > 1:
        started = _first_lists(codes, n, range(tables, tables + TABLES), length).withColumns(
            {"fresh": F.lit(True), "room": F.lit(0)})
        edges = started if edges is None else started.unionByName(edges)
        graph = staged(_kept(edges, length, least), "lists")
        tables += TABLES
        near, before = graph.filter(F.col("sim") >= least).count(), -1
        while near > before * (1 + SETTLED):
            graph = _round(codes, graph, length, least)
            near, before = graph.filter(F.col("sim") >= least).count(), near
        found = staged(graph.filter(F.col("sim") >= least).select(F.col("id").alias("a"), F.col("nbr").alias("b")), "edges")
        groups = components.merge(classes.select("id", F.col("id").alias("label")), found)
        linked = _blocks(classes.join(groups, "id"), threshold)
        counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
        counted = staged(classes.select("id").join(counts, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links")),
                         "counted")
        # Groups of one block are done; of larger ones every block pair has its part.
        done = linked.filter("big < 0").select("id", "low")
        start = classes.select("id").join(done, "id", "left").select("id", F.coalesce("low", "id").alias("label"))
        labels = components.merge(staged(start, "labels"),
                                  linked.filter("big >= 0 AND low <> id").select(F.col("id").alias("a"), F.col("low").alias("b")))
        if _audit(classes, counted, threshold) >= RECALL:
            break
        edges, length = graph.select("id", "nbr", "sim", F.lit(False).alias("fresh"), "room"), min(2 * length, LONGEST)
    by_class = classes.join(labels, "id").join(counted, "id").select("v", "label", (F.col("links") + F.col("size") - 1).alias("n"))
    out = own.join(by_class, "v", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("label", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))

"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Method: hierarchical residual packing.  Pieces are dealt evenly into groups;
each group packs best-fit (longest first) on its own and its nearly full bins
are final.  The underfull bins go on as items of their fill, are dealt into
fewer groups and packed best-fit again, until one group is left or a round no
longer merges anything worth another.

* A group has about ``GROUP`` items whatever the input, so no task sees an
  unbounded group; the number of groups follows the count of what is left.
* Only (id, size) pairs take part in the rounds: token ids never move.
* Each round is written to the shared folder; groups and the order inside a
  group follow from ids alone, so a repeated task packs the same way.

Defined results: a null or empty text is one piece of the end token; rows are
packed each for itself, so repeated rows and null ids are fine; an empty table
gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.common import staged
from factloom.llm.tokens import word_tokenizer

#: Items of a group, about; bins with less room left than this share are final;
#: a round that merges away less than this share of its items is the last.
GROUP = 8192
NEARLY_FULL = 1 / 128
WORTH = 0.01


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``capacity``: id, ``piece``, ``start``, ``length``,
    ``ids_crc32`` and, if asked for, ``ids`` (little-endian 32-bit, binary)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, id_type = src.schema["id"].dataType.simpleString(), to_arrow_type(src.schema["id"].dataType)
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "ids_crc32", "ids")}
            for row, text in enumerate(batch.column(1)):
                ids = tokenizer.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    for c, v in zip(rows, (row, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        rows[c].append(v)
            out = {"id": batch.column(0).take(pa.array(rows.pop("row"), pa.int64())).cast(id_type),
                   "piece": pa.array(rows["piece"], pa.int32())}
            out |= {c: pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32")}
            yield pa.record_batch(out | ({"ids": pa.array(rows["ids"], pa.binary())} if with_ids else {}))

    return src.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long"
                          + ", ids binary" * with_ids)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every item, taken in the given order, and the bins'
    fills: an item goes to the open bin with the least room that still holds it.
    Bins are kept by their room; a bit mask tells which rooms exist."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, offsets, fills = 0, [], [], []
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + size
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += size
        room -= size
        by_room[room].append(b)
        rooms |= 1 << room
    return bins, offsets, fills


def _packed_groups(items: DataFrame, groups: int, round_: int, capacity: int) -> DataFrame:
    """One round over (id, size): id, its ``bin``, ``offset`` there and the bin's
    ``fill``.  Bin ids tell round, group and place."""
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "id"], ascending=[False, True])
        bins, offsets, fills = best_fit(group["size"].tolist(), capacity)
        bins = np.asarray(bins, np.int64)
        return pd.DataFrame({"id": group["id"].to_numpy(), "bin": (round_ << 56) + (key[0] << 24) + bins,
                             "offset": offsets, "fill": np.asarray(fills, np.int64)[bins]})

    return (items.withColumn("group", F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(groups)))
            .groupBy("group").applyInPandas(pack, "id long, bin long, offset long, fill long"))


def pack(cut: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Pieces with ``sequence_id`` and their ``offset`` there."""
    cut = staged(cut.withColumnRenamed("id", "doc").withColumn("pid", F.monotonically_increasing_id()), "pieces")
    placed = cut.withColumn("sequence_id", -1 - F.col("pid")).withColumn("offset", F.lit(0).cast("long"))
    items = cut.filter(F.col("length") < capacity).select(F.col("pid").alias("id"), F.col("length").alias("size"))
    full = placed.filter(F.col("length") >= capacity)
    rest, done = placed.filter(F.col("length") < capacity).drop("sequence_id").withColumnRenamed("pid", "bin"), False
    left, round_ = items.count(), 0
    while left and not done:
        groups = -(-left // GROUP)
        moves = staged(_packed_groups(items, groups, round_, capacity), "round")
        rest = (rest.withColumnRenamed("offset", "inner").withColumnRenamed("bin", "id")
                .join(moves.drop("fill"), "id", "left")
                .withColumn("offset", F.col("inner") + F.coalesce("offset", F.lit(0)))
                .withColumn("bin", F.coalesce("bin", "id")).drop("id", "inner"))
        under = moves.filter((F.col("offset") == 0) & (F.col("fill") < capacity * (1 - NEARLY_FULL)))
        items = under.select(F.col("bin").alias("id"), F.col("fill").alias("size"))
        before, left = left, items.count()
        merged = before - moves.filter("offset = 0").count()
        done, round_ = groups == 1 or merged < WORTH * before, round_ + 1
    rest = rest.withColumnRenamed("bin", "sequence_id").select(*full.drop("pid").columns)
    return full.drop("pid").unionByName(rest).withColumnRenamed("doc", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves, from pieces that carry their ``ids``:
    ``sequence_id``, ``n_pieces`` and ``ids`` (binary).  A sequence is bounded by
    the capacity, so a group is too."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.size("parts").alias("n_pieces"),
        F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))

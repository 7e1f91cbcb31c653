"""Exact dedup by deterministic block naming.

Method: the normalised text is cut into blocks of ``BLOCK`` bytes; distinct
blocks are sorted into integer names; adjacent pairs of names are again sorted
into integer names, until each document has one.  (number of blocks, last name)
is equal for two documents exactly when their texts are: names are given to
contents, so nothing can collide.  DataFrame functions only.

* The contents of blocks are shuffled once, after a map-side distinct: a block
  that a third of all documents share costs one copy per task.
* Documents meet their names by a 128-bit hash of the block.  That the hash
  tells all distinct blocks apart is *checked* on the names before it is used;
  if it did not, other seeds are taken.
* Each level halves the names; only documents of more than 2^level blocks take
  part.  Levels are written to the shared folder, so names are fixed before
  they are joined and a lost executor repeats one level's task.

Defined results: null counts as the empty text, which is a text like any other
(one empty block); of equal texts the row with the smallest doc_id stays, null
ids last, and of rows repeating that id one; an empty table gives an empty
table.  Only the id and text columns are read, so extra columns have no effect.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import free_name, let, staged

#: Bytes of a block.
BLOCK = 4096


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _blocks(data: Column) -> Column:
    last = F.greatest(F.ceil(F.length(data) / F.lit(BLOCK)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * BLOCK + 1, F.lit(BLOCK)))


def _hash(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("h2"))


def _named(distinct: DataFrame, order: list[str], keep: list[str], tag: str) -> DataFrame:
    """Distinct contents in sorted order, each with an integer name."""
    return staged(distinct.sortWithinPartitions(*order).select(
        *keep, F.monotonically_increasing_id().alias("name")), tag)


def _block_names(src: DataFrame) -> tuple[int, DataFrame]:
    """The seed of a hash without collisions among the blocks, and the names."""
    blocks = src.select(F.explode(let(normalised(F.col("text")).cast("binary"), _blocks)).alias("block"))
    for seed in count():
        hashed = blocks.select(_hash(F.col("block"), seed).alias("h"), "block").select("h.h1", "h.h2", "block")
        names = _named(hashed.distinct(), ["block"], ["h1", "h2"], "block-names")
        if names.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return seed, names


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seed, names = _block_names(src)
    signed = let(normalised(F.col("text")).cast("binary"), lambda data: F.struct(
        F.sha2(data, 256).alias("sha"), F.transform(_blocks(data), lambda b: _hash(b, seed)).alias("hashes")))
    rows = staged(src.select(F.monotonically_increasing_id().alias("rid"), "id", signed.alias("s"))
                  .select("rid", "id", "s.sha", "s.hashes", F.size("s.hashes").alias("n")), "rows")
    most = rows.agg(F.max("n")).first()[0] or 1

    level = staged(rows.select("rid", "n", F.posexplode("hashes").alias("pos", "h"))
                   .select("rid", "n", "pos", "h.h1", "h.h2")
                   .join(names, ["h1", "h2"]).select("rid", "n", "pos", "name"), "level")
    ended = level.filter("n = 1")
    width = 1
    while width < most:
        odd = F.col("pos") % 2 == 1
        pairs = (level.filter(F.col("n") > width)
                 .groupBy("rid", "n", F.shiftright("pos", 1).alias("pos"))
                 .agg(F.max(F.when(~odd, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b")))
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], "pair-names")
        level = staged(pairs.join(names, ["a", "b"]).select("rid", "n", "pos", "name"), "level")
        width *= 2
        ended = ended.unionByName(level.filter((F.col("n") > width // 2) & (F.col("n") <= width)))

    identified = staged(rows.select("rid", "id", "sha", "n").join(ended.select("rid", "name"), "rid"), "identified")
    # Written before the join, so that AQE may split a large group between plain sides.
    groups = staged(identified.groupBy("n", "name").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("keep"),
        F.count(F.lit(1)).alias("group_size")), "groups")
    return identified.join(groups, ["n", "name"]).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names."""
    groups = staged(exact_groups(docs, id_col, text_col), "groups")
    own, kept_id, sha = (free_name(docs, name) for name in ("__own", "__id", "__sha"))
    kept = groups.filter("kept").select(F.col(id_col).alias(kept_id), F.col("text_sha256").alias(sha))
    signed = docs.withColumn(own, F.sha2(normalised(F.col(text_col)), 256))
    rows = signed.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(sha)), "left_semi")
    repeats = groups.groupBy(id_col, "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeats.isEmpty():  # rows that repeat both id and text
        rows = rows.dropDuplicates([id_col, own])
    return rows.drop(own)

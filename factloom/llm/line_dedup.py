"""Line dedup: lines found in many documents are dropped everywhere.

Method: explode normalised lines, hash, count distinct documents per hash, drop
lines over the threshold, and reassemble by position - DataFrame functions only.

Lines travel as 96-bit hashes (two independent functions): counting and the
join back to documents shuffle a few bytes a line, and the texts move once, to
meet their dropped hashes.  A line in a third of all documents costs one
partial count per task; in the join back it is one side of an equi-join, which
AQE may split.  What a text loses are positions, gathered per id and text (a 64-bit
hash tells the texts of one id apart), so rows that share an id, null ones too, are
not gathered together; taking the positions out is linear in the document.

Defined results: a null or empty text is one empty line; lines whose key is
shorter than ``min_chars`` code points are never dropped; a line repeated in one
document counts once; rows that share a doc_id (also a null one) count as one
document and each row keeps its own lines; an empty table gives an empty table.
Only the id and text columns are read, so extra columns have no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import let, staged

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return let(F.btrim(line, F.lit(_BLANKS)), lambda s: F.when(
        F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, _UPPER, _UPPER.lower())))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_lines`` (before), ``n_dropped`` and the kept ``text``."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashes = F.transform(_lines(F.col("text")), lambda x: let(line_key(x), lambda k: F.when(
        F.char_length(k) >= F.lit(max(min_chars, 1)), _hashed(k))))
    seen = staged(
        src.select("id", F.xxhash64("text").alias("t"), F.posexplode(hashes).alias("pos", "h"))
        .filter("h IS NOT NULL").select("id", "t", "pos", "h.h1", "h.h2"), "lines")
    repeated = (seen.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
                .filter(F.col("n_docs") >= min_docs).select("h1", "h2"))
    repeated = staged(repeated, "repeated-lines")  # a join of two plain sides, which AQE may split or broadcast
    dropped = (seen.join(repeated, ["h1", "h2"], "left_semi")
               .groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
               .select(F.col("id").alias("gone_id"), F.col("t").alias("gone_t"), "gone"))
    both = src.withColumn("t", F.xxhash64("text")).join(
        dropped, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("t") == F.col("gone_t")), "left")
    # One flag a line up to the last that goes: true between two of them.
    gap = lambda p, j: p - F.coalesce(F.get(F.col("gone"), j - 1), F.lit(-1)) - 1
    stays = F.flatten(F.transform("gone", lambda p, j: F.concat(
        F.array_repeat(F.lit(True), gap(p, j)), F.array(F.lit(False)))))
    both = both.select("id", "text", stays.alias("stays"))
    kept = let(_lines(F.col("text")), lambda lines: F.struct(
        F.size(lines).alias("n"),
        F.when(F.col("stays").isNull(), lines).otherwise(F.filter(
            lines, lambda _, i: F.coalesce(F.get(F.col("stays"), i), F.lit(True)))).alias("kept")))
    return both.select("id", kept.alias("r")).select(
        F.col("id").alias(id_col), F.col("r.n").cast("long").alias("n_lines"),
        (F.col("r.n") - F.size("r.kept")).cast("long").alias("n_dropped"),
        F.array_join("r.kept", "\n").alias(text_col))

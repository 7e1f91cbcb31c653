"""Exact row numbering without a single-partition window.

``row_number() over (partition by k order by o)`` puts a whole group in one
task; with a hot key holding a third of the rows that is one task for a third
of the data, and with no key it is one task for everything.  Instead:

1. range-partition on the full sort key (the hot group is cut into several
   ranges, each a task);
2. number rows inside each (range, key) piece;
3. count rows per (range, key) — at most one row per range and key — and
   prefix-sum those counts per key in range order;
4. add the offset of the piece.

The range-partitioned rows are checkpointed (reliable checkpoint into the
cluster's shared ``spark.checkpoint.dir``) before steps 2–3: both branches must
see the very same pieces, and re-running the range exchange per branch does
not guarantee that.  The checkpoint also cuts lineage, so a lost executor
recomputes from the saved pieces.

The result equals the window function's numbering (the sort key must be
unique, as every caller's is).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import cut_lineage


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "idx",
              partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Adds ``out`` = 0-based position of the row inside its ``keys`` group in
    ``order``.  ``keys`` may be empty (one global numbering).  With ``weight`` the
    sum of that column over the rows before instead of their number."""
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                          spark.sparkContext.defaultParallelism)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    key_cols = list(keys)
    ranged = cut_lineage(df.repartitionByRange(n, *[F.col(k) for k in key_cols], *order_cols)
                         .withColumn("_piece", F.spark_partition_id()))
    grp = ["_piece", *key_cols]
    inside = Window.partitionBy(*grp).orderBy(*order_cols)
    local = ranged.withColumn("_local", F.row_number().over(inside) - 1 if weight is None else F.coalesce(
        F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = ranged.groupBy(*grp).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    w = Window.partitionBy(*key_cols).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    # Null keys are a group like any other, so the join back is null-safe.
    named = offsets.select(*[F.col(g).alias(f"_o{i}") for i, g in enumerate(grp)], "_off")
    same = F.lit(True)
    for i, g in enumerate(grp):
        same = same & F.col(g).eqNullSafe(F.col(f"_o{i}"))
    return (local.join(named, same, "inner")
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_piece", "_local", "_off", *[f"_o{i}" for i in range(len(grp))]))

"""Small helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import checkpoint_dir


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row: a lambda over one
    element.  A plain repeated column expression may be evaluated per use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the cluster's shared checkpoint folder and read
    it back: cuts the lineage, and a lost executor loses nothing of it."""
    path = f"{checkpoint_dir(df.sparkSession)}/{tag}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

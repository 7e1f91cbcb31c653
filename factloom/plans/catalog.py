"""Registry of the queries (one per operator row of the survey) and their
DuckDB oracle SQL.  Keys are ``<id>_<slug>``; each query takes
``(spark, sf_dir)`` and reads the driver tables (or data Spark derives from
them) in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from factloom.plans import (  # noqa: F401
        q_annotated, q_articles, q_build, q_codec, q_corpora, q_extend, q_history, q_io, q_relations, q_results, q_scoring,
        q_serial, q_shapes, q_text)

"""factloom — a Spark-native engine for building, serialising, decoding and
scoring text-to-triples datasets, and for the meta-metrics over training
histories.

Everything is expressed as DataFrame / SQL plans: facts live as an ordered
``array<struct<s,p,o,dt>>`` per example (no shuffle needed to serialise),
or as a long ``triples`` table when they must meet other rows in a join.
"""

from factloom.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

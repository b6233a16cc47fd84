"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import mark, release
from .common import materialize


def _with_least(near: DataFrame) -> DataFrame:
    """near(u, v) with m: the least of u and its neighbours."""
    least = near.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return near.join(least, "u")


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the edges (u, v); the component is its least node.

    Both steps only group and join on nodes with pre-aggregated minima, so a hub with any number of neighbours is
    spread like any other rows. Every round is written to the shared folder in place of the one before; rounds grow with
    the logarithm of the longest path. Self-loops and repeated edges do not matter; no edges give no rows.
    """
    since = mark()
    current = materialize(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = _state(current)
    while True:
        both = current.union(current.select("v", "u"))
        large = _with_least(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = (
            _with_least(large)
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        current = materialize(small, "edges")
        release(edges.sparkSession, since, keep=1)
        state = _state(current)
        if state == seen:
            break
        seen = state
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

"""Which interval a point falls into, as an equi-join on buckets instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_lookup(points: DataFrame, intervals: DataFrame, point: str, start: str, length: str, width: int = 4096) -> DataFrame:
    """points joined with the intervals [start, start + length) that hold them.

    An interval is listed in every bucket of `width` it touches, so a width near the usual length lists most once.
    """
    first, last = F.floor(F.col(start) / width), F.floor((F.col(start) + F.col(length) - 1) / width)
    listed = intervals.filter(F.col(length) > 0).withColumn("__bucket", F.explode(F.sequence(first, last)))
    probed = points.withColumn("__bucket", F.floor(F.col(point) / width))
    inside = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(length))
    return probed.join(listed, "__bucket").filter(inside).drop("__bucket")

"""Mixing sources to target weights on a time-varying curriculum.

Each source gets a share of the token budget by weight, never more than `cap` times its size: the excess is shared
again by weight until no source is above its cap (the level at which all capped sources stop is found exactly from
sorted ratios). A source's documents, in an order drawn from a hash, fill its target by cumulative words: whole passes
first, then the last pass up to the target; only the document at the end of the target is taken in part.

The curriculum gives every source a piecewise-linear weight over training time. Its integral, scaled to the source's
target, is the source's cumulative demand; inverting it at the words taken before a document gives the document's time,
and the demand of all sources at that time is its training position in words. Documents are range-sorted by position.

Defined results: a null text has size 0; a document of size 0 is taken 0 times and has no placement; a null source is a
source of its own, last in order; a source of size 0 has target 0; repeated rows are documents of their own, and rows
that share a key (or have none) are told apart by their other columns; rows alike in all columns are placed side by side,
which of them where makes no difference; extra columns are ignored by the assignment; no documents give no rows. Hashes
of whole rows fix the order, so reruns agree, and no key, however frequent, gathers its rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from .common import materialize, words

WEIGHTS = (5, 2, 1)
BUDGET, CAP = 1.5, 2.0
#: Relative weight over time of the first, second, ... source in order, repeating, at evenly spaced moments.
CURRICULUM = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
#: Least rows aimed at in a bucket of a source; large sources use the square root of their rows.
BUCKET_ROWS = 128
#: Copies of one row that are listed by one task.
LOT = 1000


def _integral(curve: Sequence[float]) -> list[float]:
    """Cumulative integral of a piecewise-linear curve at its moments, scaled to end at 1."""
    total, out = 0.0, [0.0]
    for a, b in zip(curve, curve[1:], strict=False):
        total += (a + b) / 2
        out.append(total)
    return [x / total for x in out]


def _normal(curve: Sequence[float]) -> list[float]:
    """The curve scaled so that its integral over [0, 1] is 1."""
    steps = len(curve) - 1
    total = sum((a + b) / 2 for a, b in zip(curve, curve[1:], strict=False)) / steps
    return [x / total for x in curve]


def elapsed(share: Column, curve: Sequence[float]) -> Column:
    """The time in [0, 1] by which a source with this curve has asked for `share` of its target."""
    steps, at = len(curve) - 1, _normal(curve)
    sums = _integral(curve)
    out = F.lit(1.0)
    for k in range(steps - 1, -1, -1):
        slope, base = (at[k + 1] - at[k]) * steps, at[k]
        rest = F.greatest(share - F.lit(sums[k]), F.lit(0.0))
        if abs(slope) < 1e-12:
            inside = rest / base
        else:  # slope / 2 t^2 + base t = rest
            inside = (F.sqrt(F.greatest(F.lit(base * base) + rest * (2 * slope), F.lit(0.0))) - base) / slope
        out = F.when(share <= sums[k + 1], F.least(inside + k / steps, F.lit((k + 1) / steps))).otherwise(out)
    return out


def demand(time: Column, curve: Sequence[float]) -> Column:
    """Share of its target that a source with this curve asks for up to `time`."""
    steps, at = len(curve) - 1, _normal(curve)
    sums = _integral(curve)
    out = F.lit(1.0)
    for k in range(steps - 1, -1, -1):
        slope, base = (at[k + 1] - at[k]) * steps, at[k]
        t = F.greatest(time - F.lit(k / steps), F.lit(0.0))
        out = F.when(time <= (k + 1) / steps, t * t * (slope / 2) + t * base + sums[k]).otherwise(out)
    return out


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """One row per source: source, place (order by code point, null last), source_size, n_rows, weight, target.

    Windows here run over one row per source, after the documents have been aggregated.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights)).cast("int"))
    per = (
        sized.groupBy("source")
        .agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_rows"))
        .withColumn("place", place)
        .withColumn("weight", by)
        .withColumn("limit", F.col("source_size") * cap)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    upto = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, 0)
    # Level at which the sources after this one share what the ones up to it leave.
    left = F.sum("source_size").over(everything) * budget - F.sum("limit").over(upto) + F.col("limit")
    open_weight = F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")
    levelled = per.withColumn("level", left / open_weight).withColumn("fits", F.col("level") <= F.col("ratio"))
    # The first source, in order of ratio, that the level does not fill ends the capped ones.
    final = F.min(F.when(F.col("fits"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * final, F.col("limit")))
    return levelled.withColumn("target", target).select("source", "place", "source_size", "n_rows", "weight", "target")


def assign(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    cap: float = CAP,
    curriculum: Sequence[Sequence[float]] = CURRICULUM,
) -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken, draw (see `identity`) and `placements`.

    placements: array of (position in words from the start of training, words taken) for every pass that takes it.
    """
    # Sizes are counted once; rows alike in every column are one row with a number of copies from here on.
    sized = materialize(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).alias("source"),
            F.size(words(F.col(text))).cast("long").alias("size"),
            identity(docs).alias("draw"),
        )
        .groupBy("key", "source", "size", "draw")
        .agg(F.count("*").alias("copies")),
        "sizes",
    )
    per = materialize(targets(sized, weights, budget, cap), "targets")
    share = F.shiftrightunsigned("draw", 33) / float(1 << 31)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.greatest(F.lit(float(BUCKET_ROWS)), F.sqrt("n_rows"))))
    # Sources are few rows, one each, but their number is not bounded: the join is left to the optimizer.
    dealt = sized.join(per, sized["source"].eqNullSafe(per["source"])).drop(per["source"])
    dealt = dealt.withColumn("bucket", F.least(F.floor(share * buckets), buckets - 1).cast("long")).withColumn("total", F.col("size") * F.col("copies"))
    inside = (
        Window.partitionBy("place", "bucket").orderBy("draw", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        dealt.groupBy("place", "bucket")
        .agg(F.sum("total").alias("bucket_size"))
        .select("place", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    )
    summed = dealt.withColumn("within", F.sum("total").over(inside)).join(sums, ["place", "bucket"])
    placed = _copies(summed.withColumn("first", F.col("offset") + F.col("within") - F.col("total")))
    before = F.col("first") + F.col("copy") * F.col("size")
    budgeted = F.round("target").cast("long")
    passes = []
    for k in range(int(cap) if float(cap).is_integer() else int(cap) + 1):
        start = before + F.col("source_size") * k
        passes.append(F.struct(start.alias("start"), F.greatest(F.lit(0), F.least(F.col("size"), budgeted - start)).alias("taken")))
    spread = placed.withColumn("passes", F.filter(F.array(*passes), lambda p: p["taken"] > 0))
    n = len(curriculum)
    kind = F.col("place") % n

    def time(p: Column) -> Column:
        out = F.lit(None).cast("double")
        for i, curve in enumerate(curriculum):
            out = F.when(kind == i, elapsed(p["start"] / F.col("target"), curve)).otherwise(out)
        return out

    totals = per.groupBy().agg(
        *[F.coalesce(F.sum(F.when(F.col("place") % n == i, F.col("target"))), F.lit(0.0)).alias(f"t{i}") for i in range(n)]
    )

    def position(t: Column) -> Column:
        return sum((F.col(f"t{i}") * demand(t, curve) for i, curve in enumerate(curriculum)), F.lit(0.0))

    timed = spread.join(F.broadcast(totals)).withColumn(  # one row
        "timed", F.transform("passes", lambda p: F.struct(time(p).alias("time"), p["taken"].alias("taken")))
    )
    return timed.select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "draw",
        "size",
        "source_size",
        "target",
        F.aggregate("timed", F.lit(0).cast("long"), lambda a, p: a + p["taken"]).alias("taken"),
        F.transform("timed", lambda p: F.struct(position(p["time"]).alias("position"), p["taken"].alias("words"))).alias("placements"),
    )


def identity(docs: DataFrame) -> Column:
    """A hash of the whole row, which is its draw; columns that cannot be hashed count as text."""
    return F.xxhash64(*[F.to_json(c) if isinstance(docs.schema[c].dataType, MapType) else F.col(c) for c in docs.columns], F.lit("mix"))


def _copies(rows: DataFrame) -> DataFrame:
    """rows once for each of their copies, numbered in `copy`; many copies are dealt out in lots first."""
    few = rows.filter(F.col("copies") <= LOT).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    lots = rows.filter(F.col("copies") > LOT).withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / LOT))))
    last = F.least(F.col("lot") * LOT + LOT, F.col("copies")) - 1
    many = lots.repartition("draw", "lot").withColumn("copy", F.explode(F.sequence(F.col("lot") * LOT, last))).drop("lot")
    return few.unionByName(many)


def training_order(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs in training order, once for every pass that takes at least half of them."""
    placed = materialize(assign(docs, key=key, **options).select("draw", "size", "placements"), "placed")
    copies = placed.select(F.col("draw").alias("__draw"), "size", F.explode("placements").alias("__at")).filter(
        2 * F.col("__at.words") >= F.col("size")
    ).select("__draw", "__at")
    known = docs.withColumn("__draw", identity(docs))
    # Rows alike in every column share their draw: one of them stands for all, and takes all their placements.
    repeated = materialize(placed.groupBy("draw").count().filter("count > 1").select(F.col("draw").alias("__draw")), "repeated")
    if not repeated.isEmpty():
        once = known.join(repeated, "__draw", "left_semi").dropDuplicates(["__draw"]).select(known.columns)
        known = known.join(repeated, "__draw", "left_anti").select(known.columns).unionByName(once)
    return (
        known.join(copies, "__draw")
        .repartitionByRange(F.col("__at.position"), F.col(key))
        .sortWithinPartitions("__at.position", key)
        .select(*docs.columns)
    )

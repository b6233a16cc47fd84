"""k-hop neighbourhoods as joins: all seeds (and all variants of the graph) at once, one join and one anti-join a hop.

`keys` name the columns that tell balls apart: the seed, and whatever else its traversal depends on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.staging import staged

SEED = ("seed",)
#: Rows of a frontier up to which it is sent to the edges instead of the edges being shuffled to it.
BROADCAST_ROWS = 200_000


def balls(
    seeds: DataFrame, half_edges: DataFrame, hops: int, active: DataFrame | None = None, keys: Sequence[str] = SEED
) -> DataFrame:
    """(*keys, node, depth) of every node within `hops`; seeds(*keys) are in their balls even if not active(node).

    Edges may carry `mask`, the variants in which their target is active as bits; then keys hold the number `variant`.
    Every hop is staged, so the plan stays one join deep and a lost executor repeats one hop.
    """
    masked = "mask" in half_edges.columns
    reached = seeds.select(*keys, F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = reached = staged(reached, "frontier")
    for depth in range(1, hops + 1):
        # The count reads file footers only.
        near = F.broadcast(frontier) if frontier.count() <= BROADCAST_ROWS else frontier
        step = half_edges.join(near, half_edges["src"] == near["node"])
        if masked:
            step = step.filter(F.expr("(mask >> variant) & 1 = 1"))
        step = step.select(*keys, F.col("dst").alias("node")).distinct()
        if active is not None:
            step = step.join(active.select("node"), "node", "left_semi").select(*keys, "node")
        frontier = staged(step.join(reached, [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        reached = reached.unionAll(frontier)
    return reached


def by_hop(reached: DataFrame, hops: int) -> DataFrame:
    """Every ball repeated for each hop that contains it, with `hop`; hops is small and fixed."""
    return reached.withColumn("hop", F.explode(F.sequence(F.greatest("depth", F.lit(1)), F.lit(hops))))


def _cells(keys: Sequence[str], grouped: DataFrame) -> DataFrame:
    return grouped.select(*keys, F.explode("cells").alias("c")).select(*keys, "c.*")


def ball_sizes(reached: DataFrame, token_len: DataFrame, hops: int, prompt_tokens: int = 24, keys: Sequence[str] = SEED) -> DataFrame:
    """(*keys, hop, nodes, tokens): tokens(node, token_len) summed over the ball plus a flat prompt."""
    weighed = reached.join(token_len, "node", "left")
    cells = []
    for k in range(1, hops + 1):
        inside = F.col("depth") <= k
        cells.append(
            F.struct(
                F.lit(k).alias("hop"),
                F.count_if(inside).alias("nodes"),
                (F.coalesce(F.sum(F.when(inside, F.col("token_len"))), F.lit(0)) + prompt_tokens).cast("long").alias("tokens"),
            )
        )
    return _cells(keys, weighed.groupBy(*keys).agg(F.array(*cells).alias("cells")))


def induced_edges(reached: DataFrame, half_edges: DataFrame, hops: int, keys: Sequence[str] = SEED) -> DataFrame:
    """(*keys, hop, edges): edges with both ends in the ball, multiplicity kept, half-edges halved after summing."""
    inner = reached.select(*keys, F.col("node").alias("src"), F.col("depth").alias("src_depth"))
    outer = reached.select(*keys, F.col("node").alias("dst"), F.col("depth").alias("dst_depth"))
    both = inner.join(half_edges.select("src", "dst"), "src").join(outer, [*keys, "dst"]).withColumn("reach", F.greatest("src_depth", "dst_depth"))
    cells = [F.struct(F.lit(k).alias("hop"), F.floor(F.count_if(F.col("reach") <= k) / 2).cast("long").alias("edges")) for k in range(1, hops + 1)]
    found = _cells(keys, both.groupBy(*keys).agg(F.array(*cells).alias("cells")))
    every = reached.filter("depth = 0").select(*keys).withColumn("hop", F.explode(F.sequence(F.lit(1), F.lit(hops))))
    return every.join(found, [*keys, "hop"], "left").fillna(0, ["edges"])


def capped(edges: DataFrame, owner: str, rank: list, cap: int) -> DataFrame:
    """At most `cap` rows per owner by rank; the window limit prunes before the shuffle."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*rank))
    return edges.withColumn("__place", place).filter(F.col("__place") <= cap).drop("__place")


def union_balls(members: DataFrame, reached: DataFrame) -> DataFrame:
    """(item, node, depth): union of the balls of an item's seeds, each node at its least depth. members(item, seed)."""
    return members.join(reached, "seed").groupBy("item", "node").agg(F.min("depth").alias("depth"))


def composition(reached: DataFrame, types: DataFrame, hops: int, shown: Sequence[str] | None = None) -> DataFrame:
    """(hop, type, nodes_per_seed) averaged over seeds; types(node, type). Types not `shown` are summed as `other`."""
    seeds = reached.agg(F.count_distinct("seed").alias("seeds"))  # one row
    kind = F.col("type") if shown is None else F.when(F.col("type").isin(*shown), F.col("type")).otherwise("other")
    counted = by_hop(reached, hops).join(types, "node").groupBy("hop", kind.alias("type")).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(seeds)).select("hop", "type", (F.col("n") / F.col("seeds")).alias("nodes_per_seed"))

"""Seeds, variants and summaries of ball sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..plans.staging import staged
from . import traverse

PERCENTS = (10, 25, 50, 75, 90, 95, 99)


def draw(seed: int, key: Column) -> Column:
    """A reproducible draw for every key, whatever the partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(nodes: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement in the order of their draws."""
    return nodes.orderBy(draw(seed, F.col(key)), key).limit(n)


def seed_pool(nodes: DataFrame, generation: int = 3) -> DataFrame:
    """(seed, ...) that may be drawn: from the third generation on anchors with a text; in the second, lexical units with
    a text; in the first, lexical units. nodes(key or node, kind, type_id, is_mwe, token_len) as the generation has them."""
    rule = {
        3: (F.col("kind") == vocab.ANCHOR) & (F.col("token_len") > 0) if "kind" in nodes.columns else F.lit(False),
        2: (F.col("type_id") == vocab.TYPES["lexical-unit"]) & (F.col("token_len") > 0),
        1: F.col("type_id") == vocab.TYPES["lexical-unit"],
    }[generation]
    key = "key" if "key" in nodes.columns else "node"
    return nodes.filter(rule).select(F.col(key).alias("seed"), *[c for c in ("is_mwe",) if c in nodes.columns])


def summary(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """n, mean, least, greatest and exact, linearly interpolated percentiles of a column."""
    p = F.percentile(F.col(value).cast("double"), [x / 100 for x in PERCENTS])
    agg = df.groupBy(*groups).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), p.alias("p")
    )
    return agg.select(*groups, "n", "mean", "min", "max", *[F.get("p", F.lit(i)).alias(f"p{x}") for i, x in enumerate(PERCENTS)])


#: Name of a variant part -> kinds it leaves out.
_PARTS = (
    (("expand", ()), ("collapse", (vocab.FORM,))),
    (("examples", ()), ("noexamples", (vocab.EXAMPLE,))),
    (("colloc", ()), ("nocolloc", (vocab.COLLOCATION,))),
)


def variants() -> dict[str, tuple[int, ...]]:
    """The eight variants and the kinds each leaves out of the traversal."""
    out: dict[str, tuple[int, ...]] = {"": ()}
    for part in _PARTS:
        out = {f"{name}_{more}".strip("_"): kinds + gone for name, kinds in out.items() for more, gone in part}
    return out


def masks(kind: Column, only: Sequence[str] | None = None) -> Column:
    """Bits of the variants in which a node of this kind is active, the first variant lowest."""
    names = list(only or variants())
    out = F.lit(0)
    for bit, name in enumerate(names):
        gone = variants()[name]
        out = out + F.when(kind.isin(*gone) if gone else F.lit(False), 0).otherwise(1 << bit)
    return out


def study(
    nodes: DataFrame, half_edges: DataFrame, seeds: DataFrame, hops: int = 3, prompt_tokens: int = 24, only: Sequence[str] | None = None
) -> DataFrame:
    """Summaries (variant, hop, seed_kind, metric, n, mean, ...) for all, word and multi-word seeds.

    nodes(node, kind, token_len), seeds(seed, is_mwe). Edges get the variants of their target as bits and are staged
    once; every seed starts once a variant, and one traversal serves them all.
    """
    names = list(only or variants())
    keys = ("variant", "seed")
    targets = nodes.select(F.col("node").alias("dst"), masks(F.col("kind"), names).alias("mask"))
    edges = staged(half_edges.select("src", "dst").join(targets, "dst").select("src", "dst", "mask"), "masked-edges")
    starts = seeds.select("seed").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    reached = traverse.balls(starts, edges, hops, keys=keys)
    sized = traverse.ball_sizes(reached, nodes.select("node", "token_len"), hops, prompt_tokens, keys)
    both = sized.join(traverse.induced_edges(reached, edges, hops, keys), [*keys, "hop"]).join(seeds, "seed")
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("nodes", "edges", "tokens")]))
    kinds = F.explode(F.array(F.lit("all"), F.when(F.col("is_mwe"), "mwe").otherwise("word")))
    rows = both.withColumn("m", metrics).withColumn("seed_kind", kinds)
    named = F.get(F.array(*[F.lit(x) for x in names]), F.col("variant")).alias("variant")
    rows = rows.select(named, "hop", "seed_kind", F.col("m.metric").alias("metric"), F.col("m.value").alias("value"))
    return summary(rows, "value", ["variant", "hop", "seed_kind", "metric"])

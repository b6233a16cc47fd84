"""Earlier generations of the graph as projections: typed, undirected and simple, or typed and directed with labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, vocab
from ..plans.staging import staged
from . import build, traverse

#: Variants of the second generation and the text kinds they leave out.
VARIANTS = {
    "expand_examples": (),
    "collapse_examples": (vocab.FORM,),
    "expand_noexamples": (vocab.EXAMPLE,),
    "collapse_noexamples": (vocab.FORM, vocab.EXAMPLE),
}


def first_generation(triples: DataFrame, hosts: Sequence[str] = vocab.HOSTS, decomposition: bool = True) -> DataFrame:
    """(lo, hi, pred): one predicate per undirected pair of codes, the least; without decomposition if so asked."""
    kept = [p for p in vocab.TYPED_PREDICATES if decomposition or p not in vocab.DECOMPOSITION]
    ids = F.create_map(*[F.lit(x) for p in kept for x in (p, vocab.TYPED_PREDICATES[p][0])])
    ends = triples.filter(F.col("is_iri") & F.col("p").isin(*kept)).select(
        scalar.node_code(F.col("s"), hosts).alias("a"), scalar.node_code(F.col("o"), hosts).alias("b"), F.try_element_at(ids, F.col("p")).alias("pred")
    )
    return least_predicates(ends)


def least_predicates(ends: DataFrame) -> DataFrame:
    """(lo, hi, pred) of undirected ends(a, b, pred): the least predicate of every pair, no self-loops."""
    inner = ends.filter("a is not null and b is not null and a <> b")
    return inner.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("pred").alias("pred"))


def label_tokens(labelled: DataFrame, group: Column, tokens=scalar.token_proxy) -> DataFrame:
    """(group, label_tokens): tokens of the labels of undirected edges, summed over half-edges and halved after the sum."""
    half = labelled.select(group.alias("group"), F.explode(F.array(F.lit(0), F.lit(1))), tokens(F.col("label")).alias("k"))
    return half.groupBy("group").agg(F.floor(F.sum("k") / 2).cast("long").alias("label_tokens"))


def predicate_label(pred: Column) -> Column:
    labels = dict(vocab.TYPED_PREDICATES.values())
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), pred)


def first_generation_texts(triples: DataFrame, hosts: Sequence[str] = vocab.HOSTS) -> DataFrame:
    """(code, text): a definition or value before a written form; values count in any language, the others in Slovene."""
    priority = F.when(F.col("p").isin(vocab.SKOS + "definition", vocab.RDF + "value"), 1).when(F.col("p") == vocab.ONTOLEX + "writtenRep", 2)
    passes = (F.col("p") == vocab.RDF + "value") | scalar.is_slovene(F.col("tail"))
    found = triples.filter(~F.col("is_iri") & passes).select(scalar.node_code(F.col("s"), hosts).alias("code"), priority.alias("priority"), "lit")
    return best_texts(found.filter("code is not null and priority is not null")).select("code", "text")


def best_texts(found: DataFrame) -> DataFrame:
    """(code, text, priority): of found(code, priority, lit) the text of least priority, then the least."""
    best = found.groupBy("code").agg(F.min(F.struct("priority", "lit")).alias("b"))
    return best.select("code", F.col("b.lit").alias("text"), "b.priority")


def second_generation(triples: DataFrame, hosts: Sequence[str] = vocab.HOSTS) -> DataFrame:
    """(src, dst, rel) as codes: the directed edges of the second generation, heads among them, both directions of a
    translation as one relation from form to sense, and parts contracted to words."""
    keys = dict(vocab.SECOND_PREDICATES)
    named = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    ends = triples.filter(F.col("is_iri") & F.col("p").isin(*keys)).select(
        scalar.node_code(F.col("s"), hosts).alias("s"), scalar.node_code(F.col("o"), hosts).alias("o"), F.try_element_at(named, F.col("p")).alias("rel")
    ).filter("s is not null and o is not null")
    ends = staged(ends, "ends")  # read three times, and the lines but once
    mwe = build.contract(
        ends.filter("rel = 'constituent'").select(F.col("s").alias("mwe"), F.col("o").alias("part")),
        ends.filter("rel = 'corresponds'").select(F.col("s").alias("part"), F.col("o").alias("word")),
    )
    back = F.col("rel") == "translation back"
    plain = ends.filter(~F.col("rel").isin("constituent", "corresponds")).select(
        F.when(back, F.col("o")).otherwise(F.col("s")).alias("src"),
        F.when(back, F.col("s")).otherwise(F.col("o")).alias("dst"),
        F.when(back, "translation").otherwise(F.col("rel")).alias("rel"),
    )
    return plain.unionByName(mwe.select(F.col("mwe").alias("src"), F.col("word").alias("dst"), F.lit("constituent").alias("rel"))).distinct()


def with_labels(edges: DataFrame) -> DataFrame:
    """edges(src, dst, rel) with the second generation's relation id and label; unlabelled relations are left out."""
    known = edges.filter(F.col("rel").isin(*vocab.RELATIONS))
    ids = F.create_map(*[F.lit(x) for k, (i, _) in vocab.RELATIONS.items() for x in (k, i)])
    labels = F.create_map(*[F.lit(x) for k, (_, t) in vocab.RELATIONS.items() for x in (k, t)])
    return known.withColumns({"rel_id": F.element_at(ids, F.col("rel")), "label": F.element_at(labels, F.col("rel"))})


def levi_sizes(reached: DataFrame, labelled: DataFrame, token_len: DataFrame, hops: int, tokens=scalar.token_proxy) -> DataFrame:
    """(seed, hop, orig_nodes, induced_edges, levi_nodes, tokens): every edge is a node of its own with its label's tokens.

    labelled(src, dst, label); label tokens are summed over induced half-edges and halved after the sum.
    """
    half = labelled.select("src", "dst", tokens(F.col("label")).alias("k")).unionAll(
        labelled.select(F.col("dst").alias("src"), F.col("src").alias("dst"), tokens(F.col("label")).alias("k"))
    )
    inner = reached.select("seed", F.col("node").alias("src"), F.col("depth").alias("d1"))
    outer = reached.select("seed", F.col("node").alias("dst"), F.col("depth").alias("d2"))
    both = inner.join(half, "src").join(outer, ["seed", "dst"]).withColumn("reach", F.greatest("d1", "d2"))
    cells = [
        F.struct(
            F.lit(k).alias("hop"),
            F.floor(F.count_if(F.col("reach") <= k) / 2).cast("long").alias("induced_edges"),
            F.floor(F.coalesce(F.sum(F.when(F.col("reach") <= k, F.col("k"))), F.lit(0)) / 2).cast("long").alias("label_tokens"),
        )
        for k in range(1, hops + 1)
    ]
    counted = both.groupBy("seed").agg(F.array(*cells).alias("c")).select("seed", F.explode("c").alias("c")).select("seed", "c.*")
    sized = traverse.ball_sizes(reached, token_len, hops).join(counted, ["seed", "hop"], "left").fillna(0, ["induced_edges", "label_tokens"])
    return sized.select(
        "seed",
        "hop",
        F.col("nodes").alias("orig_nodes"),
        "induced_edges",
        (F.col("nodes") + F.col("induced_edges")).alias("levi_nodes"),
        (F.col("tokens") + F.col("label_tokens")).alias("tokens"),
    )

"""Spelling, id and raw-triple lookups over a graph; every method returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, vocab
from .build import Graph

BASE_KINDS = (vocab.ANCHOR, vocab.FORM)
RANK_CAP = 200_000


def kinds_named(names: list[str]) -> set[int]:
    """Kinds chosen by name; 'all' and 'vse' choose every kind; other names raise ValueError."""
    out: set[int] = set()
    for name in names:
        if name in ("all", "vse"):
            return set(range(9))
        if name not in vocab.KIND_NAMES:
            raise ValueError(f"unknown kind {name!r}")
        out.add(vocab.KIND_NAMES[name])
    return out


class Lexicon:
    def __init__(self, graph: Graph):
        self.graph = graph

    def matches(self, word: str) -> DataFrame:
        """Nodes whose text holds the word in one of its usual casings."""
        hit = scalar.any_of(*[F.col("text").contains(v) for v in scalar.case_variants(word)])
        return self.graph.nodes.filter(hit)

    def word(self, word: str, also: list[str] | None = None, rank_cap: int = RANK_CAP) -> DataFrame:
        """(kind, tier, label, key, text) of the searched kinds, best first; counts in `counts` stay exact beyond rank_cap.

        One ordered limit a kind: tasks keep their least rank_cap rows, and those alone are merged.
        """
        wanted = sorted(set(BASE_KINDS) | kinds_named(also or []))
        found = self.matches(word)
        ranked = None
        for kind in wanted:
            one = found.filter(F.col("kind") == kind).orderBy("key").limit(rank_cap)
            ranked = one if ranked is None else ranked.unionAll(one)
        return ranked.select(
            "kind",
            scalar.tier(F.col("text"), F.col("kind"), word).alias("tier"),
            scalar.node_label(F.col("code"), F.col("key")).alias("label"),
            "key",
            "text",
        ).orderBy("kind", "tier", "label")

    def best_forms(self, ranked: DataFrame) -> DataFrame:
        """(key) of the forms in the best tier that forms reach, from the rows of `word`."""
        forms = ranked.filter(F.col("kind") == vocab.FORM)
        best = forms.agg(F.min("tier").alias("best"))  # one row
        return forms.join(F.broadcast(best), F.col("tier") == F.col("best"), "left_semi").select("key")

    def inflected_only(self, ranked: DataFrame) -> DataFrame:
        """One row: whether a form bears the word exactly and no headword does."""
        exact = lambda kind: F.count_if((F.col("kind") == kind) & (F.col("tier") == 0)) > 0
        return ranked.agg((exact(vocab.FORM) & ~exact(vocab.ANCHOR)).alias("inflected_only"))

    def unsearched(self, word: str, also: list[str] | None = None) -> DataFrame:
        """(kind, nodes) of the kinds that `word` does not rank but that hold the word, most first."""
        wanted = set(BASE_KINDS) | kinds_named(also or [])
        return self.counts(word).filter(~F.col("kind").isin(*wanted))

    def counts(self, word: str) -> DataFrame:
        return self.matches(word).groupBy("kind").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "kind")

    def headwords(self, forms: DataFrame) -> DataFrame:
        """(form, headword, text): the anchors one edge away from forms(key)."""
        half = self.graph.half_edges
        anchors = self.graph.nodes.filter(F.col("type_id") == vocab.TYPES["lexical-unit"]).select(F.col("key").alias("headword"), "text")
        near = forms.select(F.col("key").alias("form")).join(half, F.col("form") == half["src"]).select("form", F.col("dst").alias("headword"))
        return near.join(anchors, "headword").distinct().select("form", "headword", "text")

    def raw(self, triples: DataFrame, iri: str) -> DataFrame:
        """Triples that touch a name, marked out or in; a self-loop counts as out."""
        hit = triples.filter((F.col("s") == iri) | (F.col("o") == iri))
        return hit.withColumn("direction", F.when(F.col("s") == iri, "out").otherwise("in"))

    def raw_id(self, triples: DataFrame, number: int, host: str = vocab.HOSTS[0]) -> DataFrame:
        return self.raw(triples, f"{host}lexical-unit-{number}")

    def raw_word(self, triples: DataFrame, word: str, lang: str | None = None) -> DataFrame:
        """Triples whose literal is exactly the word; lang matches as the beginning of the tag."""
        hit = triples.filter(F.col("lit") == word)
        return hit.filter(F.col("lang").startswith(lang)) if lang else hit

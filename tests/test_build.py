import pytest
from pyspark.sql import functions as F

from graphloom.operators import build
from graphloom.sources import ntriples

from . import golden


@pytest.fixture(scope="module")
def graph(spark):
    lines = spark.createDataFrame([(x,) for x in golden.lines()], "value string")
    g = build.build(ntriples.parse(lines))
    return build.Graph(g.nodes.cache(), g.edges.cache(), g.parts)


def test_golden_texts(graph):
    assert {r["key"]: (r["kind"], r["text"]) for r in graph.nodes.collect()} == golden.TEXTS


def test_golden_counts(graph):
    assert graph.nodes.count() == 16 and graph.edges.count() == 17 and graph.half_edges.count() == 34
    degree = graph.half_edges.groupBy("src").count()
    minted = graph.nodes.filter("type_id = -1").join(degree, F.col("key") == F.col("src"))
    assert {r["count"] for r in minted.collect()} == {2}
    assert [r["key"] for r in graph.nodes.filter("is_mwe").collect()] == [golden.code("lexical-unit-9")]
    assert {(r["size"], r["owners"]) for r in build.member_histogram(graph.parts["members"]).collect()} == {(1, 1), (2, 2)}


def test_ends_exist_and_order_does_not_matter(spark, graph):
    ends = graph.half_edges.select("src").distinct()
    assert ends.join(graph.nodes, F.col("src") == F.col("key"), "left_anti").isEmpty()
    lines = spark.createDataFrame([(x,) for x in reversed(golden.lines())], "value string").repartition(3)
    again = build.build(ntriples.parse(lines)).nodes
    assert again.exceptAll(graph.nodes).isEmpty() and graph.nodes.exceptAll(again).isEmpty()


def test_pair_text_changes_collocations_only(spark, graph):
    lines = spark.createDataFrame([(x,) for x in golden.lines()], "value string")
    pair = build.build(ntriples.parse(lines), colloc_text="pair").nodes
    changed = pair.exceptAll(graph.nodes).collect()
    assert [(r["kind"], r["text"]) for r in changed] == [(5, "kolokacija: boj + kriminaliteta")]

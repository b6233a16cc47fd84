import random
from collections import defaultdict

import pytest

from graphloom.operators import sizing
from graphloom.plans import catalog, graph_queries, registry

from .oracle import FOLDER, rows_by_sql, rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    assert rows_of(spark, registry.QUERIES[name]) == rows_by_sql(registry.ORACLES[name])


def test_entry_runs_without_the_training_data_operators(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_whole_tables_reach_the_operators(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect()
    pairs = {tuple(r) for r in lines}
    got = {tuple(r) for r in registry.QUERIES["edge_symmetry_check"](spark, FOLDER).select("src", "dst").collect()}
    assert got == {(a, b) for a, b in pairs if (b, a) not in pairs}
    ids = {r["id"] for r in registry.QUERIES["question_units"](spark, FOLDER).select("id").distinct().collect()}
    assert ids == {r["p_partkey"] for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect()}


def test_study_with_production_parameters(spark, tmp_path):
    r = random.Random(8)
    sizes, status = {p: r.randint(1, 30) for p in range(1, 16)}, {o: r.choice("FPO") for o in range(1, 13)}
    spark.createDataFrame([(p, "name " * (p % 4 + 1), s) for p, s in sizes.items()], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(o, "1-URGENT", s) for o, s in status.items()], "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(r.randint(1, 12), r.randint(1, 15), k) for k in range(26)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    tables = catalog.Tables(spark, str(tmp_path))
    near = defaultdict(list)
    for row in graph_queries.half(tables).collect():
        near[row["src"]].append(row["dst"])
    assert {b for a in near for b in near[a]} == set(near) and len(near) > 20
    kinds = {row["node"]: row["kind"] for row in graph_queries.study_nodes(tables).collect()}

    def ball(seed, hops, gone):
        depth, last = {seed: 0}, [seed]
        for k in range(1, hops + 1):
            last = {b for a in last for b in near[a] if b not in depth and kinds[b] not in gone}
            depth |= dict.fromkeys(last, k)
        return depth

    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    got = {(x["seed"], x["node"], x["depth"]) for x in run("khop_balls")}
    assert got == {(p, n, d) for p in sizes for n, d in ball(p, 3, ()).items()} and {d for *_, d in got} == {0, 1, 2, 3}
    want = {(p, h): sum(b in own for a in own for b in near[a]) // 2 for p in sizes for h in (1, 2, 3) for own in [ball(p, h, ())]}
    assert {(x["seed"], x["hop"]): x["edges"] for x in run("neighbourhood_lookup")} == want
    report = {(x["variant"], x["hop"]): (x["n"], x["mean"]) for x in run("sizing_study") if x["seed_kind"] == "all" and x["metric"] == "nodes"}
    assert len(report) == 24 and graph_queries.SEEDS == 400
    for (variant, hop), (n, mean) in report.items():
        counts = [len(ball(p, hop, sizing.variants()[variant])) for p in sizes]
        assert n == 15 and abs(mean - sum(counts) / 15) < 1e-5

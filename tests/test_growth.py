"""What keeps a query's work in proportion to its tables, and results on keys that the small tables lack."""

from graphloom.functions import vocab
from graphloom.operators import qa, store
from graphloom.plans import lexicon_queries, qa_queries, registry
from graphloom.plans.catalog import Tables
from graphloom.sources import ntriples

from .oracle import FOLDER


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_partners_without_a_name_are_none(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(k, f"NATION_{k}") for k in range(3)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    pairs = [(1, 0), (2, 1), (7, 2), (8, 30), (40, 9), (2, 30), (1, 99)]
    spark.createDataFrame(pairs, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    db = duckdb.connect()
    for name in ("nation", "supplier"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(db.sql(registry.ORACLES["antonym_list"]).fetchall())
    got = registry.QUERIES["antonym_list"](spark, str(tmp_path)).select("anchor", "gold", "tier", "split").collect()
    assert sorted(map(tuple, got)) == want and {r[0] for r in want} == {0, 1, 2, 7, 30, 99}


def test_questions_are_listed_last(spark, monkeypatch):
    monkeypatch.setattr(qa, "UNIT_CHUNK", 3)
    asked = [(1, "Kaj je rdeč vrh?"), (2, "rdeč, rdeč vrh kaj"), (3, "vrh"), (4, "kaj"), (5, "?"), (6, "neznan vrh"), (7, None)]
    index = [("rdeč", u) for u in range(20)] + [("vrh", u) for u in range(15, 40)] + [("kaj", 99), ("vrh", 16)]
    found = qa.extracted(
        spark.createDataFrame(asked, "id long, question string"), spark.createDataFrame(index, "surface string, unit long").distinct(), ("kaj",)
    )
    vrh, both = range(15, 40), range(40)
    want = [(i, u) for i, units in ((1, both), (2, both), (3, vrh), (6, vrh)) for u in units]
    assert sorted(map(tuple, found.collect())) == want
    logical, _ = _plan(found)
    assert "Generate explode(units" in logical.split("Join")[0] and "Aggregate" not in logical.split("Join")[0]
    pairs = spark.createDataFrame([(1, 5), (3, 5), (4, 99), (8, 1)], "id long, unit long")
    rates = qa.extraction_rates(pairs, *qa.named_units(spark.createDataFrame(asked, "id long, question string"), spark.createDataFrame(index, "surface string, unit long").distinct(), ("kaj",)))
    assert tuple(rates.first()) == (4, 0.25, 0.5)


def test_cells_are_dealt_out_by_part_and_moved_once(spark, monkeypatch):
    monkeypatch.setattr(qa_queries, "PARTS_A_TASK", 30)
    tables = Tables(spark, FOLDER)
    tasks = -(-tables.part.count() // 30)
    assert qa_queries._slots(tables, 18).rdd.getNumPartitions() == tasks
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("paradigm_table", "paradigm_by_number", "single_cell", "verb_paradigm", "verb_tenses"):
            plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_rules_read_written_graphs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lexicon_queries.store, "text_rules", lambda *graphs: seen.extend(graphs) or graphs[0].nodes.selectExpr("key AS check", "0L AS found").limit(0))
    monkeypatch.setattr(lexicon_queries.store, "edge_rules", lambda *graphs: graphs[0].nodes.selectExpr("key AS check", "0L AS found").limit(0))
    registry.QUERIES["store_rules"](spark, FOLDER)
    assert len(seen) == 2 and not any("Join" in _plan(df)[0] for g in seen for df in (g.nodes, g.edges))


def test_asymmetric_edges_need_no_join(spark):
    rows = [(1, 2), (2, 1), (3, 1), (3, 1), (1, 4), (5, 5), (6, None), (None, 6), (None, None)]
    half = spark.createDataFrame(rows, "src long, dst long")
    key = lambda r: repr(tuple(r))
    want = [(3, 1), (3, 1), (1, 4), (6, None), (None, 6), (None, None)]
    assert sorted(map(tuple, store.asymmetric(half).collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, store.asymmetric(half, distinct=True).collect()), key=key) == sorted(set(want), key=key)
    logical, _ = _plan(registry.QUERIES["edge_symmetry_check"](spark, FOLDER))
    assert "Join" not in logical and logical.count("Aggregate") == 1


def test_senses_move_by_entry_only(spark):
    logical, _ = _plan(registry.QUERIES["sense_text"](spark, FOLDER))
    read = [x for x in logical.splitlines() if "Relation" in x and "l_suppkey" in x]
    assert "struct(lu" not in logical and len(read) == 2


def test_partner_lists_are_dealt_out_by_lines(spark, monkeypatch):
    monkeypatch.setattr(qa_queries, "LINES_A_TASK", 500)
    tables = Tables(spark, FOLDER)
    tasks = -(-tables.lineitem.count() // 500)
    for name in ("synonym_list", "counted_list"):
        logical, _ = _plan(registry.QUERIES[name](spark, FOLDER))
        assert logical.count(f", {tasks}\n") == 2 and tasks > 4 and logical.count("parquet") == 2


def test_lines_are_cut_by_bytes(spark):
    """Against the cutting in plain Python, on names and literals of several bytes a character and on broken lines."""
    rows = ["<š> <p> <č> .", "<> <> <> .", "<a> <b> <c .", '<ž> <p> """čš"x"""@sl .', '<a> <p> "é" .', '<a> <p> "open', "<a> <b>", "<a <p> <o> .", "x> <p> <o>", "<a> <p> 5 .", None, "", "<", "<a> <p> <", "<😀> <p> <😀> <b> <c>"]

    def cut(line):
        head, found, rest = (line or "").partition("> <")
        p, more, raw = rest.partition("> ")
        if not (line and line.startswith("<") and found and more):
            return []
        quotes = '"""' if raw.startswith('"""') else '"'
        lit, closed, tail = raw[len(quotes) :].partition(quotes)
        if raw.startswith("<"):
            return [(head[1:], p, raw[1:].partition(">")[0] if ">" in raw else "", None, None)]
        return [(head[1:], p, None, lit, tail)] if raw.startswith('"') and closed else []

    want = [x for line in rows for x in cut(line)]
    lines = spark.createDataFrame([(x,) for x in rows], "value string")
    got = [tuple(r) for r in ntriples.parse(lines).select("s", "p", "o", "lit", "tail").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 7
    assert ntriples.parse(lines, predicates=("b",)).select("s", "o").collect() == [("a", "")]


def test_other_predicates_go_before_objects_are_read(spark):
    for name in ("graph_features", "graph_members", "graph_first_examples", "graph_sense_lemmas"):
        seen, whole = [], ntriples.dispatched

        def watch(triples, *a, **k):
            seen.append(_plan(triples)[0].splitlines())
            return whole(triples, *a, **k)

        ntriples.dispatched = watch
        try:
            registry.QUERIES[name](spark, FOLDER)
        finally:
            ntriples.dispatched = whole
        (plan,) = seen
        chosen = next(i for i, x in enumerate(plan) if "Filter" in x and (" IN (" in x or "INSET" in x or f"= {vocab.RDFS}member" in x))
        read = next(i for i, x in enumerate(plan) if " AS is_iri" in x)
        assert read < chosen, name


def test_edges_need_no_other_triples(spark, monkeypatch):
    seen, whole = [], lexicon_queries.build.dispatched_table
    monkeypatch.setattr(lexicon_queries.build, "dispatched_table", lambda triples, hosts=vocab.HOSTS, keys=None: seen.append(keys) or whole(triples, hosts, keys))
    for name in ("graph_edges", "second_generation_labels"):
        logical, _ = _plan(registry.QUERIES[name](spark, FOLDER))
        assert not {"pos", "value", "definition", *vocab.FEATURES} & set(seen[-1] or ("pos",)), name
        assert "LeftSemi" not in logical, name


def test_texts_stay_where_they_are_read(spark, monkeypatch):
    for name in ("form_analysis_in_sentence", "form_in_sentence"):
        logical, physical = _plan(registry.QUERIES[name](spark, FOLDER))
        assert "Contains" in logical or "contains" in logical.lower()
        assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical, name
    monkeypatch.setattr(qa, "BROADCAST_FORMS", 0)
    few = spark.createDataFrame([("sl", "hiša"), ("sl", "vrt"), ("de", "rot")], "lang string, surface string")
    told = spark.createDataFrame([(1, "sl", "v hiša."), (2, "sl", "hišaž vrt_"), (3, "de", "hiša rot"), (4, None, "rot"), (5, "de", None)], "id int, lang string, text string")
    joined = qa.in_sentences(told, few, ("lang",))
    assert "strategy=broadcast" not in _plan(joined)[0] and sorted((r.id, r.surface) for r in joined.collect()) == [(1, "hiša"), (3, "rot")]

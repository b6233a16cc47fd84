"""Queries of traversal, sizing and lookup on the order-part graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, vocab
from ..operators import build, lookup, sizing, traverse, typed
from ..sources import ntriples, relational
from .build_queries import EDGES, LINES
from .catalog import query
from .staging import staged

#: The production parameters of the sizing study.
SEEDS, HOPS, PROMPT = 400, 3, 24
_SEEDS = f"seeds AS (SELECT p_partkey AS seed FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT {SEEDS})"
_HOPS = f"k AS (SELECT unnest(range(1, {HOPS + 1})) AS hop)"


def _ball_sql(name: str, hops: int, edges: str = "h", gone: str | None = None) -> str:
    """CTEs <name>0..<name><hops> of new nodes by depth, and <name>(seed, node, depth)."""
    active = f" AND dst NOT IN (SELECT node FROM knd WHERE kind IN ({gone}))" if gone else ""
    out = [f"{name}0 AS (SELECT seed, seed AS node FROM seeds)"]
    for k in range(1, hops + 1):
        seen = " ".join(f"EXCEPT SELECT seed, node FROM {name}{j}" for j in range(k))
        out.append(f"{name}{k} AS (SELECT DISTINCT x.seed, e.dst AS node FROM {name}{k - 1} x JOIN {edges} e ON e.src = x.node WHERE true{active} {seen})")
    union = " UNION ALL ".join(f"SELECT seed, node, {k} AS depth FROM {name}{k}" for k in range(hops + 1))
    return ", ".join([*out, f"{name} AS ({union})"])


_BALLS = f"""
{EDGES}, {_SEEDS}, {_HOPS}, {_ball_sql('b', HOPS)}
"""
_TOKENS = """
t AS (SELECT p_partkey AS node, greatest(1, length(p_name) // 4) AS token_len FROM part
    UNION ALL SELECT o_orderkey + 10000000000, greatest(1, length(o_orderpriority) // 4) FROM orders)
"""
_SIZES = f"z AS (SELECT seed, hop, count(*) AS nodes, sum(token_len)::BIGINT + {PROMPT} AS tokens FROM b JOIN t USING (node) JOIN k ON depth <= hop GROUP BY seed, hop)"


def _induced_sql(name: str, ball: str) -> str:
    """CTE of edges inside the balls: each half-edge counts from the hop on that reaches both its ends."""
    return f"""{name} AS (
    SELECT seed, hop, count(*) // 2 AS edges FROM (SELECT x.seed, greatest(x.depth, y.depth) AS reach FROM {ball} x JOIN h ON h.src = x.node
        JOIN {ball} y ON y.seed = x.seed AND y.node = h.dst) JOIN k ON reach <= hop GROUP BY seed, hop)"""


def seeds(t) -> DataFrame:
    return sizing.sample(t.part.select(F.col("p_partkey").alias("seed")), "seed", SEEDS)


def half(t) -> DataFrame:
    """Half-edges, staged once for all hops."""
    return staged(build.half_edges(relational.constituents(t.lineitem)), "half-edges")


def reached(t, edges: DataFrame | None = None) -> DataFrame:
    return traverse.balls(seeds(t), half(t) if edges is None else edges, HOPS)


def tokens(t) -> DataFrame:
    words = t.part.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("text"), F.lit("word").alias("type"), F.col("p_size").alias("size"))
    entries = t.orders.select((F.col("o_orderkey") + relational.ORDERS).alias("node"), F.col("o_orderpriority").alias("text"), F.lit("mwe").alias("type"), F.lit(0).alias("size"))
    return words.unionByName(entries).withColumn("token_len", scalar.token_proxy(F.col("text")))


@query(f"WITH {_SEEDS} SELECT seed FROM seeds")
def seed_sample(t):
    return seeds(t)


@query(f"WITH {_BALLS} SELECT seed, node, depth FROM b")
def khop_balls(t):
    return reached(t)


@query(f"WITH {_BALLS}, {_TOKENS}, {_SIZES} SELECT seed, hop, nodes, tokens FROM z")
def ball_sizes(t):
    return traverse.ball_sizes(reached(t), tokens(t).select("node", "token_len"), HOPS, PROMPT)


@query(f"WITH {_BALLS}, {_induced_sql('i', 'b')} SELECT seed, hop, edges FROM i")
def induced_edges(t):
    edges = half(t)
    return traverse.induced_edges(reached(t, edges), edges, HOPS)


@query(f"""
WITH {_BALLS}, {_TOKENS}, {_SIZES}, {_induced_sql('i', 'b')}
SELECT seed, hop, nodes AS orig_nodes, edges AS induced_edges, nodes + edges AS levi_nodes, tokens + edges * 2 AS tokens FROM z JOIN i USING (seed, hop)
""")
def levi_size(t):
    """Every edge is a node of its own, with the two tokens of its label."""
    edges = relational.constituents(t.lineitem).withColumn("label", F.lit("sestavina"))
    return typed.levi_sizes(reached(t), edges, tokens(t).select("node", "token_len"), HOPS)


@query(f"""
WITH {_BALLS} SELECT hop, CASE WHEN node >= 10000000000 THEN 'mwe' ELSE 'other' END AS type,
    round(count(*) / (SELECT count(*) FROM seeds)::DOUBLE, 6) AS nodes_per_seed
FROM b JOIN k ON depth <= hop GROUP BY ALL
""")
def ball_composition(t):
    out = traverse.composition(reached(t), tokens(t).select("node", "type"), HOPS, shown=("mwe",))
    return out.select("hop", "type", F.round("nodes_per_seed", 6).alias("nodes_per_seed"))


def study_nodes(t) -> DataFrame:
    """Small parts stand for forms, finished orders for examples, pending ones for collocations, so every variant leaves some out."""
    words = t.part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") <= 10, vocab.FORM).otherwise(vocab.ANCHOR).alias("kind"), scalar.token_proxy(F.col("p_name")).alias("token_len"))
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", vocab.EXAMPLE).when(status == "P", vocab.COLLOCATION).otherwise(vocab.SENSE)
    entries = t.orders.select((F.col("o_orderkey") + relational.ORDERS).alias("node"), kind.alias("kind"), scalar.token_proxy(F.col("o_orderpriority")).alias("token_len"))
    return words.unionByName(entries)


def _study_sql() -> str:
    kinds = f"""knd AS (SELECT p_partkey AS node, CASE WHEN p_size <= 10 THEN {vocab.FORM} ELSE {vocab.ANCHOR} END AS kind FROM part
    UNION ALL SELECT o_orderkey + 10000000000, CASE o_orderstatus WHEN 'F' THEN {vocab.EXAMPLE} WHEN 'P' THEN {vocab.COLLOCATION} ELSE {vocab.SENSE} END FROM orders)"""
    parts, rows = [], []
    for n, (name, gone) in enumerate(sizing.variants().items()):
        parts += [_ball_sql(f"v{n}_", HOPS, gone=", ".join(map(str, gone)) or None), _induced_sql(f"i{n}", f"v{n}_")]
        rows.append(f"""SELECT '{name}' AS variant, seed, hop, count(*) AS nodes, sum(token_len)::BIGINT + {PROMPT} AS tokens, coalesce(any_value(edges), 0) AS edges
            FROM v{n}_ JOIN t USING (node) JOIN k ON depth <= hop LEFT JOIN i{n} USING (seed, hop) GROUP BY seed, hop""")
    return f"{EDGES}, {_SEEDS}, {_HOPS}, {_TOKENS}, {kinds}, {', '.join(parts)}, r AS ({' UNION ALL '.join(rows)})"


_FIGURES = ", ".join(
    ["count(*) AS n", "round(avg(value), 6) AS mean", "min(value)::BIGINT AS min", "max(value)::BIGINT AS max"]
    + [f"round(quantile_cont(value::DOUBLE, {p / 100}), 6) AS p{p}" for p in sizing.PERCENTS]
)


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(c, 6).alias(c) if c == "mean" or c[1:].isdigit() else F.col(c) for c in rows.columns])


@query(f"""
WITH {_study_sql()}, kinds AS (
    SELECT variant, hop, unnest(['all', CASE WHEN seed % 5 = 0 THEN 'mwe' ELSE 'word' END]) AS seed_kind, nodes, edges, tokens FROM r),
x AS (SELECT variant, hop, seed_kind, unnest(['nodes', 'edges', 'tokens']) AS metric, unnest([nodes, edges, tokens]) AS value FROM kinds)
SELECT variant, hop, seed_kind, metric, {_FIGURES} FROM x GROUP BY variant, hop, seed_kind, metric
""")
def sizing_study(t):
    """The whole report: 400 seeds, three hops, eight variants; nodes, edges and tokens by seed kind."""
    kinds = seeds(t).withColumn("is_mwe", F.col("seed") % 5 == 0)
    return _rounded(sizing.study(study_nodes(t), half(t), kinds, HOPS, PROMPT))


@query(f"WITH {_study_sql()}, x AS (SELECT variant, hop, nodes AS value FROM r) SELECT variant, hop, {_FIGURES} FROM x GROUP BY variant, hop")
def variant_summary(t):
    """Ball sizes in the eight variants (a seed is never left out)."""
    kinds = seeds(t).withColumn("is_mwe", F.lit(False))
    out = sizing.study(study_nodes(t), half(t), kinds, HOPS, PROMPT).filter("metric = 'nodes' and seed_kind = 'all'")
    return _rounded(out.drop("metric", "seed_kind"))


@query(f"""
WITH {_BALLS}, {_TOKENS}, {_SIZES},
g AS (SELECT hop, tokens, unnest(['all', CASE WHEN seed % 5 = 0 THEN 'mwe' ELSE 'word' END]) AS seed_kind FROM z)
SELECT hop, seed_kind, count(*) AS n, round(avg(tokens), 6) AS mean, round(quantile_cont(tokens::DOUBLE, 0.9), 6) AS p90 FROM g GROUP BY ALL
""")
def sizing_report(t):
    """Token sizes for all seeds and by seed kind: one pass, seeds counted in both groups."""
    sized = traverse.ball_sizes(reached(t), tokens(t).select("node", "token_len"), HOPS, PROMPT)
    kinds = F.explode(F.array(F.lit("all"), F.when(F.col("seed") % 5 == 0, "mwe").otherwise("word"))).alias("seed_kind")
    out = sizing.summary(sized.select("hop", "tokens", kinds), "tokens", ["hop", "seed_kind"])
    return out.select("hop", "seed_kind", "n", F.round("mean", 6).alias("mean"), F.round("p90", 6).alias("p90"))


_TYPED = """
e AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, pred FROM (
    SELECT l_partkey AS a, l_suppkey AS b, 3 AS pred FROM lineitem UNION ALL SELECT l_partkey, l_linenumber, 4 FROM lineitem
    UNION ALL SELECT l_partkey, l_orderkey, 7 FROM lineitem) WHERE a <> b)
"""


def _typed(t):
    return (
        t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.lit(3).alias("pred"))
        .unionAll(t.lineitem.select("l_partkey", F.col("l_linenumber").cast("long"), F.lit(4)))
        .unionAll(t.lineitem.select("l_partkey", "l_orderkey", F.lit(7)))
    )


@query(f"WITH {_TYPED} SELECT lo, hi, min(pred) AS pred FROM e GROUP BY lo, hi")
def typed_dedup(t):
    """First-generation graph: one predicate per undirected pair, the least."""
    return typed.least_predicates(_typed(t))


@query(f"WITH {_TYPED}, d AS (SELECT lo, hi, min(pred) AS pred FROM e WHERE pred <> 7 GROUP BY lo, hi) SELECT pred, count(*) AS edges FROM d GROUP BY pred")
def semantic_core(t):
    """The typed graph without its decomposition predicates."""
    return typed.least_predicates(_typed(t).filter("pred <> 7")).groupBy("pred").agg(F.count("*").alias("edges"))


@query(f"""
WITH {_TYPED}, d AS (SELECT lo, hi, min(pred) AS pred FROM e GROUP BY lo, hi)
SELECT lo AS "group", sum(length(CASE pred WHEN 3 THEN 'sense' WHEN 4 THEN 'synonym' ELSE 'constituent' END) // 4)::BIGINT AS label_tokens FROM d GROUP BY 1
""")
def relation_label_tokens(t):
    """Tokens of the labels of undirected edges, by their lesser end."""
    one = typed.least_predicates(_typed(t))
    return typed.label_tokens(one.withColumn("label", typed.predicate_label(F.col("pred"))), F.col("lo"))


def lexicon(t) -> lookup.Lexicon:
    """Parts as anchors, suppliers as forms, order priorities as senses, with edges from anchors to forms."""
    words = t.part.select((F.lit(1 << vocab.TYPE_SHIFT).bitwiseOR(F.col("p_partkey"))).alias("code"), F.lit(vocab.ANCHOR).alias("kind"), F.concat(F.lit("iztočnica: "), "p_name", F.lit(" ("), "p_type", F.lit(")")).alias("text"))
    forms = t.supplier.select((F.lit(3 << vocab.TYPE_SHIFT).bitwiseOR(F.col("s_suppkey"))).alias("code"), F.lit(vocab.FORM).alias("kind"), F.concat(F.lit("oblika: "), F.when(F.col("s_suppkey") % 9 == 0, "red").otherwise(F.col("s_name"))).alias("text"))
    senses = t.part.filter("p_size > 40").select((F.lit(5 << vocab.TYPE_SHIFT).bitwiseOR(F.col("p_partkey"))).alias("code"), F.lit(vocab.SENSE).alias("kind"), F.concat(F.lit("pomen: "), "p_name").alias("text"))
    nodes = words.unionByName(forms).unionByName(senses).withColumn("key", F.concat(F.lit("c:"), F.col("code").cast("string"))).withColumn("type_id", scalar.type_of(F.col("code")))
    edges = t.lineitem.select(
        F.concat(F.lit("c:"), F.lit(1 << vocab.TYPE_SHIFT).bitwiseOR(F.col("l_partkey")).cast("string")).alias("src"),
        F.concat(F.lit("c:"), F.lit(3 << vocab.TYPE_SHIFT).bitwiseOR(F.col("l_suppkey")).cast("string")).alias("dst"),
    ).distinct()
    return lookup.Lexicon(build.Graph(nodes, edges))


_NODES = """
n AS (SELECT 0 AS kind, 'lexical-unit-' || p_partkey AS label, p_name AS name, 'iztočnica: ' || p_name || ' (' || p_type || ')' AS text,
        (1::BIGINT << 56) | p_partkey AS code FROM part
    UNION ALL SELECT 1, 'word-form-' || s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'red' ELSE s_name END,
        'oblika: ' || CASE WHEN s_suppkey % 9 = 0 THEN 'red' ELSE s_name END, (3::BIGINT << 56) | s_suppkey FROM supplier
    UNION ALL SELECT 2, 'sense-' || p_partkey, NULL, 'pomen: ' || p_name, (5::BIGINT << 56) | p_partkey FROM part WHERE p_size > 40),
r AS (SELECT kind, CASE WHEN lower(name) = 'red' THEN 0
        WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])red($|[^\\p{L}\\p{N}_])') THEN 1 ELSE 2 END AS tier, label, 'c:' || code AS key, text
    FROM n WHERE text LIKE '%red%' OR text LIKE '%RED%' OR text LIKE '%Red%')
"""


@query(f"WITH {_NODES} SELECT kind, tier, label, key, text FROM r")
def lookup_word_ranked(t):
    return lexicon(t).word("red", also=["sense"])


@query(f"WITH {_NODES} SELECT kind, count(*) AS nodes FROM r GROUP BY kind")
def lookup_counts(t):
    return lexicon(t).counts("red")


@query("""
SELECT DISTINCT 'c:' || ((3::BIGINT << 56) | l_suppkey) AS form, 'c:' || ((1::BIGINT << 56) | l_partkey) AS headword,
    'iztočnica: ' || p_name || ' (' || p_type || ')' AS text
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 9 = 0
""")
def form_headwords(t):
    """Headwords of the forms that match best."""
    found = lexicon(t)
    return found.headwords(found.best_forms(found.word("red")))


@query(f"WITH {_NODES} SELECT kind, count(*) AS nodes FROM r WHERE kind NOT IN (0, 1) GROUP BY kind")
def lookup_unsearched(t):
    """Totals of the kinds that a plain lookup does not rank."""
    return lexicon(t).unsearched("red")


@query(f"WITH {_NODES} SELECT count_if(kind = 1 AND tier = 0) > 0 AND count_if(kind = 0 AND tier = 0) = 0 AS inflected_only FROM r WHERE kind IN (0, 1)")
def lookup_inflected_note(t):
    """Whether the word is an inflected form and no headword."""
    found = lexicon(t)
    return found.inflected_only(found.word("red"))


@query(f"""
WITH {EDGES},
s1 AS (SELECT DISTINCT dst AS node FROM h WHERE src = 7),
s2 AS (SELECT DISTINCT h.dst AS node FROM s1 JOIN h ON h.src = s1.node WHERE h.dst <> 7 EXCEPT SELECT node FROM s1)
SELECT 0 AS depth, 1 AS nodes, 7 AS first UNION ALL SELECT 1, count(*), min(node) FROM s1 UNION ALL SELECT 2, count(*), min(node) FROM s2
""")
def lookup_id_hops(t):
    one = t.part.filter("p_partkey = 7").select(F.col("p_partkey").alias("seed"))
    return traverse.balls(one, half(t), 2).groupBy("depth").agg(F.count("*").alias("nodes"), F.min("node").alias("first"))


@query("""
SELECT CASE WHEN l_partkey = 7 THEN 'out' ELSE 'in' END AS direction, l_partkey AS s, l_suppkey AS o, count(*) AS n
FROM lineitem WHERE l_partkey = 7 OR l_suppkey = 7 GROUP BY ALL
""")
def raw_in_out(t):
    triples = t.lineitem.select(F.col("l_partkey").cast("string").alias("s"), F.col("l_suppkey").cast("string").alias("o"))
    hit = lookup.Lexicon(None).raw(triples, "7")
    return hit.groupBy("direction", F.col("s").cast("long").alias("s"), F.col("o").cast("long").alias("o")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name AS lit FROM part WHERE p_name = 'red widget'")
def raw_word(t):
    triples = t.part.select("p_partkey", F.col("p_name").alias("lit"), F.lit("sl").alias("lang"))
    return lookup.Lexicon(None).raw_word(triples, "red widget", "sl").select("p_partkey", "lit")


@query(f"""
WITH {_BALLS}, {_TOKENS}, {_SIZES}, {_induced_sql('i', 'b')}
SELECT z.seed, p_name AS headword, z.hop, nodes, edges, tokens FROM z JOIN i USING (seed, hop) JOIN part ON p_partkey = z.seed
""")
def neighbourhood_lookup(t):
    """Headwords and their one- to three-hop neighbourhoods: nodes, induced edges and tokens."""
    edges = half(t)
    found = reached(t, edges)
    sized = traverse.ball_sizes(found, tokens(t).select("node", "token_len"), HOPS, PROMPT)
    words = t.part.select(F.col("p_partkey").alias("seed"), F.col("p_name").alias("headword"))
    both = sized.join(traverse.induced_edges(found, edges, HOPS), ["seed", "hop"]).join(words, "seed")
    return both.select("seed", "headword", "hop", "nodes", "edges", "tokens")


@query("""
WITH r AS (SELECT p_type AS kind, p_partkey, left(p_name, 160) AS sample, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS place,
    count(*) OVER (PARTITION BY p_type) AS nodes FROM part)
SELECT kind, place::INTEGER AS place, p_partkey, sample, nodes FROM r WHERE place <= 5
""")
def sample_dump(t):
    """First five texts of every kind, with the kind's exact size."""
    first = traverse.capped(t.part.select(F.col("p_type").alias("kind"), "p_partkey", F.substring("p_name", 1, 160).alias("sample")), "kind", [F.col("p_partkey")], 5)
    sizes = t.part.groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("nodes"))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("kind").orderBy("p_partkey"))  # five rows a kind
    return first.withColumn("place", place).join(sizes, "kind").select("kind", "place", "p_partkey", "sample", "nodes")


@query(f"""
WITH {EDGES}, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT DISTINCT src AS node FROM h)),
d AS (SELECT n.id, count(*) AS degree, min(o.id) AS first FROM h JOIN n ON n.node = h.src JOIN n o ON o.node = h.dst GROUP BY n.id)
SELECT id, (sum(degree) OVER (ORDER BY id) - degree)::BIGINT AS start, degree::INTEGER AS degree, first FROM d
""")
def csr_export(t):
    """Dense ids in key order, and where each node's neighbours begin."""
    from ..operators import export

    edges = half(t)
    ids = export.dense_ids(edges.select(F.col("src").alias("node")).distinct(), "node")
    rows = export.compressed_rows(ids, edges)
    return rows.select("id", "start", "degree", F.get("neighbours", F.lit(0)).alias("first"))


@query("""
WITH n AS (SELECT p_partkey AS node, p_partkey * 10 AS start, p_size % 10 AS length FROM part), q AS (SELECT o_orderkey, (o_orderkey * 7) % 25000 AS place FROM orders)
SELECT o_orderkey, place, node FROM q JOIN n ON place >= start AND place < start + length
""")
def offset_lookup(t):
    """Offsets into concatenated texts -> the node whose text lies there; gaps belong to no node."""
    from ..operators import ranges

    nodes = t.part.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_size") % 10).alias("length"))
    points = t.orders.select("o_orderkey", ((F.col("o_orderkey") * 7) % 25000).alias("place"))
    return ranges.interval_lookup(points, nodes, "place", "start", "length", 64).select("o_orderkey", "place", "node")


@query(f"""
WITH x AS ({LINES}) SELECT CASE WHEN s LIKE '%/lexical-unit-7' THEN 'out' ELSE 'in' END AS direction, p, count(*) AS n FROM x
WHERE s LIKE '%/lexical-unit-7' OR o LIKE '%/lexical-unit-7' GROUP BY ALL
""")
def raw_id(t):
    """Triples that touch an entry, by direction and predicate."""
    triples = ntriples.parse(relational.rendered(t.part, t.orders, t.lineitem, t.documents))
    return lookup.Lexicon(None).raw_id(triples, 7).groupBy("direction", "p").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT p_brand AS kind, count(*) AS nodes FROM part GROUP BY 1)
SELECT kind, nodes, (rank() OVER (ORDER BY nodes DESC, kind))::INTEGER AS place FROM x
""")
def footer_order(t):
    """Totals by kind in the order a footer lists them: most first, then by name."""
    from pyspark.sql.window import Window

    counted = t.part.groupBy(F.col("p_brand").alias("kind")).agg(F.count("*").alias("nodes"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("nodes"), "kind")))  # one row a kind

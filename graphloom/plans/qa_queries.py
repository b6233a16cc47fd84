"""Queries of question-answer derivation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import qa, store, traverse
from ..sources import relational
from .build_queries import EDGES
from .catalog import query
from .graph_queries import half, seeds
from .staging import staged



def _forms(t):
    return t.part.select(F.col("p_name").alias("surface"), F.col("p_partkey").alias("unit"), F.col("p_type").alias("lemma"))


_INDEX = "i AS (SELECT lower(p_name) AS surface, list_sort(list_distinct(list(p_type))) AS lemmas, count(DISTINCT p_partkey) AS n_units FROM part GROUP BY 1)"


@query(f"WITH {_INDEX} SELECT surface, array_to_string(lemmas, ', ') AS lemmas, n_units FROM i")
def reverse_index(t):
    """T4 as well: the lemmas a surface may stand for."""
    return qa.reverse_index(_forms(t)).withColumn("lemmas", F.array_join("lemmas", ", "))


@query(f"""
WITH {_INDEX}, c AS (SELECT n_units, count(*) AS surfaces FROM i GROUP BY 1)
SELECT n_units, surfaces, round(sum(surfaces) OVER (ORDER BY n_units) / sum(surfaces) OVER (), 6) AS share_up_to FROM c
""")
def surface_ambiguity(t):
    out = qa.ambiguity(qa.reverse_index(_forms(t)))
    return out.withColumn("share_up_to", F.round("share_up_to", 6))


_BANDS = f"""
{EDGES}, f AS (SELECT word, count(*) AS proxy FROM (SELECT l_partkey AS word FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem UNION ALL SELECT dst FROM m) GROUP BY word),
bands AS (SELECT word, proxy, CASE WHEN proxy <= 0 THEN 0 WHEN proxy <= 4 THEN 1 WHEN proxy <= 16 THEN 2 WHEN proxy <= 64 THEN 3
    WHEN proxy <= 256 THEN 4 WHEN proxy <= 1024 THEN 5 ELSE 6 END AS band FROM f)
"""


def _bands(t):
    collocations = t.lineitem.select(F.explode(F.array("l_partkey", "l_suppkey")).alias("word"))
    entries = relational.constituents(t.lineitem).select(F.col("dst").alias("word"))
    return qa.frequency(collocations, entries)


@query(f"WITH {_BANDS} SELECT word, proxy, band FROM bands")
def frequency_bands(t):
    return _bands(t)


@query(f"""
WITH {_BANDS}, r AS (SELECT word, band, row_number() OVER (PARTITION BY band ORDER BY md5('42:' || word), word) AS place FROM bands)
SELECT word, band FROM r WHERE place <= [10, 20, 30, 40, 40, 40, 20][band + 1]
""")
def band_quota_sample(t):
    return qa.quota_sample(_bands(t).select("word", "band"), "word", 200)


@query("""
SELECT p_partkey, p_name AS lemma, CASE WHEN ('0x' || substr(md5('42:' || lower(p_name)), 1, 14))::BIGINT % 100 < 15 THEN 'test' ELSE 'train' END AS split FROM part
""")
def lemma_split(t):
    return qa.lemma_split(t.part.select("p_partkey", F.col("p_name").alias("lemma")), "lemma")


@query(f"""
WITH {_BANDS}, l AS (SELECT p_partkey AS lemma_word, lower(p_name) || p_partkey AS lemma, band FROM part JOIN bands ON word = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY ('0x' || substr(md5('42:' || lemma), 1, 14))::BIGINT, lemma) AS place, count(*) OVER (PARTITION BY band) AS n FROM l)
SELECT lemma_word AS word, CASE WHEN place * 100 <= n * 15 THEN 'test' ELSE 'train' END AS split FROM r
""")
def band_split(t):
    """Lemmas split so that both sides have the same share of every band."""
    words = t.part.select(F.col("p_partkey").alias("word"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("lemma"))
    return qa.lemma_split(words.join(_bands(t), "word"), "lemma", band="band").select("word", "split")


@query(f"""
WITH {_BANDS} SELECT band, count_if(p_type = 'ECONOMY') AS "ECONOMY", count_if(p_type = 'SMALL') AS "SMALL", count_if(p_type = 'PROMO') AS "PROMO"
FROM bands JOIN part ON p_partkey = word WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO') GROUP BY band
""")
def availability_matrix(t):
    types = ("ECONOMY", "SMALL", "PROMO")
    joined = _bands(t).join(t.part.filter(F.col("p_type").isin(*types)), F.col("word") == F.col("p_partkey"))
    return qa.availability(joined.select("band", F.col("p_type").alias("type")), types)


@query("""
SELECT p_partkey AS seed FROM part WHERE p_partkey < 1000000 AND (p_partkey IN (SELECT doc_id FROM labels WHERE quality = 1)
    OR p_partkey IN (SELECT l_suppkey FROM lineitem) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7))
""")
def seed_pool(t):
    """Numbered words with a definition, a synonym or an example (a last line)."""
    flags = (
        t.labels.filter("quality = 1").select(F.col("doc_id").alias("seed"))
        .union(t.lineitem.select("l_suppkey"))
        .union(t.lineitem.filter("l_linenumber = 7").select("l_partkey"))
    )
    return qa.eligible(t.part, flags, "p_partkey")


_UPWARD = f"""
{EDGES}, n AS (SELECT src, count(*) AS size FROM m GROUP BY src),
u AS (SELECT m.dst AS word, m.src AS mwe, row_number() OVER (PARTITION BY m.dst ORDER BY (o_orderstatus = 'F') DESC, n.size, m.src) AS place
    FROM m JOIN n USING (src) JOIN orders ON o_orderkey + 10000000000 = m.src)
"""


def _upward(t):
    edges = relational.constituents(t.lineitem)
    sizes = edges.groupBy("src").agg(F.count("*").alias("size"))
    content = t.orders.select((F.col("o_orderkey") + relational.ORDERS).alias("src"), (F.col("o_orderstatus") == "F").alias("has"))
    ranked = edges.join(sizes, "src").join(content, "src")
    return traverse.capped(ranked, "dst", [F.col("has").desc(), F.col("size"), F.col("src")], 15)


@query(f"WITH {_UPWARD} SELECT word, mwe FROM u WHERE place <= 15")
def upward_cap(t):
    """At most 15 entries per word: those with content first, then the shortest."""
    return _upward(t).select(F.col("dst").alias("word"), F.col("src").alias("mwe"))


@query(f"""
WITH {_UPWARD}, g AS (SELECT src, dst FROM m UNION ALL SELECT word, mwe FROM u WHERE place <= 15),
s AS (SELECT p_partkey AS seed FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 400),
b1 AS (SELECT DISTINCT seed, dst AS node FROM s JOIN g ON src = seed WHERE dst <> seed),
b2 AS (SELECT DISTINCT b1.seed, g.dst AS node FROM b1 JOIN g ON g.src = b1.node WHERE g.dst <> b1.seed EXCEPT SELECT seed, node FROM b1)
SELECT seed, depth, count(*) AS nodes FROM (SELECT seed, 1 AS depth FROM b1 UNION ALL SELECT seed, 2 FROM b2) GROUP BY ALL
""")
def capped_extraction(t):
    """Two hops: down to constituents always, up to at most 15 entries; hubs are cut before they are joined."""
    down = relational.constituents(t.lineitem)
    up = _upward(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = traverse.balls(seeds(t), staged(down.unionByName(up), "directed"), 2)
    return reached.filter("depth > 0").groupBy("seed", "depth").agg(F.count("*").alias("nodes"))


@query(f"""
WITH {EDGES}, s AS (SELECT p_partkey AS seed, p_size AS item FROM part),
b AS (SELECT item, seed AS node, 0 AS depth FROM s UNION ALL SELECT item, dst, 1 FROM s JOIN h ON src = seed)
SELECT item, node, min(depth) AS depth FROM b GROUP BY item, node
""")
def union_balls(t):
    """Balls of all parts, joined into one for every size."""
    chosen = t.part.select(F.col("p_partkey").alias("seed"), F.col("p_size").alias("item"))
    return traverse.union_balls(chosen, traverse.balls(chosen.select("seed"), half(t), 1))


_WEIGHTED = """
x AS (SELECT DISTINCT l_partkey AS anchor, l_suppkey AS node, l_suppkey % 40 AS proxy FROM lineitem),
y AS (SELECT anchor, node, row_number() OVER (PARTITION BY anchor ORDER BY
    round(-ln(((('0x' || substr(md5(anchor || ':' || node), 1, 14))::BIGINT % 1000003) + 1) / 1000004.0::DOUBLE) / greatest(ln(1 + proxy), 1e-9), 9), node) AS place FROM x)
"""


@query(f"WITH {_WEIGHTED} SELECT anchor, node FROM y WHERE place <= 15")
def weighted_cap(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("anchor"), F.col("l_suppkey").alias("node"), (F.col("l_suppkey") % 40).alias("proxy")).distinct()
    return qa.weighted_cap(rows, "anchor", "node", "proxy").select("anchor", "node")


@query(f"""
WITH {_WEIGHTED.replace("l_partkey AS anchor", "l_orderkey AS anchor")}
SELECT anchor, string_agg(s_name, ', ' ORDER BY s_name) AS gold, count(*) AS n
FROM y JOIN supplier ON s_suppkey = node WHERE place <= 15 GROUP BY anchor HAVING count(*) BETWEEN 5 AND 10
""")
def collocation_list(t):
    """Five to ten phrases of the capped sample, in order."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("anchor"), F.col("l_suppkey").alias("node"), (F.col("l_suppkey") % 40).alias("proxy")).distinct()
    names = t.supplier.select(F.col("s_suppkey").alias("node"), "s_name")
    few = qa.weighted_cap(rows, "anchor", "node", "proxy").join(names, "node")
    listed = few.groupBy("anchor").agg(F.array_join(F.sort_array(F.collect_list("s_name")), ", ").alias("gold"), F.count("*").alias("n"))
    return listed.filter("n between 5 and 10")


_SENSES = """
s AS (SELECT DISTINCT l_partkey AS anchor, l_suppkey AS number FROM lineitem),
c AS (SELECT anchor, number, p_name AS lemma, CASE WHEN number = anchor % 100 THEN 'placeholder' WHEN number % 3 = 0 THEN 'fallback' ELSE 'defined' END AS class,
    CASE WHEN number % 3 = 0 THEN p_name ELSE p_type || ' ' || number % 7 END AS definition FROM s JOIN part ON p_partkey = anchor)
"""


def _senses(t):
    """Senses of words: a third repeats the lemma (some with an example), others carry a definition."""
    rows = t.lineitem.select(F.col("l_partkey").alias("anchor"), F.col("l_suppkey").alias("number")).distinct()
    joined = rows.join(t.part, F.col("anchor") == F.col("p_partkey"))
    n = F.col("number")
    definition = F.concat_ws(" ", "p_type", (n % 7).cast("string"))
    fallback = F.concat(F.lit("pomen: "), "p_name", F.when(n % 2 == 0, F.lit(" (zgled: x y ...)")).otherwise(""))
    text = F.when(n % 3 == 0, fallback).otherwise(F.concat(F.lit("pomen "), n.cast("string"), F.lit(": "), definition))
    kind = qa.sense_class(n, F.col("anchor") % 100, text, F.col("p_name"))
    return joined.select("anchor", "number", kind.alias("class"), definition.alias("definition"))


@query(f"WITH {_SENSES} SELECT anchor, number, class FROM c")
def sense_class(t):
    return _senses(t).select("anchor", "number", "class")


_DEFINED = """
d AS (SELECT anchor, definition, min(number) AS ordinal FROM c WHERE class = 'defined' GROUP BY ALL),
g AS (SELECT anchor, string_agg(definition, ' | ' ORDER BY ordinal, definition) AS gold, count(*) AS n FROM d GROUP BY anchor)
"""


def _defined(t):
    return qa.definitions(_senses(t).filter("class = 'defined'").select("anchor", F.col("number").alias("ordinal"), "definition"))


@query(f"WITH {_SENSES}, {_DEFINED} SELECT anchor, 'ODGOVOR: ' || gold AS answer FROM g")
def definition_list(t):
    """T12."""
    return _defined(t).select("anchor", qa.answer_line(F.col("gold"), " | ").alias("answer"))


@query(f"""
WITH {_SENSES}, {_DEFINED} SELECT anchor, n::INTEGER AS n, CASE n % 100 WHEN 1 THEN 'v bazi je zabeležen ' || n || ' pomen'
    WHEN 2 THEN 'v bazi sta zabeležena ' || n || ' pomena' WHEN 3 THEN 'v bazi so zabeleženi ' || n || ' pomeni'
    WHEN 4 THEN 'v bazi so zabeleženi ' || n || ' pomeni' ELSE 'v bazi je zabeleženih ' || n || ' pomenov' END AS ui FROM g
""")
def sense_count(t):
    """The length of T12's list."""
    return _defined(t).select("anchor", "n", scalar.counted_senses(F.col("n")).alias("ui"))


_PAIRS = """
p AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey ),
q AS (SELECT DISTINCT a AS anchor, y.p_name AS name FROM p JOIN part y ON y.p_partkey = b UNION SELECT b, x.p_name FROM p JOIN part x ON x.p_partkey = a)
"""


#: Lines whose pairs one task joins or sorts.
LINES_A_TASK = 1_000_000


def _partners(t, cap):
    """Both ends of every line, dealt out by partner and then by anchor to as many tasks as the lines ask for."""
    tasks = max(1, -(-t.lineitem.count() // LINES_A_TASK), int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    ends = F.array(*[F.struct(F.col(a).alias("anchor"), F.col(b).alias("k")) for a, b in (("l_partkey", "l_suppkey"), ("l_suppkey", "l_partkey"))])
    both = t.lineitem.filter("l_partkey <> l_suppkey").select(F.explode(ends).alias("e")).select("e.anchor", "e.k")
    names = t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    named = both.repartition(tasks, "k").join(names, "k").select("anchor", "name").distinct()
    return qa.listed_partners(named.repartition(tasks, "anchor"), cap)


@query(f"""
WITH {_PAIRS}, r AS (SELECT anchor, name, row_number() OVER (PARTITION BY anchor ORDER BY name) AS place FROM q)
SELECT anchor, string_agg(name, ', ' ORDER BY place) AS gold FROM r WHERE place <= 10 GROUP BY anchor
""")
def synonym_list(t):
    """T15 (and T16 on antonyms): both directions, at most ten in alphabetical order; names here are plain letters."""
    return _partners(t, 10).select("anchor", F.array_join("gold", ", ").alias("gold"))


@query(f"""
WITH {_PAIRS}, r AS (SELECT anchor, name, row_number() OVER (PARTITION BY anchor ORDER BY name) AS place, count(*) OVER (PARTITION BY anchor) AS n,
    (('0x' || substr(md5('42:asked:' || anchor), 1, 14))::BIGINT % 9 + 2)::INTEGER AS asked, ('0x' || substr(md5('42:short:' || anchor), 1, 14))::BIGINT % 100 < 10 AS drawn FROM q)
SELECT anchor, asked, string_agg(name, ', ' ORDER BY place) AS gold, any_value(n) < asked AS short FROM r WHERE place <= asked AND (n >= asked OR drawn) GROUP BY anchor, asked
""")
def counted_list(t):
    """Exactly N of anchors that have as many, and some honest short lists."""
    return qa.counted(_partners(t, 10)).withColumn("gold", F.array_join("gold", ", "))


@query("""
WITH p AS (SELECT DISTINCT least(s_suppkey, s_nationkey) AS a, greatest(s_suppkey, s_nationkey) AS b FROM supplier WHERE s_suppkey <> s_nationkey),
q AS (SELECT DISTINCT a AS anchor, y.n_name AS name FROM p JOIN nation y ON y.n_nationkey = b UNION SELECT b, x.n_name FROM p JOIN nation x ON x.n_nationkey = a),
r AS (SELECT anchor, name, row_number() OVER (PARTITION BY anchor ORDER BY name) AS place FROM q)
SELECT anchor, string_agg(name, ', ' ORDER BY place) AS gold, 'C' AS tier, 'test' AS split FROM r WHERE place <= 10 GROUP BY anchor
""")
def antonym_list(t):
    """Partners of antonym pairs, at most ten; always in the test split, a relation that training never sees."""
    pairs = t.supplier.filter("s_suppkey <> s_nationkey").select(F.least("s_suppkey", "s_nationkey").alias("a"), F.greatest("s_suppkey", "s_nationkey").alias("b")).distinct()
    names = t.nation.select(F.col("n_nationkey").alias("k"), "n_name")
    named = pairs.join(names.select(F.col("k").alias("a"), F.col("n_name").alias("name_a")), "a", "left").join(names.select(F.col("k").alias("b"), F.col("n_name").alias("name_b")), "b", "left")
    listed = qa.partners(named, 10)
    items = listed.withColumns({"type": F.lit("T16"), "frame": F.lit(0), "split": F.lit("train")})
    return qa.held_out(items, 20).select("anchor", F.array_join("gold", ", ").alias("gold"), "tier", "split")


@query("""
WITH i AS (SELECT p_partkey AS id, 'T' || (p_size % 3 + 14) AS type, ('0x' || substr(md5('42:' || p_partkey), 1, 14))::BIGINT % 20 AS frame,
    CASE WHEN ('0x' || substr(md5('42:' || lower(p_name)), 1, 14))::BIGINT % 100 < 15 THEN 'test' ELSE 'train' END AS split FROM part)
SELECT id, CASE WHEN type = 'T16' THEN 'C' WHEN type = 'T15' THEN 'B' WHEN frame >= 18 THEN 'A' END AS tier,
    CASE WHEN type <> 'T14' OR frame >= 18 THEN 'test' ELSE split END AS split FROM i
""")
def held_out_tiers(t):
    """Phrasings, question types and a relation that only test items have."""
    frame = scalar.hash56(F.concat(F.lit("42:"), F.col("p_partkey").cast("string"))) % 20
    typed = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("lemma"), F.concat(F.lit("T"), (F.col("p_size") % 3 + 14).cast("string")).alias("type"), frame.alias("frame"))
    return qa.held_out(qa.lemma_split(typed, "lemma"), 20, 2, ("T15",)).select("id", "tier", "split")


@query("""
SELECT l_orderkey AS anchor, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS gold FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY' GROUP BY l_orderkey
""")
def collocations_by_category(t):
    """Partners of one part of speech only."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    phrases = rows.select(F.col("l_orderkey").alias("anchor"), F.col("p_name").alias("name"), F.col("p_type").alias("pos"))
    return qa.by_category(phrases, "ECONOMY").withColumn("gold", F.array_join("gold", ", "))


@query("""
SELECT l_partkey AS anchor, l_linenumber AS sense, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS gold FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
""")
def synonyms_by_sense(t):
    """Partners of each sense by itself."""
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return qa.by_sense(rows.select(F.col("l_partkey").alias("anchor"), F.col("l_linenumber").alias("sense"), F.col("s_name").alias("name"))).withColumn("gold", F.array_join("gold", ", "))


#: The cells of a part: all of them, all but one, two thirds or half, by its size; a tenth of the parts has a doublet.
_PRESENT = "(p_size % 4 = 3 OR (p_size % 4 = 2 AND i <> p_partkey % 18) OR (p_size % 4 = 0 AND (p_partkey + i) % 3 <> 0) OR (p_size % 4 = 1 AND (p_partkey + i) % 2 = 0))"
_CASE_SQL = "['nominative', 'genitive', 'dative', 'accusative', 'locative', 'instrumental']"
_CELLS = f"""
f AS (
    SELECT p_partkey AS anchor, p_name || '-' || i AS surface, {_CASE_SQL}[i % 6 + 1] AS "case", ['singular', 'dual', 'plural'][i // 6 + 1] AS number
    FROM part, (SELECT unnest(range(18)) AS i) WHERE {_PRESENT} AND p_partkey % 4 <> 1
    UNION ALL SELECT p_partkey, p_name || '-x', 'nominative', 'singular' FROM part WHERE p_partkey % 10 = 0),
bad AS (SELECT anchor FROM f GROUP BY anchor, "case", number HAVING count(DISTINCT surface) > 1),
u AS (SELECT * FROM f WHERE anchor NOT IN (SELECT anchor FROM bad))
"""


#: Parts whose cells one task makes and sorts.
PARTS_A_TASK = 50_000


def _slots(t, n: int):
    """Parts by `i` below n. The parts are dealt out by key first: a small file of them becomes many cells in one task."""
    tasks = -(-t.part.count() // PARTS_A_TASK)
    return t.part.select("p_partkey", "p_name", "p_size").repartition(max(tasks, 1), "p_partkey").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _cells(t):
    """Forms of nouns, adjectives and pronouns; every fourth part is a verb. Slot 18 is the second form of a first cell."""
    i = F.col("i")
    case = F.get(F.array(*[F.lit(c) for c in qa.CASES]), i % 6)
    number = F.get(F.array(*[F.lit(n) for n in qa.NUMBERS]), F.floor(i % 18 / 6).cast("int"))
    told = F.when(i == 18, F.concat("p_name", F.lit("-x"))).otherwise(F.concat_ws("-", "p_name", i.cast("string")))
    rows = _slots(t, 19).filter(f"(i = 18 AND p_partkey % 10 = 0) OR (i < 18 AND {_PRESENT} AND p_partkey % 4 <> 1)")
    return rows.select(F.col("p_partkey").alias("anchor"), told.alias("surface"), case.alias("case"), number.alias("number"))


def _table_sql(inner):
    cell = "coalesce(max(CASE WHEN \"case\" = '{c}' AND number = '{n}' THEN surface END), '/')"
    groups = [" || ', ' || ".join(cell.format(c=c, n=n) for c in inner) for n in qa.NUMBERS]
    return " || '; ' || ".join(groups)


@query(f"""
WITH {_CELLS} SELECT anchor, count(DISTINCT ("case", number))::INTEGER AS filled, {_table_sql(qa.CASES)} AS "table" FROM u GROUP BY anchor HAVING count(*) >= 12
""")
def paradigm_table(t):
    """Six cases by three numbers, twelve cells at least; anchors with doublets are left out."""
    return qa.paradigm(_cells(t), ("number", qa.NUMBERS), ("case", qa.CASES), 12)


@query(f"""
WITH {_CELLS} SELECT anchor, "case", number, surface FROM u JOIN part ON p_partkey = anchor
WHERE ('0x' || substr(md5('slot:' || p_partkey), 1, 14))::BIGINT % 18 = list_position({_CASE_SQL}, "case") - 1 + 6 * (list_position(['singular', 'dual', 'plural'], number) - 1)
""")
def single_cell(t):
    """Of every paradigm without doublets the one cell that its draw asks for, if it has it."""
    place = F.array_position(F.array(*[F.lit(c) for c in qa.CASES]), F.col("case")) - 1 + 6 * (F.array_position(F.array(*[F.lit(n) for n in qa.NUMBERS]), F.col("number")) - 1)
    asked = scalar.hash56(F.concat(F.lit("slot:"), F.col("anchor").cast("string"))) % 18
    return qa.unique_cells(_cells(t), ("case", "number")).filter(place == asked).select("anchor", "case", "number", "surface")


@query("""
WITH b AS (SELECT l_suppkey AS anchor, p_size % 3 AS degree, min((p_partkey % 2, p_name)) AS best FROM lineitem JOIN part ON p_partkey = l_partkey
    GROUP BY ALL)
SELECT anchor, array_to_string([coalesce(max(CASE WHEN degree = k THEN best[2] END), '/') FOR k IN [0]], '') || ', ' ||
    coalesce(max(CASE WHEN degree = 1 THEN best[2] END), '/') || ', ' || coalesce(max(CASE WHEN degree = 2 THEN best[2] END), '/') AS gold FROM b GROUP BY anchor
""".replace("array_to_string([coalesce(max(CASE WHEN degree = k THEN best[2] END), '/') FOR k IN [0]], '')", "coalesce(max(CASE WHEN degree = 0 THEN best[2] END), '/')"))
def gradation(t):
    """T11 (T7 likewise): one form per degree by preference, gaps as '/'."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    degree = F.get(F.array(*[F.lit(d) for d in qa.DEGREES]), (F.col("p_size") % 3).cast("int"))
    forms = rows.select(F.col("l_suppkey").alias("anchor"), F.col("p_name").alias("surface"), degree.alias("degree"), (F.col("p_partkey") % 2).alias("rank"))
    return qa.picked(forms, "degree", qa.DEGREES, F.col("rank")).select("anchor", F.array_join("gold", ", ").alias("gold"))


@query("""
WITH r AS (SELECT DISTINCT p_name || '-' || p_size AS surface, p_partkey % 6 AS c, p_size % 3 AS n FROM part)
SELECT surface, string_agg(['nominative', 'genitive', 'dative', 'accusative', 'locative', 'instrumental'][c + 1] || ' ' || ['singular', 'dual', 'plural'][n + 1],
    ' ali ' ORDER BY n, c) AS gold, count(*)::INTEGER AS n FROM r GROUP BY surface
    HAVING count(*) >= 2 OR ('0x' || substr(md5('42:lone:' || surface), 1, 14))::BIGINT % 100 < 25
""")
def ambiguous_readings(t):
    """All readings of a surface with at least two, and of a quarter of those with one."""
    case = F.get(F.array(*[F.lit(c) for c in qa.CASES]), (F.col("p_partkey") % 6).cast("int"))
    number = F.get(F.array(*[F.lit(n) for n in qa.NUMBERS]), (F.col("p_size") % 3).cast("int"))
    rows = t.part.select(F.concat_ws("-", "p_name", F.col("p_size").cast("string")).alias("surface"), case.alias("case"), number.alias("number"))
    return qa.readings(rows, 25).withColumn("gold", F.array_join("gold", " ali "))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'samostalnik, moški spol' WHEN 'SMALL' THEN 'glagol, dovršni' ELSE 'pridevnik' END AS gold FROM part")
def basic_properties(t):
    """Category, with gender for nouns and aspect for verbs."""
    kind = F.col("p_type")
    pos = F.when(kind == "ECONOMY", "noun").when(kind == "SMALL", "verb").otherwise("adjective")
    from ..functions import vocab

    extra = F.when(pos == "noun", scalar.feature_label("gender", F.lit("masculine"))).when(pos == "verb", scalar.feature_label("aspect", F.lit("perfective")))
    return t.part.select("p_partkey", F.concat_ws(", ", scalar.mapped(pos, vocab.POS_LABELS), extra).alias("gold"))


@query("""
WITH w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT source, min(doc_id) AS node, arg_min(text, doc_id) AS gold FROM w WHERE n <= 60 GROUP BY source
""")
def first_example_verbatim(t):
    """The example of least id with at most 60 words, as it is."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    short = t.documents.filter(n <= 60)
    return short.groupBy("source").agg(F.min("doc_id").alias("node"), F.min_by("text", "doc_id").alias("gold"))


_FORMS = r"""
f AS (
    SELECT source, lang, arg_min(regexp_extract(lower(text), '[a-zà-ÿ]+'), doc_id) AS surface FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL
    GROUP BY source, lang)
"""
_STANDS = r"regexp_matches(text, '(^|[^\p{L}\p{N}_])' || surface || '($|[^\p{L}\p{N}_])')"


def _forms_of_sources(t):
    """The first word of the first document of every source and language, in small letters."""
    told = t.documents.filter("lang is not null and source is not null and text is not null")
    word = F.regexp_extract(F.lower("text"), "[a-zà-ÿ]+", 0)
    return told.groupBy("source", "lang").agg(F.min_by(word, "doc_id").alias("surface"))


@query(f"WITH {_FORMS} SELECT doc_id, surface FROM documents JOIN f USING (source, lang) WHERE surface <> '' AND {_STANDS}")
def form_in_sentence(t):
    """T20's join: forms that stand as words in the sentences of their source and language."""
    forms = _forms_of_sources(t).filter("surface <> ''")
    return qa.in_sentences(t.documents, forms, ("source", "lang")).select("doc_id", "surface")


@query("""
WITH i AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'brez' WHEN p_partkey % 2 = 0 THEN p_name || ', ' || p_type ELSE p_type || ', ' || p_name || '.' END AS pred, p_name || ', ' || p_type AS gold FROM part)
SELECT id, id % 9 <> 0 AS exact, CASE WHEN id % 9 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS f1 FROM i
""")
def grade_unordered(t):
    """Exact match after normalisation, order ignored; predictions without an answer line score nothing."""
    pred = (
        F.when(F.col("p_partkey") % 9 == 0, F.lit("brez"))
        .when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ODGOVOR: "), "p_name", F.lit(",  "), F.upper("p_type")))
        .otherwise(F.concat(F.lit("uvod\nODGOVOR: "), "p_type", F.lit(", "), "p_name", F.lit(".")))
    )
    items = t.part.select(F.col("p_partkey").alias("id"), pred.alias("pred"), F.concat(F.lit("ODGOVOR: "), "p_name", F.lit(", "), "p_type").alias("gold"))
    return qa.graded(items, ", ", ordered=False).select("id", "exact", "f1")


@query("""
SELECT p_partkey AS id, p_partkey % 3 = 0 AS exact,
    round(CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2 * 1 / 3.0 ELSE 1.0 END, 6)::DOUBLE AS f1 FROM part
""")
def grade_ordered(t):
    """Order graded: a swapped list has f1 1 and is not exact, a short one has two thirds."""
    name, kind = F.col("p_name"), F.col("p_type")
    pred = F.when(F.col("p_partkey") % 3 == 0, F.concat(name, F.lit(" | "), kind)).when(F.col("p_partkey") % 3 == 1, name).otherwise(F.concat(kind, F.lit(" | "), name))
    items = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("ODGOVOR: "), pred).alias("pred"), F.concat(F.lit("ODGOVOR: "), name, F.lit(" | "), kind).alias("gold"))
    return qa.graded(items, "|", ordered=True).select("id", "exact", F.round("f1", 6).alias("f1"))


@query("""
WITH n AS (SELECT p_brand AS type, p_type AS answer, count(*) AS n FROM part GROUP BY ALL)
SELECT type, round(max(n) / sum(n), 6) AS baseline FROM n GROUP BY type
""")
def majority_baseline(t):
    out = qa.majority_baseline(t.part.select(F.col("p_brand").alias("type"), F.col("p_type").alias("answer")))
    return out.select("type", F.round("baseline", 6).alias("baseline"))


@query("""
SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'scum') OR contains(lower(text), 'trash')
""")
def leakage_check(t):
    """Items whose text gives a held-out word away."""
    return qa.leaks(t.documents, "text", ("idiot", "scum", "trash")).select("doc_id")


@query("""
SELECT conv_id, turn AS asked, text AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL
    AND EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = conversations.conv_id AND a.turn = conversations.turn + 1 AND a.role = 'assistant')
""")
def question_answer_pairs(t):
    """User turns that the next turn answers."""
    answers = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn")).distinct()
    asked = t.conversations.filter("role = 'user' and text is not null")
    return asked.join(answers, ["conv_id", "turn"], "left_semi").select("conv_id", F.col("turn").alias("asked"), F.col("text").alias("question"))


_UNITS = r"""
q AS (SELECT p_partkey AS id, unnest(regexp_extract_all(lower('Kaj pomeni ' || p_name || '?'), '\p{L}+')) AS surface FROM part),
x AS (SELECT DISTINCT id, l_suppkey AS unit FROM q JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS surface, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey) i USING (surface)
    WHERE surface NOT IN ('kaj', 'pomeni'))
"""


@query(f"WITH {_UNITS} SELECT id, unit FROM x")
def question_units(t):
    """Fallback extraction: words of a question, without stopwords, looked up in the index."""
    return qa.extracted(*_asked(t))


def _asked(t):
    questions = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Kaj pomeni "), "p_name", F.lit("?")).alias("question"))
    used = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    index = used.select(F.substring_index("p_name", " ", 1).alias("surface"), F.col("l_suppkey").alias("unit")).distinct()
    return questions, staged(index, "index"), ("kaj", "pomeni")


@query(f"""
WITH {_UNITS}, a AS (SELECT l_partkey AS id, min(l_suppkey) AS unit FROM lineitem GROUP BY 1), n AS (SELECT id, count(DISTINCT unit) AS n FROM x GROUP BY id)
SELECT count(*) AS items, round(avg((x.unit IS NOT NULL)::INT), 6) AS recall, round(avg((coalesce(n, 0) > 1)::INT), 6) AS several
FROM a LEFT JOIN x ON x.id = a.id AND x.unit = a.unit LEFT JOIN n ON n.id = a.id
""")
def extraction_rates(t):
    """Share of questions whose unit is found, and of those that name several."""
    asked = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_suppkey").alias("unit"))
    out = qa.extraction_rates(asked, *qa.named_units(*_asked(t)))
    return out.select("items", F.round("recall", 6).alias("recall"), F.round("several", 6).alias("several"))


#: Frames of one type: known phrasings first, then new ones, the last of which training never sees.
_FRAMES = (
    "Kaj pomeni <L>?", "Razloži besedo <L>.", "Navedi pomene: <L>", "Kaj je <L>?", "Pomen besede <L>?", "Kako bi razložil <L>?", "Opiši, kaj pomeni <L>.",
    "Navedi <N> pomenov besede <L>.", "Kateri pomen ima <L> v zvezi <S>?", "Beseda <L>: pomen?", "Povej, kaj pomeni <L>.", "Kaj pomeni <L> (<S>)?", "Razloži <L> na <N> načinov.",
    "Daj razlago za <L>.", "Kaj razumeš pod <L>?", "Zapiši pomen: <L>.", "Kaj označuje <L>?", "Kako razložimo <L>?", "Definicija: <L>", "<L> pomeni kaj?",
)


@query(f"""
SELECT p_partkey AS id, replace(replace(replace({list(_FRAMES)}[(('0x' || substr(md5('42:' || p_partkey), 1, 14))::BIGINT % {len(_FRAMES)}) + 1], '<L>', p_name), '<S>', p_type), '<N>', p_size::VARCHAR) AS question FROM part
""")
def rendered_questions(t):
    """A frame drawn for every item, its slots filled."""
    return qa.rendered(t.part.select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_size"), _FRAMES, {"L": "p_name", "S": "p_type", "N": "p_size"}).select("id", "question")


@query(f"""
WITH {_FORMS}, g AS (SELECT source, lang, surface, {_CASE_SQL}[ascii(right(source, 1)) % 6 + 1] AS c FROM f WHERE surface <> ''),
a AS (SELECT lang, surface FROM g GROUP BY lang, surface HAVING count(DISTINCT c) = 1),
s AS (SELECT DISTINCT source, lang FROM documents JOIN g USING (source, lang) WHERE {_STANDS}),
x AS (SELECT g.*, s.source IS NOT NULL AS shown, a.surface IS NOT NULL AS clear FROM g LEFT JOIN s ON s.source = g.source AND s.lang = g.lang LEFT JOIN a ON a.lang = g.lang AND a.surface = g.surface)
SELECT count(*) AS forms, count_if(shown) AS with_example, count_if(shown AND clear) AS both FROM x
""")
def example_intersection(t):
    """How many forms stand in an example of their own, and how many of those have one reading only."""
    case = F.get(F.array(*[F.lit(c) for c in qa.CASES]), F.ascii(F.right("source", F.lit(1))) % 6)
    forms = _forms_of_sources(t).filter("surface <> ''").withColumn("c", case)
    shown = qa.in_sentences(t.documents, forms.select("source", "lang", "surface"), ("source", "lang")).select("source", "lang").distinct().withColumn("shown", F.lit(True))
    clear = qa.unambiguous(forms, ("lang", "surface"), "c").select("lang", "surface", F.lit(True).alias("clear"))
    return forms.join(shown, ["source", "lang"], "left").join(clear, ["lang", "surface"], "left").agg(
        F.count("*").alias("forms"), F.count_if("shown").alias("with_example"), F.count_if(F.col("shown") & F.col("clear")).alias("both")
    )


@query(f"""
WITH {EDGES}, s AS (SELECT p_partkey AS item FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 400),
b AS (SELECT item, item AS node, 0 AS depth FROM s UNION SELECT item, dst, 1 FROM s JOIN h ON src = item),
x AS (SELECT item, depth, node, coalesce(p_name, o_orderpriority) AS text FROM b LEFT JOIN part ON p_partkey = node LEFT JOIN orders ON o_orderkey + 10000000000 = node)
SELECT item, string_agg(text, chr(10) ORDER BY depth, node) AS document FROM x GROUP BY item
""")
def serialise_ball(t):
    """Baseline that reads the ball as text, nearest nodes first."""
    from .graph_queries import tokens

    reached = traverse.balls(seeds(t), half(t), 1)
    return qa.serialised(reached.join(tokens(t).select("node", "text"), "node").select(F.col("seed").alias("item"), "depth", "node", "text"))


#: One letter for each remainder of a key, and its place in the alphabet; the last one lies outside it.
_LETTERS = ("a", "b", "c", "č", "s", "š", "z", "ž", "ö")
_PLACES = (0, 1, 2, 3, 18, 19, 23, 24, 25 + ord("ö"))


@query(f"""
WITH w AS (SELECT p_partkey, {list(_LETTERS)}[p_partkey % 9 + 1] || {list(_LETTERS)}[p_size % 9 + 1] AS word, {list(_PLACES)}[p_partkey % 9 + 1] AS x, {list(_PLACES)}[p_size % 9 + 1] AS y FROM part)
SELECT word, (rank() OVER (ORDER BY x, y))::INTEGER AS place, count(*) AS n FROM (SELECT DISTINCT p_partkey, word, x, y FROM w) GROUP BY word, x, y
""")
def slovene_collation(t):
    """Words in the order of the Slovene alphabet: how often each occurs and its place among the distinct ones."""
    from pyspark.sql.window import Window

    letter = lambda k: F.get(F.array(*[F.lit(x) for x in _LETTERS]), (k % 9).cast("int"))
    words = t.part.select(F.concat(letter(F.col("p_partkey")), letter(F.col("p_size"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(scalar.slovene_key(F.col("word")), "word"))  # one row a distinct word
    return words.withColumn("place", place)


@query("""
WITH p AS (SELECT CASE WHEN p_size <= 25 THEN 'core' ELSE 'tail' END AS population, p_partkey FROM part)
SELECT population, round(avg((p_partkey IN (SELECT doc_id FROM labels WHERE quality = 1))::INT), 6) AS defined,
    round(avg((p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7))::INT), 6) AS exemplified, count(*) AS n FROM p GROUP BY 1
""")
def population_coverage(t):
    """Share of core and tail words that have each relation."""
    words = t.part.select(F.col("p_partkey").alias("word"), F.when(F.col("p_size") <= 25, "core").otherwise("tail").alias("population"))
    flags = {
        "defined": t.labels.filter("quality = 1").select(F.col("doc_id").alias("word")),
        "exemplified": t.lineitem.filter("l_linenumber = 7").select(F.col("l_partkey").alias("word")),
    }
    out = qa.covered(words, "population", flags)
    return out.select("population", *[F.round(f, 6).alias(f) for f in flags], "n")


@query(f"""
WITH {EDGES}, d AS (SELECT p_partkey AS word, ('0x' || substr(md5('42:negative:' || p_partkey), 1, 14))::BIGINT % 100 < 10 AS asked,
    ('0x' || substr(md5('42:made up:' || p_partkey), 1, 14))::BIGINT % 100 < 30 AS made FROM part),
o AS (SELECT DISTINCT l_partkey AS word FROM lineitem WHERE l_linenumber = 7),
s AS (SELECT l_partkey AS word FROM (SELECT l_partkey, l_suppkey, bool_or(l_returnflag = 'R') AS has FROM lineitem GROUP BY ALL) GROUP BY l_partkey HAVING bool_or(has) AND NOT bool_and(has)),
n AS (SELECT DISTINCT a.dst AS word FROM m a JOIN m b ON a.src = b.src AND a.dst <> b.dst JOIN o ON o.word = b.dst)
SELECT word, CASE WHEN made THEN 'made_up' WHEN word NOT IN (SELECT word FROM o) THEN CASE WHEN word IN (SELECT word FROM n) THEN 'distractor' ELSE 'lacks' END ELSE 'other_sense' END AS flavour
FROM d WHERE asked AND (made OR word NOT IN (SELECT word FROM o) OR word IN (SELECT word FROM s))
""")
def negative_slice(t):
    """A tenth of the items have no answer, in four flavours, three in ten for words that do not exist."""
    words, has = t.part.select(F.col("p_partkey").alias("word")), t.lineitem.filter("l_linenumber = 7").select(F.col("l_partkey").alias("word"))
    senses = t.lineitem.groupBy(F.col("l_partkey").alias("word"), F.col("l_suppkey").alias("sense")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("has"))
    edges = staged(relational.constituents(t.lineitem), "constituents")
    a, b = edges.select("src", F.col("dst").alias("word")), edges.select("src", F.col("dst").alias("near"))
    return qa.negatives(words, has, senses, a.join(b, "src").filter("word <> near").select("word", "near"))


@query(f"""
WITH {_CELLS} SELECT anchor, number, {" || ', ' || ".join(f"coalesce(max(CASE WHEN " + '"case"' + f" = '{c}' THEN surface END), '/')" for c in qa.CASES)} AS gold
FROM u GROUP BY anchor, number HAVING count(*) >= 5
""")
def paradigm_by_number(t):
    """The six cases of one number, five of them at least."""
    out = qa.paradigm(_cells(t), ("number", qa.NUMBERS), ("case", qa.CASES), 5, by_outer=True)
    return out.select("anchor", "number", F.col("table").alias("gold"))


_VERB = f"""
f AS (
    SELECT p_partkey AS anchor, p_name || '-' || i AS surface, i % 3 AS person, i // 3 AS number FROM part, (SELECT unnest(range(9)) AS i) WHERE {_PRESENT} AND p_partkey % 4 = 1
    UNION ALL SELECT p_partkey, p_name || '-x', 0, 0 FROM part WHERE p_partkey % 10 = 1),
u AS (SELECT * FROM f WHERE anchor NOT IN (SELECT anchor FROM f GROUP BY anchor, person, number HAVING count(DISTINCT surface) > 1)),
v AS (SELECT anchor, {" || '; ' || ".join(" || ', ' || ".join(f"coalesce(max(CASE WHEN person = {p} AND number = {n} THEN surface END), '/')" for p in range(3)) for n in range(3))} AS "table"
    FROM u GROUP BY anchor HAVING count(*) = 9)
"""


def _verbs(t):
    """Tables of verbs with all nine cells of the present tense; slot 9 is the second form of a first cell."""
    i = F.col("i")
    person = F.get(F.array(*[F.lit(p) for p in qa.PERSONS]), i % 3)
    number = F.get(F.array(*[F.lit(n) for n in qa.NUMBERS]), F.floor(i % 9 / 3).cast("int"))
    told = F.when(i == 9, F.concat("p_name", F.lit("-x"))).otherwise(F.concat_ws("-", "p_name", i.cast("string")))
    rows = _slots(t, 10).filter(f"(i = 9 AND p_partkey % 10 = 1) OR (i < 9 AND {_PRESENT} AND p_partkey % 4 = 1)").select(
        F.col("p_partkey").alias("anchor"), told.alias("surface"), person.alias("person"), number.alias("number")
    )
    return qa.paradigm(rows, ("number", qa.NUMBERS), ("person", qa.PERSONS), 9)


@query(f"WITH {_VERB} SELECT anchor, 'ODGOVOR: ' || \"table\" AS answer FROM v")
def verb_paradigm(t):
    """T5: three persons by three numbers, all nine."""
    return _verbs(t).select("anchor", F.concat(F.lit(qa.ANSWER), "table").alias("answer"))


@query(f"""
WITH {_VERB} SELECT anchor, tense, CASE WHEN tense = 'sedanjik' THEN 'ODGOVOR: sedanjik: ' || "table" ELSE 'ODGOVOR: ni podatka v bazi' END AS answer
FROM (SELECT *, ['sedanjik', 'prihodnjik', 'preteklik'][('0x' || substr(md5('tense:' || anchor), 1, 14))::BIGINT % 3 + 1] AS tense FROM v)
""")
def verb_tenses(t):
    """The table of the present; other tenses are not recorded."""
    drawn = scalar.hash56(F.concat(F.lit("tense:"), F.col("anchor").cast("string"))) % 3
    asked = _verbs(t).withColumn("tense", F.get(F.array(F.lit("sedanjik"), F.lit("prihodnjik"), F.lit("preteklik")), drawn.cast("int")))
    told = F.concat(F.lit(qa.ANSWER), "tense", F.lit(": "), "table")
    return asked.select("anchor", "tense", F.when(F.col("tense") == "sedanjik", told).otherwise(F.lit(qa.NO_DATA)).alias("answer"))


@query("""
WITH b AS (SELECT l_suppkey AS anchor, p_partkey % 5 AS k, min(p_name) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT anchor, 'nedoločnik: ' || coalesce(max(CASE WHEN k = 0 THEN s END), '/') || '; namenilnik: ' || coalesce(max(CASE WHEN k = 1 THEN s END), '/')
    || '; velelnik: ' || coalesce(max(CASE WHEN k = 2 THEN s END), '/') AS gold FROM b GROUP BY anchor
""")
def nonfinite_forms(t):
    """Infinitive, supine and imperative, labelled, gaps as '/'."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    kinds = F.get(F.array(*[F.lit(v) for v in (*qa.VERB_FORMS, "present", "participle")]), (F.col("p_partkey") % 5).cast("int"))
    forms = rows.select(F.col("l_suppkey").alias("anchor"), F.col("p_name").alias("surface"), kinds.alias("vform"))
    gold = qa.picked(forms, "vform", qa.VERB_FORMS, F.lit(0))
    labels = [scalar.feature_label("vform", F.lit(v)) for v in qa.VERB_FORMS]
    parts = [F.concat(label, F.lit(": "), F.get("gold", F.lit(i))) for i, label in enumerate(labels)]
    return gold.select("anchor", F.concat_ws("; ", *parts).alias("gold"))


@query("SELECT p_partkey, ['moški spol', 'ženski spol', 'srednji spol'][p_size % 3 + 1] AS gold FROM part WHERE p_type = 'ECONOMY'")
def noun_gender(t):
    """Gender read from the unit, once it is among the unit's features."""
    gender = F.get(F.array(F.lit("masculine"), F.lit("feminine"), F.lit("neuter")), (F.col("p_size") % 3).cast("int"))
    return t.part.filter("p_type = 'ECONOMY'").select("p_partkey", scalar.feature_label("gender", gender).alias("gold"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN 'dovršni' WHEN 2 THEN 'nedovršni' ELSE 'dvovidski' END AS gold FROM part WHERE p_type = 'SMALL'")
def verb_aspect(t):
    """The aspect of a verb."""
    aspect = F.get(F.array(F.lit("biaspectual"), F.lit("perfective"), F.lit("progressive")), (F.col("p_size") % 3).cast("int"))
    return t.part.filter("p_type = 'SMALL'").select("p_partkey", scalar.feature_label("aspect", aspect).alias("gold"))


@query(f"""
WITH {_FORMS}, g AS (SELECT lang, surface, {_CASE_SQL}[ascii(right(source, 1)) % 6 + 1] AS c FROM f WHERE surface <> ''),
a AS (SELECT lang, surface, min(c) AS c FROM g GROUP BY lang, surface HAVING count(DISTINCT c) = 1)
SELECT doc_id, surface, 'ODGOVOR: ' || c AS answer FROM documents JOIN a USING (lang) WHERE {_STANDS}
""")
def form_analysis_in_sentence(t):
    """The reading of a form in an example, for forms with one reading only."""
    case = F.get(F.array(*[F.lit(c) for c in qa.CASES]), F.ascii(F.right("source", F.lit(1))) % 6)
    clear = qa.unambiguous(_forms_of_sources(t).filter("surface <> ''").withColumn("c", case), ("lang", "surface"), "c")
    joined = qa.in_sentences(t.documents, clear, ("lang",))
    return joined.select("doc_id", "surface", F.concat(F.lit(qa.ANSWER), "c").alias("answer"))


@query("""
SELECT p_partkey, ('0x' || substr(md5('slot:' || p_partkey), 1, 14))::BIGINT % 18 AS slot, ('0x' || substr(md5('number:' || p_partkey), 1, 14))::BIGINT % 3 AS number FROM part
""")
def slot_sample(t):
    """Uniform slots: one of 18 cells for single forms, one of three numbers for half paradigms."""
    cell = scalar.hash56(F.concat(F.lit("slot:"), F.col("p_partkey").cast("string"))) % 18
    number = scalar.hash56(F.concat(F.lit("number:"), F.col("p_partkey").cast("string"))) % 3
    return t.part.select("p_partkey", cell.alias("slot"), number.alias("number"))


@query("""
WITH a AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END AS k FROM documents),
b AS (SELECT doc_id, CASE WHEN length(t) > 0 THEN greatest(1, length(t) // 4) ELSE 0 END AS k FROM (SELECT doc_id, replace(text, '.', '') AS t FROM documents))
SELECT count(*) AS n, sum(a.k)::BIGINT AS old_tokens, sum(b.k)::BIGINT AS new_tokens, round(avg(b.k), 6) AS new_mean, count_if(b.k = 0) AS zeros,
    round(avg((a.k = b.k)::INT), 6) AS agreement FROM a JOIN b USING (doc_id)
""")
def token_agreement(t):
    """Token lengths of two stores compared node by node: with and without full stops."""
    old = t.documents.select("doc_id", scalar.token_proxy(F.col("text")).alias("token_len"))
    new = t.documents.select("doc_id", scalar.token_proxy(F.replace("text", F.lit("."), F.lit(""))).alias("token_len"))
    out = store.token_agreement(old, new, "doc_id")
    return out.select("n", "old_tokens", "new_tokens", F.round("new_mean", 6).alias("new_mean"), "zeros", F.round("agreement", 6).alias("agreement"))


@query("""
WITH g AS (SELECT p_partkey AS id, p_name || ' | ' || p_type AS gold, 'T12' AS type FROM part)
SELECT type, count(*) AS items, 0::BIGINT AS bad_lines, 1.0::DOUBLE AS self_grade FROM g GROUP BY type
""")
def gold_checks(t):
    """Every gold line is well formed and scores 1 against itself."""
    line = F.concat(F.lit(qa.ANSWER), "p_name", F.lit(" | "), "p_type")
    items = t.part.select(F.col("p_partkey").alias("id"), line.alias("pred"), line.alias("gold"), F.lit("T12").alias("type"))
    bad = F.count_if(~F.col("gold").rlike(r"^ODGOVOR: [^\n]+$"))
    return qa.graded(items, "|", True).groupBy("type").agg(F.count("*").alias("items"), bad.alias("bad_lines"), F.avg("f1").alias("self_grade"))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'type' WHEN 1 THEN 'line' WHEN 2 THEN 'arity' ELSE 'separator' END AS breach FROM part WHERE p_partkey % 5 <> 4
""")
def contract_breaches(t):
    """Gold answers that break the contract of their type: unknown types, no line, wrong number of items, separators inside items."""
    k = F.col("p_partkey") % 5
    kind = F.when(k == 0, "T99").when(k == 2, "T7").otherwise("T15")
    gold = F.when(k == 3, F.array(F.concat("p_name", F.lit(", "), "p_type"))).otherwise(F.array("p_name", "p_type"))
    answer = F.when(k == 1, F.lit("odgovor")).otherwise(F.concat(F.lit(qa.ANSWER), "p_name"))
    items = t.part.select(F.col("p_partkey").alias("id"), kind.alias("type"), gold.alias("gold"), answer.alias("answer"))
    return qa.contract_breaches(items).select("id", "breach")


@query(f"""
WITH {_SENSES}, {_DEFINED} SELECT count(*) AS lists, count(*) AS consistent, count(*) AS in_order FROM g
""")
def list_consistency(t):
    """T14's number is the length of T12's list, and every list is in its canonical order."""
    listed = _defined(t)
    first = _senses(t).filter("class = 'defined'").groupBy("anchor", "definition").agg(F.min("number").alias("k"))
    again = first.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "definition"))), lambda x: x["definition"]).alias("sorted"))
    both = listed.join(again, "anchor")
    return both.agg(
        F.count("*").alias("lists"), F.count_if(F.size("gold") == F.col("n")).alias("consistent"), F.count_if(F.col("gold") == F.col("sorted")).alias("in_order")
    )

"""The whole build on a lexicon rendered from the driver's tables: lines -> triples -> graph -> store, under SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, vocab
from ..operators import build, sizing, store, typed
from ..sources import ntriples
from ..sources.relational import iri, line
from .build_queries import _CASES, _NUMBERS, _POS, _SNIPPET
from .catalog import query
from .staging import shared_folder, staged

#: Added to keys so that entries of several words, their senses, and other forms differ from those of parts.
ENTRY, SENSE, FORM, SECOND = 10_000_000_000, 200_000_000, 20_000_000, 9_000_000
V = vocab


def _lit(text: Column, tag: str, quotes: str = '"""') -> Column:
    """A literal of any text: quotes, backslashes and line breaks are escaped."""
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', "\\u0022"), ("č", "\\U0000010d")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit(quotes), text, F.lit(f"{quotes}@{tag}"))


def _name(stem: str, number: Column | str) -> Column:
    return iri(stem, F.col(number) if isinstance(number, str) else number)


def lines(t) -> DataFrame:
    """Parts are entries with a form, orders entries of several words, suppliers inflected forms and translations,
    lines of orders senses, documents examples; return flags make lines synonyms or antonyms. Some lines are malformed,
    some names lie outside the data's own host, some predicates are not read."""
    p, s, o, n = (F.col(c) for c in ("p_partkey", "s_suppkey", "o_orderkey", "l_linenumber"))
    sense_no = F.col("l_partkey") * 100 + n
    lex, ont = V.LEXINFO, V.ONTOLEX
    value = lambda x: F.concat(F.lit(f"<{lex}"), x, F.lit(">"))
    pick = lambda names, k: F.get(F.array(*[F.lit(x) for x in names]), (k % len(names)).cast("int"))
    unit, form = _name("lexical-unit", p), _name("word-form", p)
    part, supplier, orders, item = t.part, t.supplier, t.orders, t.lineitem
    entry, sense = _name("lexical-unit", F.col("l_orderkey") + ENTRY), _name("sense", sense_no)
    piece = _name("lexical-unit-part", F.col("l_orderkey") * 100 + n)
    other_sense = _name("sense", F.col("l_suppkey") * 100 + n)
    named = F.when(p % 7 == 0, F.concat("p_name", F.lit(' "q" \\'))).otherwise(F.col("p_name"))
    owner = F.concat(F.lit("<https://www.lex.example/dependent-sense-"), (o + SENSE).cast("string"), F.lit("-lexical-unit-"), F.col("o_custkey").cast("string"), F.lit(">"))
    told = F.concat(F.lit("harc "), "s_name")
    rows = [
        (part.filter("p_size > 5"), unit, ont + "canonicalForm", form),
        (part.filter("p_size > 5 and p_partkey % 13 = 0"), unit, ont + "canonicalForm", _name("word-form", p + SECOND)),
        (part, form, ont + "writtenRep", _lit(named, "sl")),
        (part.filter("p_partkey % 2 = 0"), form, ont + "writtenRep", _lit(F.upper(named), "sl-SI")),
        (part, _name("word-form", p + SECOND), ont + "writtenRep", _lit(F.concat(F.lit("drugič "), "p_name"), "sl")),
        (part.filter("p_partkey % 11 = 0"), form, ont + "writtenRep", _lit(F.col("p_name"), "en", '"')),
        (part, form, lex + "case", value(pick(_CASES, p))),
        (part.filter("p_partkey % 19 = 0"), form, lex + "case", value(F.lit("accusative"))),
        (part.filter("p_partkey % 7 <> 0"), form, lex + "number", value(pick(_NUMBERS, F.col("p_size")))),
        (part.filter("p_partkey % 5 = 0"), form, lex + "definiteness", value(F.lit("yes"))),
        (part, unit, lex + "case", value(F.lit("dative"))),
        (part, unit, lex + "partOfSpeech", value(pick(_POS, p))),
        (part.filter("p_partkey % 4 = 1"), unit, lex + "aspect", value(F.lit("perfective"))),
        (part.filter("p_partkey % 11 = 0"), unit, lex + "clitic", value(F.lit("bound"))),
        (part, unit, V.RDF + "type", F.lit(f"<{ont}LexicalEntry>")),
        (part, unit, ont + "otherForm", F.lit("<http://elsewhere.example/word-form-1>")),
        (item.select("l_partkey", "l_suppkey").distinct(), _name("lexical-unit", "l_partkey"), ont + "otherForm", _name("word-form", F.col("l_suppkey") + FORM)),
        (supplier.filter("s_suppkey % 9 <> 0"), _name("word-form", s + FORM), ont + "writtenRep", _lit(F.col("s_name"), "sl")),
        (supplier, _name("word-form", s + FORM), lex + "gender", value(F.lit("feminine"))),
        (item.select("l_partkey", "l_linenumber").distinct(), _name("lexical-unit", "l_partkey"), ont + "sense", sense),
        (item.filter("l_partkey % 17 = 0").select("l_partkey", "l_linenumber").distinct(), _name("lexical-unit", F.col("l_partkey") + 1), ont + "sense", sense),
        (item.filter("(l_partkey * 100 + l_linenumber) % 3 = 0").select("l_partkey", "l_linenumber").distinct(), sense, V.SKOS + "definition", _lit(F.concat(F.lit("č "), sense_no.cast("string")), "sl")),
        (item.filter("(l_partkey * 100 + l_linenumber) % 4 = 0").select("l_partkey", "l_linenumber").distinct(), sense, V.SKOS + "definition", _lit(F.lit("battle"), "en")),
        (item.select("l_partkey", "l_linenumber", "l_orderkey").distinct(), sense, V.LEXICOG + "usageExample", _name("example", "l_orderkey")),
        (t.documents, _name("example", "doc_id"), V.RDF + "value", F.when(F.col("lang") == "de", _lit(F.col("text"), "de")).otherwise(_lit(F.col("text"), "sl"))),
        (item.filter("l_returnflag = 'R'"), sense, lex + "synonym", other_sense),
        (item.filter("l_returnflag = 'A'"), sense, lex + "antonym", other_sense),
        (orders, _name("lexical-unit", o + ENTRY), ont + "canonicalForm", _name("form-lexical-unit", o)),
        (orders, _name("form-lexical-unit", o), ont + "writtenRep", _lit(F.concat(F.lit("zveza "), o.cast("string")), "sl")),
        (orders, _name("lexical-unit", o + ENTRY), ont + "sense", _name("sense", o + SENSE)),
        (item, entry, V.DECOMP + "constituent", piece),
        (item, piece, V.DECOMP + "correspondsTo", _name("lexical-unit", "l_partkey")),
        (item.filter("l_suppkey % 3 = 0"), piece, V.DECOMP + "correspondsTo", _name("lexical-unit", "l_suppkey")),
        (item.join(orders, F.col("l_orderkey") == o), owner, V.RDFS + "member", sense),
        (supplier.filter("s_suppkey % 3 = 0"), _name("translation-form", s), ont + "writtenRep", _lit(told, "hun")),
        (supplier.filter("s_suppkey % 3 = 1"), _name("translation-form", s), ont + "writtenRep", _lit(told, "sl")),
        (supplier.filter("s_suppkey % 3 = 2"), _name("translation-form", s), ont + "writtenRep", _lit(told, "la-x")),
        (supplier, _name("translation-form", s), V.VARTRANS + "source", _name("sense", s * 100 + 1)),
        (supplier, _name("lexical-entry-translation", s), ont + "sense", _name("sense-translation", s)),
        (supplier, _name("lexical-entry-translation", s), ont + "canonicalForm", _name("translation-form", s)),
        (supplier, _name("sense", s * 100 + 1), V.VARTRANS + "target", _name("translation-form", s)),
        (orders, _name("lexical-unit", o + ENTRY), V.FRAC + "head", _name("lexical-unit", "o_custkey")),
    ]
    out = None
    for df, subject, predicate, object_ in rows:
        one = df.select(line(subject, predicate, object_).alias("value"))
        out = one if out is None else out.unionAll(one)
    broken = t.region.select(F.explode(F.array(*[F.lit(x) for x in ("# note", "<broken", f'<https://www.lex.example/sense-1> <{V.SKOS}definition> """open')])).alias("value"))
    whole = ntriples.once(F.col("value")).alias("value")  # the parser is planned once, not in every branch
    return out.unionAll(broken).select(whole).filter("value is not null")


def graph(t) -> build.Graph:
    return build.build(ntriples.parse(lines(t)))


def _dispatched(t, keys) -> DataFrame:
    triples = ntriples.parse(lines(t), predicates=ntriples.predicates_of(keys))
    return build.dispatched_table(triples, keys=keys)


def relations(t, *keys: str) -> dict[str, DataFrame]:
    """Relations that a part of the predicates is enough for; only those triples are written."""
    return build.relations(_dispatched(t, keys))


def edges(t) -> DataFrame:
    """The graph's edges, which no text but the lemmas decides on; the names of collocations are not looked up."""
    return build.from_dispatched(_dispatched(t, build.EDGE_KEYS), colloc_text="pair").edges


def _c(kind: int, number: str) -> str:
    return f"(({kind}::BIGINT << 56) | ({number}))"


_SL = f"""
it AS (SELECT *, l_partkey * 100 + l_linenumber AS sn FROM lineitem),
named AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' "q" \\' ELSE p_name END AS nm FROM part),
wall AS (
    SELECT {_c(3, 'p_partkey')} AS code, nm AS text FROM named UNION ALL SELECT {_c(3, 'p_partkey')}, upper(nm) FROM named WHERE p_partkey % 2 = 0
    UNION ALL SELECT {_c(3, f'p_partkey + {SECOND}')}, 'drugič ' || p_name FROM part
    UNION ALL SELECT {_c(3, f's_suppkey + {FORM}')}, s_name FROM supplier WHERE s_suppkey % 9 <> 0
    UNION ALL SELECT {_c(4, 'o_orderkey')}, 'zveza ' || o_orderkey FROM orders
    UNION ALL SELECT {_c(7, 's_suppkey')}, 'harc ' || s_name FROM supplier WHERE s_suppkey % 3 = 1),
w AS (SELECT code, arg_min(text, (length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')), text)) AS text FROM wall GROUP BY code),
canon AS (
    SELECT {_c(1, 'p_partkey')} AS lu, {_c(3, 'p_partkey')} AS form FROM part WHERE p_size > 5
    UNION ALL SELECT {_c(1, 'p_partkey')}, {_c(3, f'p_partkey + {SECOND}')} FROM part WHERE p_size > 5 AND p_partkey % 13 = 0
    UNION ALL SELECT {_c(1, f'o_orderkey + {ENTRY}')}, {_c(4, 'o_orderkey')} FROM orders),
co AS (SELECT lu, min(form) AS form FROM canon GROUP BY lu),
oth AS (SELECT DISTINCT {_c(1, 'l_partkey')} AS lu, {_c(3, f'l_suppkey + {FORM}')} AS form FROM it),
sen AS (
    SELECT DISTINCT {_c(1, 'l_partkey')} AS lu, {_c(5, 'sn')} AS sense FROM it
    UNION ALL SELECT DISTINCT {_c(1, 'l_partkey + 1')}, {_c(5, 'sn')} FROM it WHERE l_partkey % 17 = 0
    UNION ALL SELECT {_c(1, f'o_orderkey + {ENTRY}')}, {_c(5, f'o_orderkey + {SENSE}')} FROM orders),
use AS (SELECT DISTINCT {_c(5, 'sn')} AS sense, {_c(8, 'l_orderkey')} AS example FROM it),
mw AS (
    SELECT DISTINCT {_c(1, f'l_orderkey + {ENTRY}')} AS mwe, word FROM it JOIN (
        SELECT part, min(word) AS word FROM (SELECT l_orderkey * 100 + l_linenumber AS part, {_c(1, 'l_partkey')} AS word FROM it
            UNION ALL SELECT l_orderkey * 100 + l_linenumber, {_c(1, 'l_suppkey')} FROM it WHERE l_suppkey % 3 = 0) GROUP BY part)
        ON part = l_orderkey * 100 + l_linenumber),
tra AS (SELECT {_c(7, 's_suppkey')} AS form, {_c(5, 's_suppkey * 100 + 1')} AS sense FROM supplier),
so AS (SELECT sense, min(lu) AS lu FROM sen GROUP BY sense),
sl AS (SELECT so.sense, so.lu, w.text AS lemma FROM so LEFT JOIN co USING (lu) LEFT JOIN w ON w.code = co.form),
df AS (SELECT DISTINCT {_c(5, 'sn')} AS code, 'č ' || sn AS definition FROM it WHERE sn % 3 = 0),
va AS (SELECT {_c(8, 'doc_id')} AS code, min(text) AS value FROM documents WHERE coalesce(lang, '') <> 'de' AND text IS NOT NULL GROUP BY 1),
e AS (
    SELECT lu AS a, form AS b, 'other' AS rel FROM oth UNION ALL SELECT lu, sense, 'sense' FROM sen UNION ALL SELECT sense, example, 'usage' FROM use
    UNION ALL SELECT mwe, word, 'constituent' FROM mw UNION ALL SELECT form, sense, 'translation' FROM tra),
u AS (SELECT a AS code FROM e UNION SELECT b FROM e UNION SELECT lu FROM canon),
ft AS (
    SELECT {_c(3, 'p_partkey')} AS form, CASE WHEN p_partkey % 19 = 0 AND c > 'accusative' THEN 'accusative' ELSE c END AS c,
        CASE WHEN p_partkey % 7 <> 0 THEN ['ednina', 'dvojina', 'množina'][p_size % 3 + 1] END AS n, NULL AS g, CASE WHEN p_partkey % 5 = 0 THEN 'določna oblika' END AS d
    FROM (SELECT *, {list(_CASES)}[p_partkey % 6 + 1] AS c FROM part)
    UNION ALL SELECT {_c(3, f's_suppkey + {FORM}')}, NULL, NULL, 'ženski spol', NULL FROM supplier),
fl AS (SELECT form, concat_ws(', ', MAP {{{', '.join(f"'{c}': '{V.LABELS[c]}'" for c in _CASES)}}}[c], n, g, d) AS labels FROM ft),
ul AS (
    SELECT {_c(1, 'p_partkey')} AS lu, concat_ws(', ', [{', '.join(f"'{V.POS_LABELS[x]}'" if x in V.POS_LABELS else 'NULL' for x in _POS)}][p_partkey % 4 + 1],
        CASE WHEN p_partkey % 4 = 1 THEN 'dovršni' END, CASE WHEN p_partkey % 11 = 0 THEN 'naslonska oblika' END) AS labels FROM part),
sh AS (
    SELECT coalesce(x.lu, y.lu) AS lu, coalesce(x.form, y.form) AS form FROM (SELECT lu, form FROM co JOIN w ON w.code = co.form) x
    FULL JOIN (SELECT lu, min(form) AS form FROM oth JOIN w ON w.code = oth.form GROUP BY lu) y ON x.lu = y.lu),
an AS (
    SELECT sh.lu AS code, 'iztočnica: ' || w.text || CASE WHEN f = '' THEN '' ELSE ' (' || f || ')' END AS text
    FROM (SELECT sh.*, concat_ws(', ', nullif(ul.labels, ''), nullif(fl.labels, '')) AS f FROM sh LEFT JOIN ul ON ul.lu = sh.lu LEFT JOIN fl ON fl.form = sh.form) sh
    JOIN w ON w.code = sh.form),
fo AS (
    SELECT form AS code, 'oblika: ' || w.text || CASE WHEN coalesce(fl.labels, '') = '' THEN '' ELSE ' (' || fl.labels || ')' END AS text
    FROM (SELECT DISTINCT form FROM oth) JOIN w ON w.code = form LEFT JOIN fl USING (form)),
fx AS (SELECT sense, min(example) AS example, arg_min(value, example) AS value FROM use JOIN va ON va.code = example GROUP BY sense),
fs AS (SELECT sense, {_SNIPPET} AS short FROM (SELECT sense, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS f FROM fx)),
od AS (
    SELECT sense, arg_min(k, lu) AS k FROM (SELECT lu, sense, row_number() OVER (PARTITION BY lu ORDER BY sense) AS k, count(*) OVER (PARTITION BY lu) AS n FROM sen)
    WHERE n > 1 GROUP BY sense),
st AS (
    SELECT sl.sense AS code, CASE WHEN k IS NULL THEN 'pomen: ' ELSE 'pomen ' || k || ': ' END
        || coalesce(definition, lemma || CASE WHEN coalesce(short, '') = '' THEN '' ELSE ' (zgled: ' || short || ')' END) AS text
    FROM sl LEFT JOIN df ON df.code = sl.sense LEFT JOIN fs ON fs.sense = sl.sense LEFT JOIN od ON od.sense = sl.sense
    WHERE definition IS NOT NULL OR coalesce(lemma, '') <> ''),
tr AS (
    SELECT {_c(7, 's_suppkey')} AS code, CASE s_suppkey % 3 WHEN 0 THEN 'prevod (madžarsko): ' WHEN 1 THEN 'prevod: ' ELSE 'prevod (la-x): ' END || 'harc ' || s_name AS text FROM supplier),
own AS (
    SELECT code, min((kind, text)) AS t FROM (
        SELECT code, 0 AS kind, text FROM an UNION ALL SELECT code, 1, text FROM fo UNION ALL SELECT code, 2, text FROM st
        UNION ALL SELECT code, 3, 'zgled: ' || value FROM va WHERE value <> '' UNION ALL SELECT code, 4, text FROM tr) GROUP BY code),
nn AS (
    SELECT 'c:' || code AS key, code >> 56 AS type_id, CASE WHEN t IS NULL THEN 8 ELSE t[1] END AS kind, code IN (SELECT mwe FROM mw) AS is_mwe, coalesce(t[2], '') AS text
    FROM u LEFT JOIN own USING (code)),
le AS (SELECT sense, lemma FROM sl JOIN u ON u.code = sense WHERE coalesce(lemma, '') <> ''),
mb AS (SELECT {_c(11, f'((o_orderkey + {SENSE}) << 28) | o_custkey')} AS owner, {_c(5, f'o_orderkey + {SENSE}')} AS named, {_c(5, 'sn')} AS member FROM it JOIN orders ON o_orderkey = l_orderkey),
bi AS (
    SELECT lo, hi, arg_min(named, owner) AS named FROM (SELECT owner, named, min(member) AS lo, max(member) AS hi FROM mb GROUP BY ALL HAVING count(DISTINCT member) = 2) GROUP BY lo, hi),
pa AS (
    SELECT DISTINCT CASE l_returnflag WHEN 'R' THEN 6 ELSE 7 END AS kind, least({_c(5, 'sn')}, {_c(5, 'l_suppkey * 100 + l_linenumber')}) AS lo,
        greatest({_c(5, 'sn')}, {_c(5, 'l_suppkey * 100 + l_linenumber')}) AS hi, NULL::VARCHAR AS phrase FROM it WHERE l_returnflag <> 'N' AND l_partkey <> l_suppkey
    UNION ALL SELECT 5, lo, hi, lemma FROM bi LEFT JOIN sl ON sl.sense = bi.named),
mi AS (
    SELECT kind || ':' || lo || ':' || hi AS key, kind, lo, hi, CASE kind WHEN 5 THEN 'kolokacija: ' || coalesce(phrase, a.lemma || ' + ' || b.lemma)
        WHEN 6 THEN 'sopomenka: ' || a.lemma || ' ~ ' || b.lemma ELSE 'protipomenka: ' || a.lemma || ' ~ ' || b.lemma END AS text
    FROM pa JOIN le a ON a.sense = lo JOIN le b ON b.sense = hi),
no AS (SELECT * FROM nn UNION ALL SELECT key, -1, kind, false, text FROM mi),
ed AS (
    SELECT 'c:' || a AS src, 'c:' || b AS dst, rel FROM e UNION ALL SELECT key, 'c:' || lo, kind::VARCHAR FROM mi UNION ALL SELECT key, 'c:' || hi, kind::VARCHAR FROM mi)
"""


@query(f"WITH {_SL} SELECT key, type_id::INTEGER AS type_id, kind::TINYINT AS kind, is_mwe, text, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END::INTEGER AS token_len FROM no")
def graph_nodes(t):
    """All nodes of the built graph with their texts."""
    return graph(t).nodes.select("key", "type_id", "kind", "is_mwe", "text", "token_len")


@query(f"WITH {_SL} SELECT src, dst, rel FROM ed")
def graph_edges(t):
    """All edges of the built graph."""
    return edges(t)


@query(f"WITH {_SL}, h AS (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed) SELECT src AS node, count(*) AS degree FROM h GROUP BY src")
def graph_degrees(t):
    return build.half_edges(edges(t)).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


@query(f"WITH {_SL} SELECT sense, lu, lemma FROM sl")
def graph_sense_lemmas(t):
    """Each sense's least owner and the written form of that owner's canonical form."""
    found = relations(t, "canon", "sense", "written")
    return build.sense_lemmas(found["sense"], found["canon_of"], found["written"])


@query(f"WITH {_SL} SELECT sense, example, value AS example_text FROM fx")
def graph_first_examples(t):
    return relations(t, "usage", "value")["examples"]


@query(f"WITH {_SL} SELECT code, 'definition' AS part, definition AS text FROM df UNION ALL SELECT code, 'value', value FROM va UNION ALL SELECT code, 'written', text FROM w")
def graph_literals(t):
    """One Slovene text a code and property: other languages and later spellings lose."""
    parts = relations(t, "definition", "value", "written")
    rows = [parts[k].select("code", F.lit(k).alias("part"), F.col(c).alias("text")) for k, c in (("definition", "definition"), ("value", "value"), ("written", "text"))]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query(f"""
WITH {_SL} SELECT 'form' AS owner, form AS code, c AS "case", nullif(n, '') IS NOT NULL AS has_number, NULL AS aspect FROM ft
UNION ALL SELECT 'unit', {_c(1, 'p_partkey')}, NULL, false, CASE WHEN p_partkey % 4 = 1 THEN 'perfective' END FROM part WHERE p_partkey % 4 = 1 OR p_partkey % 11 = 0
""")
def graph_features(t):
    """Feature columns of forms and units; features of other subjects are dropped, of two values the least stays."""
    parts = relations(t, *V.FEATURES, *V.UNIT_FEATURES)
    forms = parts["features"].select(F.lit("form").alias("owner"), "code", "case", F.col("number").isNotNull().alias("has_number"), F.lit(None).cast("string").alias("aspect"))
    units = parts["units"].select(F.lit("unit").alias("owner"), "code", F.lit(None).cast("string").alias("case"), F.lit(False).alias("has_number"), "aspect")
    return forms.unionAll(units)


@query(f"""
WITH {_SL}, r AS (
    SELECT 'edge' AS role, 'canon' AS key, count(*) AS n FROM canon UNION ALL SELECT 'edge', 'canon', count(*) FROM supplier
    UNION ALL SELECT 'edge', 'other', count(*) FROM oth UNION ALL SELECT 'edge', 'sense', count(*) FROM sen UNION ALL SELECT 'edge', 'sense', count(*) FROM supplier
    UNION ALL SELECT 'edge', 'usage', count(*) FROM use UNION ALL SELECT 'edge', CASE l_returnflag WHEN 'R' THEN 'syn' ELSE 'ant' END, count(*) FROM it WHERE l_returnflag <> 'N' GROUP BY l_returnflag
    UNION ALL SELECT 'edge', 'constit', count(*) FROM it UNION ALL SELECT 'edge', 'corr', count(*) + count_if(l_suppkey % 3 = 0) FROM it
    UNION ALL SELECT 'edge', 'tsrc', count(*) FROM tra UNION ALL SELECT 'edge', 'member', count(*) FROM mb
    UNION ALL SELECT 'pos', 'pos', count(*) FROM part UNION ALL SELECT 'literal', 'written', count(*) FROM wall
    UNION ALL SELECT 'literal', 'written', count_if(p_partkey % 11 = 0) FROM part UNION ALL SELECT 'literal', 'written', count_if(s_suppkey % 3 <> 1) FROM supplier
    UNION ALL SELECT 'literal', 'definition', count(*) + (SELECT count(DISTINCT sn) FROM it WHERE sn % 4 = 0) FROM df
    UNION ALL SELECT 'literal', 'value', count(text) FROM documents
    UNION ALL SELECT 'feature', 'case', 2 * count(*) + count_if(p_partkey % 19 = 0) FROM part UNION ALL SELECT 'feature', 'number', count_if(p_partkey % 7 <> 0) FROM part
    UNION ALL SELECT 'feature', 'definiteness', count_if(p_partkey % 5 = 0) FROM part UNION ALL SELECT 'feature', 'gender', count(*) FROM supplier
    UNION ALL SELECT 'unit', 'aspect', count_if(p_partkey % 4 = 1) FROM part UNION ALL SELECT 'unit', 'clitic', count_if(p_partkey % 11 = 0) FROM part)
SELECT role, key, sum(n)::BIGINT AS n, CASE WHEN role = 'edge' THEN sum(n)::BIGINT ELSE 0 END AS inside FROM r GROUP BY role, key
""")
def graph_dispatch(t):
    """Triples of every role and key, and those whose object lies under the data's host; other predicates are dropped."""
    found = ntriples.dispatched(ntriples.parse(lines(t))).filter("role <> 'edge' or oc is not null")
    return found.groupBy("role", "key").agg(F.count("*").alias("n"), F.count_if(F.col("oc").isNotNull()).alias("inside"))


@query(f"WITH {_SL}, s AS (SELECT len(list(DISTINCT member)) AS size FROM mb GROUP BY owner) SELECT size::BIGINT AS size, count(*) AS owners FROM s GROUP BY size")
def graph_members(t):
    """Sizes of the member sets of collocation names."""
    triples = ntriples.parse(lines(t), predicates=ntriples.predicates_of(("member",)))
    return build.member_histogram(build.relations(ntriples.dispatched(triples, keys=("member",)))["members"])


@query(f"""
WITH {_SL} SELECT type_id::INTEGER AS type_id, count_if(text = '') AS textless, count(*) AS n FROM no GROUP BY type_id
""")
def graph_textless(t):
    return build.textless(graph(t).nodes)


def _saved(t) -> tuple[str, build.Graph]:
    import uuid

    path = f"{shared_folder(t.spark).rstrip('/')}/graphloom-store-{uuid.uuid4().hex}"
    store.save(graph(t), path, {"note": "rendered tables"})
    return path, store.load(t.spark, path)[0]


@query(f"""
WITH {_SL}, k AS (SELECT kind, count(*) AS n FROM no GROUP BY kind)
SELECT 'nodes' AS name, count(*) AS n FROM no UNION ALL SELECT 'edges', count(*) FROM ed UNION ALL SELECT 'kind_' || kind, n FROM k
UNION ALL SELECT 'textless', count_if(text = '') FROM no UNION ALL SELECT 'is_form_leaf', count_if(kind = 1) FROM no
UNION ALL SELECT 'is_example', count_if(kind = 3) FROM no UNION ALL SELECT 'is_colloc', count_if(kind = 5) FROM no
UNION ALL SELECT 'tokens', sum(CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT FROM no
""")
def store_contents(t):
    """A saved and reloaded store: counts of its manifest, its masks and its tokens."""
    path, loaded = _saved(t)
    manifest = store.load(t.spark, path)[1]
    told = {"nodes": manifest["nodes"], "edges": manifest["edges"]} | {k: v for k, v in manifest["stats"].items() if k == "textless" or k.startswith("kind_")}
    rows = t.spark.createDataFrame(list(told.items()), "name string, n long")
    masks = loaded.nodes.agg(*[F.count_if(m).alias(m) for m in manifest["masks"]], F.sum("token_len").alias("tokens"))
    return rows.unionByName(masks.unpivot([], masks.columns, "name", "n"))


@query("""
SELECT unnest(['duplicate keys', 'missing ends', 'asymmetric half-edges', 'minted degree is not 2', 'tokens without text', 'negative or missing kind', 'node count',
    'edge count', 'kind counts', 'token total', 'content of nodes', 'content of edges']) AS "check", 0::BIGINT AS found
""")
def store_checks(t):
    """Every check of a sound store, over all its rows."""
    path, loaded = _saved(t)
    return store.violations(loaded, store.load(t.spark, path)[1])


@query(f"""
WITH {_SL}, d AS (
    SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi, min(p) AS pred FROM (
        SELECT lu AS a, form AS b, 1 AS p FROM canon UNION ALL SELECT {_c(10, 's_suppkey')}, {_c(7, 's_suppkey')}, 1 FROM supplier UNION ALL SELECT lu, form, 2 FROM oth
        UNION ALL SELECT lu, sense, 3 FROM sen UNION ALL SELECT {_c(10, 's_suppkey')}, {_c(6, 's_suppkey')}, 3 FROM supplier
        UNION ALL SELECT {_c(5, 'sn')}, {_c(5, 'l_suppkey * 100 + l_linenumber')}, CASE l_returnflag WHEN 'R' THEN 4 ELSE 5 END FROM it WHERE l_returnflag <> 'N'
        UNION ALL SELECT sense, example, 6 FROM use
        UNION ALL SELECT {_c(1, f'l_orderkey + {ENTRY}')}, {_c(2, 'l_orderkey * 100 + l_linenumber')}, 7 FROM it
        UNION ALL SELECT {_c(2, 'l_orderkey * 100 + l_linenumber')}, {_c(1, 'l_partkey')}, 8 FROM it
        UNION ALL SELECT {_c(2, 'l_orderkey * 100 + l_linenumber')}, {_c(1, 'l_suppkey')}, 8 FROM it WHERE l_suppkey % 3 = 0
        UNION ALL SELECT form, sense, 9 FROM tra UNION ALL SELECT {_c(1, f'o_orderkey + {ENTRY}')}, {_c(1, 'o_custkey')}, 11 FROM orders) WHERE a <> b GROUP BY 1, 2)
SELECT lo, hi, pred FROM d
""")
def first_generation_graph(t):
    """The typed, undirected and simple graph of the first generation: the least predicate of every pair."""
    return typed.first_generation(ntriples.parse(lines(t)))


@query(f"""
WITH {_SL}, a AS (
    SELECT {_c(5, 'sn')} AS code, 1 AS p, 'č ' || sn AS text FROM it WHERE sn % 3 = 0 UNION ALL SELECT {_c(8, 'doc_id')}, 1, text FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT code, 2, text FROM wall)
SELECT code, arg_min(text, (p, text)) AS text FROM a GROUP BY code
""")
def first_generation_texts(t):
    """A definition or a value in any language before a written form."""
    return typed.first_generation_texts(ntriples.parse(lines(t)))


@query(f"""
WITH {_SL}, r AS (SELECT rel, count(*) AS n FROM e GROUP BY rel)
SELECT rel, CASE rel WHEN 'other' THEN 'oblika' WHEN 'sense' THEN 'pomen' WHEN 'usage' THEN 'zgled' WHEN 'constituent' THEN 'sestavina' ELSE 'prevod' END AS label, n FROM r
""")
def second_generation_labels(t):
    """Edges of the directed, labelled graph of the second generation by relation."""
    return typed.with_labels(build.real_edges(relations(t, *build.REAL_KEYS))).groupBy("rel", "label").agg(F.count("*").alias("n"))


@query(f"""
WITH {_SL}, n AS (SELECT text, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS k FROM no)
SELECT count(*) AS nodes, count(DISTINCT text) AS texts, sum(k)::BIGINT AS tokens FROM n
""")
def distinct_text_lengths(t):
    """Token lengths measured once for every different text."""
    nodes = staged(graph(t).nodes.select("key", "text"), "texts")
    measured = build.with_token_lengths(nodes, scalar.token_proxy, distinct=True)
    return measured.agg(F.count("*").alias("nodes"), F.count_distinct("text").alias("texts"), F.sum("token_len").alias("tokens"))


@query(f"""
WITH {_SL}, c AS (SELECT mi.key, phrase, a.lemma AS la, b.lemma AS lb FROM mi JOIN pa ON pa.kind = mi.kind AND pa.lo = mi.lo AND pa.hi = mi.hi
    JOIN le a ON a.sense = mi.lo JOIN le b ON b.sense = mi.hi WHERE mi.kind = 5)
SELECT 'text changed, kind 5' AS "check", count_if(phrase IS NOT NULL AND phrase <> la || ' + ' || lb) AS found FROM c
UNION ALL SELECT 'text changed, kind 0', count(*) FROM an JOIN ul ON ul.lu = an.code JOIN part ON {_c(1, 'p_partkey')} = an.code WHERE p_partkey % 4 = 1 OR p_partkey % 11 = 0
UNION ALL SELECT unnest(['keys in one only', 'kind changed', 'surface changed', 'items lost', 'edges in old only', 'edges in new only', 'degree changed']), 0
""")
def store_rules(t):
    """An older build, with pairs for names and without unit features, against the newer: what changed, and which rules broke."""
    found = build.dispatched_table(ntriples.parse(lines(t)))
    old, new = build.from_dispatched(found, colloc_text="pair", unit_features=()), build.from_dispatched(found)
    old, new = (build.Graph(staged(g.nodes, "nodes"), staged(g.edges, "edges")) for g in (old, new))  # each is read by several rules
    rules = store.text_rules(old, new).unionByName(store.edge_rules(old, new))
    return rules.filter("check not in ('unanchored names', 'forms alike')")


@query(f"""
WITH {_SL}, c AS (SELECT key, text, unnest([lo, hi]) AS sense FROM mi WHERE kind = 5),
l AS (SELECT key, unnest(regexp_extract_all(lower(substr(c.text, 13)), '\\p{{L}}+')) AS x, regexp_extract(an.text, '^iztočnica: (.*?)( \\(.*\\))?$', 1) AS lemma
    FROM c JOIN sen USING (sense) JOIN an ON an.code = sen.lu),
y AS (SELECT key, x, unnest(regexp_extract_all(lower(lemma), '\\p{{L}}+')) AS y FROM l)
SELECT c.key, coalesce(bool_or(starts_with(y, left(x, 4)) OR starts_with(x, left(y, 4))), false) AS anchored FROM c LEFT JOIN y USING (key) GROUP BY c.key
""")
def collocation_anchors(t):
    """Whether each collocation's name shares a stem with the headword of one of its members."""
    return store.anchored(graph(t))


@query(f"""
WITH {_SL}, g AS (
    SELECT lu AS src, form AS dst, 'other' AS rel FROM oth UNION ALL SELECT lu, sense, 'sense' FROM sen
    UNION ALL SELECT {_c(10, 's_suppkey')}, {_c(6, 's_suppkey')}, 'sense' FROM supplier UNION ALL SELECT sense, example, 'usage' FROM use
    UNION ALL SELECT mwe, word, 'constituent' FROM mw UNION ALL SELECT form, sense, 'translation' FROM tra
    UNION ALL SELECT DISTINCT {_c(5, 'sn')}, {_c(5, 'l_suppkey * 100 + l_linenumber')}, CASE l_returnflag WHEN 'R' THEN 'syn' ELSE 'ant' END FROM it WHERE l_returnflag <> 'N'
    UNION ALL SELECT {_c(1, f'o_orderkey + {ENTRY}')}, {_c(1, 'o_custkey')}, 'head' FROM orders)
SELECT src, dst, rel FROM g
""")
def second_generation_graph(t):
    """The directed, labelled graph of the second generation, heads and both directions of translations among its relations."""
    return typed.second_generation(ntriples.parse(lines(t)))


@query(f"""
WITH {_SL}, n AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE 1 END AS told FROM no)
SELECT 3 AS generation, count_if(kind = 0 AND told = 1) AS seeds, count_if(kind = 0 AND told = 1 AND is_mwe) AS entries FROM n
UNION ALL SELECT 2, count_if(type_id = 1 AND told = 1), count_if(type_id = 1 AND told = 1 AND is_mwe) FROM n
UNION ALL SELECT 1, count_if(type_id = 1), count_if(type_id = 1 AND is_mwe) FROM n
""")
def seed_pools(t):
    """How many nodes each generation's rule lets be drawn."""
    nodes = staged(graph(t).nodes, "nodes")
    counts = [sizing.seed_pool(nodes, g).agg(F.count("*").alias("seeds"), F.count_if("is_mwe").alias("entries")).withColumn("generation", F.lit(g)) for g in (3, 2, 1)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])

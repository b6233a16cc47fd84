"""Registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, langid, lm, mixing, near_dup, packing, quality, simhash, toolcalls, wrapper
from .common import crc_rest, materialize, table, worker_path

QUERIES: dict = {}
ORACLES: dict = {}


def _query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        worker_path(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality rules over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_chars", "kept")
    return quality.assess(docs).select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in names))



def _quality_sql(rules: quality.LineRules) -> str:
    """The line-first rules in DuckDB SQL; limits and phrases come from the operator's parameters."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    spoken = " OR ".join(f"contains(lower(l), {quoted(p)})" for p in quality.BOILERPLATE)
    space = r"[\x20\x09-\x0D]+"
    split = lambda x: f"list_filter(regexp_split_to_array({x}, '{space}'), lambda y: y <> '')"
    number = lambda pattern: f"(length(l) - length(regexp_replace(l, {quoted(pattern)}, '', 'g')))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {split('t')} AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, l, {split('l')} AS lw FROM (SELECT doc_id, unnest(ls) AS l FROM w)),
o AS (SELECT doc_id, sum(length(array_to_string(lw, ''))) AS n FROM l
    WHERE contains({quoted(quality.TERMINAL)}, right(rtrim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1))
    AND {number(quality.MARKS)} * 100 <= len(lw) * {rules.mark_percent}
    AND {number('[!?]')} * 100 <= len(lw) * {rules.exclaim_percent} + 100
    AND (length(l) < {rules.shout_min_chars} OR {number(chr(92) + 'p{Lu}')} * 100 <= length(l) * {rules.shout_percent})
    AND (len(lw) < {rules.repeat_min_words} OR len(list_distinct(lw)) * 100 >= len(lw) * {rules.distinct_percent})
    AND NOT (len(lw) <= {rules.notice_max_words} AND ({spoken}))
    AND NOT (len(regexp_split_to_array(l, {quoted(quality.NAV_SIGNS)})) >= {quality.NAV_ENTRIES}
        AND len(lw) <= len(regexp_split_to_array(l, {quoted(quality.NAV_SIGNS)})) * {rules.nav_entry_words + 1}) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, coalesce(o.n, 0)::BIGINT AS left_chars
    FROM w LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id))
SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
    NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)
    AND left_chars * 100 >= word_chars * {100 - rules.max_loss_percent} AS kept FROM m
"""


ORACLES["op10_quality_rules"] = _quality_sql(quality.LineRules())

@_query
def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, and the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, "doc_id", "text", path, public_tokenizers.PATTERN)


@_query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on 4-word shingles at 80 percent."""
    return near_dup.classes(table(spark, sf_dir, "documents"), width=4, percent=80)


ORACLES["op3_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
s AS (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END) AS sh
    FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
    SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b
    WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(any_value(c.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id,
       d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""


@_query
def op9_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; n_near and near answer the ids divisible by 100."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = simhash.with_next(docs, "doc_id", "text", ["text", "fp"], lambda rows: simhash.with_fingerprint(rows, "text", "fp"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    both = simhash.with_fingerprint(
        paired.select("doc_id", "fp", "next_fp", n.cast("long").alias("n_chars"), edited.alias("edited")), "edited", "edited_fp"
    )
    narrow = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "edited_fp", "next_fp")
    done = materialize(narrow, "fingerprints")
    near = simhash.search(done, done.filter("doc_id % 100 = 0"), "doc_id")
    asked = done.filter("doc_id % 100 = 0").join(near, "fp").select(done.columns + ["n_near", "near"])
    rest = done.filter("doc_id % 100 <> 0 or doc_id is null").withColumn("n_near", F.lit(None).cast("long"))
    rest = rest.withColumn("near", F.lit(None).cast(near.schema["near"].dataType))
    return asked.union(rest).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.as_hex(F.col("fp")).alias("fingerprint"),
        simhash.as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        simhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
        "near",
    )


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_rest(F.col("doc_id"), 3) == 1
    return langid.identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op4_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents by source weights 5, 2, 1, in training order."""
    placed = mixing.assign(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.size("placements").alias("passes"),
        F.get("placements", F.lit(0))["position"].alias("position"),
    ).orderBy("position", "doc_id")


@_query
def op5_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of all documents, learned from those whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_rest(F.col("doc_id"), 7) == 2
    scored = lm.score(docs, ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.withColumn("held_out", held_out)


@_query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by the wrappers of their hosts."""
    return wrapper.extract(table(spark, sf_dir, "pages"))


@_query
def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' byte-level BPE ids packed into rows of 2,048."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return packing.pack(table(spark, sf_dir, "documents"), bpe.fast_ids(path, pattern))


@_query
def op2_tool_call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical call records of all conversations."""
    calls, results = toolcalls.from_turns(table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, toolcalls.TOOLS)


ORACLES["op2_tool_call_records"] = r"""
WITH RECURSIVE u AS (
    SELECT *, conv_id || ':' || turn AS call_id, length(text) AS n, coalesce(to_json(text), 'null') AS j,
        CASE WHEN length(text) % 5 = 1 THEN 'chat.search' WHEN length(text) % 5 = 2 THEN 'chat.note'
            WHEN length(text) % 25 = 3 THEN 'chat.lost' ELSE 'chat.reply' END AS name
    FROM conversations WHERE role = 'user'),
f AS (
    SELECT conv_id, call_id, conv_id || ':' || (turn - 2) AS ref FROM u WHERE turn >= 2
    UNION ALL SELECT conv_id, call_id, conv_id || ':' || (turn + 2) FROM u WHERE n % 11 = 0),
k AS (SELECT DISTINCT call_id FROM u),
e AS (SELECT DISTINCT f.call_id AS a, f.ref AS b FROM f JOIN k ON k.call_id = f.ref),
g AS (SELECT f.call_id, count(*) AS n FROM f LEFT JOIN k ON k.call_id = f.ref WHERE k.call_id IS NULL GROUP BY 1),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
o AS (SELECT a FROM r WHERE a = b),
c AS (SELECT a AS call_id FROM o UNION SELECT r.a FROM r JOIN o ON o.a = r.b),
p AS (
    SELECT call_id, 0 AS level FROM k WHERE call_id NOT IN (SELECT call_id FROM c)
    UNION SELECT e.a, p.level + 1 FROM p JOIN e ON e.b = p.call_id WHERE e.a NOT IN (SELECT call_id FROM c)),
l AS (SELECT call_id, max(level) AS level FROM p GROUP BY 1),
a AS (
    SELECT conv_id || ':' || (turn - 1) AS call_id, arg_min(text, (turn, text)) AS content, count(*) AS n
    FROM conversations WHERE role = 'assistant' GROUP BY 1),
x AS (
    SELECT u.conv_id, u.turn, u.call_id, u.name, l.level, coalesce(g.n, 0) AS dangling, a.n AS found, a.content,
        list_sort(list_filter(CASE name
            WHEN 'chat.search' THEN [CASE WHEN u.n % 2 = 0 THEN 'type:limit' END, CASE WHEN u.n % 2 = 0 THEN 'type:exact' END]
            WHEN 'chat.note' THEN ['unknown:odd'] WHEN 'chat.lost' THEN ['tool']
            ELSE [CASE WHEN text IS NULL THEN 'missing:prompt' END] END, lambda y: y IS NOT NULL))
            || CASE WHEN l.level IS NULL THEN ['cycle'] ELSE [] END AS errors,
        CASE name
            WHEN 'chat.search' THEN CASE WHEN u.n % 2 = 0 THEN '"exact":"yes","limit":"10","query":' || j ELSE '"limit":10,"query":' || j END
            WHEN 'chat.note' THEN '"body":{"at":' || u.turn || ',"list":[1,2],"text":' || j || '},"odd":1'
            ELSE CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || j || ',' END || '"turn":' || u.turn END AS arguments
    FROM u LEFT JOIN l ON l.call_id = u.call_id LEFT JOIN g ON g.call_id = u.call_id LEFT JOIN a ON a.call_id = u.call_id)
SELECT conv_id, turn, call_id, name, level, dangling, found IS NOT NULL AS linked, coalesce(found, 0) AS n_results, len(errors) = 0 AS valid,
    array_to_string(errors, ',') AS errors,
    '{"arguments":{' || arguments || '},"id":' || to_json(call_id) || ',"name":"' || name || '","result":' || coalesce(to_json(content), 'null') || '}' AS record
FROM x
"""

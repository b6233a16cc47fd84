"""Triples -> untyped graph with self-describing node texts, as one lazy plan.

Natural keys replace dense ids: 'c:<code>' for named nodes, '<kind>:<lo>:<hi>' for minted ones. Wherever several values
compete, the least wins, so no result depends on the order in which files arrive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, vocab
from ..plans.staging import staged
from ..sources import ntriples


@dataclass
class Graph:
    """nodes(key, code, type_id, kind, is_mwe, text, token_len), edges(src, dst, rel), and named intermediate tables."""

    nodes: DataFrame
    edges: DataFrame
    parts: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def half_edges(self) -> DataFrame:
        return self.parts.get("half_edges", half_edges(self.edges))


def half_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions of every edge; repeated edges and self-loops keep their multiplicity. The edges are read once."""
    a, b = F.col(src), F.col(dst)
    both = F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst")))
    return edges.select(F.explode(both).alias("e")).select("e.src", "e.dst")


def unordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (lo, hi) without self-loops."""
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def contract(constituents: DataFrame, corresponds: DataFrame) -> DataFrame:
    """(mwe, word) from (mwe, part) and (part, word): each part stands for its least word; distinct edges."""
    words = corresponds.groupBy("part").agg(F.min("word").alias("word"))
    return constituents.join(words, "part").select("mwe", "word").distinct()


def ordinals(owned: DataFrame, owner: str, item: str) -> DataFrame:
    """(item, ordinal) of items whose owner has several: place by item within the owner, of the least owner."""
    w = Window.partitionBy(owner)
    numbered = owned.select(owner, item).distinct().select(
        owner, item, F.row_number().over(w.orderBy(item)).alias("ordinal"), F.count("*").over(w).alias("siblings")
    )
    return numbered.filter("siblings > 1").groupBy(item).agg(F.min_by("ordinal", owner).alias("ordinal"))


def best_spelling(forms: DataFrame, key: str, text: str) -> DataFrame:
    """One text per key: fewest capitals, then least; and how many other spellings there are."""
    ranked = forms.groupBy(key).agg(
        F.min(F.struct(scalar.uppercase(F.col(text)).alias("n"), F.col(text).alias("t"))).alias("best"),
        (F.count_distinct(text) - 1).alias("others"),
    )
    return ranked.select(key, F.col("best.t").alias(text), "others")


def binary_member_sets(members: DataFrame) -> DataFrame:
    """(lo, hi, owner) of owners with exactly two distinct members; of owners with equal sets the least."""
    pairs = members.select("owner", "member").distinct().groupBy("owner").agg(
        F.count("*").alias("n"), F.min("member").alias("lo"), F.max("member").alias("hi")
    )
    return pairs.filter("n = 2").groupBy("lo", "hi").agg(F.min("owner").alias("owner"))


def member_histogram(members: DataFrame) -> DataFrame:
    sizes = members.select("owner", "member").distinct().groupBy("owner").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("owners"))


def real_key(code: Column) -> Column:
    return F.concat(F.lit("c:"), code.cast("string"))


def _features(found: DataFrame, role: str, props: Sequence[str], types: Sequence[int]) -> DataFrame:
    """One row per code with a column for every property; the least value of repeated ones."""
    rows = found.filter((F.col("role") == role) & scalar.type_of(F.col("sc")).isin(*types)).withColumn("value", scalar.local_name(F.col("o")))
    cells = [F.min(F.when(F.col("key") == p, F.col("value"))).alias(p) for p in props]
    grouped = rows.groupBy(F.col("sc").alias("code"))
    return grouped.agg(*cells) if cells else rows.select(F.col("sc").alias("code")).distinct()


def translations_out(edges: DataFrame, lu: str) -> DataFrame:
    """Edges whose lexical unit is not the entry of a translation; such chains are collapsed to form and sense."""
    return edges.filter(scalar.type_of(F.col(lu)) != vocab.TYPES["lexical-entry-translation"])


def literals(found: DataFrame) -> dict[str, DataFrame]:
    """written, definition, value in Slovene, (code, ...) with one text each, and foreign (code, f: lang and lit)."""

    def of(key: str) -> DataFrame:
        return found.filter((F.col("role") == "literal") & (F.col("key") == key)).select(F.col("sc").alias("code"), "lit", "tail", "lang")

    slovene = scalar.is_slovene(F.col("tail"))
    spelled = of("written").filter(slovene).select("code", F.col("lit").alias("text"))
    return {
        "written": best_spelling(spelled, "code", "text"),
        "foreign": of("written").filter(~slovene).groupBy("code").agg(F.min(F.struct("lang", "lit")).alias("f")),
        "definition": of("definition").filter(slovene).groupBy("code").agg(F.min("lit").alias("definition")),
        "value": of("value").filter(slovene).groupBy("code").agg(F.min("lit").alias("value")),
    }


def anchor_texts(
    canon_of: DataFrame, other: DataFrame, text_of: DataFrame, features: DataFrame, pos: DataFrame, units: DataFrame, unit_features: Sequence[str]
) -> DataFrame:
    """(code, kind, text) of lexical units: the canonical form, else the least inflected form with text, and features.

    canon_of(lu, form), other(lu, form), text_of(form, text), features(form, ...), pos(code, pos), units(code, ...).
    """
    first_inflected = other.join(text_of, "form", "left_semi").groupBy("lu").agg(F.min("form").alias("inflected"))
    shown = (
        canon_of.join(text_of.select("form"), "form", "left_semi")
        .join(first_inflected, "lu", "full")
        .select("lu", F.coalesce("form", "inflected").alias("form"))
    )
    labels = scalar.feature_text(F.col("pos"), {p: F.col(p) for p in unit_features}, {p: F.col(p) for p in vocab.FEATURES})
    return (
        shown.join(text_of, "form")
        .join(features, "form", "left")
        .join(pos.withColumnRenamed("code", "lu"), "lu", "left")
        .join(units.withColumnRenamed("code", "lu"), "lu", "left")
        .select(
            F.col("lu").alias("code"),
            F.lit(vocab.ANCHOR).alias("kind"),
            F.concat(F.lit(vocab.TAGS[vocab.ANCHOR]), "text", labels).alias("text"),
        )
    )


def form_texts(other: DataFrame, text_of: DataFrame, features: DataFrame) -> DataFrame:
    """(code, kind, text) of inflected forms with a text."""
    labels = scalar.feature_text(F.lit(None).cast("string"), {}, {p: F.col(p) for p in vocab.FEATURES})
    return other.select("form").distinct().join(text_of, "form").join(features, "form", "left").select(
        F.col("form").alias("code"), F.lit(vocab.FORM).alias("kind"), F.concat(F.lit(vocab.TAGS[vocab.FORM]), "text", labels).alias("text")
    )


def first_examples(usage: DataFrame, value: DataFrame) -> DataFrame:
    """(sense, example, example_text): of the examples with a text the least. usage(sense, example), value(code, value)."""
    texts = value.select(F.col("code").alias("example"), F.col("value"))
    first = usage.join(texts, "example").groupBy("sense").agg(F.min(F.struct("example", "value")).alias("e"))
    return first.select("sense", F.col("e.example").alias("example"), F.col("e.value").alias("example_text"))


def sense_texts(sense_lemma: DataFrame, definition: DataFrame, examples: DataFrame, numbered: DataFrame, snippet_chars: int = 60) -> DataFrame:
    """(code, kind, text): the definition, else the lemma with a short example; the ordinal where there is one.

    sense_lemma(sense, lemma), definition(code, definition), examples(sense, example_text), numbered(sense, ordinal).
    Senses with neither definition nor lemma are left out.
    """
    return (
        sense_lemma.join(definition.withColumnRenamed("code", "sense"), "sense", "left")
        .join(examples.select("sense", "example_text"), "sense", "left")
        .join(numbered, "sense", "left")
        .filter(has_sense_text())
        .select(F.col("sense").alias("code"), F.lit(vocab.SENSE).alias("kind"), sense_text(snippet_chars).alias("text"))
    )


def has_sense_text() -> Column:
    return (F.coalesce("definition", F.lit("")) != "") | (F.coalesce("lemma", F.lit("")) != "")


def sense_text(snippet_chars: int = 60) -> Column:
    """The text of a row (definition, lemma, example_text, ordinal)."""
    short = scalar.snippet(F.coalesce("example_text", F.lit("")), snippet_chars)
    body = F.when(F.coalesce("definition", F.lit("")) != "", F.col("definition")).otherwise(
        F.concat("lemma", F.when(short != "", F.concat(F.lit(" (zgled: "), short, F.lit(")"))).otherwise(""))
    )
    tag = F.coalesce(F.concat(F.lit("pomen "), F.col("ordinal").cast("string"), F.lit(": ")), F.lit(vocab.TAGS[vocab.SENSE]))
    return F.concat(tag, body)


def _pairs(df: DataFrame, kind: int, joiner: str) -> DataFrame:
    return df.select("lo", "hi", "phrase", F.lit(kind).alias("kind"), F.lit(joiner).alias("joiner"))


def minted(synonyms: DataFrame, antonyms: DataFrame, collocations: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(key, kind, lo, hi, text) of the nodes that stand for pairs whose two members are among lemmas(sense, lemma).

    synonyms and antonyms have ends (a, b); collocations(lo, hi, phrase).
    """
    left = lemmas.select(F.col("sense").alias("lo"), F.col("lemma").alias("la"))
    right = lemmas.select(F.col("sense").alias("hi"), F.col("lemma").alias("lb"))
    plain = F.lit(None).cast("string")
    pairs = (
        _pairs(unordered_pairs(synonyms, "a", "b").withColumn("phrase", plain), vocab.SYNONYM, "~")
        .unionByName(_pairs(unordered_pairs(antonyms, "a", "b").withColumn("phrase", plain), vocab.ANTONYM, "~"))
        .unionByName(_pairs(collocations, vocab.COLLOCATION, "+"))
    )
    tags = F.create_map(*[x for k in (vocab.SYNONYM, vocab.ANTONYM, vocab.COLLOCATION) for x in (F.lit(k), F.lit(vocab.TAGS[k]))])
    text = F.concat(F.element_at(tags, F.col("kind")), F.coalesce("phrase", F.concat_ws(" ", "la", "joiner", "lb")))
    return pairs.join(left, "lo").join(right, "hi").select(F.concat_ws(":", "kind", "lo", "hi").alias("key"), "kind", "lo", "hi", text.alias("text"))


def minted_ends(pairs: DataFrame) -> DataFrame:
    """(src, end, rel): two edges of every minted node."""
    return pairs.select(F.col("key").alias("src"), F.explode(F.array("lo", "hi")).alias("end"), F.col("kind").cast("string").alias("rel"))


def named_by_owner(pairs: DataFrame, sense_lemma: DataFrame) -> DataFrame:
    """pairs(lo, hi, owner) with `phrase`: the lemma of the sense that the owner's code names, if it names one."""
    number = F.shiftright("owner", vocab.HALF_BITS).bitwiseAND(F.lit((1 << vocab.HALF_BITS) - 1))
    sense = F.when(scalar.type_of(F.col("owner")) == vocab.T_COLLOCATION, number.bitwiseOR(F.lit(vocab.TYPES["sense"] << vocab.TYPE_SHIFT)))
    phrases = sense_lemma.select(F.col("sense").alias("named"), F.nullif("lemma", F.lit("")).alias("phrase"))
    return pairs.withColumn("named", sense).join(phrases, "named", "left").select("lo", "hi", "owner", "phrase")


def coverage(features: DataFrame, props: Sequence[str]) -> DataFrame:
    """(prop, codes): how many codes carry each property."""
    return features.unpivot(features.columns[0], list(props), "prop", "value").filter("value is not null").groupBy("prop").agg(F.count("*").alias("codes"))


def textless(nodes: DataFrame, kind: str = "type_id") -> DataFrame:
    """(kind, textless, n)."""
    return nodes.groupBy(kind).agg(F.count_if(F.coalesce("text", F.lit("")) == "").alias("textless"), F.count("*").alias("n"))


def token_budget(nodes: DataFrame, kind: str = "kind") -> DataFrame:
    """(kind, nodes, tokens, share, mean) of nodes(kind, token_len); the window has one row a kind."""
    counted = nodes.groupBy(kind).agg(F.count("*").alias("nodes"), F.sum("token_len").alias("tokens"), F.avg("token_len").alias("mean"))
    return counted.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))


def with_token_lengths(nodes: DataFrame, tokens, text: str = "text", distinct: bool = False) -> DataFrame:
    """nodes with token_len; `distinct` measures every different text once and joins the lengths back."""
    if not distinct:
        return nodes.withColumn("token_len", tokens(F.col(text)))
    lengths = nodes.select(F.col(text).alias("__t")).distinct().withColumn("token_len", tokens(F.col("__t")))
    return nodes.join(lengths, nodes[text] == lengths["__t"], "left").drop("__t")


def dispatched_table(triples: DataFrame, hosts: Sequence[str] = vocab.HOSTS, keys: Sequence[str] | None = None) -> DataFrame:
    """Dispatched triples (of `keys` only, if given), written once by role and key, so each relation reads its own
    partitions only. Edges are two codes; names stay where a value is read from them.

    Rows are first gathered by role, key and a salt, so the number of files does not grow with the number of tasks.
    """
    found = ntriples.dispatched(triples, hosts, keys)
    spark = found.sparkSession
    slim = found.select("sc", "oc", F.when(~F.col("role").isin("edge", "literal"), F.col("o")).alias("o"), "lit", "tail", "lang", "role", "key")
    salt = F.pmod(F.xxhash64("sc"), F.lit(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)))
    return staged(slim.repartition("role", "key", salt), "triples", ("role", "key"))


def relations(found: DataFrame, unit_features: Sequence[str] = vocab.UNIT_FEATURES) -> dict[str, DataFrame]:
    """The relations of dispatched triples by name. Nothing is written or read until one is used."""

    def edge(key: str, a: str, b: str) -> DataFrame:
        return found.filter((F.col("role") == "edge") & (F.col("key") == key) & F.col("oc").isNotNull()).select(
            F.col("sc").alias(a), F.col("oc").alias(b)
        )

    texts = literals(found)
    canon, sense = translations_out(edge("canon", "lu", "form"), "lu"), translations_out(edge("sense", "lu", "sense"), "lu")
    usage = edge("usage", "sense", "example")
    return texts | {
        "canon": canon,
        "canon_of": canon.groupBy("lu").agg(F.min("form").alias("form")),
        "sense": sense,
        "other": edge("other", "lu", "form"),
        "usage": usage,
        "translated": edge("tsrc", "form", "sense"),
        "members": edge("member", "owner", "member"),
        "synonyms": edge("syn", "a", "b"),
        "antonyms": edge("ant", "a", "b"),
        "mwe": contract(edge("constit", "mwe", "part"), edge("corr", "part", "word")),
        "features": _features(found, "feature", vocab.FEATURES, (vocab.TYPES["word-form"], vocab.TYPES["form-lexical-unit"])),
        "units": _features(found, "unit", unit_features, (vocab.TYPES["lexical-unit"],)),
        "pos": found.filter("role = 'pos'").groupBy(F.col("sc").alias("code")).agg(F.min(scalar.local_name(F.col("o"))).alias("pos")),
        "examples": first_examples(usage, texts["value"]),
    }


def sense_lemmas(sense: DataFrame, canon_of: DataFrame, written: DataFrame) -> DataFrame:
    """(sense, lu, lemma): each sense's least owner and the written form of that owner's canonical form."""
    lemma = canon_of.join(written.select(F.col("code").alias("form"), "text"), "form").select("lu", F.col("text").alias("lemma"))
    return sense.groupBy("sense").agg(F.min("lu").alias("lu")).join(lemma, "lu", "left").select("sense", "lu", "lemma")


#: Keys of the triples that edges between named nodes come from, and of those that decide which pairs are minted.
REAL_KEYS = ("other", "sense", "usage", "constit", "corr", "tsrc")
EDGE_KEYS = (*REAL_KEYS, "canon", "written", "syn", "ant", "member")


def real_edges(parts: dict[str, DataFrame]) -> DataFrame:
    """(a, b, rel): edges between named nodes, from relations of REAL_KEYS."""

    def as_edges(name: str, a: str, b: str, rel: str) -> DataFrame:
        return parts[name].select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(rel).alias("rel"))

    return (
        as_edges("other", "lu", "form", "other")
        .unionAll(as_edges("sense", "lu", "sense", "sense"))
        .unionAll(as_edges("usage", "sense", "example", "usage"))
        .unionAll(as_edges("mwe", "mwe", "word", "constituent"))
        .unionAll(as_edges("translated", "form", "sense", "translation"))
    )


def build(
    triples: DataFrame,
    hosts: Sequence[str] = vocab.HOSTS,
    snippet_chars: int = 60,
    sense_index: bool = True,
    colloc_text: str = "phrase",
    unit_features: Sequence[str] = vocab.UNIT_FEATURES,
    tokens=scalar.token_proxy,
    distinct_tokens: bool = False,
) -> Graph:
    """The graph of parsed triples. `tokens` maps a text column to its length in tokens."""
    return from_dispatched(dispatched_table(triples, hosts), snippet_chars, sense_index, colloc_text, unit_features, tokens, distinct_tokens)


def from_dispatched(
    found: DataFrame,
    snippet_chars: int = 60,
    sense_index: bool = True,
    colloc_text: str = "phrase",
    unit_features: Sequence[str] = vocab.UNIT_FEATURES,
    tokens=scalar.token_proxy,
    distinct_tokens: bool = False,
) -> Graph:
    """The graph of a table of dispatched triples, which several builds may share."""
    parts = relations(found, unit_features)
    canon, canon_of, sense, other, usage, members, mwe = (parts[k] for k in ("canon", "canon_of", "sense", "other", "usage", "members", "mwe"))
    written = staged(parts["written"], "written")
    foreign, definition, value = (parts[k] for k in ("foreign", "definition", "value"))
    forms, units, pos = (parts[k] for k in ("features", "units", "pos"))

    text_of = written.select(F.col("code").alias("form"), "text")
    sense_lemma = staged(sense_lemmas(sense, canon_of, written), "sense-lemma")

    real = staged(real_edges(parts), "edges")
    universe = real.select(F.col("a").alias("code")).union(real.select("b")).union(canon.select("lu")).distinct()

    features = forms.withColumnRenamed("code", "form")
    anchors = anchor_texts(canon_of, other, text_of, features, pos, units, unit_features)
    examples = parts["examples"]
    numbered = ordinals(sense, "lu", "sense") if sense_index else sense.select("sense").limit(0).withColumn("ordinal", F.lit(0))
    senses = sense_texts(sense_lemma, definition, examples, numbered, snippet_chars)
    ranked = anchors.union(form_texts(other, text_of, features)).union(senses).groupBy("code").agg(F.min(F.struct("kind", "text")).alias("own"))
    some = lambda c: F.nullif(c, F.lit(""))
    type_id = scalar.type_of(F.col("code"))
    d, v, w = some(F.col("definition")), some(F.col("value")), some(F.col("text"))
    told = F.coalesce(scalar.mapped(F.col("f.lang"), vocab.LANGUAGE_LABELS), F.col("f.lang"))
    example_text = F.concat(F.lit(vocab.TAGS[vocab.EXAMPLE]), F.coalesce(v, d))
    translation = F.coalesce(
        F.concat(F.lit("prevod ("), told, F.lit("): "), F.col("f.lit")), F.concat(F.lit("prevod: "), w)
    )
    rest = (
        F.when(type_id == vocab.TYPES["example"], F.struct(F.lit(vocab.EXAMPLE).alias("kind"), example_text.alias("text")))
        .when(type_id == vocab.TYPES["translation-form"], F.struct(F.lit(vocab.TRANSLATION).alias("kind"), translation.alias("text")))
        .otherwise(F.struct(F.lit(vocab.OTHER).alias("kind"), F.coalesce(d, v, w).alias("text")))
    )
    mwes = mwe.select(F.col("mwe").alias("code")).distinct().withColumn("is_mwe", F.lit(True))
    named = universe
    for more in (ranked, definition, value, written.drop("others"), foreign, mwes):
        named = named.join(more, "code", "left")
    chosen = F.coalesce("own", rest)
    text = F.coalesce(chosen["text"], F.lit(""))
    named = named.select(
        real_key(F.col("code")).alias("key"),
        "code",
        type_id.alias("type_id"),
        F.when(text == "", vocab.OTHER).otherwise(chosen["kind"]).cast("byte").alias("kind"),
        F.coalesce("is_mwe", F.lit(False)).alias("is_mwe"),
        text.alias("text"),
    )

    # Minted nodes: both members must be nodes, which every sense with an owner is, and have a lemma.
    lemmas = sense_lemma.filter(F.coalesce("lemma", F.lit("")) != "")
    collocations = binary_member_sets(members)
    if colloc_text == "phrase":
        collocations = named_by_owner(collocations, sense_lemma)
    else:
        collocations = collocations.withColumn("phrase", F.lit(None).cast("string"))
    pairs = minted(parts["synonyms"], parts["antonyms"], collocations, lemmas)
    minted_nodes = pairs.select(
        "key", F.lit(None).cast("long").alias("code"), F.lit(-1).alias("type_id"), F.col("kind").cast("byte").alias("kind"), F.lit(False).alias("is_mwe"), "text"
    )
    nodes = with_token_lengths(named.unionByName(minted_nodes), tokens, distinct=distinct_tokens)
    edges = real.select(real_key(F.col("a")).alias("src"), real_key(F.col("b")).alias("dst"), "rel").unionByName(
        minted_ends(pairs).select("src", real_key(F.col("end")).alias("dst"), "rel")
    )
    parts = {
        "real": real, "mwe": mwe, "sense_lemma": sense_lemma, "members": members, "written": written, "features": forms, "units": units, "canon_of": canon_of, "other": other,
        "definition": definition, "pos": pos, "sense": sense, "usage": usage, "value": value, "found": found, "examples": examples, "numbered": numbered,
    }
    return Graph(nodes, edges, parts)

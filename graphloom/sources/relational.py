"""The driver's tables read as lexical relations: parts are words, orders are multi-word entries made of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import build

#: Added to order keys so that they differ from part keys.
ORDERS = 10_000_000_000
HOST = vocab.HOSTS[0]


def connectors(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mwe, part) and (part, word): a line of an order is the connector to the least of the parts it names."""
    connector = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return (
        lineitem.select(F.col("l_orderkey").alias("mwe"), connector.alias("part")),
        lineitem.select(connector.alias("part"), F.col("l_partkey").alias("word")),
    )


def constituents(lineitem: DataFrame) -> DataFrame:
    """Edges (src, dst) from orders to the parts that their lines stand for."""
    edges = build.contract(*connectors(lineitem))
    return edges.select((F.col("mwe") + ORDERS).alias("src"), F.col("word").alias("dst"))


def iri(stem: str, number: Column) -> Column:
    return F.concat(F.lit(f"<{HOST}{stem}-"), number.cast("string"), F.lit(">"))


def line(s: Column, predicate: str, o: Column) -> Column:
    return F.concat(s, F.lit(f" <{predicate}> "), o, F.lit(" ."))


def escaped(text: Column) -> Column:
    """A text as it is written inside quotes; quotes as code points, so that none can be taken for the closing ones."""
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', "\\u0022")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def literal(text: Column, lang) -> Column:
    tag = F.lit(lang) if isinstance(lang, str) else lang
    return F.concat(F.lit('"""'), escaped(text), F.lit('"""@'), tag)


def rendered(part: DataFrame, orders: DataFrame, lineitem: DataFrame, documents: DataFrame) -> DataFrame:
    """The tables as N-Triples lines (value): names, categories, constituents and languages."""
    k = F.col("p_partkey")
    connector = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    rows = [
        part.select(line(iri("word-form", k), vocab.ONTOLEX + "writtenRep", literal(F.col("p_name"), "sl")).alias("value")),
        part.select(line(iri("lexical-unit", k), vocab.ONTOLEX + "canonicalForm", iri("word-form", k)).alias("value")),
        part.select(line(iri("lexical-unit", k), vocab.RDF + "type", iri("resource", F.col("p_size"))).alias("value")),
        orders.select(line(iri("sense", F.col("o_orderkey")), vocab.SKOS + "definition", literal(F.col("o_orderpriority"), "sl")).alias("value")),
        lineitem.select(line(iri("lexical-unit", F.col("l_orderkey") + ORDERS), vocab.DECOMP + "constituent", iri("lexical-unit-part", connector)).alias("value")),
        documents.select(
            line(iri("example", F.col("doc_id")), vocab.RDF + "value", literal(F.col("text"), F.col("lang"))).alias("value")
        ),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionAll(more)
    return out

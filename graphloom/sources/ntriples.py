"""N-Triples sources: one row per well-formed triple, from text files or any DataFrame of lines."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, vocab

SCHEMA = "s string, p string, o string, is_iri boolean, lit string, tail string, lang string"


def files_of(spark: SparkSession, folder: str, recursive: bool = False) -> list[str]:
    """Paths of folder/*.nt in name order, listed by the file system that holds them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, out = files.listFiles(where, recursive), []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().endswith(".nt"):
            out.append(path.toString())
    return sorted(out)


def read_lines(spark: SparkSession, folder: str, files_limit: int | None = None, recursive: bool = False) -> DataFrame:
    """Lines of folder/*.nt with their file; files_limit keeps the first files in name order.

    Bytes that are not UTF-8 become replacement characters. A folder or file that cannot be read is an error, whatever
    the session tolerates elsewhere; a folder without such files has no lines.
    """
    reader = spark.read.option("ignoreMissingFiles", "false").option("ignoreCorruptFiles", "false")
    if files_limit is None:
        lines = reader.option("pathGlobFilter", "*.nt").option("recursiveFileLookup", str(recursive).lower()).text(folder)
    else:
        chosen = files_of(spark, folder, recursive)[:files_limit]
        lines = reader.text(chosen) if chosen else reader.option("pathGlobFilter", "*.nt").text(folder).limit(0)
    return lines.select(F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("file"))


def _find(what: str, text: Column, start: Column) -> Column:
    """Place of the first `what` from `start` on, 0 without one."""
    return F.call_function("locate", F.lit(what), text, start)


def once(value: Column) -> Column:
    """A value that later steps read many times and filters test: the partition id keeps it from being written out again
    in each of them, and filters on it from moving below it."""
    return F.when(F.spark_partition_id() >= 0, value)


def _literal_end(o: Column) -> Column:
    """Where the closing quotes begin; 0 or null without them."""
    return F.when(o.startswith('"""'), _find('"""', o, F.lit(4))).when(o.startswith('"'), _find('"', o, F.lit(2)))


def literal_parts(o: Column, end: Column | None = None) -> tuple[Column, Column]:
    """Content and tail of a literal: triple quotes end at the first three quotes, plain ones at the first; else null.

    This is the source's own, lenient reading: an escaped quote just before the closing quotes is cut.
    """
    end = _literal_end(o) if end is None else end
    width = F.when(o.startswith('"""'), 3).otherwise(1)
    return F.when(end > 0, F.substr(o, width + 1, end - width - 1)), F.when(end > 0, F.substr(o, end + width))


def _until(what: str, text: str) -> Column:
    """What precedes the first `what`; the whole text without one."""
    return once(F.substring_index(text, what, 1))


def _from(text: str, place: Column | int) -> Column:
    """The text from a place on, which is counted in bytes and begins a character."""
    return F.substring(F.col(text).cast("binary"), place, 1 << 30).cast("string")


def parse(lines: DataFrame, column: str = "value", predicates: Collection[str] | None = None) -> DataFrame:
    """Triples of well-formed lines; malformed lines and unterminated literals are dropped.

    A line is cut at the first '> <' and the first '> ' after it, by bytes: nothing counts the characters of a name.
    With `predicates`, triples of those only: every line is read up to its predicate, objects of others are not looked at.
    """
    line, raw, size = F.col(column), F.col("raw"), F.octet_length
    found = lines.filter(line.startswith("<")).select(line.alias("line")).withColumn("head", _until("> <", "line"))
    cut = found.filter(size("head") < size("line")).select("head", once(_from("line", size("head") + 4)).alias("rest")).withColumn("p", _until("> ", "rest"))
    cut = cut.filter(size("p") < size("rest"))
    if predicates is not None:
        cut = cut.filter(F.col("p").isin(*predicates))
    split = cut.select(_from("head", 2).alias("s"), "p", once(_from("rest", size("p") + 3)).alias("raw"))
    ended = split.select("s", "p", "raw", once(raw.startswith("<")).alias("is_iri"), once(F.coalesce(_literal_end(raw), F.lit(0))).alias("end"))
    is_iri = F.col("is_iri")
    content, tail = literal_parts(raw, F.col("end"))
    typed = ended.filter(is_iri | (F.col("end") > 0)).select(
        "s",
        "p",
        "raw",
        once(F.when(is_iri, F.substring_index(raw, ">", 1))).alias("opened"),
        "is_iri",
        once(F.when(~is_iri, content)).alias("lit"),
        once(F.when(~is_iri, tail)).alias("tail"),
    )
    name = F.when(is_iri, F.when(size("opened") < size("raw"), _from("opened", 2)).otherwise(""))
    typed = typed.select("s", "p", once(name).alias("o"), "is_iri", once(scalar.unescape(F.col("lit"))).alias("lit"), "tail")
    return typed.withColumn("lang", scalar.language(F.col("tail")))


def dispatched(triples: DataFrame, hosts: Sequence[str] = vocab.HOSTS, keys: Sequence[str] | None = None) -> DataFrame:
    """Triples of known predicates with role and key, and the codes of subject and object; the rest is dropped.

    With `keys`, those predicates only. The predicate tables are literal maps, so the filter runs inside the scan's stage.
    """
    chosen = {name: found for name, found in vocab.PREDICATES.items() if keys is None or found[1] in keys}

    def told(place: int) -> Column:
        return scalar.mapped(F.col("p"), {name: found[place] for name, found in chosen.items()})

    return (
        triples.filter(F.col("p").isin(*chosen))
        .withColumns({"role": told(0), "key": told(1)})
        .withColumns({"sp": once(scalar.host_path(F.col("s"), hosts)), "op": once(scalar.host_path(F.col("o"), hosts))})
        .filter(F.col("sp").isNotNull())
        .withColumns({f"{c}d": once(F.substring_index(f"{c}p", "-", -1)) for c in "so"})
        .withColumns({f"{c}n": once(F.col(f"{c}d").try_cast("long")) for c in "so"})
        .withColumns({f"{c}c": once(scalar.path_code(F.col(f"{c}p"), F.col(f"{c}d"), F.col(f"{c}n"))) for c in "so"})
        .drop(*[c + part for c in "so" for part in "pdn"])
    )


def predicates_of(keys: Sequence[str]) -> list[str]:
    """The predicates that have these keys, for `parse`."""
    return [name for name, (_, key) in vocab.PREDICATES.items() if key in keys]


def raw_split(lines: DataFrame, column: str = "value") -> DataFrame:
    """Subject, predicate and object tokens of raw lines, split at the first two spaces, without the closing ' .'."""
    clean = F.regexp_replace(F.rtrim(F.col(column)), r" \.$", "")
    parts = F.split(clean, " ", 3)
    return lines.filter(F.size(parts) == 3).select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate("spo")])

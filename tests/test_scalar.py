import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import scalar, vocab
from graphloom.operators import typed
from graphloom.sources import ntriples

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def slow_snippet(s, limit=60):
    s = " ".join(s.split())
    if len(s) <= limit:
        return s
    cut = s[:limit].rfind(" ")
    return (s[:cut] if cut > limit // 2 else s[:limit]).rstrip(" ,;:.!?-") + " ..."


@FEW
@given(st.lists(st.text("abč ,.;-", max_size=90), min_size=4, max_size=12))
def test_snippet(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scalar.snippet(F.col("t"))).collect()] == [slow_snippet(t) for t in texts]


def test_unescape(spark):
    cases = {r"a\\b": "a\\b", r"ač": "ač", r"\q": r"\q", r"\"x\"": '"x"', r"\\n": "\\n", r"\U0001F600": "😀", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(scalar.unescape(F.col("t"))).collect()] == list(cases.values())


def test_literals(spark):
    cases = {
        '"""a"""@sl .': ("a", "@sl ."),
        '"single"@sl': ("single", "@sl"),
        '"""x': None,
        '""""""@sl': ("", "@sl"),
        '"""x\\""""@sl': ("x\\", '"@sl'),
        '"""v"""@sl-SI-fonipa': ("v", "@sl-SI-fonipa"),
    }
    content, tail = ntriples.literal_parts(F.col("o"))
    df = spark.createDataFrame([(k,) for k in cases], "o string").select(content.alias("c"), tail.alias("t"))
    assert [None if r["c"] is None else (r["c"], r["t"]) for r in df.collect()] == list(cases.values())


@FEW
@given(st.integers(0, 2**56 - 1), st.sampled_from(sorted(vocab.TYPES)))
def test_codes_unpack(spark, number, stem):
    code = scalar.node_code(F.lit(f"{vocab.HOSTS[1]}{stem}-{number}"))
    row = spark.range(1).select(scalar.type_of(code).alias("t"), scalar.payload(code).alias("n"))
    r = row.first()
    assert (r["t"], r["n"]) == (vocab.TYPES[stem], number) or number >= 10**16


def test_codes_of_odd_names(spark):
    names = ["dependent-sense-3-lexical-unit-4", f"dependent-sense-{2**28}-lexical-unit-4", "novel-7", "lexical-unit-", "x"]
    df = spark.createDataFrame([(vocab.HOSTS[0] + n,) for n in [*names, "../other"]] + [("http://elsewhere/lexical-unit-1",)], "i string")
    codes = [r[0] for r in df.select(scalar.node_code(F.col("i"))).collect()]
    assert codes[0] == (11 << 56) | (3 << 28) | 4 and codes[1] >> 56 == 11 and codes[1] != codes[0]
    assert all(c >> 56 == 12 for c in codes[2:6]) and codes[6] is None


@FEW
@given(st.lists(st.text("aA.ß é́č\t", max_size=12), min_size=3, max_size=8))
def test_normal(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [" ".join(unicodedata.normalize("NFC", t).split()).strip().rstrip(".").casefold() for t in texts]
    assert [r[0] for r in df.select(scalar.normal(F.col("t"))).collect()] == want


def test_small_functions(spark):
    assert [one(spark, scalar.counted_senses(F.lit(n))).split()[-1] for n in (1, 2, 3, 5, 101, 112)] == ["pomen", "pomena", "pomeni", "pomenov", "pomen", "pomenov"]
    assert [one(spark, scalar.band(F.lit(n))) for n in (0, 1, 4, 5, 16, 64, 256, 1024, 1025)] == [0, 1, 1, 2, 2, 3, 4, 5, 6]
    assert [one(spark, scalar.token_proxy(F.lit(t))) for t in ("", "abc", "abcdefgh")] == [0, 1, 2]
    words = "cesta čas riba sok šola zima žito".split()
    df = spark.createDataFrame([(w,) for w in reversed([*words, "øre"])], "w string")
    assert [r["w"] for r in df.orderBy(scalar.slovene_key(F.col("w"))).collect()] == [*words, "øre"]
    assert one(spark, scalar.is_subsequence(F.array(F.lit("a"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    assert not one(spark, scalar.is_subsequence(F.array(F.lit("c"), F.lit("a")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    assert [one(spark, scalar.tier(F.lit(t), F.lit(k), "čas")) for t, k in (("iztočnica: Čas (x)", 0), ("pomen: dober čas!", 2), ("pomen: časopis", 2))] == [0, 1, 2]
    assert one(spark, scalar.parse_answer(F.lit("uvod\nODGOVOR: A | b.\nkonec"), "|")) == ["a", "b"]
    assert one(spark, scalar.parse_answer(F.lit("brez"), "|")) is None


def test_codes_without_patterns_are_those_with(spark):
    """Names read the short way get the codes that the patterns give; the rows' code stays small enough to be compiled."""
    numbers = ["0", "7", "007", "+7", " 7", "7 ", "-7", "", "x", "7x", "9" * 16, "1" + "0" * 16, "9" * 17, "9" * 19, "٣", "7\n", str(1 << 28), str((1 << 28) - 1)]
    names = [f"{stem}-{n}" for stem in (*vocab.TYPES, "lexical", "", "-", "dependent-sense", "Sense") for n in numbers]
    names += [f"dependent-sense-{a}-lexical-unit-{b}" for a in numbers for b in numbers] + ["dependent-sense-1-lexical-unit-2-3", "dependent-sense-1-lexical-form-2", "sense", "7", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(1)
    rows = df.select("n", scalar.path_code(F.col("n")).alias("a"), F.when(F.col("n").isNotNull(), scalar._any_code(F.col("n"))).alias("b")).collect()
    assert len(rows) == len(names) and [r["n"] for r in rows if r["a"] != r["b"]] == []
    lines = spark.createDataFrame([(f"<{vocab.HOSTS[0]}sense-1> <{vocab.SKOS}definition> \"x\"@sl .",)], "value string").repartition(1)
    shown = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (ntriples.dispatched(ntriples.parse(lines)), typed.first_generation(ntriples.parse(lines)), typed.first_generation_texts(ntriples.parse(lines))):
            sizes = re.findall(r"maxMethodCodeSize:(-?\d+)", shown.codegenString(made._jdf.queryExecution().executedPlan()))
            assert sizes and all(0 < int(n) < 8000 for n in sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)

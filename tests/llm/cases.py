"""Documents with every awkward shape: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F

WORDS = "alfa beta gama delta epsilon zeta eta theta jota kapa lambda mi ni ksi omikron pi ro sigma tau ipsilon fi hi psi omega".split()


def prose(seed: int, n: int = 80) -> str:
    out = []
    for i in range(n):
        seed = (seed * 1103515245 + 12345) % 2**31
        out.append(WORDS[seed // 65536 % len(WORDS)] + ("." if i % 9 == 8 else ""))
    return " ".join(out) + "."


BASE = prose(1)
ROWS = [
    (1, BASE, "xx", "a", 1),
    (2, BASE, "xx", "a", 1),
    (2, BASE, "xx", "a", 1),
    (3, BASE.replace("alfa", "novo", 1), "xx", "b", 1),
    (4, None, None, None, None),
    (5, "", "xx", "a", 0),
    (6, " \t\n ", "xx", "a", 4),
    (7, "beseda", "yy", "b", 6),
    (None, prose(2), "xx", "a", 1),
    (8, prose(3, 30_000), "xx", None, 1),
    (9, "a" * 150_000, "yy", "b", 1),
    (10, "čšž 漢字 🙂\x0bx\x1cy z", "yy", "b", 1),
    (11, prose(4), None, "c", 1),
    (11, prose(5), None, "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("id", "key", "size", "score", "lang_pred", "quality", "text2", "n", "rows", "bucket", "fp", "word", "ids")


def documents(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns):
    return sorted(repr([r[c] for c in columns]) for r in df.collect())

"""Document likelihood under a subword lattice.

A word's probability sums all its segmentations: into pieces of an existing vocabulary (their scores start the
estimate; ROUNDS expectation steps over all distinct training words of a class fit them), and the arc that spells a word
seen in training whole, weighted by its discounted count. The document's probability marginalises, in log space, over
segmentations and over a document class (the training documents' language) whose word arcs back off to spellings and to
the words of all classes; words are independent given the class, so the forward recursion over a document is the product
of its words' marginals.
Every part is a probability distribution, so the score is a log10 probability of the text.

`vocabulary_score` is the marginal under the vocabulary's own scores alone, without anything learned: a lattice of its
pieces only.

Each distinct word is scored once for the whole table. Words of the HOT most frequent (a bounded broadcast) are summed
where the document is read; all others are joined to their scores by word.

Defined results: null and empty texts have one token, the end; without training documents the spelling alone scores and
an end costs log10(0.5); repeated rows are scored each; rows without a key count as key ''; of classes with equally many
documents the first by code point counts as more frequent; very long texts and words are read whole; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .lattice import Lattice, load_pieces, spelling_weights

HOT, HOT_CHARS, CLASSES, DISCOUNT, ROUNDS = 50_000, 64, 8, 0.75, 2
#: Share of a class's spelling mass that goes to the words of all classes.
COMMON = 0.1
#: Distinct words counted before a partial count is passed on.
FLUSH = 500_000


def _words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z folded; bytes.lower and bytes.split act on exactly these characters."""
    return text.encode("utf-8").lower().split() if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """Partial counts (word, cls, c) of docs(text, cls); the caller sums them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(w.decode("utf-8"), k, n) for k, c in counts.items() for w, n in c.items()]
            counts.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["word", "cls", "c"])

        for batch in batches:
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(k, Counter()).update(_words(text))
                if sum(map(len, counts.values())) > FLUSH:
                    yield out()
        yield out()

    return docs.select("text", "cls").mapInArrow(run, "word string, cls int, c long")


def _expected(vocabulary: DataFrame, pieces, models, k: int) -> np.ndarray:
    """(classes, pieces) expected uses when each distinct word of a class is spelled DISCOUNT times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, byte_ids = pieces.value
        own = Lattice(names, prior, byte_ids, np.float32)
        total = np.zeros((k, len(names)))
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), dtype=object)
            for i in range(k):
                here = words[batch.column(i + 1).to_numpy() > 0].tolist()
                if here:
                    own.set_weights(models.value[i])
                    total[i] += own.expected(here, np.full(len(here), DISCOUNT))
        cls, used = np.nonzero(total)
        kinds = [pa.array(cls, pa.int64()), pa.array(used, pa.int64()), pa.array(total[cls, used])]
        yield pa.RecordBatch.from_arrays(kinds, ["cls", "piece", "uses"])

    rows = vocabulary.mapInArrow(run, "cls long, piece long, uses double").groupBy("cls", "piece").agg(F.sum("uses").alias("uses"))
    found = rows.orderBy("cls", "piece").toPandas()  # at most one row per class and piece of the vocabulary
    out = np.zeros((k, len(pieces.value[0])))
    out[found["cls"], found["piece"]] = found["uses"]
    return out


def _most_frequent(words: DataFrame) -> DataFrame:
    """The words at or above the least count level that no more than HOT words reach.

    Levels are eighths of powers of two, so the histogram is a few hundred rows, and only the chosen words are sent on.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    histogram = words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in histogram:
        total += r["count"]
        if total > HOT:
            break
        least = r["level"]
    return words.filter(level >= least) if least is not None else words.filter("false")


def score(
    docs: DataFrame, training: Column, path: str, key: str = "doc_id", text: str = "text", label: str | None = "lang"
) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score and vocabulary_score of every row of docs.

    training chooses the rows to learn from; path is a sentencepiece vocabulary with scores.
    """
    spark = docs.sparkSession
    training = F.coalesce(training, F.lit(False))
    kind = F.col(label).cast("string") if label else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), training.alias("learn"), kind.alias("kind"))
    per_kind = rows.filter("learn").groupBy("kind").count()
    common = [r["kind"] for r in per_kind.filter("kind is not null").orderBy(F.desc("count"), "kind").limit(CLASSES).collect()]
    cls = F.lit(len(common))
    for i, name in enumerate(common):
        cls = F.when(F.col("kind") == name, i).otherwise(cls)
    rows = rows.withColumn("cls", F.when(F.col("learn"), F.coalesce(cls, F.lit(len(common)))).otherwise(-1).cast("int"))
    k = len(common) + 1
    ends = {r["cls"]: r["n"] for r in rows.filter("learn").groupBy("cls").agg(F.count("*").alias("n")).collect()}
    ends = np.array([float(ends.get(i, 0)) for i in range(k)])
    by_class = [F.coalesce(F.sum(F.when(F.col("cls") == i, F.col("c"))), F.lit(0)).alias(f"c{i}") for i in range(k)]
    vocabulary = materialize(count_words(rows).groupBy("word").agg(*by_class), "vocabulary")
    seen = sum((F.col(f"c{i}") for i in range(k)), F.lit(0))
    sums = vocabulary.agg(
        F.sum(F.when(seen > 0, 1)).alias("types"),
        *[F.sum(f"c{i}").alias(f"n{i}") for i in range(k)],
        *[F.sum(F.when(F.col(f"c{i}") > 0, 1)).alias(f"v{i}") for i in range(k)],
    ).first()
    n_k = np.array([float(sums[f"n{i}"] or 0) for i in range(k)]) + ends
    v_k = np.array([float(sums[f"v{i}"] or 0) for i in range(k)]) + (ends > 0)
    n, v = float(n_k.sum()), float((sums["types"] or 0) + (ends.sum() > 0))
    names, prior, byte_ids = load_pieces(path)
    pieces = spark.sparkContext.broadcast((names, prior, byte_ids))
    weights, stops = [prior] * k, np.zeros(k)
    for _ in range(ROUNDS if n else 0):
        models = spark.sparkContext.broadcast(np.array(weights))
        uses = _expected(vocabulary, pieces, models, k)
        fits = [spelling_weights(names, uses[i], prior, DISCOUNT * v_k[i]) for i in range(k)]
        weights, stops = [f[0] for f in fits], np.array([f[1] for f in fits])
    fitted = spark.sparkContext.broadcast(np.array(weights))
    share = np.log(np.maximum(v_k, 1e-300) / max(v_k.sum(), 1e-300))

    def by_count(counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Natural-log probability in every class, (rows, k), from counts and log spelling probabilities by class."""
        if n == 0:
            return logs
        top = np.maximum(logs.max(axis=1, keepdims=True), -1e300)
        common = top[:, 0] + np.log(np.maximum(np.exp(logs - top) @ np.exp(share), 1e-300))
        mass, own_mass = np.log(DISCOUNT * v / n), np.log(np.maximum(DISCOUNT * v_k, 1e-300) / np.maximum(n_k, 1e-300))
        overall = np.logaddexp(np.log(np.maximum(counts.sum(axis=1) - DISCOUNT, 1e-300) / n), mass + common)
        spelled = np.logaddexp(np.log(1 - COMMON) + logs, np.log(COMMON) + overall[:, None])
        own = np.logaddexp(np.log(np.maximum(counts - DISCOUNT, 1e-300) / np.maximum(n_k, 1e-300)), own_mass + spelled)
        return np.where(n_k > 0, own, overall[:, None])

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*pieces.value)
        for whole in batches:
            counts = np.column_stack([whole.column(i + 1).to_numpy() for i in range(k)]).astype(np.float64)
            words = whole.column(0).to_pylist()
            logs = own.log_probabilities(words, [*fitted.value, pieces.value[1]])
            lp = by_count(counts, logs[:, :k] + stops)
            total = counts.sum(axis=1)
            base = np.log10((total + 1) / (n + v + 1))
            offsets = pa.array(np.arange(0, len(words) * k + 1, k, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(lp.ravel()))
            yield pa.RecordBatch.from_arrays(
                [whole.column(0), pa.array(total.astype(np.int64)), pa.array(base), pa.array(logs[:, k]), lists], ["word", "c", "base", "plain", "lp"]
            )

    scored = materialize(
        vocabulary.mapInArrow(score_words, "word string, c long, base double, plain double, lp array<double>"), "scored-words"
    )
    top = _most_frequent(scored.filter((F.col("c") > 0) & (F.length("word") <= HOT_CHARS)))
    top = top.select("word", "base", "plain", *[F.get("lp", F.lit(i)).alias(f"lp{i}") for i in range(k)]).toPandas()
    lexicon = {w.encode("utf-8"): i for i, w in enumerate(top["word"])}
    hot = spark.sparkContext.broadcast((lexicon, top.drop(columns="word").to_numpy(dtype=np.float64)))
    del top

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, values = hot.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                tokens, known, found, words, times = [], [], [], [], []
                for t in batch.column(1).to_pylist():
                    counts = Counter(_words(t))
                    index = [where.get(w, -1) for w in counts]
                    n_of = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
                    at_hot = np.array(index, dtype=np.int64)
                    hits = at_hot >= 0
                    found.append(values[at_hot[hits]].T @ n_of[hits] if hits.any() else np.zeros(k + 2))
                    tokens.append(int(n_of.sum()) + 1)
                    known.append(int(n_of[hits].sum()))
                    words.append([w.decode("utf-8") for w, i in zip(counts, index, strict=True) if i < 0])
                    times.append([c for c, i in zip(counts.values(), index, strict=True) if i < 0])
                sums = np.array(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(tokens, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(sums[:, 0]),
                        pa.array(sums[:, 1]),
                        pa.array(list(sums[:, 2:]), pa.list_(pa.float64())),
                        pa.array(words, pa.list_(pa.string())),
                        pa.array(times, pa.list_(pa.int64())),
                    ],
                    ["key", "n_tokens", "n_known", "base", "plain", "lp", "words", "times"],
                )

    key_kind = docs.schema[key].dataType.simpleString()
    summed = rows.select("key", "text").mapInArrow(
        read, f"key {key_kind}, n_tokens long, n_known long, base double, plain double, lp array<double>, words array<string>, times array<long>"
    )
    parts = materialize(summed.withColumn("row", F.monotonically_increasing_id()), "summed")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("e")).select("row", F.col("e.words").alias("word"), F.col("e.times").alias("t"))
    more = (
        rare.join(scored, "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("more_known"),
            F.sum(F.col("t") * F.col("base")).alias("more_base"),
            F.sum(F.col("t") * F.col("plain")).alias("more_plain"),
            *[F.sum(F.col("t") * F.get("lp", F.lit(i))).alias(f"m{i}") for i in range(k)],
        )
    )
    end_lp = np.full(k, np.log(0.5)) if n == 0 else by_count(ends[None, :], np.full((1, k), -np.inf))[0]
    prior_k = np.log(np.maximum(ends, 1e-300) / max(ends.sum(), 1e-300)) if n else np.append(np.full(k - 1, -np.inf), 0.0)
    total = [
        F.get("lp", F.lit(i)) + F.coalesce(F.col(f"m{i}"), F.lit(0.0)) + float(end_lp[i] + prior_k[i]) for i in range(k) if np.isfinite(prior_k[i])
    ]
    top_of = F.greatest(*total, F.lit(float("-inf"))) if len(total) > 1 else total[0]
    marginal = top_of + F.log(sum((F.exp(x - top_of) for x in total), F.lit(0.0)))
    end_base = float(np.log10((ends.sum() + 1) / (n + v + 1)))
    return (
        parts.drop("words", "times")
        .join(more, "row", "left")
        .select(
            F.col("key").alias(key),
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(ends.sum() > 0)).alias("n_known"),
            F.lit(int(n)).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + end_base).alias("base_score"),
            (marginal / float(np.log(10))).alias("score"),
            ((F.col("plain") + F.coalesce("more_plain", F.lit(0.0))) / float(np.log(10))).alias("vocabulary_score"),
        )
    )

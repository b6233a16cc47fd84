"""Language identification by a bidirectional gated recurrent network over bytes.

Segments (runs without white space; long ones are cut, between characters, into windows of WINDOW bytes that also see
CONTEXT bytes on either side, so that whole texts are read) enter the network between two space bytes. The network
labels every byte position; a document's probability of a language is the mean over the positions of its segments that
hold a letter. It is trained in numpy by backpropagation through time. States do not pass from one segment to the next:
a worker then labels each distinct segment once, which is what makes whole texts affordable.

Training sample: at most PER_LANGUAGE documents of every language, chosen by a hash of key and text, at most TRAIN_CHARS
characters of each. Every label that occurs in the training rows is learned; from LANGUAGES labels on they share
LANGUAGES * PER_LANGUAGE documents evenly (at least one each), and the steps grow with their number. The bounds only limit
training, and hold before rows reach the driver: every prediction reads the whole text.

Defined results: null text or a text without a letter is `und` with score 0; without any labelled training row (an empty
table too) every text is `und`; rows without a key, repeated keys and repeated rows are rows of their own; of labels with
equal probability the first by code point wins; columns that bear the names of the results give way to them; equal
texts get equal results.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

PER_LANGUAGE, TRAIN_CHARS, LANGUAGES = 250, 1500, 64
HIDDEN, WINDOW, CONTEXT = 24, 40, 8
STEPS, BATCH, RATE = 260, 384, 0.02
#: Segments a worker remembers, and labels at once, up to LANGUAGES languages; fewer in proportion if there are more.
MEMO_ENTRIES, CHUNK = 300_000, 1024
_LETTER = regex.compile(r"\p{L}")
_NAMES = [f"{d}{p}" for d in "fb" for p in ("x", "h", "c")]


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]


def segments(text: str) -> list[str]:
    return text.split()


def _windows(word: str) -> list[tuple[bytes, int, int]]:
    """(bytes, first, last): windows of a segment, each with its context; the positions first to last are its own."""
    raw = word.encode("utf-8")
    if len(raw) <= WINDOW:
        return [(raw, 0, len(raw))]

    def edge(i: int) -> int:
        """The start of the character that byte i belongs to."""
        while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
            i -= 1
        return min(i, len(raw))

    cuts = [0]
    while cuts[-1] < len(raw):
        cuts.append(edge(cuts[-1] + WINDOW))
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        left, right = edge(max(0, a - CONTEXT)), edge(b + CONTEXT)
        out.append((raw[left:right], a - left, b - left))
    return out


def _batch(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix (time, rows) with a space before and after every part, and the lengths."""
    lengths = np.array([len(p) + 2 for p in parts])
    out = np.full((len(parts), lengths.max()), 32, dtype=np.int64)
    for i, p in enumerate(parts):
        out[i, 1 : len(p) + 1] = np.frombuffer(p, dtype=np.uint8)
    return out.T.copy(), lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _run(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, wc: np.ndarray, learn: bool) -> tuple[np.ndarray, list]:
    """States of one direction, (time, rows, hidden), and, to learn, what the backward pass needs.

    wx: (256, 3 hidden) rows of input sums by byte; wh: (hidden, 2 hidden) for the gates; wc: (hidden, hidden).
    """
    n = wc.shape[0]
    h = np.zeros((x.shape[1], n), dtype=np.float32)
    states, kept = np.empty((len(x), x.shape[1], n), dtype=np.float32), []
    for t in range(len(x)):
        a = wx[x[t]]
        gates = _sigmoid(a[:, : 2 * n] + h @ wh)
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(a[:, 2 * n :] + (r * h) @ wc)
        m = mask[t][:, None]
        new = np.where(m, h + z * (c - h), h)
        if learn:
            kept.append((h, z, r, c))
        h = states[t] = new
    return states, kept


def _back(x, mask, d_states, kept, wh, wc, g, name: str) -> None:
    """Adds the gradients of one direction to g."""
    n = wc.shape[0]
    d_h = np.zeros_like(d_states[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c = kept[t]
        m = mask[t][:, None]
        d_new = d_h + d_states[t]
        d_in = np.where(m, d_new, 0)
        d_c = d_in * z * (1 - c * c)
        d_rh = d_c @ wc.T
        d_z = d_in * (c - h) * z * (1 - z)
        d_r = d_rh * h * r * (1 - r)
        d_gates = np.concatenate((d_z, d_r), axis=1)
        g[name + "c"] += (r * h).T @ d_c
        g[name + "h"] += h.T @ d_gates
        np.add.at(g[name + "x"], x[t], np.concatenate((d_gates, d_c), axis=1))
        d_h = np.where(m, d_in * (1 - z) + d_rh * r + d_gates @ wh.T, d_new)


def _forward(w: dict[str, np.ndarray], parts: list[bytes], learn: bool = True):
    x, lengths = _batch(parts)
    mask = np.arange(len(x))[:, None] < lengths[None, :]
    f, f_kept = _run(x, mask, w["fx"], w["fh"], w["fc"], learn)
    b, b_kept = _run(x[::-1], mask[::-1], w["bx"], w["bh"], w["bc"], learn)
    both = np.concatenate((f, b[::-1]), axis=2)
    scores = both @ w["out"] + w["bias"]
    scores -= scores.max(axis=2, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=2, keepdims=True)
    return x, mask, both, p, f_kept, b_kept


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fits the network to sampled texts; words are drawn in proportion to their occurrences, languages evenly."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], {})
    rng = np.random.default_rng(seed)
    parts: list[list[bytes]] = [[] for _ in languages]
    for text, label in zip(texts, labels, strict=True):
        own = parts[languages.index(label)]
        for word in segments(text):
            if _LETTER.search(word):
                own.extend(part for part, _, _ in _windows(word))
    n, k = HIDDEN, len(languages)
    w = {}
    for d in "fb":
        w[d + "x"] = rng.normal(0, 0.3, (256, 3 * n))
        w[d + "h"] = rng.normal(0, n**-0.5, (n, 2 * n))
        w[d + "c"] = rng.normal(0, n**-0.5, (n, n))
    w["out"], w["bias"] = rng.normal(0, 0.1, (2 * n, k)), np.zeros(k)
    w = {name: v.astype(np.float32) for name, v in w.items()}
    m = {name: np.zeros_like(v) for name, v in w.items()}
    v2 = {name: np.zeros_like(v) for name, v in w.items()}
    some = [i for i in range(k) if parts[i]]
    steps = STEPS * max(1, -(-k // LANGUAGES))
    for step in range(1, steps + 1 if some else 1):
        label = np.sort(rng.choice(some, BATCH))
        drawn = [parts[i][rng.integers(len(parts[i]))] for i in label]
        x, mask, both, p, f_kept, b_kept = _forward(w, drawn)
        d = p
        d[:, np.arange(BATCH), label] -= 1
        d *= (mask / mask.sum())[:, :, None]
        d = d.astype(np.float32)
        g = {name: np.zeros_like(v) for name, v in w.items()}
        g["out"] = np.tensordot(both, d, ((0, 1), (0, 1)))
        g["bias"] = d.sum(axis=(0, 1))
        d_both = d @ w["out"].T
        _back(x, mask, d_both[:, :, :n], f_kept, w["fh"], w["fc"], g, "f")
        _back(x[::-1], mask[::-1], d_both[::-1, :, n:], b_kept, w["bh"], w["bc"], g, "b")
        norm = float(np.sqrt(sum((a.astype(np.float64) ** 2).sum() for a in g.values())))
        rate = RATE * min(1.0, 3 * (1 - (step - 1) / steps))
        for name in w:
            a = g[name] * min(1.0, 5.0 / max(norm, 1e-12))
            m[name] = 0.9 * m[name] + 0.1 * a
            v2[name] = 0.99 * v2[name] + 0.01 * a * a
            w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, w)


class Labeller:
    """Pools position probabilities of whole texts; remembers segments it has labelled."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.part = min(1.0, LANGUAGES / max(1, len(model.languages)))

    def _learn(self, words: list[str]) -> None:
        """Memo entry of a word: sum of its positions' probabilities, then their number; zeros without a letter."""
        k = len(self.model.languages)
        sums = np.zeros((len(words), k + 1))
        owner, parts = [], []
        for i, word in enumerate(words):
            if _LETTER.search(word):
                for part in _windows(word):
                    owner.append(i)
                    parts.append(part)
        order = sorted(range(len(parts)), key=lambda j: len(parts[j][0]))
        chunk = max(1, int(CHUNK * self.part))
        for at in range(0, len(order), chunk):
            chosen = [parts[j] for j in order[at : at + chunk]]
            _, mask, _, p, _, _ = _forward(self.model.weights, [c[0] for c in chosen], learn=False)
            # Own positions, and the spaces around the segment where a window begins or ends it.
            first = np.array([f + (f > 0) for _, f, _ in chosen])
            last = np.array([t + (1 if t < len(raw) else 2) for raw, _, t in chosen])
            steps = np.arange(len(mask))[:, None]
            mask = mask & (steps >= first) & (steps < last)
            total = (p * mask[:, :, None]).sum(axis=0)
            np.add.at(sums, [owner[j] for j in order[at : at + chunk]], np.column_stack((total, mask.sum(axis=0))))
        self.memo.update(zip(words, sums, strict=True))

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.memo) > MEMO_ENTRIES * self.part:
            self.memo.clear()
        counts = [Counter(segments(t)) if t else Counter() for t in texts]
        if self.model.languages:
            self._learn(list(set().union(*counts).difference(self.memo)))
        out = []
        for c in counts:
            total = np.zeros(len(self.model.languages) + 1)
            if c and self.model.languages:
                total = np.array([self.memo[word] for word in c]).T @ np.fromiter(c.values(), dtype=np.float64)
            if total[-1]:
                best = int(np.argmax(total[:-1]))
                out.append((self.model.languages[best], float(min(1.0, total[best] / total[-1]))))
            else:
                out.append(("und", 0.0))
        return out


def sample(docs: DataFrame, key: str, text: str, lang: str, training: Column) -> pd.DataFrame:
    """The bounded training sample: label counts cover all rows, then a hash of the key chooses the documents."""
    usable = docs.filter(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    most = max(1, min(PER_LANGUAGE, LANGUAGES * PER_LANGUAGE // len(counts)))
    # A margin above the documents wanted, so that no label draws none; one folded literal, however many labels there are.
    shares = {name: min(1.0, max(1.2 * most, most + 20) / n) for name, n in counts.items()}
    share = F.element_at(F.from_json(F.lit(json.dumps(shares)), "map<string,double>"), F.col(lang))
    draw = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.select(F.substring(text, 1, TRAIN_CHARS).alias("text"), F.col(lang).alias("lang"), draw.alias("draw"), F.col(key).alias("key"))
    # The limit holds in every task before rows are sent on, however many rows share a draw.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key", "text"))

    def first(some: DataFrame) -> pd.DataFrame:
        return some.withColumn("place", place).filter(F.col("place") <= most).toPandas()

    rows = first(drawn.filter(F.col("draw") < share))
    missed = sorted(set(counts) - set(rows["lang"]))  # all their rows are copies of a few texts
    if missed:
        rows = pd.concat([rows, first(drawn.filter(F.col("lang").isin(missed)))])
    return rows.sort_values(["lang", "place"])[["text", "lang"]]


def identify(
    docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """docs with lang_pred and score; `training` chooses the rows whose labels may be learned from.

    Columns of docs that bear the names of the results give way to them.
    """
    docs = docs.drop("lang_pred", "score")
    rows = sample(docs, key, text, lang, training)
    model = train(list(rows["text"]), list(rows["lang"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(model)
        place = names.index(text)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = own.label(batch.column(place).to_pylist())
                extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "lang_pred", "score"])

    names = docs.columns
    schema = StructType(docs.schema.fields + StructType().add("lang_pred", "string").add("score", "double").fields)
    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, training: Column, least: float = 0.4) -> DataFrame:
    """docs whose language is identified with a score of at least `least`."""
    return identify(docs, training).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")

"""Near-duplicate classes by min-max hashing.

Every permutation of a text's shingle hashes keeps both its least and its greatest value, so half the permutations
give a signature of the same length. Bands of `ROWS` equal values propose buckets of texts. Equal shingle sets are one
representative from the start. A bucket never emits all its pairs: each text is first confirmed, on full shingle sets,
against the bucket leader it meets most often, and only pairs that the classes found so far leave apart are confirmed
after that. The chance that no band holds a pair at similarity 0.8 is (1 - 0.8**6)**48, below 5e-7, and lower above.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text with
fewer words than a shingle has its whole sequence as one shingle; rows that share a key are one document; a row
without a key is linked with nothing, has no class and is kept; very long texts are hashed in blocks and read whole;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import mark, release
from .common import materialize
from .components import components
from .shingles import U, mix, shingle_set

ROWS, BANDS = 6, 48
PERMUTATIONS = ROWS * BANDS // 2
#: Shingles hashed at a time.
BLOCK = 1 << 14
#: Most bits of the filter that drops texts outside all pairs (32 MB; beyond a quarter as many ids the texts are joined
#: instead), and 64-bit words of marks kept of a difference.
SIEVE_BITS, MARKS = 1 << 28, 8

_SEED = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_FACTOR, _OFFSET = _SEED[:PERMUTATIONS] | U(1), _SEED[PERMUTATIONS:]
_SALT = mix(np.arange(101, 101 + BANDS, dtype=np.uint64) * U(0xD6E8FEB86659FD93))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of PERMUTATIONS minima followed by as many maxima, for non-empty sets."""
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint64)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (total == 0 or total + len(sets[last]) <= BLOCK):
            total += len(sets[last])
            last += 1
        values = np.concatenate(sets[first:last])
        starts = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        x = np.empty_like(values)
        for k in range(PERMUTATIONS):
            np.multiply(values, _FACTOR[k], out=x)
            np.add(x, _OFFSET[k], out=x)
            out[first:last, k] = np.minimum.reduceat(x, starts)
            out[first:last, PERMUTATIONS + k] = np.maximum.reduceat(x, starts)
        first = last
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for every row and band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(_SALT, parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key ^ parts[:, :, k])
    return key


def _list_column(rows: np.ndarray, has: np.ndarray) -> pa.Array:
    """list<int64> column: the rows of a matrix in turn where `has`, null elsewhere."""
    lengths = np.where(has, rows.shape[1], 0)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1).view(np.int64)))
    return pa.ListArray.from_arrays(pa.array(offsets), lists.values, mask=pa.array(~has))


def signed(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """id, set size n, the set's 128-bit digest (k1, k2) and bucket keys; null digest and keys for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                has = sizes > 0
                digests = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
                full = [s for s in sets if len(s)]
                keys = band_keys(signatures(full)) if full else np.zeros((0, BANDS), dtype=np.uint64)
                halves = np.array([(d >> 64, d & (1 << 64) - 1) for d in digests], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(sizes),
                        pa.array(halves[:, 0], mask=~has),
                        pa.array(halves[:, 1], mask=~has),
                        _list_column(keys, has),
                    ],
                    ["id", "n", "k1", "k2", "keys"],
                )

    return docs.select(key, text).mapInArrow(run, "id long, n long, k1 long, k2 long, keys array<long>")


def _sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """id and full set of the rows that are wanted, and of some others.

    A Bloom filter of the wanted ids drops most other texts where they are read; where they are too many for one, the
    texts are joined with them first.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null")
    n = wanted.count()
    sieve = None
    if 4 * n > SIEVE_BITS:
        rows = rows.join(wanted, "id", "left_semi")
    else:
        sieve = docs.sparkSession.sparkContext.broadcast(_sieve(wanted, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                if sieve is not None:
                    batch = batch.filter(pa.array(_sifted(sieve.value, batch.column(0).to_numpy(zero_copy_only=False))))
                sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
                offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), column], ["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles array<long>")


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + U(0x9E3779B97F4A7C15))
    return [h & U(bits - 1), (h >> U(32)) & U(bits - 1), mix(h) & U(bits - 1)]


def _sieve(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the n ids as 64-bit words, of 2**20 to SIEVE_BITS bits."""
    bits = 1 << 20
    while bits < min(16 * n, SIEVE_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(_places(batch.column(0).to_numpy(), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places >> 6), pa.array(np.left_shift(U(1), (places & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"]
            )

    words = ids.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy().view(np.uint64)
    return out


def _sifted(sieve: np.ndarray, ids: np.ndarray) -> np.ndarray:
    found = np.ones(len(ids), dtype=bool)
    for place in _places(ids, len(sieve) * 64):
        found &= (sieve[(place >> U(6)).astype(np.int64)] >> (place & U(63)) & U(1)).astype(bool)
    return found


def confirm(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int, name: str) -> DataFrame:
    """pairs(a, b) with the size of their full sets' intersection and union, and whether they are linked.

    Texts are not shuffled: a Bloom filter of bounded size drops most others where they are read, and an exact
    semi-join on the ids drops the rest. `bits` marks where the sets' difference falls among 64 * MARKS places.
    """
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
    read = _sets(docs, key, text, width, wanted)
    # Made distinct before it is written, so that the joins below stay plain ones, which skew handling can split.
    sets = materialize(read.join(wanted, "id", "left_semi").dropDuplicates(["id"]), f"{name}-sets")
    left, right = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    joined = (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("apart", F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")))
        .select("a", "b", both.alias("common"), (F.size("sa") + F.size("sb")).cast("long").alias("total"), "apart")
    )

    def marked(word: int):
        own = F.filter("apart", lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(MARKS - 1)) == word)
        bit = F.transform(own, lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))
        return F.aggregate(bit, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return joined.select(
        "a",
        "b",
        "common",
        (F.col("total") - F.col("common")).alias("either"),
        F.array(*[marked(word) for word in range(MARKS)]).alias("bits"),
    ).withColumn("linked", 100 * F.col("common") >= percent * F.col("either"))


def _alike_sizes(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (least key of its class) and kept."""
    found = materialize(signed(docs, key, text, width), "signed")
    some = found.filter(F.col("id").isNotNull() & F.col("k1").isNotNull())
    digests = some.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    signs = materialize(
        some.join(digests.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "keys"), "representatives"
    )
    rows = signs.select("id", "n", F.explode("keys").alias("bucket"))
    heads = (
        rows.groupBy("bucket")
        .agg(F.count("*").alias("rows"), F.min(F.struct("id", "n")).alias("head"))
        .filter("rows > 1")
        .select("bucket", F.col("head.id").alias("leader"), F.col("head.n").alias("leader_n"))
    )
    members = materialize(rows.join(heads, "bucket"), "members")
    # First the leader that a text meets in most bands.
    met = (
        members.filter((F.col("id") != F.col("leader")) & _alike_sizes("n", "leader_n", percent))
        .groupBy("id", "leader")
        .agg(F.count("*").alias("bands"))
        .groupBy("id")
        .agg(F.max(F.struct("bands", (-F.col("leader")).alias("minus"))).alias("best"))
        .select((-F.col("best.minus")).alias("a"), F.col("id").alias("b"))
    )
    since = mark()
    first = materialize(confirm(met, docs, key, text, width, percent, "first"), "first")
    release(docs.sparkSession, since, keep=1)  # full sets are the largest tables
    linked = components(first.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
    rest = _apart(members, first, linked, percent)
    since = mark()
    second = materialize(confirm(rest, docs, key, text, width, percent, "second"), "second")
    release(docs.sparkSession, since, keep=1)
    label = F.coalesce(F.col("component"), F.col("id"))
    bridges = second.filter("linked")
    for end in ("a", "b"):
        bridges = (
            bridges.withColumn("id", F.col(end))
            .join(linked.withColumnRenamed("node", "id"), "id", "left")
            .withColumn(end, label)
            .drop("id", "component")
        )
    over = components(bridges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # A class of representatives, and the class that bridges joined it to.
    of = (
        digests.select("k1", "k2", F.col("rep").alias("id"))
        .join(linked.withColumnRenamed("node", "id"), "id", "left")
        .select("k1", "k2", label.alias("node"))
        .join(over, "node", "left")
        .select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    )
    counted = found.select("id", "n", "k1", "k2")
    placed = counted.filter("k1 is not null").join(of, ["k1", "k2"], "left").select("id", "n", "component_id")
    alone = counted.filter("k1 is null").select("id", "n", F.col("id").alias("component_id"))
    out = placed.union(alone)
    return out.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _apart(members: DataFrame, first: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a bucket, lie in different classes so far, and may still be similar enough.

    Only the texts outside a bucket's largest class are compared with the others. Two texts X and Y confirmed against
    the same leader L differ by |DX| + |DY| - 2 |DX and DY| shingles, where D is the difference from L; the marks of DX
    and DY bound their overlap from above, so a pair that must differ too much is left out without losing a link.
    """
    tested = first.select(F.col("b").alias("id"), F.col("a").alias("to"), (F.col("either") - F.col("common")).alias("differ"), "bits")
    placed = (
        members.select("bucket", "id", "n")
        .join(linked.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    main = (
        placed.groupBy("bucket", "component")
        .agg(F.count("*").alias("rows"))
        .groupBy("bucket")
        .agg(F.max(F.struct("rows", "component")).alias("top"), F.count("*").alias("classes"))
        .filter("classes > 1")
        .select("bucket", F.col("top.component").alias("main"))
    )
    mixed = materialize(placed.join(main, "bucket").join(tested, "id", "left"), "mixed")
    names = ("id", "n", "component", "to", "differ", "bits")
    some = mixed.filter("component <> main").select("bucket", "main", *(F.col(c).alias(f"x_{c}") for c in names))
    every = mixed.select(F.col("bucket").alias("y_bucket"), *(F.col(c).alias(f"y_{c}") for c in names))

    def pop(parts):
        return sum((F.bit_count(p) for p in parts), F.lit(0))

    x, y = ([F.get(f"{side}_bits", F.lit(i)) for i in range(MARKS)] for side in "xy")
    overlap = pop([p.bitwiseAND(q) for p, q in zip(x, y, strict=True)]) + F.least(
        F.col("x_differ") - pop(x), F.col("y_differ") - pop(y)
    )
    least = F.col("x_differ") + F.col("y_differ") - 2 * overlap
    far = (F.col("x_to") == F.col("y_to")) & (least * (100 + percent) > (100 - percent) * (F.col("x_n") + F.col("y_n")))
    pairs = some.join(
        every,
        (F.col("bucket") == F.col("y_bucket"))
        & (F.col("x_component") != F.col("y_component"))
        & ((F.col("y_component") == F.col("main")) | (F.col("x_id") < F.col("y_id")))
        & _alike_sizes("x_n", "y_n", percent)
        & ~F.coalesce(far, F.lit(False)),
    )
    ordered = pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialize(ordered.join(known, ["a", "b"], "left_anti"), "rest")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose class has a smaller key; of rows that share a key, one stays."""
    kept = classes(docs, key, text, width, percent).filter("kept").select(F.col(key).alias("__kept")).distinct()
    keyed = docs.filter(F.col(key).isNotNull())
    if not keyed.groupBy(key).count().filter("count > 1").isEmpty():
        keyed = keyed.dropDuplicates([key])
    return keyed.join(kept, keyed[key] == kept["__kept"], "left_semi").union(docs.filter(F.col(key).isNull()))

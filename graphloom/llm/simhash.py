"""SimHash fingerprints and Hamming search by permuted block tables, in DataFrame functions only.

Terms are a text's pairs of neighbouring words (its one word if it has no pair), each weighted by its occurrences;
their 64-bit hashes vote on every bit. Votes are counted in packed lanes, so a text costs a few sums over its terms and
no shuffle. The search splits fingerprints into eight blocks; fingerprints within five bits agree on at least three
whole blocks, so one of 56 tables, keyed by three blocks (24 bits), holds the pair. A pair is reported by the first
table that holds it only.

Defined results: a null or empty text, or one without words, has fingerprint 0; equal texts have equal fingerprints;
texts are read whole; rows without a key come last in descending order of keys, and rows with equal keys (or none) are
ordered by a hash of their text, then the text; repeated rows follow one another; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, words

BITS, RADIUS = 64, 5
#: Widths of the blocks; RADIUS fewer than all of them make a table's key.
BLOCKS = (8, 8, 8, 8, 8, 8, 8, 8)
#: Terms up to which votes fit into lanes of 16 bits; longer texts use lanes of 32.
NARROW = (1 << 16) - 1
#: Most buckets that order the keys (their bounds are held by every task), and rows aimed at in each.
MAX_BUCKETS, BUCKET_ROWS = 20_000, 2048


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[int]:
    starts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    block = [((1 << w) - 1) << s for w, s in zip(BLOCKS, starts, strict=True)]
    return [_signed(sum(block[i] for i in chosen)) for chosen in combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)]


MASKS = _masks()


def _votes(terms: Column, lanes: int) -> list[Column]:
    """Set bits of all terms, counted for bit j, j + lanes, ... in the fields of the j-th long."""
    field = _signed(sum(1 << k for k in range(0, BITS, lanes)))

    def one(j: int) -> Column:
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(field)))

    return [one(j) for j in range(lanes)]


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the signed 64-bit fingerprint of `text` in `out`; one column a step keeps the expressions shallow."""
    w, terms = F.col("__w"), F.col("__terms")
    n = F.size(terms)
    pairs = F.transform(
        F.when(F.size(w) >= 2, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)),
    )
    lone = F.when(F.size(w) == 1, F.array(F.xxhash64(F.get(w, F.lit(0))))).otherwise(pairs)
    df = df.withColumn("__w", words(F.lower(F.col(text)))).withColumn("__terms", lone).drop("__w")
    narrow, wide = (F.array(*_votes(terms, lanes)) for lanes in (16, 32))
    df = df.withColumn("__votes", F.when(n <= NARROW, narrow).otherwise(wide))

    def bit(b: int) -> Column:
        def count(lanes: int, width: int) -> Column:
            lane = F.get("__votes", F.lit(b % lanes))
            return F.shiftrightunsigned(lane, b // lanes * width).bitwiseAND(F.lit((1 << width) - 1))

        count_b = F.when(n <= NARROW, count(16, 16)).otherwise(count(32, 32))
        return F.when(count_b * 2 > n, F.lit(_signed(1 << b))).otherwise(F.lit(0))

    fingerprint = reduce(lambda a, b: a.bitwiseOR(b), [bit(b) for b in range(BITS)])
    return df.withColumn(out, fingerprint).drop("__terms", "__votes")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _constant(values: list, kind: str) -> Column:
    """One folded literal, however many values there are."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds up to the key, found in two steps of about the square root of their number; null keys: -1."""
    step = max(1, round(len(bounds) ** 0.5))
    coarse = _constant(bounds[::step], "array<bigint>")
    fine = _constant([bounds[i : i + step] for i in range(0, len(bounds), step)], "array<array<bigint>>")
    at = F.size(F.filter(coarse, lambda b: b <= key))
    inner = F.size(F.filter(F.get(fine, at - 1), lambda b: b <= key))
    return F.when(key.isNull(), -1).when(at == 0, 0).otherwise((at - 1) * step + inner).cast("int")


def _dealt(df: DataFrame, key: str, tie: str) -> DataFrame:
    """df with __bucket and __part (range buckets of the order), __alone (whether a bucket has one key) and __turn.

    Keys are dealt by their quantiles. A key that fills several of them has a bucket of its own, as have the rows
    without a key, and such a bucket is parted by the hash of the tie.
    """
    rows, keyless = df.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    buckets = max(1, min(MAX_BUCKETS, (rows - keyless) // BUCKET_ROWS))
    shares = [k / buckets for k in range(1, buckets)]
    found = (df.agg(F.percentile_approx(key, shares, max(10_000, 4 * buckets))).first()[0] if shares else None) or []
    often = {k: n for k, n in Counter(found).items() if n > 1}
    bounds = sorted(set(found) | {k + 1 for k in often})
    parts = [max(1, min(MAX_BUCKETS, keyless // BUCKET_ROWS)), 1, *[often.get(k, 1) for k in bounds]]
    alone = [True, False, *[k in often for k in bounds]]
    bucket = _bucket(F.col(key), bounds) if bounds else F.when(F.col(key).isNull(), -1).otherwise(0)
    turn = F.shiftrightunsigned(F.xxhash64(tie), 1)
    share = F.shiftrightunsigned(F.xxhash64(tie), 34) / float(1 << 30)
    return (
        df.withColumn("__bucket", bucket)
        .withColumn("__part", F.floor(share * F.get(_constant(parts, "array<int>"), F.col("__bucket") + 1)).cast("int"))
        .withColumn("__alone", F.get(_constant(alone, "array<boolean>"), F.col("__bucket") + 1))
        .withColumn("__turn", turn)
    )


def with_next(df: DataFrame, key: str, tie: str, carried: Sequence[str], derive=lambda rows: rows) -> DataFrame:
    """df with `next_<c>` of the row that follows in descending order of keys (after the last: the first).

    derive(df) may add columns, also carried ones, where rows are read: once a row, and once more for the few copies.
    Each bucket also gets a copy of the first row of the bucket that follows, so one window over buckets answers all
    rows without ordering the whole table in one task.
    """
    dealt = _dealt(df, key, tie)
    place = ["__bucket", "__part"]
    # One row a bucket and part: at most 2 * MAX_BUCKETS for the keys and MAX_BUCKETS for rows without one.
    heads = dealt.groupBy(*place).agg(F.max(key).alias("__head"), F.min("__turn").alias("__least"))
    before = _follow(heads)
    first = F.when(F.col("__alone"), F.col("__turn") == F.col("__least")).otherwise(F.col(key).eqNullSafe(F.col("__head")))
    own = dealt.join(F.broadcast(before), (F.col("__bucket") == F.col("__own")) & (F.col("__part") == F.col("__own_part")))
    copies = own.filter(first).dropDuplicates(["__own", "__own_part", key, "__turn", tie])
    copies = copies.select(*df.columns, F.col("__to").alias("__bucket"), F.col("__to_part").alias("__part"), "__turn", F.lit(1).alias("__copy"))
    both = derive(dealt.select(*df.columns, *place, "__turn", F.lit(0).alias("__copy"))).unionByName(derive(copies))
    w = Window.partitionBy(*place).orderBy(F.col("__copy"), F.col(key).desc_nulls_last(), F.col("__turn"), F.col(tie))
    for c in carried:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.filter("__copy = 0").drop("__copy", "__turn", *place)


def _follow(heads: DataFrame) -> DataFrame:
    """Of each bucket and part: its head, and the one before it in the order (of the first: the last). One row a part."""
    order = Window.orderBy(F.col("__bucket").desc(), F.col("__part"))
    last = F.max(F.struct((-F.col("__bucket")).alias("b"), F.col("__part").alias("p"))).over(Window.partitionBy())
    return heads.select(
        F.col("__bucket").alias("__own"),
        F.col("__part").alias("__own_part"),
        "__head",
        "__least",
        F.coalesce(F.lag("__bucket").over(order), -last["b"]).alias("__to"),
        F.coalesce(F.lag("__part").over(order), last["p"]).alias("__to_part"),
    )


def near(fingerprints: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(fp, found, distance, member, copies): for each distinct `fp` of asked, every fingerprint within RADIUS bits.

    member is the least key among the rows with the found fingerprint, copies their number. Equal fingerprints are one row
    before the tables are built, so copies cost nothing; the rows with fingerprint `found` are the matches.
    """
    counted = materialize(fingerprints.groupBy("fp").agg(F.count("*").alias("copies"), F.min(key).alias("member")), "counted")

    def keys(fp: Column) -> list[Column]:
        return [F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(m))) for t, m in enumerate(MASKS)]

    left = asked.select(F.col("fp").alias("asked")).distinct()
    left = left.select("asked", F.posexplode(F.array(*keys(F.col("asked")))).alias("t", "k"))
    # Rows of the tables are two numbers; counts are joined to what is found.
    right = counted.select("fp", F.explode(F.array(*keys(F.col("fp")))).alias("k"))
    differ = F.col("asked").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(MASKS)])
    # Estimates of its size do not see the tables, so a broadcast must be ruled out.
    close = left.join(right.hint("merge"), "k").filter(F.bit_count(differ) <= RADIUS).filter(first == F.col("t"))
    found = close.select("asked", "fp", F.bit_count(differ).alias("distance"))
    return found.join(counted, "fp").select(F.col("asked").alias("fp"), F.col("fp").alias("found"), "distance", "member", "copies")


def search(fingerprints: DataFrame, asked: DataFrame, key: str = "fp") -> DataFrame:
    """For each distinct `fp` of asked: n_near, the rows of fingerprints within RADIUS bits (its own row counts), and near.

    near holds (distance, member, fingerprint, copies) of each fingerprint found, the closest first; see `near`.
    """
    one = F.struct("distance", "member", as_hex(F.col("found")).alias("fingerprint"), "copies")
    found = near(fingerprints, asked, key).groupBy("fp")
    return found.agg(F.sum("copies").alias("n_near"), F.array_sort(F.collect_list(one)).alias("near"))

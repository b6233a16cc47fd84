"""Quality rules, BPE, SimHash and packing against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from graphloom.llm import bpe, packing, quality, queries, simhash
from graphloom.llm.common import words

from ..oracle import FOLDER, rows_by_sql, rows_of
from . import cases

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert rows_of(spark, queries.QUERIES[name]) == rows_by_sql(queries.ORACLES[name])


def test_words(spark):
    df = cases.documents(spark)
    for r in df.select("text", words(F.col("text")).alias("w")).collect():
        assert r["w"] == SPLIT.findall(r["text"] or "")


def plain_quality(text):
    text = text or ""
    w = SPLIT.findall(text)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("a b c. d| #e\n f\n f\t").strip("q") for _ in range(r.randint(0, 120))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in [*texts, *[x[1] for x in cases.ROWS]]], "text string")
    for row in quality.assess(df).collect():
        assert tuple(row["quality"][n] for n in NAMES) == plain_quality(row["text"])


def test_quality_verdicts(spark):
    good, menu = cases.prose(7, 120), " | ".join(cases.WORDS)
    shout = " ".join(w.upper() + "!!" for w in cases.WORDS)
    symbols = " ".join(w + "***" for w in cases.prose(8, 90).split())
    texts = {good: True, good + "\n" + menu: True, "\n".join([menu] * 4) + "\n" + good[:200] + ".": False, symbols: False, shout * 4: False}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["quality"] for r in quality.assess(df).collect()}
    assert {t: q["kept"] for t, q in got.items()} == texts
    assert got[good + "\n" + menu]["cleaned"] == good


def test_quality_edges(spark):
    out = quality.assess(cases.documents(spark))
    assert out.count() == len(cases.ROWS) and not any(r[0] for r in out.filter("text is null or trim(text) = ''").select("quality.kept").collect())
    assert quality.clean(cases.documents(spark)).filter("doc_id = 2").count() == 2
    assert quality.assess(cases.empty(spark)).count() == 0


def test_codec_matches_library():
    own = bpe.codec(PATH, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("abc the  \n\t'sllre 0123é漢字🙂#$\x1c ") for _ in range(r.randint(0, 200))) for _ in range(800)]
    texts += ["x" * 3000, "ab" * 2000 + " " * 900, "".join(r.choice("etaoin") for _ in range(5000)), "<|endoftext|>", "", None, cases.BASE]
    fast = bpe.fast_ids(PATH, PATTERN)(texts)
    for text, packed, ids in zip(texts, own.encode_batch(texts), fast, strict=True):
        want = library.encode_ordinary(text or "")
        assert np.frombuffer(packed, "<u4").tolist() == want == ids.tolist() and own.decode(packed) == (text or "").encode()
    keys = list(own.ranks)
    assert sorted(own.hash.slots(keys).tolist()) == list(range(len(keys)))


def test_long_texts_leave_the_library(monkeypatch):
    monkeypatch.setattr(bpe, "LIBRARY_CHARS", 10)
    ids = next(iter(bpe.fast_ids(PATH, PATTERN)(["hello world, hello"])))
    assert bpe.codec(PATH, PATTERN).decode(ids.tobytes()) == b"hello world, hello"


def test_round_trip_edges(spark):
    out = bpe.round_trip(cases.documents(spark), "doc_id", "text", PATH, PATTERN).collect()
    want = sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in cases.ROWS)
    assert sorted(r["decoded_sha256"] for r in out) == want
    assert bpe.round_trip(cases.empty(spark), "doc_id", "text", PATH, PATTERN).count() == 0
    ids = bpe.encode(cases.documents(spark), "doc_id", "text", PATH, PATTERN).filter("doc_id = 5").first()
    assert (ids["n_tokens"], ids["ids"]) == (0, b"")


def test_byte_level_query(spark):
    own = bpe.codec(PATH, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.QUERIES["op6_byte_level_bpe"](spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), dtype="<u4").tobytes()
        want = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_packing_query(spark):
    own = bpe.codec(PATH, PATTERN)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    parts, full = {}, 0
    for x in queries.QUERIES["op8_token_packing"](spark, FOLDER).collect():
        ids = np.frombuffer(x["ids"], "<u4")
        full += x["n_tokens"]
        for k, doc in enumerate(x["doc_ids"]):
            a, b = x["cu_seqlens"][k : k + 2]
            parts.setdefault(doc, []).append((x["starts"][k], ids[a:b]))
    assert set(parts) == set(texts)
    for doc, text in texts.items():
        whole = np.concatenate([p for _, p in sorted(parts[doc], key=lambda y: y[0])])
        assert whole[-1] == 50256 and own.decode(whole[:-1].tobytes()) == text.encode()
    assert full == sum(len(p) for x in parts.values() for _, p in x)


def test_simhash_votes_and_search(spark):
    df = cases.documents(spark).select("doc_id", "text")
    marked = simhash.with_fingerprint(df, "text", "fp")
    terms = F.transform(F.sequence(F.lit(0), F.size(F.col("w")) - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))
    plain = df.withColumn("w", words(F.lower("text"))).filter(F.size("w") > 1).select("doc_id", "text", terms.alias("h"))
    fps = {r["text"]: r["fp"] for r in marked.collect()}
    for r in plain.collect():
        votes = sum(((np.array(r["h"])[:, None] >> np.arange(64)) & 1).astype(int))
        bits = sum(1 << b for b in range(64) if 2 * votes[b] > len(r["h"]))
        assert fps[r["text"]] == bits - (1 << 64 if bits >> 63 else 0)
    assert fps[None] == fps[""] == 0
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << k for k in r.sample(range(64), d)) for b in base for d in (1, 2, 3, 4, 5, 6, 7)] + base[:5]
    signed = [v - (1 << 64 if v >> 63 else 0) for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {x["fp"]: x["n_near"] for x in simhash.search(table, table).collect()}
    assert found == {s: sum((v ^ w).bit_count() <= simhash.RADIUS for w in values) for s, v in zip(signed, values, strict=True)}


def test_near_documents_can_be_told(spark):
    base, r = 0x0123456789ABCDEF, random.Random(6)
    values = [base, base, base ^ 1, base ^ 0b111 << 60, base ^ 0b111111 << 40, *[r.getrandbits(64) for _ in range(20)]]
    signed = [v - (1 << 64 if v >> 63 else 0) for v in values]
    table = spark.createDataFrame([(100 + i, v) for i, v in enumerate(signed)], "doc_id long, fp long")
    got = {(x["fp"], x["found"]): (x["distance"], x["member"], x["copies"]) for x in simhash.near(table, table, "doc_id").collect()}
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(a, b): (bits(a, b), 100 + signed.index(b), signed.count(b)) for a in signed for b in signed if bits(a, b) <= simhash.RADIUS}
    assert got == want
    row = simhash.search(table, table.filter("doc_id = 102"), "doc_id").first()
    assert [(x["distance"], x["member"], x["copies"]) for x in row["near"]] == [(0, 102, 1), (1, 100, 2), (4, 103, 1)]


def test_wide_lanes_agree(spark, monkeypatch):
    df = spark.createDataFrame([(cases.prose(9, 500),)], "text string")
    narrow = simhash.with_fingerprint(df, "text", "fp").first()["fp"]
    monkeypatch.setattr(simhash, "NARROW", 10)
    assert simhash.with_fingerprint(df, "text", "fp").first()["fp"] == narrow


def test_next_row_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 3)
    ids = [None, *random.Random(3).sample(range(-50, 1000), 60), 7, 7]
    df = spark.createDataFrame([(i, str(k)) for k, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    out = simhash.with_next(df, "doc_id", "text", ["text"]).collect()
    turn = {r["text"]: r["h"] for r in df.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).collect()}
    order = sorted(((i, str(k)) for k, i in enumerate(ids)), key=lambda x: (x[0] is None, -(x[0] or 0), turn[x[1]], x[1]))
    want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    assert {r["text"]: r["next_text"] for r in out} == want and len(out) == len(ids)
    # Half of the rows share a key and a quarter has none: both are parted, and the order stays whole.
    ids = [9] * 60 + [None] * 30 + list(range(30))
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    parts = simhash._dealt(df, "doc_id", "text").groupBy("__bucket", "__part").count().collect()
    assert max(r["count"] for r in parts) <= 20 and len({r["__part"] for r in parts if r["__bucket"] == -1}) > 5
    turn = {r["text"]: r["h"] for r in df.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).collect()}
    order = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda x: (x[0] is None, -(x[0] or 0), turn[x[1]], x[1]))
    want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    again = simhash.with_next(df, "doc_id", "text", ["text", "n"], lambda d: d.withColumn("n", F.length("text"))).collect()
    assert {r["text"]: r["next_text"] for r in again} == want and all(r["next_n"] == len(r["next_text"]) for r in again)
    assert simhash.with_next(cases.empty(spark), "doc_id", "text", ["text"]).count() == 0


def test_fingerprint_query(spark):
    rows = sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_simhash_fingerprints"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        cut, after = len(r["text"]) // 3, rows[(k + 1) % len(rows)]
        edited = r["text"][: len(r["text"]) - cut] + after["text"][:cut]
        x = got[r["doc_id"]]
        assert (x["n_chars"], x["edited_sha256"]) == (len(r["text"]), hashlib.sha256(edited.encode()).hexdigest())
        assert x["near_next"] == 1 - (int(x["fingerprint"], 16) ^ int(got[after["doc_id"]]["fingerprint"], 16)).bit_count() / 64
    assert np.mean([x["near_edited"] for x in got.values()]) > np.mean([x["near_next"] for x in got.values()]) + 0.15


def test_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(120):
        width = r.randint(1, 40)
        lengths = [r.randint(1, width) for _ in range(r.randint(0, 50))]
        rows = packing.best_fit_decreasing(lengths, width)
        slow = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = [row for row in slow if row[0] >= lengths[i]]
            row = min(fit, key=lambda x: x[0]) if fit else [width]
            if not fit:
                slow.append(row)
            row[0] -= lengths[i]
        assert sorted(sum(rows, [])) == list(range(len(lengths)))
        assert sorted(width - sum(lengths[i] for i in x) for x in rows) == sorted(x[0] for x in slow)


def test_packed_rows_unpack(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(packing, "WINDOW", 5000)
    packed = packing.pack(cases.documents(spark), bpe.fast_ids(PATH, PATTERN), width=256)
    packing.write_matrices(packed, str(tmp_path / "out"))
    own, parts = bpe.codec(PATH, PATTERN), []
    for x in spark.read.parquet(str(tmp_path / "out")).collect():
        ids, places = np.frombuffer(x["ids"], "<u4"), np.frombuffer(x["positions"], "<u4")
        assert len(ids) == len(places) == 256 and x["cu_seqlens"][-1] == x["n_tokens"] <= 256
        for k, doc in enumerate(x["doc_ids"]):
            a, b = x["cu_seqlens"][k : k + 2]
            assert (places[a:b] == np.arange(b - a)).all()
            parts.append((doc, x["starts"][k], ids[a:b].tolist()))
    total = sum(len(p[2]) for p in parts)
    want = [next(iter(own.encode_batch([r[1]]))) for r in cases.ROWS]
    assert total == sum(len(w) // 4 + 1 for w in want)
    long = np.array(sum((p[2] for p in sorted(p for p in parts if p[0] == 8)), []), dtype="<u4")
    assert long[-1] == 50256 and own.decode(long[:-1].tobytes()).decode() == cases.ROWS[9][1]
    assert packing.pack(cases.empty(spark), bpe.fast_ids(PATH, PATTERN)).count() == 0

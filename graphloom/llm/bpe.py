"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a vocabulary entry. Tier two:
any other pre-token is split into bytes on a linked list, and a heap of candidate merges joins the pair of lowest rank
(leftmost on ties) until none is left. Pre-tokens come from the public pattern; special tokens are ordinary text.

Defined results: a null or empty text encodes to no ids and decodes to no bytes; texts are read whole and every
pre-token is encoded whole, whatever its length; rows are independent, so ties, repeated rows and extra columns with
any name do not matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Longest text of a remembered pre-token, and how many are remembered; both bound a worker's memory only.
MEMO_CHARS, MEMO_ENTRIES = 64, 400_000
LIBRARY_CHARS = 200_000
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash of n distinct byte strings onto 0..n-1 by hash and displace.

    Keys fall into n/3 buckets; the fullest buckets first look for a displacement that sends all their keys to free
    slots, and buckets of one key take the free slots that are left, stored as a negative displacement. A seed that
    leaves a bucket without a displacement is replaced by the next.
    """

    TRIES, BLOCK = 1 << 17, 1 << 8

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets, self.seed = len(keys), max(1, len(keys) // 3), 0
        while not self._place(keys):
            self.seed += 1

    def _place(self, keys: list[bytes]) -> bool:
        a, b, at = self._hashes(keys)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        taken = np.zeros(self.n, dtype=bool)
        for k in np.argsort(-sizes, kind="stable"):
            own = order[bounds[k] : bounds[k + 1]]
            if len(own) < 2:
                break
            d = self._displacement(a[own], b[own], taken)
            if d < 0:
                return False
            taken[(a[own] + np.uint64(d) * b[own]) % np.uint64(self.n)] = True
            self.shift[k] = d
        free = iter(np.flatnonzero(~taken))
        for k in np.flatnonzero(sizes == 1):
            self.shift[k] = -1 - next(free)
        return True

    def _displacement(self, a: np.ndarray, b: np.ndarray, taken: np.ndarray) -> int:
        for first in range(0, self.TRIES, self.BLOCK):
            d = np.arange(first, first + self.BLOCK, dtype=np.uint64)[:, None]
            slots = (a + d * b) % np.uint64(self.n)
            for row in np.flatnonzero(~taken[slots].any(axis=1)):
                if len(set(slots[row].tolist())) == len(a):
                    return first + int(row)
        return -1

    def _hashes(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.array([xxhash.xxh3_64_intdigest(x, self.seed) for x in keys], dtype=np.uint64)
        low = h & np.uint64(0xFFFFFFFF)
        high = h >> np.uint64(32)
        return low, high | np.uint64(1), ((low * np.uint64(0x9E3779B1) + high) % np.uint64(self.buckets)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of every key; of strings outside the key set, some slot."""
        a, b, at = self._hashes(keys)
        d = self.shift[at]
        hashed = (a + np.maximum(d, 0).astype(np.uint64) * b) % np.uint64(self.n)
        return np.where(d < 0, -1 - d, hashed.astype(np.int64))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by lowest-rank merges over linked bytes."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once i has been merged away
    before = list(range(-1, n))  # start of the part before the one that starts at i
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapify(heap)
    while heap:
        rank, i, stop = heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        before[stop] = i
        if stop < n:
            wider = ranks.get(piece[i : end[stop]])
            if wider is not None:
                heappush(heap, (wider, i, end[stop]))
        left = before[i]
        if left >= 0:
            wider = ranks.get(piece[left:stop])
            if wider is not None:
                heappush(heap, (wider, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encoder and decoder for one vocabulary file and pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        vocabulary = list(self.ranks)
        self.hash = PerfectHash(vocabulary)
        slots = self.hash.slots(vocabulary)
        self.keys: list[bytes] = [b""] * len(vocabulary)
        self.values = [0] * len(vocabulary)
        for slot, token in zip(slots.tolist(), vocabulary, strict=True):
            self.keys[slot], self.values[slot] = token, self.ranks[token]
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.memo: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed little-endian ids of distinct pre-tokens."""
        raw = [p.encode("utf-8") for p in pieces]
        found: dict[str, bytes] = {}
        for piece, key, slot in zip(pieces, raw, self.hash.slots(raw).tolist(), strict=True):
            ids = [self.values[slot]] if self.keys[slot] == key else merge(key, self.ranks)
            found[piece] = np.array(ids, dtype="<u4").tobytes()
        return found

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of every text as packed little-endian unsigned 32-bit integers, a group of texts at a time."""
        group: list[list[str]] = []
        weight = 0
        for text in texts:
            group.append(self.pattern.findall(text) if text else [])
            weight += len(group[-1])
            if weight > 200_000:
                yield from self._encode(group)
                group, weight = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[bytes]:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        unseen = set().union(*group).difference(self.memo) if group else set()
        long = {}
        if unseen:
            learned = self._learn(list(unseen))
            self.memo.update((k, v) for k, v in learned.items() if len(k) <= MEMO_CHARS)
            long = {k: v for k, v in learned.items() if len(k) > MEMO_CHARS}
        known = self.memo if not long else self.memo | long
        for pieces in group:
            yield b"".join(map(known.__getitem__, pieces))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's own codec; its tables are fixed by the vocabulary, whatever the number of documents."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """One row per row of docs: key, n_tokens and ids (packed little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = list(own.encode_batch(batch.column(1).to_pylist()))
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(run, f"key {kind}, n_tokens long, ids binary")
    return out.withColumnRenamed("key", key)


def round_trip(docs: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """One row per row of docs: key, n_tokens, digests of the ids and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for packed in own.encode_batch(batch.column(1).to_pylist()):
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(own.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, {RESULT}").withColumnRenamed("key", key)


def fast_ids(path: str, pattern: str):
    """A function of texts that yields their ids as arrays, for operators that take tokens as they come.

    It uses the public tokenizer library on the same vocabulary, and the codec above, which gives the same ids, for
    texts long enough to exhaust that library's regular-expression stack.
    """

    def encode_texts(texts: list[str | None]) -> Iterator[np.ndarray]:
        import tiktoken

        key = (path, pattern, "library")
        if key not in _codecs:
            _codecs[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        for text in texts:
            if text and len(text) > LIBRARY_CHARS:
                yield np.frombuffer(next(iter(codec(path, pattern).encode_batch([text]))), dtype="<u4")
            else:
                yield np.array(_codecs[key].encode_ordinary(text or ""), dtype=np.uint32)

    return encode_texts

"""Word-shingle sets of texts as 64-bit hashes, computed in numpy over whole texts."""

from __future__ import annotations

import numpy as np

U = np.uint64
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Bytes hashed at a time; a longer text is cut at white space where it has any, and read whole either way.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    folded = np.arange(256, dtype=np.uint64)
    folded[65:91] += U(32)  # A-Z
    value = mix(folded * _BASE + U(1))
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return value, space


_VALUE, _SPACE = _tables()
_INVERSE = U(pow(int(_STEP), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, BLOCK + 1), _powers(_INVERSE, BLOCK + 1)


def _block_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash sums, starts and ends of the words of a block."""
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(space.astype(np.int8)))
    starts = edges[space[edges]] + 1
    ends = edges[~space[edges]] + 1
    if len(raw) and not space[0]:
        starts = np.concatenate(([0], starts))
    if len(raw) and not space[-1]:
        ends = np.concatenate((ends, [len(raw)]))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * _UP[: len(raw)], out=total[1:])
    return (total[ends] - total[starts]) * _DOWN[starts], starts, ends


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for every word (run of bytes other than ASCII white space), letters A-Z folded."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if len(raw) <= BLOCK:
        sums, starts, ends = _block_hashes(raw)
        return mix(sums + (ends - starts).astype(np.uint64) * _BASE)
    sums, lengths, open_word = [], [], False
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        s, starts, ends = _block_hashes(part)
        n = (ends - starts).astype(np.uint64)
        if open_word and len(starts) and starts[0] == 0:  # goes on with the word that the last block ended in
            sums[-1][-1:] += s[:1] * U(pow(int(_STEP), int(lengths[-1][-1]), 1 << 64))
            lengths[-1][-1:] += n[:1]
            s, n = s[1:], n[1:]
        if len(s):
            sums.append(s)
            lengths.append(n)
        open_word = len(ends) > 0 and ends[-1] == len(part)
    if not sums:
        return np.zeros(0, dtype=np.uint64)
    return mix(np.concatenate(sums) + np.concatenate(lengths) * _BASE)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of `width` words.

    A text with fewer words has its whole word sequence as its one shingle; one without words has none.
    """
    if not text:
        return np.zeros(0, dtype=np.uint64)
    w = word_hashes(text.encode("utf-8"))
    n = len(w)
    if n == 0:
        return w
    size = min(n, width)
    h = np.full(n - size + 1, U(size * int(_BASE) & (1 << 64) - 1), dtype=np.uint64)
    for k in range(size):
        h = h * _STEP + w[k : n - size + 1 + k]
    return np.unique(mix(h))

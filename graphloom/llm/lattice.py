"""Marginal likelihood of words under a subword lattice, computed for many words at once in numpy.

A word is its characters after a boundary mark. Every piece of an existing vocabulary that matches at a position is an
arc; a character that no piece spells is one arc through its UTF-8 byte pieces. Forward (and, to estimate piece
weights, backward) recursions run in log space over all segmentations.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
MARK = "▁"
_SLOT_BITS, _FIRST_BITS = 21, 20
#: Characters up to which words of one length are batched; longer words run one by one, whole.
BATCHED = 64


def load_pieces(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces that can spell a word, their natural-log weights from the vocabulary's scores, and the byte pieces' ids.

    Scores of a merge vocabulary are minus the merge rank; they become Zipf weights 1 / (rank + 10). Scores of a
    unigram vocabulary, which fill a narrow range, are log weights already.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [
        i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    scores = np.array([model.get_score(i) for i in usable])
    ranked = scores.min() < -1000
    weights = -np.log(np.maximum(-scores, 0) + 10) if ranked else scores
    names = [model.id_to_piece(i) for i in usable]
    byte_ids = np.full(256, -1)
    for at, i in enumerate(usable):
        if model.is_byte(i):
            byte_ids[int(names[at][3:5], 16)] = at
            weights[at] = weights.min()
            names[at] = ""  # never matches as text
    return names, weights - np.log(np.exp(weights).sum()), byte_ids


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class Lattice:
    def __init__(self, names: list[str], log_weights: np.ndarray, byte_ids: np.ndarray, kind: type = np.float64):
        """kind: precision of the recursions; single precision serves to estimate weights."""
        self.byte_ids, self.kind = byte_ids, kind
        self.longest = max(map(len, names))
        by_length: dict[int, list[int]] = {}
        for i, name in enumerate(names):
            by_length.setdefault(len(name), []).append(i)
        coded = []
        for n, at in by_length.items():
            raw = "".join(names[i] for i in at).encode("utf-32-le", "surrogatepass")
            coded.append((at, np.frombuffer(raw, dtype="<u4").reshape(len(at), n).astype(np.uint64)))
        for seed in range(1, 100):
            self.step = _mix(np.array([seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1], dtype=np.uint64))[0] | U(1)
            own = np.zeros(len(names), dtype=np.uint64)
            for at, codes in coded:
                h = np.zeros(len(at), dtype=np.uint64)
                for k in range(codes.shape[1]):
                    h = h * self.step + codes[:, k] + U(1)
                own[at] = h
            own = _mix(own)
            real = np.array([bool(n) for n in names])
            slots = (own >> U(64 - _SLOT_BITS)).astype(np.int64)
            order = np.flatnonzero(real)[np.argsort(slots[real], kind="stable")]
            rank = np.arange(len(order)) - np.searchsorted(slots[order], slots[order])
            if rank.max() < 2:
                break
        self.hashes = np.append(own, U(0))
        self.ways = np.full((2, 1 << _SLOT_BITS), len(names), dtype=np.int32)
        for way in range(2):
            chosen = order[rank == way]
            self.ways[way, slots[chosen]] = chosen
        #: A first look that fits the cache: most substrings end there.
        self.first = np.zeros(1 << _FIRST_BITS, dtype=bool)
        self.first[(own[real] >> U(64 - _FIRST_BITS)).astype(np.int64)] = True
        self.set_weights(log_weights)

    def set_weights(self, log_weights: np.ndarray) -> None:
        self.log_weights = np.append(log_weights, -np.inf).astype(self.kind)
        known = self.byte_ids >= 0
        self.byte_weights = np.where(known, self.log_weights[self.byte_ids], np.log(1e-9))

    def _spelled(self, codes: np.ndarray) -> np.ndarray:
        """Weight of each character through its UTF-8 bytes."""
        unique, back = np.unique(codes, return_inverse=True)
        each = [self.byte_weights[list(chr(int(c)).encode("utf-8", "replace"))].sum() for c in unique]
        return np.array(each)[back].reshape(codes.shape)

    def arcs(self, codes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(length, row, position) ids of matching pieces, len(names) where nothing matches, and the lengths less 1.

        Only lengths that match somewhere are listed; single characters always are.
        """
        b, n = codes.shape
        none = len(self.hashes) - 1
        ids = np.full((min(self.longest, n), b, n), none, dtype=np.int32)
        h = np.zeros((b, n), dtype=np.uint64)
        for k in range(len(ids)):
            h = h[:, : n - k] * self.step + codes[:, k:] + U(1)
            final = _mix(h)
            likely = np.nonzero(self.first[(final >> U(64 - _FIRST_BITS)).astype(np.int64)])
            final = final[likely]
            slot = (final >> U(64 - _SLOT_BITS)).astype(np.int64)
            for way in self.ways:
                found = way[slot]
                hit = self.hashes[found] == final
                ids[k][likely[0][hit], likely[1][hit]] = found[hit]
        lengths = [k for k in range(len(ids)) if k == 0 or (ids[k] != none).any()]
        return ids[lengths], lengths

    def weigh(self, ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Weights of arcs, -inf where there is none; a character without a piece is spelled in bytes."""
        weights = self.log_weights[ids]
        bare = ids[0] == len(self.hashes) - 1
        if bare.any():
            weights[0][bare] = self._spelled(codes[bare])
        return weights

    def _forward(self, weights: np.ndarray, lengths: list[int]) -> np.ndarray:
        _, b, n = weights.shape
        alpha = np.full((b, n + 1), -np.inf, dtype=self.kind)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            into = np.stack([alpha[:, j - 1 - k] + weights[a, :, j - 1 - k] for a, k in enumerate(lengths) if k < j])
            top = into.max(axis=0)
            alpha[:, j] = top + np.log(np.exp(into - top).sum(axis=0))
        return alpha

    def _backward(self, weights: np.ndarray, lengths: list[int]) -> np.ndarray:
        _, b, n = weights.shape
        beta = np.full((b, n + 1), -np.inf, dtype=self.kind)
        beta[:, n] = 0
        for i in range(n - 1, -1, -1):
            out = np.stack([weights[a, :, i] + beta[:, i + 1 + k] for a, k in enumerate(lengths) if k < n - i])
            top = out.max(axis=0)
            beta[:, i] = top + np.log(np.exp(out - top).sum(axis=0))
        return beta

    @staticmethod
    def _groups(words: list[str]):
        """Indices of words of one length, at most some 2**15 characters at a time."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(i)
        for n, own in by.items():
            size = max(1, (1 << 15) // n) if n <= BATCHED else 1
            for at in range(0, len(own), size):
                yield n, own[at : at + size]

    @staticmethod
    def _codes(words: list[str], n: int) -> np.ndarray:
        raw = "".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass")
        return np.frombuffer(raw, dtype="<u4").reshape(len(words), n).astype(np.uint64)

    def log_probabilities(self, words: list[str], models: list[np.ndarray]) -> np.ndarray:
        """Natural-log marginal over all segmentations, (words, models), under each model's log weights."""
        out = np.empty((len(words), len(models)))
        for n, own in self._groups(words):
            codes = self._codes([words[i] for i in own], n)
            ids, lengths = self.arcs(codes)
            for k, log_weights in enumerate(models):
                self.set_weights(log_weights)
                out[own, k] = self._forward(self.weigh(ids, codes), lengths)[:, -1]
        return out

    def log_probability(self, words: list[str]) -> np.ndarray:
        return self.log_probabilities(words, [self.log_weights[:-1]])[:, 0]

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected uses of every piece when each word is spelled `times` times."""
        counts = np.zeros(len(self.log_weights))
        for n, own in self._groups(words):
            codes = self._codes([words[i] for i in own], n)
            ids, lengths = self.arcs(codes)
            weights = self.weigh(ids, codes)
            alpha, beta = self._forward(weights, lengths), self._backward(weights, lengths)
            share = np.log(times[own]).astype(self.kind) - alpha[:, -1]
            for a, k in enumerate(lengths):
                use = np.exp(alpha[:, : n - k] + weights[a][:, : n - k] + beta[:, k + 1 :] + share[:, None])
                counts += np.bincount(ids[a][:, : n - k].ravel(), use.ravel(), minlength=len(counts))
                if k == 0 and (bare := ids[0] == len(counts) - 1).any():
                    for c, u in zip(codes[bare], use[bare], strict=True):
                        np.add.at(counts, self.byte_ids[list(chr(int(c)).encode("utf-8", "replace"))], u)
        return counts[:-1]


def spelling_weights(names: list[str], counts: np.ndarray, prior: np.ndarray, words: float) -> tuple[np.ndarray, float]:
    """Natural-log arc weights, and the weight of ending a word, that make spellings a distribution over words.

    Pieces that begin a word share one distribution, all other pieces another; after each piece the word ends with the
    rate at which training words do. `prior` (log weights) keeps unused pieces possible.
    """
    first = np.array([n.startswith(MARK) for n in names])
    smooth = counts + 50 * np.exp(prior)
    end = min(0.9, max(0.05, words / smooth.sum()))
    weights = np.empty(len(names))
    weights[first] = np.log(smooth[first] / smooth[first].sum())
    weights[~first] = np.log(smooth[~first] / smooth[~first].sum()) + np.log1p(-end)
    return weights, float(np.log(end))

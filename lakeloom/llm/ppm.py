"""Prediction by partial matching over bytes, as sorted arrays of a trie."""

from __future__ import annotations

import numpy as np

#: Bytes that never occur in UTF-8: the padding before a text and its end.
PAD, END = 0xFE, 0xFF
#: Positions that are handled at a time.
CHUNK = 1 << 20
_FIBONACCI = np.uint64(0x9E3779B97F4A7C15)


def stream(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after ``order`` PADs and before an END; and the place after each END."""
    pad, end = bytes([PAD]) * order, bytes([END])
    flat = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
    return flat, np.cumsum(np.fromiter((len(t) + order + 1 for t in texts), np.int64, len(texts)))


def grams(flat: np.ndarray, order: int) -> np.ndarray:
    """Codes of the symbol at each place from ``order`` on and the ``order`` bytes before it."""
    out = np.zeros(max(0, len(flat) - order), np.uint64)
    for k in range(order + 1):
        out <<= np.uint64(8)
        out |= flat[k : k + len(out)]
    return out


def count_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of all texts and how often each occurs."""
    flat, _ = stream(texts, order)
    codes, counts = [], []
    for start in range(0, max(1, len(flat) - order), CHUNK):
        own = grams(flat[start : start + CHUNK + order], order)
        a, b = np.unique(own[(own & np.uint64(0xFF)) != PAD], return_counts=True)
        codes.append(a)
        counts.append(b)
    return add_up(np.concatenate(codes), np.concatenate(counts))


def add_up(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sums of their counts."""
    if not len(codes):
        return codes, counts
    by = np.argsort(codes, kind="stable")
    codes, counts = codes[by], counts[by]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(counts, first)


class _Hash:
    """Open addressing over distinct codes: the index of each, or -1."""

    def __init__(self, codes: np.ndarray):
        bits = max(4, int(2 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.index = np.full(1 << bits, -1, np.int32)
        self.codes = codes
        left, slot = np.arange(len(codes), dtype=np.int32), self._slot(codes)
        while len(left):
            free = self.index[slot] < 0
            self.index[slot[free]] = left[free]  # of several for one slot, the last stays
            lost = self.index[slot] != left
            left, slot = left[lost], slot[lost] + 1 & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _FIBONACCI >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slot(codes)
        out = self.index[slot]
        if not len(self.codes):
            return out
        left = np.flatnonzero((out >= 0) & (self.codes[out] != codes))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            out[left] = self.index[slot[left]]
            left = left[(out[left] >= 0) & (self.codes[out[left]] != codes[left])]
        return out


class Known:
    """Values of distinct codes, each in a slot of its own."""

    #: No code: the end of a text has no byte like it before it.
    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.codes, self.values = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits)
        left, slot = np.arange(len(codes)), self._slot(codes)
        while len(left):
            free = self.codes[slot] == self.EMPTY
            self.codes[slot[free]] = codes[left[free]]  # of several for one slot, the last stays
            here = self.codes[slot] == codes[left]
            self.values[slot[here]] = values[left[here]]
            left, slot = left[~here], slot[~here] + 1 & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _FIBONACCI >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each code, and which codes have none."""
        slot = self._slot(codes)
        there = self.codes[slot]
        out, absent = self.values[slot], there == self.EMPTY
        left = np.flatnonzero((there != codes) & ~absent)
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            there = self.codes[slot[left]]
            out[left], absent[left] = self.values[slot[left]], there == self.EMPTY
            left = left[(there != codes[left]) & (there != self.EMPTY)]
        return out, absent

    def share(self, texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the sum of the known values, and (text, code, times) of its other n-grams, in order of text."""
        flat, ends = stream(texts, order)
        of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[order:]
        total, rest_of, rest = np.zeros(len(texts)), [of[:0]], [np.zeros(0, np.uint64)]
        for start in range(0, max(1, len(flat) - order), CHUNK):
            codes = grams(flat[start : start + CHUNK + order], order)
            real = (codes & np.uint64(0xFF)) != PAD
            codes, text = codes[real], of[start : start + CHUNK][real]
            value, absent = self.find(codes)
            value[absent] = 0
            total += np.bincount(text, value, len(texts))
            rest_of.append(text[absent])
            rest.append(codes[absent])
        text, codes = np.concatenate(rest_of), np.concatenate(rest)
        by = np.lexsort((codes, text))
        text, codes = text[by], codes[by]
        first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (codes[1:] != codes[:-1])))[: len(text)])
        return total, text[first], codes[first], np.diff(np.append(first, len(text)))


class Model:
    """Probabilities of bytes after the ``order`` bytes before them.

    Level k of the trie holds the contexts of k bytes and the symbols seen
    after each. With n occurrences of a context and d distinct symbols after
    it, a symbol seen c times has (c - 1/2) / n and the escape to the context
    without its first byte d / 2n (method D). There, symbols that the longer
    context has seen are excluded from n and d. Below the top level, c is the
    number of longer contexts that the symbol follows (update exclusion).
    After the empty context, what remains of the 256 bytes is equally likely.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, lower: tuple[int, np.ndarray, np.ndarray] | None = None):
        """``lower`` has a level and its sorted codes and counts, where ``codes`` aren't all there are.

        The levels above it are then whole for contexts of which ``codes`` has
        all that end with the same ``level + 1`` bytes.
        """
        self.order = order
        self.symbols: list[_Hash] = [None] * (order + 1)
        self.contexts: list[_Hash] = [None] * (order + 1)
        self.log_count: list[np.ndarray] = [None] * (order + 1)
        #: Of a context: logs of n and of d / 2n; and of n and d of the next shorter one without its symbols.
        self.log_all, self.log_escape = [None] * (order + 1), [None] * (order + 1)
        self.log_rest, self.log_rest_escape = [None] * (order + 1), [None] * (order + 1)
        levels = [(codes, counts)]
        for k in range(order, 0, -1):
            codes, counts = lower[1:] if lower and lower[0] == k - 1 else add_up(codes & np.uint64((1 << 8 * k) - 1), np.ones_like(counts))
            levels.append((codes, counts))
        levels.reverse()
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        for k, (codes, counts) in enumerate(levels):
            contexts, first = np.unique(codes >> np.uint64(8), return_index=True)
            n = np.add.reduceat(counts, first) if len(first) else counts[:0]
            d = np.diff(np.append(first, len(codes)))
            sums.append((n, d))
            self.symbols[k], self.contexts[k] = _Hash(codes), _Hash(contexts)
            self.log_count[k] = np.log10(counts - 0.5)
            self.log_all[k] = np.log10(n)
            self.log_escape[k] = np.log10(d / 2) - self.log_all[k]
            if k:
                below = np.searchsorted(levels[k - 1][0], codes & np.uint64((1 << 8 * k) - 1))
                parent = np.searchsorted(self.contexts[k - 1].codes, contexts & np.uint64((1 << 8 * (k - 1)) - 1))
                seen = np.add.reduceat(levels[k - 1][1][below], first) if len(first) else counts[:0]
                n_rest, d_rest = sums[k - 1][0][parent] - seen, sums[k - 1][1][parent] - d
                some = d_rest > 0  # if no symbol is left, the escape is certain
                self.log_rest[k] = np.where(some, np.log10(np.maximum(n_rest, 1)), 0.0)
                self.log_rest_escape[k] = np.where(some, np.log10(np.maximum(d_rest, 1) / 2) - self.log_rest[k], 0.0)
        seen = len(levels[0][0])
        self.log_unseen = -np.log10(max(1, 256 - seen))
        #: Most symbols are found at the top level, which needs one look-up.
        self.top = (self.log_count[order] - self.log_all[order][np.repeat(np.arange(len(sums[order][1])), sums[order][1])]).astype(np.float32)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after its context."""
        at = self.symbols[self.order].find(codes)
        out = np.where(at >= 0, self.top[at] if len(self.top) else 0.0, 0.0).astype(np.float64)
        left = np.flatnonzero(at < 0)
        longer = np.full(len(left), -1)
        for k in range(self.order, -1, -1):
            own = codes[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            context = self.contexts[k].find(own >> np.uint64(8)) if k < 8 else None
            after = longer >= 0
            if k < self.order:
                symbol = self.symbols[k].find(own)
                found = symbol >= 0
                below = self.log_all[k][context[found]] if len(self.log_all[k]) else np.zeros(0)
                if k + 1 <= self.order and len(self.log_rest[k + 1]):
                    below = np.where(after[found], self.log_rest[k + 1][longer[found]], below)
                out[left[found]] += self.log_count[k][symbol[found]] - below
            else:
                found = np.zeros(len(left), bool)
            known = (context >= 0) & ~found
            escape = np.zeros(len(left))
            if len(self.log_escape[k]):
                escape = np.where(known, self.log_escape[k][context], 0.0)
            if k < self.order and len(self.log_rest_escape[k + 1]):
                escape = np.where(after & ~found, self.log_rest_escape[k + 1][longer], escape)
            out[left] += np.where(found, 0.0, escape)
            left, longer = left[~found], context[~found]
        out[left] += self.log_unseen
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text and its end."""
        flat, ends = stream(texts, self.order)
        out = np.zeros(len(texts))
        for start in range(0, max(1, len(flat) - self.order), CHUNK):
            codes = grams(flat[start : start + CHUNK + self.order], self.order)
            at = np.flatnonzero((codes & np.uint64(0xFF)) != PAD)
            text = np.searchsorted(ends, at + start + self.order, "right")
            out += np.bincount(text, self.log10(codes[at]), len(texts))
        return out

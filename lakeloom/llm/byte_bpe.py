"""Byte-level BPE by a queue of ranks over a hierarchical bitmap, and decoding."""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import slices

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pre-tokens whose ids a worker remembers, twice over, and characters up to which it does.
CACHE, CACHED = 350_000, 48
#: Bytes from which a pre-token's first pairs are sorted into buckets by array operations.
LARGE = 256
#: Characters of a text from which its pre-tokens are taken a few at a time, and how many.
LONG, FEW = 1 << 20, 1 << 16


class RankSet:
    """A set of ranks as bits; a bit above tells whether any of 256 below is set."""

    def __init__(self, ranks: int):
        self.words = [0] * ((ranks >> 8) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        word = rank >> 8
        self.words[word] |= 1 << (rank & 255)
        self.top |= 1 << word

    def discard(self, rank: int) -> None:
        word = rank >> 8
        self.words[word] &= ~(1 << (rank & 255))
        if not self.words[word]:
            self.top &= ~(1 << word)

    def first(self) -> int:
        """The least rank, by finding the first bit set on either level; -1 if there is none."""
        if not self.top:
            return -1
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        return word << 8 | (bits & -bits).bit_length() - 1


class _Buckets:
    """Positions by rank: those of the first pairs as sorted slices of one array, later ones in a heap each."""

    def __init__(self, ranks: RankSet):
        self.ranks, self.later = ranks, {}
        self.sorted: dict[int, tuple[int, int]] = {}
        self.order = array("i")

    def fill(self, pair: np.ndarray) -> None:
        """Takes all positions of ``pair`` with a rank, in order."""
        has = np.flatnonzero(pair >= 0)
        by = has[np.argsort(pair[has], kind="stable")].astype(np.int32)
        self.order.frombytes(by.tobytes())
        ranks, start = np.unique(pair[by], return_index=True)
        for rank, a, b in zip(ranks.tolist(), start.tolist(), [*start.tolist(), len(by)][1:], strict=True):
            self.sorted[rank] = (a, b)
            self.ranks.add(rank)

    def push(self, rank: int, at: int) -> None:
        if (heap := self.later.get(rank)) is None:
            self.later[rank] = [at]
            self.ranks.add(rank)
        else:
            heappush(heap, at)

    def pop(self, rank: int) -> int:
        """The leftmost position of a rank that the set holds."""
        heap, begun = self.later.get(rank), self.sorted.get(rank)
        if begun is None or heap and heap[0] < self.order[begun[0]]:
            at = heappop(heap)
            if not heap:
                del self.later[rank]
        else:
            a, b = begun
            at = self.order[a]
            if a + 1 < b:
                self.sorted[rank] = (a + 1, b)
            else:
                del self.sorted[rank]
        if rank not in self.later and rank not in self.sorted:
            self.ranks.discard(rank)
        return at


class _Known(dict):
    """Ids of pre-tokens, as little-endian unsigned 32-bit integers.

    When it is full it becomes the older of two generations, and what is met
    in that moves to the newer, so that frequent pre-tokens stay.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        if (out := self.older.get(piece)) is None:
            ids = self.encoder.encode_piece(piece.encode("utf-8", "replace"))
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Encodes texts by the ranks of a file of base64 tokens, and decodes ids.

    Each match of the pattern is a pre-token of its own. Its bytes are a
    linked list of tokens. Every neighbouring pair that is a token when
    joined has its position in the bucket of that token's rank; the least
    rank with a bucket is found by two find-first-set steps, its leftmost
    position is joined, and the pairs on either side go to new buckets. What
    their positions say in the old ones is stale and is skipped when it comes
    up. So a pre-token of n bytes takes a few steps for each byte, however
    long it is.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.set = RankSet(len(self.tokens))
        pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.pairs, self.pairs_list = np.array(pairs, np.int32), pairs
        self.known = _Known(self)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; one that is a token has its rank."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None or not n:
            return [whole] if n else []
        if n < LARGE:
            return self._encode_short(piece)
        buckets = _Buckets(self.set)
        flat = np.frombuffer(piece, np.uint8).astype(np.int32)
        first = np.concatenate((self.pairs[flat[:-1] << 8 | flat[1:]], np.array([-1], np.int32)))
        buckets.fill(first)
        places = np.arange(n, dtype=np.int32)
        after, before, pair = (array("i", x.tobytes()) for x in (places + 1, places - 1, first))
        next_rank = self.set.first
        while (rank := next_rank()) >= 0:
            at = buckets.pop(rank)
            if pair[at] != rank:
                continue  # stale: the pair here has changed since
            gone = after[at]
            end = after[gone]
            after[at], pair[gone], pair[at] = end, -1, -1
            if end < n:
                before[end] = at
                if (joined := ranks.get(piece[at : after[end]])) is not None:
                    pair[at] = joined
                    buckets.push(joined, at)
            if (left := before[at]) >= 0:
                if (joined := ranks.get(piece[left:end])) is not None:
                    pair[left] = joined
                    buckets.push(joined, left)
                else:
                    pair[left] = -1
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def _encode_short(self, piece: bytes) -> list[int]:
        """The same for a few bytes, the queue's steps written out: most of a corpus' new pre-tokens pass here."""
        ranks, words, top, n = self.ranks, self.set.words, 0, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [self.pairs_list[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)] + [-1]
        buckets: dict[int, list[int]] = {}
        for at, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(at)
                else:
                    buckets[rank] = [at]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            low = top & -top
            word = low.bit_length() - 1
            bits = words[word]
            bit = bits & -bits
            rank = word << 8 | bit.bit_length() - 1
            heap = buckets[rank]
            if len(heap) > 1:
                at = heappop(heap)
            else:
                at = heap[0]
                del buckets[rank]
                words[word] = bits = bits ^ bit
                if not bits:
                    top ^= low
            if pair[at] != rank:
                continue
            gone = after[at]
            end = after[gone]
            after[at], pair[gone], pair[at] = end, -1, -1
            if end < n:
                before[end] = at
            left = before[at]
            for start, stop in ((at, after[end] if end < n else 0), (left, end if left >= 0 else 0)):
                if stop:
                    joined = ranks.get(piece[start:stop], -1)
                    pair[start] = joined
                    if joined >= 0:
                        if joined in buckets:
                            heappush(buckets[joined], start)
                        else:
                            buckets[joined] = [start]
                            words[joined >> 8] |= 1 << (joined & 255)
                            top |= 1 << (joined >> 8)
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        ids = self.known.__getitem__
        if len(text) < LONG:
            return b"".join(map(ids, self.pattern.findall(text)))
        matches = (m.group() for m in self.pattern.finditer(text))
        out = bytearray()
        while few := list(islice(matches, FEW)):
            out += b"".join(map(ids, few))
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens, one after the other."""
        own = np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(self.tokens.__getitem__, own[k : k + FEW].tolist())) for k in range(0, len(own), FEW))


#: The encoder of each (file, pattern) that a worker has used.
_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _mapped(docs: DataFrame, column: str, name: str, kind: pa.DataType, make) -> DataFrame:
    own = docs.drop(name).withColumn(name, F.lit(None).cast("binary"))
    at = own.columns.index(own.select(column).columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches):
            out = pa.array([work(x) for x in part.column(at).cast(kind).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], out], schema=part.schema)

    return own.mapInArrow(run, own.schema)


def encode_texts(docs: DataFrame, *, text_col: str = "text", name: str = "ids", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the ids of each text, little-endian unsigned 32-bit integers in a binary column.

    Texts are encoded whole, row by row, without special tokens and without
    any exchange, so no row waits for another; the rows of a task share what
    pre-tokens it has met, twice ``CACHE`` at most. A null or empty text has no ids
    (an empty value, not null). A column ``name`` is replaced; others stay,
    whatever their names. An empty table stays empty; repeated rows are
    encoded alike. Of very long texts a few pre-tokens are held at a time,
    and one pre-token takes about 40 bytes of memory for each of its own.
    """
    return _mapped(docs, text_col, name, pa.string(), lambda: (lambda e: lambda t: e.encode(t or ""))(_encoder(ranks, pattern)))


def decode_ids(encoded: DataFrame, *, ids_col: str = "ids", name: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; null ids are none, an id that the file lacks raises."""
    return _mapped(encoded, ids_col, name, pa.binary(), lambda: (lambda e: lambda i: e.decode(i or b""))(_encoder(ranks, PATTERN)))

"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeloom.llm.common import LOWER, slices, stage, utf8

CAPACITY = 4096
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Distinct units whose ids a Python worker remembers.
CACHE = 700_000
Pattern = tuple[tuple[int, ...], int]


class LengthIndex:
    """Counts by length, and the sums of one, two and three lengths at hand.

    A bit mask holds the lengths that are left and a second one the same
    mirrored. Shifted by a gap, their conjunction has a bit for every length
    whose complement is left too, so a pair sum is looked up in one step and
    a triple sum in one step for each first length.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity = dict(counts), capacity
        self.mask = sum(1 << n for n, c in counts.items() if c)
        self.mirror = sum(1 << (capacity - n) for n, c in counts.items() if c)

    def take(self, lengths: tuple[int, ...], copies: int) -> None:
        for n in lengths:
            self.left[n] -= copies
            if not self.left[n]:
                self.mask &= ~(1 << n)
                self.mirror &= ~(1 << (self.capacity - n))

    def copies(self, lengths: tuple[int, ...]) -> int:
        """How often these lengths can be taken together."""
        return min(self.left.get(n, 0) // c for n, c in Counter(lengths).items())

    def _pairs(self, total: int, first: tuple[int, ...]) -> tuple[int, ...] | None:
        bits = self.mask & (self.mirror >> (self.capacity - total)) & ((1 << total) - 1)
        while bits:
            a = bits.bit_length() - 1
            if 2 * a < total:
                return None
            if self.copies((*first, a, total - a)):
                return (*first, a, total - a)
            bits ^= 1 << a
        return None

    def filling(self, first: int) -> tuple[int, ...] | None:
        """``first`` and one, two or three lengths that fill it up exactly."""
        gap = self.capacity - first
        if not gap:
            return (first,)
        if self.copies((first, gap)):
            return (first, gap)
        if found := self._pairs(gap, (first,)):
            return found
        bits = self.mask & ((1 << gap) - 1)
        while bits:
            a = bits.bit_length() - 1
            if 3 * a < gap:
                return None
            if found := self._pairs(gap - a, (first, a)):
                return found
            bits ^= 1 << a
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """(lengths, copies) of sequences that use up all ``counts``.

    From the longest down, lengths are completed to exactly ``capacity`` as
    often as counts allow; what can't be completed is packed best-fit
    decreasing. The work and the result depend on the number of distinct
    lengths, not on how many pieces have them.
    """
    index, done = LengthIndex({n: c for n, c in counts.items() if c}, capacity), []
    for n in sorted(index.left, reverse=True):
        while index.left[n] and (found := index.filling(n)):
            copies = index.copies(found)
            index.take(found, copies)
            done.append((found, copies))
    return done + _best_fit({n: c for n, c in index.left.items() if c}, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over groups of bins with equal content."""
    open_bins: dict[int, list[Pattern]] = {}
    gaps = 0
    full: list[Pattern] = []

    def put(content: tuple[int, ...], gap: int, copies: int) -> int:
        if not gap:
            full.append((content, copies))
            return 0
        open_bins.setdefault(gap, []).append((content, copies))
        return 1 << gap

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            if fitting := gaps >> n << n:
                gap = (fitting & -fitting).bit_length() - 1
                content, copies = open_bins[gap].pop()
                used = min(copies, left)
                if used < copies:
                    open_bins[gap].append((content, copies - used))
                if not open_bins[gap]:
                    gaps &= ~(1 << gap)
                gaps |= put((*content, n), gap - n, used)
                left -= used
            else:
                each = capacity // n
                if left >= each:
                    gaps |= put((n,) * each, capacity - n * each, left // each)
                    left %= each
                if left:
                    gaps |= put((n,) * left, capacity - n * left, 1)
                    left = 0
    return full + [p for bins in open_bins.values() for p in bins]


class Runs:
    """Places for the pieces of each length, in the order of their rank."""

    def __init__(self, patterns: list[Pattern]):
        rows, base = [], 0
        for lengths, copies in patterns:
            at = 0
            for n in lengths:
                rows.append((n, base, at, copies))
                at += n
            base += copies
        own = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.sequences = base
        self.sequence, self.offset = own[:, 1], own[:, 2]
        self.ends = np.cumsum(own[:, 3])
        self.starts = self.ends - own[:, 3]
        lengths, first = np.unique(own[:, 0], return_index=True)
        self.before = np.zeros(lengths.max(initial=0) + 1, np.int64)
        self.before[lengths] = self.starts[first]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset by length and the rank among its pieces."""
        rank = self.before[length] + rank
        k = np.searchsorted(self.ends, rank, "right")
        return self.sequence[k] + rank - self.starts[k], self.offset[k]


class Encoder:
    """Ids of whole texts, put together from those of their words.

    The tokenizer drops white space, lower-cases, and never joins letters or
    digits with other signs, so a text's ids are those of its units: runs of
    letters and digits, and runs of ASCII signs. A chunk between white space
    that holds an apostrophe (it may begin an English ending) or a character
    whose class isn't plain from its bytes is one unit. Units are found and
    looked up by array operations over a slice of texts: a unit of up to 23
    bytes is its own key, three words of 64 bits with the length in the last
    byte. New ones are encoded by the tokenizer, those of letters only in one
    call, told apart by the tokens that end a word. After ``CACHE`` units the
    table begins anew.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # what it would remember is known here
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros((3, 2 * CACHE), np.uint64)
        self.slots = np.full(2 * CACHE, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.ids, self.begin, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.units = self.used = 0

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # The tokenizer's special strings are matched as they are written.
        plain = [b"" if not t or b"<|" in t else t for t in texts]
        out = self._plain(plain)
        for k, t in enumerate(texts):
            if t and b"<|" in t:
                out[k] = np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        if self.units > CACHE:
            self._clear()
        raw = b"\n".join(texts).translate(LOWER) + b"\n" + bytes(32)
        flat = np.frombuffer(raw, np.uint8)[:-32]
        starts, ends = _units(flat)
        index = self._find(raw, starts, ends)
        count = self.count[index]
        upto = np.cumsum(count)
        own = self.ids[np.repeat(self.begin[index] - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)]
        after = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        cuts = np.concatenate(([0], upto))[np.searchsorted(starts, after)] * 4
        whole, cuts = own.astype("<u4").tobytes(), cuts.tolist()
        return [whole[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _find(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The index of each unit, after learning the new ones."""
        size = ends - starts
        words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        keys = [words[starts + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)] for k in range(3)]
        keys[2] |= size.astype(np.uint64) << np.uint64(56)
        index, slot = self._look_up(*keys)
        long = size > 23
        index[long] = [self.long.get(raw[a:b], -1) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        new = np.flatnonzero((index < 0) & ~long)
        if len(new):
            by = new[np.lexsort([k[new] for k in keys])]
            first = np.concatenate(([True], np.any([k[by[1:]] != k[by[:-1]] for k in keys], axis=0)))
            one = by[first]
            known = self._learn([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            self._insert([k[one] for k in keys], slot[one], known)
            index[by] = known[np.cumsum(first) - 1]
        if len(rest := np.flatnonzero((index < 0) & long)):
            found = [raw[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            fresh = list(dict.fromkeys(found))
            self.long.update(zip(fresh, self._learn(fresh).tolist(), strict=True))
            index[rest] = [self.long[u] for u in found]
        return index

    def _look_up(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices, -1 where unknown, and the slots where the search ended."""
        slot = ((a * _MIX[0] ^ b * _MIX[1] ^ c * _MIX[2]) * _MIX[3] >> np.uint64(20)).astype(np.int64) % len(self.slots)
        out, left = self.slots[slot], np.arange(len(slot))
        while len(left):
            at = slot[left]
            left = left[(out[left] >= 0) & ((self.keys[0][at] != a[left]) | (self.keys[1][at] != b[left]) | (self.keys[2][at] != c[left]))]
            slot[left] = (slot[left] + 1) % len(self.slots)
            out[left] = self.slots[slot[left]]
        return out, slot

    def _insert(self, keys: list[np.ndarray], slot: np.ndarray, index: np.ndarray) -> None:
        if 2 * self.units > len(self.slots):  # a slice of very many new units
            has = np.flatnonzero(self.slots >= 0)
            keys = [np.concatenate((own[has], k)) for own, k in zip(self.keys, keys, strict=True)]
            index = np.concatenate((self.slots[has], index))
            self.keys = np.zeros((3, 4 * self.units), np.uint64)
            self.slots = np.full(4 * self.units, -1, np.int32)
            slot = self._look_up(*keys)[1]
        left = np.arange(len(slot))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = index[free]  # of several for one slot, the last stays
            for own, k in zip(self.keys, keys, strict=True):
                own[slot[free]] = k[free]
            lost = self.slots[slot[left]] != index[left]
            if lost.any():  # the keys of a slot must be those of the unit that has it
                held = left[~lost]
                for own, k in zip(self.keys, keys, strict=True):
                    own[slot[held]] = k[held]
            left = left[lost]
            slot[left] = (slot[left] + 1) % len(self.slots)

    def _learn(self, units: list[bytes]) -> np.ndarray:
        """Encodes new units and gives their indices."""
        alpha = [u.isalpha() or not u.isascii() and u.decode().isalpha() for u in units]
        words = [k for k, a in enumerate(alpha) if a]
        rest = [k for k, a in enumerate(alpha) if not a]
        counts, found = np.zeros(len(units), np.int32), []
        order: list[int] = []
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join([units[k] for k in words]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.word_end[ids]) + 1
            if len(cuts) == len(words) and cuts[-1] == len(ids):
                counts[words] = np.diff(cuts, prepend=0)
                found.append(ids)
                order += words
            else:  # a word that normalises to several
                rest += words
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([units[k].decode() for k in rest], add_special_tokens=False), strict=True):
            found.append(np.array(e.ids, np.uint32))
            counts[k] = len(e.ids)
        order += rest
        own = np.concatenate(found) if found else np.zeros(0, np.uint32)
        begin = np.zeros(len(units), np.int64)
        begin[order] = self.used + np.cumsum(counts[order]) - counts[order]
        n, used = self.units + len(units), self.used + len(own)
        while len(self.count) < n:
            self.count, self.begin = np.concatenate((self.count, self.count * 0)), np.concatenate((self.begin, self.begin * 0))
        while len(self.ids) < used:
            self.ids = np.concatenate((self.ids, self.ids * 0))
        index = np.arange(self.units, n, dtype=np.int32)
        self.count[index], self.begin[index], self.ids[self.used : used] = counts, begin, own
        self.units, self.used = n, used
        return index


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Odd numbers that mix the bits of a key.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Of bytes: 0 ASCII white space, 1 letters, digits and all beyond ASCII, 2 other signs, 3 the apostrophe.
_CLASS = np.array([0 if b in (9, 10, 11, 12, 13, 32) else 3 if b == 39 else 1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


@cache
def _odd() -> np.ndarray:
    """Of a first byte beyond ASCII and the next, as a 16-bit number: whether the character may be no letter or digit.

    Of two bytes, it is one if it and what it normalises and lower-cases to
    are. Of three, those of U+4000 to U+9FFF but for U+4DC0 to U+4DFF are.
    """
    out = np.zeros((256, 256), bool)
    out[0xC2:] = True
    for c in range(0x80, 0x800):
        a, b = chr(c).encode()
        out[a, b] = not (chr(c).isalnum() and unicodedata.normalize("NFC", chr(c)).lower().isalnum())
    out[0xE4:0xEA] = False
    out[0xE4, 0xB7] = True
    return out.ravel()


def _units(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of lower-cased UTF-8 that ends in white space begin and end."""
    kind = _CLASS[flat]
    inside = kind > 0
    before = np.concatenate(([False], inside[:-1]))
    chunk = inside & ~before
    cut = np.concatenate(([False], kind[1:] != kind[:-1])) & inside
    whole = np.flatnonzero(kind == 3)
    lead = np.flatnonzero(flat >= 0xC2)
    if len(lead):
        lead = lead[_odd()[flat[lead].astype(np.int64) << 8 | flat[lead + 1]]]
    if len(whole) or len(lead):
        of = np.cumsum(chunk) - 1
        held = np.zeros(of[-1] + 1, bool)
        held[of[whole]] = held[of[lead]] = True
        cut &= ~held[of]
    begins = chunk | cut
    after = np.concatenate((~inside[1:] | begins[1:], [True]))
    return np.flatnonzero(begins), np.flatnonzero(inside & after) + 1


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        part_id, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for part in slices(batches):
            rows: list[tuple] = []
            for at, ids in enumerate(encode(utf8(part.column(1)))):
                ids += end
                for piece, start in enumerate(range(0, len(ids), step)):
                    own = ids[start : start + step]
                    n = len(own) // 4
                    rows.append((at, piece, start // 4, n, zlib.crc32(own), seen[n]))
                    seen[n] += 1
            at, piece, start, length, crc, rank = np.array(rows, np.int64).T
            arrays = [part.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc)), pa.array(np.full(len(at), part_id, np.int32)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence.

    A text's ids (none for a null or empty text) are followed by ``end_id``;
    longer documents are cut into pieces of ``capacity`` ids. Columns:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Ids may be
    null or repeat: every row of ``docs`` has its own pieces. Long texts are
    encoded whole; an empty table gives no rows; other columns aren't used,
    whatever their names.

    Pieces are counted by length, at most ``capacity`` numbers, and the
    driver plans over these counts alone. A piece then finds its place by its
    rank among those of its length: the rank within its task, taken while
    texts are read, plus the ranks used up by the tasks before. No length,
    however frequent, is gathered anywhere.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stage(own.mapInArrow(_pieces(tokenizer, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long"), "pieces")
    counts = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = docs.sparkSession.sparkContext.broadcast(Runs(plan(by_length, capacity)))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(earlier, F.lit(0)).cast("long").alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sequence, offset = runs.value.place(x["length"].to_numpy(), x["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(sequence), pa.array(offset)], [*x.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

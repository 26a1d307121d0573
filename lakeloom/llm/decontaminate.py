"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import slices, spare, stage, utf8

#: Words of a window.
WINDOW = 13
#: Bytes of a benchmark's distinct texts and their ids up to which every task gets them, and ids of a text that go together.
BENCHMARK_BYTES, IDS = 2 << 20, 4096
#: Of a larger one: places of a shift table and bits for hashes of windows, as powers of two.
SHIFT_BITS, FILTER_BITS = 18, 27
#: Distinct words whose hashes a task remembers.
_WORDS = 200_000
#: Odd numbers that mix hashes.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: A-Z lower-cased, every other ASCII byte but 0-9 and a-z a space.
_WORD_BYTES = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(_WORD_BYTES).split()


class WuManber:
    """Finds all occurrences of windows of ``m`` words.

    Blocks are pairs of words (single words if m is 1). A block's shift is
    its distance from the end of the nearest window that holds it; a block of
    no window lets the search move past all positions it touches. A block of
    shift 0 is a suffix: its bucket holds the windows that end so, and a
    direct comparison with these confirms an occurrence.
    """

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], m: int):
        self.m, self.b = m, min(2, m)
        self.shift: dict[bytes | tuple, int] = {}
        self.bucket: dict[bytes | tuple, dict[tuple, tuple[str, ...]]] = defaultdict(dict)
        for window, items in windows.items():
            for end in range(self.b, m + 1):
                block = window[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, m), m - end)
            self.bucket[window[m - self.b :]][window] = tuple(items)

    def find(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged (start, end) word spans and the ids of items that occur."""
        m, b, shift, free = self.m, self.b, self.shift.get, self.m - self.b + 1
        spans: list[list[int]] = []
        items: set[str] = set()
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b : end])
            if step := shift(block, free):
                end += step
                continue
            if (found := self.bucket[block].get(tuple(words[end - m : end]))) is not None:
                items.update(found)
                if spans and spans[-1][1] >= end - m:
                    spans[-1][1] = end
                else:
                    spans.append([end - m, end])
            end += 1
        return spans, items


def matchers(items: list[tuple[str | int | None, bytes | None]], window: int = WINDOW) -> list[WuManber]:
    """A search for each length of window that the items have."""
    by_length: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
    for name, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for start in range(len(words) - m + 1 if m else 0):
            by_length[m][tuple(words[start : start + m])] |= {name} - {None}
    return [WuManber(windows, m) for m, windows in by_length.items()]


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``bench_words``, ``bench_spans`` and ``bench_items``.

    These are the number of words, the merged (start, end) word positions
    that lie in an occurrence of a window, and the sorted ids, as text, of
    the items with an occurring window. An item of fewer than ``window``
    words is one window. Every row of ``docs`` is returned once, with all its
    columns (columns of the three names are replaced).

    Equal item texts are one, with a list of ids, of which ``IDS`` or so go
    together. A benchmark of up to ``BENCHMARK_BYTES`` of these is searched
    for in one pass that shuffles nothing. Of a larger one tasks get what has
    a fixed size, whatever the benchmark's: a shift table by hashes of blocks
    and a bit for each hash of a window. Positions that these leave are
    joined with the windows themselves by their hashes and compared with
    them, and the hits of a row come together. So texts are read once for
    the search and once for the result, however large the benchmark is, and
    however often a text or a window is in it.

    Null or wordless texts have no spans and no items, and without items no
    text has any. An item without id marks words but isn't listed; repeated
    items count once. Long texts are searched whole; an empty table of
    documents stays empty.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    chunks = items.groupBy("text").agg(F.ceil(F.count("*") / IDS).alias("n")).withColumnRenamed("text", "t")
    grouped = items.join(chunks, F.col("text") == F.col("t")).groupBy("text", F.pmod(F.xxhash64("id"), F.col("n")).alias("chunk")).agg(F.collect_list("id").alias("ids"))
    grouped = stage(grouped.withColumn("size", F.octet_length("text").cast("long") + 16 * F.size("ids")), "items")
    total = grouped.agg(F.sum("size")).first()[0] or 0
    own = docs.drop("bench_words", "bench_spans", "bench_items")
    result = own.withColumns({"bench_words": F.lit(0).cast("long"), "bench_spans": F.expr(f"cast(array() as {_SPANS})"), "bench_items": F.expr("cast(array() as array<string>)")}).schema
    if total <= BENCHMARK_BYTES:
        sent = spark.sparkContext.broadcast([(r.ids, r.text.encode()) for r in grouped.collect()])
        return own.mapInArrow(_search(sent, own.columns.index(text_col), window), result)
    row = spare(own, "row")
    kept = stage(own.withColumn(row, F.monotonically_increasing_id()), "documents")
    met = _joined(kept.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")), grouped, window)
    number, spans, names = (spare(own, x) for x in ("number", "spans", "names"))
    met = met.select(F.col("row").alias(number), F.col("spans").alias(spans), F.col("names").alias(names))
    joined = kept.join(met, F.col(row) == F.col(number), "left").drop(row, number).select(*own.columns, spans, names)
    return joined.mapInArrow(_together(own.columns.index(text_col)), result)


_SPANS = "array<struct<start:int,end:int>>"
#: The searches of the benchmark used last, by a key made for each broadcast; a Python worker serves many tasks.
_built: dict[str, tuple[list[WuManber], list[list[str | None]]]] = {}


def _search(block, text_at: int, window: int):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = matchers(list(enumerate(text for _, text in block.value)), window), [ids for ids, _ in block.value]
        tables, ids_of = _built[key]
        for part in slices(batches):
            counts, spans, names = [], [], []
            for text in utf8(part.column(text_at)):
                words = words_of(text)
                found, items = [], set()
                for table in tables:
                    more, own = table.find(words)
                    found += more
                    items |= own
                counts.append(len(words))
                spans.append(found)
                names.append(set().union(*(ids_of[k] for k in items)) - {None})
            yield _with(part, part.num_columns, counts, spans, names)

    return run


class _Hashes(dict):
    """64 bits of each word asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _slots(hashes: np.ndarray, m: int, bits: int) -> np.ndarray:
    """The place in the shift table of the block that ends at each word from the b-th on, blocks of b words."""
    block = hashes[1:] * _ODD[0] + hashes[:-1] if m > 1 else hashes
    return (block * _ODD[1] >> np.uint64(64 - bits)).astype(np.int64)


def _whole(hashes: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the windows of ``m`` words from these places on."""
    out = np.full(len(starts), m, np.uint64)
    for j in range(m):
        out = (out ^ hashes[starts + j]) * _ODD[2]
        out ^= out >> np.uint64(29)
    return out


def _windows(window: int, bits: int):
    """(m, h, words, k) of all windows of each (k, text), and with no words (m, slot, shift) of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for part in slices(batches, rows=64):
            rows: list[tuple] = []
            shifts: dict[tuple[int, int], int] = {}
            for k, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                words = words_of(text)
                m = min(window, len(words))
                if not m:
                    continue
                hashes, b = known.of(words), min(2, m)
                starts = np.arange(len(words) - m + 1)
                rows += zip([m] * len(starts), _whole(hashes, starts, m).view(np.int64).tolist(), (b" ".join(words[a : a + m]).decode() for a in starts.tolist()), [k] * len(starts), [0] * len(starts), strict=True)
                for at, slot in enumerate(_slots(hashes, m, bits).tolist()):
                    # The block's end is that of a window, or the nearest window's end is so many words on.
                    shift = max(0, m - b - at)
                    if shift < shifts.get((m, slot), 255):
                        shifts[m, slot] = shift
            rows += ((m, slot, None, None, shift) for (m, slot), shift in shifts.items())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32()))], ["m", "h", "words", "k", "shift"])

    return run


def _candidates(sent):
    """(row, m, start, h, words) of the windows of each (row, text) whose blocks and hashes aren't ruled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        tables, bits = sent.value
        low = np.uint64(64 * len(bits) - 1)
        for part in slices(batches):
            rows: list[tuple] = []
            for row, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                words = words_of(text)
                hashes = known.of(words)
                for m, shift in tables.items():
                    if len(words) < m:
                        continue
                    # A block that may not end a window rules its place out.
                    starts = np.flatnonzero(shift[_slots(hashes, m, len(shift).bit_length() - 1)[m - min(2, m) :]] == 0)
                    h = _whole(hashes, starts, m)
                    at = h & low
                    has = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) > 0
                    rows += ((row, m, a, x, b" ".join(words[a : a + m]).decode()) for a, x in zip(starts[has].tolist(), h[has].view(np.int64).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["row", "m", "start", "h", "words"])

    return run


def _joined(texts: DataFrame, grouped: DataFrame, window: int) -> DataFrame:
    """``(row, spans, names)`` of the texts with a hit, by a join with the windows of all items."""
    spark = texts.sparkSession
    items = stage(grouped.select("text").distinct().select(F.monotonically_increasing_id().alias("k"), "text"), "texts")
    filed = stage(items.mapInArrow(_windows(window, SHIFT_BITS), "m int, h long, words string, k long, shift int"), "windows")
    tables: dict[int, np.ndarray] = {}
    # Bounded: a row for each slot of a length of window, and one for each 64 bits.
    shifts = filed.where("words is null").groupBy("m", "h").agg(F.min("shift").alias("shift")).toArrow()
    lengths, slots, least = (shifts[c].to_numpy() for c in ("m", "h", "shift"))
    for m in np.unique(lengths).tolist():
        tables[m] = np.full(1 << SHIFT_BITS, 255, np.uint8)
        tables[m][slots[lengths == m]] = least[lengths == m]
    windows = filed.where("words is not null").select("m", "h", "words", "k")
    at = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    marks = windows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    sent = spark.sparkContext.broadcast((tables, bits.view(np.uint64)))
    asked = stage(texts.where("text is not null").mapInArrow(_candidates(sent), "row long, m int, start int, h long, words string"), "candidates")
    on = ["m", "h", "words"]
    hits = stage(asked.join(windows.select(*on).distinct(), on), "hits")
    spans = hits.groupBy("row").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("m")).alias("end"))).alias("spans"))
    of = hits.select("row", *on).distinct().join(windows, on).select("row", "k").distinct()
    ids = grouped.join(items, "text").select("k", "ids")
    names = of.join(ids, "k").groupBy(F.col("row").alias("r")).agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("names"))
    return spans.join(names, F.col("row") == F.col("r")).select("row", "spans", "names")


def _together(text_at: int):
    """The hits of all windows, in the last two columns, as one search would give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n = part.num_columns - 2
            spans = [[[s["start"], s["end"]] for s in x or ()] for x in part.column(n).to_pylist()]
            yield _with(part, n, [len(words_of(t)) for t in utf8(part.column(text_at))], spans, part.column(n + 1).to_pylist())

    return run


def _with(part: pa.RecordBatch, columns: int, counts: list[int], spans: list[list[list[int]]], names: list) -> pa.RecordBatch:
    place = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    own = [pa.array(counts, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in merged(x)] for x in spans], pa.list_(place)), pa.array([sorted(x or ()) for x in names], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*part.columns[:columns], *own], [*part.schema.names[:columns], "bench_words", "bench_spans", "bench_items"])


def verdict(found: DataFrame) -> DataFrame:
    """``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` of what ``find_benchmark`` gives."""
    hit = F.aggregate("bench_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumns(
        {
            "n_words": F.col("bench_words"),
            "n_hit": hit,
            "n_items": F.size("bench_items").cast("long"),
            "items_sha256": F.sha2(F.array_join("bench_items", ","), 256),
            "contaminated": (hit > 0) & (20 * hit >= F.col("bench_words")),
        }
    )


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bi AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bi WHERE len(w) > 0)),
dk AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
hit AS (SELECT d.doc_id, d.i, d.k, b.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM dk) d JOIN bw b USING (k, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::varchar AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

"""Substring dedup by hashing lines or paragraphs, and units that content marks out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import LOWER, slices, stage, unstage, utf8

#: Lines or paragraphs of fewer words (headings, list items, licence lines) may repeat, but not so many in a row that they reach it together.
MIN_WORDS = 25
#: What stands between units.
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
#: Words of a passage that may not repeat, wherever it begins and however it is wrapped.
PASSAGE = 51
#: Documents of a part, as a power of two.
PART_BITS = 10
PART_ROWS = 1 << PART_BITS
#: Distinct words whose hashes a task remembers.
_WORDS = 200_000
_SPACES = np.array([bytes([b]).isspace() for b in range(256)])
_MIX = 0x9E3779B97F4A7C15
_LOW = (1 << 24) - 1


class _WordHashes(dict):
    """40 bits of the MD5 of each word asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[8:13], "little")
        return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def marked_runs(hashes: np.ndarray, text: np.ndarray, place: np.ndarray, passage: int = PASSAGE) -> np.ndarray:
    """The first words of the runs that content marks out, by their words' hashes.

    A run has (passage + 1) // 2 words. Its value is the sum of their hashes,
    scrambled. Of the runs in each ``passage`` words of one text the one of
    least value is marked out, of equal ones the last. So wherever equal
    passages stand, the same run in them is marked out, and marked runs
    follow each other without a gap through any longer passage. ``text`` and
    ``place`` say for each word in which text it is and the how many-th.
    """
    run = (passage + 1) // 2
    n = len(hashes) - passage + 1
    if n < 1:
        return np.zeros(0, np.int64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)))
    value = (sums[run:] - sums[:-run]) * np.uint64(_MIX) >> np.uint64(24)
    low = place.astype(np.uint64) & np.uint64(_LOW)
    packed = value << np.uint64(24) | (np.uint64(_LOW) - low[: len(value)])
    least = _sliding_min(packed, passage - run + 1)
    first = np.flatnonzero(text[:n] == text[passage - 1 :])
    after = (np.uint64(_LOW) - (least[first] & np.uint64(_LOW)) - low[first]) & np.uint64(_LOW)
    return np.unique(first + after.astype(np.int64))


def units(texts: list[bytes], known: dict, unit: str = "line", min_words: int = MIN_WORDS, passage: int | None = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, start, end, digest) of all units of the texts, places in code points.

    Units are lines or paragraphs of at least ``min_words`` words, from end
    to end; from each shorter one on as many whole ones as reach that number
    together; whole texts, however short; and the runs that ``marked_runs``
    finds. A digest is the XXH128
    of the unit's words, A-Z lower-cased and joined by a space, so that case
    and spacing make no difference.
    """
    raw = b"\n".join(texts)
    lower = raw.translate(LOWER)
    words, data = lower.split(), np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACES[data], [True]))))
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes + 1) - sizes - 1
    sep = SEPARATORS[unit].encode()
    pieces = [np.cumsum([0, *(len(p) + len(sep) for p in t.split(sep))]) for t in texts]
    piece_text = np.repeat(np.arange(len(texts)), [len(p) - 1 for p in pieces])
    piece_start = np.concatenate([p[:-1] + b for p, b in zip(pieces, base.tolist(), strict=True)]) if texts else base
    piece_end = np.concatenate([p[1:] + b for p, b in zip(pieces, base.tolist(), strict=True)]) - len(sep) if texts else base
    begin, end = np.searchsorted(starts, piece_start), np.searchsorted(starts, piece_end)
    own_text, sizes_in_words = piece_text, end - begin
    long = np.flatnonzero(sizes_in_words >= max(1, min_words))
    short = np.flatnonzero((sizes_in_words > 0) & (sizes_in_words < min_words))
    last = np.searchsorted(end, begin[short] + min_words - 1, "right")
    within = last < len(end)
    short, last = short[within], last[within]
    within = own_text[last] == own_text[short]
    first, last = np.concatenate((long, short[within])), np.concatenate((long, last[within]))
    text, at, to, begin, end = piece_text[first], piece_start[first], piece_end[last], begin[first], end[last]
    whole_begin, whole_end = np.searchsorted(starts, base), np.searchsorted(starts, base + sizes)
    whole = np.flatnonzero(whole_end > whole_begin)
    text, at, to = np.concatenate((text, whole)), np.concatenate((at, base[whole])), np.concatenate((to, (base + sizes)[whole]))
    begin, end = np.concatenate((begin, whole_begin[whole])), np.concatenate((end, whole_end[whole]))
    if passage:
        word_text = np.searchsorted(base, starts, "right") - 1
        place = np.arange(len(starts)) - np.searchsorted(starts, base)[word_text]
        own = marked_runs(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), word_text, place, passage)
        run = (passage + 1) // 2
        text, at, to = np.concatenate((text, word_text[own])), np.concatenate((at, starts[own])), np.concatenate((to, ends[own + run - 1]))
        begin, end = np.concatenate((begin, own)), np.concatenate((end, own + run))
    digests = [xxhash.xxh128_digest(b" ".join(words[a:b])) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    if lower.isascii():
        return text, at - base[text], to - base[text], digests
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return text, points[at] - points[base[text]], points[to] - points[base[text]], digests


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """``text`` without the spans, and these in order, merged.

    Spans that overlap or are one character of white space apart become one.
    With a span goes one character of white space: that before it unless the
    span begins a line, else that after it, so that no two lines are joined
    and no empty line is left.
    """
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    kept, at = [], 0
    for a, b in merged:
        if a > 0 and (text[a - 1] != "\n" or b == len(text)):
            kept.append(text[at : a - 1])
            at = b
        else:
            kept.append(text[at:a])
            at = min(b + 1, len(text))
    return "".join([*kept, text[at:]]), merged


def dedup_units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS, passage: int | None = PASSAGE) -> DataFrame:
    """``docs`` with repeated units cut from the text, and ``removed_spans``.

    Units are lines (or paragraphs) of at least ``min_words`` words, shorter
    ones in a row from each on until they reach that number, whole texts and,
    as a passage may begin within a line or be wrapped in another way, runs
    of (passage + 1) // 2 words that content marks out (``marked_runs``):
    every ``passage`` words in a row hold one, the same wherever they occur.
    ``passage=None`` leaves these out. Of equal units over
    all documents the one with the smallest (id, offset) stays and the rest
    go, but for those that overlap it. So of a passage of at least
    ``passage`` words that occurred before, all goes but less than a run at
    either end, which the passage's neighbours decide on. A text that an
    earlier document has as a whole goes whole, even one of a few words; a
    single short line or paragraph of other texts may repeat.

    ``removed_spans`` has the sorted (start, end) code points cut, in the
    original text, so that every kept character can be traced back; it
    replaces a column of that name, all other columns stay, whatever their
    names. ``without`` says which white space goes with a span.

    A null text stays null, an empty one empty, and an empty table empty; long
    texts are used whole. Null ids rank before others. Rows of one id are
    told apart by their text; rows equal in both are one document and are
    treated alike.

    Documents are staged in parts of ``PART_ROWS``. A part passes on each of
    its digests once, with the first place and the number there, so a unit in
    a third of the documents is a row for each part and no burden on one
    task. First places of all parts come from a partial aggregation, go back
    to the parts that have the digest, and meet their documents there.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.drop("removed_spans")
    row = stage(own.select(F.shiftright(F.monotonically_increasing_id(), PART_BITS).alias("part"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.struct(*own.columns).alias("doc")), "documents")
    asked = row.select("part", "id", "th", F.col("doc")[text_col].cast("string").alias("text")).where("text is not null")
    found = stage(asked.mapInArrow(_units(unit, min_words, passage), f"part long, h1 long, h2 long, id {kind}, th long, start int, end int, n long"), "units")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "start", "end")).alias("first"), F.sum("n").alias("n")).where("n > 1")
    first = stage(first.select("h1", "h2", "first.id", "first.th", "first.end"), "first")  # so that either side of the join has a plain exchange, which may be split
    known = stage(found.select("part", "h1", "h2").join(first, ["h1", "h2"]), "known")
    unstage(found)
    unstage(first)
    laid = known.select("part", F.lit(0).alias("kind"), "h1", "h2", "id", "th", "end", F.lit(None).cast(row.schema["doc"].dataType).alias("doc"))
    none = F.lit(0).cast("long")
    laid = laid.unionByName(row.select("part", F.lit(1).alias("kind"), none.alias("h1"), none.alias("h2"), "id", "th", F.lit(0).alias("end"), "doc"))
    result = own.withColumn("removed_spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).schema
    return laid.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_cut(own.columns.index(own.select(text_col).columns[0]), unit, min_words, passage), result)


def _groups(batches: Iterator[pa.RecordBatch], *keys: int) -> Iterator[pa.RecordBatch]:
    """The batches cut where one of these whole-number columns changes."""
    for batch in batches:
        if batch.num_rows:
            own = [batch.column(k).to_numpy() for k in keys]
            cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in own], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                yield batch.slice(a, b - a)


def _units(unit: str, min_words: int, passage: int | None):
    """Each digest of a part once, with its first place there and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part = _WordHashes(), None
        held: dict[bytes, list] = {}

        def out(kind: pa.DataType) -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
            place = [x for x, _ in held.values()]
            columns = [pa.array(np.full(len(held), part, np.int64)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([x[1] for x in place], kind)]
            columns += [pa.array([x[k] for x in place], t) for k, t in ((2, pa.int64()), (3, pa.int32()), (4, pa.int32()))]
            columns.append(pa.array([n for _, n in held.values()], pa.int64()))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "h1", "h2", "id", "th", "start", "end", "n"])

        kind = None
        for own in slices(_groups(batches, 0)):
            now, kind = own.column(0)[0].as_py(), own.schema.field(1).type
            if held and now != part:
                yield out(kind)
            part = now
            ids, marks = own.column(1).to_pylist(), own.column(2).to_pylist()
            text, start, end, digests = units(utf8(own.column(3)), hashes, unit, min_words, passage)
            for t, a, b, digest in zip(text.tolist(), start.tolist(), end.tolist(), digests, strict=True):
                place = (ids[t] is not None, ids[t], marks[t], a, b)
                if (known := held.get(digest)) is None:
                    held[digest] = [place, 1]
                else:
                    known[1] += 1
                    if _before(place, known[0]):
                        known[0] = place
        if held:
            yield out(kind)

    return run


def _before(a: tuple, b: tuple) -> bool:
    """Whether place ``a`` comes before ``b``; of no ids none is compared."""
    return (a[0], *a[2:]) < (b[0], *b[2:]) if not (a[0] and b[0]) else a < b


def _cut(text_at: int, unit: str, min_words: int, passage: int | None):
    """The documents of each part, which come after the first places of its repeated digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part = _WordHashes(), None
        first: dict[bytes, tuple] = {}
        for own in slices(_groups(batches, 0, 1)):
            if (now := own.column(0)[0].as_py()) != part:
                first, part = {}, now
            ids, marks = own.column(4).to_pylist(), own.column(5).to_pylist()
            if own.column(1)[0].as_py() == 0:
                halves = np.column_stack([own.column(k).to_numpy() for k in (2, 3)]).astype("<i8").tobytes()
                first.update(zip([halves[k : k + 16] for k in range(0, len(halves), 16)], zip(ids, marks, own.column(6).to_pylist(), strict=True), strict=True))
                continue
            columns = own.column(7).flatten()
            texts = columns[text_at].to_pylist()
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            if first:
                rows = [k for k, t in enumerate(texts) if t is not None]
                found = units([str(texts[k]).encode() for k in rows], hashes, unit, min_words, passage)
                for t, a, b, digest in zip(found[0].tolist(), found[1].tolist(), found[2].tolist(), found[3], strict=True):
                    if (f := first.get(digest)) is not None and (f[0] != ids[rows[t]] or f[1] != marks[rows[t]] or a >= f[2]):
                        spans[rows[t]].append((a, b))
            done = [without(t, x) if x else (t, []) for t, x in zip(texts, spans, strict=True)]
            columns[text_at] = pa.array([t for t, _ in done], columns[text_at].type)
            place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            names = [f.name for f in own.schema.field(7).type]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([[{"start": a, "end": b} for a, b in x] for _, x in done], place)], [*names, "removed_spans"])

    return run


SQL = r"""
WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
lp AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start,
              regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM ln),
pc AS (SELECT doc_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS piece FROM (SELECT doc_id, string_split_regex(text, '[\x20\x09-\x0D]') AS ps FROM d)),
pp AS (SELECT doc_id, k, translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, length(piece) AS size,
              coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM pc),
wd AS (SELECT doc_id, word, start, start + size AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i,
              count(*) OVER (PARTITION BY doc_id) AS n, (md5_number_lower(word) % 1099511627776)::hugeint AS h FROM pp WHERE word <> ''),
rn AS (SELECT doc_id, i, n, start, lead(stop, 25) OVER x AS stop, string_agg(word, ' ') OVER y AS unit,
              ((sum(h) OVER y * 11400714819323198485::hugeint) % 18446744073709551616::hugeint) // 16777216 * 16777216 + 16777215 - i % 16777216 AS v
       FROM wd WINDOW x AS (PARTITION BY doc_id ORDER BY i), y AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 25 FOLLOWING)),
ms AS (SELECT doc_id, i, n, min(v) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 25 FOLLOWING) AS m FROM rn WHERE i <= n - 26),
ch AS (SELECT DISTINCT doc_id, 16777215 - m % 16777216 AS i FROM ms WHERE i <= n - 51),
lw AS (SELECT doc_id, start, start + length(line) AS stop, len(w) AS n, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY start, length(line) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS wb FROM lp),
dw AS (SELECT doc_id, length(text) AS size, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM d),
sr AS (SELECT a.doc_id, a.start, b.stop, a.wb, b.wb + b.n AS we FROM (SELECT *, wb + 24 AS last FROM lw WHERE n BETWEEN 1 AND 24) a
       ASOF JOIN (SELECT * FROM lw WHERE n > 0) b ON a.doc_id = b.doc_id AND a.last >= b.wb WHERE a.last < b.wb + b.n),
un AS (SELECT doc_id, start, start + length(line) AS stop, array_to_string(w, ' ') AS unit FROM lp WHERE len(w) >= 25
       UNION ALL SELECT doc_id, start, stop, array_to_string(w[wb + 1:we], ' ') FROM sr JOIN dw USING (doc_id)
       UNION ALL SELECT doc_id, 0, size, array_to_string(w, ' ') FROM dw WHERE len(w) > 0
       UNION ALL SELECT doc_id, start, stop, unit FROM rn JOIN ch USING (doc_id, i)),
fs AS (SELECT doc_id, start, stop, first_value(doc_id) OVER x AS first_id, first_value(stop) OVER x AS first_stop FROM un WINDOW x AS (PARTITION BY unit ORDER BY doc_id, start, stop)),
ct AS (SELECT DISTINCT doc_id, start, stop FROM fs WHERE doc_id <> first_id OR start >= first_stop),
nw AS (SELECT *, start > max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS new FROM ct),
gr AS (SELECT *, sum(CASE WHEN coalesce(new, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS g FROM nw),
sp AS (SELECT doc_id, min(start) AS a, max(stop) AS b FROM gr GROUP BY doc_id, g),
ex AS (SELECT doc_id, a, b, text, length(text) AS size, a > 0 AND (substring(text, a::int, 1) <> chr(10) OR b = length(text)) AS before FROM sp JOIN d USING (doc_id)),
ed AS (SELECT doc_id, a, b, text, CASE WHEN before THEN a - 1 ELSE a END AS low, CASE WHEN before THEN b ELSE least(b + 1, size) END AS high FROM ex),
kp AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM ed),
g AS (SELECT doc_id, count(*) AS n_removed, sum(b - a)::bigint AS removed_chars, string_agg(a::varchar, ',' ORDER BY a) AS removed_at,
             string_agg(substring(text, (since + 1)::int, (low - since)::int), '' ORDER BY a) || substring(any_value(text), (max(high) + 1)::int) AS text FROM kp GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(removed_chars, 0)::bigint AS removed_chars, coalesce(removed_at, '') AS removed_at, coalesce(g.text, s.text) AS text
FROM documents s LEFT JOIN g USING (doc_id)
"""

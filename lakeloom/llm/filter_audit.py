"""How five filters overlap, in every order, with exact copies found by fingerprint-routed RDDs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import count, permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import stage

FILTERS = "ABCDE"
#: A text fails A with fewer words, B with a lower per cent of distinct ones, C with a higher per cent of capitals, D with one of these signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, b"#$%&*|"
#: The bit of filter E, an exact copy of an earlier text.
COPY = 1 << FILTERS.index("E")
#: Bytes of distinct texts that a task remembers at a time, to tell copies before they are routed, and bytes of all texts for each partition they are routed to.
SEEN_BYTES, ROUTED_BYTES = 16 << 20, 64 << 20
_CAPITALS, _CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
_MASKS = 1 << len(FILTERS)


def mask_of(text: bytes) -> int:
    """Bits 0 to 3 for the filters A to D that a text fails."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    out = int(len(words) < LEAST_WORDS)
    out |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    out |= (100 * capitals > MOST_CAPITALS * points) << 2
    return out | (len(text) != len(text.translate(None, SIGNS))) << 3


class Chains:
    """The texts of each fingerprint, told apart by comparing them whole.

    A text is held once, with the least id so far and the rows of that id,
    counted by source.
    """

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def find(self, key: int, text: bytes) -> list | None:
        return next((own for own in self.chains.get(key, ()) if own[0] == text), None)

    def put(self, key: int, text: bytes, mask: int, id_, rows: dict[str, int]) -> None:
        self.chains.setdefault(key, []).append([text, mask, id_, Counter(rows)])
        self.bytes += len(text) + 256

    @staticmethod
    def meet(own: list, id_, rows: dict[str, int]) -> Iterator[tuple]:
        """Takes more rows of the text ``own``; gives (id, source, mask, n) of those that a smaller id makes copies."""
        _, mask, least, held = own
        if id_ == least:
            held.update(rows)
            return
        late = (id_, rows) if id_ > least else (least, held)
        if id_ < least:
            own[2:] = [id_, Counter(rows)]
        for source, n in late[1].items():
            yield late[0], source, mask | COPY, n

    def drain(self) -> Iterator[tuple]:
        """(key, text, mask, id, rows) of every text; nothing is held any longer."""
        for key, chain in self.chains.items():
            for own in chain:
                yield key, *own
        self.chains, self.bytes = {}, 0


def _route(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(fingerprint, (text, mask, id, rows)) of each text's first row in a task, and (any number, (None, mask, id, rows)) of what is known to be a copy or can't be one."""
    seen, number = Chains(), count()

    def known(found: Iterator[tuple]) -> Iterator[tuple]:
        for id_, source, mask, n in found:
            # Numbered, so that no value of the data gathers these anywhere.
            yield xxhash.xxh64_intdigest(next(number).to_bytes(8)), (None, mask, id_, {source: n})

    def first() -> Iterator[tuple]:
        for key, *own in seen.drain():
            own[3] = dict(own[3])
            yield key, tuple(own)

    for id_, source, text in rows:
        text = bytes(text or b"")
        if id_ is None:
            yield from known([(None, source, mask_of(text), 1)])
            continue
        key = xxhash.xxh64_intdigest(text)
        if (own := seen.find(key, text)) is not None:
            yield from known(seen.meet(own, id_, {source: 1}))
            continue
        seen.put(key, text, mask_of(text), id_, {source: 1})
        if seen.bytes > SEEN_BYTES:
            yield from first()
    yield from first()


def _settle(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, source, mask, n) of all rows; ``rows`` come sorted by fingerprint, so one chain is held at a time."""
    seen, now = Chains(), None

    def first() -> Iterator[tuple]:
        for _, _, mask, id_, held in seen.drain():
            for source, n in held.items():
                yield id_, source, mask, n

    for key, (text, mask, id_, held) in rows:
        if key != now:
            yield from first()
            now = key
        if text is None:
            for source, n in held.items():
                yield id_, source, mask, n
        elif (own := seen.find(key, text)) is not None:
            yield from seen.meet(own, id_, held)
        else:
            seen.put(key, text, mask, id_, held)
    yield from first()


def failed_filters(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, mask, n)``: the filters that each document fails, bit by bit from A.

    A text's rows are routed by the XXH64 of the text. Before that a task
    settles among its own rows all that it can: a text leaves it once for
    each ``SEEN_BYTES`` of other texts, with its least id there, so copies,
    however many, cost their ids and not their texts. Where they arrive,
    sorted by fingerprint, chains of full texts say which are equal; every
    id but the least of a text is a copy. Rows equal in id, source and text
    come as one, ``n`` times; a null source is an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col), F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.col(text_col).cast("string").cast("binary")).rdd
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    routed = own.mapPartitions(_route).repartitionAndSortWithinPartitions(max(own.context.defaultParallelism, -(-size // ROUTED_BYTES)), lambda key: key)
    return docs.sparkSession.createDataFrame(routed.mapPartitions(_settle), f"id {kind}, source string, mask int, n long", verifySchema=False)


def _none() -> np.ndarray:
    return np.zeros((3, _MASKS), np.int64)


def _count(counts: np.ndarray, row: tuple) -> np.ndarray:
    """Adds (mask, n, good, toxic) to counts of all, good and toxic documents by mask."""
    mask, n, good, toxic = row
    counts[:, mask] += (n, n * good, n * toxic)
    return counts


@cache
def _steps() -> tuple[list[tuple[str, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """All (order, step, filter), and for each the masks that are kept, removed, and failing but removed before."""
    names, kept, removed, redundant = [], [], [], []
    masks = np.arange(_MASKS)
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            gone, fails = (masks & before) > 0, (masks >> f & 1) > 0
            names.append(("".join(FILTERS[x] for x in order), step, f))
            kept.append(~gone & ~fails)
            removed.append(~gone & fails)
            redundant.append(gone & fails)
            before |= 1 << f
    return names, *(np.array(x, np.int64) for x in (kept, removed, redundant))


def _report(item: tuple[str, np.ndarray]) -> Iterator[tuple]:
    part, (n, good, toxic) = item
    names, kept, removed, redundant = _steps()
    orders = len(names) // len(FILTERS)
    alone = [int(n[1 << f]) for f in range(len(FILTERS))]
    # Of all orders, a filter comes first among those that a document fails in one of as many as it fails.
    shapley = [sum(int(n[m]) * orders // m.bit_count() for m in range(_MASKS) if m >> f & 1) for f in range(len(FILTERS))]
    columns = [x.tolist() for x in (kept @ n, removed @ n, redundant @ n, removed @ good, removed @ toxic)]
    for (order, step, f), k, r, d, g, t in zip(names, *columns, strict=True):
        yield part, order, step, k, r, d, alone[f], g, t, shapley[f]


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """What each filter does in every order of the five, by source.

    A row for each source (``part``; a null one is empty), each order and
    each step: how many documents are kept after it, removed by it, fail it
    but were removed before (``redundant``), fail it alone
    (``unique_fails``); how many of those removed are labelled good or toxic;
    and ``shapley``, what the filter removes summed over all orders.

    A document's masks of failed filters are counted, 32 numbers three times
    over for each source, which tasks sum before anything is exchanged; all
    orders follow from these. A source with a third of all rows is a row for
    each task.

    A null or empty text has no words and fails A alone, or E too. Long texts
    are used whole. A null id is no one's copy, makes no copies and has no
    label; ids that repeat are rows of their own, and of equal texts all rows
    with the least id stay. Of several labels of an id, one that is good (or
    toxic) is enough. An empty table gives no rows. Other columns aren't
    used, whatever their names.
    """
    failed = stage(failed_filters(docs, id_col=id_col, text_col=text_col, source_col=source_col), "failed")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_one(quality_col).alias("good"), is_one(toxic_col).alias("toxic"))
    rows = failed.join(known, "id", "left").select("source", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0))).rdd
    counts = rows.map(lambda r: (r[0], r[1:])).combineByKey(lambda r: _count(_none(), r), _count, np.add)
    return docs.sparkSession.createDataFrame(counts.flatMap(_report), "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long", verifySchema=False)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
m AS (SELECT doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::int
             + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * e::int AS mask FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::int AS before
      FROM (SELECT filter_order, unnest(range(1, 6))::int AS step FROM o)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::bigint AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0)::bigint AS removed,
             coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0)::bigint AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::bigint AS unique_fails,
             coalesce(sum(g) FILTER (mask & before = 0 AND mask & own > 0), 0)::bigint AS good_lost, coalesce(sum(x) FILTER (mask & before = 0 AND mask & own > 0), 0)::bigint AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::bigint AS shapley FROM r
"""

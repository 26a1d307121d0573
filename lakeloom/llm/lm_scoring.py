"""Language-model scores of documents: PPM over bytes, and word counts."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import ppm
from lakeloom.llm.common import LOWER, slices, stage, utf8

#: Bytes of context.
ORDER = 5
#: N-grams whose probabilities, and words whose counts, every task gets; the rest are joined.
MAX_GRAMS = 2_000_000
MAX_FREQUENT = 150_000
#: Rows after which whole groups of contexts are looked up.
_LOOK_UP = 1 << 19
#: Distinct words and n-grams that a task holds before it passes them on.
_FLUSH = 400_000
#: Stands for the end of a text in the word counts; no word is empty.
_END = b""


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or b"").translate(LOWER).split()


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            codes, counts = (np.concatenate(x) for x in zip(*grams, strict=True)) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            codes, counts = ppm.add_up(codes, counts)
            word = pa.concat_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(codes), pa.binary())])
            gram = pa.array(np.concatenate((np.full(len(words), -1), codes.view(np.int64))))
            n = pa.array(np.concatenate((np.fromiter(words.values(), np.int64, len(words)), counts)))
            words.clear()
            grams.clear()
            return pa.RecordBatch.from_arrays([word, gram, n], ["word", "gram", "n"])

        held = 0
        for part in slices(batches):
            texts = [words_of(t) for t in utf8(part.column(0))]
            for own in texts:
                words.update(own)
            words[_END] += len(texts)
            grams.append(ppm.count_grams([b" ".join(own) for own in texts], order))
            held += len(grams[-1][0])
            if held > 4 * _FLUSH:
                grams[:] = [ppm.add_up(*(np.concatenate(x) for x in zip(*grams, strict=True)))]
                held = len(grams[0][0])
            if held > 4 * _FLUSH or len(words) > _FLUSH:
                yield out()
                held = 0
        yield out()

    return run


def _suffix(gram: str, level: int) -> Column:
    """The ``level`` bytes before the symbol and the symbol itself."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * (level + 1)) - 1))


class LanguageModel:
    """What ``learn`` gathers: all counts as a staged table, and what every task gets of them.

    These are the sums, the level that all contexts share, the counts of the
    most frequent words and the probabilities of the most frequent n-grams.
    """

    def __init__(self, counts: DataFrame, order: int, max_grams: int, max_frequent: int):
        self.order = order
        words = counts.where("word is not null")
        self.tokens, self.distinct = (int(x or 0) for x in words.agg(F.sum("n"), F.count("*")).first())
        self.words = words.where(F.octet_length("word") > 0).select("word", "n")
        self.ends = int(words.where(F.octet_length("word") == 0).agg(F.sum("n")).first()[0] or 0)
        self.grams = counts.where("word is null").select("gram", "n")
        #: Level of the trie that every task gets whole; it has at most 256 entries to the power of its number plus 1.
        self.low = max(0, min(2, order - 1))
        longer = self.grams.select(_suffix("gram", self.low + 1).alias("c")).distinct()
        self.lower = (self.low, *_sorted(longer.groupBy(_suffix("c", self.low).alias("c")).agg(F.count("*").alias("n"))))
        self.common = _least(self.words, max_frequent)
        top = self.words.where(F.col("n") >= self.common).toArrow()
        self.frequent = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True))
        # Found at the top level, a symbol's probability needs no other count than its context's.
        context = F.shiftrightunsigned("gram", 8).alias("context")
        whole = self.grams.groupBy(context).agg(F.sum("n").alias("all"))
        known = self.grams.where(F.col("n") >= _least(self.grams, max_grams)).select("gram", "n", context)
        self.known = _sorted(known.join(whole, "context").select("gram", (F.log10(F.col("n") - 0.5) - F.log10("all")).alias("p")))

    def base(self, n: np.ndarray | int) -> np.ndarray | float:
        """log10 of a token's probability by its count."""
        return np.log10((np.asarray(n) + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order and their values, on the driver."""
    own = table.toArrow()
    codes, values = (own.column(k).to_numpy() for k in range(2))
    by = np.argsort(codes.view(np.uint64))
    return codes[by].view(np.uint64), values[by]


def _least(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach, up to 1024, and beyond the least power of two.

    It comes from all counts, by a table with a row for each such count.
    """
    step = F.when(F.col("n") <= 1024, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    least, room = None, most
    for r in sorted(counts.groupBy(step.alias("k")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.k):
        room -= r.rows
        if room < 0:
            break
        least = r.k
    return 1 << 62 if least is None else least


def learn(docs: DataFrame, text_col: str = "text", *, order: int = ORDER, max_grams: int = MAX_GRAMS, max_frequent: int = MAX_FREQUENT) -> LanguageModel:
    """Counts of all words and of all bytes after ``order`` others in ``docs``.

    Every text, a null one being empty, is counted whole: its words A-Z
    lower-cased and joined by a space, then its end. Tasks pass on their own
    sums, which are added up by word and by n-gram and staged; the table has
    all that occurs. ``max_grams`` and ``max_frequent`` bound what every task
    gets of it and change no score.
    """
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counts(order), "word binary, gram long, n long")
    return LanguageModel(stage(found.groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts"), order, max_grams, max_frequent)


def _look_up(given):
    """(gram, p) of the n-grams without a count, by those with one; rows come sorted by the key of their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, lower = given.value[:2]
        mask = np.uint64((1 << 8 * (lower[0] + 1)) - 1)
        held: list[list[np.ndarray]] = []

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            gram, n = rows
            learned = n > 0
            model = ppm.Model(*ppm.add_up(gram[learned].view(np.uint64), n[learned]), order, lower)
            asked = gram[~learned]
            return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(model.log10(asked.view(np.uint64)))], ["gram", "p"])

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(2)])
            if sum(len(h[0]) for h in held) >= _LOOK_UP:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                keys = rows[0].view(np.uint64) >> np.uint64(8) & mask
                whole = int(np.searchsorted(keys, keys[-1]))
                if whole:
                    yield out([x[:whole] for x in rows])
                held = [[x[whole:] for x in rows]]
        if held:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _probabilities(asked: DataFrame, model: LanguageModel, given) -> DataFrame:
    """``(gram, p)`` of distinct n-grams, each scored among all counts of the contexts that end as its own does."""
    both = model.grams.unionByName(asked.withColumn("n", F.lit(0).cast("long")))
    key = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * (model.low + 1)) - 1))
    laid = both.withColumn("key", key).repartition("key").sortWithinPartitions("key").select("gram", "n")
    return laid.mapInArrow(_look_up(given), "gram long, p double")


#: The table of the broadcast used last, by a key made for each; a Python worker serves many tasks.
_built: dict[str, ppm.Known] = {}


def _score(given):
    """Of each document the share of both scores that is known at once, and what is left to join."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, _, frequent, tokens, distinct, ends, known = given.value
        if key not in _built:
            _built.clear()
            _built[key] = ppm.Known(*known)
        log_n, table = np.log10(tokens + 0.5 * (distinct + 1)), _built[key]
        part_id, at = TaskContext.get().partitionId(), 0
        for part in slices(batches):
            texts = [words_of(t) for t in utf8(part.column(1))]
            n, base, seen, rare = part.num_rows, [], [], []
            for words in texts:
                counts = Counter(words)
                found = list(map(frequent.get, counts))
                c = np.fromiter((x or 0 for x in found), np.int64, len(found))
                times = np.fromiter(counts.values(), np.int64, len(found))
                has = c > 0
                base.append(float((np.log10(c[has] + 0.5) - log_n) @ times[has] + np.log10(ends + 0.5) - log_n))
                seen.append(int(times[has].sum()) + (ends > 0))
                rare.append([x for x, c in zip(counts.items(), found, strict=True) if not c])
            score, text, left, times = table.share([b" ".join(w) for w in texts], order)
            words = _lists(np.repeat(np.arange(n), [len(r) for r in rare]), n, pa.array([w for r in rare for w, _ in r], pa.binary()), pa.array([c for r in rare for _, c in r], pa.int32()), "word")
            grams = _lists(text, n, pa.array(left.view(np.int64)), pa.array(times.astype(np.int32)), "gram")
            own = [np.full(n, part_id), np.arange(at, at + n), np.array([len(w) + 1 for w in texts]), np.array(seen, np.int64), np.array(base), score]
            names = ["part", "row", "n_tokens", "n_known", "base", "score", "words", "grams"]
            at += n
            yield pa.RecordBatch.from_arrays([part.column(0), pa.StructArray.from_arrays([*map(pa.array, own), words, grams], names)], ["doc", "own"])

    return run


def _lists(row: np.ndarray, rows: int, values: pa.Array, counts: pa.Array, name: str) -> pa.ListArray:
    """For each row the (value, n) structs that belong to it."""
    ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([values, counts], [name, "n"]))


def score(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``score`` is log10 of the trie's probability of the words joined by a
    space and the end; ``base_score`` is that of a unigram model of the
    words and the end. Columns of these names are replaced. One row for each
    row of ``docs``, whatever its ids.

    Both come from all counts. Those of frequent words, and the probabilities
    of frequent n-grams, are broadcast in bounded number. What else a
    document has is staged with its counts in it and joined: words with their
    counts, n-grams with the probabilities of all distinct ones that were
    asked for. To find these, the n-grams meet all counts of the contexts
    that end with the same three bytes, which is all that a probability
    depends on besides the broadcast level of three-byte entries. A very long
    text takes memory for its distinct n-grams; an empty table gives no rows,
    and with no training text every byte is new.
    """
    given = docs.sparkSession.sparkContext.broadcast((model.order, model.lower, model.frequent, model.tokens, model.distinct, model.ends, model.known))
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*names)
    kept = [c for c in docs.columns if c.lower() != text_col.lower()]
    own_row = "struct<part:long,row:long,n_tokens:long,n_known:long,base:double,score:double,words:array<struct<word:binary,n:int>>,grams:array<struct<gram:long,n:int>>>"
    own = docs.select(F.struct(*kept or [F.lit(0).alias("none")]).alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = own.select("doc", F.lit(None).cast(own_row).alias("own")).schema
    scored = stage(own.mapInArrow(_score(given), schema), "scores").select("doc", "own.*")

    words = scored.select("part", "row", F.explode("words").alias("x")).select("part", "row", F.col("x.word").alias("word"), F.col("x.n").alias("times"))
    total = model.tokens + 0.5 * (model.distinct + 1)
    counted = words.join(model.words.where(F.col("n") < model.common), "word", "left").select(
        "part",
        "row",
        (F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(total))).alias("more_base"),
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).cast("long").alias("more_known"),
        F.lit(0.0).alias("more_score"),
    )
    grams = scored.select("part", "row", F.explode("grams").alias("x")).select("part", "row", F.col("x.gram").alias("gram"), F.col("x.n").alias("times"))
    p = _probabilities(grams.select("gram").distinct(), model, given)
    looked = grams.join(p, "gram").select("part", "row", F.lit(0.0).alias("more_base"), F.lit(0).cast("long").alias("more_known"), (F.col("times") * F.col("p")).alias("more_score"))
    more = counted.unionByName(looked).groupBy("part", "row").agg(*[F.sum(c).alias(c) for c in ("more_base", "more_known", "more_score")])
    joined = scored.drop("words", "grams").join(more, ["part", "row"], "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return joined.select(
        *([F.col("doc")[c].alias(c) for c in kept]),
        "n_tokens",
        plus("n_known", "more_known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        plus("score", "more_score").alias("score"),
    )

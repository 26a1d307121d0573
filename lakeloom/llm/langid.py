"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import slices

#: Longest n-gram; three code points of 21 bits fill a long.
LONGEST = 3
#: Most frequent n-grams of a profile, and of a document.
PROFILE = 300
#: More distinct values of the language column are taken for an error.
MAX_LANGUAGES = 4096
#: Code points that are counted at a time.
CHUNK = 1 << 20
#: Distinct n-grams that a task holds before it passes them on.
_FLUSH = 1 << 18
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or a space if it is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def spaced(text: str) -> np.ndarray:
    """Code points of the lower-cased words, one space around each; empty if there is no letter."""
    own = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    own = np.concatenate(([32], own, [32])).astype(np.uint32)
    own = own[~((own == 32) & (np.concatenate(([0], own[:-1])) == 32))]
    return own if len(own) > 1 else own[:0]


def ngrams(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of 1 to ``LONGEST`` and their counts.

    A word's n-grams begin at most one space before it and end at most one
    after it. A code holds the code points in 21 bits each.
    """
    codes, counts = [], []
    for start in range(0, len(own), CHUNK):
        alphabet, at = np.unique(own[start : start + CHUNK + LONGEST - 1], return_inverse=True)
        here, space = min(CHUNK, len(own) - start), int(np.searchsorted(alphabet, 32))
        for n in range(1, LONGEST + 1):
            size = min(here, len(at) - n + 1)
            if size < 1:
                continue
            code, whole = np.zeros(size, np.int64), np.ones(size, bool)
            for k in range(n):
                code = code * len(alphabet) + at[k : k + size]
                if 0 < k < n - 1 or n == 1:
                    whole &= at[k : k + size] != space
            code, base = code[whole], len(alphabet)
            if base**n <= 64 * size + 4096:
                found = np.bincount(code)
                some = np.flatnonzero(found)
                found = found[some]
            else:
                some, found = np.unique(code, return_counts=True)
            wide = np.zeros(len(some), np.int64)
            for k in range(n):
                wide |= alphabet[some // base**k % base].astype(np.int64) << 21 * k
            codes.append(wide)
            counts.append(found)
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(codes) <= LONGEST:
        return np.concatenate(codes), np.concatenate(counts)
    wide, at = np.unique(np.concatenate(codes), return_inverse=True)
    return wide, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def most_frequent(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The codes with the highest counts, in that order, ties by code."""
    if len(codes) > most:
        some = counts >= np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:most]


def count_ngrams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, code, n)`` over all rows with a language and a text."""
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, c, n) for lang, own in held.items() for c, n in own.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "code", "n"])

        for part in slices(batches):
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(spaced(text))
            for lang, words in texts.items():
                own = np.concatenate([words[0][:1], *(w[1:] for w in words)])
                if not len(own):
                    own = np.concatenate(words)
                add, get = held.setdefault(lang, {}), held[lang].get
                codes, counts = ngrams(own)
                for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                    add[c] = get(c, 0) + n
            if sum(map(len, held.values())) > _FLUSH:
                yield out()
        yield out()

    return own.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Profiles:
    """Ranks of the most frequent n-grams of each language."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.langs = sorted(ranked)
        self.codes = np.unique(np.array([c for own in ranked.values() for c in own], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, ranked[lang]), k] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance and its score.

        Each of the text's n-grams adds the distance between its ranks in
        text and profile, or ``PROFILE`` if the profile lacks it. The score
        is 1 less the distance's share of the greatest possible one.
        """
        own = spaced(text or "")
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        codes = most_frequent(*ngrams(own))
        at = np.searchsorted(self.codes, codes)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != codes)] = -1
        ranks = self.rank[at]
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(codes))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (PROFILE * len(codes))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Profiles of all languages of ``docs``, over all its rows.

    The driver gets ``PROFILE`` n-grams of each language at most; more than
    ``MAX_LANGUAGES`` languages raise a ValueError. Ties go by code.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = count_ngrams(docs, lang_col, text_col).withColumn("rank", rank).where(F.col("rank") <= PROFILE)
    packed = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "code"))).alias("own")).limit(MAX_LANGUAGES + 1).collect()
    if len(packed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles({r.lang: [x.code for x in r.own] for r in packed})


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    Whole texts are used. A text that is null or has no letters, and any text
    if no language was learned, is ``und`` with score 0. Of languages at the
    same distance the first by name is taken. Very long texts take memory for
    their distinct n-grams alone; repeated rows are judged alike; other
    columns stay, whatever their names; an empty table stays empty.
    """
    known = docs.sparkSession.sparkContext.broadcast(profiles)
    own = docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)})
    at = own.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [known.value.predict(t) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=part.schema)

    return own.mapInArrow(run, own.schema)

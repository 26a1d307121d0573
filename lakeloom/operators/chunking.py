"""Splitting texts into chunks: by characters, by tokens, by separators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import tokens

SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def _windows(n: F.Column, size: int, step: int) -> F.Column:
    overlap = size - step
    last = F.greatest(F.lit(0), F.floor((n - overlap - 1) / step)).cast("int")
    return F.sequence(F.lit(0), last)


def chunk_fixed(docs: DataFrame, size: int = 200, overlap: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, chunk, text)``: windows of ``size`` code points, each ``overlap`` into the one before.

    A window begins while more than ``overlap`` characters are left. An empty
    text is one empty chunk, a null text none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    step = size - overlap
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("__t"))
    own = own.withColumn("chunk", F.explode(_windows(F.length("__t"), size, step)))
    return own.select(id_col, "chunk", F.substring("__t", F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def chunk_tokens(docs: DataFrame, size: int = 100, overlap: int = 20, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, chunk, n_tokens, text)``: windows of ``size`` tokens, joined by a space.

    Texts without tokens have no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    step = size - overlap
    own = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("__t")).where(F.size("__t") > 0)
    own = own.withColumn("chunk", F.explode(_windows(F.size("__t"), size, step)))
    part = F.slice("__t", F.col("chunk") * step + 1, F.lit(size))
    return own.select(id_col, "chunk", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("text"))


def split_recursive(text: str, size: int, separators: list[str]) -> list[str]:
    """Pieces of at most ``size`` characters that add up to ``text``.

    The text is cut after each occurrence of the first separator; pieces that
    are still too long are cut by the next one, at last between characters.
    Neighbouring pieces are merged as long as they fit.
    """
    if len(text) <= size:
        return [text] if text else []
    sep, rest = separators[0], separators[1:]
    cut = [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]] if sep else [text[i : i + size] for i in range(0, len(text), size)]
    out: list[str] = []
    for piece in (q for p in cut for q in ([p] if len(p) <= size else split_recursive(p, size, rest or [""]))):
        if out and len(out[-1]) + len(piece) <= size:
            out[-1] += piece
        elif piece:
            out.append(piece)
    return out


def chunk_recursive(docs: DataFrame, size: int = 500, separators: list[str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, chunk, text)`` by ``split_recursive``; the chunks of a text add up to it.

    Null and empty texts have no chunk. The separators are tried one inside
    the other, which SQL expressions can't nest to unknown depth, so it runs
    on Arrow batches.
    """
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seps = list(separators or SEPARATORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [split_recursive(t, size, seps) for t in batch.column(1).to_pylist()]
            at = pa.array([k for k, c in enumerate(each) for _ in c], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([k for c in each for k in range(len(c))], pa.int32()), pa.array([t for c in each for t in c], pa.string())], [id_col, "chunk", "text"])

    return own.mapInArrow(run, f"`{id_col}` {own.schema['id'].dataType.simpleString()}, chunk int, text string")

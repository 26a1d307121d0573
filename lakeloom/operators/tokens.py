"""Token counts by a byte-pair vocabulary."""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import tokens


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tok, n)``: how often each token occurs in each row's text.

    Tokens are sorted and runs of equal ones counted by their places, so it
    takes n log n steps within the row and nothing is exchanged. An id that
    repeats is counted row by row; null and empty texts have no token.
    """
    own = docs.select(F.col(id_col), F.sort_array(tokens(F.col(text_col))).alias("__t")).where(F.size("__t") > 0)
    # Each step is a column of its own: a lambda would compute an expression anew for every element.
    places = F.sequence(F.lit(0), F.size("__t") - 1)
    own = own.withColumn("__p", F.filter(places, lambda i: (i == 0) | (F.get("__t", i - 1) != F.get("__t", i))))
    runs = F.transform("__p", lambda p, k: F.struct(F.get("__t", p).alias("tok"), (F.coalesce(F.get("__p", k + 1), F.size("__t")) - p).cast("long").alias("n")))
    return own.select(id_col, F.explode(runs).alias("__r")).select(id_col, "__r.tok", "__r.n")


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_count(df: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "n_bpe") -> DataFrame:
    """``df`` with the number of tokens of each text under the vocabulary file ``path``; null for null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        own = _encoding(path, pattern)
        return texts.map(lambda t: None if t is None else len(own.encode_ordinary(t))).astype("Int64")

    return df.withColumn(name, count(text_col))

import random
import shutil

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakeloom.operators import bm25_index
from lakeloom.operators.bm25 import bm25

WORDS = [f"w{k}" for k in range(60)]


def some_docs(spark, n=900, seed=1):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(WORDS[: rng.choice([5, 20, 60])]) for _ in range(rng.randint(0, 30)))
    rows = [(k, text()) for k in range(n)] + [(7, text()), (None, "w1 w2"), (5000, None), (5001, ""), (5002, "W3 w3, É w59")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def plain(docs, terms, k, digits):
    scores = bm25(docs, terms)
    return [(r.doc_id, r.score) for r in scores.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "doc_id").limit(k).collect()]


def test_it_ranks_as_all_scores_do(spark, monkeypatch):
    docs = some_docs(spark)
    for block, shard, first, named in ((2, 2, 1, 3),):
        for name, value in (("BLOCK_BITS", block), ("SHARD_BITS", shard), ("FIRST", first), ("NAMED", named), ("HELD", 5 * first)):
            monkeypatch.setattr(bm25_index, name, value)
        index = bm25_index.build(docs)
        for terms in (["w1", "W1", "w40"], ["w3", "é", "absent"], []):
            for k in (3, 2000):
                got = [(r.id, r.score) for r in bm25_index.topk(spark, index, terms, k, digits=6).collect()]
                assert got == (plain(docs, terms, k, 6) if terms else []), (block, terms, k)


def test_postings_of_other_blocks_are_not_read(spark, tmp_path, monkeypatch):
    """What isn't opened may as well be gone: all shards but those of blocks that can count are removed."""
    for name, value in (("BLOCK_BITS", 2), ("SHARD_BITS", 1), ("FIRST", 2)):
        monkeypatch.setattr(bm25_index, name, value)
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["rare" if k % 40 == 3 else "x", "common", "y", "z"]) for _ in range(12))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = bm25_index.build(docs, f"file://{tmp_path}/index")
    want = plain(docs, ["rare", "common"], 3, 6)
    bounds = {}
    for r in spark.read.parquet(f"file://{tmp_path}/index/blocks").where("term in ('rare', 'common')").collect():
        bounds.setdefault(r.block >> 1, []).append(r)
    spared = []
    removed = 0
    for folder in (tmp_path / "index" / "postings").glob("shard=*"):
        if any(r.term == "rare" for r in bounds.get(int(folder.name[6:]), ())):
            spared.append(folder)
        else:
            shutil.rmtree(folder)
            removed += 1
    assert removed > len(spared) > 2
    spark.catalog.clearCache()
    assert [(r.id, r.score) for r in bm25_index.topk(spark, index, ["rare", "common"], 3, digits=6).collect()] == want


def test_few_postings_pass_the_scan(spark, monkeypatch):
    for name, value in (("BLOCK_BITS", 4), ("SHARD_BITS", 3)):
        monkeypatch.setattr(bm25_index, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    index = bm25_index.build(docs)
    read, real = [], bm25_index.Index.postings

    class Seen:
        """Keeps what ``where`` leaves of the table."""

        def __init__(self, df):
            self.df = df

        def where(self, condition):
            kept = self.df.where(condition)
            read.append(kept.select("block").distinct().count())
            return kept

    whole = real(index, spark).select("block").distinct().count()
    monkeypatch.setattr(bm25_index.Index, "postings", lambda *x: Seen(real(*x)))
    terms = ["that", "erblest", "hein"]
    got = [(r.id, r.score) for r in bm25_index.topk(spark, index, terms, 10, digits=6).collect()]
    assert got == plain(docs, terms, 10, 6)
    print(f"blocks read {sum(read)} of {whole}")
    assert 0 < sum(read) < whole


def test_an_empty_index_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bm25_index.topk(spark, bm25_index.build(none), ["a"]).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "x"), (2, "a", 6, "y")], "shard long, term string, doc long, p string")
    index = bm25_index.build(odd, id_col="shard", text_col="term")
    assert [r.id for r in bm25_index.topk(spark, index, ["a"]).collect()] == [2, 1]


def test_the_query_has_the_rows_of_the_other(spark):
    sf = "/root/testdata/sf0.01"
    queries = entry.queries()
    assert list(map(tuple, queries["bm25_indexed"](spark, sf).collect())) == list(map(tuple, queries["bm25_topk"](spark, sf).collect()))

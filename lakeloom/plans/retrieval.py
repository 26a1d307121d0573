"""Retrieval queries: tokens, chunks, BM25, vectors, fusion, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.text import html_to_text
from lakeloom.operators import bm25_index, chunking, clients, fusion, minhash, stored, structured, summaries, vectors
from lakeloom.operators.bm25 import bm25
from lakeloom.operators.dedup import one_of_each_text
from lakeloom.operators.ivf import knn_approx as ivf_search
from lakeloom.operators.pages import page_texts
from lakeloom.operators.tokens import bpe_count, token_counts
from lakeloom.plans.query import Query
from lakeloom.sources.shared import scratch
from lakeloom.sources.tables import table

TERMS = ["that", "erblest", "hein"]

BM25_SQL = r"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS tok FROM documents),
len AS (SELECT doc_id, count(*)::double AS l FROM tok GROUP BY 1),
st AS (SELECT count(*)::double AS n, avg(l) AS a FROM len),
tf AS (SELECT doc_id, tok, count(*)::double AS f FROM tok WHERE tok IN ('that','erblest','hein') GROUP BY 1, 2),
df AS (SELECT tok, count(*)::double AS d FROM tf GROUP BY 1)
SELECT doc_id, round(sum(ln(1+(n-d+0.5e0)/(d+0.5e0)) * f*2.5e0 / (f+1.5e0*(0.25e0+0.75e0*l/a))), 6) AS score
FROM tf JOIN df USING (tok) JOIN len USING (doc_id), st GROUP BY doc_id
"""

KNN_SQL = """
WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) AS sim
           FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 {where})
SELECT query, id, rank::int AS rank, round(sim, 6) AS sim
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 10
"""


def bm25_scores(spark, sf_dir):
    return bm25(table(spark, sf_dir, "documents"), TERMS).withColumn("score", F.round("score", 6))


def bm25_topk(spark, sf_dir, k: int = 10):
    return bm25_scores(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(k)


def bm25_indexed(spark, sf_dir, k: int = 10):
    """The same rows as ``bm25_topk`` from an index of all documents, blocks that can't count passed over."""
    index = bm25_index.build(table(spark, sf_dir, "documents"))
    return bm25_index.topk(spark, index, TERMS, k, digits=6).withColumnRenamed("id", "doc_id")


def tokenize(spark, sf_dir):
    """Token counts of each document, taken within its row."""
    return token_counts(table(spark, sf_dir, "documents"))


def page_text(spark, sf_dir):
    """The text of every raw page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html_to_text(F.col("html")).alias("text"))


def page_main_text(spark, sf_dir):
    """Title, text and main text of every raw page, by states that SQL can't express."""
    return page_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def distinct_texts(spark, sf_dir):
    """Every text once, by digest, with how many documents have it and the first of them."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def near_duplicate_texts(spark, sf_dir):
    """Every document with the first of its copies and the first of its near-duplicates; by chance, so without SQL."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def deduplicated_texts(spark, sf_dir):
    """One document of each text, all its columns."""
    return one_of_each_text(table(spark, sf_dir, "documents"))


PLACES = 8


def client_embeddings(spark, sf_dir):
    """Vectors by an injected client: words counted by their hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = structured.with_client(docs, "text", clients.hashed_words(PLACES), "v", "array<double>")
    return made.select("doc_id", *[F.col("v")[k].alias(f"v{k}") for k in range(PLACES)])


def client_completions(spark, sf_dir):
    """Answers of an injected client to rendered prompts: the longest word."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", "turn", structured.prompt_render("{role}: {text}", role=F.col("role"), text=F.col("text")).alias("prompt"))
    made = structured.with_client(asked, "prompt", clients.longest_word, "answer", "string")
    return made.select("conv_id", "turn", "answer")


def chunk_fixed(spark, sf_dir):
    return chunking.chunk_fixed(table(spark, sf_dir, "documents"))


def chunk_tokens(spark, sf_dir):
    return chunking.chunk_tokens(table(spark, sf_dir, "documents"))


def chunk_recursive(spark, sf_dir):
    return chunking.chunk_recursive(table(spark, sf_dir, "documents"))


def bpe_counts(spark, sf_dir):
    import public_tokenizers as p

    return bpe_count(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN).select("doc_id", "n_bpe")


def _queries_of(embeddings):
    return embeddings.where(F.col("vec_id") % 50 == 0)


def knn_exact(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.knn_exact(_queries_of(e), e).withColumn("sim", F.round("sim", 6))


def knn_filtered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.knn_filtered(_queries_of(e), e, F.col("label") == 1).withColumn("sim", F.round("sim", 6))


def knn_approx(spark, sf_dir):
    """Approximate, so without SQL; a test measures its recall against ``knn_exact``."""
    e = table(spark, sf_dir, "embeddings")
    return ivf_search(_queries_of(e), e).withColumn("sim", F.round("sim", 6))


def vector_distances(spark, sf_dir):
    """Distances between every vector and each of the stated queries, which are a row each."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.distances(_queries_of(e), e, digits=6)


def vector_upsert(spark, sf_dir):
    """Ids divisible by 5 get a new label, those by 7 go; the later change wins."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    first = e.where("vec_id % 5 = 0").select("vec_id", F.lit(100).alias("label"), F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    second = e.where("vec_id % 7 = 0").select("vec_id", "label", F.lit(2).alias("version"), F.lit(True).alias("deleted"))
    return vectors.upsert(e, first.unionByName(second))


def stored_upsert(spark, sf_dir):
    """The same changes to a table in buckets on disk, one after the other; a second run of the last rewrites nothing."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    kept = stored.create(e, scratch(spark, "stored") + "/rows", buckets=16)
    kept.upsert(e.where("vec_id % 5 = 0").select("vec_id", F.lit(100).alias("label"), F.lit(1).alias("version"), F.lit(False).alias("deleted")))
    gone = e.where("vec_id % 7 = 0").select("vec_id", "label", F.lit(2).alias("version"), F.lit(True).alias("deleted"))
    kept.upsert(gone)
    return kept.rows().withColumn("again", F.lit(kept.upsert(gone)))


def rrf(spark, sf_dir):
    """BM25's hundred best fused with the hundred vectors nearest to each query, on the number alone."""
    e = table(spark, sf_dir, "embeddings")
    lexical = bm25_topk(spark, sf_dir, 100)
    first = lexical.agg(F.sort_array(F.collect_list(F.struct(-F.col("score"), "doc_id"))).alias("x")).select(F.posexplode("x").alias("k", "x")).select(F.col("x.doc_id").alias("id"), (F.col("k") + 1).alias("rank"))
    asked = _queries_of(e).select(F.col("vec_id").alias("query"))
    # A hundred rows: the lexical list is the same for every query.
    first = asked.crossJoin(F.broadcast(first))
    second = vectors.knn_exact(_queries_of(e), e, 100).select("query", "id", "rank")
    pair = F.struct("query", "id").alias("id")
    fused = fusion.rrf([first.select(pair, "rank"), second.select(pair, "rank")])
    return fused.select("id.query", "id.id", F.round("score", 9).alias("score"))


def mmr(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = vectors.knn_exact(_queries_of(e), e, 20)
    with_v = near.join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id")
    return fusion.mmr(with_v.select("query", "id", "sim", "v"))


def parse_structured(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props")
    good, _ = structured.parse_structured(events, "props", "k int")
    return good.select("event_id", F.col("parsed.k").alias("k"))


def prompt_render(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", structured.prompt_render("[{role}] {text}\n", role=F.col("role"), text=F.col("text")).alias("prompt"))


def history_window(spark, sf_dir):
    own = structured.history_window(table(spark, sf_dir, "conversations"))
    return own.select("conv_id", "turn", F.array_join(F.transform("history", lambda h: F.concat_ws(": ", h["role"], h["text"])), "\n").alias("history"))


def describe(spark, sf_dir):
    return summaries.describe(table(spark, sf_dir, "documents"), "lang", "n_chars")


def correlation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("r"))


def histogram(spark, sf_dir):
    return summaries.histogram(table(spark, sf_dir, "documents"), F.col("n_chars"), 1000.0)


def retrieval_metrics(spark, sf_dir):
    """The ten nearest vectors; all vectors of the query's label are relevant, and are counted, not listed."""
    e = table(spark, sf_dir, "embeddings")
    near = vectors.knn_exact(_queries_of(e), e, 10).select("query", "id", "rank")
    labels = e.select(F.col("vec_id").alias("id"), "label")
    judged = near.join(labels, "id").join(labels.select(F.col("id").alias("query"), F.col("label").alias("own")), "query")
    counts = _queries_of(e).select(F.col("vec_id").alias("query"), "label").join(e.groupBy("label").agg(F.count("*").alias("n")), "label").select("query", "n")
    out = fusion.retrieval_metrics(near, judged.select("query", "id", (F.col("label") == F.col("own")).cast("int").alias("grade")), relevant=counts)
    return out.select("query", "hit", F.round("rr", 9).alias("rr"), F.round("ndcg", 9).alias("ndcg"))


METRICS_SQL = """
WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, (e.label = q.label)::int AS grade,
                  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::double[], e.embedding::double[]) DESC, e.vec_id) AS rank
           FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10),
c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
i AS (SELECT query, sum(1 / log2(r + 1)) AS ideal FROM (SELECT q.vec_id AS query, unnest(range(1, least(10, n) + 1)) AS r FROM embeddings q JOIN c USING (label) WHERE q.vec_id % 50 = 0) GROUP BY 1),
f AS (SELECT query, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM s WHERE grade > 0 AND rank <= 10 GROUP BY 1)
SELECT query, (first IS NOT NULL)::int AS hit, round(coalesce(1 / first, 0), 9) AS rr, CASE WHEN ideal IS NOT NULL THEN round(coalesce(dcg / ideal, 0), 9) END AS ndcg
FROM (SELECT DISTINCT query FROM s) LEFT JOIN f USING (query) LEFT JOIN i USING (query)
"""

QUERIES = {
    "retrieval_metrics": Query(retrieval_metrics, METRICS_SQL),
    "bm25": Query(bm25_scores, BM25_SQL),
    "bm25_topk": Query(bm25_topk, BM25_SQL + " ORDER BY score DESC, doc_id LIMIT 10"),
    "bm25_indexed": Query(bm25_indexed, BM25_SQL + " ORDER BY score DESC, doc_id LIMIT 10"),
    "tokenize": Query(tokenize, r"SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS tok FROM documents) GROUP BY 1, 2"),
    "page_text": Query(page_text, r"SELECT page_id, url, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS text FROM pages"),
    "page_main_text": Query(page_main_text),
    "distinct_texts": Query(distinct_texts, "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1"),
    "near_duplicate_texts": Query(near_duplicate_texts),
    "deduplicated_texts": Query(deduplicated_texts, "SELECT doc_id, text, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"),
    "client_embeddings": Query(
        client_embeddings,
        "WITH w AS (SELECT doc_id, (md5_number_lower(w) % 8)::int AS k, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS w FROM documents) GROUP BY 1, 2) SELECT d.doc_id, "
        + ", ".join(f"coalesce(sum(n) FILTER (k = {k}), 0)::double AS v{k}" for k in range(PLACES))
        + " FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id",
    ),
    "client_completions": Query(
        client_completions,
        """SELECT conv_id, turn, coalesce(list_sort(list_transform(w, lambda x: lpad((100000 - length(x))::varchar, 6, '0') || x))[1][7:], '') AS answer
        FROM (SELECT conv_id, turn, regexp_extract_all(translate(coalesce(role, '') || ': ' || coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+') AS w FROM conversations)""",
    ),
    "chunk_fixed": Query(chunk_fixed, "SELECT doc_id, i::int AS chunk, substring(text, (i*150+1)::int, 200) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(0, (length(text)-51)//150)+1)) AS i FROM documents)"),
    "chunk_tokens": Query(
        chunk_tokens,
        r"""SELECT doc_id, i::int AS chunk, len(t[i*80+1:i*80+100])::int AS n_tokens, array_to_string(t[i*80+1:i*80+100], ' ') AS text
        FROM (SELECT doc_id, t, unnest(range(0, greatest(0, (len(t)-21)//80)+1)) AS i
              FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents) WHERE len(t) > 0)""",
    ),
    "chunk_recursive": Query(chunk_recursive),
    "bpe_count": Query(bpe_counts),
    "knn_exact": Query(knn_exact, KNN_SQL.format(where="")),
    "knn_filtered": Query(knn_filtered, KNN_SQL.format(where="AND e.label = 1")),
    "knn_approx": Query(knn_approx),
    "vector_distances": Query(
        vector_distances,
        """SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) AS cos,
        round(list_distance(q.embedding::double[], e.embedding::double[]), 6) AS l2, round(list_inner_product(q.embedding::double[], e.embedding::double[]), 6) AS ip
        FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q""",
    ),
    "vector_upsert": Query(vector_upsert, "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 100 ELSE label END AS label FROM embeddings WHERE vec_id % 7 <> 0"),
    "stored_upsert": Query(stored_upsert, "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 100 ELSE label END AS label, 0 AS again FROM embeddings WHERE vec_id % 7 <> 0"),
    "rrf": Query(
        rrf,
        f"""WITH b AS ({BM25_SQL}), l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b QUALIFY r <= 100),
        v AS (SELECT q.vec_id AS query, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::double[], e.embedding::double[]) DESC, e.vec_id) AS r
              FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY r <= 100)
        SELECT query, id, round(sum(1e0/(60+r)), 9) AS score FROM (SELECT vec_id AS query, id, r FROM l, embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT * FROM v) GROUP BY query, id""",
    ),
    "mmr": Query(mmr),
    "parse_structured": Query(parse_structured, "SELECT event_id, (props->>'k')::int AS k FROM events"),
    "prompt_render": Query(prompt_render, "SELECT conv_id, turn, '[' || coalesce(role, '') || '] ' || coalesce(text, '') || chr(10) AS prompt FROM conversations"),
    "history_window": Query(history_window, "SELECT conv_id, turn, array_to_string(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), chr(10)) AS history FROM conversations"),
    "describe": Query(
        describe,
        """SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, round(quantile_cont(n_chars, 0.25), 6) AS q1,
        round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.75), 6) AS q3, max(n_chars) AS max FROM documents GROUP BY lang""",
    ),
    "correlation": Query(correlation, "SELECT round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem"),
    "histogram": Query(histogram, "SELECT floor(n_chars / 1000)::bigint AS bin, count(*) AS n FROM documents GROUP BY 1"),
}

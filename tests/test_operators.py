import json
import math
import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakeloom.functions.text import html_to_text
from lakeloom.operators import chunking, clients, dedup, fusion, grid, ivf, joins, structured, summaries, timejoins, vectors
from lakeloom.operators.bm25 import bm25
from lakeloom.operators.tokens import token_counts
from lakeloom.sources import jsonl
from lakeloom.sources.files import read_table, write_table
from lakeloom.streaming import queries as streaming


def test_entry_has_a_row_for_each_of_ten_documents(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_a_session_and_without_the_optional_parts():
    code = "import sys; sys.modules['lakeloom.llm'] = None; import __spark_entry__ as e; assert 'bm25' in e.queries() and not any(k.startswith('op1') for k in e.queries())"
    root = entry.__file__.rsplit("/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
    assert subprocess.run([sys.executable, "-c", code.replace("lakeloom.llm", "corpus_pipeline")], cwd=root).returncode == 0
    if os.path.exists(f"{root}/lakeloom/llm/queries.py") and os.path.exists(f"{root}/corpus_pipeline.py"):
        other = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
        assert subprocess.run([sys.executable, "-c", other], cwd=root, capture_output=True).returncode == 1


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, ""), (4, None), (5, "d d d d")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in bm25(docs, ["B", "b", "absent"]).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got == {1: pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 3)))}


def test_chunks_add_up_to_the_text(spark):
    rng = random.Random(1)
    texts = ["", "a", "x" * 50, None, *("".join(rng.choice("ab \n.") for _ in range(rng.randint(0, 400))) for _ in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = chunking.chunk_recursive(docs, 40).collect()
    for k, text in enumerate(texts):
        own = sorted((r.chunk, r.text) for r in parts if r.doc_id == k)
        assert "".join(t for _, t in own) == (text or "") and all(len(t) <= 40 for _, t in own)
    fixed = chunking.chunk_fixed(docs, 30, 10).collect()
    for k, text in enumerate(texts):
        own = [t for _, t in sorted((r.chunk, r.text) for r in fixed if r.doc_id == k)]
        assert own[:1] == ([] if text is None else [text[:30]])
        assert "".join([*own[:1], *(t[10:] for t in own[1:])]) == (text or "")
    with pytest.raises(ValueError):
        chunking.chunk_fixed(docs, 10, 10)


def test_vectors_of_no_length_null_and_ties(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [-1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for asked, rows, few in ((1, 1, 1), (2, 3, 2), (4096, 1 << 14, 512)):
        monkeypatch.setattr(grid, "ASKED_BLOCK", asked)
        monkeypatch.setattr(grid, "ROW_BLOCK", rows)
        for name in ("QUERIES", "VECTORS", "PAIRS"):
            monkeypatch.setattr(vectors, name, few)
        got = {(r.query, r["rank"]): r.id for r in vectors.knn_exact(e, e, 2).collect()}
        assert got == {(1, 1): 1, (1, 2): 2, (2, 1): 1, (2, 2): 2, (3, 1): 3, (3, 2): 1, (6, 1): 6, (6, 2): 3}
    d = e.select(vectors.cosine("embedding", "embedding").alias("c"), vectors.l2(F.col("embedding"), F.array(F.lit(0.0), F.lit(0.0))).alias("l"), "vec_id")
    assert {r.vec_id: (r.c, r.l) for r in d.collect()} == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (None, 0), 5: (None, None), 6: (1, 1)}
    assert vectors.knn_exact(e.limit(0), e, 2).count() == 0


def test_nearest_vectors_of_many_blocks_ties_and_odd_rows(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)] + [(100 + k, [0.3, 0.4, -0.5, 1.0]) for k in range(30)] + [(100, [0.3, 0.4, -0.5, 1.0])]
    odd = [(200, [1.0, None, 0.0, 0.0]), (201, [math.inf, 0.0, 0.0, 0.0]), (202, [math.nan] * 4), (203, []), (204, [1.0, 2.0]), (205, [2.0, 4.0]), (206, None)]
    e = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)

    def plain(k):
        unit = [(i, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in [*rows, odd[4], odd[5]]]
        out = []
        for q in {i for i, _ in unit}:
            sims = [(-round(sum(x * y for x, y in zip(v, w, strict=True)), 9), i) for j, v in unit if j == q for i, w in unit if len(v) == len(w)]
            out += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(sims)[:k], 1)]
        return sorted(out)

    found = lambda k: sorted((r["query"], r.id, round(r.sim, 9), r["rank"]) for r in vectors.knn_exact(e, e, k).collect())
    assert found(3) == plain(3)
    for name, size in (("ASKED_BLOCK", 20), ("ROW_BLOCK", 7)):
        monkeypatch.setattr(grid, name, size)
    for name in ("QUERIES", "VECTORS", "PAIRS"):
        monkeypatch.setattr(vectors, name, 5)
    assert found(3) == plain(3) and found(40) == plain(40)


def test_nearest_vectors_go_nowhere_near_the_driver(spark):
    e = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "vec_id long, embedding array<double>")
    plan = vectors.knn_exact(e, e, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "LocalTableScan" not in plan


def test_a_worker_holds_a_slice_of_all_pairs(tmp_path):
    """4,096 queries and 10,000 vectors in one cell: what the process takes at most, all libraries included."""
    code = """
import resource, sys
import numpy as np, pyarrow as pa
from lakeloom.operators import grid, vectors
rng = np.random.default_rng(0)
column = lambda n: pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64, dtype=np.int32)), pa.array(rng.normal(size=64 * n)))
side = lambda kind, n, name: (kind, n, pa.StructArray.from_arrays([pa.array(np.arange(n)), column(n)], [name, "v"]))
def batches():
    for kind, n, x in (side(0, 4096, "query"), side(1, 10000, "id")):
        zero = pa.array(np.zeros(n, np.int64))
        none = pa.nulls(n, pa.struct([("query" if kind else "id", pa.int64()), ("v", pa.list_(pa.float64()))]))
        yield pa.RecordBatch.from_arrays([zero, zero, zero, pa.array(np.full(n, kind)), *((none, x) if kind else (x, none))], list("gbakxy"))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for b in grid._run(lambda: vectors._Nearest(10))(batches()))
print(n, before // 1024, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    root = entry.__file__.rsplit("/", 1)[0]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, env=os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"})
    rows, before, most = map(int, out.stdout.split())
    print(f"worker: {before} MB before, {most} MB at most")
    assert rows == 40960 and most < 300


def test_distances_of_all_pairs_match_by_block(spark, monkeypatch):
    e = spark.createDataFrame([(k, [float(k), 1.0], k % 3) for k in range(20)], "vec_id long, v array<double>, g long")
    want = sorted((a, b) for a in range(0, 20, 4) for b in range(20) if a % 3 == b % 3)
    for asked, rows in ((256, 4096), (2, 3)):
        monkeypatch.setattr(grid, "PAIRS_ASKED", asked)
        monkeypatch.setattr(grid, "PAIRS_ROWS", rows)
        got = grid.pairs(e.where("vec_id % 4 = 0"), e, group="g").select("x0.vec_id", F.col("x1.vec_id").alias("other"))
        assert sorted(map(tuple, got.collect())) == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_distances_of_odd_vectors(spark):
    v = [[1.0, 2.0], [-3.0, 0.5], [0.0, 0.0], None, [], [1.0, None], [math.nan, 1.0], [math.inf, 1.0], [2.0], [1.0, 2.0], [1e-9, 0.1234565]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 0, None]
    rows = list(zip(ids, v, strict=True))

    def plain(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return None, None, None
        ip = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), 0.0)
        long = math.sqrt(ip(a, a) * ip(b, b))
        cos = (ip(a, b) / long if long else math.nan) if a else None
        d = [p - q for p, q in zip(a, b, strict=True)]
        return cos and min(1.0, max(-1.0, cos)) if cos == cos else cos, math.sqrt(ip(d, d)), ip(a, b)

    for kind in ("double", "float"):
        e = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
        held = [(r.vec_id, r.embedding) for r in e.collect()]
        got = [tuple(r) for r in vectors.distances(e, e).collect()]
        assert sorted(map(repr, got)) == sorted(repr((i, j, *plain(a, b))) for i, a in held for j, b in held)
        assert vectors.distances(e.limit(0), e).count() == 0
    third = e.where("vec_id = 8")
    assert [tuple(r) for r in vectors.distances(third, third.selectExpr("9L AS vec_id", "array(1.23456789f) AS embedding"), digits=3).collect()] == [(8, 9, 1.0, 0.765, 2.469)]
    import numpy as np

    assert vectors._rounded(np.array([0.5, -0.5, 1.5, 0.49999999999999994, -2.4, math.inf, 1e308]), 0).tolist() == [1, -1, 2, 0, -2, math.inf, 1e308]
    assert vectors._rounded(np.array([0.1234565, 1e308, -2.5e-6]), 6).tolist() == [0.123457, 1e308, -3e-6]


def test_distances_by_slice_are_the_same_bits():
    import numpy as np
    import pyarrow as pa

    rng, seen = np.random.default_rng(5), set()
    ids, v = pa.array(np.arange(70)), pa.array(rng.normal(size=(70, 9)).tolist())
    for sizes in ((32, 512), (1, 1), (7, 30)):
        cell = vectors._Distances(None)
        vectors.TILE_QUERIES, vectors.TILE_VECTORS, kept = *sizes, (vectors.TILE_QUERIES, vectors.TILE_VECTORS)
        try:
            for a in (0, 40):
                cell.ask([ids.slice(a, 40), v.slice(a, 40)])
            found = [b for a in (0, 33, 66) for b in cell.feed([ids.slice(a, 33), v.slice(a, 33)])]
        finally:
            vectors.TILE_QUERIES, vectors.TILE_VECTORS = kept
        assert all(b.num_rows <= sizes[0] * sizes[1] for b in found) and cell.end().num_rows == 0
        seen.add(tuple(sorted(t for b in found for t in zip(*b.to_pydict().values(), strict=True))))
    assert len(seen) == 1 and len(seen.pop()) == 4900


def test_rounded_distances_are_those_of_ordered_sums():
    import numpy as np

    rng = np.random.default_rng(6)
    copies = rng.normal(size=(300, 5))
    copies[::3], copies[5], copies[6], copies[7, 1], copies[8:40] = copies[0], 0, math.nan, math.inf, copies[8] + 1e-9 * rng.normal(size=(32, 5))
    turned = rng.normal(size=(300, 2))
    turned[1::2] = turned[::2, ::-1] * [1, -1]  # at right angles, up to rounding
    halves = np.round(rng.normal(size=(300, 2)), 4) * 0.5
    for v in (copies, turned, halves, rng.normal(size=(300, 8)) * 10.0 ** rng.integers(-12, 12, size=(300, 1)), np.eye(300), rng.normal(size=(300, 64))):
        x = np.ascontiguousarray(v.T)
        with np.errstate(all="ignore"):
            norm = sum(a * a for a in x)
        whole, quick = vectors._rounded(vectors._distances(x, x, norm, norm), 6), vectors._rounded_distances(x, x, norm, norm, 6)
        assert np.array_equal(whole, quick, equal_nan=True) and np.array_equal(np.signbit(whole)[whole == 0], np.signbit(quick)[quick == 0])


def test_a_million_distances_take_seconds(spark, tmp_path):
    """Summed for each pair by lambdas in the JVM they took 58 s."""
    import time

    from lakeloom.plans import retrieval

    spark.range(7000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.sin(F.col("id") * k).cast("float")).alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    began = time.perf_counter()
    out = retrieval.vector_distances(spark, str(tmp_path))
    assert "aggregate(" not in out._jdf.queryExecution().executedPlan().toString()
    n = out.agg(F.count("*"), F.count("cos"), F.sum("l2"), F.sum("ip")).first()[0]
    took = time.perf_counter() - began
    print(f"{n} pairs in {took:.1f} s")
    assert n == 980_000 and took < 30


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_approximate_neighbours_reach_the_recall(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").repartition(4)
    q = e.where("vec_id % 50 = 0")
    index = ivf.fit(e)
    found = ivf.search(q, ivf.build(e, index), 10)
    exact = vectors.knn_exact(q, e)
    hits = found.join(exact.select("query", "id"), ["query", "id"]).count()
    print(f"{sf}: recall {hits / exact.count():.3f}, probes {index.probes} of {len(index.centroids)}, error {index.error:.3f}")
    assert hits >= 0.9 * exact.count()


def clustered_vectors(spark, n=6000, d=32, centres=48):
    import numpy as np

    rng = np.random.default_rng(3)
    c = rng.normal(size=(centres, d))
    v = c[rng.integers(0, centres, n)] + 0.25 * rng.normal(size=(n, d))
    return spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(4)


def test_lists_that_no_query_probes_are_not_read(spark, tmp_path):
    import pyarrow.parquet as pq

    e = clustered_vectors(spark)
    q = e.where("vec_id in (5, 17, 99, 1234, 4321)")
    index = ivf.fit(e)
    stored = ivf.build(e, index, f"file://{tmp_path}/lists")
    found = ivf.search(q, stored, 10)
    exact = vectors.knn_exact(q, e)
    recall = found.join(exact.select("query", "id"), ["query", "id"]).count() / exact.count()
    asked = vectors.unit(__import__("numpy").array([r.embedding for r in q.collect()]))[0]
    opened = {int(n) for n in index.probed(asked).ravel()}
    whole = read = 0
    for file in (tmp_path / "lists").glob("list=*/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        sizes = [meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups) for c in range(meta.num_columns)]
        whole += sum(sizes)
        read += sum(sizes) if int(file.parent.name[5:]) in opened else 0
    print(f"recall {recall:.3f}, {len(opened)} of {len(index.centroids)} lists, {read / whole:.3f} of the bytes")
    assert recall >= 0.9 and read < 0.5 * whole
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^]]*list#\d+ IN", plan)) == 1


def test_codes_save_reading_vectors_and_never_lose_a_neighbour_by_rank(spark):
    """With all lists probed and an error that covers every difference, the result is exact."""
    import dataclasses

    e = clustered_vectors(spark, n=900, d=8)
    q = e.where("vec_id % 30 = 0")
    index = dataclasses.replace(ivf.fit(e, lists=6), probes=6, error=1.0)
    near = lambda df: sorted((r["query"], r["rank"], r.id, round(r.sim, 9)) for r in df.collect())
    assert near(ivf.search(q, ivf.build(e, index), 7)) == near(vectors.knn_exact(q, e, 7))


def test_approximate_neighbours_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.1]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {(r.query, r.id) for r in ivf.knn_approx(e, e, 2, 2, 1.0).collect()} == {(1, 1), (1, 4), (4, 4), (4, 1)}
    assert ivf.knn_approx(e.limit(0), e.limit(0)).count() == 0
    assert ivf.knn_approx(e.limit(0), e).count() == 0


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "vec_id long, v string")
    changes = spark.createDataFrame([(1, "x", 1, False), (1, "y", 2, False), (2, "b", 5, True), (4, "new", 1, None)], "vec_id long, v string, version int, deleted boolean")
    once = vectors.upsert(base, changes)
    assert sorted(map(tuple, once.collect())) == [(1, "y"), (3, "c"), (4, "new")]
    assert sorted(map(tuple, vectors.upsert(once, changes).collect())) == [(1, "y"), (3, "c"), (4, "new")]


def test_fusion_and_metrics(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1)], "id string, rank int")
    assert {r.id: r.score for r in fusion.rrf([a, b]).collect()} == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 1 / 61)}
    c = spark.createDataFrame([(1, 10, 0.9, [1.0, 0.0]), (1, 11, 0.8, [1.0, 0.1]), (1, 12, 0.1, [0.0, 1.0])], "query long, id long, sim double, v array<double>")
    assert [r.id for r in fusion.mmr(c, 3, 1.0).orderBy("rank").collect()] == [10, 11, 12]
    assert [r.id for r in fusion.mmr(c, 2, 0.3).orderBy("rank").collect()] == [10, 12]
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1)], "query long, id long, rank int")
    judged = spark.createDataFrame([(1, 6, 1), (2, 9, 2), (3, 1, 0)], "query long, id long, grade int")
    got = {r["query"]: (r.hit, r.rr, r.ndcg) for r in fusion.retrieval_metrics(ranked, judged).collect()}
    assert got == {1: (1, 0.5, pytest.approx(1 / math.log2(3))), 2: (0, 0.0, 0.0), 3: (0, 0.0, None)}
    counts = spark.createDataFrame([(1, 2), (2, 50), (3, 0)], "query long, n long")
    more = {r["query"]: r.ndcg for r in fusion.retrieval_metrics(ranked, judged, relevant=counts).collect()}
    assert more == {1: pytest.approx(1 / math.log2(3) / (1 + 1 / math.log2(3))), 2: 0.0, 3: None}


def test_malformed_json_is_set_apart(spark):
    rows = [(1, '{"k": 1}'), (2, "{broken"), (3, None), (4, "{}"), (5, '{"k": "text"}')]
    good, bad = structured.parse_structured(spark.createDataFrame(rows, "id long, payload string"), "payload", "k int")
    assert {r.id: r.parsed.k for r in good.collect()} == {1: 1, 4: None}
    assert {r.id for r in bad.collect()} == {2, 3, 5}


def test_prompts_history_and_clients(spark):
    turns = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(4)] + [(2, 0, None, None)], "conv_id long, turn long, role string, text string")
    out = turns.select(structured.prompt_render("<{role}> {text} {other}", role=F.col("role"), text=F.col("text")).alias("p")).collect()
    assert out[1].p == "<user> t1 {other}" and out[4].p == "<>  {other}"
    own = {(r.conv_id, r.turn): [h.text for h in r.history] for r in structured.history_window(turns, 2).collect()}
    assert own[(1, 3)] == ["t2", "t3"] and own[(1, 0)] == ["t0"]
    said = structured.with_client(turns, "text", lambda: lambda xs: [len(x or "") for x in xs], "n", "long")
    assert sorted(r.n for r in said.collect()) == [0, 2, 2, 2, 2] and said.columns == [*turns.columns, "n"]
    over = structured.with_client(turns, "text", lambda: lambda xs: [f"{x}!" for x in xs], "text", "string")
    assert sorted(r.text for r in over.collect()) == ["None!", "t0!", "t1!", "t2!", "t3!"]


def test_clients_answer_from_the_text():
    embed = clients.hashed_words(5)()
    out = embed(["a b A", None, "é 1", "b"])
    assert sum(out[0]) == 3 and out[1] == out[2] == [0.0] * 5 and max(out[3]) == 1 and sum(x * y for x, y in zip(out[0], out[3], strict=True)) >= 1
    assert clients.longest_word()(["to be OR not, Bee", "", None, "zz aa"]) == ["bee", "", "", "aa"]


def test_one_row_of_each_text_stays(spark):
    rows = [(3, "a", 1), (1, "a", 2), (None, "a", 3), (1, "a", 2), (None, "b", 4), (5, None, 5), (4, None, 6), (7, "", 7), (2, "A", 8), (9, "c", 9), (9, "c", 10)]
    out = dedup.one_of_each_text(spark.createDataFrame(rows, "doc_id long, text string, __row int").repartition(3))
    assert out.columns == ["doc_id", "text", "__row"]
    got = {r.text: (r.doc_id, r["__row"]) for r in out.collect()}
    assert got.pop("c") in {(9, 9), (9, 10)}
    assert got == {"a": (1, 2), "b": (None, 4), None: (4, 6), "": (7, 7), "A": (2, 8)} and out.count() == 6
    assert dedup.one_of_each_text(out.limit(0)).count() == 0


def test_asof_and_range_joins_match_nested_loops(spark):
    rng = random.Random(3)
    left = [(k, rng.choice([1, 2, None]), rng.choice([None, *range(20)])) for k in range(80)]
    right = [(100 + k, rng.choice([1, 2, None]), rng.choice([None, *range(20)])) for k in range(60)]
    schema = "id long, by long, at long"
    for slot in (None, lambda t: F.floor(t / 4), lambda t: t):
        out = timejoins.asof_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), by="by", ts="at", value="id", name="last", slot=slot)
        got = {r.id: r.last for r in out.collect()}
        assert out.columns == ["id", "by", "at", "last"] and len(got) == out.count() == len(left)
        for key, by, at in left:
            own = [(t, v) for v, b, t in right if b is not None and b == by and t is not None and at is not None and t <= at]
            assert got[key] == (max(own)[1] if own else None)
    spans = [(k, a, a + rng.uniform(-1, 9)) for k, a in enumerate(rng.uniform(-20, 20) for _ in range(50))]
    inf, nan = float("inf"), float("nan")
    spans += [(100, -1e9, 1e9), (101, -inf, 0.0), (102, 0.0, inf), (103, -inf, inf), (104, 0.0, None), (105, nan, 5.0), (106, 0.0, 1e300), (107, 0.0, 3.0), (108, -6.0, 6.0)]
    points = [(k, rng.uniform(-20, 20)) for k in range(60)] + [(97, 0.0), (98, 3.0), (99, None), (100, nan)]
    out = timejoins.range_join(spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(spans, "s long, a double, b double"), at=F.col("x"), start=F.col("a"), end=F.col("b"), width=3.0)
    assert sorted((r.p, r.s) for r in out.collect()) == sorted((p, s) for p, x in points for s, a, b in spans if x is not None and b is not None and a <= x < b)


def test_joins_by_time_keep_all_columns_and_spread_rows_that_match_nothing(spark):
    points = spark.createDataFrame([(1.0, 2, 3)], "x double, level int, bucket int")
    spans = spark.createDataFrame([(0.0, 5.0, 7, 8)], "a double, b double, own_level int, levels int")
    out = timejoins.range_join(points, spans, at=F.col("x"), start=F.col("a"), end=F.col("b"), width=1.0)
    assert out.columns == ["x", "level", "bucket", "a", "b", "own_level", "levels"] and tuple(out.first()) == (1.0, 2, 3, 0.0, 5.0, 7, 8)
    left = spark.createDataFrame([(k, None, k) for k in range(50)] + [(100, 1, None), (101, 1, 5)], "id long, by long, at long")
    right = spark.createDataFrame([(1000, None, 1), (1001, 1, None), (1002, 1, 3)], "id long, by long, at long")
    got = {r.id: r.last for r in timejoins.asof_join(left, right, by="by", ts="at", value="id", name="last").collect()}
    assert got == {**{k: None for k in range(50)}, 100: None, 101: 1002}


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None), (3, 'q"\n')], "k long, t string")
    for kind in ("parquet", "orc", "json", "csv"):
        options = {"multiLine": "true", "escape": '"'} if kind == "csv" else {}
        write_table(df, f"{tmp_path}/{kind}", kind, **{k: v for k, v in options.items() if k == "escape"})
        assert sorted(map(tuple, read_table(spark, f"{tmp_path}/{kind}", kind, "k long, t string", **options).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "csv")


def test_summaries(spark, monkeypatch):
    df = spark.createDataFrame([("a", float(k)) for k in range(5)] + [("b", None)], "g string, v double")
    got = {r.g: (r.n, r["median"]) for r in summaries.describe(df, "g", "v").collect()}
    assert got == {"a": (5, 2.0), "b": (0, None)}
    rng = random.Random(6)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, rng.randint(-9, 9)])) for _ in range(300)]
    wide = spark.createDataFrame(rows, "g string, v int").repartition(3)
    exact = wide.groupBy("g").agg(*[F.round(F.percentile("v", F.lit(q)), 6).alias(name) for name, q in summaries.QUARTILES.items()])
    same = lambda df: sorted((str(r.g), r.q1, r["median"], r.q3) for r in df.collect())
    assert same(summaries.describe(wide, "g", "v")) == same(exact)
    monkeypatch.setattr(summaries, "FEW", 1)
    monkeypatch.setattr(summaries, "PIECES", 3)
    assert same(summaries.describe(wide, "g", "v")) == same(exact)
    assert summaries.describe(wide.limit(0), "g", "v").count() == 0
    assert {r.bin: r.n for r in summaries.histogram(df, F.col("v"), 2.0).collect()} == {0: 2, 1: 2, 2: 1}


def test_late_events_are_dropped_by_the_watermark(spark, tmp_path):
    for k, hours in enumerate(([0, 1, 30], [31], [2, 60])):
        rows = [{"event_id": h, "ts": f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00:00", "user_id": 1, "event_type": "x", "value": 1.0} for h in hours]
        (tmp_path / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(tmp_path / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # files come by age
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path))
    out = streaming.drain(streaming.tumbling(events))
    assert {str(r.start)[:10]: r.n for r in out.collect()} == {"2024-01-01": 2, "2024-01-02": 2}


def test_bpe_counts_are_the_tokenizers(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    from lakeloom.operators.tokens import bpe_count

    texts = ["", None, "Hello, world! It's 2024.", "été 日本", "a" * 300]
    out = bpe_count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    plain = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_bpe for r in out.collect()} == {k: None if t is None else len(plain.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_sketches_are_near_the_exact_counts(spark):
    sf = "/root/testdata/sf0.01"
    exact = {r.l_returnflag: r.n for r in spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n")).collect()}
    queries, top = entry.queries(), {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag", "l_linenumber").count().orderBy(F.desc("count"), "l_linenumber").collect():
        top.setdefault(r.l_returnflag, []).append((r.l_linenumber, r["count"]))
    for r in queries["approximate"](spark, sf).collect():
        assert abs(r.parts / exact[r.l_returnflag] - 1) < 0.1 and abs(r.hll_parts / exact[r.l_returnflag] - 1) < 0.05
        assert [(x.item, x["count"]) for x in r.top] == top[r.l_returnflag][:3]
    for r in queries["sketches"](spark, sf).collect():
        assert abs(r.hll / exact[r.l_returnflag] - 1) < 0.05 and abs(r.theta / exact[r.l_returnflag] - 1) < 0.1


def test_quantiles_of_merged_sketches_are_near_the_exact_ranks(spark):
    sf = "/root/testdata/sf0.01"
    prices = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_extendedprice").collect():
        prices.setdefault(r[0], []).append(r[1])
    for r in entry.queries()["kll_quantiles"](spark, sf).collect():
        own = prices[r.l_returnflag]
        for got, q in ((r.q1, 0.25), (r["median"], 0.5), (r.q3, 0.75)):
            assert abs(sum(x <= got for x in own) / len(own) - q) < 0.02


def batches_of(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # files come by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_update_and_complete_mode_keep_what_all_batches_gave(spark, tmp_path):
    event = lambda user, value: {"user_id": user, "value": value}
    batches = [[event(1, 1.0), event(2, 2.0)], [event(1, 5.0)], [event(3, 7.0), event(3, 1.0)], [event(1, 1.0)]]
    (tmp_path / "a").mkdir()
    totals = streaming.drain(streaming.running_totals(batches_of(spark, tmp_path / "a", batches, "user_id long, value double")), "update", ("user_id",))
    want = [(1, 3, 7.0), (2, 1, 2.0), (3, 2, 8.0)]
    assert sorted(map(tuple, totals.collect())) == want
    (tmp_path / "b").mkdir()
    counted = batches_of(spark, tmp_path / "b", batches, "user_id long, value double").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    assert sorted(map(tuple, streaming.drain(counted, "complete").collect())) == want
    assert sorted(map(tuple, streaming.drain(counted, "update", ("user_id",)).collect())) == want
    with pytest.raises(ValueError):
        streaming.drain(counted, "update")
    (tmp_path / "c").mkdir()
    none = batches_of(spark, tmp_path / "c", [], "user_id long, value double").groupBy("user_id").agg(F.count("*").alias("n"))
    assert streaming.drain(none, "complete").count() == 0


def test_a_timer_reports_users_who_fell_silent(spark, tmp_path):
    at = lambda user, hour: {"user_id": user, "ts": f"2024-01-{1 + hour // 24:02d}T{hour % 24:02d}:00:00"}
    batches = [[at(1, 0), at(2, 0)], [at(2, 20)], [at(3, 40)], [at(2, 41)], [at(3, 200)]]
    out = streaming.drain(streaming.idle_users(batches_of(spark, tmp_path, batches, "user_id long, ts timestamp")))
    assert sorted((r.user_id, r.last.hour, r.n) for r in out.collect()) == [(1, 0, 1), (2, 17, 3)]


def test_join_strategies(spark):
    left = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(40)], "k long, a long")
    right = spark.createDataFrame([(k if k else None, 10 * k) for k in range(9)], "k long, b long")
    for how in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        want = sorted(map(repr, left.join(right, ["k"], how).collect()))
        for strategy in ("auto", "merge", "shuffle_hash"):
            assert sorted(map(repr, joins.equi_join(left, right, ["k"], how, strategy=strategy).collect())) == want
    plan = lambda **x: joins.equi_join(left, right, ["k"], **x)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan() and "SortMergeJoin" in plan(strategy="merge") and "ShuffledHashJoin" in plan(strategy="shuffle_hash")
    assert joins.fits(right, 9) and not joins.fits(right, 8)
    for bad in ({"strategy": "broadcast", "most": 3}, {"strategy": "broadcast", "how": "full"}, {"strategy": "nested"}):
        with pytest.raises(ValueError):
            joins.equi_join(left, right, ["k"], **bad)


def test_tokens_and_pages(spark):
    texts = ["b a B", "", None, "é É x", "...", "a " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, token_counts(docs).collect())) == [(0, "a", 1), (0, "b", 2), (3, "x", 1), (3, "é", 2), (5, "a", 5000)]
    pages = spark.createDataFrame([("<p>a<b>c</b></p>",), ("<style>\nx</style>t<script a='1'>var t='</p>';\n</script>y",), ("",), (None,), ("a < b",)], "h string")
    assert [r[0] for r in pages.select(html_to_text(F.col("h"))).collect()] == [" a c  ", " t y", "", None, "a < b"]


def test_json_lines_source(spark, tmp_path):
    spark.dataSource.register(jsonl.JsonLinesSource)
    rows = [(k, f'é "{k}"\n' if k % 3 else None, k / 7, [k, None]) for k in range(100)]
    df = spark.createDataFrame(rows, "k long, t string, x double, a array<long>").repartition(3)
    path, read = str(tmp_path / "out"), lambda schema: spark.read.format("lakeloom_jsonl").schema(schema).load(path)
    df.write.format("lakeloom_jsonl").mode("append").save(path)
    assert sorted(map(tuple, read(df.schema).collect())) == rows
    df.where("k < 2").write.format("lakeloom_jsonl").mode("append").save(path)
    assert read("t string, other long").where("other is null").count() == 102
    df.where("k = 5").write.format("lakeloom_jsonl").mode("overwrite").save(path)
    assert [r.k for r in read("k long").collect()] == [5]
    assert not [x for x in os.listdir(path) if x.startswith(".part")]


def test_json_lines_ranges_have_every_line_once(tmp_path, monkeypatch):
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"k": k, "t": "y" * (k % 13)}) + "\n" for k in range(200)))
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(jsonl, "RANGE", size)
        reader = jsonl.JsonLinesSource({"path": str(tmp_path)}).reader(jsonl.StructType().add("k", "long"))
        assert [k for p in reader.partitions() for (k,) in reader.read(p)] == list(range(200))


def test_mmr_matches_a_plain_choice(spark):
    rng = random.Random(11)
    rows = [(q, 10 * q + k, rng.random(), [rng.gauss(0, 1) for _ in range(3)]) for q in range(4) for k in range(rng.randint(1, 9))]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    frame = spark.createDataFrame(rows, "query long, id long, sim double, v array<double>").repartition(3)
    for weight in (0.2, 0.5, 0.9):
        got = {}
        for r in fusion.mmr(frame, 4, weight).orderBy("rank").collect():
            got.setdefault(r["query"], []).append(r["id"])
        for q in range(4):
            left, taken = {i: (s, v) for k, i, s, v in rows if k == q}, []
            vector = {i: v for _, i, _, v in rows}
            while left and len(taken) < 4:
                value = {i: weight * s - (1 - weight) * max((cos(v, vector[t]) for t in taken), default=0) for i, (s, v) in left.items()}
                taken.append(max(sorted(value), key=value.get))
                del left[taken[-1]]
            assert got[q] == taken


def plain_chunks(text, size, separators):
    """Cut after each separator, outermost first, as long as a piece is too long; then fill up greedily."""
    if not text or len(text) <= size:
        return [text] if text else []
    if separators[0] == "":
        pieces = list(text[i : i + size] for i in range(0, len(text), size))
    else:
        pieces, rest = [], text
        while separators[0] in rest:
            cut = rest.index(separators[0]) + len(separators[0])
            pieces.append(rest[:cut])
            rest = rest[cut:]
        pieces.append(rest)
    small = []
    for p in pieces:
        small += [p] if len(p) <= size else plain_chunks(p, size, separators[1:] or [""])
    out = [""]
    for p in small:
        if out[-1] and len(out[-1]) + len(p) > size:
            out.append("")
        out[-1] += p
    return [x for x in out if x]


def test_recursive_chunks_match_a_plain_version(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(["a", "bc", " ", "\n", "\n\n", ". ", "é"]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for size in (1, 7, 30):
        got = {}
        for r in chunking.chunk_recursive(docs, size).orderBy("doc_id", "chunk").collect():
            got.setdefault(r.doc_id, []).append(r.text)
        for k, text in enumerate(texts):
            assert got.get(k, []) == plain_chunks(text, size, chunking.SEPARATORS)

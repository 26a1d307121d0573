import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.operators import stored, vectors
from lakeloom.sources import log
from lakeloom.streaming import queries as streaming


def rows(a, b):
    return [(k, "even" if k % 2 == 0 else "odd" if k % 5 else None, k / 7 if k % 11 else float("nan"), k % 3 == 0) for k in range(a, b)]


def written(path, own, group=10):
    k, s, x, b = zip(*own, strict=True)
    pq.write_table(pa.table({"k": pa.array(k, pa.int64()), "s": pa.array(s, pa.string()), "x": pa.array(x, pa.float64()), "b": pa.array(b)}), path, row_group_size=group)


@pytest.fixture
def source(spark):
    spark.dataSource.register(log.LogSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda path, **more: spark.read.format("lakeloom_log").options(path=str(path), **more).load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


CONDITIONS = ["k < 25", "k >= 95 and s = 'even'", "s is null", "s in ('odd', 'none') and k > 50", "s like 'ev%'", "x > 3", "x <= 3 and x >= 1", "x = double('nan')", "not (s = 'odd')", "k = 7 or k = 8", "b and s <=> null", "s != 'odd' and k between 20 and 40", "x < 2 or s is null", "k in (3, null)"]


def test_filters_give_what_spark_gives(spark, source, tmp_path):
    (tmp_path / "a").mkdir()
    written(tmp_path / "a" / "0.parquet", rows(0, 60))
    written(tmp_path / "a" / "1.parquet", rows(60, 120))
    # Rows in memory: Spark's own reader loses NaN to the statistics of row groups.
    plain = spark.createDataFrame(rows(0, 120), "k long, s string, x double, b boolean")
    for path in (tmp_path / "a", f"file:{tmp_path}/a", f"file://{tmp_path}/a"):
        assert sorted(map(repr, source(path).collect())) == sorted(map(repr, plain.collect()))
    for c in CONDITIONS:
        assert sorted(map(repr, source(tmp_path / "a").where(c).collect())) == sorted(map(repr, plain.where(c).collect())), c
    assert source(tmp_path / "a", columns="s, k").columns == ["s", "k"]
    assert source(tmp_path / "a" / "0.parquet").count() == 60


def test_fewer_rows_are_read_under_a_filter(source, tmp_path):
    written(tmp_path / "0.parquet", rows(0, 1000))
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    def read(*filters):
        reader = log._Reader(StructType.fromDDL("k long, s string, x double, b boolean"), str(tmp_path))
        left = list(reader.pushFilters(list(filters)))
        parts = reader.partitions()
        return len(parts), sum(b.num_rows for p in parts for b in reader.read(p)), left

    assert read() == (100, 1000, [])
    assert read(LessThan(("k",), 15)) == (2, 15, [])
    assert read(EqualTo(("s",), "even"), LessThan(("k",), 15)) == (2, 8, [])
    nan = GreaterThan(("x",), 100.0)
    assert read(nan) == (100, 1000, [nan])


def test_a_stream_goes_on_where_it_stopped(spark, source, tmp_path):
    (tmp_path / "in").mkdir()

    def run():
        own = spark.readStream.format("lakeloom_log").option("path", str(tmp_path / "in")).schema("k long, s string").load()
        q = own.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect())

    written(tmp_path / "in" / "0.parquet", rows(0, 35))
    assert run() == list(range(35))
    assert run() == list(range(35))
    written(tmp_path / "in" / "1.parquet", rows(35, 40))
    written(tmp_path / "in" / "2.parquet", rows(40, 77))
    assert run() == list(range(77))
    reader = log._Stream(StructType.fromDDL("k long"), str(tmp_path / "in"))
    assert reader.latestOffset() == {"rows": 77}
    for _ in range(30):
        a, b = sorted(random.randint(0, 77) for _ in range(2))
        parts = reader.partitions({"rows": a}, {"rows": b})
        assert [k for p in parts for x in reader.read(p) for k in x.column(0).to_pylist()] == list(range(a, b))


def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_an_upsert_rewrites_the_buckets_it_changes_alone(spark, tmp_path):
    base = spark.createDataFrame([(k, f"v{k}") for k in range(200)], "vec_id long, v string")
    kept = stored.create(base, f"file://{tmp_path}/t", buckets=8)
    of = {r.vec_id: r.b for r in base.select("vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(8)).alias("b")).collect()}
    before = files(tmp_path / "t")
    changes = spark.createDataFrame([(3, "new", 1, False), (3, "newer", 2, None), (500, "more", 1, False), (7, None, 1, True)], "vec_id long, v string, version int, deleted boolean")
    want = sorted(map(tuple, vectors.upsert(base, changes).collect()))
    touched = {of[3], of[7], spark.range(500, 501).select(F.pmod(F.xxhash64("id"), F.lit(8))).first()[0]}
    assert kept.upsert(changes) == len(touched)
    assert sorted(map(tuple, kept.rows().collect())) == want
    after = files(tmp_path / "t")
    same = {f for f in before if int(f.split("/")[0][7:]) not in touched}
    assert same and same <= after and not {f for f in before - same} & after
    assert kept.upsert(changes) == 0 and files(tmp_path / "t") == after
    assert kept.upsert(changes.limit(0)) == 0
    rng = random.Random(1)
    now = base
    for version in range(3):
        more = spark.createDataFrame([(rng.randrange(300), f"{version}", version, rng.random() < 0.3) for _ in range(40)], changes.schema).dropDuplicates(["vec_id"]).cache()
        now = vectors.upsert(now, more) if version else vectors.upsert(vectors.upsert(base, changes), more)
        kept.upsert(more)
    assert sorted(map(tuple, kept.rows().collect())) == sorted(map(tuple, now.collect()))
    kept.upsert(kept.rows().select("vec_id", "v", F.lit(9).alias("version"), F.lit(True).alias("deleted")))
    assert kept.rows().count() == 0
    kept.upsert(changes)
    assert sorted(map(tuple, kept.rows().collect())) == [(3, "newer"), (500, "more")]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        stored.create(base, f"file://{tmp_path}/t")


def test_a_table_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, v string")
    kept = stored.create(none, f"file://{tmp_path}/t")
    assert kept.rows().count() == 0
    kept.upsert(spark.createDataFrame([(1, "a", 1, False)], "vec_id long, v string, version int, deleted boolean"))
    assert [tuple(r) for r in kept.rows().collect()] == [(1, "a")]


def test_a_path_is_a_file_or_a_folder(spark, tmp_path):
    written(tmp_path / "events.parquet", rows(0, 5))
    (tmp_path / "d.parquet").mkdir()
    written(tmp_path / "d.parquet" / "part.parquet", rows(0, 6))
    assert streaming.is_file(spark, str(tmp_path / "events.parquet")) and not streaming.is_file(spark, f"file://{tmp_path}/d.parquet")

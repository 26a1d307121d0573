"""Relational queries over the star schema and the events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import tdigest
from lakeloom.operators.joins import equi_join
from lakeloom.operators.timejoins import asof_join, range_join
from lakeloom.plans.query import Query
from lakeloom.sources.tables import table


def _sql(text: str):
    """A query given as SQL over temporary views of the tables it names."""
    names = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if t in text]

    def run(spark, sf_dir):
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in names})

    return run


def _both(text: str, duck: str | None = None) -> Query:
    """One text for both engines, with {table} for each table."""
    names = {t: t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    return Query(_sql(text), duck or text.format(**names))


def filter_project(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    band = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large")
    kept = (F.col("l_shipdate") >= "1995-01-01") & F.col("l_returnflag").isin("A", "R") & F.col("l_discount").between(0.02, 0.06) & F.col("l_tax").isNotNull()
    return li.where(kept).select("l_orderkey", "l_linenumber", band.alias("band"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


def asof(spark, sf_dir):
    """Each purchase with the latest view of the same user at or before it."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("prior"), "user_id", "ts")
    return asof_join(left, right, by="user_id", ts="ts", value="prior", name="prior_id", slot=lambda t: F.date_trunc("day", t)).select("event_id", "prior_id")


def ranges(spark, sf_dir):
    """Parts and the customers whose balance is at most 5 below the part's price, signs aside."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.abs("c_acctbal").alias("lo"), (F.abs("c_acctbal") + 5).alias("hi"))
    return range_join(p, c, at=F.col("p_retailprice"), start=F.col("lo"), end=F.col("hi"), width=5.0).select("p_partkey", "c_custkey")


def approximate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts"),
        F.percentile_approx("l_quantity", 0.5, 10_000).alias("median_quantity"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 14)).alias("hll_parts"),
        F.expr("approx_top_k(l_linenumber, 3)").alias("top"),
    )


def sketches(spark, sf_dir):
    """Distinct parts by quarter-like groups, merged from sketches without going back to the rows."""
    li = table(spark, sf_dir, "lineitem")
    by_line = li.groupBy("l_returnflag", "l_linestatus").agg(F.hll_sketch_agg("l_partkey", 14).alias("s"), F.theta_sketch_agg("l_partkey").alias("t"))
    return by_line.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("hll"), F.theta_sketch_estimate(F.theta_union_agg("t")).alias("theta"))


def kll_quantiles(spark, sf_dir):
    """Quartiles of the price by return flag, from sketches of finer groups that are merged."""
    li = table(spark, sf_dir, "lineitem")
    fine = li.groupBy("l_returnflag", "l_linestatus").agg(F.kll_sketch_agg_double("l_extendedprice", 400).alias("s"))
    merged = fine.groupBy("l_returnflag").agg(F.kll_merge_agg_double("s").alias("s"))
    return merged.select("l_returnflag", *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(name) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])


def sized_join(spark, sf_dir):
    """Orders by market segment: the customers' side is broadcast only if it is found small."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return equi_join(o, c, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def pivoted(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1)))


def unpivoted(spark, sf_dir):
    c = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return c.unpivot(["p_partkey"], ["p_size", "p_retailprice"], "name", "value")


def scalar_udf(spark, sf_dir):
    @F.pandas_udf("double")
    def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.round(F.sum(discounted("l_extendedprice", "l_discount")), 6).alias("net"))


SHARES = [0.01, 0.25, 0.5, 0.75, 0.99]


def tdigest_quantiles(spark, sf_dir):
    """Estimates, so without SQL; tests hold them against exact ranks."""
    digests = tdigest.tdigest(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return tdigest.quantiles_of(digests, SHARES).select("o_orderpriority", "n", "quantiles")


def aggregate_udf(spark, sf_dir):
    """Count and spread from digests of each priority, and whether all quantiles' exact ranks are within a hundredth."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    found = tdigest.quantiles_of(tdigest.tdigest(orders, "o_orderpriority", "o_totalprice"), SHARES)
    ranks = [F.avg((F.col("o_totalprice") <= F.col("quantiles")[k]).cast("double")) - s for k, s in enumerate(SHARES)]
    near = equi_join(orders, found.select("o_orderpriority", "quantiles"), ["o_orderpriority"]).groupBy("o_orderpriority").agg((F.greatest(*[F.abs(r) for r in ranks]) < 0.01).alias("within"))
    return found.join(near, "o_orderpriority").select("o_orderpriority", F.round(F.col("high") - F.col("low"), 6).alias("spread"), "n", "within")


class Words:
    """A table function: the words of a text and their places."""

    def eval(self, text: str):
        for k, w in enumerate((text or "").split()):
            yield w, k


def table_udf(spark, sf_dir):
    words = F.udtf(Words, returnType="part string, at int")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.lateralJoin(words(F.col("p_name").outer())).select("p_partkey", "part", "at")


def session_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def topk_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("rank", rank).where("rank <= 2").select("o_custkey", "o_orderkey", "rank")


def variant_path(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


SESSIONS_SQL = """WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM f)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""

QUERIES = {
    "filter_project": Query(
        filter_project,
        """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS band, l_extendedprice * (1 - l_discount) AS net
        FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_returnflag IN ('A', 'R') AND l_discount BETWEEN 0.02 AND 0.06 AND l_tax IS NOT NULL""",
    ),
    "like_and_nulls": _both("SELECT p_partkey, p_name LIKE '%a%' AS has_a, nullif(p_size, 10) IS NULL AS ten, coalesce(nullif(p_size, 10), -1) AS size FROM {part} WHERE NOT p_brand LIKE '%5'"),
    "join_inner": _both("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name"),
    "join_left": _both("SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN (SELECT * FROM {orders} WHERE o_totalprice > 100000) o ON c_custkey = o_custkey GROUP BY c_custkey"),
    "join_right": _both("SELECT s_suppkey, n_name FROM (SELECT * FROM {nation} WHERE n_regionkey = 1) n RIGHT JOIN {supplier} ON s_nationkey = n_nationkey"),
    "join_full": _both("SELECT c.c_custkey AS customer, s.s_suppkey AS supplier FROM {customer} c FULL JOIN {supplier} s ON c_custkey + 50 = s_suppkey"),
    "join_semi": _both("SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "join_anti": _both("SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 450000)"),
    "join_cross": _both("SELECT r_name, x.n AS n FROM {region} CROSS JOIN (SELECT count(*) AS n FROM {nation}) x"),
    "range_join": Query(ranges, "SELECT p_partkey, c_custkey FROM part JOIN customer ON p_retailprice >= abs(c_acctbal) AND p_retailprice < abs(c_acctbal) + 5"),
    "asof_join": Query(
        asof,
        """SELECT o.event_id, p.event_id AS prior_id FROM (SELECT * FROM events WHERE event_type = 'purchase') o
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON o.user_id = p.user_id AND o.ts >= p.ts""",
    ),
    "group_having": _both("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10".replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10"),
    "distinct": _both("SELECT DISTINCT p_brand, p_type FROM {part}"),
    "count_distinct": _both("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag"),
    "approximate": Query(approximate),
    "sketches": Query(sketches),
    "kll_quantiles": Query(kll_quantiles),
    "sized_join": Query(sized_join, "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "rollup": _both("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "cube": _both("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "grouping_sets": _both("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "ranking_windows": _both(
        """SELECT o_orderkey, cast(row_number() OVER w AS int) AS rn, cast(rank() OVER v AS int) AS rk, cast(dense_rank() OVER v AS int) AS dr, cast(ntile(4) OVER w AS int) AS tile, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd
        FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)"""
    ),
    "analytic_windows": _both(
        """SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after, first_value(o_orderkey) OVER w AS first, nth_value(o_orderkey, 2) OVER w AS second,
        round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three,
        count(*) OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000) RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS near
        FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
    ),
    "topk_per_group": Query(topk_per_group, "SELECT o_custkey, o_orderkey, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2"),
    "sort_limit": _both("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "union_all": _both("SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}"),
    "union_distinct": _both("SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}"),
    "intersect": _both("SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM {part} WHERE p_size < 20"),
    "intersect_all": _both("SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}"),
    "except": _both("SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity > 40"),
    "except_all": _both("SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}"),
    "pivot": Query(pivoted, "SELECT user_id, "+ ", ".join(f"nullif(count(*) FILTER (WHERE event_type = '{k}'), 0) AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id"),
    "unpivot": Query(unpivoted, "SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS name, unnest([p_size::double, p_retailprice]) AS value FROM part"),
    "string_scalars": _both("SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, substring(p_name, 2, 3) AS sub, cast(length(p_name) AS int) AS len, replace(p_name, 'a', 'b') AS rep, lpad(p_brand, 12, '*') AS pad, trim(concat(' ', p_type, ' ')) AS tr, cast(instr(p_name, 'e') AS int) AS pos, concat_ws('-', p_brand, p_type) AS cat FROM {part}"),
    "date_scalars": _both(
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, datediff(DATE '2000-01-01', o_orderdate) AS days, date_format(o_orderdate, 'yyyy-MM-dd') AS f, dayofweek(o_orderdate) AS dow, cast(last_day(o_orderdate) AS string) AS eom FROM {orders}",
        "SELECT o_orderkey, year(o_orderdate)::int AS y, month(o_orderdate)::int AS m, day(o_orderdate)::int AS d, quarter(o_orderdate)::int AS q, date_diff('day', o_orderdate::date, DATE '2000-01-01')::int AS days, strftime(o_orderdate, '%Y-%m-%d') AS f, (dayofweek(o_orderdate) + 1)::int AS dow, last_day(o_orderdate)::varchar AS eom FROM orders",
    ),
    "math_scalars": _both("SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, cast(floor(o_totalprice) AS bigint) AS fl, cast(ceil(o_totalprice) AS bigint) AS ce, round(ln(o_totalprice + 1), 6) AS lg, abs(-o_orderkey) AS ab, round(power(o_orderkey % 7, 3), 6) AS po, cast(sign(o_totalprice - 1e5) AS int) AS si, greatest(o_orderkey, 500) AS gr FROM {orders}"),
    "array_map_scalars": _both(
        "SELECT user_id, array_join(sort_array(collect_set(event_type)), ',') AS kinds, size(collect_set(event_type)) AS n, element_at(map('a', user_id, 'b', user_id * 2), 'b') AS twice, aggregate(sequence(1, 5), 0, (s, x) -> s + x) AS total FROM {events} GROUP BY user_id",
        "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type)::int AS n, user_id * 2 AS twice, 15 AS total FROM events GROUP BY user_id",
    ),
    "json_scalars": _both("SELECT event_id, cast(get_json_object(props, '$.k') AS int) AS k FROM {events}", "SELECT event_id, (props->>'k')::int AS k FROM events"),
    "variant_path": Query(variant_path, "SELECT event_id, (props->>'k')::int AS k FROM events"),
    "tumbling_batch": _both("SELECT cast(date_trunc('day', ts) AS timestamp_ntz) AS start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2", "SELECT date_trunc('day', ts)::timestamp AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "session_batch": Query(
        session_batch,
        SESSIONS_SQL,
    ),
    "scalar_udf": Query(scalar_udf, "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 6) AS net FROM lineitem GROUP BY 1"),
    "aggregate_udf": Query(aggregate_udf, "SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 6) AS spread, count(o_totalprice) AS n, true AS within FROM orders GROUP BY 1"),
    "tdigest_quantiles": Query(tdigest_quantiles),
    "table_udf": Query(table_udf, "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS part, (generate_subscripts(string_split(p_name, ' '), 1) - 1)::int AS at FROM part"),
}

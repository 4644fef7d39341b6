"""Scans, filters, joins, aggregates, windows, sorting and sets: mostly SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import aggregates, relational
from tessera.queries.base import query, same_sql
from tessera.session import load

REVENUE = "round(sum(l_extendedprice * (1 - l_discount)), 2)"

# flagship
same_sql("segment_revenue", f"""
SELECT c_mktsegment, {REVENUE} AS revenue, count(DISTINCT o_orderkey) AS n_orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_quantity > 5 GROUP BY c_mktsegment
""")
same_sql("pricing_summary", f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, {REVENUE} AS sum_disc,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
# scan, projection, filter
same_sql("scan_project", "SELECT o_orderkey, o_custkey AS customer, o_totalprice * 2 AS doubled FROM orders")
same_sql("filter_cmp", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 25 AND l_discount < 0.05 AND l_returnflag <> 'R'")
same_sql("filter_and_or_not", "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 5000) AND NOT c_nationkey = 3")
same_sql("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 900 AND 905")
same_sql("filter_in", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (5, 6)")
same_sql("filter_like", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%00_1%' AND c_mktsegment NOT LIKE 'B%'")
same_sql("filter_ilike", "SELECT event_id FROM events WHERE event_type ILIKE 'CL%'")
same_sql("filter_escape", r"SELECT 'a_b' LIKE 'a\_b' ESCAPE '\' AS hit, 'axb' LIKE 'a\_b' ESCAPE '\' AS miss, count(*) AS n FROM region", r"SELECT 'a_b' LIKE 'a\\_b' AS hit, 'axb' LIKE 'a\\_b' AS miss, count(*) AS n FROM region")
same_sql("filter_is_null", "SELECT count(*) AS n FROM (SELECT nullif(event_type, 'view') AS t FROM events) x WHERE t IS NULL")
same_sql("filter_is_true", "SELECT event_id FROM events WHERE (value > 50) IS TRUE AND (event_type = 'click') IS NOT TRUE")
same_sql("filter_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '[13]$')", "SELECT p_partkey FROM part WHERE p_brand RLIKE '[13]$'")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2).*'")
def filter_similar(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").where(scalar.similar_to(F.col("p_brand"), "Brand#(1|2)%")).select("p_partkey", "p_brand")


same_sql("filter_text_ops", "SELECT doc_id, contains(text, 'idiot') AS c, starts_with(text, 'The') AS s, suffix(text, '.') AS e FROM documents", "SELECT doc_id, contains(text, 'idiot') AS c, startswith(text, 'The') AS s, endswith(text, '.') AS e FROM documents")
same_sql("arith", "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_discount AS s, round(l_quantity * l_extendedprice, 2) AS m, l_extendedprice / l_quantity AS d, l_orderkey % 7 AS r FROM lineitem")


@query("SELECT o_orderkey, o_custkey // 7 AS quotient, (0 - o_custkey) // 1 AS negative, NULL::BIGINT AS by_zero FROM orders")
def int_div(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.select("o_orderkey", scalar.int_div(F.col("o_custkey"), F.lit(7)).alias("quotient"), scalar.int_div(-F.col("o_custkey"), F.lit(1)).alias("negative"), scalar.int_div(F.col("o_custkey"), F.lit(0)).alias("by_zero"))


same_sql("power_concat", "SELECT n_nationkey, pow(n_nationkey, 2) AS p, n_name || '-' || NULLIF(n_regionkey, 2) AS s FROM nation", "SELECT n_nationkey, pow(n_nationkey, 2) AS p, n_name || '-' || cast(NULLIF(n_regionkey, 2) AS string) AS s FROM nation")
same_sql("bitwise", "SELECT n_nationkey, n_nationkey & 5 AS a, n_nationkey | 5 AS o, xor(n_nationkey, 5) AS x, n_nationkey << 2 AS l, n_nationkey >> 1 AS r, ~n_nationkey AS n FROM nation", "SELECT n_nationkey, n_nationkey & 5 AS a, n_nationkey | 5 AS o, n_nationkey ^ 5 AS x, shiftleft(n_nationkey, 2) AS l, shiftright(n_nationkey, 1) AS r, ~n_nationkey AS n FROM nation")
same_sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS status FROM orders")
same_sql("case_searched", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band FROM lineitem")
same_sql("cast_types", "SELECT o_orderkey, CAST(floor(o_totalprice) AS INTEGER) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST('12' AS BIGINT) + o_custkey AS b, TRY_CAST(o_orderpriority AS INTEGER) AS bad FROM orders WHERE o_totalprice = floor(o_totalprice) OR o_custkey >= 0", "SELECT o_orderkey, CAST(floor(o_totalprice) AS INT) AS i, CAST(o_orderkey AS STRING) AS s, CAST('12' AS BIGINT) + o_custkey AS b, TRY_CAST(o_orderpriority AS INT) AS bad FROM orders WHERE o_totalprice = floor(o_totalprice) OR o_custkey >= 0")
same_sql("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 500000) SELECT o_custkey, round(total, 2) AS total FROM top")
same_sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
same_sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
same_sql("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
same_sql("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
same_sql("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
same_sql("values_list", "SELECT id, name FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")
same_sql("dual", "SELECT 1 + 1 AS two, 'x' AS letter")
same_sql("table_function", "SELECT n_nationkey, x AS k FROM nation, unnest(range(n_nationkey % 3)) AS u(x)", "SELECT n_nationkey, k FROM nation LATERAL VIEW explode(filter(sequence(CAST(0 AS BIGINT), CAST(n_nationkey % 3 AS BIGINT)), i -> i < n_nationkey % 3)) AS k")
same_sql("lateral_join", "SELECT r_name, x.c FROM region r, LATERAL (SELECT count(*) AS c FROM nation n WHERE n.n_regionkey = r.r_regionkey) x")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def prepared_parameters(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = :segment", args={"segment": "BUILDING"})


# joins
same_sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
same_sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
same_sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
same_sql("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal < 5000) c ON s_suppkey = c_custkey")
same_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same_sql("join_semi", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey")
same_sql("join_anti", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
same_sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
same_sql("join_using", "SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id)")
same_sql("join_natural", "SELECT n_regionkey, n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r")


@query("""
SELECT a.event_id AS click_id, b.event_id AS buy_id FROM events a JOIN events b
ON a.user_id = b.user_id AND epoch_us(a.ts) // 1000 >= epoch_us(b.ts) // 1000 AND epoch_us(a.ts) // 1000 < epoch_us(b.ts) // 1000 + 3600000
WHERE a.event_type = 'purchase' AND b.event_type = 'click'
""")
def join_interval(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.timeseries import epoch_ms

    e = load(spark, d, "events").select("event_id", "user_id", "event_type", epoch_ms(F.col("ts")).alias("ms"))
    buys = e.where("event_type = 'purchase'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ms").alias("at"))
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("buy_id"), "user_id", F.col("ms").alias("start"))
    return relational.interval_join(buys, clicks, ["user_id"], "at", "start", 3_600_000).select("click_id", "buy_id")


@query("""
SELECT a.event_id, b.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts
""")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    buys, views = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value")
    return relational.asof_join(buys, views, ["user_id"], "ts", "ts", "value").select("event_id", "asof_value")


@query("SELECT c_custkey AS doc_c_custkey, c_name AS doc_c_name, e.event_id AS ts_event_id FROM customer JOIN events e ON c_custkey = e.user_id")
def cross_model_join(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", "c_name")
    e = load(spark, d, "events").select("event_id", "user_id")
    return relational.cross_model_join(c, e, "c_custkey", "user_id", ("doc", "ts")).select("doc_c_custkey", "doc_c_name", "ts_event_id")


# aggregates
same_sql("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_tax), 6) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi FROM lineitem")
same_sql("agg_group", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
same_sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
same_sql("agg_filter", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS spent FROM events GROUP BY user_id")
same_sql("agg_ordered", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
same_sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND avg(o_totalprice) > 100000")
same_sql("agg_stddev_samp", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 4) AS v FROM events GROUP BY event_type")
same_sql("agg_stddev_pop", "SELECT event_type, round(stddev_pop(value), 6) AS sd, round(var_pop(value), 4) AS v FROM events GROUP BY event_type")
same_sql("agg_empty", "SELECT count(*) AS n, sum(value) AS s, avg(value) AS a, coalesce(sum(value), 0.0) AS s0 FROM events WHERE value < -1e9")


@query("SELECT user_id, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id")
def agg_first_last(spark: SparkSession, d: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    return load(spark, d, "events").groupBy("user_id").agg(aggregates.first_by(v, i).alias("first_value"), aggregates.last_by(v, i).alias("last_value"))


same_sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same_sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
same_sql("agg_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(grouping(c_mktsegment) AS INT) AS g FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")


@query("SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_name)) AS VARCHAR) AS names FROM nation GROUP BY n_regionkey")
def json_agg(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").groupBy("n_regionkey").agg(aggregates.json_agg(F.col("n_name")).alias("names"))


@query("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS doc FROM nation GROUP BY n_regionkey")
def json_object_agg(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").groupBy("n_regionkey").agg(aggregates.json_object_agg(F.col("n_name"), F.col("n_nationkey")).alias("doc"))


@query("SELECT event_type, CAST(to_json(list(event_id ORDER BY event_id) FILTER (WHERE value > 90)) AS VARCHAR) AS ids FROM events GROUP BY event_type")
def json_agg_filtered(spark: SparkSession, d: str) -> DataFrame:
    high = F.transform(F.sort_array(F.collect_list(F.when(F.col("value") > 90, F.col("event_id")))), lambda x: x)
    return load(spark, d, "events").groupBy("event_type").agg(F.when(F.size(high) > 0, F.to_json(high)).alias("ids"))


@query("""
SELECT event_type, v AS percentile FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) x
WHERE r = CAST(floor(0.9 * (n - 1) + 0.5) AS BIGINT)
""")
def percentile_nearest(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.percentile_nearest(load(spark, d, "events"), ["event_type"], "value", 90)


@query("""
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 10)) AS BIGINT), 9) AS bucket, lo, hi FROM lineitem, s)
SELECT bucket, round(any_value(lo + (bucket + 1) * ((hi - lo) / 10)), 4) AS upper_bound, count(*) AS n FROM b GROUP BY bucket
""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram(load(spark, d, "lineitem"), "l_extendedprice", 10).withColumn("upper_bound", F.round("upper_bound", 4))


@query()
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("sketched"))


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def distinct_salted(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.skew_safe_count_distinct(load(spark, d, "events"), ["event_type"], "user_id")


# window functions
same_sql("row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
same_sql("rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
same_sql("dense_rank", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
same_sql("percent_rank", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS r FROM part")
same_sql("cume_dist", "SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS r FROM part")
same_sql("ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer")
same_sql("lag", "SELECT event_id, lag(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events")
same_sql("lead", "SELECT event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events")
FULL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
same_sql("first_value", f"SELECT event_id, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id {FULL}) AS v FROM events")
same_sql("last_value", f"SELECT event_id, last_value(value) OVER (PARTITION BY user_id ORDER BY event_id {FULL}) AS v FROM events")
same_sql("nth_value", f"SELECT event_id, nth_value(value, 3) OVER (PARTITION BY user_id ORDER BY event_id {FULL}) AS v FROM events")
same_sql("sum_over_rows", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM orders")
same_sql("avg_over_range", "SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS a FROM part")
same_sql("min_max_over", "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS lo, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS hi FROM events")
# sort, limit, sets
same_sql("sort_nulls", "SELECT event_id, nullif(event_type, 'view') AS t FROM events ORDER BY t DESC NULLS LAST, event_id LIMIT 50")
same_sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
same_sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")


@query("SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) x WHERE r <= 10")
def limit_with_ties(spark: SparkSession, d: str) -> DataFrame:
    return relational.limit_with_ties(load(spark, d, "part"), 10, [("p_size", True)]).select("p_partkey", "p_size")


same_sql("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    by = [relational.order("o_totalprice", descending=True), relational.order("o_orderkey")]
    return relational.distinct_on(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], by)


same_sql("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
same_sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
same_sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
same_sql("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
same_sql("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
same_sql("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")

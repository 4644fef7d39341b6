"""The scalar library: text, numbers, dates, arrays, maps, JSON, keyed stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import json_ops, keyed, scalar
from tessera.queries.base import query, same_sql
from tessera.session import load

same_sql("str_basic", "SELECT p_partkey, length(p_name) AS n, upper(p_name) AS u, lower(p_brand) AS l, trim('  ' || p_name || ' ') AS t, concat(p_brand, '/', p_type) AS c, reverse(p_brand) AS r FROM part")


@query("SELECT p_partkey, substr(p_name, 1, 4) AS a, substr(p_name, 3) AS b, substr(p_name, 1, 2) AS c, '' AS past FROM part")
def str_substring(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_name")
    return load(spark, d, "part").select("p_partkey", scalar.substring(s, 1, 4).alias("a"), scalar.substring(s, 3).alias("b"), scalar.substring(s, -5, 2).alias("c"), scalar.substring(s, 10_000).alias("past"))


same_sql("str_replace", "SELECT p_partkey, replace(p_type, 'E', '*') AS r, replace(p_type, NULLIF(p_brand, 'Brand#1'), '') AS n FROM part")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS d, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 9) AS s FROM nation a, nation b")
def str_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    a, b = n.toDF("a", "x"), n.toDF("b", "y")
    return a.join(F.broadcast(b)).select("a", "b", F.levenshtein("x", "y").alias("d"), F.round(scalar.similarity(F.col("x"), F.col("y")), 9).alias("s"))


same_sql("math_basic", "SELECT s_suppkey, abs(s_acctbal) AS a, round(sqrt(abs(s_acctbal)), 9) AS q, floor(s_acctbal) AS f, ceil(s_acctbal) AS c, s_suppkey % 4 AS m, pow(s_nationkey, 3) AS p, sign(s_acctbal) AS sg FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, round(sqrt(abs(s_acctbal)), 9) AS q, CAST(floor(s_acctbal) AS DOUBLE) AS f, CAST(ceil(s_acctbal) AS DOUBLE) AS c, mod(s_suppkey, 4) AS m, power(s_nationkey, 3) AS p, CAST(sign(s_acctbal) AS INT) AS sg FROM supplier")
same_sql("math_round", "SELECT l_orderkey, l_linenumber, round(l_extendedprice) AS r0, round(l_extendedprice, 1) AS r1, round(-l_quantity - 0.5) AS half FROM lineitem")
same_sql("cond_coalesce_nullif", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS c, nullif(user_id, 3) AS n FROM events")
same_sql("greatest_least", "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax, 0.03) AS l FROM lineitem")
same_sql("date_parts", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, quarter(ts) AS q, weekofyear(ts) AS w, dayofyear(ts) AS doy, hour(ts) AS h, minute(ts) AS mi, CAST(floor(second(ts)) AS INT) AS s FROM events", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, quarter(ts) AS q, weekofyear(ts) AS w, dayofyear(ts) AS doy, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events")


@query("SELECT event_id, dayofweek(ts) AS dow, CAST(floor(extract(epoch FROM ts)) AS BIGINT) AS epoch FROM events")
def date_dow_epoch(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.timeseries import epoch_ms

    return load(spark, d, "events").select("event_id", scalar.day_of_week(F.col("ts")).alias("dow"), F.floor(epoch_ms(F.col("ts")) / 1000).alias("epoch"))


same_sql("date_trunc", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS mo, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h FROM events", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ) AS mo, CAST(date_trunc('week', ts) AS TIMESTAMP_NTZ) AS w, CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS d, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h FROM events")
same_sql("date_add_diff", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS later, o_orderdate + INTERVAL 2 MONTH AS months, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS later, o_orderdate + INTERVAL 2 MONTH AS months, datediff(o_orderdate, DATE '1992-01-01') AS days FROM orders")
same_sql("make_date", "SELECT n_nationkey, make_date(2000 + n_nationkey, n_regionkey + 1, 15) AS d, make_timestamp(2020, 1, 1 + n_regionkey, 3, 4, 5.5) AS t FROM nation", "SELECT n_nationkey, make_date(2000 + n_nationkey, n_regionkey + 1, 15) AS d, make_timestamp_ntz(2020, 1, 1 + n_regionkey, 3, 4, 5.5) AS t FROM nation")
same_sql("to_date_parse", "SELECT n_nationkey, CAST('2024-02-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS DATE) AS d FROM nation WHERE n_nationkey < 28", "SELECT n_nationkey, to_date('2024-02-' || lpad(CAST(n_nationkey + 1 AS STRING), 2, '0')) AS d FROM nation WHERE n_nationkey < 28")


@query("SELECT vec_id, embedding[1] AS first, embedding[100] AS past, array_slice(embedding, 2, 4) AS part, len(embedding) AS n FROM embeddings")
def array_index_slice(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", scalar.element(e, 1).alias("first"), scalar.element(e, 100).alias("past"), scalar.slice_1(e, 2, 4).alias("part"), F.size(e).cast("long").alias("n"))


same_sql("array_build", "SELECT n_nationkey, list_append([n_regionkey, n_nationkey], 7) AS a, list_prepend(0, [n_regionkey]) AS p, list_concat([n_regionkey], [n_nationkey]) AS c FROM nation", "SELECT n_nationkey, array_append(array(n_regionkey, n_nationkey), 7) AS a, array_prepend(array(n_regionkey), 0) AS p, concat(array(n_regionkey), array(n_nationkey)) AS c FROM nation")


@query("""
SELECT n_nationkey, list_has_all([1, 2, 3], [n_regionkey]) AS has, list_has_any([n_regionkey, 9], [1, 4]) AS meets, list_sort(list_distinct([n_regionkey, 1, 1])) AS uniq FROM nation
""")
def array_set_ops(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("n_regionkey")
    return load(spark, d, "nation").select("n_nationkey", scalar.contains_all(F.array(*map(F.lit, (1, 2, 3))), F.array(r)).alias("has"), F.arrays_overlap(F.array(r, F.lit(9)), F.array(F.lit(1), F.lit(4))).alias("meets"), F.sort_array(F.array_distinct(F.array(r, F.lit(1), F.lit(1)))).alias("uniq"))


same_sql("array_higher_order", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)) > 0 AS pos, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings", "SELECT vec_id, aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * 2), 0D, (s, x) -> s + x) > 0 AS pos, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS n FROM embeddings")
same_sql("map_ops", "SELECT n_nationkey, map_extract_value(m, 'a') AS a, map_extract_value(m, 'zz') AS missing, CAST(cardinality(m) AS BIGINT) AS n, list_sort(map_keys(m)) AS keys FROM (SELECT n_nationkey, MAP {'a': n_regionkey, 'b': n_nationkey} AS m FROM nation) x", "SELECT n_nationkey, m['a'] AS a, try_element_at(m, 'zz') AS missing, CAST(size(m) AS BIGINT) AS n, sort_array(map_keys(m)) AS keys FROM (SELECT n_nationkey, map('a', n_regionkey, 'b', n_nationkey) AS m FROM nation) x")
same_sql("struct_ops", "SELECT n_nationkey, s.a AS a, s.b AS b FROM (SELECT n_nationkey, {'a': n_name, 'b': n_regionkey} AS s FROM nation) x", "SELECT n_nationkey, s.a AS a, s.b AS b FROM (SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey) AS s FROM nation) x")


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' AS missing FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return load(spark, d, "events").select("event_id", json_ops.path(p, "k").cast("long").alias("k"), json_ops.path(p, "missing").alias("missing"))


@query("SELECT conv_id, turn, to_json({'a': {'b': [turn, 7]}})->>'$.a.b[1]' AS v FROM conversations")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    doc = F.to_json(F.struct(F.struct(F.array(F.col("turn"), F.lit(7).cast("long")).alias("b")).alias("a")))
    return load(spark, d, "conversations").select("conv_id", "turn", json_ops.path(doc, "a.b[1]").alias("v"))


@query("SELECT event_id, json_keys(props) AS keys, list_contains(json_keys(props), 'k') AS has, list_has_any(json_keys(props), ['x', 'k']) AS any_of, list_has_all(json_keys(props), ['x', 'k']) AS all_of FROM events")
def json_keys(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return load(spark, d, "events").select("event_id", F.json_object_keys(p).alias("keys"), json_ops.has_key(p, "k").alias("has"), json_ops.has_any_key(p, ["x", "k"]).alias("any_of"), json_ops.has_all_keys(p, ["x", "k"]).alias("all_of"))


@query("SELECT event_id, '{\"k\":\"' || (props->>'$.k') || '\",\"t\":\"' || event_type || '\"}' AS merged, '{}' AS deleted FROM events")
def json_merge_delete(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return load(spark, d, "events").select("event_id", json_ops.merge(p, F.to_json(F.struct(F.col("event_type").alias("t")))).alias("merged"), json_ops.delete_key(p, "k").alias("deleted"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) = 5 AS has, true AS empty_part FROM events")
def json_contains(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return load(spark, d, "events").select("event_id", json_ops.contains(p, '{"k": 5}').alias("has"), json_ops.contains(p, "{}").alias("empty_part"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) BETWEEN 10 AND 60 AS ok, 'object' AS kind, 'number' AS k_kind FROM events")
def json_validate(spark: SparkSession, d: str) -> DataFrame:
    schema = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 60}}}
    p = F.col("props")
    return load(spark, d, "events").select("event_id", json_ops.valid(p, schema).alias("ok"), json_ops.kind(p).alias("kind"), json_ops.kind(p, "k").alias("k_kind"))


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    return keyed.current_values(load(spark, d, "events"), "user_id", "value", "event_id")


@query("SELECT user_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id")
def kv_setnx(spark: SparkSession, d: str) -> DataFrame:
    return keyed.set_if_absent(load(spark, d, "events"), "user_id", "value", "event_id")


@query("SELECT user_id, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS delta FROM events GROUP BY user_id")
def kv_incr(spark: SparkSession, d: str) -> DataFrame:
    return keyed.counters(load(spark, d, "events").select("user_id", json_ops.path(F.col("props"), "k").cast("long").alias("delta")), "user_id", "delta")


@query("SELECT user_id, list(event_id ORDER BY event_id)[1:3] AS head, list(event_id ORDER BY event_id)[-2:] AS tail, list(event_id ORDER BY event_id)[2] AS second, count(*) AS n FROM events GROUP BY user_id")
def kv_lists(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("at"))
    items = F.col("items")
    return keyed.lists(e, "user_id", "event_id", "at").select("user_id", keyed.lrange(items, 0, 2).alias("head"), keyed.lrange(items, -2, -1).alias("tail"), keyed.lindex(items, 1).alias("second"), F.size(items).cast("long").alias("n"))


@query("SELECT user_id, count(*) AS fields, max(v) FILTER (WHERE event_type = 'click') AS click FROM (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY user_id, event_type) x GROUP BY user_id")
def kv_hashes(spark: SparkSession, d: str) -> DataFrame:
    h = keyed.hashes(load(spark, d, "events"), "user_id", "event_type", "value", "event_id")
    return h.select("user_id", F.size("fields").cast("long").alias("fields"), F.try_element_at("fields", F.lit("click")).alias("click"))


@query("SELECT event_type, user_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score, user_id) - 1 AS rank FROM (SELECT event_type, user_id, sum(value) AS score FROM events GROUP BY event_type, user_id) s) x WHERE rank BETWEEN 1 AND 4")
def kv_zrange(spark: SparkSession, d: str) -> DataFrame:
    z = keyed.zset(load(spark, d, "events").select("event_type", "user_id", F.col("value").alias("score")), "event_type", "user_id", "score")
    return keyed.zrange(z, "event_type", "user_id", "score", 1, 4).withColumn("score", F.round("score", 4)).select("event_type", "user_id", "score", "rank")


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def kv_sinter(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return keyed.set_intersection(e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT event_id FROM events WHERE value IS NULL OR value > 50")
def kv_ttl(spark: SparkSession, d: str) -> DataFrame:
    return keyed.alive(load(spark, d, "events"), "value", 50).select("event_id")


@query("SELECT n_nationkey, [CAST(n_regionkey AS VARCHAR), '7'] AS wild, ['7'] AS part, ['7'] AS deep FROM nation")
def json_path_query(spark: SparkSession, d: str) -> DataFrame:
    doc = F.to_json(F.struct(F.array(F.struct(F.col("n_regionkey").alias("v")), F.struct(F.lit(7).alias("v"))).alias("a"), F.struct(F.lit(7).alias("z")).alias("o")))
    return load(spark, d, "nation").select("n_nationkey", json_ops.path_query(doc, "$.a[*].v").alias("wild"), json_ops.path_query(doc, "$.a[1:2].v").alias("part"), json_ops.path_query(doc, "$..z").alias("deep"))


@query("SELECT n_nationkey, '{\"a\":[' || n_regionkey || ',2]}' AS left_over, 2 AS size FROM nation")
def json_delete_path(spark: SparkSession, d: str) -> DataFrame:
    doc = F.to_json(F.struct(F.array(F.col("n_regionkey"), F.lit(1), F.lit(2)).alias("a")))
    less = json_ops.delete_path(doc, "a[1]")
    return load(spark, d, "nation").select("n_nationkey", less.alias("left_over"), json_ops.size(json_ops.path(less, "a")).alias("size"))


@query("SELECT n_nationkey, [2, n_regionkey] AS popped, [1, 2] AS cut, [1, 9, 2, n_regionkey] AS put FROM nation")
def kv_list_edit(spark: SparkSession, d: str) -> DataFrame:
    items = F.array(F.lit(1), F.lit(2), F.col("n_regionkey"))
    return load(spark, d, "nation").select("n_nationkey", keyed.lpop(items).alias("popped"), keyed.rpop(items).alias("cut"), keyed.linsert(items, F.lit(2), F.lit(9)).alias("put"))


@query("SELECT n_nationkey, n_regionkey + 5 AS a, 1 AS c, 2 AS n FROM nation")
def kv_hash_edit(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("a"), F.col("n_regionkey"), F.lit("b"), F.lit(3))
    m = keyed.hincrby(keyed.hdel(keyed.hincrby(m, "a", 5), "b"), "c", 1)
    return load(spark, d, "nation").select("n_nationkey", m["a"].alias("a"), m["c"].alias("c"), F.size(m).alias("n"))

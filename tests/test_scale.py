"""Plans made for many rows give what the plain ones give."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import aggregates, graph
from tessera.operators import timeseries as ts
from tessera.sources.versions import VersionedTable


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(1)
    data = [(k, rng.choice(["a", "b", None]), t, None if rng.random() < 0.1 else rng.uniform(-5, 5)) for k, t in enumerate(rng.sample(range(-500, 5000), 400))]
    return spark.createDataFrame(data, "event_id long, series string, t long, v double").repartition(5).cache()


@pytest.mark.parametrize("chunk", [7, 300, 10**9])
def test_chunked_series(series, chunk):
    w = Window.partitionBy("series").orderBy("t")
    near = lambda a, b: [(x[0], None if x[1] is None else round(x[1], 9)) for x in rows(a)] == [(x[0], None if x[1] is None else round(x[1], 9)) for x in rows(b)]
    assert near(ts.moving_average(series, ["series"], "t", "v", 250, chunk).select("event_id", "moving_avg"), series.select("event_id", F.avg("v").over(w.rangeBetween(-250, 0))))
    assert near(ts.delta(series, ["series"], "t", "v", chunk).select("event_id", "delta"), series.select("event_id", F.col("v") - F.lag("v").over(w)))
    assert near(ts.rate(series, ["series"], "t", "v", chunk).select("event_id", "rate"), series.select("event_id", (F.col("v") - F.lag("v").over(w)) / ((F.col("t") - F.lag("t").over(w)) / 1000)))
    assert near(ts.cumulative_sum(series, ["series"], "t", "v", chunk).select("event_id", "cumulative_sum"), series.select("event_id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    full = series.where("v is not null")
    last, want = {}, {}
    for r in sorted(full.collect(), key=lambda r: r["t"]):
        last[r["series"]] = 0.3 * r["v"] + 0.7 * last[r["series"]] if r["series"] in last else r["v"]
        want[r["event_id"]] = round(last[r["series"]], 9)
    assert {r["event_id"]: round(r["ema"], 9) for r in ts.exponential_average(series, ["series"], "t", "v", 0.3, chunk).collect()} == want
    spans = series.select("series", "v", F.coalesce(F.lead("t").over(w) - F.col("t"), F.lit(0)).alias("s")).groupBy("series").agg(F.sum(F.col("v") * F.col("s")) / F.sum("s"))
    assert near(ts.time_weighted_average(series, ["series"], "t", "v", chunk), spans)


def test_tied_times_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1), ("a", 1, 3.0, 2), ("a", 2, 5.0, 3)], "series string, t long, v double, n int")
    assert rows(ts.exponential_average(df, ["series"], "t", "v", 0.5).select("n", "ema")) == [(1, 1.0), (2, 2.0), (3, 3.5)]


@pytest.mark.parametrize("p", [0, 13, 50, 99.5, 100])
def test_percentiles(spark, p):
    rng = random.Random(2)
    data = [(k % 3 if k % 7 else None, None if k % 11 == 0 else float(rng.choice([1, 2, rng.uniform(0, 9)]))) for k in range(3000)]
    df = spark.createDataFrame(data, "k int, v double").repartition(4)
    want = {}
    for k in {k for k, _ in data}:
        v = sorted(x for kk, x in data if kk == k and x is not None)
        want[k] = v[int(p / 100 * (len(v) - 1) + 0.5)]
    assert {r["k"]: r["percentile"] for r in aggregates.percentile_nearest(df, ["k"], "v", p).collect()} == want
    every = sorted(x for _, x in data if x is not None)
    assert aggregates.percentile_nearest(df, [], "v", p).first()[0] == every[int(p / 100 * (len(every) - 1) + 0.5)]


def test_centralities_by_rounds(spark, monkeypatch):
    rng = random.Random(3)
    n = 14
    nodes = spark.createDataFrame([(i,) for i in range(n + 1)], "id long")
    edges = spark.createDataFrame([(rng.randrange(n), rng.randrange(n)) for _ in range(22)], "src long, dst long")
    monkeypatch.setattr(graph, "SOURCES_AT_ONCE", 8)
    near = lambda df: [(a, round(b, 9)) for a, b in rows(df)]
    assert near(graph.closeness(nodes, edges, 0)) == near(graph.closeness(nodes, edges))
    assert near(graph.betweenness(nodes, edges, 0)) == near(graph.betweenness(nodes, edges))


def test_walks_and_embeddings(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)], "src long, dst long")
    walks = graph.random_walks(nodes, edges, 6, 3).collect()
    near = {frozenset(e) for e in [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]}
    assert len(walks) == 21 and all(frozenset(s) in near for w in walks for s in zip(w["path"], w["path"][1:])) and {len(w["path"]) for w in walks} == {1, 7}
    found = {r["id"]: r["embedding"] for r in graph.node_embeddings(nodes, edges, 4).collect()}
    assert sorted(found) == list(range(7)) and all(len(v) == 4 for v in found.values())
    means = {r["id"]: r["features"] for r in graph.neighbourhood_means(nodes.withColumn("features", F.array(F.col("id").cast("double"))), edges, rounds_=1).collect()}
    assert means[0] == [0.75] and means[6] == [6.0] and means[2] == [(2 + 4 / 3) / 2]


def test_appends_write_only_their_rows(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    first = t.write(spark.range(5))
    second = t.append(spark.range(5, 8))
    t.branch("dev", first)
    third = t.append(spark.range(100, 101), "dev")
    assert [t.read(snapshot=k).count() for k in (first, second, third)] == [5, 8, 6] and t.read(branch="dev").count() == 6
    assert spark.read.parquet(f"{t.root}/data/{second}").count() == 3
    assert t.history("dev") == [third, first] and len({t._claim(), t._claim()}) == 2
    assert t.read(snapshot=t.compact()).count() == 8 and len(t._folders(t.current())) == 1


def test_rounds_are_deleted(spark, tmp_path):
    import os
    from types import SimpleNamespace

    from tessera.sources import rounds

    with rounds.rounds() as made:
        a, b = (rounds.keep_round(spark.range(n), "x") for n in (2, 3))
        c = rounds.keep_round(a, "x")
        rounds.drop_round(a)
    rounds.release(made, c)
    assert c.count() == 2 and [os.path.exists(x._round_path) for x in (a, b, c)] == [False, False, True]
    rounds.drop_round(c)
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="z"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        rounds.shared_folder(unset)
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    folder = rounds.shared_folder(spark)
    before = set(os.listdir(folder))
    assert graph.bfs(spark.createDataFrame([(0,)], "id long"), edges).count() == 10
    assert len(set(os.listdir(folder)) - before) == 1

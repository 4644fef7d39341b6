"""Change streams, event stores and live queries: folds over ordered changes, in batch or by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append"):
    """A streaming query that gives each micro-batch to `sink`. every: an interval as trigger, `once` to take what is there in one batch, or None for all that is there in batches."""
    trigger = {"availableNow": True} if every is None else {"once": True} if every == "once" else {"processingTime": every}
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def filter_changes(df: DataFrame, tables: Sequence[str] = (), operations: Sequence[str] = (), transactions: Sequence[int] = ()) -> DataFrame:
    """Changes that meet every list that isn't empty."""
    for column, wanted in (("table", tables), ("op", operations), ("tx", transactions)):
        if wanted:
            df = df.where(F.col(column).isin(list(wanted)))
    return df


def latest_state(changes: DataFrame, keys: Sequence[str], order: str, op: str, value: Sequence[str], deleted: str = "delete") -> DataFrame:
    """The table after all changes: each key's last row, unless that deletes it. Partial maxima before the shuffle."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(op, *value), order).alias("_last"))
    return last.where(F.col(f"_last.{op}") != deleted).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in value])


def replay(changes: DataFrame, order: str, start: int, end: int | None = None) -> DataFrame:
    """Changes with start <= order (<= end)."""
    rows = changes.where(F.col(order) >= start)
    return rows if end is None else rows.where(F.col(order) <= end)


def fold_events(events: DataFrame, keys: Sequence[str], order: str, kind: str, amount: str, effect: dict[str, int]) -> DataFrame:
    """rebuild_state: (keys, version, balance): each event adds effect[kind] * amount; kinds without effect count as a version only."""
    sign = F.lit(0)
    for k, v in effect.items():
        sign = F.when(F.col(kind) == k, F.lit(v)).otherwise(sign)
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("version"), F.sum(sign * F.col(amount)).alias("balance"))


def fold_from_snapshot(snapshot: DataFrame, later: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State of a snapshot and of the events after it, as fold_events gives them, added up."""
    return snapshot.unionByName(later).groupBy(*keys).agg(F.sum("version").alias("version"), F.sum("balance").alias("balance"))


def live_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a live query reports: rows with change = added or removed (as multisets)."""
    added = after.exceptAll(before).withColumn("change", F.lit("added"))
    return added.unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))


def on_batch(stream: DataFrame, when: Callable[[DataFrame], DataFrame], action: Callable[[DataFrame, int], None], checkpoint: str):
    """A trigger: `action` on what `when` keeps of every micro-batch, once a batch (the id tells repeats)."""
    return stream.writeStream.foreachBatch(lambda df, n: action(when(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partition_key(table: Column, key: Column) -> Column:
    """The key under which changes go to a topic: table:key."""
    return F.concat_ws(":", table, key.cast("string"))


def to_topic(changes: DataFrame, table: str, key: str) -> DataFrame:
    """(key, value) as a message sink wants them: value is the row as JSON."""
    return changes.select(partition_key(F.lit(table), F.col(key)).alias("key"), F.to_json(F.struct(*changes.columns)).alias("value"))


def write_topic(stream: DataFrame, servers: str, topic: str, checkpoint: str):
    """A Kafka sink for to_topic's rows; needs Spark's Kafka connector on the class path."""
    return stream.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def post_rows(rows: DataFrame, url: str, batch: int = 500, timeout: float = 10.0) -> None:
    """A webhook sink: the rows of to_topic as JSON arrays of at most `batch`, posted by each task; a refused post fails the task, which is tried again (at least once)."""

    def send(part) -> None:
        import json
        from itertools import islice
        from urllib.request import Request, urlopen

        part = iter(part)
        while chunk := [{"key": r["key"], "value": json.loads(r["value"])} for r in islice(part, batch)]:
            urlopen(Request(url, json.dumps(chunk).encode(), {"Content-Type": "application/json"}), timeout=timeout).close()

    rows.select("key", "value").foreachPartition(send)


def write_webhook(stream: DataFrame, url: str, checkpoint: str):
    """The webhook sink on a stream of to_topic's rows."""
    return stream.writeStream.foreachBatch(lambda df, _: post_rows(df, url)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def geofence(df: DataFrame, entity: str, order: str, inside: Column) -> DataFrame:
    """df rows where an entity enters or leaves, with `event`; its first position counts as enter if inside."""
    from pyspark.sql import Window

    w = Window.partitionBy(entity).orderBy(order)
    rows = df.withColumn("_in", inside).withColumn("_was", F.coalesce(F.lag("_in").over(w), F.lit(False)))
    return rows.where("_in <> _was").withColumn("event", F.when(F.col("_in"), "enter").otherwise("exit")).drop("_in", "_was")


def geofence_stream(df: DataFrame, entity: str, inside: Column):
    """(entity, event) as entities enter or leave on a stream, by one boolean of state each; rows are taken in the order they come."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (was,) = state.get if state.exists else (False,)
        out = []
        for part in parts:
            for now in part["_in"]:
                if bool(now) != was:
                    was = bool(now)
                    out.append((key[0], "enter" if was else "exit"))
        state.update((was,))
        yield pd.DataFrame(out, columns=[entity, "event"])

    kind = df.schema[entity].dataType.simpleString()
    return df.select(entity, inside.alias("_in")).groupBy(entity).applyInPandasWithState(run, f"`{entity}` {kind}, event string", "was boolean", "append", GroupStateTimeout.NoTimeout)


def movement_alerts(df: DataFrame, entity: str, at: str, x: str, y: str, max_speed: float = 100.0, max_move: float = 1000.0) -> DataFrame:
    """Rows whose move since the entity's last row is longer than max_move, or faster than max_speed a second, with move, speed, alert."""
    from pyspark.sql import Window

    w = Window.partitionBy(entity).orderBy(at)
    move = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), F.lit(2.0)) + F.pow(F.col(y) - F.lag(y).over(w), F.lit(2.0)))
    rows = df.withColumn("move", move).withColumn("speed", F.try_divide(F.col("move"), (F.col(at) - F.lag(at).over(w)) / 1000.0))
    alert = F.when(F.col("move") > max_move, "move").when(F.col("speed") > max_speed, "speed")
    return rows.withColumn("alert", alert).where("alert is not null")


def append_events(store: DataFrame, events: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """An event store with new events, numbered on from each aggregate's last version."""
    from pyspark.sql import Window

    last = store.groupBy(*keys).agg(F.max(version).alias("_last"))
    w = Window.partitionBy(*keys).orderBy(version)
    numbered = events.withColumn("_n", F.row_number().over(w)).join(last, list(keys), "left").withColumn(version, (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast(store.schema[version].dataType))
    return store.unionByName(numbered.select(*store.columns))


def rows_in_batches(df: DataFrame, size: int = 1000):
    """Lists of at most `size` rows, fetched partition by partition: the driver holds one partition."""
    batch = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch

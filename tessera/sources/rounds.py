"""Tables written between jobs, or the rounds of an iterative operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: ContextVar[list[DataFrame] | None] = ContextVar("rounds", default=None)
_gone: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where it is unset and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tessera-"))


def keep_round(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read again; the plan so far is cut off, lost executors cost a new read.

    Files stay until `drop_round` or `release`.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._round_path = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def drop_round(*frames: DataFrame) -> None:
    """Delete the files of rounds that no later plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._round_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        if _made.get() is not None:
            _gone.add(df._round_path)


@contextmanager
def rounds() -> Iterator[list[DataFrame]]:
    """The rounds that are kept inside the block, by this thread, for `release`."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def release(made: list[DataFrame], *kept: DataFrame) -> None:
    """Delete the rounds in `made` that are still there, but for those kept."""
    stay = {df._round_path for df in kept}
    drop_round(*(df for df in made if df._round_path not in stay | _gone))
    _gone.difference_update(df._round_path for df in made)

"""Time travel on plain Parquet: every write is a snapshot in a folder of its own, listed in a small log.

Layout: <root>/data/<snapshot id>/, <root>/ids/<snapshot id> (a marker that claims the id) and
<root>/log/ (one row a snapshot, tag or branch move). A snapshot is a list of data folders: a write
has one of its own, an append that of its rows and its parent's; nothing is rewritten but by `compact`.
Ids are claimed by creating the marker, which fails if it is there, so two writers never share one.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "snapshot long, at timestamp, kind string, name string, parent long, folders array<long>"
MAIN = "main"


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def log(self) -> DataFrame:
        """All entries: kind is snapshot, tag or branch."""
        if not self._exists(f"{self.root}/log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.root}/log")

    def _note(self, snapshot: int, kind: str, name: str, parent: int | None, folders: list[int] | None = None) -> None:
        row = [(snapshot, datetime.now(timezone.utc), kind, name, parent, folders)]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def _claim(self) -> int:
        """The next id that no writer has."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        last = self.log().where("kind = 'snapshot'").agg(F.max("snapshot")).first()[0]
        new = (last or 0) + 1
        while not fs.createNewFile(path(f"{self.root}/ids/{new}")):
            new += 1
        return new

    def _folders(self, snapshot: int) -> list[int]:
        row = self.log().where((F.col("kind") == "snapshot") & (F.col("snapshot") == snapshot)).first()
        if row is None:
            raise ValueError("no such snapshot")
        return row["folders"] or [snapshot]

    def write(self, df: DataFrame, branch: str = MAIN) -> int:
        """A new snapshot at the branch's head, of df alone; returns its id."""
        new = self._claim()
        df.write.parquet(f"{self.root}/data/{new}")
        self._note(new, "snapshot", branch, self.current(branch), [new])
        return new

    def append(self, df: DataFrame, branch: str = MAIN) -> int:
        """A new snapshot of the branch's head and df's rows; only df is written."""
        head = self.current(branch)
        if head is None:
            return self.write(df, branch)
        new = self._claim()
        df.select(*self.read(snapshot=head).columns).write.parquet(f"{self.root}/data/{new}")
        self._note(new, "snapshot", branch, head, [*self._folders(head), new])
        return new

    def compact(self, branch: str = MAIN) -> int:
        """A new snapshot of the branch's head in one folder."""
        return self.write(self.read(branch=branch), branch)

    def snapshots(self) -> DataFrame:
        return self.log().where("kind = 'snapshot'").select("snapshot", "at", F.col("name").alias("branch"), "parent")

    def current(self, branch: str = MAIN) -> int | None:
        """The branch's latest snapshot, or the one it was made or moved to."""
        row = self.log().where((F.col("kind").isin("snapshot", "branch")) & (F.col("name") == branch)).orderBy(F.desc("at"), F.desc("snapshot")).first()
        return row["snapshot"] if row else None

    def tag(self, name: str, snapshot: int) -> None:
        self._note(snapshot, "tag", name, None)

    def branch(self, name: str, snapshot: int) -> None:
        """Make a branch at a snapshot, or move it there (rollback)."""
        self._note(snapshot, "branch", name, None)

    def resolve(self, snapshot: int | None = None, as_of: datetime | None = None, tag: str | None = None, branch: str = MAIN) -> int:
        if snapshot is not None:
            return snapshot
        if tag is not None:
            row = self.log().where((F.col("kind") == "tag") & (F.col("name") == tag)).orderBy(F.desc("at")).first()
        elif as_of is not None:
            row = self.log().where((F.col("kind").isin("snapshot", "branch")) & (F.col("name") == branch) & (F.col("at") <= F.lit(as_of))).orderBy(F.desc("at"), F.desc("snapshot")).first()
        else:
            row = {"snapshot": self.current(branch)}
        if row is None or row["snapshot"] is None:
            raise ValueError("no such snapshot")
        return row["snapshot"]

    def read(self, **which) -> DataFrame:
        """read(), read(snapshot=3), read(as_of=datetime), read(tag="v1"), read(branch="dev")."""
        return self.spark.read.parquet(*[f"{self.root}/data/{k}" for k in self._folders(self.resolve(**which))])

    def history(self, branch: str = MAIN) -> list[int]:
        """Snapshot ids from the branch's head back to its first."""
        parent = {r["snapshot"]: r["parent"] for r in self.snapshots().collect()}
        out, at = [], self.current(branch)
        while at is not None:
            out.append(at)
            at = parent.get(at)
        return out

"""An append-only status log: the state of a table as the latest row of each key.

Every commit is one folder of parquet files, written by one Spark job; it counts once Spark's own ``_SUCCESS`` marker
lies in it, so a job that stopped half-way is invisible and its number is written anew by the next commit.  Nothing is
updated in place: a status change appends the changed rows, and the current state is ``max_by`` over the versions of a
key.  The log is at the same time the table's change history.

``compact`` folds the log into a snapshot of two folders, the rows still open and the settled ones, so that looking
for open work reads the open rows and the commits since, whatever the size of the table.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "_v"


class StatusLog:
    def __init__(self, spark: SparkSession, base: str, key: list[str], schema: T.StructType,
                 open_rows: str = "false", compact_every: int = 20):
        """``open_rows``: SQL condition of the rows that are still work; ``compact_every``: commits after which a
        snapshot is written (0: never)."""
        self.spark, self.base, self.key, self.schema = spark, base.rstrip("/"), list(key), schema
        self.open_rows, self.compact_every = open_rows, compact_every
        self._stored = T.StructType(schema.fields + [T.StructField(VERSION, T.LongType())])

    # -- commits
    def _done(self, kind: str, marker: str = "_SUCCESS") -> list[int]:
        """The committed versions under ``log`` or ``snapshot``: one name per commit."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{kind}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(top))
        return sorted(int(n) for n in names if n.isdigit()
                      and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.base}/{kind}/{n}/{marker}")))

    def _parts(self) -> tuple[int, list[int]]:
        """The newest snapshot (0: none) and the commits after it."""
        snapshots = self._done("snapshot", "open/_SUCCESS")
        last = snapshots[-1] if snapshots else 0
        return last, [v for v in self._done("log") if v > last]

    def next_version(self) -> int:
        snapshot, tail = self._parts()
        return max([snapshot, *tail]) + 1

    def append(self, rows: DataFrame, version: int | None = None) -> int:
        """Commit ``rows`` as one version.  Writing a given version again replaces it (a replayed micro-batch)."""
        version = version or self.next_version()
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows.select(*cols, F.lit(version).cast("long").alias(VERSION)).write.mode("overwrite").parquet(f"{self.base}/log/{version:012d}")
        if self.compact_every and len(self._parts()[1]) >= self.compact_every:
            self.compact()
        return version

    # -- reading
    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*paths)

    def rows(self, only_open: bool = False) -> DataFrame:
        """Rows of the snapshot and the commits since, several of a key where it changed."""
        snapshot, tail = self._parts()
        kinds = ["open"] if only_open else ["open", "settled"]
        paths = [f"{self.base}/snapshot/{snapshot:012d}/{k}" for k in kinds] if snapshot else []
        return self._read(paths + [f"{self.base}/log/{v:012d}" for v in tail])

    def _latest(self, rows: DataFrame) -> DataFrame:
        cols = [f.name for f in self._stored.fields]
        if self.key:
            best = F.max_by(F.struct(*cols), F.col(VERSION)).alias("r")
            return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)]).agg(best).select("r.*")
        return rows

    def versioned(self) -> DataFrame:
        """The current rows with the version that wrote them."""
        return self._latest(self.rows())

    def read(self) -> DataFrame:
        """The current rows."""
        return self.versioned().select(*self.schema.fieldNames())

    def open(self) -> DataFrame:
        """The current rows that are still work, with their version; settled rows of the snapshot are not read."""
        return self._latest(self.rows(only_open=True)).filter(self.open_rows)

    def compact(self) -> None:
        """Write the current state as a snapshot.  The open rows come last: their marker makes it count."""
        snapshot, tail = self._parts()
        if not tail:
            return
        now, target = self.versioned(), f"{self.base}/snapshot/{tail[-1]:012d}"
        is_open = F.coalesce(F.expr(self.open_rows), F.lit(False))
        now.filter(~is_open).write.mode("overwrite").parquet(f"{target}/settled")
        now.filter(is_open).write.mode("overwrite").parquet(f"{target}/open")

    def changes(self) -> DataFrame:
        """The change history: ``insert`` for a key's first row, ``update_preimage`` and ``update_postimage`` for each
        later one, with the version that made it."""
        logs = self._read([f"{self.base}/log/{v:012d}" for v in self._done("log")])
        cols = self.schema.fieldNames()
        w = Window.partitionBy(*self.key).orderBy(VERSION)
        both = logs.select(F.struct(*cols).alias("now"), F.col(VERSION).alias("_commit_version"),
                           F.lag(F.struct(*cols)).over(w).alias("was"))
        row = lambda kind, c: F.struct(F.lit(kind).alias("t"), F.col(c).alias("r"))
        made = F.when(F.col("was").isNull(), F.array(row("insert", "now"))).otherwise(
            F.array(row("update_preimage", "was"), row("update_postimage", "now")))
        return both.select("_commit_version", F.explode(made).alias("c")).select(
            "c.r.*", F.col("c.t").alias("_change_type"), "_commit_version")

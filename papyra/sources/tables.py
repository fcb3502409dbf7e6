"""Table sources and sinks (A3 literal rows, A5 scan, A6 append, A7 ensure table, A8 view, A9 names).

Row-level updates are appends to a status log (``papyra.sources.status_log``).  ``SnapshotTable`` replaces small
control tables (the list of extractions to retry) as new immutable versions.  The path being read is never overwritten
by the job reading it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$")


def literal_rows(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    """A3: typed DataFrame from rows with an explicit schema (tests and tiny control tables only)."""
    return spark.createDataFrame(list(rows), schema)


def table_scan(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A5: a catalog table by name, or a parquet path."""
    if "/" in name_or_path or name_or_path.endswith(".parquet"):
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def append_sink(df: DataFrame, target: str, schema: T.StructType | None = None) -> None:
    """Append by column name (not by position), optionally conformed to a declared schema."""
    if schema is not None:
        df = df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    if "/" in target:
        df.write.mode("append").parquet(target)
    elif df.sparkSession.catalog.tableExists(target):
        cols = df.sparkSession.table(target).columns
        df.select(*cols).write.insertInto(target)  # columns reordered by name first
    else:
        df.write.mode("append").saveAsTable(target)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, location: str | None = None,
                 properties: dict[str, str] | None = None) -> None:
    """Create-if-absent with a fixed schema, stored as parquet; table properties are recorded."""
    if not _IDENT.match(name):
        raise ValueError(f"bad table name {name!r}")
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=location, source="parquet", schema=schema)
    for k, v in (properties or {}).items():
        if not _IDENT.match(k):
            raise ValueError(f"bad property name {k!r}")
        text = v.replace("\\", "\\\\").replace("'", "\\'")       # a property value has to be a literal
        spark.sql(f"ALTER TABLE IDENTIFIER(:t) SET TBLPROPERTIES ('{k}' = '{text}')", args={"t": name})


def temp_view(df: DataFrame, name: str) -> DataFrame:
    """Name a DataFrame for SQL."""
    df.createOrReplaceTempView(name)
    return df


def sql_with_names(spark: SparkSession, query: str, **args) -> DataFrame:
    """Parameterised SQL; table names go through ``IDENTIFIER(:name)``, values through markers,
    never string interpolation."""
    return spark.sql(query, args=args)


class SnapshotTable:
    """A directory of immutable snapshots ``v000001, v000002, ...``; the newest one with ``_SUCCESS`` is
    current.  ``write`` never touches the snapshot being read."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.base)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        out = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("v") and name[1:].isdigit():
                done = self.spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")
                if fs.exists(done):
                    out.append(int(name[1:]))
        return sorted(out)

    def current_path(self) -> str | None:
        v = self.versions()
        return f"{self.base}/v{v[-1]:06d}" if v else None

    def read(self, schema: T.StructType | str | None = None) -> DataFrame:
        p = self.current_path()
        if p is None:
            if schema is None:
                raise FileNotFoundError(self.base)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(p)

    def write(self, df: DataFrame) -> str:
        v = self.versions()
        nxt = f"{self.base}/v{(v[-1] + 1 if v else 1):06d}"
        df.write.mode("overwrite").parquet(nxt)
        return nxt


"""File scans (A1 inventory, A2 content hash, A4 binary scan, A10 content fetch, one-pass opening of new files).

Names and contents are separate steps.  ``list_files`` is a Python data source that lists a folder inside a task and
never opens a file; what is already known is removed from that listing by joins; ``open_files`` then reads each
remaining file once and hashes its bytes in the same pass, spread over tasks by the files' sizes.  Spark's own binary
source keeps every file of a folder in the driver, so ``binary_scan`` leaves large folders to these steps too.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from papyra.functions.columns import base_name, file_extension

Opener = Callable[[str], bytes]

LISTING = "path string, modificationTime timestamp, length long"
OPENED = LISTING + ", content binary, file_hash string"
BATCH_BYTES = 32 << 20          # contents handed on at a time
TASK_BYTES = 128 << 20          # contents that a task opens, about
DRIVER_FILES = 50_000           # files that Spark's binary source may hold in the driver (1 to 2 KB each)


def content_hash(content: str | Column = "content") -> Column:
    """A2: MD5 hex digest of the file bytes (chunked reading in the application is not observable)."""
    return F.md5(F.col(content) if isinstance(content, str) else content)


def _spark_files(spark: SparkSession, path: str, path_glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Spark's binary source: prunes ``content``, reads any store, lists all files into the driver."""
    reader = spark.read.format("binaryFile")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def binary_scan(spark: SparkSession, path: str, max_bytes: int | None = None,
                path_glob: str | None = None, recursive: bool = False, report_skipped: bool = False) -> DataFrame:
    """A4: files as rows ``(path, modificationTime, length, content)``.

    Unselected ``content`` is never read (column pruning on the binary source), and a ``max_bytes`` cap is a
    pushed-down ``length`` filter, so oversized files are skipped at the scan.  With ``report_skipped`` they stay as
    rows with NULL content and ``scan_status = 'too_large'`` (their bytes are not read either).

    A folder of more than ``DRIVER_FILES`` files is listed and opened by tasks, and the driver holds no file of it.
    There ``content`` is read whether selected or not (``list_files`` gives names alone), and files in ``key=value``
    subfolders have no column for the key.
    """
    if arrow_reads(path) and _is_folder(spark, path):
        names = visible_files(spark, path, path_glob, recursive)
        if names.limit(DRIVER_FILES + 1).count() > DRIVER_FILES:
            return _scan_in_tasks(names, max_bytes, report_skipped)
    df = _spark_files(spark, path, path_glob, recursive)
    if max_bytes is None:
        return df.withColumn("scan_status", F.lit("ok")) if report_skipped else df
    kept = df.filter(F.col("length") <= F.lit(max_bytes))
    if not report_skipped:
        return kept
    skipped = df.filter(F.col("length") > F.lit(max_bytes)).withColumn("content", F.lit(None).cast("binary"))
    return kept.withColumn("scan_status", F.lit("ok")).unionByName(skipped.withColumn("scan_status", F.lit("too_large")))


def _scan_in_tasks(names: DataFrame, max_bytes: int | None, report_skipped: bool) -> DataFrame:
    if max_bytes is not None and not report_skipped:
        names = names.filter(F.col("length") <= F.lit(max_bytes))
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = names.repartition(tasks, "path").mapInArrow(_read_all(max_bytes), LISTING + ", content binary")
    if not report_skipped:
        return df
    large = F.lit(False) if max_bytes is None else F.col("length") > F.lit(max_bytes)
    return df.withColumn("scan_status", F.when(large, F.lit("too_large")).otherwise(F.lit("ok")))


def _read_all(max_bytes: int | None):
    """``content`` of each file up to ``max_bytes``, handed on by size; larger ones keep their row without it."""
    def run(batches):
        for b in batches:
            data, held, at = [], 0, 0
            for i, (path, size) in enumerate(zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True)):
                data.append(read_bytes(path) if max_bytes is None or size <= max_bytes else None)
                held += len(data[-1] or b"")
                if held >= BATCH_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(at, len(data)).columns, pa.array(data, pa.binary())],
                                                     names=[*b.schema.names, "content"])
                    data, held, at = [], 0, i + 1
    return run


# ----------------------------------------------------------------------------------------------- locations

def qualified(spark: SparkSession, path: str) -> str:
    """The path as the cluster's file systems name it: absolute, with scheme, ``.`` and ``..`` resolved."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?")
# Schemes of the application's paths and of Hadoop that stand for one pyarrow file system each.
_ARROW = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def _scheme(path: str) -> str:
    m = _SCHEME.match(path)
    return m.group(1).lower() if m else ""


def arrow_reads(path: str) -> bool:
    """Whether tasks can open this location themselves; other stores are read through Spark's binary source."""
    return _scheme(path) in _ARROW


def _file_system(path: str):
    """The pyarrow file system of a path, and the path within it (names are taken as they are, not as URI text)."""
    import pyarrow.fs as pafs

    m = _SCHEME.match(path)
    scheme, rest = _ARROW[_scheme(path)], path[m.end():] if m else path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    fs, top = pafs.FileSystem.from_uri(f"{scheme}:{m.group(2) or '//'}/")      # a bucket is part of the path, a host is not
    return fs, top.rstrip("/") + "/" + rest.lstrip("/")


def read_bytes(path: str) -> bytes:
    """The default opener: one file's bytes, inside a task."""
    fs, p = _file_system(path)
    with fs.open_input_stream(p) as f:
        return f.read()


# ----------------------------------------------------------------------------------------------- listing

class _Folder(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _hidden(name: str) -> bool:
    """Whether Spark's file sources leave this name out."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _walk(path: str, enter: Callable[[str], bool]) -> Iterator[tuple[str, int, int]]:
    """(path below ``path``, modification time in microseconds, size) of the files in a folder and in the subfolders that
    ``enter`` accepts.  A local folder is read entry by entry, so its size does not matter; other stores list one at once."""
    import pyarrow.fs as pafs

    fs, root = _file_system(path)
    todo = [""]
    while todo:
        at = todo.pop()
        if isinstance(fs, pafs.LocalFileSystem):
            with os.scandir(root.rstrip("/") + at + "/") as found:
                for e in found:
                    if e.is_dir():
                        if enter(e.name):
                            todo.append(f"{at}/{e.name}")
                    elif e.is_file():
                        try:
                            st = e.stat()
                        except FileNotFoundError:       # removed meanwhile
                            continue
                        yield f"{at}/{e.name}", st.st_mtime_ns // 1000, st.st_size
        else:
            for f in fs.get_file_info(pafs.FileSelector(root.rstrip("/") + at)):
                if f.type == pafs.FileType.Directory and enter(f.base_name):
                    todo.append(f"{at}/{f.base_name}")
                elif f.type == pafs.FileType.File:
                    yield f"{at}/{f.base_name}", (f.mtime_ns or 0) // 1000, f.size


class _ListingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.recursive = options["path"], options.get("recursive", "false") == "true"
        self.visible = options.get("visible", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Folder(self.path)]

    def _enter(self, name: str) -> bool:
        if self.visible:
            return not _hidden(name) and (self.recursive or "=" in name)
        return self.recursive

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        prefix = partition.path.rstrip("/")
        hidden = _hidden if self.visible else lambda name: name.startswith(".")
        rows = ((prefix + p, t, n) for p, t, n in _walk(partition.path, self._enter) if not hidden(p.rsplit("/", 1)[-1]))
        schema = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
        while part := list(itertools.islice(rows, 10_000)):
            columns = zip(zip(*part), schema.types, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=schema)


class ListingSource(DataSource):
    """``spark.read.format("papyra_listing").option("path", folder)``: names, times and sizes, no content."""

    @classmethod
    def name(cls) -> str:
        return "papyra_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(dict(self.options))


def list_files(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """``(path, modificationTime, length)`` of the files in a folder (not of its subfolders unless ``recursive``), also
    those whose names begin with ``_`` (names with a leading ``.`` are hidden files); no file is opened.  Stores that
    only Spark reads are listed by its binary source, whose listing leaves names with a leading ``_`` out."""
    folder = qualified(spark, directory)
    if arrow_reads(folder):
        spark.dataSource.register(ListingSource)
        return (spark.read.format("papyra_listing").option("path", folder)
                .option("recursive", str(recursive).lower()).load())
    raw = _spark_files(spark, folder, recursive=True).select("path", "modificationTime", "length")
    return raw if recursive else raw.filter(F.regexp_replace("path", "/[^/]*$", "") == F.lit(folder.rstrip("/")))


def visible_files(spark: SparkSession, path: str, path_glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``(path, modificationTime, length)`` of the files that Spark's binary source shows for ``path``: none that are empty
    or begin with ``_``, those in ``key=value`` subfolders too, times in milliseconds.  A folder is listed by a task; patterns, single
    files and stores that only Spark reads are listed by that source."""
    if not (arrow_reads(path) and _is_folder(spark, path)):
        return _spark_files(spark, path, path_glob, recursive).select("path", "modificationTime", "length")
    spark.dataSource.register(ListingSource)
    df = (spark.read.format("papyra_listing").option("path", qualified(spark, path))
          .option("recursive", str(recursive).lower()).option("visible", "true").load())
    if path_glob:
        pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(path_glob).compiled().pattern()
        df = df.filter(F.regexp_replace("path", "(?s)^.*/", "").rlike(f"(?s)^(?:{pattern})$"))
    return df.filter("length > 0").withColumn("modificationTime", F.date_trunc("millisecond", "modificationTime"))


# ----------------------------------------------------------------------------------------------- opening

def _open_all(opener: Opener):
    def run(batches):
        for b in batches:
            rows, held = [], 0
            for i in range(b.num_rows):
                try:
                    data = opener(b.column("path")[i].as_py())
                except FileNotFoundError:       # removed since the listing: it is not there to be ingested
                    continue
                rows.append((i, data, hashlib.md5(data).hexdigest()))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield _opened(b, rows)
                    rows, held = [], 0
            if rows:
                yield _opened(b, rows)
    return run


def _opened(b: pa.RecordBatch, rows: list) -> pa.RecordBatch:
    at, data, digest = zip(*rows)
    own = b.take(pa.array(at))
    return pa.RecordBatch.from_arrays([*own.columns, pa.array(data, pa.binary()), pa.array(digest, pa.string())],
                                      names=[*b.schema.names, "content", "file_hash"])


def open_files(listing: DataFrame, opener: Opener | None = None, tasks: int | None = None) -> DataFrame:
    """``listing`` (path, modificationTime, length) with ``content`` and ``file_hash``: every file is opened once, read
    and hashed in the same pass.  ``tasks``: over how many the files are spread (default: by their sizes)."""
    spark = listing.sparkSession
    src = listing.select("path", "modificationTime", "length")
    if tasks is None:
        size = src.agg(F.sum("length").alias("n")).first()["n"] or 0
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    return src.repartition(tasks, "path").mapInArrow(_open_all(opener or read_bytes), OPENED)


# ----------------------------------------------------------------------------------------------- inventory

def inventory_columns(stamp: Column) -> list[Column]:
    name = base_name(F.col("path"))
    return [name.alias("file_name"), file_extension(name).alias("type"), F.col("length").cast("long").alias("size"),
            F.col("path").alias("file_path"), stamp.cast("timestamp").alias("upload_time"),
            F.lit(None).cast("timestamp").alias("processed_time"), F.col("file_hash")]


def file_inventory(spark: SparkSession, directory: str, upload_time: str = "now",
                   recursive: bool = False) -> DataFrame:
    """A1: one row per file directly inside ``directory`` (non-recursive, like a directory listing), with its MD5.

    ``upload_time='now'`` stamps the listing time as the application does; ``'modified'`` uses the file's
    modification time instead.
    """
    listing = list_files(spark, directory, recursive)
    if arrow_reads(qualified(spark, directory)):
        raw = open_files(listing, tasks=int(spark.conf.get("spark.sql.shuffle.partitions")))
    else:
        raw = (_spark_files(spark, qualified(spark, directory), recursive=True).join(listing.select("path"), "path", "left_semi")
               .withColumn("file_hash", content_hash("content")))
    stamp = F.current_timestamp() if upload_time == "now" else F.col("modificationTime")
    return raw.select(*inventory_columns(stamp))


def inside(path: str, root: str) -> bool:
    """Whether ``path`` lies in the folder ``root``: scheme and ``..`` resolved, compared segment by segment."""
    def norm(p: str) -> str:
        return os.path.normpath("/" + _SCHEME.sub("", p).lstrip("/"))
    p, r = norm(path), norm(root)
    return p == r or p.startswith(r.rstrip("/") + "/")


def fetch_content(spark: SparkSession, contracts: DataFrame, lookup: str, files_root: str | None = None
                  ) -> DataFrame:
    """A10: resolve a lookup text to the first matching stored path and return that file's bytes.

    The path is chosen on the path column alone (a distributed top-1); that single path (one row, a
    bounded lookup) then drives a binary read of exactly one file, so no other file's bytes are read.
    ``files_root``, when given, must contain the path (guards against reading outside the volume).
    """
    from papyra.operators.serving import path_contains

    top = path_contains(contracts.select("path"), lookup).orderBy("path").limit(1).collect()
    empty = spark.createDataFrame([], "path string, content binary")
    if not top:
        return empty
    path = top[0]["path"]
    if files_root is not None and not inside(path, files_root):
        return empty
    return binary_scan(spark, path).select("path", "content")

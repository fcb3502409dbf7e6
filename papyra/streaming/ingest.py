"""Incremental ingestion as Structured Streaming.

A stream over the names that arrive in the landing directory drives the same set-based steps as the batch ingestion run in
``foreachBatch``.  The stream carries names, times and sizes only: contents are not read by it, the ingestion run opens
the files that are new, each once.  ``availableNow`` drains what has arrived and stops (the file-arrival trigger);
``max_files_per_trigger`` throttles micro-batch size.  ``foreachBatch`` is at-least-once: a replayed micro-batch finds its
files already registered and their outcomes stored (anti joins), so it adds nothing.

Spark's own file stream keeps every file it lists, has seen or looks up for a micro-batch in the driver.  Here a task lists
the directory, a join leaves out what arrived before, and the new names are written to ``arrivals`` in the checkpoint
folder: the stream reads those few files, oldest names first, so the driver holds none of the landed ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.plans.ingestion import IngestRun, _exists
from papyra.sources.files import LISTING, inventory_columns, open_files, visible_files


def _arrive(spark: SparkSession, landing: str, checkpoint: str, max_files: int | None, glob: str | None) -> str:
    """Write the names that have not arrived before; with ``max_files``, that many a file (a micro-batch), oldest first."""
    arrivals = f"{checkpoint}/arrivals"
    listing = visible_files(spark, landing, glob)
    if _exists(spark, arrivals):
        known = spark.read.schema(LISTING).parquet(arrivals).select("path")
        listing = listing.join(known, "path", "left_anti")
    listing.select("path", "modificationTime", "length").write.mode("overwrite").parquet(f"{checkpoint}/listing")
    new = spark.read.schema(LISTING).parquet(f"{checkpoint}/listing")
    if not _exists(spark, arrivals) or not new.isEmpty():
        if max_files:
            new = new.coalesce(1).sortWithinPartitions("modificationTime", "path")
        new.write.mode("append").option("maxRecordsPerFile", max_files or 0).parquet(arrivals)
    return arrivals


def _stream(spark: SparkSession, landing: str, checkpoint: str, max_files: int | None, glob: str | None) -> DataFrame:
    """Names, times and sizes of the files that arrive."""
    r = spark.readStream.schema(LISTING)
    if max_files:
        r = r.option("maxFilesPerTrigger", 1)
    return r.parquet(_arrive(spark, landing, checkpoint, max_files, glob))


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _drain(stream: DataFrame, step: Callable[[DataFrame], None], checkpoint: str) -> None:
    """A micro-batch looks up the files it reads in a job of up to 10,000 tasks, one a file, each with a result of its own
    for the driver; a few tasks a slot do the same.  The source reads the session's setting at each micro-batch."""
    spark = stream.sparkSession
    before = spark.conf.get(_LISTING, None)
    tasks = min(int(before or 10_000), max(16, 2 * spark.sparkContext.defaultParallelism))
    spark.conf.set(_LISTING, str(tasks))

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():          # the first file of an empty directory holds no names
            step(batch)
    try:
        q = (stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/query")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(_LISTING) if before is None else spark.conf.set(_LISTING, before)


def stream_register(spark: SparkSession, run: IngestRun, landing: str, checkpoint: str,
                    max_files_per_trigger: int | None = None, glob: str | None = None) -> None:
    """Register newly landed files (B1 per micro-batch) until the directory is drained.  A file whose name is
    known is not opened; a new one is opened once, for its hash."""
    def step(batch: DataFrame) -> None:
        opened = open_files(run.unseen(batch), run.cfg.opener, run.cfg.partitions)
        run.register(opened.select(*inventory_columns(F.current_timestamp())))

    _drain(_stream(spark, landing, checkpoint, max_files_per_trigger, glob), step, checkpoint)


def stream_extract(spark: SparkSession, run: IngestRun, landing: str, checkpoint: str,
                   max_files_per_trigger: int | None = None, glob: str | None = None) -> None:
    """Register, parse, summarise, extract and mark each micro-batch's files."""
    _drain(_stream(spark, landing, checkpoint, max_files_per_trigger, glob), run.ingest, checkpoint)

"""Change capture (Z3) and last-write-wins state as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.sources.status_log import StatusLog


def change_feed(before: DataFrame, after: DataFrame, key: str | list[str], cols: list[str] | None = None
                ) -> DataFrame:
    """Z3: row changes between two snapshots: ``insert``, ``delete``, ``update_preimage`` and
    ``update_postimage`` (the usual change-feed vocabulary).  A full outer join on the key, a null-safe
    comparison of the other columns, one pass."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = cols or [c for c in before.columns if c not in keys]
    b = before.select(*keys, F.struct(*cols).alias("_b"))
    a = after.select(*keys, F.struct(*cols).alias("_a"))
    j = b.join(a, keys, "full_outer")
    row = lambda kind, side: F.struct(F.lit(kind).alias("change_type"), F.col(side).alias("r"))
    changes = (F.when(F.col("_b").isNull(), F.array(row("insert", "_a")))
               .when(F.col("_a").isNull(), F.array(row("delete", "_b")))
               .when(~F.col("_b").eqNullSafe(F.col("_a")),
                     F.array(row("update_preimage", "_b"), row("update_postimage", "_a")))
               .otherwise(F.array().cast(T.ArrayType(T.StructType([
                   T.StructField("change_type", T.StringType()),
                   T.StructField("r", b.schema["_b"].dataType)])))))
    return (j.select(*keys, F.explode(changes).alias("_c"))
            .select(*keys, "_c.change_type", "_c.r.*"))


def stream_latest_kv(spark: SparkSession, source_dir: str, schema: T.StructType, keys: list[str], value: str,
                     order: list[str], out_base: str, checkpoint: str, file_glob: str | None = None,
                     max_files_per_trigger: int | None = None, deleted: str | None = None,
                     compact_every: int = 20) -> DataFrame:
    """Z4 (H3 and H4 as a stream): the last write per key over a file stream, in any order of arrival.

    The aggregation keeps each key's latest write as stream state and, in update mode, hands on only the keys that a
    micro-batch touched; those rows are committed to an append-only log under the batch's number.  No other key is read
    or written, and a replayed micro-batch writes its own folder again.  ``deleted`` names a boolean column: a delete is
    a write like any other, so an update that is older but arrives later does not bring the key back.

    Runs until the source is drained (``availableNow``) and returns the current table (keys, value).
    """
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    last = F.max_by(F.struct(F.col(value).alias("value"), gone.alias("gone")), F.struct(*order))
    agg = src.groupBy(*keys).agg(last.alias("r")).select(*keys, F.col("r.value").alias(value), F.col("r.gone").alias("_gone"))
    log = StatusLog(spark, f"{out_base}/state", keys, T.StructType(
        [schema[k] for k in keys] + [T.StructField(value, schema[value].dataType), T.StructField("_gone", T.BooleanType())]),
        compact_every=compact_every)

    def commit(batch: DataFrame, batch_id: int) -> None:
        log.append(batch, version=batch_id + 1)

    q = (agg.writeStream.outputMode("update").foreachBatch(commit)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return log.read().filter(~F.col("_gone")).drop("_gone")

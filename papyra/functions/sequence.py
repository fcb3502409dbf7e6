"""Ordered-sequence primitives that stay balanced when one key holds a large share of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` puts every row of a key into one task.  Here each key's sequence is
cut into buckets: the per-row window runs inside ``(key, bucket)`` groups, and only one summary row per bucket crosses
bucket borders (a window over bucket summaries, of which there are few).  The results equal the plain window's exactly.

Buckets are ranges of the row rank by default (``width=None``): Spark deals the rows to ranges of (key, order) with
equal numbers of rows, whatever the times in them, and the ranges are written once to the shared folder, so that the
rows and their bucket summaries see the same borders.  A session with all its rows in one second is split like any
other.  Where the order value is a dense counter (turns, chunk numbers), ``width`` cuts it arithmetically instead:
those buckets are balanced without a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.session import scratch_path

BUCKET = "_b"


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def bucketed(df: DataFrame, keys: list[str], order_cols: list[str], order_value: Column | None = None,
             width: int | None = None, buckets: int | None = None) -> DataFrame:
    """``df`` with a bucket number ``_b`` that increases along ``order_cols`` within a key."""
    if width is not None:
        return df.withColumn(BUCKET, F.floor(order_value / F.lit(width)).cast("long"))
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order_cols).withColumn(BUCKET, F.spark_partition_id().cast("long"))
    path = scratch_path(spark, "ranges")
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def with_summary(rows: DataFrame, summary: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Every row with the summary columns of its bucket; a NULL key is a key like any other."""
    own = [*keys, BUCKET]
    right = summary.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(own)], *cols)
    cond = F.lit(True)
    for i, k in enumerate(own):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    return rows.join(right, cond).drop(*[f"_s{i}" for i in range(len(own))])


def neighbour(df: DataFrame, key: str | list[str], order_value: Column, order_cols: list[str],
              cols: list[str], direction: str = "next", width: int | None = 1 << 20, prefix: str | None = None
              ) -> DataFrame:
    """``lead`` (``direction='next'``) or ``lag`` (``'prev'``) of ``cols`` along ``order_cols`` within ``key``.

    ``order_value`` is a numeric column that increases with ``order_cols`` (used only to cut buckets by ``width``).
    Adds ``{prefix}{c}`` columns (default prefix ``next_`` / ``prev_``).
    """
    keys = _keys(key)
    prefix = prefix or ("next_" if direction == "next" else "prev_")
    b = bucketed(df, keys, order_cols, order_value, width)
    order = [F.col(c) for c in order_cols]
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    fn = F.lead if direction == "next" else F.lag
    inner = b.select("*", *[fn(F.col(c)).over(w).alias(f"_in_{c}") for c in cols],
                     fn(F.lit(1)).over(w).alias("_has"))
    # One summary row per bucket: its first (for 'next') or last (for 'prev') row.
    pick = F.min_by if direction == "next" else F.max_by
    edge = (b.groupBy(*keys, "_b")
            .agg(pick(F.struct(*[F.col(c) for c in cols]), F.struct(*order)).alias("_edge")))
    wb = Window.partitionBy(*keys).orderBy("_b")
    across = edge.select(*keys, "_b", fn(F.col("_edge")).over(wb).alias("_x"))
    j = with_summary(inner, across, keys, ["_x"])
    out = j.select(*[F.col(c) for c in df.columns],
                   *[F.when(F.col("_has").isNotNull(), F.col(f"_in_{c}")).otherwise(F.col(f"_x.{c}"))
                     .alias(f"{prefix}{c}") for c in cols])
    return out


def running_sum(df: DataFrame, key: str | list[str], order_value: Column, order_cols: list[str],
                value: str, out: str = "running_sum", width: int | None = 1 << 20,
                buckets: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order_cols`` within ``key`` (bucketed, exact)."""
    keys = _keys(key)
    b = bucketed(df, keys, order_cols, order_value, width, buckets)
    w = (Window.partitionBy(*keys, "_b").orderBy(*[F.col(c) for c in order_cols])
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = b.withColumn("_local", F.sum(F.col(value)).over(w))
    totals = b.groupBy(*keys, "_b").agg(F.sum(F.col(value)).alias("_t"))
    wb = (Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(wb), F.lit(0)).alias("_before"))
    j = with_summary(inner, before, keys, ["_before"])
    return j.select(*[F.col(c) for c in df.columns], (F.col("_local") + F.col("_before")).alias(out))

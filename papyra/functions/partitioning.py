"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal rows to the session's number of shuffle partitions by ``cols``, before CPU-heavy per-row work (regex, JSON,
    rendering): a scan of few row groups would run it in few tasks, whatever the cluster."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)

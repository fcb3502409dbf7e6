"""File registry: incremental tracking and row-level updates.

The registry is a table of files with a status flag.  Admission, listing and status updates are joins;
nothing is collected to the driver and no per-file loop exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.schemas import CONTRACT_TRACK, PENDING, PROCESSED

_TRACK_COLS = [f.name for f in CONTRACT_TRACK.fields]


def register_new_files(inventory: DataFrame, registry: DataFrame, within_batch: str = "all",
                       match: str = "name_or_hash") -> DataFrame:
    """B1: inventory rows whose name **and** hash are both unseen in the registry, as pending rows.

    ``NOT EXISTS (name = name OR hash = hash)`` is rewritten as equi joins instead of a nested loop.  The
    registry is probed with the listing as the build side: a semi join keeps the registry names (and,
    separately, hashes) that occur in the listing, and the listing is then anti-joined with those few
    hits.  Each run therefore scans the registry's two key columns but never shuffles the registry when the
    listing is small (AQE broadcasts it); NULL keys never match, exactly as in the OR form.

    ``within_batch='first'`` additionally keeps one row per hash inside the batch (the earliest name);
    the default keeps them all, like the application.  ``match='hash'`` admits a known name whose content
    changed (a re-upload); the default rejects any known name or known content, like the application.
    """
    if match not in ("name_or_hash", "hash"):
        raise ValueError("match must be 'name_or_hash' or 'hash'")
    # One row a key on both sides: many listed or registered copies can share a name or a hash (partial aggregates).
    inv_names = inventory.select(F.col("file_name").alias("_n")).filter(F.col("_n").isNotNull()).distinct()
    inv_hashes = inventory.select(F.col("file_hash").alias("_h")).filter(F.col("_h").isNotNull()).distinct()
    seen_names = registry.select(F.col("file_name").alias("_n")).join(inv_names, "_n", "left_semi").distinct()
    seen_hashes = (registry.select(F.col("file_hash").alias("_h"))
                   .join(inv_hashes, "_h", "left_semi").distinct())
    new = inventory
    if match == "name_or_hash":
        new = new.join(seen_names, inventory.file_name == seen_names._n, "left_anti")
    new = new.join(seen_hashes, F.col("file_hash") == seen_hashes._h, "left_anti")
    if within_batch == "first":
        # Deterministic winner per hash: the smallest file name (a partial aggregate, skew safe).
        first = (new.filter(F.col("file_hash").isNotNull()).groupBy("file_hash")
                 .agg(F.min("file_name").alias("_keep")))
        new = new.join(first, "file_hash", "left").filter(
            F.col("_keep").isNull() | (F.col("file_name") == F.col("_keep"))).drop("_keep")
    return new.select(
        "file_name", "type", "size", F.lit(PENDING).alias("processed"), "file_path",
        "upload_time", "processed_time", "file_hash",
    )


def apply_registration(inventory: DataFrame, registry: DataFrame, within_batch: str = "all") -> DataFrame:
    """Registry after B1: the old rows plus the admitted ones (what the append produces)."""
    return registry.select(_TRACK_COLS).unionByName(register_new_files(inventory, registry, within_batch))


def pending_files(registry: DataFrame) -> DataFrame:
    """B2: rows not yet processed."""
    return registry.filter(F.col("processed") == F.lit(PENDING))


def pending_count(registry: DataFrame) -> DataFrame:
    """Number of pending rows (one-row aggregate; computed by partial counts per task)."""
    return pending_files(registry).agg(F.count(F.lit(1)).alias("pending"))


def mark_processed(registry: DataFrame, finished: DataFrame, now: Column | None = None,
                   path_col: str = "path") -> DataFrame:
    """Set ``processed='S'`` and ``processed_time=now`` for rows whose path finished.

    An ``UPDATE`` becomes a left join with the finished paths and a ``when``; the caller stores the changed
    rows (the ingestion run appends them to its status log).  Paths compare by equality (not ``LIKE``), so ``_``/``%`` in names and
    suffix matches cannot mark the wrong file.
    """
    now = F.current_timestamp() if now is None else now
    done = finished.select(F.col(path_col).alias("_done")).distinct()
    j = registry.join(done, registry.file_path == done._done, "left")
    hit = F.col("_done").isNotNull()
    out = []
    for c in _TRACK_COLS:
        if c == "processed":
            out.append(F.when(hit, F.lit(PROCESSED)).otherwise(F.col(c)).alias(c))
        elif c == "processed_time":
            out.append(F.when(hit, now.cast("timestamp")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(out)


def arrival_semi(scan: DataFrame, registry: DataFrame, path_col: str = "path") -> DataFrame:
    """The scanned files that are pending, in one job (instead of a per-file loop)."""
    pend = pending_files(registry).select(F.col("file_path").alias("_p"))
    return scan.join(pend, scan[path_col] == pend._p, "left_semi")


def latest_upload(inventory: DataFrame, time_col: str = "upload_time") -> DataFrame:
    """An upload under an existing name replaces its bytes; keep the latest row per file name.

    ``max_by`` over a struct is a partial aggregate, so even one very hot name is combined map-side.
    """
    cols = [c for c in inventory.columns if c != "file_name"]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(time_col), F.col("file_path")))
    return inventory.groupBy("file_name").agg(best.alias("_r")).select("file_name", "_r.*")

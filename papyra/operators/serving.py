"""Serving queries over the registry and the extract table.

Each function returns a lazy DataFrame; column pruning keeps file bytes and unused columns out of the
scan, and every filter is a column expression (no SQL text is assembled from user input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.columns import base_name, day_label, display_default, kb_label, strip_scheme
from papyra.schemas import CONTRACT_FIELDS, PROCESSED

# Fixed values shown by the application.
DONE_MARK, PENDING_MARK = "✅", "❌"
DONE_LABEL, PENDING_LABEL = "Processado", "Pendente"
PAGE_SIZES = (8, 10, 25)
LISTING_COLUMNS = ["file_name", "type", "size", "processed", "file_path", "upload_time", "processed_time"]
DETAIL_COLUMNS = CONTRACT_FIELDS + ["summarize"]
DISPLAY_COLUMNS = ["tipo_contrato", "nome_contrato", "contratante", "contratado", "valor_total", "moeda",
                   "data_assinatura", "data_inicio_vigencia", "data_fim_vigencia", "prazo_vigencia",
                   "forma_pagamento", "multa_rescisao", "foro"]


def files_listing(registry: DataFrame) -> DataFrame:
    """Registry listing with KB size, status mark and ``dd/MM/yyyy`` dates (``-`` when missing).

    Ordered newest first on the raw timestamps (the application ordered by the formatted text)."""
    return (registry
            .orderBy(F.col("upload_time").desc_nulls_last(), F.col("processed_time").desc_nulls_last())
            .select(
                "file_name", "file_path", "type",
                kb_label("size").alias("size"),
                F.when(F.col("processed") == F.lit(PROCESSED), F.lit(DONE_MARK)).otherwise(F.lit(PENDING_MARK))
                .alias("processed"),
                day_label("upload_time").alias("upload_time"),
                day_label("processed_time").alias("processed_time"),
            ))


def clean_lookup(text: str | None) -> str:
    """D6 input rule: ``%20`` and ``+`` mean a space."""
    return (text or "").replace("%20", " ").replace("+", " ")


def path_contains(df: DataFrame, lookup: str | None, path_col: str = "path") -> DataFrame:
    """Substring filter on the path; blank lookup means no filter.  A literal ``contains``: ``_`` and
    ``%`` are ordinary characters and the text is never spliced into SQL."""
    needle = clean_lookup(lookup)
    if needle == "":
        return df
    return df.filter(F.contains(F.col(path_col), F.lit(needle)))


def path_parts(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Path without scheme, and the last segment."""
    return df.select("*", strip_scheme(path_col).alias("volume"), base_name(path_col).alias("pdf"))


def contract_details(extract: DataFrame, lookup: str | None = "") -> DataFrame:
    """Formatted detail rows (all contracts, or those whose path contains the lookup)."""
    e = path_contains(extract, lookup)
    out = [F.col("path"), strip_scheme("path").alias("volume"), base_name("path").alias("pdf")]
    for f in CONTRACT_FIELDS:
        if f in ("valor_total", "multa_rescisao"):
            out.append(F.format_number(F.col(f), 2).alias(f))
        elif f.startswith("data_"):
            out.append(F.date_format(F.col(f), "dd/MM/yyyy").alias(f))
        else:
            out.append(F.col(f))
    out.append(F.col("summarize"))
    return e.select(out)


def detail_projection(extract: DataFrame, lookup: str | None = "") -> DataFrame:
    """D3: the 20-column API projection of the detail rows."""
    return contract_details(extract, lookup).select(DETAIL_COLUMNS)


def listing_projection(registry: DataFrame) -> DataFrame:
    """The 7 listing columns; fails before any job runs if one is missing."""
    listing = files_listing(registry)
    missing = [c for c in LISTING_COLUMNS if c not in listing.columns]
    if missing:
        raise ValueError(f"listing is missing columns {missing}")
    return listing.select(LISTING_COLUMNS)


def first_summary(extract: DataFrame, lookup: str | None = "") -> DataFrame:
    """The first matching summary (by path), or ``''`` when nothing matches: always one row."""
    top = path_contains(extract.select("path", "summarize"), lookup).orderBy("path").limit(1)
    # Aggregating the (at most one) row gives exactly one output row, empty input included.
    return top.agg(F.coalesce(F.first("summarize"), F.lit("")).alias("summarize"))


def paginate(df: DataFrame, page: int, rows_per_page: int = 8, order: list[str | Column] | None = None
             ) -> DataFrame:
    """Page ``page`` (0-based) of ``rows_per_page`` rows under a total order."""
    if page < 0 or rows_per_page <= 0:
        raise ValueError("page must be >= 0 and rows_per_page > 0")
    order = order or list(df.columns)
    return df.orderBy(*order).offset(page * rows_per_page).limit(rows_per_page)


def page_after(df: DataFrame, order: list[str], after: tuple | None, rows_per_page: int = 8) -> DataFrame:
    """D8 by key: the rows that follow ``after`` (the order values of the last row shown; None: the first page).  The
    predicate bounds the leading column, so a sorted table is read from there on, and no earlier row is sorted."""
    if after is not None:
        beyond = F.lit(False)
        same = F.lit(True)
        for c, v in zip(order, after, strict=True):
            beyond = beyond | (same & (F.col(c) > F.lit(v)))
            same = same & (F.col(c) == F.lit(v))
        df = df.filter((F.col(order[0]) >= F.lit(after[0])) & beyond)
    return df.orderBy(*order).limit(rows_per_page)


RANGE = "_range"


def write_pages(df: DataFrame, path: str, order: list[str], ranges: int | None = None) -> None:
    """Store a listing for paging: rows dealt to ranges of the order by their rank, a folder per range, and the
    number of rows of each range."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(RANGE, F.spark_partition_id())
     .write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows"))
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    stored.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")


def read_page(spark: SparkSession, path: str, page: int, rows_per_page: int, order: list[str]) -> DataFrame:
    """D8 by rank: page ``page`` of a stored listing.  The range counts (one small row each) say which range holds the
    page's first row; only that folder, and the next ones if the page runs over its end, are read and sorted."""
    if page < 0 or rows_per_page <= 0:
        raise ValueError("page must be >= 0 and rows_per_page > 0")
    first, before, wanted, skip = page * rows_per_page, 0, [], 0
    for r in spark.read.parquet(f"{path}/counts").orderBy(RANGE).toLocalIterator():
        if before + r["n"] > first and before < first + rows_per_page:
            skip = first - before if not wanted else skip
            wanted.append(r[RANGE])
        before += r["n"]
        if before >= first + rows_per_page:
            break
    rows = spark.read.parquet(f"{path}/rows").filter(F.col(RANGE).isin(wanted) if wanted else F.lit(False))
    return rows.orderBy(*order).offset(skip).limit(rows_per_page).drop(RANGE)


def page_label(total: DataFrame, page: int, rows_per_page: int = 8) -> DataFrame:
    """D8 footer: ``from-to of count`` from a one-row count DataFrame (column ``n``)."""
    lo = F.least(F.lit(page * rows_per_page + 1), F.col("n"))
    hi = F.least(F.lit((page + 1) * rows_per_page), F.col("n"))
    return total.select(F.format_string("%d-%d of %d", lo, hi, F.col("n")).alias("label"))


def status_label(listing: DataFrame) -> DataFrame:
    """Status mark to label; actions are enabled only for processed rows."""
    done = F.col("processed") == F.lit(DONE_MARK)
    return listing.select("*", F.when(done, F.lit(DONE_LABEL)).otherwise(F.lit(PENDING_LABEL)).alias("status"),
                          done.alias("actions_enabled"))


def display_default_view(details: DataFrame) -> DataFrame:
    """The 13-column contract card; falsy values and ``-`` show as ``-``."""
    return details.select(*[display_default(c).alias(c) for c in DISPLAY_COLUMNS])


def file_size_label(registry: DataFrame) -> DataFrame:
    """Size in KB with two decimals, as the listing table renders it."""
    return registry.select("file_name", F.format_string("%.2f KB", F.col("size") / F.lit(1024.0)).alias("size_kb"))


def expiring_contracts(extract: DataFrame, year: int) -> DataFrame:
    """Contracts whose term ends in ``year``."""
    # A range on the bare column reaches the scan; a function of it would not.
    return extract.filter(F.col("data_fim_vigencia").between(F.make_date(F.lit(year), F.lit(1), F.lit(1)),
                                                             F.make_date(F.lit(year), F.lit(12), F.lit(31))))


def contract_metrics(extract: DataFrame) -> DataFrame:
    """Portfolio measures by contract type and currency (partial aggregation before the shuffle)."""
    return (extract.groupBy("tipo_contrato", "moeda")
            .agg(F.count(F.lit(1)).alias("n_contracts"),
                 F.round(F.sum("valor_total"), 2).alias("total_value"),
                 F.round(F.avg("multa_rescisao"), 6).alias("avg_penalty"),
                 F.min("data_assinatura").alias("first_signed"),
                 F.max("data_fim_vigencia").alias("last_end")))

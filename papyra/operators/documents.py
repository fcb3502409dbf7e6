"""Document parse and reassembly.

A parse result is a VARIANT ``{"metadata":{"version":..}, "error_status":.., "document":{"pages"|"elements":
[{"content":..}]}}``.  Reassembly runs inside each row with array functions (filter the non-null contents in
position order, join them with a blank line), so it needs no explode, no global sort, no group-by and no
join back to the raw parse; the application's explode / ORDER BY / GROUP BY / JOIN chain is kept as
separate operators (C7, C9, C10) for callers that want element rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.columns import dotted_extension
from papyra.functions.html import html_blocks

# The default list of extensions sent to the parser, the separator between elements, and
# the version whose items live under ``document.pages`` (all other versions use ``document.elements``).
PARSE_EXTENSIONS = [".pdf"]
ELEMENT_SEPARATOR = "\n\n"
PAGES_VERSION = "1.0"
BATCH_CHARS = 4 << 20            # parse results that a worker hands on at a time, about

Parser = Callable[[DataFrame], DataFrame]


# ----------------------------------------------------------------------------------------------- C1 - C3

def batch_topn_files(scan: DataFrame, n: int) -> DataFrame:
    """The first ``n`` files by path.  The top-n runs on the path column alone (a distributed
    take-ordered: per-task top-n, then one merge of at most ``n * tasks`` paths); content is joined back
    by a semi join, so the sort never carries file bytes."""
    top = scan.select(F.col("path").alias("_p")).orderBy("_p").limit(n)
    return scan.join(top, scan.path == top._p, "left_semi")


def spread_by_hash(df: DataFrame, partitions: int, exact: bool = False) -> DataFrame:
    """Spread slow per-row work evenly before parsing.  Rows are unchanged.

    Default: hash-partition by path.  ``exact=True`` uses the application's ``crc32(path) % P`` key (which
    Spark hashes again, leaving some partitions empty)."""
    key = (F.crc32(F.col("path")) % F.lit(partitions)) if exact else F.col("path")
    return df.repartition(partitions, key)


def route_by_extension(df: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """``route = 'parse'`` when the lower-cased extension of the last path segment is in the list,
    else ``'raw'``."""
    exts = [e.lower() for e in (extensions or PARSE_EXTENSIONS)]
    hit = F.array_contains(F.array(*[F.lit(e) for e in exts]), dotted_extension(F.col("path")))
    return df.withColumn("route", F.when(hit, F.lit("parse")).otherwise(F.lit("raw")))


# ----------------------------------------------------------------------------------------------- parsers

def parse_result(items: Column, version: str | Column = "2.0", error_status: Column | None = None,
                 form: str = "elements") -> Column:
    """Build the parse VARIANT from an ``array<string>`` of item contents."""
    elems = F.transform(items, lambda x: F.struct(x.alias("content")))
    ver = F.lit(version) if isinstance(version, str) else version
    err = error_status if error_status is not None else F.lit(None).cast("string")
    doc = F.struct(elems.alias(form))
    return F.parse_json(F.to_json(F.struct(F.struct(ver.alias("version")).alias("metadata"),
                                           err.alias("error_status"), doc.alias("document"))))


def _carried(df: DataFrame) -> list[str]:
    """What a parser hands on: every column but the bytes (path first)."""
    return ["path", *[c for c in df.columns if c not in ("path", "content")]]


def text_parser(df: DataFrame) -> DataFrame:
    """Built-in parser for UTF-8 text: each line is an element.  Undecodable bytes give an error status."""
    txt = F.try_validate_utf8(F.col("content").cast("string"))
    bad = txt.isNull()
    lines = F.when(~bad, F.split(txt, "\n"))
    return df.select(*_carried(df), parse_result(lines, "2.0", F.when(bad, F.lit("INVALID_UTF8"))).alias("parsed"))


def html_parser(df: DataFrame) -> DataFrame:
    """Built-in parser for HTML bytes: each block of text (heading, paragraph, list item, table row, ...) is an element."""
    html = F.try_validate_utf8(F.col("content").cast("string"))
    return df.select(*_carried(df), parse_result(html_blocks(html), "2.0",
                                                 F.when(html.isNull(), F.lit("INVALID_UTF8"))).alias("parsed"))


def pandas_parser(fn: Callable[[bytes], dict]) -> Parser:
    """Wrap a binary-format parser ``bytes -> dict`` (the parse contract above).  It runs in Arrow batches
    inside ``mapInArrow`` tasks; an exception becomes ``error_status`` for that file only.  One file is unpacked at a
    time, and results are handed on by their size, so a worker's memory does not follow the number of rows in a batch."""

    def one(b: bytes | None) -> str:
        try:
            return json.dumps(fn(b) if b is not None else {"error_status": "EMPTY"})
        except Exception as e:  # noqa: BLE001
            return json.dumps({"metadata": {}, "error_status": f"PARSE_FAILED: {type(e).__name__}"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            carried, content = b.select([c for c in b.schema.names if c != "content"]), b.column("content")
            names, at, out, held = [*carried.schema.names, "parsed_json"], 0, [], 0
            for i in range(b.num_rows):
                out.append(one(content[i].as_py()))
                held += len(out[-1])
                if held >= BATCH_CHARS or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*carried.slice(at, len(out)).columns, pa.array(out, pa.string())], names=names)
                    at, out, held = i + 1, [], 0

    def parser(df: DataFrame) -> DataFrame:
        carried = _carried(df)
        schema = T.StructType([df.schema[c] for c in carried] + [T.StructField("parsed_json", T.StringType())])
        j = df.select(*carried, "content").mapInArrow(run, schema)
        return j.select(*carried, F.parse_json("parsed_json").alias("parsed"))

    return parser


# ----------------------------------------------------------------------------------------------- C4 - C11

def parse_documents(routed: DataFrame, parser: Parser) -> DataFrame:
    """C4: send the ``route = 'parse'`` rows through the parser: ``(path, parsed)``."""
    return parser(routed.filter(F.col("route") == "parse").select("path", "content"))


def raw_text_documents(routed: DataFrame) -> DataFrame:
    """``route = 'raw'`` rows decoded as UTF-8 text.  Malformed bytes give ``error_status`` instead of
    failing the whole job."""
    txt = F.try_validate_utf8(F.col("content").cast("string"))
    return routed.filter(F.col("route") == "raw").select(
        "path", F.lit(None).cast("variant").alias("raw_parsed"), txt.alias("text"),
        F.lit(None).cast("string").alias("summarize"),
        F.when(txt.isNull() & F.col("content").isNotNull(), F.lit("INVALID_UTF8")).alias("error_status"))


def error_of(parsed: Column) -> Column:
    return F.try_variant_get(parsed, "$.error_status", "string")


def items_of(parsed: Column) -> Column:
    """The ``array<variant>`` of items: pages for version 1.0, elements otherwise."""
    ver = F.try_variant_get(parsed, "$.metadata.version", "string")
    return F.when(ver == F.lit(PAGES_VERSION), F.try_variant_get(parsed, "$.document.pages", "array<variant>")) \
            .otherwise(F.try_variant_get(parsed, "$.document.elements", "array<variant>"))


def parse_errors(parsed: DataFrame) -> DataFrame:
    """Parses that carry an error status; the raw parse is kept, text is NULL."""
    return parsed.filter(error_of(F.col("parsed")).isNotNull()).select(
        "path", F.col("parsed").alias("raw_parsed"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("summarize"), error_of(F.col("parsed")).alias("error_status"))


def explode_elements(parsed: DataFrame) -> DataFrame:
    """One row per item of a successful parse: ``(path, idx, content)``."""
    ok = parsed.filter(error_of(F.col("parsed")).isNull())
    return ok.select("path", F.posexplode(items_of(F.col("parsed"))).alias("idx", "element")).select(
        "path", "idx", F.try_variant_get(F.col("element"), "$.content", "string").alias("content"))


def concat_elements(elements: DataFrame) -> DataFrame:
    """C8 + C9 on element rows: one row per document, non-null contents in ``idx`` order joined by a blank
    line.  Ordering happens inside each group (``array_sort`` of ``(idx, content)``), never globally."""
    return (elements.filter(F.col("content").isNotNull())
            .groupBy("path")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))),
                                          lambda x: x["content"]), ELEMENT_SEPARATOR).alias("text")))


def reassembled_text(parsed: Column) -> Column:
    """C9 inside the row: joined non-null contents, or NULL when there are none (the document vanishes
    from the application's output in that case)."""
    contents = F.filter(F.transform(items_of(parsed), lambda e: F.try_variant_get(e, "$.content", "string")),
                        lambda x: x.isNotNull())
    # An array of one: the contents are used twice, and a branch evaluates its own copy of them.
    return F.transform(F.array(contents), lambda c: F.when(F.size(c) > 0, F.array_join(c, ELEMENT_SEPARATOR)))[0]


def concat_text(parsed: DataFrame) -> DataFrame:
    """One row per successfully parsed document with at least one non-null content."""
    ok = parsed.filter(error_of(F.col("parsed")).isNull())
    return ok.select("path", reassembled_text(F.col("parsed")).alias("text")).filter(F.col("text").isNotNull())


def attach_raw(concatenated: DataFrame, parsed: DataFrame) -> DataFrame:
    """Join the text back to the raw parse (only needed after the element-row route)."""
    return concatenated.join(parsed.select("path", F.col("parsed").alias("raw_parsed")), "path", "inner")


def parsed_outcomes(parsed: DataFrame, summary: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """C9 + C10 + summary for successful parses, in the stored shape."""
    ok = (parsed.filter(error_of(F.col("parsed")).isNull())
          .select("path", F.col("parsed").alias("raw_parsed"), reassembled_text(F.col("parsed")).alias("text"))
          .filter(F.col("text").isNotNull()))
    if summary is not None:
        ok = summary(ok)
    else:
        ok = ok.withColumn("summarize", F.lit(None).cast("string"))
    return ok.select("path", "raw_parsed", "text", "summarize",
                     F.lit(None).cast("string").alias("error_status"))


def parse_outcomes(parsed: DataFrame, summary: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """C6 + C9 + C10 in one projection: every parse result becomes its single outcome row (text for a
    success, error status for a failure; documents without any content vanish), so one pass over the
    parse output feeds both, and the parser runs once even without staging.  ``summary`` receives all rows
    and must leave rows with an ``error_status`` unsummarised."""
    err = error_of(F.col("parsed"))
    text = F.when(err.isNull(), reassembled_text(F.col("parsed")))
    # A generator of no or one row: a filter would be moved below the projection and evaluate the parse again.
    one = F.filter(F.array(F.struct(text.alias("text"), err.alias("error_status"))),
                   lambda r: r["error_status"].isNotNull() | r["text"].isNotNull())
    x = parsed.select("path", F.col("parsed").alias("raw_parsed"), F.inline(one))
    x = summary(x) if summary is not None else x.withColumn("summarize", F.lit(None).cast("string"))
    return x.select("path", "raw_parsed", "text", "summarize", "error_status")


def union_outcomes(ok: DataFrame, raw: DataFrame, errors: DataFrame) -> DataFrame:
    """C11: parsed + raw text + errors in one shape (no dedupe)."""
    cols = ["path", "raw_parsed", "text", "summarize", "error_status"]
    return ok.select(cols).unionByName(raw.select(cols)).unionByName(errors.select(cols))


def outcome_label(df: DataFrame) -> Column:
    return (F.when(F.col("error_status").isNotNull(), F.lit("error"))
            .when(F.col("raw_parsed").isNull(), F.lit("raw"))
            .otherwise(F.lit("ok")))


def coverage_report(batch: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Files in versus rows out, by outcome, including files that silently vanished.

    One full outer join of the input paths with the outcome rows (each side evaluated once): an input file
    without an outcome row is ``vanished``."""
    seen = outcomes.select(F.col("path").alias("_p"), outcome_label(outcomes).alias("_o"))
    files_in = batch.select(F.col("path").alias("_p"))
    j = files_in.join(seen, "_p", "full_outer")
    return (j.select(F.coalesce(F.col("_o"), F.lit("vanished")).alias("outcome"))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("n_files")))


def process_batch(batch: DataFrame, parser: Parser, extensions: list[str] | None = None,
                  partitions: int | None = None,
                  summary: Callable[[DataFrame], DataFrame] | None = None,
                  stage_path: str | None = None) -> DataFrame:
    """Spread, route, parse, reassemble, and combine the outcomes.

    Parse results become outcome rows in one pass (``parse_outcomes``).  With ``stage_path`` (a folder in
    the shared storage) the parse output is also written once and read back, which cuts the lineage before
    the model calls: a retried summary task does not re-run the parser.  If ``summary`` adds a column
    ``summary_error`` (failed model calls), the outcomes carry it."""
    b = spread_by_hash(batch, partitions) if partitions else batch
    routed = route_by_extension(b, extensions)
    parsed = parse_documents(routed, parser)
    if stage_path is not None:
        parsed.write.mode("overwrite").parquet(stage_path)
        parsed = parsed.sparkSession.read.schema(parsed.schema).parquet(stage_path)
    cols = ["path", "raw_parsed", "text", "summarize", "error_status"]
    done = parse_outcomes(parsed, summary)
    more = ["summary_error"] if "summary_error" in done.columns else []
    return done.select(*cols, *more).unionByName(raw_text_documents(routed).select(cols), allowMissingColumns=True)

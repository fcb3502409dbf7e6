"""Command line: the ingestion job and the serving queries.

    spark-submit papyra/cli.py ingest  --landing DIR --base DIR [--stream] [--max-files N] [--limit N]
                                       [--partitions P] [--summary-model mod:fn] [--extract-model mod:fn]
    spark-submit papyra/cli.py listing --base DIR [--page P] [--rows R]
    spark-submit papyra/cli.py details --base DIR [--lookup TEXT] [--out PATH]
    spark-submit papyra/cli.py summary --base DIR --lookup TEXT
    spark-submit papyra/cli.py context --base DIR

Models are importable callables ``list[str] -> list[str]``.  Result sets that can be large are written
with ``--out`` (parquet); otherwise a bounded number of rows is printed as JSON lines.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _load(spec: str | None):
    if not spec:
        return None
    mod, _, fn = spec.partition(":")
    return getattr(importlib.import_module(mod), fn)


def _print(df: DataFrame) -> None:
    """All rows, one JSON line each, streamed a partition at a time."""
    for line in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        print(line.j)


def _run(spark: SparkSession, cfg_base: str, **kw):
    from papyra.plans.ingestion import IngestConfig, IngestRun
    return IngestRun(spark, IngestConfig(base=cfg_base, **kw))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="papyra")
    sub = p.add_subparsers(dest="cmd", required=True)
    ing = sub.add_parser("ingest")
    ing.add_argument("--landing", required=True)
    ing.add_argument("--base", required=True)
    ing.add_argument("--stream", action="store_true")
    ing.add_argument("--max-files", type=int)
    ing.add_argument("--limit", type=int)
    ing.add_argument("--partitions", type=int)
    ing.add_argument("--checkpoint")
    ing.add_argument("--summary-model")
    ing.add_argument("--extract-model")
    for name in ("listing", "details", "summary", "context"):
        sp = sub.add_parser(name)
        sp.add_argument("--base", required=True)
        sp.add_argument("--lookup", default="")
        sp.add_argument("--page", type=int, default=0)
        sp.add_argument("--rows", type=int, default=8)
        sp.add_argument("--out")
    a = p.parse_args(argv)

    from papyra.operators import chat, serving
    from papyra.session import get_session
    spark = spark or get_session()

    if a.cmd == "ingest":
        run = _run(spark, a.base, limit=a.limit, partitions=a.partitions,
                   summary_model=_load(a.summary_model), extract_model=_load(a.extract_model))
        if a.stream:
            from papyra.streaming.ingest import stream_extract
            stream_extract(spark, run, a.landing, a.checkpoint or f"{a.base}/_checkpoints/ingest",
                           max_files_per_trigger=a.max_files)
        else:
            from papyra.sources.files import list_files
            run.ingest(list_files(spark, a.landing))
        pending = run.registry.read().filter("processed = 'N'").count()
        print(json.dumps({"registered": run.registry.read().count(), "pending": pending}))
        return 0

    run = _run(spark, a.base)
    if a.cmd == "listing":
        rows = run.registry.read()
        # The newest first, by the stored time: the listing's own dates are formatted text.
        page = rows.orderBy(F.desc_nulls_last("upload_time"), "file_name").offset(a.page * a.rows).limit(a.rows)
        _print(serving.files_listing(page))
        _print(serving.page_label(rows.selectExpr("count(*) AS n"), a.page, a.rows))
    elif a.cmd == "details":
        details = serving.contract_details(run.extracted(), a.lookup)
        if a.out:
            details.write.mode("overwrite").parquet(a.out)
        else:
            _print(details)
    elif a.cmd == "summary":
        _print(serving.first_summary(run.extracted(), a.lookup))
    elif a.cmd == "context":
        _print(chat.chat_context(run.extracted()))
    return 0


if __name__ == "__main__":
    sys.exit(main())

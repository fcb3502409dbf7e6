"""

Every query reads the driver tables (or data Spark derives from them, see ``papyra.plans.fixtures``) in
full.  Dates leave the queries as ISO text so that both engines print them the same way.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))  # the package sits next to this file

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.plans import fixtures as fx
from papyra.plans.fixtures_sql import with_ctes
from papyra.operators import registry as reg
from papyra.operators import serving as srv
from papyra.operators import extraction as ext
from papyra.operators import documents as doc
from papyra.operators import chat
from papyra.operators import events as ev
from papyra.operators import signals as sig

SF0001 = "/root/testdata/sf0.001"
RUN_TIME = "2025-01-01 12:00:00"  # the fixed "now" of the registered status-update queries


def _iso_dates(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, T.DateType)
        else F.col(f.name) for f in df.schema.fields])


_STORED: dict[tuple[str, str], str] = {}


def _stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table the ingestion run writes (registry, contract_extract), written once per process into the shared
    scratch folder and read back, as the serving layer reads the stored tables."""
    from papyra.session import scratch_path
    key = (sf, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def _extract_table(spark: SparkSession, sf: str) -> DataFrame:
    """contract_extract as the ingestion run writes it, from the model answers fixture."""
    return _stored(spark, sf, "contract_extract", lambda: ext.expand_struct(
        ext.extract_fields(fx.model_response(spark, sf)), keep=["path", "summarize"]))


# ------------------------------------------------------------------------------------------------ registry

def q_register_new_files(spark, sf):
    return reg.register_new_files(fx.incoming(spark, sf), fx.track(spark, sf))


def q_pending_files(spark, sf):
    r = _registry(spark, sf)
    return reg.pending_files(r).select("file_name", "file_path", "size", "file_hash")


def q_pending_count(spark, sf):
    return reg.pending_count(_registry(spark, sf))


def q_mark_processed(spark, sf):
    r = _registry(spark, sf)
    finished = reg.pending_files(r).filter(F.col("type") == "pdf").select(F.col("file_path").alias("path"))
    return reg.mark_processed(r, finished, now=F.lit(RUN_TIME).cast("timestamp"))


def q_arrival_semi(spark, sf):
    b = fx.batch(spark, sf)
    return reg.arrival_semi(b, _registry(spark, sf)).select(
        "path", F.octet_length("content").cast("long").alias("n_bytes"))


def q_latest_upload(spark, sf):
    # Two listings of the same names: the later one (re-uploads an hour later) wins.
    inv = fx.files(spark, sf).drop("doc_id")
    later = inv.withColumn("upload_time", F.col("upload_time") + F.expr("INTERVAL 1 HOUR")) \
               .withColumn("size", F.col("size") + 1)
    return reg.latest_upload(inv.unionByName(later))


# ------------------------------------------------------------------------------------------------ serving

def _registry(spark, sf):
    """contract_track after admitting the incoming listing (stored, as the ingestion run keeps it)."""
    return _stored(spark, sf, "contract_track",
                   lambda: reg.apply_registration(fx.incoming(spark, sf), fx.track(spark, sf)))


def q_files_listing(spark, sf):
    return srv.files_listing(_registry(spark, sf))


def q_listing_projection(spark, sf):
    return srv.listing_projection(_registry(spark, sf))


def q_status_label(spark, sf):
    return srv.status_label(srv.files_listing(_registry(spark, sf))).select(
        "file_name", "processed", "status", "actions_enabled")


def q_file_size_label(spark, sf):
    return srv.file_size_label(_registry(spark, sf))


def q_contract_details(spark, sf):
    return srv.contract_details(_extract_table(spark, sf))


def q_detail_projection(spark, sf):
    return srv.detail_projection(_extract_table(spark, sf), "contrato_1")


def q_path_contains(spark, sf):
    return srv.path_contains(_extract_table(spark, sf).select("path"), "contrato_7")


def q_path_parts(spark, sf):
    return srv.path_parts(fx.files(spark, sf).select(F.col("file_path").alias("path")))


def q_first_summary(spark, sf):
    return srv.first_summary(_extract_table(spark, sf), "contrato_12")


def q_paginate(spark, sf):
    return srv.paginate(srv.files_listing(_registry(spark, sf)), page=3, rows_per_page=8,
                        order=["file_name"])


def q_page_label(spark, sf):
    total = _registry(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return srv.page_label(total, page=3, rows_per_page=8)


def q_page_by_range(spark, sf):
    """D8 by rank: pages 0, 30 and 10000 of the stored listing, each read from the range that holds it."""
    from papyra.session import scratch_path
    path = scratch_path(spark, "pages")
    srv.write_pages(_registry(spark, sf), path, ["file_name"])
    pages = [srv.read_page(spark, path, p, 8, ["file_name"]).withColumn("page", F.lit(p)) for p in (0, 30, 10_000)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).select("page", "file_name", "size", "processed")


def q_page_after(spark, sf):
    """D8 by key: the page that follows a given last row."""
    return srv.page_after(_registry(spark, sf).select("file_name", "size", "processed"), ["file_name"], ("doc_42.pdf",), 25)


def q_display_default(spark, sf):
    return srv.display_default_view(srv.contract_details(_extract_table(spark, sf)))


def q_expiring_contracts(spark, sf):
    return _iso_dates(srv.expiring_contracts(_extract_table(spark, sf), 1996).select(
        "path", "data_fim_vigencia", "valor_total"))


def q_contract_metrics(spark, sf):
    return _iso_dates(srv.contract_metrics(_extract_table(spark, sf)))


# ------------------------------------------------------------------------------------------------ extraction

def q_extract_fields(spark, sf):
    e = ext.extract_fields(fx.model_response(spark, sf))
    return _iso_dates(e.select("path", "extract_status", "info.*"))


def q_write_extract(spark, sf):
    """Extraction of the answers whose contract is not yet in the extract table (even keys are)."""
    answers = fx.model_response(spark, sf)
    existing = _extract_table(spark, sf).join(
        answers.filter(F.col("o_orderkey") % 2 == 0).select("path"), "path", "left_semi")
    return _iso_dates(ext.write_extract(answers.select("path", "summarize", "response"), existing))


def q_field_rules(spark, sf):
    return ext.field_rules(fx.model_response(spark, sf))


def q_parse_summary(spark, sf):
    return ext.parse_summary(fx.wrapped_summary(spark, sf))


# ------------------------------------------------------------------------------------------------ documents

def _routed(spark, sf):
    return doc.route_by_extension(fx.batch(spark, sf))


def _parsed(spark, sf):
    return doc.parse_documents(_routed(spark, sf), fx.fixture_parser)


def q_batch_topn_files(spark, sf):
    return doc.batch_topn_files(fx.batch(spark, sf), 100).select(
        "path", F.octet_length("content").cast("long").alias("n_bytes"))


def q_spread_by_hash(spark, sf):
    return doc.spread_by_hash(fx.batch(spark, sf), 10).select(
        "path", F.octet_length("content").cast("long").alias("n_bytes"))


def q_route_by_extension(spark, sf):
    return _routed(spark, sf).select("path", "route")


def q_parse_documents(spark, sf):
    p = F.col("parsed")
    return _parsed(spark, sf).select(
        "path", F.try_variant_get(p, "$.metadata.version", "string").alias("version"),
        # a failed parse has no document: 0 items
        F.coalesce(F.size(doc.items_of(p)), F.lit(0)).cast("long").alias("n_items"),
        doc.error_of(p).alias("error_status"))


def q_raw_text_documents(spark, sf):
    return doc.raw_text_documents(_routed(spark, sf)).select("path", "text", "error_status")


def q_parse_errors(spark, sf):
    return doc.parse_errors(_parsed(spark, sf)).select("path", "error_status")


def q_explode_elements(spark, sf):
    return doc.explode_elements(_parsed(spark, sf))


def q_concat_elements(spark, sf):
    return doc.concat_elements(doc.explode_elements(_parsed(spark, sf)))


def q_concat_text(spark, sf):
    return doc.concat_text(_parsed(spark, sf))


def q_attach_raw(spark, sf):
    parsed = _parsed(spark, sf)
    j = doc.attach_raw(doc.concat_elements(doc.explode_elements(parsed)), parsed)
    return j.select("path", "text", F.try_variant_get("raw_parsed", "$.metadata.version", "string").alias("version"))


def _outcomes(spark, sf):
    routed = _routed(spark, sf)
    done = doc.parse_outcomes(doc.parse_documents(routed, fx.fixture_parser))     # text and errors of one parse
    return done.unionByName(doc.raw_text_documents(routed).select(done.columns))


def q_union_outcomes(spark, sf):
    o = _outcomes(spark, sf)
    return o.select("path", doc.outcome_label(o).alias("outcome"), "text", "error_status")


def q_coverage_report(spark, sf):
    return doc.coverage_report(fx.batch(spark, sf), _outcomes(spark, sf))


def q_parse_binary(spark, sf):
    """C4 with a parser of bytes (``pandas_parser``): one element a line; files it cannot read get an error status."""
    from papyra.functions.model import parse_lines
    parsed = doc.parse_documents(_routed(spark, sf), doc.pandas_parser(parse_lines))
    return doc.parse_outcomes(parsed).select("path", "text", "error_status")


def q_parse_html(spark, sf):
    pages = fx.table(spark, sf, "pages").select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("path"),
        F.encode("html", "UTF-8").alias("content"))
    p = doc.html_parser(pages)
    return p.select("path", F.size(doc.items_of(F.col("parsed"))).cast("long").alias("n_blocks"),
                    doc.reassembled_text(F.col("parsed")).alias("text"))


# ------------------------------------------------------------------------------------------------ chat

def _conversations(spark, sf):
    return fx.table(spark, sf, "conversations")


def q_chat_context(spark, sf):
    return chat.chat_context(fx.summary(spark, sf))


def q_chat_prompt(spark, sf):
    ctx = chat.chat_context(fx.summary(spark, sf))
    qs = _conversations(spark, sf).filter(F.col("role") == "user")
    return chat.chat_prompt(qs, ctx).select("conv_id", "turn", "system_content", "user_content")


def q_extract_answer(spark, sf):
    return chat.extract_answer(fx.responses(spark, sf)).select("conv_id", "turn", "answer")


def q_append_turn(spark, sf):
    c = _conversations(spark, sf)
    last = c.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("q"),
        F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("a"))
    ex = last.filter(F.col("q").isNotNull() & F.col("a").isNotNull()).select(
        "conv_id", F.col("q.text").alias("question"), F.col("a.text").alias("answer"))
    return chat.append_turn(c, ex)


def q_turn_pairs(spark, sf):
    return chat.turn_pairs(_conversations(spark, sf))


def q_history_view(spark, sf):
    return chat.history_view(_conversations(spark, sf))


def q_skip_blank_input(spark, sf):
    return chat.skip_blank_input(_conversations(spark, sf))


# ------------------------------------------------------------------------------------------------ events

def _events(spark, sf):
    return fx.table(spark, sf, "events")


def q_collapse_runs(spark, sf):
    return ev.collapse_runs(_events(spark, sf))


def q_elapsed_label(spark, sf):
    return ev.elapsed_label(_events(spark, sf)).select("event_id", "user_id", "elapsed")


def q_latest_kv(spark, sf):
    return ev.latest_kv(_events(spark, sf), ["user_id", "event_type"])


def q_latest_items(spark, sf):
    return ev.latest_items(fx.items(spark, sf), fx.deleted_items(spark, sf))


def q_item_text(spark, sf):
    return ev.item_text(fx.items(spark, sf)).select("item_id", "seq", "display_text")


def q_speaker_label(spark, sf):
    return ev.speaker_label(fx.items(spark, sf)).select("item_id", "seq", "speaker")


def q_exclude_interrupted(spark, sf):
    return ev.exclude_interrupted(fx.tracks(spark, sf)).select("track_id", "event_id")


def q_track_offsets(spark, sf):
    kept = ev.exclude_interrupted(fx.tracks(spark, sf))
    return ev.track_offsets(kept).select("track_id", "event_id", "length", "offset")


# ------------------------------------------------------------------------------------------------ signals

RATE = float(fx.SAMPLE_RATE)


def _r6(c):
    return F.round(c, 6)


def _long(spark, sf):
    return sig.explode_samples(fx.signals(spark, sf), ["vec_id", "channel", "signal_id"])


def q_downsample_mean(spark, sf):
    d = sig.downsample(fx.signals(spark, sf), ["vec_id"], 24)
    return d.select("vec_id", "bucket", _r6(F.col("value")).alias("value"))


def q_downsample_peak(spark, sf):
    d = sig.downsample(fx.signals(spark, sf), ["vec_id"], 24, peaks=True)
    return d.select("vec_id", "bucket", _r6(F.col("value")).alias("value"))


def q_normalize_signals(spark, sf):
    """S1 + S2 over signals of 1 to 64 values: each has its 24 values in the output, shorter ones interpolated."""
    short = fx.signals(spark, sf).withColumn("samples", F.slice("samples", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")))
    d = sig.normalize(short, ["vec_id"], 24)
    return d.select("vec_id", "idx", _r6(F.col("value")).alias("value"))


def q_upsample_linear(spark, sf):
    s = fx.signals(spark, sf)
    return s.select("vec_id", F.posexplode(sig.upsample(s, 100)).alias("idx", "value")).select(
        "vec_id", "idx", _r6(F.col("value")).alias("value"))


def _bands(spark, sf, kind):
    b = sig.band_peak(fx.spectra(spark, sf), ["vec_id"], RATE, kind)
    return b.select("vec_id", "band", "label", "frequency", _r6(F.col("value")).alias("value"),
                    _r6(F.col("level")).alias("level"))


def q_band_peak_music(spark, sf):
    return _bands(spark, sf, "music")


def q_band_peak_voice(spark, sf):
    return _bands(spark, sf, "voice")


def q_linear_bins(spark, sf):
    b = sig.linear_bins(fx.spectra(spark, sf), ["vec_id"], RATE)
    return b.select("vec_id", "idx", "frequency", "label", _r6(F.col("value")).alias("value"),
                    _r6(F.col("level")).alias("level"))


def q_minmax_clamp(spark, sf):
    b = sig.linear_bins(fx.spectra(spark, sf), ["vec_id"], RATE)
    return b.select("vec_id", "idx", _r6(F.col("level")).alias("level"))


def _pcm(spark, sf):
    lng = _long(spark, sf)
    return lng.select("vec_id", "signal_id", "channel", "idx", sig.pcm16_quantise(F.col("value")).alias("pcm"))


def q_pcm16(spark, sf):
    p = _pcm(spark, sf)
    return p.select("vec_id", "idx", "pcm", sig.pcm16_dequantise(F.col("pcm")).alias("dequantised"))


def q_mix_channels(spark, sf):
    m = sig.mix_channels(_long(spark, sf))
    return m.select("signal_id", "idx", _r6(F.col("value")).alias("value"))


def q_interleave_channels(spark, sf):
    return sig.interleave_channels(_long(spark, sf))


def _chunks(spark, sf):
    s = fx.signals(spark, sf)
    return s.select("channel", F.col("signal_id").alias("seq"), "samples")


def q_concat_chunks(spark, sf):
    return sig.concat_chunks(_chunks(spark, sf), width=16)


def q_rechunk(spark, sf):
    return sig.rechunk(sig.concat_chunks(_chunks(spark, sf), width=16))


def q_trim_leading_zeros(spark, sf):
    p = _pcm(spark, sf).select("signal_id", "channel", "idx", F.col("pcm").alias("value"))
    return sig.trim_leading_zeros(p)


def q_duration_seconds(spark, sf):
    return sig.duration_seconds(_long(spark, sf), RATE)


# ------------------------------------------------------------------------------------------------ sources, model, streams

def q_file_inventory(spark, sf):
    """A1 + A2 over the landed documents: name, type, size and MD5 of every file."""
    from papyra.sources.files import file_inventory
    return file_inventory(spark, _landing(spark, sf)).select("file_name", "type", "size", "file_hash")


def q_binary_scan(spark, sf):
    """A4 over the landed documents: contents up to a size, larger files reported without their bytes."""
    from papyra.functions.columns import base_name
    from papyra.sources.files import binary_scan
    b = binary_scan(spark, _landing(spark, sf), max_bytes=4096, report_skipped=True)
    return b.select(base_name("path").alias("file_name"), F.col("length").cast("long").alias("length"), "scan_status",
                    F.md5("content").alias("content_hash"))


def q_fetch_content(spark, sf):
    """A10: the bytes of the first landed file that a lookup text names, inside the landing folder only."""
    from papyra.functions.columns import base_name
    from papyra.sources.files import fetch_content, list_files, qualified
    landing = _landing(spark, sf)
    got = fetch_content(spark, list_files(spark, landing), "doc_1", qualified(spark, landing))
    return got.select(base_name("path").alias("file_name"), F.octet_length("content").cast("long").alias("n_bytes"),
                      F.md5("content").alias("content_hash"))


def q_append_sink(spark, sf):
    """Two appends by name (the second with its columns in another order) and the table read back."""
    from papyra.schemas import CONTRACT_TRACK
    from papyra.session import scratch_path
    from papyra.sources.tables import append_sink, table_scan
    path = scratch_path(spark, "appended")
    append_sink(fx.track(spark, sf), path, CONTRACT_TRACK)
    more = reg.register_new_files(fx.incoming(spark, sf), fx.track(spark, sf))
    append_sink(more.select(*reversed(more.columns)), path, CONTRACT_TRACK)
    return table_scan(spark, path).select("file_name", "type", "size", "processed", "file_path", "file_hash")


def q_named_table_scan(spark, sf):
    """A5 + A8 + A9: a table registered by name and queried through IDENTIFIER and value markers."""
    import uuid
    from papyra.sources.tables import sql_with_names, table_scan, temp_view
    name = f"documents_{uuid.uuid4().hex[:8]}"
    temp_view(table_scan(spark, f"{sf}/documents.parquet"), name)
    return sql_with_names(spark, "SELECT lang, count(*) AS n_docs, sum(n_chars) AS n_chars FROM IDENTIFIER(:t) "
                                 "WHERE n_chars >= :lo GROUP BY lang", t=name, lo=0)


def q_build_prompt(spark, sf):
    return fx.summary(spark, sf).select("path", ext.build_prompt("summarize", "extract").alias("prompt"))


def q_infer_text(spark, sf):
    from papyra.functions.model import md5_model, infer_text
    p = fx.summary(spark, sf).select("path", ext.build_prompt("summarize", "extract").alias("prompt"))
    return infer_text(p, "prompt", md5_model).select("path", "response", "model_error")


def q_summarize_documents(spark, sf):
    from papyra.functions.model import md5_model
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    return ext.summarize_documents(d, "text", md5_model).select("doc_id", "summarize")


_LANDED: dict[str, str] = {}


def _landing(spark: SparkSession, sf: str) -> str:
    """The documents landed as files once per process (the landing folder is only ever read)."""
    from papyra.session import scratch_path
    if sf not in _LANDED:
        path = scratch_path(spark, "landing")
        fx.land_documents(spark, sf, path)
        _LANDED[sf] = path
    return _LANDED[sf]


def q_stream_register(spark, sf):
    """Documents landed as files, registered by an availableNow binaryFile stream."""
    from papyra.plans.ingestion import IngestConfig, IngestRun
    from papyra.session import scratch_path
    from papyra.streaming.ingest import stream_register
    landing = _landing(spark, sf)
    run = IngestRun(spark, IngestConfig(base=scratch_path(spark, "z1")))
    stream_register(spark, run, landing, scratch_path(spark, "z1-ckpt"))
    return run.registry.read().select("file_name", "type", "size", "processed", "file_hash")


def _run_config(base: str, healthy: bool = True, **kw):
    """An ingestion run with the stand-in models, or with models that fail for some documents."""
    from papyra.functions import model as m
    from papyra.plans.ingestion import IngestConfig
    return IngestConfig(base=base, summary_source="text", summary_model=m.md5_model if healthy else m.failing_summary,
                        extract_model=m.extract_stand_in if healthy else m.failing_extract, **kw)


def _run_rows(run) -> DataFrame:
    """What a run stored for each identity: outcome, mark, extract status and fields."""
    from papyra.functions.columns import base_name
    parsed = run.parsed()
    flags = run.registry.read().select(F.col("file_path").alias("path"), "file_hash", "processed")
    fields = run.extracted().select("path", "file_hash", "extract_status", "tipo_contrato", "valor_total")
    p = parsed.select("path", "file_hash", doc.outcome_label(parsed).alias("outcome"), "text", "error_status")
    return (flags.join(p, ["path", "file_hash"], "left").join(fields, ["path", "file_hash"], "left")
            .select(base_name("path").alias("file_name"), "file_hash", "outcome", "processed", "extract_status",
                    "tipo_contrato", "valor_total", "text", "error_status"))


def q_stream_extract(spark, sf):
    """Documents landed as files; one availableNow stream registers, parses, summarises, extracts and marks them
    (stand-in models).  Output: each stored outcome with its registry flag and extracted fields."""
    from papyra.plans.ingestion import IngestRun
    from papyra.session import scratch_path
    from papyra.streaming.ingest import stream_extract
    landing = _landing(spark, sf)
    run = IngestRun(spark, _run_config(scratch_path(spark, "z2")))
    stream_extract(spark, run, landing, scratch_path(spark, "z2-ckpt"))
    return _run_rows(run)


def q_ingest_run(spark, sf):
    """The ingestion run twice over a landing folder: some model calls fail in the first run, every tenth file is
    replaced before the second (re-uploads admitted).  Output: each identity (name, hash) with what is stored for it."""
    from papyra.plans.ingestion import IngestRun
    from papyra.session import scratch_path
    from papyra.sources.files import list_files
    landing, base = scratch_path(spark, "changing"), scratch_path(spark, "ingest")
    fx.land_documents(spark, sf, landing)
    IngestRun(spark, _run_config(base, healthy=False, admit_match="hash")).ingest(list_files(spark, landing))
    fx.land_documents(spark, sf, landing, only="doc_id % 10 = 0", suffix=" v2")
    run = IngestRun(spark, _run_config(base, admit_match="hash"))
    run.ingest(list_files(spark, landing))
    return _run_rows(run).drop("text", "error_status")


def q_change_feed(spark, sf):
    from papyra.streaming.changes import change_feed
    before = fx.track(spark, sf)
    after = q_mark_processed(spark, sf)
    return change_feed(before, after, "file_path", ["processed", "processed_time", "file_hash"])


def q_stream_latest_kv(spark, sf):
    """The events as six files; three micro-batches, a restart from the checkpoint, three more."""
    from papyra.session import scratch_path
    from papyra.streaming.changes import stream_latest_kv
    events = fx.table(spark, sf, "events")
    src, out, ckpt = scratch_path(spark, "events"), scratch_path(spark, "latest-kv"), scratch_path(spark, "latest-kv-ckpt")
    half = F.crc32(F.col("event_id").cast("string")) % 2
    for part in (0, 1):
        events.filter(half == part).repartition(3, "event_id").write.mode("append").parquet(src)
        now = stream_latest_kv(spark, src, events.schema, ["user_id", "event_type"], "value", ["ts", "event_id"],
                               out, ckpt, max_files_per_trigger=1, compact_every=4)
    return now


# ------------------------------------------------------------------------------------------------ entry

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: contract details served from the extract table built from sf0.001."""
    return _utc(q_contract_details)(spark, SF0001)


def _utc(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Timestamps are read and formatted in UTC (the tables hold UTC wall times)."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        # The comparison reads the tables' zone-less times as UTC in both engines: this module's contract, not the library's.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _llm() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the training-data operators, or nothing where that sub-package is not installed."""
    try:
        from papyra.llm.queries import QUERIES
        from papyra.llm.oracles import ORACLES
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith("papyra.llm"):
            raise
        return {}, {}
    return dict(QUERIES), dict(ORACLES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _utc(v) for k, v in {**_QUERIES, **_llm()[0]}.items()}


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "register_new_files": q_register_new_files,
        "pending_files": q_pending_files,
        "pending_count": q_pending_count,
        "mark_processed": q_mark_processed,
        "latest_upload": q_latest_upload,
        "arrival_semi": q_arrival_semi,
        "write_extract": q_write_extract,
        "files_listing": q_files_listing,
        "listing_projection": q_listing_projection,
        "status_label": q_status_label,
        "file_size_label": q_file_size_label,
        "contract_details": q_contract_details,
        "detail_projection": q_detail_projection,
        "path_contains": q_path_contains,
        "path_parts": q_path_parts,
        "first_summary": q_first_summary,
        "paginate": q_paginate,
        "page_label": q_page_label,
        "page_by_range": q_page_by_range,
        "page_after": q_page_after,
        "display_default": q_display_default,
        "expiring_contracts": q_expiring_contracts,
        "contract_metrics": q_contract_metrics,
        "extract_fields": q_extract_fields,
        "field_rules": q_field_rules,
        "parse_summary": q_parse_summary,
        "batch_topn_files": q_batch_topn_files,
        "spread_by_hash": q_spread_by_hash,
        "route_by_extension": q_route_by_extension,
        "parse_documents": q_parse_documents,
        "raw_text_documents": q_raw_text_documents,
        "parse_errors": q_parse_errors,
        "explode_elements": q_explode_elements,
        "concat_elements": q_concat_elements,
        "concat_text": q_concat_text,
        "attach_raw": q_attach_raw,
        "union_outcomes": q_union_outcomes,
        "coverage_report": q_coverage_report,
        "parse_binary": q_parse_binary,
        "parse_html": q_parse_html,
        "chat_context": q_chat_context,
        "chat_prompt": q_chat_prompt,
        "extract_answer": q_extract_answer,
        "append_turn": q_append_turn,
        "turn_pairs": q_turn_pairs,
        "history_view": q_history_view,
        "skip_blank_input": q_skip_blank_input,
        "collapse_runs": q_collapse_runs,
        "elapsed_label": q_elapsed_label,
        "latest_kv": q_latest_kv,
        "latest_items": q_latest_items,
        "item_text": q_item_text,
        "speaker_label": q_speaker_label,
        "exclude_interrupted": q_exclude_interrupted,
        "track_offsets": q_track_offsets,
        "downsample_mean": q_downsample_mean,
        "downsample_peak": q_downsample_peak,
        "normalize_signals": q_normalize_signals,
        "upsample_linear": q_upsample_linear,
        "band_peak_music": q_band_peak_music,
        "band_peak_voice": q_band_peak_voice,
        "linear_bins": q_linear_bins,
        "minmax_clamp": q_minmax_clamp,
        "pcm16": q_pcm16,
        "mix_channels": q_mix_channels,
        "interleave_channels": q_interleave_channels,
        "concat_chunks": q_concat_chunks,
        "rechunk": q_rechunk,
        "trim_leading_zeros": q_trim_leading_zeros,
        "duration_seconds": q_duration_seconds,
        "file_inventory": q_file_inventory,
        "binary_scan": q_binary_scan,
        "fetch_content": q_fetch_content,
        "append_sink": q_append_sink,
        "named_table_scan": q_named_table_scan,
        "build_prompt": q_build_prompt,
        "infer_text": q_infer_text,
        "summarize_documents": q_summarize_documents,
        "stream_register": q_stream_register,
        "stream_extract": q_stream_extract,
        "ingest_run": q_ingest_run,
        "change_feed": q_change_feed,
        "stream_latest_kv": q_stream_latest_kv,
    }


# ------------------------------------------------------------------------------------------------ oracles

_LISTING_SELECT = """SELECT file_name, file_path, type,
       format('{:,.0f}', round(size / 1024, 2)) AS size,
       CASE WHEN processed = 'S' THEN '✅' ELSE '❌' END AS processed,
       coalesce(strftime(upload_time, '%d/%m/%Y'), '-') AS upload_time,
       coalesce(strftime(processed_time, '%d/%m/%Y'), '-') AS processed_time
FROM registry"""


def _details_select(where: str = "") -> str:
    from papyra.schemas import CONTRACT_FIELDS
    cols = ["path", "replace(path, 'dbfs:', '') AS volume", "split_part(path, '/', -1) AS pdf"]
    for f in CONTRACT_FIELDS:
        if f in ("valor_total", "multa_rescisao"):
            cols.append(f"format('{{:,.2f}}', {f}) AS {f}")
        elif f.startswith("data_"):
            cols.append(f"strftime({f}, '%d/%m/%Y') AS {f}")
        else:
            cols.append(f)
    cols.append('"summarize"')
    return ("SELECT " + ", ".join(cols) + ' FROM (SELECT e.*, s."summarize" FROM extracted e '
            "JOIN summary s USING (o_orderkey)) x " + where)


def _oracle_parse_summary() -> str:
    from papyra.operators.extraction import SUMMARY_TEMPLATE
    from papyra.plans.fixtures_sql import render_value_sql
    from papyra.plans.fixtures import WRAP
    parts = []
    section, valued = None, 0
    wrapped = "o_orderkey % 4 = 0"
    for i, (kind, title, field) in enumerate(SUMMARY_TEMPLATE, start=1):
        if kind == "head":
            section = title
        if field is None:
            continue
        label = f"'{title}'" if kind in ("head", "item") else "CAST(NULL AS VARCHAR)"
        # Each value before this one takes a second line where values are wrapped.
        parts.append(f"SELECT path, {i} + CASE WHEN {wrapped} THEN {valued} ELSE 0 END AS line_no, '{section}' AS section, "
                     f"{label} AS label, {render_value_sql(field)} || CASE WHEN {wrapped} THEN ' {WRAP}' ELSE '' END AS value, "
                     "CAST(o_orderkey % 5 + 1 AS INTEGER) AS page FROM truth")
        valued += 1
    return with_ctes("truth") + "\nUNION ALL\n".join(parts)


def oracle_sql() -> dict[str, str]:
    return {**_oracles(), **_llm()[1]}


def _oracles() -> dict[str, str]:
    from papyra.schemas import CONTRACT_FIELDS
    reg_ctes = with_ctes("registry")
    ex_fields = ", ".join(
        f"strftime({f}, '%Y-%m-%d') AS {f}" if f.startswith("data_") else f for f in CONTRACT_FIELDS)
    details = with_ctes("extracted", "summary")
    return {
        "register_new_files": with_ctes("new_files") +
        "SELECT file_name, type, size, processed, file_path, upload_time, processed_time, file_hash FROM new_files",
        "pending_files": reg_ctes + "SELECT file_name, file_path, size, file_hash FROM registry WHERE processed = 'N'",
        "pending_count": reg_ctes + "SELECT count(*) AS pending FROM registry WHERE processed = 'N'",
        "mark_processed": reg_ctes + f"""SELECT file_name, type, size,
  CASE WHEN processed = 'N' AND type = 'pdf' THEN 'S' ELSE processed END AS processed, file_path, upload_time,
  CASE WHEN processed = 'N' AND type = 'pdf' THEN TIMESTAMP '{RUN_TIME}' ELSE processed_time END AS processed_time,
  file_hash FROM registry""",
        "latest_upload": with_ctes("files") + """SELECT file_name, type, size + 1 AS size, file_path,
  upload_time + INTERVAL 1 HOUR AS upload_time, processed_time, file_hash FROM files""",
        "files_listing": reg_ctes + _LISTING_SELECT,
        "arrival_semi": reg_ctes + """SELECT file_path AS path, CAST(strlen(text) AS BIGINT) AS n_bytes FROM files
  WHERE file_path IN (SELECT file_path FROM registry WHERE processed = 'N')""",
        "write_extract": details + 'SELECT path, "summarize", ' + ex_fields +
        " FROM extracted JOIN summary USING (o_orderkey, path) WHERE o_orderkey % 2 = 1",
        "listing_projection": reg_ctes + _LISTING_SELECT,
        "status_label": reg_ctes + """SELECT file_name,
  CASE WHEN processed = 'S' THEN '✅' ELSE '❌' END AS processed,
  CASE WHEN processed = 'S' THEN 'Processado' ELSE 'Pendente' END AS status,
  processed = 'S' AS actions_enabled FROM registry""",
        "file_size_label": reg_ctes + "SELECT file_name, printf('%.2f KB', round(size / 1024.0, 2)) AS size_kb FROM registry",
        "contract_details": details + _details_select(),
        "detail_projection": details + "SELECT " + ", ".join(CONTRACT_FIELDS + ['"summarize"']) + " FROM (" +
        _details_select("WHERE contains(path, 'contrato_1')") + ") d",
        "path_contains": with_ctes("truth") + "SELECT path FROM truth WHERE contains(path, 'contrato_7')",
        "path_parts": with_ctes("files") + """SELECT file_path AS path, replace(file_path, 'dbfs:', '') AS volume,
  split_part(file_path, '/', -1) AS pdf FROM files""",
        "first_summary": details + """SELECT coalesce((SELECT "summarize" FROM summary
  WHERE contains(path, 'contrato_12') ORDER BY path LIMIT 1), '') AS "summarize" """,
        "page_label": reg_ctes + "SELECT printf('%d-%d of %d', least(25, n), least(32, n), n) AS label "
                                 "FROM (SELECT count(*) AS n FROM registry)",
        "page_by_range": reg_ctes + """SELECT page, file_name, size, processed FROM (
  SELECT *, CAST((row_number() OVER (ORDER BY file_name) - 1) // 8 AS INTEGER) AS page FROM registry) WHERE page IN (0, 30, 10000)""",
        "page_after": reg_ctes + "SELECT file_name, size, processed FROM registry WHERE file_name > 'doc_42.pdf' ORDER BY file_name LIMIT 25",
        "paginate": reg_ctes + "SELECT * FROM (" + _LISTING_SELECT + ") ORDER BY file_name LIMIT 8 OFFSET 24",
        "display_default": details + "SELECT " + ", ".join(
            f"CASE WHEN {c} IS NULL OR {c} = '' THEN '-' ELSE {c} END AS {c}" for c in srv.DISPLAY_COLUMNS)
        + " FROM (" + _details_select() + ") d",
        "expiring_contracts": details + """SELECT path, strftime(data_fim_vigencia, '%Y-%m-%d') AS data_fim_vigencia,
  valor_total FROM extracted WHERE year(data_fim_vigencia) = 1996""",
        "contract_metrics": details + """SELECT tipo_contrato, moeda, count(*) AS n_contracts,
  round(sum(valor_total), 2) AS total_value, round(avg(multa_rescisao), 6) AS avg_penalty,
  strftime(min(data_assinatura), '%Y-%m-%d') AS first_signed,
  strftime(max(data_fim_vigencia), '%Y-%m-%d') AS last_end
  FROM extracted GROUP BY tipo_contrato, moeda""",
        "extract_fields": details + f"""SELECT path,
  CASE WHEN o_orderkey % 11 = 0 THEN 'no_json' ELSE 'ok' END AS extract_status, {ex_fields} FROM extracted""",
        "field_rules": with_ctes("truth") + """SELECT rule, violations FROM (
  SELECT 'code_fence' AS rule, count(*) FILTER (WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0) AS violations FROM truth
  UNION ALL SELECT 'invalid_json', count(*) FILTER (WHERE o_orderkey % 11 = 0) FROM truth
  UNION ALL SELECT 'objeto_over_500', CAST(0 AS BIGINT)
  UNION ALL SELECT 'money_not_numeric', CAST(0 AS BIGINT)
  UNION ALL SELECT 'bad_date', count(*) FILTER (WHERE o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0) FROM truth
  UNION ALL SELECT 'empty_string', count(*) FILTER (WHERE o_orderkey % 6 = 0 AND o_orderkey % 11 <> 0) FROM truth)""",
        "parse_summary": _oracle_parse_summary(),
        **_document_oracles(),
        **_chat_event_oracles(),
        **_signal_oracles(),
        **_misc_oracles(),
    }


def _misc_oracles() -> dict[str, str]:
    head = _sql_str(ext.EXTRACTION_INSTRUCTIONS)
    shead = _sql_str(ext.SUMMARY_INSTRUCTIONS)
    return {
        "named_table_scan": "SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents "
                            "WHERE n_chars >= 0 GROUP BY lang",
        "build_prompt": with_ctes("summary") + f'SELECT path, {head} || "summarize" AS prompt FROM summary',
        "infer_text": with_ctes("summary") + f'SELECT path, md5({head} || "summarize") AS response, '
                                             "CAST(NULL AS VARCHAR) AS model_error FROM summary",
        "summarize_documents": f"SELECT doc_id, md5({shead} || text) AS \"summarize\" FROM documents",
        "change_feed": with_ctes("registry") + f"""
, after AS (SELECT file_path, CASE WHEN processed = 'N' AND type = 'pdf' THEN 'S' ELSE processed END AS processed,
    CASE WHEN processed = 'N' AND type = 'pdf' THEN TIMESTAMP '{RUN_TIME}' ELSE processed_time END AS processed_time,
    file_hash FROM registry),
j AS (SELECT coalesce(b.file_path, a.file_path) AS file_path, b.file_path IS NOT NULL AS hb, a.file_path IS NOT NULL AS ha,
    b.processed AS bp, b.processed_time AS b_t, b.file_hash AS bh, a.processed AS ap, a.processed_time AS a_t, a.file_hash AS ah
    FROM track b FULL OUTER JOIN after a ON b.file_path = a.file_path)
SELECT file_path, 'insert' AS change_type, ap AS processed, a_t AS processed_time, ah AS file_hash FROM j WHERE NOT hb
UNION ALL SELECT file_path, 'delete', bp, b_t, bh FROM j WHERE NOT ha
UNION ALL SELECT file_path, 'update_preimage', bp, b_t, bh FROM j WHERE hb AND ha
    AND (bp IS DISTINCT FROM ap OR b_t IS DISTINCT FROM a_t OR bh IS DISTINCT FROM ah)
UNION ALL SELECT file_path, 'update_postimage', ap, a_t, ah FROM j WHERE hb AND ha
    AND (bp IS DISTINCT FROM ap OR b_t IS DISTINCT FROM a_t OR bh IS DISTINCT FROM ah)""",
        "stream_register": with_ctes("files") + "SELECT file_name, type, CAST(strlen(text) AS BIGINT) AS size, "
                                               "'N' AS processed, md5(text) AS file_hash FROM files",
        "stream_extract": with_ctes("files", extra="landed AS (SELECT doc_id, file_name, text FROM files)") + _run_sql("text, error_status"),
        "ingest_run": with_ctes("files", extra="""landed AS (SELECT doc_id, file_name, text FROM files
  UNION ALL SELECT doc_id, file_name, text || ' v2' FROM files WHERE doc_id % 10 = 0)""") + _run_sql(""),
        "file_inventory": with_ctes("files") + "SELECT file_name, type, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS file_hash FROM files",
        "binary_scan": with_ctes("files") + """SELECT file_name, CAST(strlen(text) AS BIGINT) AS length,
  CASE WHEN strlen(text) > 4096 THEN 'too_large' ELSE 'ok' END AS scan_status,
  CASE WHEN strlen(text) <= 4096 THEN md5(text) END AS content_hash FROM files""",
        "fetch_content": with_ctes("files") + """SELECT file_name, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS content_hash
  FROM files WHERE contains(file_name, 'doc_1') ORDER BY file_name LIMIT 1""",
        "append_sink": with_ctes("registry") + "SELECT file_name, type, size, processed, file_path, file_hash FROM registry",
        "stream_latest_kv": "SELECT user_id, event_type, first(value ORDER BY ts DESC, event_id DESC) AS value "
                            "FROM events GROUP BY user_id, event_type",
    }


def _run_sql(more: str) -> str:
    """What the ingestion run with the stand-in models stores for each row of ``landed``."""
    joined = "array_to_string(string_split(text, chr(10)), chr(10) || chr(10))"
    prompt = lambda head, x: f"md5({_sql_str(head)} || {x})"
    found = f"CASE WHEN doc_id % 3 <> 1 THEN {prompt(ext.EXTRACTION_INSTRUCTIONS, prompt(ext.SUMMARY_INSTRUCTIONS, joined))} END"
    return f"""SELECT file_name, file_hash, outcome, 'S' AS processed,
  CASE WHEN h IS NULL THEN 'no_summary' WHEN h[1] = '0' THEN 'no_json' ELSE 'ok' END AS extract_status,
  CASE WHEN h[1] <> '0' THEN h END AS tipo_contrato, CASE WHEN h[1] <> '0' THEN CAST(CAST('0x' || h[1:4] AS INTEGER) AS DOUBLE) END AS valor_total
  {", " + more if more else ""}
FROM (SELECT file_name, md5(text) AS file_hash, CASE WHEN doc_id % 3 = 1 THEN 'raw' ELSE 'ok' END AS outcome,
  CASE WHEN doc_id % 3 = 1 THEN text ELSE {joined} END AS text, CAST(NULL AS VARCHAR) AS error_status, {found} AS h FROM landed)"""


def _signal_oracles() -> dict[str, str]:
    d = "CAST({} AS DOUBLE)".format
    lng = f"""WITH sig AS (SELECT vec_id, CAST(vec_id % 2 AS INTEGER) AS channel, vec_id // 2 AS signal_id,
    embedding AS samples FROM embeddings),
lng AS (SELECT vec_id, channel, signal_id, len(samples) AS n, CAST(i - 1 AS INTEGER) AS idx,
    CAST(samples[i] AS DOUBLE) AS value FROM (SELECT *, unnest(generate_series(1, len(samples))) AS i FROM sig)),
pcm AS (SELECT vec_id, signal_id, channel, idx, CAST(trunc(CASE WHEN s < 0 THEN s * {d(32768)} ELSE s * {d(32767)} END)
    AS INTEGER) AS pcm FROM (SELECT *, greatest({d(-1)}, least({d(1)}, value)) AS s FROM lng)),
spec AS (SELECT vec_id, len(embedding) AS n, i - 1 AS idx,
    (i - 1) * (({d(1)} / len(embedding)) * {d(12000)}) AS f,
    {d(-100)} + {d(70)} * abs(CAST(embedding[i] AS DOUBLE)) AS v
    FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
oct AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{n}', {d(repr(f))})" for k, (n, f) in
                                          enumerate(zip(sig.OCTAVE8_LABELS, sig.OCTAVE8_FREQUENCIES)))}) t(k, name, f)),
notes AS (SELECT name || CAST(o AS VARCHAR) AS label, f / pow(2, 8 - o) AS frequency
    FROM oct, (SELECT unnest(generate_series(1, 8)) AS o)),
chunks AS (SELECT channel, signal_id AS seq, samples, len(samples) AS ln FROM sig WHERE channel < 9),
stream AS (SELECT channel, st + i - 1 AS pos, CAST(samples[i] AS DOUBLE) AS value FROM (
    SELECT *, sum(ln) OVER (PARTITION BY channel ORDER BY seq ROWS UNBOUNDED PRECEDING) - ln AS st,
    unnest(generate_series(1, len(samples))) AS i FROM chunks))
"""

    def bands(voice: bool) -> str:
        cond = "WHERE frequency > 32.0 AND frequency < 2000.0" if voice else ""
        return f""", bands AS (SELECT CAST(row_number() OVER (ORDER BY frequency) - 1 AS INTEGER) AS band, label, frequency,
    lead(frequency) OVER (ORDER BY frequency) AS nf FROM notes {cond}),
hit AS (SELECT s.vec_id, b.band, max(s.v) AS mv FROM spec s JOIN bands b
    ON s.f > b.frequency AND (b.nf IS NULL OR NOT s.f > b.nf) GROUP BY s.vec_id, b.band)
SELECT e.vec_id, b.band, b.label, b.frequency, CAST(0 AS DOUBLE) + round(greatest({d(-100)}, coalesce(h.mv, {d(-100)})), 6) AS value,
  CAST(0 AS DOUBLE) + round(greatest({d(0)}, least((greatest({d(-100)}, coalesce(h.mv, {d(-100)})) - {d(-100)}) / {d(70)}, {d(1)})), 6) AS level
FROM embeddings e CROSS JOIN bands b LEFT JOIN hit h ON h.vec_id = e.vec_id AND h.band = b.band"""

    level = f"CAST(0 AS DOUBLE) + round(greatest({d(0)}, least((v - {d(-100)}) / {d(70)}, {d(1)})), 6)"
    return {
        "downsample_mean": lng + f"SELECT vec_id, CAST(floor(idx * ({d(24)} / n)) AS INTEGER) AS bucket, "
                                 "CAST(0 AS DOUBLE) + round(avg(abs(value)), 6) AS value FROM lng WHERE n >= 24 GROUP BY ALL",
        "downsample_peak": lng + f"SELECT vec_id, CAST(floor(idx * ({d(24)} / n)) AS INTEGER) AS bucket, "
                                 "CAST(0 AS DOUBLE) + round(max(abs(value)), 6) AS value FROM lng WHERE n >= 24 GROUP BY ALL",
        "normalize_signals": f"""WITH s AS (SELECT vec_id, vec_id % 64 + 1 AS n, embedding[1:vec_id % 64 + 1] AS arr FROM embeddings),
v AS (SELECT vec_id, n, i, CAST(arr[i + 1] AS DOUBLE) AS value FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM s))
SELECT vec_id, CAST(floor(i * ({d(24)} / n)) AS INTEGER) AS idx, CAST(0 AS DOUBLE) + round(avg(abs(value)), 6) AS value FROM v WHERE n >= 24 GROUP BY ALL
UNION ALL SELECT vec_id, CAST(i AS INTEGER) AS idx, CAST(0 AS DOUBLE) + round(CASE WHEN hi >= n THEN CAST(arr[n] AS DOUBLE)
  ELSE CAST(arr[lo + 1] AS DOUBLE) * (1 - t) + CAST(arr[hi + 1] AS DOUBLE) * t END, 6) AS value
FROM (SELECT *, CAST(floor(x) AS BIGINT) AS lo, CAST(ceil(x) AS BIGINT) AS hi, x - floor(x) AS t FROM (
  SELECT *, i * (n - 1) / {d(23)} AS x FROM (SELECT *, unnest(generate_series(0, 23)) AS i FROM s WHERE n < 24)))""",
        "upsample_linear": f"""SELECT vec_id, CAST(i AS INTEGER) AS idx, CAST(0 AS DOUBLE) + round(CASE WHEN hi >= n THEN CAST(arr[n] AS DOUBLE)
  ELSE CAST(arr[lo + 1] AS DOUBLE) * (1 - t) + CAST(arr[hi + 1] AS DOUBLE) * t END, 6) AS value
FROM (SELECT *, CAST(floor(x) AS BIGINT) AS lo, CAST(ceil(x) AS BIGINT) AS hi, x - floor(x) AS t FROM (
  SELECT vec_id, len(embedding) AS n, embedding AS arr, i, i * (len(embedding) - 1) / {d(99)} AS x
  FROM (SELECT *, unnest(generate_series(0, 99)) AS i FROM embeddings) WHERE len(embedding) > 0))""",
        "band_peak_music": lng + bands(False),
        "band_peak_voice": lng + bands(True),
        "linear_bins": lng + f"SELECT vec_id, CAST(idx AS INTEGER) AS idx, f AS frequency, printf('%.2f Hz', f) AS label, "
                             f"CAST(0 AS DOUBLE) + round(v, 6) AS value, {level} AS level FROM spec",
        "minmax_clamp": lng + f"SELECT vec_id, CAST(idx AS INTEGER) AS idx, {level} AS level FROM spec",
        "pcm16": lng + "SELECT vec_id, idx, pcm, pcm / 32768.0 AS dequantised FROM pcm",
        "mix_channels": lng + "SELECT signal_id, idx, CAST(0 AS DOUBLE) + round(avg(value), 6) AS value FROM lng GROUP BY ALL",
        "interleave_channels": lng + """SELECT signal_id, idx * nch + channel AS pos, value FROM lng
  JOIN (SELECT signal_id, count(DISTINCT channel) AS nch FROM lng GROUP BY ALL) USING (signal_id)""",
        "concat_chunks": lng + "SELECT channel, CAST(pos AS BIGINT) AS pos, value FROM stream",
        "rechunk": lng + """SELECT channel, CAST(pos // 128 AS BIGINT) AS frame, CAST(pos % 128 AS INTEGER) AS slot, value
  FROM stream JOIN (SELECT channel, count(*) AS tot FROM stream GROUP BY ALL) USING (channel)
  WHERE pos < (tot // 128) * 128""",
        "trim_leading_zeros": lng + """SELECT signal_id, channel, idx, pcm AS value FROM pcm
  JOIN (SELECT signal_id, min(idx) AS st FROM pcm WHERE pcm <> 0 GROUP BY ALL) USING (signal_id) WHERE idx >= st""",
        "duration_seconds": lng + f"""SELECT signal_id, count(DISTINCT channel) AS n_channels, count(*) * 2 AS n_bytes,
  count(*) * 2 / (count(DISTINCT channel) * {d(24000)} * 2) AS duration_s FROM lng GROUP BY ALL""",
    }


def _sql_str(v: str) -> str:
    return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _chat_event_oracles() -> dict[str, str]:
    ctx = ("SELECT CASE WHEN count(*) = 0 THEN " + _sql_str(chat.NO_CONTRACTS_MESSAGE) +
           " ELSE left(coalesce(string_agg(\"summarize\", chr(10) || chr(10) ORDER BY path), ''), 2000) END "
           "AS context, count(*) AS n_contracts FROM summary")
    items = """items AS (SELECT conv_id AS item_id, turn AS seq, CASE WHEN role <> 'system' THEN role END AS role,
  CASE WHEN role = 'system' THEN 'function_call_output' ELSE 'message' END AS type,
  CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END AS transcript, text, turn % 3 = 1 AS has_audio
  FROM conversations)"""
    tracks = """tracks AS (SELECT user_id AS track_id, event_id, ts,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS length, event_type = 'error' AS is_interrupt FROM events),
cuts AS (SELECT track_id, first(ts ORDER BY ts, event_id) AS cts, first(event_id ORDER BY ts, event_id) AS cid
  FROM tracks WHERE is_interrupt GROUP BY track_id),
kept AS (SELECT t.* FROM tracks t LEFT JOIN cuts c USING (track_id)
  WHERE NOT t.is_interrupt AND (c.cts IS NULL OR t.ts < c.cts OR (t.ts = c.cts AND t.event_id < c.cid)))"""
    nb = "CASE WHEN {c} IS NULL OR {c} = '' THEN NULL ELSE {c} END"
    return {
        "chat_context": with_ctes("summary") + ctx,
        "chat_prompt": with_ctes("summary", extra="ctx AS (" + ctx + ")") +
        "SELECT conv_id, turn, " + _sql_str(chat.SYSTEM_PROMPT_HEAD) + " || (SELECT context FROM ctx) || " +
        _sql_str(chat.SYSTEM_PROMPT_TAIL) + " AS system_content, text AS user_content "
        "FROM conversations WHERE role = 'user'",
        "extract_answer": "SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'",
        "append_turn": """WITH last AS (SELECT conv_id, max(turn) AS t,
    arg_max(text, turn) FILTER (WHERE role = 'user') AS q,
    arg_max(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT conv_id, t + 1, 'user', q FROM last WHERE q IS NOT NULL AND a IS NOT NULL
UNION ALL SELECT conv_id, t + 2, 'assistant', a FROM last WHERE q IS NOT NULL AND a IS NOT NULL""",
        "turn_pairs": """SELECT conv_id, turn, text AS question, nt AS answer FROM (
  SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'""",
        "history_view": "SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'user' ELSE 'bot' END AS speaker "
                        "FROM conversations",
        "skip_blank_input": "SELECT conv_id, turn, role, text FROM conversations "
                            "WHERE text IS NOT NULL AND trim(text) <> ''",
        "collapse_runs": """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS st
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM a)
SELECT user_id, CAST(run_no AS BIGINT) AS run_no, first(event_type ORDER BY ts, event_id) AS event_type,
  min(ts) AS run_start, first(event_id ORDER BY ts, event_id) AS first_event_id, count(*) AS run_length,
  count(*) - 1 AS repeat_count FROM b GROUP BY user_id, run_no""",
        "elapsed_label": """SELECT event_id, user_id,
  lpad(CAST((d // 60000000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((d // 1000000) % 60 AS VARCHAR), 2, '0')
  || '.' || lpad(CAST((d // 10000) % 100 AS VARCHAR), 2, '0') AS elapsed
FROM (SELECT event_id, user_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS d FROM events)""",
        "latest_kv": "SELECT user_id, event_type, first(value ORDER BY ts DESC, event_id DESC) AS value "
                     "FROM events GROUP BY user_id, event_type",
        "latest_items": "WITH " + items + """ SELECT item_id, seq, role, type, transcript, text, has_audio FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS rn FROM items)
  WHERE rn = 1 AND item_id % 10 <> 0""",
        "item_text": "WITH " + items + f""" SELECT item_id, seq, CASE
  WHEN type = 'function_call_output' THEN text
  WHEN role = 'user' THEN coalesce({nb.format(c='transcript')}, CASE WHEN has_audio THEN '(awaiting transcript)' END,
                                   {nb.format(c='text')}, '(item sent)')
  WHEN role = 'assistant' THEN coalesce({nb.format(c='transcript')}, {nb.format(c='text')}, '(truncated)')
  END AS display_text FROM items""",
        "speaker_label": "WITH " + items + """ SELECT item_id, seq,
  replace(coalesce(CASE WHEN trim(role) = '' THEN NULL ELSE role END, type), '_', ' ') AS speaker FROM items""",
        "exclude_interrupted": "WITH " + tracks + " SELECT track_id, event_id FROM kept",
        "track_offsets": "WITH " + tracks + """ SELECT track_id, event_id, length,
  CAST(sum(length) OVER (PARTITION BY track_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "offset"
  FROM kept""",
    }


def _document_oracles() -> dict[str, str]:
    f = with_ctes("files")
    pdf = "doc_id % 3 <> 1"
    lines = "string_split(text, chr(10))"
    joined = f"array_to_string({lines}, chr(10) || chr(10))"
    version = "CASE WHEN doc_id % 4 = 0 THEN '1.0' ELSE '2.0' END"
    # The pages' own tags: what is not shown goes, a block tag is a border, <br> a line end, other tags nothing.
    shown = r"regexp_replace(html, '(?is)<!--.*?-->|<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!doctype[^>]*>', '', 'g')"
    marked = (rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({shown}, '[ \t\r\n]+', ' ', 'g'), '(?i)<br[^>]*>', chr(2), 'g'), "
              r"'(?i)</?(p|h1|li|ul|nav|div|article|footer|body|html)( [^>]*)?>', chr(1), 'g'), '<[^>]*>', '', 'g')")
    blocks = (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda b: translate(trim(regexp_replace(b, ' *' || chr(2) || ' *', "
              "chr(2), 'g'), ' ' || chr(2)), chr(2), chr(10))), lambda b: b <> '')")
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        blocks = f"list_transform({blocks}, lambda b: replace(b, '{entity}', '{char}'))"
    line_bytes = f"CASE WHEN strlen(text) % 5 = 0 THEN NULL ELSE array_to_string({lines}, chr(10) || chr(10)) END"
    outcome = (f"CASE WHEN NOT ({pdf}) THEN 'raw' WHEN doc_id % 13 = 0 THEN 'error' "
               f"WHEN doc_id % 17 = 0 THEN 'vanished' ELSE 'ok' END")
    return {
        "batch_topn_files": f + "SELECT file_path AS path, CAST(strlen(text) AS BIGINT) AS n_bytes FROM files "
                                "ORDER BY file_path LIMIT 100",
        "spread_by_hash": f + "SELECT file_path AS path, CAST(strlen(text) AS BIGINT) AS n_bytes FROM files",
        "route_by_extension": f + f"SELECT file_path AS path, CASE WHEN {pdf} THEN 'parse' ELSE 'raw' END AS route "
                                  "FROM files",
        "parse_documents": f + f"""SELECT file_path AS path, {version} AS version,
  CASE WHEN doc_id % 13 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(len({lines}) AS BIGINT) END AS n_items,
  CASE WHEN doc_id % 13 = 0 THEN 'PARSE_FAILED' END AS error_status FROM files WHERE {pdf}""",
        "raw_text_documents": f + f"SELECT file_path AS path, text, CAST(NULL AS VARCHAR) AS error_status "
                                  f"FROM files WHERE NOT ({pdf})",
        "parse_errors": f + f"SELECT file_path AS path, 'PARSE_FAILED' AS error_status FROM files "
                            f"WHERE {pdf} AND doc_id % 13 = 0",
        "explode_elements": f + f"""SELECT path, CAST(i - 1 AS INTEGER) AS idx,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE arr[i] END AS content
FROM (SELECT file_path AS path, doc_id, arr, unnest(generate_series(1, len(arr))) AS i
      FROM (SELECT file_path, doc_id, {lines} AS arr FROM files WHERE {pdf} AND doc_id % 13 <> 0))""",
        "concat_elements": f + f"SELECT file_path AS path, {joined} AS text FROM files "
                               f"WHERE {pdf} AND doc_id % 13 <> 0 AND doc_id % 17 <> 0",
        "concat_text": f + f"SELECT file_path AS path, {joined} AS text FROM files "
                           f"WHERE {pdf} AND doc_id % 13 <> 0 AND doc_id % 17 <> 0",
        "attach_raw": f + f"SELECT file_path AS path, {joined} AS text, {version} AS version FROM files "
                          f"WHERE {pdf} AND doc_id % 13 <> 0 AND doc_id % 17 <> 0",
        "union_outcomes": f + f"""SELECT file_path AS path, {outcome} AS outcome,
  CASE WHEN NOT ({pdf}) THEN text WHEN doc_id % 13 = 0 THEN NULL ELSE {joined} END AS text,
  CASE WHEN {pdf} AND doc_id % 13 = 0 THEN 'PARSE_FAILED' END AS error_status
FROM files WHERE {outcome} <> 'vanished'""",
        "coverage_report": f + f"SELECT {outcome} AS outcome, count(*) AS n_files FROM files GROUP BY 1",
        "parse_binary": f + f"""SELECT file_path AS path, {line_bytes} AS text,
  CASE WHEN strlen(text) % 5 = 0 THEN 'PARSE_FAILED: ValueError' END AS error_status FROM files WHERE {pdf}""",
        "parse_html": f"""SELECT 'page_' || CAST(page_id AS VARCHAR) AS path, CAST(len(bl) AS BIGINT) AS n_blocks,
  CASE WHEN len(bl) > 0 THEN array_to_string(bl, chr(10) || chr(10)) END AS text
FROM (SELECT page_id, {blocks} AS bl FROM pages)""",
    }

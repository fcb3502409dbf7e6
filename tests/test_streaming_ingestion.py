import json
import os

from pyspark.sql import functions as F

from conftest import SF0001
from papyra.operators import documents as doc
from papyra.operators import registry as reg
from papyra.plans.ingestion import IngestRun, IngestConfig
from papyra.schemas import CONTRACT_TRACK
from papyra.streaming.ingest import stream_extract, stream_register


def _write_docs(spark, landing, ids):
    rows = spark.read.parquet(f"{SF0001}/documents.parquet").filter(F.col("doc_id").isin(ids)).collect()
    for r in rows:
        ext = [".pdf", ".txt", ".PDF"][r.doc_id % 3]
        with open(os.path.join(landing, f"doc_{r.doc_id}{ext}"), "w", encoding="utf-8") as f:
            f.write(r.text)
    return len(rows)


def test_two_stream_runs_equal_one_batch(spark, scratch):
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    n1 = _write_docs(spark, landing, list(range(0, 20)))
    p = IngestRun(spark, IngestConfig(base=os.path.join(scratch, "tables")))
    ck = os.path.join(scratch, "ckpt")
    stream_register(spark, p, landing, ck, max_files_per_trigger=7)
    n2 = _write_docs(spark, landing, list(range(20, 40)))
    stream_register(spark, p, landing, ck)
    got = p.registry.read()
    # batch equivalent: B1 of the whole directory against an empty registry
    from papyra.sources.files import file_inventory
    batch = reg.register_new_files(file_inventory(spark, landing), spark.createDataFrame([], CONTRACT_TRACK))
    assert sorted(r.file_name for r in got.collect()) == sorted(r.file_name for r in batch.collect())
    assert got.count() <= n1 + n2


def test_ingestion_is_idempotent(spark, scratch):
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    _write_docs(spark, landing, list(range(0, 30)))
    model = lambda prompts: ['{"tipo_contrato": "Locação", "valor_total": "10"}' for _ in prompts]
    cfg = IngestConfig(base=os.path.join(scratch, "tables"), summary_model=lambda ps: ["resumo" for _ in ps],
                         extract_model=model)
    p = IngestRun(spark, cfg)
    stream_extract(spark, p, landing, os.path.join(scratch, "ckpt"))
    parsed1, extract1 = p.parsed().count(), p.extracted().count()
    files = spark.read.format("binaryFile").load(landing).select("path", "content")
    p.process(files)  # second run over the same files adds nothing
    assert (p.parsed().count(), p.extracted().count()) == (parsed1, extract1)
    reg_rows = p.registry.read().collect()
    assert reg_rows and all(r.processed == "S" for r in reg_rows)
    ex = p.extracted().collect()
    summed = {r.path for r in p.parsed().filter("summarize IS NOT NULL").collect()}
    assert summed and len(ex) == parsed1        # one extract row a document, empty where there was no summary
    assert all((r.tipo_contrato, r.valor_total) == (("Locação", 10.0) if r.path in summed else (None, None)) for r in ex)


def test_model_sees_each_distinct_prompt_once(spark, scratch):
    import uuid
    landing = os.path.join(scratch, "landing")
    calls = os.path.join(scratch, "calls")
    os.makedirs(landing)
    os.makedirs(calls)
    for i in range(4):  # four copies of one document
        with open(os.path.join(landing, f"c{i}.pdf"), "w") as f:
            f.write("mesmo texto\nsegunda linha")

    def model(prompts):
        for p in prompts:
            with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
                f.write(p)
        return ['{"tipo_contrato": "Locação"}' for _ in prompts]

    cfg = IngestConfig(base=os.path.join(scratch, "tables"), summary_model=lambda ps: ["resumo" for _ in ps],
                         extract_model=model)
    p = IngestRun(spark, cfg)
    files = spark.read.format("binaryFile").load(landing).select("path", "content")
    from papyra.sources.files import file_inventory
    p.register(file_inventory(spark, landing))
    p.process(files)
    assert p.extracted().count() == 4
    assert len(os.listdir(calls)) == 1


def test_parser_runs_once_per_file(spark, scratch):
    import uuid
    from papyra.operators.documents import pandas_parser
    landing = os.path.join(scratch, "landing")
    calls = os.path.join(scratch, "calls")
    os.makedirs(landing)
    os.makedirs(calls)
    for i in range(5):
        with open(os.path.join(landing, f"f{i}.pdf"), "w") as f:
            f.write(f"linha {i}\noutra")
    with open(os.path.join(landing, "nota.txt"), "w") as f:
        f.write("texto simples")

    def parse(b: bytes) -> dict:
        with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
            f.write("x")
        return {"metadata": {"version": "2.0"},
                "document": {"elements": [{"content": x} for x in b.decode().split("\n")]}}

    p = IngestRun(spark, IngestConfig(base=os.path.join(scratch, "tables"), parser=pandas_parser(parse),
                                       summary_model=lambda ps: ["resumo" for _ in ps]))
    from papyra.sources.files import file_inventory
    p.register(file_inventory(spark, landing))
    p.process(spark.read.format("binaryFile").load(landing).select("path", "content"))
    assert len(os.listdir(calls)) == 5  # text/raw/error branches and the summary reuse one parse
    rows = {os.path.basename(r.path): r for r in p.parsed().collect()}
    assert rows["f3.pdf"].text == "linha 3\n\noutra" and rows["f3.pdf"].summarize == "resumo"
    assert rows["nota.txt"].text == "texto simples" and rows["nota.txt"].raw_parsed is None


def test_failed_model_calls_are_retried_next_run(spark, scratch):
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    for i in range(4):
        with open(os.path.join(landing, f"k{i}.pdf"), "w") as f:
            f.write(f"contrato {i}")

    def summary(prompts):
        import re
        return ["doc " + re.search(r"contrato (\d+)", p).group(1) for p in prompts]

    flag = os.path.join(scratch, "fail.flag")
    open(flag, "w").close()

    def model(prompts):
        out = []
        for p in prompts:
            if os.path.exists(flag) and p.endswith("doc 2"):
                raise RuntimeError("endpoint down")
            out.append('{"tipo_contrato": "X"}')
        return out

    cfg = IngestConfig(base=os.path.join(scratch, "tables"), summary_model=summary, extract_model=model)
    run = IngestRun(spark, cfg)
    from papyra.sources.files import file_inventory
    run.register(file_inventory(spark, landing))
    files = spark.read.format("binaryFile").load(landing).select("path", "content")
    run.process(files)
    assert run.extracted().count() == 3 and run.retry.read().count() == 1
    os.remove(flag)
    run.process(files)  # nothing new is pending; only the failed document is retried
    assert run.extracted().count() == 4 and run.retry.read().count() == 0


def test_failed_parse_is_marked_processed_and_reported(spark, scratch):
    from papyra.operators.documents import coverage_report, pandas_parser
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    for n, body in {"ok.pdf": "bom", "bad.pdf": "ruim"}.items():
        with open(os.path.join(landing, n), "w") as f:
            f.write(body)

    def parse(b: bytes) -> dict:
        if b == b"ruim":
            raise ValueError("unreadable")
        return {"metadata": {"version": "2.0"}, "document": {"elements": [{"content": b.decode()}]}}

    cfg = IngestConfig(base=os.path.join(scratch, "tables"), parser=pandas_parser(parse),
                       summary_model=lambda ps: [p[-3:] for p in ps], summary_source="text")
    run = IngestRun(spark, cfg)
    from papyra.sources.files import file_inventory
    run.register(file_inventory(spark, landing))
    files = spark.read.format("binaryFile").load(landing).select("path", "content")
    run.process(files)
    reg_rows = {os.path.basename(r.file_path): r.processed for r in run.registry.read().collect()}
    assert reg_rows == {"ok.pdf": "S", "bad.pdf": "S"}  # the flag is set even for the failed parse
    parsed = {os.path.basename(r.path): r for r in run.parsed().collect()}
    assert parsed["bad.pdf"].error_status.startswith("PARSE_FAILED") and parsed["ok.pdf"].summarize == "bom"
    rep = {r.outcome: r.n_files for r in coverage_report(files, run.parsed()).collect()}
    assert rep == {"ok": 1, "error": 1}


def test_registry_change_log(spark, scratch):
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    _write_docs(spark, landing, list(range(0, 12)))
    run = IngestRun(spark, IngestConfig(base=os.path.join(scratch, "tables")))
    from papyra.sources.files import file_inventory
    run.register(file_inventory(spark, landing))
    run.process(spark.read.format("binaryFile").load(landing).select("path", "content"))
    ch = run.changes()
    counts = {r._change_type: r["count"] for r in ch.groupBy("_change_type").count().collect()}
    n = run.registry.read().count()
    assert counts == {"insert": n, "update_preimage": n, "update_postimage": n}
    post = ch.filter("_change_type = 'update_postimage'").select("processed").distinct().collect()
    assert [r.processed for r in post] == ["S"]
    # the snapshot-diff operator gives the same updates
    from papyra.streaming.changes import change_feed
    before = ch.filter("_change_type = 'insert'").select(*run.registry.read().columns)
    diff = change_feed(before, run.registry.read(), "file_path", ["processed", "processed_time"])
    assert diff.filter("change_type = 'update_postimage'").count() == n


def test_latest_kv_stream_over_many_micro_batches(spark, scratch):
    from papyra.operators.events import latest_kv
    from papyra.streaming.changes import stream_latest_kv
    events = spark.read.parquet(f"{SF0001}/events.parquet")
    src = os.path.join(scratch, "events")
    events.repartition(5).write.parquet(src)  # five files, one per trigger
    got = stream_latest_kv(spark, src, events.schema, ["user_id", "event_type"], "value", ["ts", "event_id"],
                           os.path.join(scratch, "state"), os.path.join(scratch, "ckpt"),
                           max_files_per_trigger=1, compact_every=2)
    want = latest_kv(events, ["user_id", "event_type"])
    assert sorted(got.collect()) == sorted(want.collect())


def test_cli_ingest_and_serve(spark, scratch, capsys):
    from papyra import cli
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(os.path.abspath(__file__)), "cli_models.py"))
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    _write_docs(spark, landing, list(range(0, 9)))
    base = os.path.join(scratch, "tables")
    cli.main(["ingest", "--landing", landing, "--base", base, "--summary-model",
              "cli_models:summary_stub", "--extract-model", "cli_models:extract_stub"],
             spark)
    out = capsys.readouterr().out.strip().splitlines()
    assert json.loads(out[-1]) == {"registered": 9, "pending": 0}
    cli.main(["listing", "--base", base, "--rows", "4"], spark)
    lines = capsys.readouterr().out.strip().splitlines()
    assert len(lines) == 5 and json.loads(lines[-1])["label"] == "1-4 of 9"
    cli.main(["details", "--base", base, "--lookup", "doc_3"], spark)
    rows = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert rows and all(r["valor_total"] == "12.50" and r["pdf"] == "doc_3.pdf" for r in rows)
    cli.main(["context", "--base", base], spark)
    assert json.loads(capsys.readouterr().out.strip())["context"].startswith("resumo do contrato")


def test_run_that_stopped_before_marking_is_completed_next_time(spark, scratch):
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    _write_docs(spark, landing, list(range(0, 6)))
    cfg = IngestConfig(base=os.path.join(scratch, "tables"), summary_model=lambda ps: ["resumo" for _ in ps],
                       extract_model=lambda ps: ['{"tipo_contrato": "X"}' for _ in ps])
    run = IngestRun(spark, cfg)
    from papyra.sources.files import file_inventory
    run.register(file_inventory(spark, landing))
    files = spark.read.format("binaryFile").load(landing).select("path", "content")
    # Simulate a run that appended its parse output and then died: parse only, no extraction or marking.
    from papyra.operators import documents as doc
    doc.process_batch(files, doc.text_parser).write.mode("append").parquet(run.parsed_path)
    assert run.registry.read().filter("processed = 'N'").count() == 6
    run.process(files)
    assert run.registry.read().filter("processed = 'N'").count() == 0
    assert run.parsed().count() == 6  # nothing parsed twice
    # The stopped run left no summaries: one extract row a document all the same, its fields empty.
    assert run.extracted().count() == 6 and run.extracted().filter("tipo_contrato IS NOT NULL").count() == 0


def test_failed_summaries_and_vanished_documents_are_not_lost(spark, scratch):
    from papyra.sources.files import file_inventory
    landing, healed = os.path.join(scratch, "landing"), os.path.join(scratch, "healed")
    os.makedirs(landing)
    _write_docs(spark, landing, list(range(0, 8)))

    def flaky(prompts):
        if not os.path.exists(healed) and any("TEXT: " in p and len(p) % 2 for p in prompts):
            raise RuntimeError("model is away")
        return ["resumo" for _ in prompts]
    cfg = IngestConfig(base=os.path.join(scratch, "tables"), summary_model=flaky,
                       extract_model=lambda ps: ['{"tipo_contrato": "X"}' for _ in ps])
    run = IngestRun(spark, cfg)
    run.register(file_inventory(spark, landing))
    files = spark.read.format("binaryFile").load(landing).select("path", "content")
    run.process(files)
    pending = {r.file_path for r in run.registry.read().filter("processed = 'N'").collect()}
    parsed = {r.path for r in run.parsed().collect()}
    assert not pending & parsed and len(pending | parsed) == 8
    open(healed, "w").close()
    run.process(files)
    assert run.registry.read().filter("processed = 'N'").count() == 0
    rows = run.extracted().collect()
    assert len(rows) == len({r.path for r in rows}) == 8
    done = {r.path: r for r in run.parsed().collect()}
    assert len(done) == 8
    for r in rows:
        assert (r.tipo_contrato == "X") == (done[r.path].summarize is not None)


def test_documents_without_content_get_an_outcome(spark, scratch):
    from papyra.plans.ingestion import EMPTY_PARSE
    from papyra.sources.files import file_inventory
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    _write_docs(spark, landing, list(range(0, 5)))
    run = IngestRun(spark, IngestConfig(base=os.path.join(scratch, "tables"),
                                        parser=lambda df: doc.text_parser(df).filter(F.lit(False))))
    run.register(file_inventory(spark, landing))
    run.process(spark.read.format("binaryFile").load(landing).select("path", "content"))
    assert run.registry.read().filter("processed = 'N'").count() == 0
    lost = run.parsed().filter(F.col("error_status") == EMPTY_PARSE)
    assert lost.count() == run.registry.read().filter("type = 'pdf'").count()


def _counted(scratch):
    """An opener that leaves a mark for each open."""
    import uuid
    marks = os.path.join(scratch, "opens")
    os.makedirs(marks)

    def opener(path):
        with open(os.path.join(marks, uuid.uuid4().hex), "w") as f:
            f.write(os.path.basename(path))
        with open(path.split(":", 1)[-1], "rb") as f:
            return f.read()

    def opened():
        from collections import Counter
        names = Counter(open(os.path.join(marks, m)).read() for m in os.listdir(marks))
        for m in os.listdir(marks):
            os.remove(os.path.join(marks, m))
        return names
    return opener, opened


def _land(landing, files):
    os.makedirs(landing, exist_ok=True)
    for n, text in files.items():
        with open(os.path.join(landing, n), "w", encoding="utf-8") as f:
            f.write(text)


def test_each_new_file_is_opened_once_and_known_files_never(spark, scratch):
    from papyra.sources.files import list_files
    landing = os.path.join(scratch, "landing")
    opener, opened = _counted(scratch)
    cfg = IngestConfig(base=os.path.join(scratch, "t"), opener=opener, summary_model=lambda ps: ["resumo" for _ in ps],
                       extract_model=lambda ps: ['{"tipo_contrato": "X"}' for _ in ps])
    _land(landing, {"a.pdf": "um", "b.txt": "dois", "c.pdf": "três\nquatro"})
    IngestRun(spark, cfg).ingest(list_files(spark, landing))
    assert opened() == {"a.pdf": 1, "b.txt": 1, "c.pdf": 1}
    _land(landing, {"d.pdf": "cinco"})
    run = IngestRun(spark, cfg)
    run.ingest(list_files(spark, landing))
    assert opened() == {"d.pdf": 1}
    run.ingest(list_files(spark, landing))
    assert not opened() and run.extracted().count() == 4
    # A parser that returns (path, parsed) alone, and one that drops a file, read each file once or once more.
    plain = lambda df: doc.text_parser(df.select("path", "content"))
    other = IngestRun(spark, IngestConfig(base=os.path.join(scratch, "u"), opener=opener, parser=plain))
    other.ingest(list_files(spark, landing))
    assert opened() == {"a.pdf": 1, "b.txt": 1, "c.pdf": 1, "d.pdf": 1} and other.parsed().count() == 4


def test_stream_opens_each_new_file_once(spark, scratch):
    landing = os.path.join(scratch, "landing")
    opener, opened = _counted(scratch)
    run = IngestRun(spark, IngestConfig(base=os.path.join(scratch, "t"), opener=opener))
    _land(landing, {f"f{i}.pdf": f"texto {i}" for i in range(5)})
    stream_extract(spark, run, landing, os.path.join(scratch, "ck"), max_files_per_trigger=2)
    _land(landing, {"g.pdf": "mais"})
    stream_extract(spark, run, landing, os.path.join(scratch, "ck"), max_files_per_trigger=2)
    assert opened() == {**{f"f{i}.pdf": 1 for i in range(5)}, "g.pdf": 1}
    assert run.registry.read().filter("processed = 'S'").count() == 6
    other = IngestRun(spark, IngestConfig(base=os.path.join(scratch, "u"), opener=opener))
    stream_register(spark, other, landing, os.path.join(scratch, "ck2"))
    assert sum(opened().values()) == 6 and other.registry.read().count() == 6


def _version_models():
    return dict(summary_model=lambda ps: ["resumo " + p[-2:] for p in ps], summary_source="text",
                extract_model=lambda ps: ['{"tipo_contrato": "' + p[-2:] + '"}' for p in ps])


def test_changed_file_is_a_new_identity(spark, scratch):
    """Re-uploads admitted: the new content is parsed, summarised and extracted; the old rows stay as they were."""
    from papyra.sources.files import list_files
    landing = os.path.join(scratch, "landing")
    cfg = IngestConfig(base=os.path.join(scratch, "t"), admit_match="hash", **_version_models())
    _land(landing, {"a.pdf": "texto v1", "b.pdf": "outro v1"})
    run = IngestRun(spark, cfg)
    run.ingest(list_files(spark, landing))
    _land(landing, {"a.pdf": "texto longo v2"})
    run.ingest(list_files(spark, landing))
    run.ingest(list_files(spark, landing))
    regs = [(os.path.basename(r.file_path), r.processed) for r in run.registry.read().collect()]
    assert sorted(regs) == [("a.pdf", "S"), ("a.pdf", "S"), ("b.pdf", "S")]
    assert sorted(r.text for r in run.parsed().collect()) == ["outro v1", "texto longo v2", "texto v1"]
    assert sorted(r.tipo_contrato for r in run.extracted().collect()) == ["v1", "v1", "v2"]
    assert sorted(r.tipo_contrato for r in run.current(run.extracted()).collect()) == ["v1", "v2"]
    assert {(os.path.basename(r.path), r.text) for r in run.current(run.parsed()).collect()} == {
        ("a.pdf", "texto longo v2"), ("b.pdf", "outro v1")}
    # The same through process(), which takes the bytes: v3 is registered first, then handed over.
    from papyra.sources.files import file_inventory
    _land(landing, {"b.pdf": "outro mais longo v3"})
    run.register(file_inventory(spark, landing))
    run.process(spark.read.format("binaryFile").load(landing).select("path", "content"))
    assert {r.text for r in run.current(run.parsed()).collect()} == {"texto longo v2", "outro mais longo v3"}


def test_failed_summary_is_retried_from_the_stored_parse(spark, scratch):
    from papyra.sources.files import list_files
    landing, healed = os.path.join(scratch, "landing"), os.path.join(scratch, "healed")
    opener, opened = _counted(scratch)

    def summary(ps):
        if not os.path.exists(healed) and any(p.endswith("b") for p in ps):
            raise RuntimeError("away")
        return ["resumo" for _ in ps]
    cfg = IngestConfig(base=os.path.join(scratch, "t"), opener=opener, summary_model=summary, summary_source="text",
                       extract_model=lambda ps: ['{"tipo_contrato": "X"}' if "resumo" in p else "nada" for p in ps])
    _land(landing, {"a.pdf": "texto a", "b.pdf": "texto b", "c.txt": "texto c"})
    run = IngestRun(spark, cfg)
    run.ingest(list_files(spark, landing))
    assert sum(opened().values()) == 3
    assert [os.path.basename(r.file_path) for r in run.registry.open().collect()] == ["b.pdf"]
    assert not os.path.exists(os.path.join(scratch, "t", "_staging"))
    open(healed, "w").close()
    run.ingest(list_files(spark, landing))
    assert not opened() and run.registry.open().count() == 0 and run.parsed().count() == 3
    got = {os.path.basename(r.path): (r.extract_status, r.tipo_contrato) for r in run.extracted().collect()}
    assert got == {"a.pdf": ("ok", "X"), "b.pdf": ("ok", "X"), "c.txt": ("no_summary", None)}


def test_a_stop_between_any_two_steps_is_repaired(spark, scratch, monkeypatch):
    """The run is stopped after its k-th write to the shared tables, for every k; the next run completes it."""
    from pyspark.sql import DataFrameWriter
    from papyra.sources.files import list_files
    landing = os.path.join(scratch, "landing")
    _land(landing, {"a.pdf": "texto v1", "b.txt": "outro v1"})
    real = DataFrameWriter.parquet

    class Stop(Exception):
        pass
    want = None
    for k in range(0, 14):
        cfg = IngestConfig(base=os.path.join(scratch, f"t{k}"), partitions=1, **_version_models())
        left = [k]

        def parquet(self, path, *a, **kw):
            if "_staging" not in path and k:
                left[0] -= 1
                if left[0] < 0:
                    raise Stop
            return real(self, path, *a, **kw)
        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
        stopped = False
        try:
            IngestRun(spark, cfg).ingest(list_files(spark, landing))
        except Stop:
            stopped = True
        monkeypatch.setattr(DataFrameWriter, "parquet", real)
        run = IngestRun(spark, cfg)
        run.ingest(list_files(spark, landing))
        got = (sorted((os.path.basename(r.file_path), r.processed) for r in run.registry.read().collect()),
               sorted((os.path.basename(r.path), r.text, r.summarize) for r in run.parsed().collect()),
               sorted((os.path.basename(r.path), r.tipo_contrato or "", r.extract_status) for r in run.extracted().collect()))
        want = want or got
        assert got == want and len(got[2]) == 2 and all(p == "S" for _, p in got[0]), k
        if k and not stopped:
            break
    else:
        raise AssertionError("the run has more writes than were tried")


def test_answer_cache_is_read_by_prefix(spark, scratch):
    from papyra.functions.model import prompt_key
    run = IngestRun(spark, IngestConfig(base=os.path.join(scratch, "t")))
    rows = spark.range(2000).selectExpr("concat('p', id) AS p").select(prompt_key(F.col("p")).alias("prompt_key"), F.lit("r").alias("response"))
    rows.withColumn("prefix", F.substring("prompt_key", 1, 2)).repartition("prefix").write.partitionBy("prefix").parquet(run.cache_path)
    few = spark.createDataFrame([("p1",), ("p2",), ("new",)], "p string").select(prompt_key(F.col("p")).alias("prompt_key"))
    cached = run._cached(few)
    plan = cached._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan
    assert {r.k for r in cached.select(F.substring("prompt_key", 1, 2).alias("k")).distinct().collect()} <= {
        r.k for r in few.select(F.substring("prompt_key", 1, 2).alias("k")).collect()}
    assert cached.join(few, "prompt_key").count() == 2


def test_latest_kv_stream_with_late_updates_deletes_and_a_restart(spark, scratch):
    from pyspark.sql import types as T
    from papyra.streaming.changes import stream_latest_kv
    schema = T.StructType.fromDDL("k string, v string, seq int, gone boolean")
    src, out, ck = (os.path.join(scratch, n) for n in ("src", "out", "ck"))

    def write(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: stream_latest_kv(spark, src, schema, ["k"], "v", ["seq"], out, ck, max_files_per_trigger=1,
                                   deleted="gone", compact_every=2)
    write(("a", "a1", 1, False), ("b", "b5", 5, False), ("c", "c1", 1, False))
    write(("a", None, 9, True), ("b", "b2", 2, False))              # b2 is older than what is there
    assert {r.k: r.v for r in run().collect()} == {"b": "b5", "c": "c1"}
    write(("a", "a3", 3, False), ("c", "c2", 2, None))              # a3 arrives after the delete that is newer
    write(("d", "d1", 1, False), ("a", "a10", 10, False))
    assert {r.k: r.v for r in run().collect()} == {"a": "a10", "b": "b5", "c": "c2", "d": "d1"}
    # The last commit holds the keys of its micro-batch only.
    last = sorted(os.listdir(os.path.join(out, "state", "log")))[-1]
    assert {r.k for r in spark.read.parquet(os.path.join(out, "state", "log", last)).collect()} <= {"a", "c", "d"}


def test_a_run_writes_texts_once_opened_and_joins_them_to_short_lists(spark, scratch, monkeypatch):
    """no step between the opened files and the tables writes the texts; of the identities to take and to leave
    out, the shorter list is joined to them."""
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    n = _write_docs(spark, landing, list(range(0, 30)))
    run = IngestRun(spark, IngestConfig(base=os.path.join(scratch, "tables"), summary_source="text",
                                        summary_model=lambda ps: ["resumo" for _ in ps]))
    wide, staged = [], IngestRun._staged

    def noted(self, run, name, df):
        out = staged(self, run, name, df)
        wide.extend([name] if "text" in out.columns else [])
        return out
    monkeypatch.setattr(IngestRun, "_staged", noted)
    from papyra.sources.files import list_files
    run.ingest(list_files(spark, landing))
    assert wide == ["opened"]
    rows = run.parsed().select("path", "file_hash", "text", "error_status", "summarize", "raw_parsed").collect()
    assert len(rows) == run.registry.read().count() <= n
    assert all((r.summarize == "resumo") == (r.raw_parsed is not None and r.error_status is None) for r in rows)

    table = spark.createDataFrame([(f"p{i % 9}", None if i % 9 == 8 else f"h{i % 9}", str(i)) for i in range(27)],
                                  "path string, file_hash string, text string")
    for take, how in ((range(8), "LeftAnti"), (range(2), "LeftSemi"), ((), "LeftSemi")):
        keys = spark.createDataFrame([(f"p{i}", f"h{i}") for i in take], "_p string, _h string")
        got = run._of_identity("run-x", f"some-{len(take)}", table, keys)
        assert sorted(int(r.text) for r in got.collect()) == [i for i in range(27) if i % 9 in take]
        assert how in got._jdf.queryExecution().optimizedPlan().toString()
    by_path = spark.createDataFrame([("p8", None), ("p1", None)], "_p string, _h string")     # stored without hashes
    got = run._of_identity("run-x", "by-path", table, by_path)
    assert sorted(int(r.text) for r in got.collect()) == [i for i in range(27) if i % 9 in (1, 8)]


def test_stream_looks_up_its_files_in_few_tasks(spark, scratch):
    landing, key = os.path.join(scratch, "landing"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    os.makedirs(landing)
    n = _write_docs(spark, landing, list(range(0, 40)))
    p = IngestRun(spark, IngestConfig(base=os.path.join(scratch, "tables")))
    seen, unseen, before = [], p.unseen, spark.conf.get(key)
    p.unseen = lambda batch: seen.append(int(spark.conf.get(key))) or unseen(batch)
    spark.conf.set(key, "10000")
    try:
        stream_register(spark, p, landing, os.path.join(scratch, "ckpt"))
        assert spark.conf.get(key) == "10000"
    finally:
        spark.conf.set(key, before)
    assert seen and max(seen) <= max(16, 2 * spark.sparkContext.defaultParallelism)
    assert p.registry.read().select("file_path").distinct().count() <= n


def _arriving(spark, scratch, start):
    """Runs a stream three times while files land; (names of each micro-batch, files that a micro-batch reads)."""
    landing = os.path.join(scratch, "landing")
    _land(landing, {f"f{i}.pdf": f"texto {i}" for i in range(7)} | {"_no.pdf": "x", ".no.pdf": "x", "no.csv": "x", "no.pdf": ""})
    for i in range(7):
        os.utime(os.path.join(landing, f"f{i}.pdf"), (1_700_000_000 - i, 1_700_000_000 - i))
    run = IngestRun(spark, IngestConfig(base=os.path.join(scratch, "t")))
    names, read, unseen = [], set(), run.unseen

    def seen(batch):
        names.append(sorted(os.path.basename(r.path) for r in batch.collect()))
        read.update(r.f for r in batch.select(F.input_file_name().alias("f")).collect())
        return unseen(batch)
    run.unseen = seen
    for late, most in (({}, 3), ({"g.pdf": "mais"}, None), ({}, 3)):
        _land(landing, late)
        start(spark, run, landing, os.path.join(scratch, "ck"), max_files_per_trigger=most, glob="*.{pdf,PDF}")
    assert run.registry.read().count() == 8
    return names, read


_BATCHES = [["f4.pdf", "f5.pdf", "f6.pdf"], ["f1.pdf", "f2.pdf", "f3.pdf"], ["f0.pdf"], ["g.pdf"]]      # oldest first


def test_registering_stream_holds_no_landed_file_in_the_driver(spark, scratch):
    names, read = _arriving(spark, scratch, stream_register)
    assert names == _BATCHES
    assert len(read) == 4 and all("/ck/arrivals/" in x for x in read)       # a file of names each, none that landed


def test_extracting_stream_holds_no_landed_file_in_the_driver(spark, scratch):
    names, read = _arriving(spark, scratch, stream_extract)
    assert names == _BATCHES
    assert len(read) == 4 and all("/ck/arrivals/" in x for x in read)
    assert IngestRun(spark, IngestConfig(base=os.path.join(scratch, "t"))).registry.read().filter("processed = 'S'").count() == 8

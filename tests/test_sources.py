import os

import pyarrow as pa
from pyspark.sql import functions as F

from papyra.schemas import CONTRACT_PARSED, CONTRACT_TRACK
from papyra.sources.files import fetch_content
from papyra.sources.tables import SnapshotTable, append_sink, ensure_table


def test_ensure_table_and_append_by_name(spark, scratch):
    name = "track_" + os.path.basename(scratch).replace("-", "_")
    ensure_table(spark, name, CONTRACT_TRACK, location=os.path.join(scratch, "t"),
                 properties={"papyra.change_feed": "true"})
    ensure_table(spark, name, CONTRACT_TRACK)  # idempotent
    row = spark.createDataFrame([("a.pdf", "pdf", 1, "N", "/v/a.pdf", None, None, "h")], CONTRACT_TRACK)
    append_sink(row.select(list(reversed(row.columns))), name)  # by name, not by position
    got = spark.table(name).first()
    assert got.file_name == "a.pdf" and got.file_hash == "h"
    props = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    assert props.get("papyra.change_feed") == "true"


def test_variant_round_trips_through_parquet(spark, scratch):
    df = spark.createDataFrame([("p", '{"a": 1}', "t", None, None)],
                               "path string, j string, text string, summarize string, error_status string")
    df = df.select("path", F.parse_json("j").alias("raw_parsed"), "text", "summarize", "error_status")
    out = os.path.join(scratch, "parsed")
    append_sink(df, out, CONTRACT_PARSED)
    back = spark.read.parquet(out)
    assert back.select(F.try_variant_get("raw_parsed", "$.a", "int").alias("a")).first().a == 1


def test_snapshot_table_versions(spark, scratch):
    t = SnapshotTable(spark, os.path.join(scratch, "snap"))
    assert t.read(CONTRACT_TRACK).count() == 0
    t.write(spark.createDataFrame([("a",)], "x string"))
    t.write(spark.createDataFrame([("a",), ("b",)], "x string"))
    assert t.versions() == [1, 2] and t.read().count() == 2


def test_fetch_content_returns_first_match_bytes(spark, scratch):
    root = os.path.join(scratch, "files")
    os.makedirs(os.path.join(root, "x"))
    for n, b in {"x/contrato_1.pdf": b"one", "x/contrato_10.pdf": b"ten", "x/outro.pdf": b"o"}.items():
        with open(os.path.join(root, n), "wb") as f:
            f.write(b)
    contracts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    got = fetch_content(spark, contracts, "contrato_1", root).collect()
    assert len(got) == 1 and got[0].path.endswith("contrato_1.pdf") and bytes(got[0].content) == b"one"
    assert fetch_content(spark, contracts, "nada", root).count() == 0


def _status_log(spark, scratch, **kw):
    from pyspark.sql import types as T
    from papyra.sources.status_log import StatusLog
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("s", T.StringType())])
    return StatusLog(spark, os.path.join(scratch, "log"), ["k"], schema, "s = 'N'", **kw)


def test_status_log_keeps_the_latest_row_and_the_history(spark, scratch):
    log = _status_log(spark, scratch, compact_every=0)
    assert log.read().count() == 0 and log.open().count() == 0
    rows = lambda *x: spark.createDataFrame(x, log.schema)
    log.append(rows(("a", "N"), ("b", "N"), (None, "N")))
    log.append(rows(("a", "S")))
    log.append(rows(("c", "N")))
    assert {r.k: r.s for r in log.read().collect()} == {"a": "S", "b": "N", "c": "N", None: "N"}
    assert {r.k for r in log.open().collect()} == {"b", "c", None}
    ch = {(r.k, r.s, r._change_type, r._commit_version) for r in log.changes().collect()}
    assert ch == {("a", "N", "insert", 1), ("b", "N", "insert", 1), (None, "N", "insert", 1), ("a", "N", "update_preimage", 2),
                  ("a", "S", "update_postimage", 2), ("c", "N", "insert", 3)}


def test_status_log_compaction_changes_nothing_but_what_is_read(spark, scratch):
    log = _status_log(spark, scratch, compact_every=3)
    rows = lambda *x: spark.createDataFrame(x, log.schema)
    for i in range(8):
        log.append(rows((f"k{i}", "N"), (f"k{i - 1}", "S")))
    snapshot, tail = log._parts()
    assert snapshot == 6 and tail == [7, 8]
    assert {r.k for r in log.open().collect()} == {"k7"}
    assert {r.k: r.s for r in log.read().collect()} == {"k7": "N", **{f"k{i}": "S" for i in range(-1, 7)}}
    # Settled rows of the snapshot are not read to find open work.
    assert not any("settled" in f for f in log.rows(only_open=True).inputFiles())
    assert log.changes().filter("_change_type = 'insert'").count() == 9


def test_status_log_ignores_a_commit_that_stopped_half_way(spark, scratch):
    log = _status_log(spark, scratch, compact_every=0)
    rows = lambda *x: spark.createDataFrame(x, log.schema)
    log.append(rows(("a", "N")))
    log.append(rows(("a", "S")))
    os.remove(os.path.join(scratch, "log", "log", f"{2:012d}", "_SUCCESS"))      # the job ended before its commit
    assert log.read().collect()[0].s == "N"
    assert log.append(rows(("b", "N"))) == 2                                     # its number is written anew
    assert {r.k: r.s for r in log.read().collect()} == {"a": "N", "b": "N"}
    # The same for a snapshot without its last folder's marker.
    log.compact()
    os.remove(os.path.join(scratch, "log", "snapshot", f"{2:012d}", "open", "_SUCCESS"))
    assert log._parts() == (0, [1, 2]) and log.read().count() == 2


def test_listing_shows_every_name_and_resolves_paths(spark, scratch):
    from papyra.sources.files import file_inventory, list_files
    os.makedirs(os.path.join(scratch, "in", "sub"))
    for n in ("a.pdf", "_b.PDF", ".c", "d d%20.txt"):
        with open(os.path.join(scratch, "in", n), "wb") as f:
            f.write(n.encode())
    with open(os.path.join(scratch, "in", "sub", "deep.pdf"), "wb") as f:
        f.write(b"x")
    dotted = os.path.join(scratch, "in", "sub", "..", ".", "")
    for folder in (os.path.join(scratch, "in"), dotted, "file:" + dotted):
        got = {r.file_name: r for r in file_inventory(spark, folder).collect()}
        assert set(got) == {"a.pdf", "_b.PDF", "d d%20.txt"}
        assert got["_b.PDF"].type == "pdf" and got["a.pdf"].size == 5
        assert got["a.pdf"].file_path == f"file:{os.path.join(scratch, 'in', 'a.pdf')}"
    assert list_files(spark, os.path.join(scratch, "in"), recursive=True).count() == 4


def test_fetch_content_stays_inside_its_folder(spark, scratch):
    from papyra.sources.files import inside
    assert inside("file:/root/x/a.pdf", "/root/x") and inside("file:///root/x/a", "file:/root/x/")
    assert not inside("/root/x/../secret.txt", "/root/x") and not inside("/root/xy/a", "/root/x")
    assert not inside("/other/root/x/a", "/root/x")
    root = os.path.join(scratch, "files")
    os.makedirs(root)
    with open(os.path.join(scratch, "secret.txt"), "wb") as f:
        f.write(b"no")
    rows = spark.createDataFrame([(f"{root}/../secret.txt",)], "path string")
    assert fetch_content(spark, rows, "secret", root).count() == 0


def test_binary_scan_reports_what_it_skips(spark, scratch):
    from papyra.sources.files import binary_scan
    for n, size in (("s.bin", 10), ("l.bin", 10_000)):
        with open(os.path.join(scratch, n), "wb") as f:
            f.write(b"x" * size)
    got = {os.path.basename(r.path): r for r in binary_scan(spark, scratch, max_bytes=100, report_skipped=True).collect()}
    assert got["s.bin"].scan_status == "ok" and len(got["s.bin"].content) == 10
    assert got["l.bin"].scan_status == "too_large" and got["l.bin"].content is None


def test_large_folder_is_scanned_without_a_file_list_in_the_driver(spark, scratch, monkeypatch):
    from papyra.sources import files
    scratch = os.path.join(scratch, "in")
    for n in ("a.bin", "b.bin", "c d%20.bin", "_no.bin", ".no.bin", "x.txt", "e.bin", "sub/deep.bin", "_sub/no.bin", "../keys/k=1/in.bin", "../keys/k=2/in.bin"):
        os.makedirs(os.path.dirname(os.path.join(scratch, n)), exist_ok=True)
        with open(os.path.join(scratch, n), "wb") as f:
            f.write(n.encode() * (0 if n == "e.bin" else 50 if n == "b.bin" else 1))

    def rows(path=scratch, **kw):
        df = files.binary_scan(spark, path, **kw)
        cols = [c for c in df.columns if c != "k"]              # the key column of Spark's source
        return cols, sorted(map(tuple, df.select(cols).collect())), df._jdf.queryExecution().executedPlan().toString()
    for kw in ({}, {"max_bytes": 20}, {"max_bytes": 20, "report_skipped": True}, {"report_skipped": True},
               {"path_glob": "{a,c}*.b?n"}, {"path": os.path.join(scratch, "..", "keys")}, {"recursive": True},
               {"recursive": True, "path_glob": "[!x]*", "max_bytes": 9}):
        monkeypatch.setattr(files, "DRIVER_FILES", 100)
        want = rows(**kw)
        monkeypatch.setattr(files, "DRIVER_FILES", 1)
        got = rows(**kw)
        assert want[1] and got[:2] == want[:2], kw
        assert "binaryFile" in want[2] and "binaryFile" not in got[2]
    assert files.binary_scan(spark, os.path.join(scratch, "a.bin")).count() == 1        # a file, a pattern: as before
    assert files.binary_scan(spark, os.path.join(scratch, "*.bin")).count() == 3
    monkeypatch.setattr(files, "BATCH_BYTES", 1)                                         # handed on one by one
    batch = pa.RecordBatch.from_pydict({"path": [f"{scratch}/a.bin", f"{scratch}/e.bin", f"{scratch}/x.txt"], "length": [5, 0, 5]})
    out = list(files._read_all(None)([batch]))
    assert [b.column("content").to_pylist() for b in out] == [[b"a.bin"], [b"", b"x.txt"]]
    assert pa.Table.from_batches(out).column("path").to_pylist() == batch.column("path").to_pylist()


def test_property_text_is_a_literal(spark, scratch):
    import pytest
    name = "props_" + os.path.basename(scratch).replace("-", "_")
    ensure_table(spark, name, CONTRACT_TRACK, location=os.path.join(scratch, "p"), properties={"note": "it's 'x' \\ y"})
    assert {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}["note"] == "it's 'x' \\ y"
    with pytest.raises(ValueError):
        ensure_table(spark, name, CONTRACT_TRACK, properties={"a' = 'b": "c"})

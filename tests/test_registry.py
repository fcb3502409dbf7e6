from datetime import datetime

from pyspark.sql import functions as F

from papyra.operators import registry as reg
from papyra.schemas import CONTRACT_TRACK, FILE_INVENTORY
from papyra.sources.tables import literal_rows

T0 = datetime(2024, 1, 1)


def _inv(spark, rows):
    return literal_rows(spark, [(n, "pdf", 1, f"/v/{n}", T0, None, h) for n, h in rows], FILE_INVENTORY)


def _reg(spark, rows):
    return literal_rows(spark, [(n, "pdf", 1, p, f"/v/{n}", T0, None, h) for n, h, p in rows], CONTRACT_TRACK)


def test_name_or_hash_seen_is_rejected_including_null_hash(spark):
    registry = _reg(spark, [("a.pdf", "h1", "S"), ("b.pdf", None, "N")])
    inv = _inv(spark, [("a.pdf", "zz"), ("c.pdf", "h1"), ("d.pdf", None), ("b.pdf", None), ("e.pdf", "h9"),
                       ("f.pdf", "h9")])
    got = sorted(r.file_name for r in reg.register_new_files(inv, registry).collect())
    # same-name and same-hash rows are out; NULL hashes never match; duplicates within a batch both enter
    assert got == ["d.pdf", "e.pdf", "f.pdf"]
    first = sorted(r.file_name for r in reg.register_new_files(inv, registry, within_batch="first").collect())
    assert first == ["d.pdf", "e.pdf"]


def test_admission_plans_as_equi_joins_not_nested_loop(spark):
    registry = _reg(spark, [("a.pdf", "h1", "S")])
    inv = _inv(spark, [("c.pdf", "h2")])
    plan = reg.register_new_files(inv, registry)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan


def test_mark_processed_uses_equality_not_like(spark):
    registry = literal_rows(spark, [
        ("a_b.pdf", "pdf", 1, "N", "/v/a_b.pdf", T0, None, "1"),
        ("axb.pdf", "pdf", 1, "N", "/v/axb.pdf", T0, None, "2"),
        ("x/a_b.pdf", "pdf", 1, "N", "/w/x/a_b.pdf", T0, None, "3"),
    ], CONTRACT_TRACK)
    done = spark.createDataFrame([("/v/a_b.pdf",)], "path string")
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    out = {r.file_path: (r.processed, r.processed_time) for r in reg.mark_processed(registry, done, now).collect()}
    assert out["/v/a_b.pdf"] == ("S", datetime(2025, 1, 1))
    assert out["/v/axb.pdf"] == ("N", None)
    assert out["/w/x/a_b.pdf"] == ("N", None)


def test_pending_and_arrival(spark):
    registry = _reg(spark, [("a.pdf", "1", "S"), ("b.pdf", "2", "N")])
    assert reg.pending_count(registry).first().pending == 1
    scan = spark.createDataFrame([("/v/a.pdf",), ("/v/b.pdf",), ("/v/z.pdf",)], "path string")
    assert [r.path for r in reg.arrival_semi(scan, registry).collect()] == ["/v/b.pdf"]


def test_latest_upload_keeps_newest_per_name(spark):
    inv = literal_rows(spark, [("a.pdf", "pdf", 1, "/v/a.pdf", T0, None, "old"),
                               ("a.pdf", "pdf", 2, "/v/a.pdf", datetime(2024, 2, 1), None, "new")], FILE_INVENTORY)
    rows = reg.latest_upload(inv).collect()
    assert len(rows) == 1 and rows[0].file_hash == "new" and rows[0].size == 2


def test_hash_only_mode_admits_reuploads(spark):
    registry = _reg(spark, [("a.pdf", "h1", "S")])
    inv = _inv(spark, [("a.pdf", "h2"), ("b.pdf", "h1"), ("c.pdf", "h3")])
    default = sorted(r.file_name for r in reg.register_new_files(inv, registry).collect())
    by_hash = sorted(r.file_name for r in reg.register_new_files(inv, registry, match="hash").collect())
    assert default == ["c.pdf"] and by_hash == ["a.pdf", "c.pdf"]

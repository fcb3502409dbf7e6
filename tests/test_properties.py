"""Operators against brute-force Python on random small fixtures."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from papyra.operators import documents as doc
from papyra.operators import extraction as ext
from papyra.operators import registry as reg
from papyra.schemas import CONTRACT_TRACK, FILE_INVENTORY


def test_register_matches_not_exists_or(spark):
    rnd = random.Random(3)
    names = [f"f{i}.pdf" for i in range(40)]
    hashes = [f"h{i}" for i in range(15)] + [None]
    t0 = datetime(2024, 1, 1)
    for trial in range(3):
        registry = [(rnd.choice(names), "pdf", 1, rnd.choice("NS"), "/r", t0, None, rnd.choice(hashes))
                    for _ in range(rnd.randint(0, 25))]
        inventory = [(rnd.choice(names), "pdf", 1, f"/i/{k}", t0, None, rnd.choice(hashes)) for k in range(30)]
        got = reg.register_new_files(spark.createDataFrame(inventory, FILE_INVENTORY),
                                     spark.createDataFrame(registry, CONTRACT_TRACK) if registry
                                     else spark.createDataFrame([], CONTRACT_TRACK))
        reg_names = {r[0] for r in registry}
        reg_hashes = {r[7] for r in registry if r[7] is not None}
        want = sorted(r[3] for r in inventory
                      if r[0] not in reg_names and (r[6] is None or r[6] not in reg_hashes))
        assert sorted(r.file_path for r in got.collect()) == want, trial


def test_money_text_formats(spark):
    rnd = random.Random(5)
    cases = []
    for _ in range(200):
        v = round(rnd.uniform(0, 9_999_999), 2)
        whole, cents = f"{v:.2f}".split(".")
        grouped = f"{int(whole):,}"
        cases += [(f"{v:.2f}", v), (f"R$ {grouped.replace(',', '.')},{cents}", v),
                  (f"US$ {grouped}.{cents}", v), (f"{whole},{cents}", v)]
    df = spark.createDataFrame(cases, "t string, v double")
    bad = df.select("t", "v", ext.to_number(F.col("t")).alias("got")).filter(
        F.abs(F.col("got") - F.col("v")) > 1e-6).collect()
    assert not bad, bad[:5]
    junk = spark.createDataFrame([("abc",), ("",), (None,), ("1.2.3,4,5",)], "t string")
    assert all(r.g is None for r in junk.select(ext.to_number(F.col("t")).alias("g")).collect())


def test_spread_keeps_rows(spark):
    rows = [(f"/p/{i}", bytearray(b"x" * (i % 7))) for i in range(300)]
    df = spark.createDataFrame(rows, "path string, content binary")
    for exact in (False, True):
        out = doc.spread_by_hash(df, 10, exact=exact)
        assert out.rdd.getNumPartitions() == 10
        assert sorted((r.path, bytes(r.content)) for r in out.collect()) == sorted((p, bytes(c)) for p, c in rows)

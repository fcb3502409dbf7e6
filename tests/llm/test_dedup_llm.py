"""Exact and near de-duplication against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from papyra.llm import exact_dedup as ed
from papyra.llm import simhash as sh
from papyra.llm.components import components


def brute_groups(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, *_ in rows]
    out = []
    for (i, *_), t in zip(rows, norm, strict=True):
        ids = [r[0] for r, u in zip(rows, norm, strict=True) if u == t]
        known = [x for x in ids if x is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs, tiny, weak):
    # The weak digest makes different texts collide: only the comparison of bytes can tell them apart.
    digest = (lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1).eqNullSafe("0").cast("int").cast("string"))) if weak else ed.sha256
    got = ed.groups(docs, digest=digest).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_groups(tiny)
    for sha in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1


def test_exact_keep_first(docs, tiny):
    kept = ed.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({g[3] for g in brute_groups(tiny)})
    assert sorted([r.doc_id for r in rows], key=str) == sorted([g[1] for g in {x[3]: x for x in brute_groups(tiny)}.values()], key=str)


def test_exact_empty(no_docs):
    assert ed.groups(no_docs).count() == 0 and ed.keep_first(no_docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    f = ed.build_filter(keys)
    assert ed.in_filter(keys, *f).all()
    other = rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2)
    if n >= 1000:
        assert ed.in_filter(other, *f).mean() < 0.01 and len(f[3]) < 1.6 * n


def brute_print(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, bits):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_rows(docs, tiny, monkeypatch):
    monkeypatch.setattr(sh, "_CHUNK", 97)      # texts in many pieces
    got = sh.near_duplicates(docs).collect()
    prints = [brute_print(t) for _, t, _ in tiny]
    roots = brute_components(prints, 3)
    least = {}
    for (i, *_), r in zip(tiny, roots, strict=True):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    want = [(i, f"{p:016x}", least[r]) for (i, *_), p, r in zip(tiny, prints, roots, strict=True)]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    kept = sh.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted(least.values(), key=str)


def test_simhash_empty(no_docs):
    assert sh.near_duplicates(no_docs).count() == 0 and sh.keep_first(no_docs).count() == 0


@pytest.mark.parametrize("bits", [2, 3])
def test_links_lose_no_component(spark, bits):
    """Dense and sparse groups of fingerprints at every distance from one to four bits."""
    rng = np.random.default_rng(bits)
    prints = []
    for c in rng.integers(0, 2**63, 40, dtype=np.uint64).tolist():
        prints.append(c)
        for _ in range(int(rng.integers(1, 25))):
            x = prints[-1] if rng.random() < 0.4 else c
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False).tolist():
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    roots = brute_components(prints, bits)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = sh.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits).collect()
    for r in found:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= bits
    where = {s: i for i, s in enumerate(signed)}
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    for r in found:
        a, b = find(where[r.a]), find(where[r.b])
        group[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == roots


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    got = dict(components(spark.createDataFrame(path + star + path[:5], "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 1000 for i in range(1000, 1200)}}

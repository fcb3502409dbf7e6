"""Packing, mixing and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF0001
from papyra.llm import exact_dedup, mixing, packing, simhash, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def check_packed(rows, texts, encode, capacity=1024):
    """Round trip: pieces of a document follow each other and hold its ids; sequences are gapless and not too long."""
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    assert set(docs) == {i for i, _ in texts}
    for i in docs:
        for t, n in Counter(t for j, t in texts if j == i).items():
            ids = np.array(encode(t) + [0], "<u4")
            want = Counter()
            at = 0
            for size in packing.cut(len(ids), capacity):
                want[(at, size, zlib.crc32(ids[at:at + size].tobytes()), len(ids))] += n
                at += size
            have = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in docs[i])
            assert all(have[k] >= v for k, v in want.items())
        assert sum(r.length for r in docs[i]) == sum(len(encode(t)) + 1 for j, t in texts if j == i)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_chunks_encode_like_whole_texts(encode):
    ids = packing.TextIds(PATH)
    texts = ("", " ", "a", " a", "a b", "a  b", "a \n b", "end ", "end  ", "\n\n x", "tab\t y", "nbsp  z   w", "it's we'll 12 34",
              "x\x1c y \x1f z", "<|endoftext|> a <|endoftext|>", "a\n <|endoftext|>", "über 🙂  naïve", "a" * 3000, "b " * 3000)
    for _ in range(2):      # unknown chunks, then remembered ones
        for t, known in zip(texts, ids(list(texts)), strict=True):
            assert np.frombuffer(known, "<u4").tolist() == encode(t), repr(t)


def test_chunk_memory_turns_over(encode, monkeypatch):
    monkeypatch.setattr(packing, "_MEMORY", 50)
    ids = packing.TextIds(PATH)
    texts = [f"w{i % 90} common x{i * 7 % 400} {'long' * 30} \n y{i}" for i in range(600)]
    for i in range(0, 600, 40):
        for t, known in zip(texts[i:i + 40], ids(texts[i:i + 40]), strict=True):
            assert np.frombuffer(known, "<u4").tolist() == encode(t), repr(t)


def test_packing_round_trip(docs, no_docs, tiny, encode):
    rows = packing.pack(docs, PATH).collect()
    check_packed(rows, [(i, t) for i, t, _ in tiny], encode)
    assert packing.pack(no_docs, PATH).count() == 0


def test_packing_leaves_little_padding(spark, encode):
    d = spark.read.parquet(f"{SF0001}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in d.collect()]
    sequences = check_packed(packing.place(packing.pieces(d, PATH), bucket_pieces=150).collect(), texts, encode)
    share = lambda seqs: sum(n for s in seqs.values() for _, n in s) / (1024 * len(seqs))
    assert share(sequences) > 0.9                                     # tiny buckets leave many bins unfilled
    assert share(check_packed(packing.pack(d, PATH).collect(), texts, encode)) > 0.995


def test_harmonic_bins_hold_a_fixed_count(spark):
    d = spark.createDataFrame([(i, 0, 1 + i % 1024, i, 1 + i % 1024) for i in range(4000)],
                              "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    bins = {}
    for r in packing.place(d, bucket_pieces=1000).collect():
        bins.setdefault(r.sequence_id, []).append(r.length)
    for s, lengths in bins.items():
        klass = s >> packing.CLASS_SHIFT & packing.CLASS_MASK
        assert sum(lengths) <= 1024
        if klass:
            assert len(lengths) == klass and all(1024 // n == klass for n in lengths)
    assert sum(map(len, bins.values())) == 4000


def brute_alpha(counts, entropy, repeats):
    def fits(a):
        p = np.array(counts, float) / sum(counts)
        q = p**a / (p**a).sum()
        b = max(counts) / q[np.argmax(counts)]
        h = -(q * np.log(q)).sum()
        return (entropy is None or h <= entropy * math.log(len(counts)) + 1e-12) and (
            repeats is None or max(q * b / np.array(counts)) <= repeats * (1 + 1e-12))
    if fits(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


@pytest.mark.parametrize("limits", [(0.9, None), (None, 3.0), (0.95, 2.0), (None, None)])
def test_exponent(spark, limits):
    counts = [100_000, 30_000, 9_000, 4_000, 1_000]
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(counts)], "key string, n long")
    mix = mixing.weigh_counts(df, *limits, None)
    assert mix.alpha == pytest.approx(1.0 if limits == (None, None) else brute_alpha(counts, *limits), abs=1e-9)
    rows = mix.weights.collect()
    assert sum(r.weight for r in rows) == pytest.approx(1)
    assert all(r.budget_tokens >= r.n_tokens for r in rows)


@pytest.mark.parametrize("counts, met", [([100_000, 30_000, 9_000, 4_000, 1_000], True), ([1000, 1010, 990, 1005], False)])
def test_entropy_reached_is_reported(spark, counts, met):
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(counts)], "key string, n long")
    mix = mixing.weigh_counts(df, 0.9, None, None)
    q = np.array(counts, float) ** mix.alpha
    q /= q.sum()
    assert mix.entropy == pytest.approx(-(q * np.log(q)).sum() / math.log(len(q)))
    assert mix.met == met and (mix.entropy <= 0.9 + 1e-9) == met and (met or mix.alpha == 1.0)


def test_schedule(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 17)), "big" if i % 10 else f"s{i % 3}") for i in range(1500)] + [(9999, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.schedule(docs, block_tokens=300, entropy=None, max_repeats=2.5).collect()
    tokens = {i: len((t or "").split()) + 1 for i, t, _ in rows}
    weights = {r.key: r for r in mixing.weigh(docs, entropy=None, max_repeats=2.5).weights.collect()}
    by_source = {}
    for r in plan:
        assert r.tokens == tokens[r.doc_id]
        by_source.setdefault(r.source, []).append(r)
    for source, copies in by_source.items():
        w = weights["n" if source is None else "s" + source]
        spent = sum(r.tokens for r in copies)
        assert w.budget_tokens - spent < max(tokens.values()) and spent <= w.budget_tokens
        times = Counter(r.doc_id for r in copies)
        assert set(times) == {i for i, _, s in rows if s == source}
        assert max(times.values()) - min(times.values()) <= 1
        at = 0
        for r in sorted(copies, key=lambda r: r.mix_position):
            assert r.mix_position == pytest.approx(at / w.budget_tokens)
            at += r.tokens
    cut = mixing.schedule(docs, block_tokens=300, budget=4000).collect()
    assert 3500 < sum(r.tokens for r in cut) <= 4000


def test_mixing_edge_rows(docs, no_docs, tiny):
    out = mixing.apply(docs, entropy=None, max_repeats=1.0)
    assert out.columns == docs.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in out.collect()])) == sorted(str((i, t)) for i, t, _ in tiny)
    assert mixing.apply(no_docs).count() == 0 and mixing.schedule(no_docs).count() == 0


def test_stages_and_whole_pipeline(spark, encode):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, SF0001)
    model = toxicity.train(docs, spark.read.parquet(f"{SF0001}/labels.parquet"))
    scores = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
    left = [(r.doc_id, r.text, r.source) for r in clean.collect()]
    assert {i for i, *_ in left} == {i for i, t in scores.items() if not t} and clean.columns == docs.columns
    # By hand: first of equal texts, first of each component of fingerprints, then as the mixture repeats them.
    import re
    first = {}
    for i, t, s in sorted(left):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), (i, t, s))
    unique = sorted(first.values())
    prints = [simhash.fingerprint(t or "") for _, t, _ in unique]
    kept = []
    root = list(range(len(unique)))
    for i in range(len(unique)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    kept = [u for i, u in enumerate(unique) if root[i] == i]
    table = spark.createDataFrame(kept, "doc_id long, text string, source string")
    assert {r.doc_id for r in simhash.keep_first(exact_dedup.keep_first(clean)).collect()} == {i for i, *_ in kept}
    mixed = mixing.apply(table).collect()
    packed = corpus_pipeline.run(spark, SF0001).collect()
    check_packed(packed, [(r.doc_id, r.text) for r in mixed], encode)

"""Search, MinHash join and filter audit against brute force, with edge rows and hot groups."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from papyra.llm import filter_audit as fa
from papyra.llm import lexical as lx
from papyra.llm import minhash_join as mj

# ------------------------------------------------------------------------------------------------ search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items, top=10):
    """(item_id, rank, doc_id, score) of every item row."""
    bags = [(i, Counter(TERM.findall(fold(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    many, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 25 + (75 * n * many) // total
            s = sum(times * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                    for t, times in Counter(TERM.findall(fold(text))).items() if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def rows(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


ITEMS = [(0, "alpha3 Beta7 beta7 the gamma"), (1, None), (2, ""), (3, "... !!"), (4, "one TWO naïve"), (5, "nowhere"),
         (None, "idiot x" + "x" * 4999), (7, "alpha3 beta7"), (7, "alpha3 beta7"), (8, " ".join(f"alpha{i} mu{i}" for i in range(60)))]


@pytest.mark.parametrize("item_rows,block_docs", [(200_000, 10_000), (40, 7)])
def test_search_equals_brute_force(spark, docs, tiny, item_rows, block_docs):
    items = spark.createDataFrame([(i, t, 1.0, 2) for i, t in ITEMS], "item_id long, text string, score double, rank int")
    got = lx.search(docs, items, item_rows=item_rows, block_docs=block_docs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got, "item_id", "rank", "doc_id", "score") == brute_search([(i, t) for i, t, _ in tiny], ITEMS)


def test_search_random_with_ties_and_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 80))) for _ in range(300)]
    data = [(i, rng.choice(texts[:40]) if i % 3 == 0 else texts[i % 300]) for i in range(900)]   # a third are copies
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(25)]
    got = lx.search(spark.createDataFrame(data, "doc_id long, text string").repartition(5),
                    spark.createDataFrame(items, "item_id long, text string"), block_docs=50)
    assert rows(got, "item_id", "rank", "doc_id", "score") == brute_search(data, items)


def test_search_empty_tables(spark, no_docs, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lx.search(no_docs, items).count() == 0 and lx.search(docs, items.limit(0)).count() == 0


def test_search_text_ids(spark):
    data = [("b", "cat dog"), ("a", "cat dog"), (None, "cat dog"), ("z", "bird")]
    got = lx.search(spark.createDataFrame(data, "doc_id string, text string"),
                    spark.createDataFrame([("q", "CAT")], "item_id string, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["a", "b", None]


def test_accumulators_stop_and_stay_exact():
    # One rare term decides; the common term alone cannot reach the k-th score, so it makes no accumulators.
    n = 2_000
    term = np.concatenate([np.zeros(20, int), np.ones(n, int)])
    doc = np.concatenate([np.arange(20), np.arange(n)])
    block = lx.Block(term, doc, np.ones(len(term), np.int64), np.full(n, 100, np.int64))
    found, score = lx.evaluate(block, [(0, 9_000), (1, 10)], 0, 10)
    assert sorted(found) == list(range(20))
    assert (score == 9_010 * (10**9 // 1800)).all()


def test_lengths_beyond_64_bits():
    n = np.array([3, 10**12], np.int64)
    assert lx.lengths(n, 10**10, 10**13).tolist() == [25 + 75 * x * 10**10 // 10**13 for x in n.tolist()]


def test_search_long_text(spark):
    data = [(1, "needle " + "hay " * 1_500_000), (2, "needle hay"), (3, "straw")]          # several pieces
    items = [(0, "needle"), (1, "hay")]
    got = lx.search(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "item_id", "rank", "doc_id", "score") == brute_search(data, items)


# ------------------------------------------------------------------------------------------------ MinHash join

def shingles(text, k=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", fold(text)) if x]
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)} if w else set()


def brute_near(data, percent=85):
    sets = [shingles(t) for _, t in data]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(data):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted([(i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(data)], key=str)


COLS = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates_edge_rows(docs, tiny):
    assert rows(mj.near_duplicates(docs), *COLS) == brute_near([(i, t) for i, t, _ in tiny])


def perturbed(rng, base, share):
    return " ".join(f"{w}{rng.randrange(10**6)}" if rng.random() < share else w for w in base)


def families(seed, sizes):
    """Groups of near copies around both sides of the threshold."""
    rng = random.Random(seed)
    data = []
    for size in sizes:
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.choice((60, 150, 400)))]
        data += [perturbed(rng, base, rng.choice((0, 0.002, 0.01, 0.02, 0.04))) for _ in range(size)]
    rng.shuffle(data)
    return list(enumerate(data))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    data = families(seed, [2, 3, 5, 8, 20, 60, 1, 1])
    assert rows(mj.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")), *COLS) == brute_near(data)


def test_group_over_several_blocks(spark):
    """A candidate group larger than a block: each pair of blocks is compared on its own, with the same links."""
    data = families(5, [180, 40])
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = mj.stage(mj.prints(docs), "p")
    from pyspark.sql import functions as F
    nodes = mj.stage(found.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("rep"),
                                                 F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
                     .withColumn("node", F.monotonically_increasing_id()), "n")
    groups = mj.stage(mj.candidate_groups(nodes), "g")
    one = mj.components(mj.exact_links(docs, nodes, groups)).collect()
    many = mj.components(mj.exact_links(docs, nodes, groups, block_nodes=17)).collect()
    assert sorted(one) == sorted(many) and len(one) > 17


def test_signature_join_finds_every_pair_under_the_threshold(spark):
    """Signatures, not texts: pairs at exactly the threshold, the differences spread to leave no chunk whole."""
    rng = np.random.default_rng(7)
    k, worst = mj.CHUNKS * mj.WIDTH, mj.CHUNKS * (mj.ERRORS + 1) - 1
    sigs, pairs = [], []
    for case in range(40):
        a = rng.integers(0, 2**mj.BITS, k).astype("<u2")
        b = a.copy()
        hit = [c * mj.WIDTH + j for c in range(mj.CHUNKS) for j in rng.choice(mj.WIDTH, mj.ERRORS + 1, replace=False)]
        at = rng.permutation(hit)[:worst] if case % 2 else rng.choice(k, worst, replace=False)
        b[at] ^= 1
        pairs.append((len(sigs), len(sigs) + 1))
        sigs += [a, b]
    nodes = spark.createDataFrame([(i, 100, bytearray(s.tobytes())) for i, s in enumerate(sigs)],
                                  "node long, n_shingles long, signature binary")
    root = {r.node: r.root for r in mj.candidate_groups(nodes).collect()}
    assert all(root.get(a, a) == root.get(b, -1) for a, b in pairs)


def test_near_duplicates_hot_and_long(spark):
    rng = random.Random(4)
    base = [f"q{rng.randrange(900)}" for _ in range(80)]
    data = [(i, " ".join(base)) for i in range(400)] + [(400 + i, perturbed(rng, base, 0.01)) for i in range(100)]
    long = " ".join(f"z{i}" for i in range(300_000))                    # over 2 MB: several pieces
    data += [(1000, long), (1001, long + " end"), (1002, "short")]
    got = {r.doc_id: r for r in mj.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[i].component_id == 0 for i in range(400)) and got[0].kept and not got[399].kept
    assert got[1001].component_id == 1000 and got[1001].n_shingles == 299_997 and got[1002].component_id == 1002


def test_near_duplicates_keep_first_and_empty(spark, docs, no_docs, tiny):
    kept = mj.keep_first(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, _, k in brute_near([(i, t) for i, t, _ in tiny]) if k}
    assert {r.doc_id for r in kept.collect()} == want
    assert mj.near_duplicates(no_docs).count() == 0 and mj.keep_first(no_docs).count() == 0


def test_overlaps_of_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120))) for _ in range(70)]
    got = mj._overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(70) for j in range(70) if i != j)


# ------------------------------------------------------------------------------------------------ filter audit

def fails(text):
    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    return {f for f, bad in (
        ("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)),
        ("C", 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)), ("D", any(c in "#$%&*|" for c in t))) if bad}


def brute_audit(data, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in data:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = [(i, p or "", fails(t) | ({"E"} if i is not None and i > least[t or ""] else set())) for i, t, p in data]
    out, shapley = [], Counter()
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), k, len(left), len(gone), sum(f in x for _, x in own) - len(gone),
                            sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
    return sorted((tuple(r) + (shapley[r[0], r[1][r[2] - 1]],) for r in out), key=str)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    data = [(1, None, "en"), (2, "", "en"), (3, " \t ", None), (4, "A" * 50, ""), (5, "x # y", "en"), (6, "x # y", "de"),
            (None, "x # y", "en"), (7, "x # y", "de"), (7, "x # y", "de"), (None, None, None), (8, "é🙂 " * 150, "fr")]
    for i in range(20, 140):
        t = " ".join(rng.choices(words[:rng.choice((30, 400))], k=rng.choice((20, 99, 100, 101, 150))))
        if rng.random() < 0.3:
            t = t.upper()
        if rng.random() < 0.2:
            t += " 50%"
        data.append((i, t, rng.choice(("en", "de"))))
        if rng.random() < 0.3:
            data.append((i + 1000, t, rng.choice(("en", "de", "fr"))))
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 130, 2)] + [(5, 0, 1), (5, 1, 0), (None, 1, 1)]
    return data, labels


def test_audit_equals_brute_force(spark):
    data, labels = audit_rows()
    docs = spark.createDataFrame([(i, t, p, 9, "m", 4) for i, t, p in data],
                                 "doc_id long, text string, lang string, mask int, prefix string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.audit(docs, marks)
    assert tuple(got.columns) == AUDIT
    assert rows(got, *AUDIT) == brute_audit(data, labels)


def test_audit_empty_and_no_labels(spark):
    data, _ = audit_rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(fa.audit(docs, none), *AUDIT) == brute_audit(data, [])
    assert fa.audit(docs.limit(0), none).count() == 0


def test_audit_many_parts_and_long_text(spark):
    """Over the row limit of a recursive query (a million) in parts; the limit is as before afterwards."""
    was = spark.conf.get("spark.sql.cteRecursionRowLimit")
    cells = spark.range(4000).selectExpr("string(id) AS part", "int(id % 32) AS mask", "3L AS n", "1L AS good", "0L AS toxic")
    steps = fa.prefixes(cells)
    assert steps.count() == 4000 * 325 and spark.conf.get("spark.sql.cteRecursionRowLimit") == was
    assert steps.filter("prefix = 'A'").selectExpr("sum(removed)").first()[0] == 3 * 2000
    text = "word " * 2_000_000 + "#"
    assert fa.text_mask(text.encode()) == 2 + 8 and fa._words(text.encode()) == (2_000_001, 2)

"""Models, line join, fingerprints, secrets and quotations against brute force, rules or held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF0001
from papyra.llm import fingerprints as fp
from papyra.llm import line_dedup as ld
from papyra.llm import quality, quotes, secrets, toxicity
from papyra.llm.common import WordHasher

SF01 = "/root/testdata/sf0.01"


def test_word_hashes_do_not_depend_on_place_or_chunks(monkeypatch):
    h = WordHasher()
    text = "The quick brown-fox, jumps; ÜBER the_lazy dog 42 the"
    alone = [int(h(w)[0]) for w in "the quick brown fox jumps über the lazy dog 42 the".split()]
    assert h(text).tolist() == alone
    monkeypatch.setattr("papyra.llm.common._CHUNK", 5)
    assert WordHasher()(text).tolist() == alone and len(h("")) == 0 and len(h(" .,")) == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_banded_edit_distance():
    rng = random.Random(1)
    for _ in range(6000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        for k in (0, 1, 2, 3):
            assert ld.within(a, b, k) == (edit_distance(a, b) <= k), (a, b, k)


def test_line_join_against_all_pairs(spark):
    rng = random.Random(2)
    lines = []
    for _ in range(25):
        s = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(4, 45))).strip() or "q"
        lines.append(s)
        for _ in range(6):
            t = list(s)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(t) + 1)
                t[at:at + rng.randrange(2)] = rng.choice(["", "z", "y"])
            lines.append("".join(t) or "q")
    lines += ["  ", "", "same line twice here", "same line twice here\r"]
    rows = [(None if i == 3 else i // 5, "\n".join(lines[i:i + 5])) for i in range(0, len(lines), 5)] + [(99, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, line string")
    flat = [(i, n, s.rstrip("\r")) for i, t in rows if t for n, s in enumerate(t.split("\n")) if s.strip(" \t\x0b\x0c\r")]
    known = sorted({s for *_, s in flat})
    near = {s: {t for t in known if t != s and edit_distance(s, t) <= min(2, max(len(s), len(t)) // 10)} for s in known}
    got = ld.line_classes(df).collect()
    assert sorted((str(r.doc_id), r.line_no) for r in got) == sorted((str(i), n) for i, n, _ in flat)
    text = {(i, n): s for i, n, s in flat}
    order = lambda at: (at[0] is not None, at[0] or 0, at[1])        # noqa: E731
    for r in got:
        s = text[(r.doc_id, r.line_no)]
        assert r.links == len(near[s]) and r.copies == sum(x == s for *_, x in flat)
        seen, todo = {s}, [s]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        head = min(((i, n) for i, n, x in flat if x in seen), key=order)
        assert (r.class_doc_id, r.class_line_no) == head and r.kept == ((r.doc_id, r.line_no) == head)


def test_line_join_edits_follow_the_length(spark):
    """Without a flat bound a tenth of the longer line may differ; short lines, shifts and length gaps included."""
    rng = random.Random(6)
    lines = []
    for n in [9, 10, 11, 19, 20, 29, 35, 48, 60, 79, 89, 90, 100, 119, 150, 240]:
        s = "".join(rng.choice("abcdefghij klmnop") for _ in range(n - 2))
        lines.append(f"x{s}y")
        for k in (1, 1, max(1, n // 20), max(1, n // 10), max(1, n // 10), n // 10 + 1, n // 9 + 2):
            t = list(rng.choice(lines[-3:]))
            kind = rng.randrange(4)                            # spread, or inserted, dropped or replaced together
            for _ in range(k):
                at = rng.randrange(len(t)) if kind == 0 else min(len(t) - 1, 3)
                t[at:at + (kind != 1)] = [] if kind == 2 and len(t) > 1 else [rng.choice("QRS")]
            lines.append("".join(t))
    lines = sorted(set(lines))
    for a in lines:
        for b in lines[:40]:
            for k in (4, 9, 25):
                assert ld.within(a, b, k) == (edit_distance(a, b) <= k), (a, b, k)
    near = {a: sum(a != b and edit_distance(a, b) <= max(len(a), len(b)) // 10 for b in lines) for a in lines}
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.links for r in ld.line_classes(df, max_edits=None).collect()}
    assert got == {i: near[s] for i, s in enumerate(lines)} and sum(near.values()) > 60


def test_line_join_without_a_flat_bound_writes_only_links(spark, scratch):
    """No run of characters is shuffled, however long the lines; blocks cut by length and into shards give the same links."""
    rng = random.Random(8)
    lines = []
    for i in range(60):
        s = "".join(rng.choice("abcdefghij klmnop") for _ in range(rng.choice([30, 90, 95, 400, 2500])))
        lines += [s, s[:7] + "##" + s[9:], s[:len(s) // 2] + "Q" * (len(s) // 10 - 1) + s[len(s) // 2:], "ab" * (len(s) // 2)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    known = ld.distinct_lines(ld.occurrences(df), f"{scratch}/lines")
    found = ld.links(known, f"{scratch}/lines", None)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    text = {r.line_id: r.line for r in known.collect()}
    got = [(r.a, r.b) for r in found.collect()]
    near = {(a, b) for a in text for b in text if a < b and abs(len(text[a]) - len(text[b])) <= 250
            and ld._within_rows(*sorted((text[a], text[b]), key=len), max(len(text[a]), len(text[b])) // 10)}
    assert len(got) == len(set(got)) and set(got) == near and len(near) > 100
    sizes = sorted({(len(x), len(x), 0) for x in text.values()})
    bands = ld._bands([(n, n, sum(len(x) == n for x in text.values()) * n) for n, *_ in sizes], 5000)
    assert any(of > 1 for *_, of in bands)
    run = ld._compare(f"{scratch}/lines", bands, chunk=3000, most=500)
    ids = pa.RecordBatch.from_arrays([pa.array(range(len(bands)))], names=["id"])
    assert sorted((a, b) for r in run([ids]) for a, b in zip(*(r.column(c).to_pylist() for c in "ab"))) == sorted(near)


def test_many_near_lines_hand_on_rows_by_the_line_not_by_the_pair(spark, scratch):
    rng = random.Random(5)
    lines = set()
    for base in ("".join(rng.choice("abcdefgh ijkl") for _ in range(n)) for n in (60, 300)):
        while len(lines) % 80 or not lines:
            t = list(base)
            for _ in range(len(base) // 40):
                t[rng.randrange(len(t))] = rng.choice("XYZ")
            lines.add("".join(t))
        lines.add("no line is near this one: " + base[::-1])
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    known = ld.distinct_lines(ld.occurrences(df), f"{scratch}/lines")
    pairs = ld.links(known, f"{scratch}/lines", None).count()
    edges, degree = ld._summed(known, f"{scratch}/lines", None)
    assert pairs > 3000 and edges.count() + degree.count() <= 4 * len(lines)
    assert degree.groupBy().sum("links").first()[0] == 2 * pairs
    near = {a: sum(a != b and ld.within(a, b, max(len(a), len(b)) // 10) for b in lines) for a in lines}
    got = {r.doc_id: r.links for r in ld.line_classes(df, max_edits=None).collect()}
    assert got == {i: near[x] for i, x in enumerate(lines)}


def test_edit_distances_of_many_pairs_in_step():
    rng = random.Random(6)
    one, two = [], []
    for _ in range(400):
        t = [rng.choice(rng.choice(["ab", "abcdefghé😀"])) for _ in range(rng.choice([40, 63, 64, 65, 128, 129, 300, 700]))]
        b = "".join(t)
        for _ in range(rng.randrange(len(t) // 7)):
            at, kind = rng.randrange(len(t)), rng.randrange(3)
            t[at:at + (kind != 1)] = [] if kind == 2 else [rng.choice("ab")]
        a, b = sorted(("".join(t), b), key=len)
        if len(b) - len(a) <= len(b) // 10:
            one.append(a)
            two.append(b)
    want = [ld._within_rows(a, b, len(b) // 10) for a, b in zip(one, two)]
    assert ld._within_many(one, two, least=1).tolist() == want and 50 < sum(want) < len(want)
    assert ld._within_many(one, two, chars=100).tolist() == want and ld._within_many([], []).tolist() == []


def test_line_query_links_a_long_line_with_one_word_changed(spark, tmp_path):
    words = [f"word{i}" for i in range(40)]
    other = words[:20] + ["elsewhere"] + words[21:]
    spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = E.queries()["op3_line_edit_join"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.links, r.class_doc_id) for r in got) == [(1, 1, 1), (2, 1, 1)]


def test_line_join_edge_rows(docs, no_docs):
    assert ld.line_classes(no_docs).count() == 0
    assert ld.line_classes(docs).count() > 0


def shingles(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_fingerprints_estimate_resemblance(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    ids = sorted(rows)
    off = []
    for r in E.queries()["op10_one_permutation_minhash"](spark, SF0001).collect():
        t, nxt = rows[r.doc_id], rows[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        h = len(t) // 2
        edited = t[:len(t) - h] + nxt[:h]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(nxt)
        off += [r.near_edited - len(a & b) / len(a | b), r.near_next - len(a & c) / len(a | c)]
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.2


def test_fingerprint_edge_rows(docs, no_docs, tiny):
    got = fp.edited_report(docs).collect()
    assert len(got) == len(tiny)
    by_text = {}
    for r in got:
        by_text.setdefault((r.fingerprint, r.n_chars), set()).add(r.doc_id)
    empty = [r.fingerprint for r in got if r.n_chars == 0]
    assert len(empty) == 3 and len(set(empty)) == 1
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fp.edited_report(no_docs).count() == 0
    one = fp.edited_report(docs.filter("doc_id = 12")).collect()
    assert one[0].near_next == 1.0


def test_fingerprint_plan_has_no_python(spark):
    df = spark.read.parquet(f"{SF0001}/documents.parquet").select(fp.signature(F_col()))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def F_col():
    from pyspark.sql import functions as F
    return F.col("text")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_quality_on_the_held_out_fold(spark):
    got = E.queries()["op1_quality_fm"](spark, SF01).toPandas()
    labels = spark.read.parquet(f"{SF01}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert auc(m.score.to_numpy(), m.quality.to_numpy()) > 0.95


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=20), rng.normal(size=(20, quality.FACTORS)))
    idx, val = np.array([2, 5, 7, 11]), rng.normal(size=4)
    pairs = sum(fm.factors[idx[i]] @ fm.factors[idx[j]] * val[i] * val[j] for i in range(4) for j in range(i))
    want = 0.3 + fm.linear[idx] @ val + pairs
    assert fm.margins(idx, val, np.array([0]))[0][0] == pytest.approx(want)


def test_models_on_edge_rows(spark, docs, no_docs, tiny):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(4, 1, 0), (9, 0, 1), (9, 0, 1), (None, 1, 1), (5, None, None), (77, 1, 0)],
                                "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        q = quality.train(docs, labels, metadata=["n"])
        assert quality.score(docs, q, metadata=["n"]).count() == len(tiny)
        assert quality.score(no_docs, q, metadata=["n"]).count() == 0
        t = toxicity.train(docs, labels)
        assert toxicity.score(docs, t).count() == len(tiny)
        assert toxicity.keep_clean(docs, t).columns == docs.columns
        assert toxicity.keep_clean(no_docs, t).count() == 0


def test_toxicity_learns_grades(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        bad = rng.choice([0, 0, 0, 1, 2, 4, 8])
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))] + [rng.choice(["foul", "vile"]) for _ in range(bad)]
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad > 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels[:1000], "doc_id long, toxic int"))
    assert (np.diff(model.thetas) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[i].toxic == y for i, y in labels[1000:]) >= 490
    severity = [np.mean([got[i].severity for i, t in rows[1000:] if t.count("foul") + t.count("vile") == n]) for n in (0, 1, 4, 8)]
    assert severity == sorted(severity)
    clean = toxicity.keep_clean(docs, model)
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.toxic}


def test_toxicity_trains_on_labels_that_are_grades(spark):
    """Grades 0 to 3 by a word of their own each, in no order of frequency: only the labels tell them apart."""
    rng = random.Random(8)
    marks = ["", "mild", "marked", "severe"]
    rows = [(i, " ".join([f"w{rng.randrange(400)}" for _ in range(30)] + [marks[i % 4]])) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 4) for i, _ in rows[:800]] + [(3, 3), (3, 2), (3, 3)]
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.grade for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == i % 4 for i, _ in rows[800:]) >= 390


def test_secret_scan(spark):
    rng = random.Random(5)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))         # noqa: E731
    rows, truth = [], {}
    for i in range(300):
        s = hexed(40) if i % 3 == 0 else "".join(rng.choice("0123456789") for _ in range(16))
        text = f'some words {"token = " if i % 3 == 0 else "call "}"{s}" and more' if i % 2 else f"plain text {s} follows"
        rows.append((i, text, "src/x.py"))
        truth[i] = (s, i % 3 == 0)
    rows += [(900, None, None), (901, "", "a"), (902, "nothing to find in this text", "a")]
    df = spark.createDataFrame([(i, t, p, 1.0) for i, t, p in rows], "doc_id long, text string, source string, score double")
    got = secrets.scan(df).collect()
    assert {r.doc_id for r in got} == set(truth)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        found = texts[r.doc_id][r.start:r.start + r.length]
        assert found == truth[r.doc_id][0] and r.candidate_sha256 == hashlib.sha256(found.encode()).hexdigest()
    assert np.mean([r.is_secret == truth[r.doc_id][1] for r in got]) > 0.9
    assert secrets.scan(df.limit(0)).count() == 0


def test_secrets_assigned_to_a_name(spark):
    """NAME=value, URL parameters, quoted and short values: the value alone is the candidate, and known to be assigned."""
    aws, gh = "AKIA" + "Q7RZ2M4KX9WD3BNA", "ghp_" + "a1B2c3D4e5F6g7H8i9J0" * 2
    rows = {1: (f"AWS_ACCESS_KEY_ID={aws}", [aws]), 2: (f"export TOKEN={gh}\nnext", [gh]), 3: (f"TOKEN_V2_OF_PRODUCTION='{gh}'", [gh]),
            4: (f"get /v?page=2&access_token={gh}&x=1", [gh]), 5: ("pwd: hunter2!x", ["hunter2!x"]), 6: ('"password": "p@ss1"', ["p@ss1"]),
            7: ("data QUJDREVGR0hJSktMTU5PUFE1Njc4OQ== end", ["QUJDREVGR0hJSktMTU5PUFE1Njc4OQ=="]), 8: ("pwd = ", []),
            9: (f"secret_of_stage_2024: {gh}", ["secret_of_stage_2024", gh])}
    df = spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id long, text string")
    found = secrets.candidates(df)
    described = secrets.features(found, secrets.dictionary(df))
    got = described.withColumn("label", secrets.reviewed(described)).orderBy("doc_id", "nth").collect()
    assert [(r.doc_id, r.candidate) for r in got] == [(i, c) for i, (_, cs) in rows.items() for c in cs]
    for r in got:
        assert rows[r.doc_id][0][r.start:r.start + len(r.candidate)] == r.candidate
        if r.doc_id != 7 and r.candidate != "secret_of_stage_2024":
            assert r.named == 1 and r.assigned == 1 and r.label == 1, r
    sha = {r.doc_id: r.candidate_sha256 for r in secrets.scan(df.filter("doc_id in (2, 4)"), path_col=None).collect()}
    assert sha[2] == sha[4] == hashlib.sha256(gh.encode()).hexdigest()
    inside = described.filter("doc_id = 1").select("left", "right", F_lit(f"host/{aws}").alias("candidate"))
    assert inside.select(secrets.reviewed(inside)).first()[0] == 1


def test_dictionary_takes_every_word(spark):
    df = spark.createDataFrame([("end\nstart\tTab-joined/slashed über, no x1y2",), (None,), ("",), ("it end_of naïve",)], "text string")
    assert {r.word for r in secrets.dictionary(df, at_least=1).collect()} == {
        "end", "start", "tab", "joined", "slashed", "über", "naïve"}
    assert {r.word for r in secrets.dictionary(df, at_least=2).collect()} == {"end"}


def F_lit(x):
    from pyspark.sql import functions as F
    return F.lit(x)


def test_quotes_are_parsed():
    body, passages = quotes.parse("I agree.\n\nOn Monday Ann wrote:\n> yes\n> and no\n>> what was\n> that\nBye")
    assert body == "I agree.\n\nBye" and passages == [(1, "yes\nand no"), (2, "what was"), (1, "that")]


def test_quotation_links(spark):
    rows = [(1, 0, "user", "How long does the parcel take to Vienna?"), (1, 1, "assistant", "About three days, sometimes four."),
            (1, 2, "user", "> About three days,\n> sometimes four.\nAnd by express?"),
            (1, 3, "assistant", "> > About three days,  sometimes FOUR.\n> And by express? I would like to know\nOne day."),
            (2, 0, "user", "Ann wrote:\n> How long does the parcel take to Vienna?\n\nI ask this too."), (2, 1, "user", None),
            (2, 1, "user", "> quoted but never said by anyone"), (None, None, None, "lost"), (3, 5, "user", "alone")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, body string")
    got = {(r.conv_id, r.position): r for r in quotes.link_conversations(df).collect()}
    assert len(got) == len(rows)
    link = lambda c, p: (got[c, p].reply_conv_id, got[c, p].reply_turn, got[c, p].link)         # noqa: E731
    assert link(1, 0) == (None, None, "root") and link(1, 1) == (1, 0, "sequence") and link(1, 2) == (1, 1, "quote")
    assert link(2, 0) == (1, 0, "quote") and got[2, 0].thread_id == 1 and got[2, 0].body == "I ask this too."
    assert link(2, 2) == (2, 1, "sequence") and got[1, 2].body == "And by express?" and got[3, 0].thread_id == 3
    assert {got[2, 1].body, got[2, 2].body} == {""} and got[None, 0].body == "lost"
    assert quotes.link_conversations(df.limit(0)).count() == 0
    assert quotes.chat_messages(quotes.link_conversations(df)).count() == len(rows)


def test_short_quotations_link_in_their_conversation(spark):
    rows = [(1, 0, "It rains."), (1, 1, "Not here."), (1, 2, "Why?"), (1, 3, "> it  RAINS.\nWhere?"), (1, 4, "> Why?\n\n> Not here.\nSo."),
            (1, 5, "Two lines,\nIt rains."), (2, 0, "> It rains.\nSays who?"), (2, 1, "> Two lines,")]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_conv_id, r.reply_turn, r.link) for r in quotes.link_conversations(df).collect()}
    assert got[1, 3] == (1, 0, "quote") and got[1, 4][2] == "quote" and got[1, 4][1] in (1, 2)
    assert got[2, 0] == (None, None, "root") and got[2, 1] == (2, 0, "sequence")     # short, in another conversation


def brute_links(rows):
    """(reply conversation, reply turn, link) of each message by a plain search over all earlier messages."""
    own = [quotes.parse(t or "") for _, _, t in rows]
    out = {}
    for i, (c, t, _) in enumerate(rows):
        best = None
        for level, passage in own[i][1]:
            for h, n in quotes.units(passage).items():
                said = [(rows[j][0], rows[j][1]) for j in range(len(rows)) if (rows[j][0], rows[j][1]) < (c, t) and h in quotes.units(own[j][0])]
                here = [x for x in said if x[0] == c]
                source = min(here) if here else min(said) if said and n >= quotes.LEAST_CHARS else None
                if source and (best is None or (-level, n, bool(here)) > best[0]):
                    best = ((-level, n, bool(here)), source)
        before = max((t2 for c2, t2, _ in rows if c2 == c and t2 < t), default=None)
        out[c, t] = (*best[1], "quote") if best else (c, before, "sequence") if before is not None else (None, None, "root")
    return out


def test_quotation_links_equal_brute_force(spark):
    rng = random.Random(8)
    says = [" ".join(rng.choices("sun rain wind storm cloud frost hail".split(), k=rng.randrange(1, 12))) for _ in range(150)]
    rows = []
    for c in range(25):
        for t in range(6):
            text = says[len(rows) % 150] + rng.choice(("", "\n\n" + rng.choice(says)))
            earlier = [x for x in rows if x[0] == c or rng.random() < 0.05]
            if earlier and rng.random() < 0.6:
                quoted = quotes.parse(rng.choice(earlier)[2])[0]
                if rng.random() < 0.4 and "\n\n" in quoted:
                    quoted = quoted.split("\n\n")[0]
                text = "\n".join("> " + x for x in quoted.split("\n")) + "\n" + text
            rows.append((c, t, text))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_conv_id, r.reply_turn, r.link) for r in quotes.link_conversations(df).collect()}
    want = brute_links(rows)
    # Where two quoted units are equally good, either source is right.
    assert {k: v[2] for k, v in got.items()} == {k: v[2] for k, v in want.items()}
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)
    assert sum(v[2] == "quote" for v in want.values()) > 40


def test_positions_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 4)
    turns = [0, 1, 2, 3, 9, 10, 40, 41, 42]
    df = spark.createDataFrame([(1, t, "user", f"t{t}") for t in turns], "conv_id long, turn long, role string, text string")
    got = sorted((r.position, r.turn, r.reply_turn) for r in quotes.link_conversations(df).collect())
    assert got == [(i, t, turns[i - 1] if i else None) for i, t in enumerate(turns)]


def test_secret_candidates_of_any_length(spark):
    """One long path, dotted name, number, repeat or mail address in a document: no pattern needs a deep stack."""
    n = 330_000                                            # about 1 MB each
    long = {"path": "ab/" * n + "ab", "dotted": "ab." * n + "ab", "digits": "9" * 3 * n, "repeats": "x" * 3 * n,
            "mail": "user@" + "ab." * n + "com", "mixed": "aB3-" * n, "dashes": "ab-" * n + "ab", "jwt": "eyJ" + "a" * n + ".eyJ" + "b" * n + ".c"}
    df = spark.createDataFrame([(i, f"token = {v}", "s") for i, v in enumerate(long.values())],
                               "doc_id long, text string, source string")
    found = secrets.candidates(df)
    described = secrets.features(found, secrets.dictionary(df))
    got = described.select("doc_id", F.length("candidate").alias("n"), secrets.reviewed(described).alias("label")).collect()
    assert {r.doc_id for r in got} == set(range(len(long)))
    assert {r.label for r in got if r.doc_id in (0, 1, 2, 3, 6)} == {0}


def test_trainers_collect_at_most_their_bound(spark, monkeypatch):
    """A third of the rows under one labelled id: the trainers take one row of it, not all."""
    docs = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "concat('some words ', id % 50) AS text", "id AS n_chars")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7, 207)], "doc_id long, quality int, toxic int")
    sizes = []
    for module in (quality, toxicity):
        fit = module.fit
        monkeypatch.setattr(module, "fit", lambda rows, *a, _fit=fit, **k: sizes.append(len(rows)) or _fit(rows, *a, **k))
    quality.train(docs, labels, metadata=["n_chars"], max_train=100)
    toxicity.train(docs, labels, max_train=100)
    assert all(0 < n <= 100 for n in sizes) and len(sizes) == 2


def test_toxicity_keeps_the_type_of_the_ids(spark):
    docs = spark.createDataFrame([("a-1", "idiot idiot"), ("b", "calm words"), (None, None)], "doc_id string, text string")
    labels = spark.createDataFrame([("a-1", 1), ("b", 0)], "doc_id string, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels))
    assert dict(got.dtypes)["doc_id"] == "string" and {r.doc_id for r in got.collect()} == {"a-1", "b", None}

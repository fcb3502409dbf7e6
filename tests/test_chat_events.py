import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions.sequence import neighbour, running_sum
from papyra.operators import chat


def test_answer_fallbacks(spark):
    df = spark.createDataFrame([
        (1, '{"output":[{"content":[{"text":""}]}],"messages":[{"id":"run--1","role":"assistant","content":"R"}]}'),
        (2, '{"messages":[{"id":"run--2","role":"assistant"}]}'),
        (3, '{"messages":[{"id":"a","role":"assistant","content":"A1"},{"id":"b","role":"assistant","content":"A2"}]}'),
        (4, "not json"),
        (5, '{"other": 1}'),
    ], "k int, response string")
    got = {r.k: r.answer for r in chat.extract_answer(df).collect()}
    assert got == {1: "R", 2: chat.EMPTY_ANSWER, 3: "A2", 4: "not json", 5: '{"other": 1}'}


def test_context_edges(spark):
    empty = spark.createDataFrame([], "path string, summarize string")
    r = chat.chat_context(empty).first()
    assert r.context == chat.NO_CONTRACTS_MESSAGE and r.n_contracts == 0
    nulls = spark.createDataFrame([("a", None)], "path string, summarize string")
    assert chat.chat_context(nulls).first().context == ""
    many = spark.createDataFrame([(f"p{i:04d}", "x" * 7) for i in range(3000)], "path string, summarize string")
    c = chat.chat_context(many).first().context
    assert len(c) == 2000 and c.startswith("xxxxxxx\n\nxxxxxxx")


def test_bucketed_sequence_equals_plain_window(spark):
    rnd = random.Random(7)
    rows = []
    for k in range(3):
        t = datetime(2024, 1, 1)
        for i in range(200 if k else 2000):  # key 0 is hot
            t += timedelta(seconds=rnd.randint(0, 50))
            rows.append((k, t, i, rnd.choice("ab"), rnd.randint(1, 9)))
    df = spark.createDataFrame(rows, "key int, ts timestamp, id int, kind string, v int")
    order = F.unix_micros("ts")
    w = Window.partitionBy("key").orderBy("ts", "id")
    for width in (1, 10_000_000, 1 << 40):
        got = neighbour(df, "key", order, ["ts", "id"], ["kind"], "prev", width)
        exp = df.withColumn("prev_kind", F.lag("kind").over(w))
        assert sorted(got.collect()) == sorted(exp.select(got.columns).collect())
        got = neighbour(df, "key", order, ["ts", "id"], ["kind", "v"], "next", width)
        exp = df.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_v", F.lead("v").over(w))
        assert sorted(got.collect()) == sorted(exp.select(got.columns).collect())
        got = running_sum(df, "key", order, ["ts", "id"], "v", "rs", width)
        exp = df.withColumn("rs", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        assert sorted(got.collect()) == sorted(exp.select(got.columns).collect())


def test_collapse_runs_equals_plain_gaps_and_islands(spark):
    from papyra.operators.events import collapse_runs
    rnd = random.Random(11)
    rows, eid = [], 0
    for u in range(3):
        t = datetime(2024, 1, 1)
        for _ in range(1500 if u == 0 else 150):  # user 0 is hot
            t += timedelta(seconds=rnd.choice([0, 1, 30, 400]))
            rows.append((eid, t, u, rnd.choice(["a", "a", "b", None])))
            eid += 1
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    prev = F.lag("event_type").over(w)
    # A NULL type is a type: a, NULL, NULL, b are three runs.
    st = F.when((F.row_number().over(w) == 1) | ~prev.eqNullSafe(F.col("event_type")), 1).otherwise(0)
    ref = (df.withColumn("st", st).withColumn("run_no", F.sum("st").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .groupBy("user_id", "run_no").agg(F.count(F.lit(1)).alias("run_length"),
                                             F.min("event_id").alias("first_event_id")))
    want = sorted((r.user_id, r.run_no, r.run_length, r.first_event_id) for r in ref.collect())
    for width in (1, 60_000_000, 3_600_000_000, 1 << 50):
        got = collapse_runs(df, width=width)
        assert sorted((r.user_id, r.run_no, r.run_length, r.first_event_id) for r in got.collect()) == want


def test_several_exchanges_of_one_conversation_follow_each_other(spark):
    from papyra.operators.chat import append_turn
    h = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    e = spark.createDataFrame([(1, "q2", "a2", 2), (1, "q1", "a1", 1), (2, "q3", "a3", 1)],
                              "conv_id long, question string, answer string, at int")
    got = sorted((r.conv_id, r.turn, r.text) for r in append_turn(h, e, order="at").collect())
    assert got == [(1, 0, "hi"), (1, 1, "q1"), (1, 2, "a1"), (1, 3, "q2"), (1, 4, "a2"), (2, 0, "q3"), (2, 1, "a3")]


def test_one_busy_hour_is_split_by_rows(spark):
    """One session with all rows in one second, and rows without a session: equal shares of the rows, same results."""
    from papyra.functions.sequence import bucketed
    from papyra.operators.events import collapse_runs, track_offsets
    rnd = random.Random(2)
    t = datetime(2024, 1, 1)
    rows = [(1 if i % 20 else None, t + timedelta(microseconds=rnd.randint(0, 500)), i, rnd.choice("ab"), rnd.randint(1, 9)) for i in range(8000)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, event_id int, event_type string, length long")
    cut = bucketed(df, ["user_id"], ["ts", "event_id"], buckets=16)
    sizes = [r["count"] for r in cut.groupBy("_b").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 2 * 8000 / 16
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = (df.withColumn("st", (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type")) | (F.row_number().over(w) == 1)).cast("int"))
            .withColumn("run_no", F.sum("st").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("user_id", "run_no").agg(F.count(F.lit(1)).alias("run_length")))
    got = collapse_runs(df, buckets=16).select("user_id", "run_no", "run_length")
    assert sorted(got.collect(), key=str) == sorted(runs.select(got.columns).collect(), key=str)
    exp = df.withColumn("offset", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = track_offsets(df, "user_id", buckets=16)
    assert sorted(got.collect(), key=str) == sorted(exp.select(got.columns).collect(), key=str)

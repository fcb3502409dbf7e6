from papyra.operators import signals as sig


def test_band_tables():
    assert len(sig.note_bands("music")) == 96
    assert len(sig.note_bands("voice")) == 72
    f = [x for _, x in sig.note_bands()]
    assert f == sorted(f)


def test_pcm_round_trip(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (-0.5,), (0.0,), (0.5,), (1.0,), (3.0,)], "v double")
    got = [r.p for r in df.select(sig.pcm16_quantise(df.v).alias("p")).collect()]
    assert got == [-32768, -32768, -16384, 0, 16383, 32767, 32767]


def test_upsample_edges(spark):
    df = spark.createDataFrame([([],), ([1.0],), ([0.0, 1.0],)], "samples array<double>")
    got = [r.u for r in df.select(sig.upsample(df, 3).alias("u")).collect()]
    assert got[0] is None and got[1] == [1.0, 1.0, 1.0] and got[2] == [0.0, 0.5, 1.0]


def _reference_normalize(data, m, peaks):
    """The stated rule with numpy: bucket ids floor(i * m / n) for m <= n, else linear interpolation at
    positions i * (n - 1) / (m - 1)."""
    import numpy as np
    x = np.asarray(data, dtype=float)
    n = len(x)
    if m <= n:
        ids = np.floor(np.arange(n) * (m / n)).astype(int)
        if peaks:
            out = np.zeros(m)
            np.maximum.at(out, ids, np.abs(x))
            return out.tolist()
        return (np.bincount(ids, weights=np.abs(x), minlength=m) / np.bincount(ids, minlength=m)).tolist()
    return np.interp(np.arange(m) * (n - 1) / (m - 1), np.arange(n), x).tolist()


def test_normalize_matches_rule(spark):
    import random
    rnd = random.Random(9)
    rows = [(k, [rnd.uniform(-1, 1) for _ in range(rnd.randint(1, 40))]) for k in range(30)]
    df = spark.createDataFrame(rows, "k int, samples array<double>")
    for m, peaks in ((7, False), (7, True), (25, False)):
        got = {}
        for r in sig.normalize(df, ["k"], m, peaks).collect():
            got.setdefault(r.k, {})[r.idx] = r.value
        for k, data in rows:
            want = _reference_normalize(data, m, peaks)
            assert [round(got[k][i], 9) for i in range(m)] == [round(w, 9) for w in want], (k, m, peaks)


def test_concat_chunks_keeps_every_channel(spark):
    from papyra.operators.signals import concat_chunks, rechunk
    df = spark.createDataFrame([(c, s, [float(c)] * 70) for c in range(12) for s in range(2)],
                               "channel int, seq int, samples array<double>")
    got = concat_chunks(df)
    assert {r.channel: r["count"] for r in got.groupBy("channel").count().collect()} == {c: 140 for c in range(12)}
    assert rechunk(got).select("channel").distinct().count() == 12


def test_in_row_reduction_matches_the_rules_on_any_length(spark):
    """Bucket and band borders that fall between floating-point numbers, short, empty and NULL signals."""
    import random

    import numpy as np
    rnd = random.Random(1)
    rows = [(k, [rnd.uniform(-100, 0) for _ in range(n)]) for k, n in enumerate([1, 2, 3, 7, 24, 49, 97, 128, 1000, 1023])]
    df = spark.createDataFrame([*rows, (90, []), (91, None)], "k int, samples array<double>")
    for m, peaks in ((1, False), (3, True), (7, False), (49, True), (24, False)):
        got = {}
        for r in sig.downsample(df, ["k"], m, peaks).collect():
            got.setdefault(r.k, {})[r.bucket] = r.value
        for k, data in rows:
            want = _reference_normalize(data, m, peaks)
            assert [round(got[k][i], 9) for i in range(m)] == [round(w, 9) for w in want], (k, m, peaks)
        assert 90 not in got and 91 not in got
    for rate, kind in ((24000.0, "music"), (8000.0, "voice"), (44100.0, "music")):
        bands = sig.note_bands(kind)
        found = {}
        for r in sig.band_peak(df, ["k"], rate, kind, "samples").collect():
            found.setdefault(r.k, {})[r.band] = r.value
        for k, data in [*rows, (90, [])]:
            want = np.full(len(bands), sig.MIN_DB)
            for i, v in enumerate(data):
                f = i * ((1.0 / len(data)) * (rate / 2.0))
                at = max((b for b, (_, x) in enumerate(bands) if f > x), default=None)
                if at is not None:
                    want[at] = max(want[at], v)
            assert [found[k][b] for b in range(len(bands))] == want.tolist(), (k, rate)

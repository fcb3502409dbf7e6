"""Signal operators (S1-S12): the audio page's array math as Spark expressions.

Signals are ``array<float>`` rows or long ``(key, idx, value)`` tables.  Per-signal math that needs random
access (interpolation, band maxima) runs inside the row with higher-order functions (no shuffle); work
that crosses rows (bucket means, channel mixes, chunk concatenation) is a grouped or bucketed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.sequence import running_sum

# ---------------------------------------------------------------------------------------------------------
# The twelve eighth-octave note frequencies (Hz) with their names, the voice range (Hz,
# exclusive), the default decibel window, the PCM scale factors, and frame / batch sizes.
OCTAVE8_FREQUENCIES = [4186.01, 4434.92, 4698.63, 4978.03, 5274.04, 5587.65, 5919.91, 6271.93,
                       6644.88, 7040.0, 7458.62, 7902.13]
OCTAVE8_LABELS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
VOICE_RANGE = (32.0, 2000.0)
MIN_DB, MAX_DB = -100.0, -30.0
PCM_NEG_SCALE, PCM_POS_SCALE = 32768.0, 32767.0
FRAME_SAMPLES = 128
RECORD_CHUNK = 8192
# ---------------------------------------------------------------------------------------------------------


def note_bands(kind: str = "music") -> list[tuple[str, float]]:
    """The band table by rule: octave ``o`` = 1..8 is the eighth octave divided by ``2**(8-o)``;
    ``voice`` keeps the notes strictly inside the voice range (96 notes, 72 voice bands)."""
    bands = [(f"{name}{o}", f / 2 ** (8 - o))
             for o in range(1, 9) for name, f in zip(OCTAVE8_LABELS, OCTAVE8_FREQUENCIES)]
    if kind == "voice":
        bands = [(n, f) for n, f in bands if VOICE_RANGE[0] < f < VOICE_RANGE[1]]
    return bands


def explode_samples(df: DataFrame, keys: list[str], array_col: str = "samples") -> DataFrame:
    """Array rows to long ``(keys..., n, idx, value)`` rows (``value`` as DOUBLE)."""
    return df.select(*keys, F.size(array_col).alias("n"),
                     F.posexplode(array_col).alias("idx", "_v")).select(
        *keys, "n", "idx", F.col("_v").cast("double").alias("value"))


def _bucket_start(b: Column, n: Column, m: int) -> Column:
    """First index ``i`` with ``floor(i * (m / n)) >= b``: the inverse of the bucket rule, mended by one where the
    rule's floating-point product falls on the other side."""
    share = F.lit(float(m)) / n
    guess = F.ceil(b * n / F.lit(float(m))).cast("int")
    return (F.when(F.floor((guess - 1) * share) >= b, guess - 1)
            .when(F.floor(guess * share) >= b, guess).otherwise(guess + 1))


def _bucketed(arr: Column, m: int, peaks: bool) -> Column:
    """``m`` bucket means (or peaks) of the absolute values of ``n >= m`` samples: a slice per bucket, every sample
    read once."""
    n = F.size(arr)
    starts = F.transform(F.sequence(F.lit(0), F.lit(m)), lambda b: F.when(b >= m, n).otherwise(_bucket_start(b, n, m)))

    def value(lo: Column, hi: Column) -> Column:
        part = F.transform(F.slice(arr, lo + 1, hi - lo), lambda v: F.abs(v.cast("double")))
        return F.array_max(part) if peaks else F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / (hi - lo)
    pairs = F.zip_with(F.slice(starts, 1, m), F.slice(starts, 2, m), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    return F.transform(pairs, lambda x: value(x["lo"], x["hi"]))


def resample(df: DataFrame, m: int, peaks: bool = False, array_col: str = "samples") -> Column:
    """S1 + S2: ``n`` values to ``m``, inside the row: bucket ``floor(i * (m / n))`` means (or peaks) of absolute values
    when ``n >= m``, else linear interpolation.  An empty signal gives NULL."""
    arr = F.col(array_col)
    down = F.when(F.size(arr) >= m, _bucketed(arr, m, peaks))
    return down if m < 2 else down.otherwise(upsample(df, m, array_col))


def downsample(signals: DataFrame, keys: list[str], m: int, peaks: bool = False, array_col: str = "samples") -> DataFrame:
    """Every signal as ``m`` rows ``(keys.., bucket, value)``; one of fewer than ``m`` values is interpolated."""
    return normalize(signals, keys, m, peaks, array_col).withColumnRenamed("idx", "bucket")


def upsample(df: DataFrame, m: int, array_col: str = "samples") -> Column:
    """``m > n`` points by linear interpolation at ``i * (n - 1) / (m - 1)`` (no abs); empty input
    gives NULL.  Runs inside the row."""
    if m < 2:
        raise ValueError("upsampling needs m >= 2")
    arr = F.col(array_col)
    n = F.size(arr)

    def point(i: Column) -> Column:
        x = i * (n - 1) / F.lit(m - 1)
        lo, hi = F.floor(x).cast("int"), F.ceil(x).cast("int")
        t = x - lo
        last = F.get(arr, n - 1).cast("double")
        mid = F.get(arr, lo).cast("double") * (F.lit(1.0) - t) + F.get(arr, hi).cast("double") * t
        return F.when(hi >= n, last).otherwise(mid)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), point))


def normalize(signals: DataFrame, keys: list[str], m: int, peaks: bool = False, array_col: str = "samples"
              ) -> DataFrame:
    """S1 + S2 as one operator: long output ``(keys..., idx, value)`` of ``resample``; no shuffle."""
    return signals.select(*keys, F.posexplode(resample(signals, m, peaks, array_col)).alias("idx", "value"))


def bin_frequencies(n: Column, rate: float) -> Column:
    """Frequency of each FFT bin ``i``: ``i * (1/n * rate/2)``."""
    step = (F.lit(1.0) / n) * F.lit(rate / 2.0)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step)


def minmax_clamp(v: Column, lo: float = MIN_DB, hi: float = MAX_DB) -> Column:
    """``(v - lo) / (hi - lo)`` clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least((v - F.lit(lo)) / F.lit(hi - lo), F.lit(1.0)))


def band_peak(spectra: DataFrame, keys: list[str], rate: float, kind: str = "music", db_col: str = "db"
              ) -> DataFrame:
    """S3: each bin goes to the highest band whose frequency is strictly below the bin's; a band's value is
    the max amplitude of its bins (at least ``MIN_DB``); bins under the lowest band are dropped.  Long
    output ``(keys..., band, label, frequency, value, level)``.

    Bins are sorted by frequency, so each band is a slice: the band edges are turned into bin indexes by one division
    each, and every bin is read once."""
    bands = note_bands(kind)
    freqs = F.array(*[F.lit(f) for _, f in bands])
    labels = F.array(*[F.lit(lbl) for lbl, _ in bands])
    db = F.col(db_col)
    n = F.size(db)
    step = (F.lit(1.0) / n) * F.lit(rate / 2.0)

    def first_above(f: Column) -> Column:
        """The first bin whose frequency ``i * step`` is over ``f``."""
        c = F.floor(f / step)
        i = (F.when((c - 1) * step > f, c - 1).when(c * step > f, c).when((c + 1) * step > f, c + 1).otherwise(c + 2))
        return F.least(F.greatest(i, F.lit(0)), n).cast("int")
    edges = F.array_append(F.transform(freqs, first_above), n)
    top = lambda lo, hi: F.greatest(F.lit(MIN_DB), F.coalesce(F.array_max(F.slice(db, lo + 1, hi - lo)).cast("double"),
                                                              F.lit(MIN_DB)))
    found = F.zip_with(F.slice(edges, 1, len(bands)), F.slice(edges, 2, len(bands)), top)
    vals = F.when(n > 0, found).otherwise(F.array_repeat(F.lit(MIN_DB), len(bands)))
    out = spectra.select(*keys, F.posexplode(vals).alias("band", "value"))
    return out.select(*keys, "band", F.get(labels, F.col("band")).alias("label"),
                      F.get(freqs, F.col("band")).alias("frequency"), "value",
                      minmax_clamp(F.col("value")).alias("level"))


def linear_bins(spectra: DataFrame, keys: list[str], rate: float, db_col: str = "db") -> DataFrame:
    """Plain frequency mode: one row per bin with its frequency, ``'%.2f Hz'`` label and level."""
    n = F.size(db_col)
    step = (F.lit(1.0) / n) * F.lit(rate / 2.0)
    x = spectra.select(*keys, step.alias("_step"), F.posexplode(db_col).alias("idx", "value"))
    f = F.col("_step") * F.col("idx")
    return x.select(*keys, "idx", f.alias("frequency"), F.format_string("%.2f Hz", f).alias("label"),
                    F.col("value").cast("double").alias("value"), minmax_clamp(F.col("value")).alias("level"))


def pcm16_quantise(v: Column) -> Column:
    """Clamp to [-1, 1]; negatives scale by 32768, others by 32767; truncate toward zero."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double")))
    return F.when(s < 0, s * F.lit(PCM_NEG_SCALE)).otherwise(s * F.lit(PCM_POS_SCALE)).cast("int")


def pcm16_dequantise(p: Column) -> Column:
    return p.cast("double") / F.lit(PCM_NEG_SCALE)


def mix_channels(long: DataFrame, signal: str = "signal_id") -> DataFrame:
    """S8 (mean): per signal and sample index, the mean over its channels."""
    return long.groupBy(signal, "idx").agg(F.avg("value").alias("value"))


def interleave_channels(long: DataFrame, signal: str = "signal_id", channel: str = "channel") -> DataFrame:
    """S8 (interleave): sample ``i`` of channel ``c`` goes to position ``i * channels + c``."""
    # Channels per signal: a set of at most a few ids, combined map-side (one shuffle, no distinct phase).
    nch = long.groupBy(signal).agg(F.size(F.collect_set(channel)).cast("long").alias("_nch"))
    return long.join(nch, signal).select(
        signal, (F.col("idx") * F.col("_nch") + F.col(channel)).alias("pos"), "value")


def concat_chunks(chunks: DataFrame, channel: str = "channel", seq: str = "seq", array_col: str = "samples",
                  width: int = 1024) -> DataFrame:
    """Chunks in ``seq`` order become one continuous signal per channel (all channels), as long rows
    ``(channel, pos, value)``.  Chunk offsets are a bucketed running sum of chunk lengths, so a channel
    with very many chunks is still spread over many tasks; no signal is ever built as one array."""
    c = chunks.select(channel, seq, array_col, F.size(array_col).cast("long").alias("_len"))
    off = running_sum(c, channel, F.col(seq), [seq], "_len", "_end", width)
    x = off.select(channel, (F.col("_end") - F.col("_len")).alias("_start"),
                   F.posexplode(array_col).alias("idx", "_v"))
    return x.select(channel, (F.col("_start") + F.col("idx")).alias("pos"), F.col("_v").cast("double").alias("value"))


def rechunk(stream: DataFrame, channel: str = "channel", frame: int = FRAME_SAMPLES) -> DataFrame:
    """Fixed frames of ``frame`` samples over each channel's continuous signal; a partial last frame
    is not emitted.  Output ``(channel, frame, slot, value)``."""
    total = stream.groupBy(channel).agg(F.count(F.lit(1)).alias("_n"))
    full = F.floor(F.col("_n") / frame) * frame
    return (stream.join(total, channel).filter(F.col("pos") < full)
            .select(channel, F.floor(F.col("pos") / frame).cast("long").alias("frame"),
                    (F.col("pos") % frame).cast("int").alias("slot"), "value"))


def trim_leading_zeros(long: DataFrame, signal: str = "signal_id", value: str = "value") -> DataFrame:
    """Each signal starts at its first non-zero sample over all channels."""
    start = long.filter(F.col(value) != 0).groupBy(signal).agg(F.min("idx").alias("_start"))
    return long.join(start, signal).filter(F.col("idx") >= F.col("_start")).drop("_start")


def duration_seconds(long: DataFrame, rate: float, signal: str = "signal_id", channel: str = "channel"
                     ) -> DataFrame:
    """16-bit PCM byte count and duration ``bytes / (channels * rate * 2)``."""
    per = long.groupBy(signal).agg(F.size(F.collect_set(channel)).cast("long").alias("n_channels"),
                                   F.count(F.lit(1)).alias("n_samples"))
    n_bytes = F.col("n_samples") * 2
    return per.select(signal, "n_channels", n_bytes.alias("n_bytes"),
                      (n_bytes / (F.col("n_channels") * F.lit(rate) * 2)).alias("duration_s"))

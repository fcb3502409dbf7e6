"""Shared helpers: staged tables, bounded label samples, vectorised word hashing, row-preserving filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.session import scratch_path

_CHUNK = 1 << 20          # bytes hashed at a time, so memory does not follow the length of a text
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` carries (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with null text as the empty text; all other columns are left behind."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def null_safe(a: Iterable[Column], b: Iterable[Column]) -> Column:
    cond = F.lit(True)
    for x, y in zip(a, b, strict=True):
        cond = cond & x.eqNullSafe(y)
    return cond


def labelled_sample(labels: DataFrame, label_col: str, bound: int, id_col: str = "doc_id", graded: bool = False) -> DataFrame:
    """At most ``bound`` (doc_id, label) rows, the same ones on every run: one row per document, null ids and
    null labels left out, several labels for a document decided by their mean (a tie counts as 1).  The label is 0 or 1;
    with ``graded`` it is the mean rounded to a grade (a tie to the upper one, under 0 is 0)."""
    mean = F.avg(F.col(label_col).cast("double"))
    label = F.greatest(F.floor(mean + 0.5), F.lit(0)) if graded else mean >= 0.5
    one = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).alias("doc_id"))
           .agg(label.cast("int").alias("label")))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def one_row_each(rows: DataFrame) -> DataFrame:
    """One row of each doc_id: the one whose text has the least hash (repeated ids are reduced before the shuffle)."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.xxhash64("text")).alias("r")).select("doc_id", "r.*")


def attach_sample(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The documents of a bounded sample with their labels, one row an id: at most as many rows as the sample, which is
    broadcast (its size is its bound)."""
    return one_row_each(docs.join(F.broadcast(sample), "doc_id"))


# ------------------------------------------------------------------------------------------- word hashing

def _word_bytes() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return t


WORD_BYTE = _word_bytes()   # ASCII letters and digits, and every byte of a longer UTF-8 sequence


def _pieces(data: bytes) -> Iterator[np.ndarray]:
    """Byte arrays of about _CHUNK bytes, cut between words."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + _CHUNK)
        while end < n:
            seps = np.flatnonzero(~WORD_BYTE[np.frombuffer(data, np.uint8, min(_CHUNK, n - end), end)])
            if len(seps):
                end += int(seps[0]) + 1
                break
            end = min(n, end + _CHUNK)
        yield np.frombuffer(data, np.uint8, end - start, start)
        start = end


class WordHasher:
    """64-bit hashes of the words of a text (runs of letters and digits, lower-cased), without a loop over words.

    A polynomial rolling hash modulo 2**64: prefix sums give the hash of any span, an odd base has an inverse, so
    a span's value does not depend on where it stands; a final mix spreads the bits.
    """

    def __init__(self) -> None:
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self._up):
            def table(base: int) -> np.ndarray:
                t = np.full(n, base, np.uint64)
                t[0] = 1
                return np.cumprod(t, dtype=np.uint64)
            self._up, self._down = table(_MULT), table(_INV)

    def __call__(self, text: str) -> np.ndarray:
        out = [self._hash(p) for p in _pieces(text.lower().encode("utf-8", "replace"))]
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _hash(self, b: np.ndarray) -> np.ndarray:
        n = len(b)
        self._powers(n + 1)
        word = WORD_BYTE[b]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if n and word[0]:
            edge = np.concatenate(([0], edge))
        if len(edge) % 2:
            edge = np.concatenate((edge, [n]))
        start, end = edge[0::2], edge[1::2]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=total[1:])
        h = (total[end] - total[start]) * self._down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


# ------------------------------------------------------------------------------------------- row operators

def batch_texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The texts of a batch one at a time, null as empty."""
    for v in batch.column(column):
        yield v.as_py() or ""


def filter_batches(docs: DataFrame, text_col: str, keep: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """Rows of ``docs`` whose text passes; all columns pass through unchanged, no shuffle.  ``keep`` is called
    once a task and returns the predicate."""
    index = docs.columns.index(text_col)

    def run(batches):
        test = keep()
        for b in batches:
            yield b.filter(pa.array([test(v.as_py() or "") for v in b.column(index)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)

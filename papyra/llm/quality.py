"""Document quality by a factorisation machine.

Features of a text: its distinct hashed words (value 1 / sqrt of their number), and structure statistics (length,
word and line lengths, shares of capitals, digits, punctuation and repeats, ...) and numeric metadata columns, each
as one bin of a bounded grid.  The score is sigmoid(w0 + w.x + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise term is
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), linear in the features.

Fitting takes a bounded sample of labelled documents (``max_train``, a parameter) outside the held-out fold; every
document is scored over its whole text.  Labels, language, source and id are no features.

Edge cases: null and empty text has structure features only and gets a score; null metadata falls in a bin of its
own; without labels of both kinds the score is the share of good labels (1/2 without any); repeated rows are scored
one by one; extra columns (also ones named like the outputs) are left behind; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import WordHasher, attach_sample, labelled_sample

WORDS = 1 << 17           # hashed word features
BINS = 24                 # bins of a statistic
FACTORS = 8
MAX_TRAIN = 16_384        # documented bound of the labelled sample
THRESHOLD = 0.3
STATS = 16
_STAT_VALUE = 0.35        # value of a statistic's feature: all of them together weigh about as much as the words

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?'\"()-"]] = True
_ODD = np.zeros(256, bool)
_ODD[[c for c in range(33, 127) if not (_STOP[c] or chr(c).isalnum())]] = True


def structure(text: str, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """STATS numbers between 0 and 1; ``words`` are the distinct word hashes and ``counts`` how often each occurs."""
    raw = text.encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    hist = np.bincount(b, minlength=256) if len(b) < 1 << 22 else sum(
        np.bincount(b[i:i + (1 << 22)], minlength=256) for i in range(0, len(b), 1 << 22))
    n, nw = max(len(b), 1), max(int(counts.sum()), 1)
    lines = int(hist[10]) + 1
    spaces, odd = int(hist[_SPACE].sum()), int(hist[_ODD].sum())
    top = np.sort(hist[_ODD])[::-1]
    share = counts / nw
    log = lambda x, most: min(1.0, math.log2(1 + x) / most)                          # noqa: E731
    tenth = np.sort(counts)[::-1][: max(1, len(counts) // 10)].sum() / nw if len(counts) else 0.0
    return np.array([
        log(n, 22), log(nw, 20), min(1.0, (n - spaces) / nw / 16), log(n / lines, 16),
        min(1.0, 4 * hist[_UPPER].sum() / n), min(1.0, 8 * hist[_DIGIT].sum() / n), min(1.0, 8 * odd / n),
        min(1.0, 8 * hist[_STOP].sum() / n), len(words) / nw, float(share.max()) if len(share) else 0.0, tenth,
        float(-(share * np.log2(np.maximum(share, 1e-12))).sum() / max(1.0, math.log2(nw))) if len(share) else 0.0,
        top[0] / max(1, odd), min(1.0, odd / nw), min(1.0, hist[128:].sum() / n), min(1.0, 4 * spaces / n)])


def features(hasher: WordHasher, text: str, meta: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a document."""
    words, counts = np.unique(hasher(text), return_counts=True)
    idx = np.unique(words & np.uint64(WORDS - 1)).astype(np.int64)
    bins = np.minimum((structure(text, words, counts) * BINS).astype(np.int64), BINS - 1)
    extra = [BINS - 1 if v is None or not math.isfinite(v) else min(BINS - 2, int(math.log2(1 + max(v, 0.0))))
             for v in meta]
    stats = WORDS + np.arange(STATS + len(meta)) * BINS + np.concatenate((bins, np.array(extra, np.int64)))
    value = np.concatenate((np.full(len(idx), 1 / math.sqrt(max(1, len(idx)))), np.full(len(stats), _STAT_VALUE)))
    return np.concatenate((idx, stats)), value


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray        # (features,)
    factors: np.ndarray       # (features, FACTORS)

    def margins(self, idx: np.ndarray, value: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of the documents whose features start at ``start``, and their factor sums."""
        v = self.factors[idx] * value[:, None]
        s = np.add.reduceat(v, start, axis=0)
        pairs = 0.5 * (s * s - np.add.reduceat(v * v, start, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[idx] * value, start) + pairs, s


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, np.float64)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], size: int, epochs: int = 6, batch: int = 128, rate: float = 0.1,
        l2: float = 1e-4, seed: int = 5) -> FactorisationMachine:
    """Adagrad on the log loss over (label, indices, values)."""
    rng = np.random.default_rng(seed)
    y = np.array([r[0] for r in rows], float)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    fm = FactorisationMachine(math.log(share / (1 - share)), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)))
    if not len(y) or y.min() == y.max():
        fm.factors[:] = 0
        return fm
    g_lin, g_fac, g_bias = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at:at + batch]]
            idx, val = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part])
            n = np.array([len(r[1]) for r in part])
            start = np.concatenate(([0], np.cumsum(n)[:-1]))
            margin, s = fm.margins(idx, val, start)
            err = np.repeat((_sigmoid(margin) - y[order[at:at + batch]]) / len(part), n)
            uniq, inv = np.unique(idx, return_inverse=True)
            lin = np.bincount(inv, weights=err * val, minlength=len(uniq)) + l2 * fm.linear[uniq] / len(part)
            grad = np.zeros((len(uniq), FACTORS))
            per = (err * val)[:, None] * (np.repeat(s, n, axis=0) - fm.factors[idx] * val[:, None])
            for f in range(FACTORS):
                grad[:, f] = np.bincount(inv, weights=per[:, f], minlength=len(uniq))
            grad += l2 * fm.factors[uniq] / len(part)
            g_lin[uniq] += lin * lin
            g_fac[uniq] += grad * grad
            fm.linear[uniq] -= rate * lin / np.sqrt(g_lin[uniq])
            fm.factors[uniq] -= 0.3 * rate * grad / np.sqrt(g_fac[uniq])
            total = err[start].sum()
            g_bias += total * total
            fm.bias -= 0.3 * rate * total / math.sqrt(g_bias)
    return fm


def _source(docs: DataFrame, id_col: str, text_col: str, metadata: list[str]) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metadata)])


def _batch(hasher: WordHasher, b: pa.RecordBatch, n_meta: int):
    meta = [b.column(f"m{i}") for i in range(n_meta)]
    for i, t in enumerate(b.column("text")):
        yield features(hasher, t.as_py() or "", [m[i].as_py() for m in meta])


def held_out(id_col):
    """The fold that no label is learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          metadata: list[str] | None = None, max_train: int = MAX_TRAIN) -> FactorisationMachine:
    metadata = metadata or []
    n_meta = len(metadata)
    size = WORDS + (STATS + n_meta) * BINS
    sample = labelled_sample(labels.filter(~held_out(F.col(id_col))), label_col, max_train, id_col)

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            got = list(_batch(hasher, b, n_meta))
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())], names=["label", "idx", "val"])
    rows = (attach_sample(_source(docs, id_col, text_col, metadata), sample)
            .select("label", "text", *[f"m{i}" for i in range(n_meta)])
            .mapInArrow(run, "label int, idx binary, val binary").collect())          # at most max_train documents
    rows = sorted((r.label, bytes(r.idx), bytes(r.val)) for r in rows)
    return fit([(y, np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float))
                for y, i, v in rows], size)


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text",
          metadata: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    metadata = metadata or []
    n_meta = len(metadata)
    small = FactorisationMachine(model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32))
    src = _source(docs, id_col, text_col, metadata)

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            out = np.zeros(len(b))
            for i, (idx, val) in enumerate(_batch(hasher, b, n_meta)):
                out[i] = small.margins(idx, val, np.zeros(1, np.int64))[0][0]
            p = _sigmoid(out)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])
    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, score double, predicted int").select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")

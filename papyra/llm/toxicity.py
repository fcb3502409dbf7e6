"""Toxicity grades by cumulative-link (proportional odds) regression on sparse word features.

One weight per word is shared by all grade thresholds: P(grade > k) = sigmoid(w.x - theta_k) with
theta_0 < theta_1 < ...; the expected severity is the sum of these probabilities.  A word is identified by its
full 64-bit hash (no feature collisions) and x is log(1 + count) over the whole text.

Fitting uses a bounded sample of labelled documents (``max_train``, a parameter); features are the words whose
document frequency differs between the classes by a clear margin, so an unknown word weighs nothing and clean
text keeps its distance from the threshold.  Copies in the sample share one vote (same six smallest word hashes).

Edge cases: null or empty text has no words and gets the intercept's grade, 0; without any toxic or any clean
label the model is empty and every document gets severity 0; repeated rows are scored one by one; extra columns
(also ones named like the outputs) are left behind by ``score`` and pass through ``keep_clean`` unchanged; an
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import WordHasher, attach_sample, batch_texts, filter_batches, labelled_sample, texts

GRADES = 4                # 0 clean, 1 mild, 2 marked, 3 severe
MAX_TRAIN = 12_000        # documented bound of the labelled sample the model is fitted on
REJECT_AT = 0.25          # probability of any toxicity from which a document is rejected
OUT = "severity double, grade int, p_toxic double, p_marked double, p_severe double, toxic int"


@dataclass
class OrdinalModel:
    keys: np.ndarray      # sorted word hashes
    weights: np.ndarray
    thetas: np.ndarray    # ascending, one per threshold

    def margin(self, words: np.ndarray) -> float:
        if not len(self.keys) or not len(words):
            return 0.0
        at = np.searchsorted(self.keys, words)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == words]
        if not len(at):
            return 0.0
        ids, n = np.unique(at, return_counts=True)
        return float(np.dot(self.weights[ids], np.log1p(n)))

    def exceed(self, words: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return _sigmoid(self.margin(words) - self.thetas)


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, dtype=np.float64)))


# ------------------------------------------------------------------------------------------------ training

def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, max_train: int) -> DataFrame:
    """(label, keys, counts): the distinct word hashes of each sampled document and how often each occurs."""
    def run(batches):
        hasher = WordHasher()
        for b in batches:
            keys, counts = [], []
            for text in batch_texts(b, "text"):
                k, n = np.unique(hasher(text), return_counts=True)
                keys.append(k.tobytes())
                counts.append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                names=["label", "keys", "counts"])
    sample = attach_sample(texts(docs), labelled_sample(labels, label_col, max_train, graded=True))
    return sample.select("label", "text").mapInArrow(run, "label int, keys binary, counts binary")


def _select(rows: list[tuple[int, np.ndarray, np.ndarray]], min_support: float, min_z: float):
    """Words whose weighted document frequency differs clearly between toxic and clean; and their log odds."""
    sizes: dict[bytes, int] = {}
    marks = [k[:6].tobytes() for _, k, _ in rows]      # keys are sorted: the six smallest hashes mark near copies
    for m in marks:
        sizes[m] = sizes.get(m, 0) + 1
    vote = np.array([1.0 / sizes[m] for m in marks])
    y = np.array([r[0] for r in rows]) > 0
    n1, n0 = vote[y].sum(), vote[~y].sum()
    vocab, inv = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    d1 = np.bincount(inv, weights=vote[doc] * y[doc], minlength=len(vocab))
    d0 = np.bincount(inv, weights=vote[doc] * ~y[doc], minlength=len(vocab))
    pooled = (d1 + d0 + 1) / (n1 + n0 + 2)
    z = (d1 / n1 - d0 / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    odds = np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1))
    chosen = (np.abs(z) >= min_z) & (np.maximum(d1 / n1, d0 / n0) >= min_support) & (np.abs(odds) >= np.log(2))
    return vocab, inv, doc, vote, y, chosen, odds


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int = GRADES, min_support: float = 0.005,
        min_z: float = 5.0, steps: int = 400, l2: float = 1e-5) -> OrdinalModel:
    """Fit on (label, word hashes, counts).  A label of 0 is grade 0.  If the labels hold only two classes the
    toxic documents are graded 1.. by how many clearly toxic words they hold, cut at equal shares; labels that are
    grades already (any label above 1) are taken as they are."""
    labels = np.array([r[0] for r in rows], dtype=int)
    flat = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), 50.0 + np.arange(grades - 1))
    if not (labels > 0).any() or (labels > 0).all():
        return flat
    vocab, inv, doc, vote, _, chosen, odds = _select(rows, min_support, min_z)
    count = np.concatenate([r[2] for r in rows]).astype(np.float64)
    hit = chosen[inv]
    column = np.cumsum(chosen) - 1
    r, c, x = doc[hit], column[inv[hit]], np.log1p(count[hit])
    if labels.max() > 1:
        y = np.minimum(labels, grades - 1)
    else:
        strong = (odds[inv[hit]] >= np.log(8)) * count[hit]
        hits = np.bincount(r, weights=strong, minlength=len(rows))
        seen = hits[(labels > 0) & (hits > 0)]
        cuts = np.quantile(seen, np.arange(1, grades - 1) / (grades - 1)) if len(seen) else np.full(grades - 2, np.inf)
        y = np.where(labels > 0, 1 + (hits[:, None] > cuts[None, :]).sum(axis=1), 0)
    return _ascend(vocab[chosen], r, c, x, y, vote, grades, steps, l2)


def _ascend(keys, r, c, x, y, vote, grades, steps, l2) -> OrdinalModel:
    """Adam on the cumulative-link likelihood; thresholds stay ordered as a start plus exponentials."""
    n, m, k = len(y), len(keys), grades - 1
    p = np.concatenate((np.zeros(m), [2.0], np.zeros(k - 1)))       # weights, theta_0, log gaps
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    vote = vote / vote.sum()
    rows = np.arange(n)
    for step in range(1, steps + 1):
        theta = p[m] + np.concatenate(([0.0], np.cumsum(np.exp(p[m + 1:]))))
        eta = np.bincount(r, weights=x * p[c], minlength=n) if len(r) else np.zeros(n)
        above = _sigmoid(eta[:, None] - theta[None, :])              # P(y > k)
        full = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
        prob = np.maximum(full[rows, y] - full[rows, y + 1], 1e-12)
        slope = np.concatenate((np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))), axis=1)
        upper, lower = slope[rows, y], slope[rows, y + 1]
        d_eta = vote * (upper - lower) / prob
        d_theta = np.zeros(k + 2)
        np.add.at(d_theta, y, -vote * upper / prob)
        np.add.at(d_theta, y + 1, vote * lower / prob)
        d_theta = d_theta[1:-1]
        tail = np.cumsum(d_theta[::-1])[::-1]
        g = np.concatenate(((np.bincount(c, weights=x * d_eta[r], minlength=m) if m else np.zeros(0)) - l2 * p[:m],
                            [tail[0]], tail[1:] * np.exp(p[m + 1:])))
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        p = p + 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    theta = p[m] + np.concatenate(([0.0], np.cumsum(np.exp(p[m + 1:]))))
    return OrdinalModel(keys, p[:m], theta)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_train: int = MAX_TRAIN) -> OrdinalModel:
    rows = training_rows(docs, labels, label_col, max_train).collect()      # at most max_train rows
    rows = sorted((r.label, bytes(r["keys"]), bytes(r.counts)) for r in rows)
    return fit([(a, np.frombuffer(k, np.uint64), np.frombuffer(n, np.int32)) for a, k, n in rows])


# ------------------------------------------------------------------------------------------------- scoring

def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text",
          reject_at: float = REJECT_AT) -> DataFrame:
    """One row per document: severity (expected grade), grade (largest k with P(grade >= k) >= 1/2), the
    probabilities of at least grade 1, 2 and 3, and toxic (1: rejected)."""
    def run(batches):
        hasher = WordHasher()
        for b in batches:
            p = np.array([model.exceed(hasher(t)) for t in batch_texts(b, "text")]).reshape(len(b), -1)
            cols = [pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32))]
            cols += [pa.array(np.ascontiguousarray(p[:, i])) for i in range(3)]
            cols += [pa.array((p[:, 0] >= reject_at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=[
                "doc_id", "severity", "grade", "p_toxic", "p_marked", "p_severe", "toxic"])
    src = texts(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, {OUT}")


def keep_clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text",
               reject_at: float = REJECT_AT) -> DataFrame:
    """The rows whose probability of any toxicity is under ``reject_at``, with all their columns."""
    def make():
        hasher = WordHasher()
        return lambda text: bool(model.exceed(hasher(text))[0] < reject_at)
    return filter_batches(docs, text_col, make)

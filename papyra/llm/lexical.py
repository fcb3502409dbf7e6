"""Ranked lexical search: accumulator-limited, term at a time, over blocks of documents.

Every document becomes one row of a forward index: its number of terms and how often each term of the query set occurs
in it.  The corpus statistics (documents, terms, document frequencies) are aggregated from that table.  Then each task
inverts its documents block by block and evaluates each item over the block:

1. the item's terms are taken rarest first;
2. while the sum of the bounds of the terms still to come can reach the score of the k-th best document known so far,
   every document of a term's list gets an accumulator; a term's bound is its weight times its greatest impact in the
   block;
3. once that sum is under the k-th score, no accumulator is created any more: a document without one cannot enter the
   ranking, ties included.  The remaining terms only update the accumulators that exist, exactly; accumulators whose
   score plus the remaining bounds stays under the k-th score are given up.

The k-th score is one that k documents have reached for certain (partial scores only grow), carried from block to
block of a task.  A task returns its k best rows an item; the k best of those are the ranking.  No list of postings
and no score is shuffled: what leaves a task is bounded by items times k.

The query set is a stated one: it is read in blocks of at most ``ITEM_TERMS`` (item, term) rows, and each block takes
one pass over the documents.

Score, in 64-bit integers but for the weight's logarithm: a term weighs floor(1000 * ln((2N + 2) / (2df + 1))); a
document of n terms has m = 25 + (75 * n * N) div L; an occurrence of the term in the item adds
weight * ((10**9 * tf) div (1000 * tf + 8 * m)).

Edge cases: null text has no terms and is neither ranked nor counted in N; an item without terms, or none of whose
terms occurs, has no rows; each row of the items is an item of its own, rows repeated with one id are ranked each;
every row of the documents is ranked, also rows repeated with one id; equal scores go by ascending id, null ids last;
extra columns are left behind; empty tables give an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.llm.common import stage

TOP = 10
ITEM_TERMS = 200_000          # (item, term) rows that one pass over the documents answers
BLOCK_DOCS = 10_000
_PIECE = 1 << 22
# ASCII letters (A-Z lower-cased) and digits, and every byte of a longer UTF-8 sequence, belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(data: bytes):
    """The terms of a text (UTF-8), in lists of bounded length."""
    start = 0
    while start < len(data):
        end = min(len(data), start + _PIECE)
        while end < len(data) and _FOLD[data[end]] != 32:
            end += 1
        yield data[start:end].translate(_FOLD).split()
        start = end


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, times): the distinct terms of each row of ``items``; ``item`` numbers the rows."""
    src = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                n = Counter()
                for part in terms(b.column("text")[i].as_py()):
                    n.update(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(b.column("item")[i], len(n)), pa.repeat(b.column("item_id")[i], len(n)),
                     pa.array([t.decode() for t in n], pa.string()), pa.array(list(n.values()), pa.int64())],
                    names=["item", "item_id", "term", "times"])
    kind = dict(src.dtypes)["item_id"]
    return src.mapInArrow(run, f"item long, item_id {kind}, term string, times long")


# ------------------------------------------------------------------------------------------- forward index

def forward_index(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, term, tf): the number of terms of every document that has one, and the positions in ``vocabulary``
    and frequencies of those that the vocabulary holds.  One pass, no shuffle."""
    src = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"),
                                                          F.col(text_col).cast("binary").alias("text"))
    place = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})

    def run(batches):
        get = place.value.get
        for b in batches:
            size, offsets, term, tf = [], [0], [], []
            for v in b.column("text"):
                n, found = 0, Counter()
                for part in terms(v.as_py()):
                    n += len(part)
                    found.update(map(get, part))
                found.pop(None, None)
                size.append(n)
                term += found.keys()
                tf += found.values()
                offsets.append(len(term))
            at = pa.array(offsets, pa.int32())
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.ListArray.from_arrays(at, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], names=["doc_id", "n", "term", "tf"])
            yield out.filter(pa.array(np.array(size, np.int64) > 0))
    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, n long, term array<int>, tf array<long>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of each document: 25 + (75 * n * documents) div total, also where the product is over 64 bits."""
    safe = n <= (2**63 - 1) // (75 * documents)
    m = 25 + np.where(safe, n, 0) * (75 * documents) // total
    for i in np.flatnonzero(~safe):
        m[i] = 25 + 75 * int(n[i]) * documents // total
    return m


# ------------------------------------------------------------------------------------------- evaluation

class Block:
    """The postings of a block of documents: by term, the documents and the impact of the term in each."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        order = np.argsort(term, kind="stable")
        term, self.doc, tf = term[order], doc[order], tf[order]
        self.impact = (10**9 * tf) // (1000 * tf + 8 * m[self.doc])
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, int)
        ends = np.append(first[1:], len(term))
        self.lists = {int(term[s]): (int(s), int(e)) for s, e in zip(first, ends)}
        self.most = {int(term[s]): int(self.impact[s:e].max()) for s, e in zip(first, ends)}
        self.size = len(m)


def evaluate(block: Block, query: list[tuple[int, int]], kth: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the block that may enter the ranking.  ``query``: (term, weight times occurrences in the
    item), rarest first; ``kth``: a score that ``top`` documents have, or 0."""
    query = [(t, q) for t, q in query if q > 0 and t in block.lists]
    bounds = [q * block.most[t] for t, q in query]
    left = sum(bounds)
    score = np.zeros(block.size, np.int64)
    alive = np.zeros(block.size, bool)
    creating = True
    for (t, q), bound in zip(query, bounds):
        s, e = block.lists[t]
        doc, gain = block.doc[s:e], q * block.impact[s:e]
        if creating and left < kth:
            creating = False
        if creating:
            alive[doc] = True
            score[doc] += gain
        else:
            kept = alive[doc]
            score[doc[kept]] += gain[kept]
        left -= bound
        now = score[alive]
        if len(now) >= top:
            kth = max(kth, int(np.partition(now, len(now) - top)[len(now) - top]))
        if not creating:
            alive &= score + left >= kth
    found = np.flatnonzero(alive & (score > 0))
    return found, score[found]


def _order(row):
    return -row[0], row[1] is None, row[1]


def rank_task(queries: list[list[tuple[int, int]]], documents: int, total: int, top: int, block_docs: int):
    """The task: (query, score, doc_id), the ``top`` best documents of the task's rows for each query."""
    def run(batches):
        best: list[list] = [[] for _ in queries.value]
        for batch in batches:
            for i in range(0, batch.num_rows, block_docs):
                b = batch.slice(i, block_docs)
                term, tf = b.column("term"), b.column("tf")
                per = np.diff(term.offsets.to_numpy())
                block = Block(term.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), per), tf.flatten().to_numpy(),
                              lengths(b.column("n").to_numpy(), documents, total))
                ids = b.column("doc_id")
                for k, query in enumerate(queries.value):
                    kth = best[k][top - 1][0] if len(best[k]) >= top else 0
                    doc, score = evaluate(block, query, kth, top)
                    if len(doc) > top:                     # ties with the last place stay until ids decide
                        least = np.partition(score, len(score) - top)[len(score) - top]
                        doc, score = doc[score >= least], score[score >= least]
                    if len(doc):
                        own = ((int(s), ids[int(d)].as_py()) for d, s in zip(doc, score))
                        best[k] = heapq.nsmallest(top, [*best[k], *own], key=_order)
        rows = [(k, s, d) for k, found in enumerate(best) for s, d in found]
        if rows:
            k, s, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(d, ids.type)],
                                             names=["query", "score", "doc_id"])
    return run


def _pass(docs: DataFrame, block: list, id_col: str, text_col: str, top: int, block_docs: int) -> DataFrame:
    """(item, score, doc_id) for one block of items, given as rows of ``item_terms``."""
    spark = docs.sparkSession
    vocabulary = sorted({r["term"] for r in block})
    index = stage(forward_index(docs, vocabulary, id_col, text_col), "forward-index")
    n = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
    documents, total = n["documents"], n["total"] or 1
    holding = {r["term"]: r["count"] for r in index.select(F.explode("term").alias("term")).groupBy("term").count().collect()}
    place = {t: i for i, t in enumerate(vocabulary)}
    by_item: dict[int, list] = {}
    for r in block:
        at = place[r["term"]]
        by_item.setdefault(r["item"], []).append((holding.get(at, 0), at, r["times"]))
    items = sorted(by_item)
    queries = [[(at, weight(documents, df) * times) for df, at, times in sorted(by_item[i]) if df] for i in items]
    sent = spark.sparkContext.broadcast(queries)
    kind = dict(index.dtypes)["doc_id"]
    found = index.mapInArrow(rank_task(sent, documents, total, top, block_docs), f"query int, score long, doc_id {kind}")
    names = spark.createDataFrame(list(enumerate(items)), "query int, item long")
    return stage(found.join(names, "query").select("item", "score", "doc_id"), "ranked")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP, item_rows: int = ITEM_TERMS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score above 0."""
    wanted = stage(item_terms(items, item_id, item_text), "item-terms")
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    found = docs.sparkSession.createDataFrame([], f"item long, score long, doc_id {kind}")
    # Items are numbered by partition and row; blocks of whole items follow that order.
    sizes = wanted.groupBy("item").count().orderBy("item")
    first, rows = None, 0
    blocks: list[tuple[int, int]] = []
    for r in sizes.toLocalIterator():
        if first is None or rows + r["count"] > item_rows:
            first, rows = r["item"], 0
            blocks.append((first, first))
        rows += r["count"]
        blocks[-1] = (first, r["item"])
    for low, high in blocks:
        block = wanted.filter(F.col("item").between(low, high)).select("item", "term", "times").collect()
        found = found.unionByName(_pass(docs, block, id_col, text_col, top, block_docs))
    place = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= top)
    names = wanted.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")

"""Harmonic packing of tokenised documents into fixed-length sequences.

A document's ids (and a closing id) are cut into pieces: whole sequences first, then the largest powers of two down
to ``min_cut``, then a rest below it.  A piece of length l belongs to class k = capacity // l (lengths in
(capacity / (k + 1), capacity / k]), and a bin of class k takes exactly k pieces, whichever they are.  Pieces are
dealt into buckets of bounded size by a hash, each (class, bucket) is filled on its own, and the bin of a piece
follows from its number in it: workers share nothing.  Powers of two divide the capacity, so their bins are full;
only rests (below ``min_cut``) leave padding.  The pieces of bins that a bucket could not fill (fewer than k a class)
are placed first-fit by falling length, one small group a bucket.

``sequence_id`` numbers (bucket, class, bin) without a count over all: bucket * 2^40 + class * 2^29 + bin, which
leaves room for 8 million buckets (2.6 * 10^11 pieces) of up to 5 * 10^8 bins a class.

Tokenisation goes chunk by chunk: byte-level BPE never merges across a space that a visible character follows, so
a text is split there and each distinct chunk is encoded once while a task remembers it (a bounded memory; a worker
process keeps the tokenizer alone from task to task).  The ids are kept as little-endian bytes, joined, and checksummed;
token ids never leave the task.

Edge cases: null or empty text is the closing id alone; repeated rows (and documents that a mixture repeats) are
packed each on their own; a null id is kept; extra columns are left behind; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.llm.common import stage, texts

CAPACITY = 1024
MIN_CUT = 64
END_ID = 0
BUCKET_PIECES = 32_000
BUCKET_SHIFT, CLASS_SHIFT, CLASS_MASK = 40, 29, 0x7FF      # of sequence_id
_MEMORY = 500_000         # chunks in a generation of a task's memory
_LONG = 64                # longer chunks are not remembered
_GROUP = 1 << 23          # bytes of a group of texts
_JOINED = 100             # chunks encoded as one string
_BREAK = re.compile(r" (?=\S)")
# Texts that are not cut at every space: some space stands before white space or at the end, or a special token, which
# ends a run of spaces, may occur.
_UNEVEN = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)|<\|"


class TextIds:
    """Texts -> their ids (bytes), equal to encoding each whole text at once.

    Arrow cuts a group of texts into chunks and finds the distinct ones; only those become Python strings.  The unknown
    ones are encoded in concatenations of ``_JOINED``: no id crosses a chunk, so the byte lengths of the ids tell where
    each chunk ends.  Known chunks are kept in two generations; when the young one is full it becomes the old one, and
    a chunk met again moves back.  The ids of all chunks are then gathered by the chunks' numbers.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        self._encode, self._encode_all = tokenizer.encode, tokenizer.encode_batch_fast
        self._young, self._old = {}, {}
        vocab = tokenizer.get_vocab()
        self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, number in vocab.items():      # a byte-level token is spelled with one character a byte
            self._bytes[number] = len(token)

    def forget(self) -> None:
        """Drop the remembered chunks: what a worker keeps between tasks is the tokenizer."""
        self._young, self._old = {}, {}

    def _ids(self, text: str) -> bytes:
        return np.array(self._encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    def _learn(self, chunks: set[str]) -> None:
        known = chunks & self._old.keys()
        self._young.update((c, self._old[c]) for c in known)
        fresh = list(chunks - known)
        if not fresh:
            return
        joined = [" " + " ".join(fresh[i:i + _JOINED]) for i in range(0, len(fresh), _JOINED)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self._encode_all(joined, add_special_tokens=False)])
        at = np.cumsum(self._bytes[ids])
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, fresh)), np.int64, len(fresh)) + 1)
        stop = np.searchsorted(at, ends)
        if not np.array_equal(at[np.minimum(stop, len(at) - 1)], ends):
            raise ValueError("the tokenizer is not byte-level: its ids do not spell the text")
        data, cuts = ids.tobytes(), [0, *(4 * (stop + 1)).tolist()]
        self._young.update(zip(fresh, map(data.__getitem__, map(slice, cuts, cuts[1:]))))

    def _chunk_ids(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct chunks, each with the space before it."""
        young = self._young
        found = list(map(young.get, distinct))
        new = {c for c, ids in zip(distinct, found) if ids is None}
        self._learn(new)
        if new:
            found = list(map(young.__getitem__, distinct))
        for c in new:
            if len(c) > _LONG:
                del young[c]
        if len(young) >= _MEMORY:
            self._old, self._young = young, {}
        return found

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of a group of texts, none of them null."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        uneven = np.flatnonzero(pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(texts, " ")
        if len(uneven):
            cut = lists.to_pylist()
            for k in uneven.tolist():
                t = texts[k].as_py()
                cut[k] = [t] if "<|" in t else _BREAK.split(t)
            lists = pa.array(cut, pa.list_(pa.string()))
        heads = pc.list_element(lists, 0).to_pylist()
        rest = pc.list_slice(lists, 1)
        coded = rest.flatten().dictionary_encode()
        found = self._chunk_ids(coded.dictionary.to_pylist())
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(found))])
        all_ids = table.take(coded.indices)
        data = memoryview(all_ids.buffers()[2] or b"")
        at = np.frombuffer(all_ids.buffers()[1], np.int64)[all_ids.offset:] if len(all_ids) else np.zeros(1, np.int64)
        first = np.concatenate(([0], np.cumsum(pc.list_value_length(rest).to_numpy())))
        cuts = at[first].tolist()
        return [self._ids(h) + data[a:b] for h, a, b in zip(heads, cuts, cuts[1:])]


def text_ids(path: str) -> TextIds:
    """The worker process's own ``TextIds`` of a tokenizer: workers serve many tasks, and the file is read once."""
    state = sys.modules.setdefault("papyra_worker_state", types.ModuleType("papyra_worker_state"))
    kept = state.__dict__.setdefault("text_ids", {})
    if path not in kept:
        kept.clear()
        kept[path] = TextIds(path)
    return kept[path]


def _groups(batch: pa.RecordBatch):
    """The texts of a batch in groups of about ``_GROUP`` bytes, null as empty."""
    texts = pc.fill_null(batch.column("text"), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(size[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + _GROUP, "right")))
        yield texts.slice(start, end - start)
        start = end


def cut(n: int, capacity: int = CAPACITY, min_cut: int = MIN_CUT) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, falling powers of two, a rest below ``min_cut``."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    size = 1 << max(rest.bit_length() - 1, 0)
    while rest >= min_cut:
        if size <= rest:
            out.append(size)
            rest -= size
        size >>= 1
    if rest:
        out.append(rest)
    return out


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, min_cut: int = MIN_CUT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), a row per piece."""
    src = texts(docs, id_col, text_col)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids_of = text_ids(tokenizer_path)
        for b in batches:
            doc, start, length, crc, total = [], [], [], [], []
            for row, known in enumerate(chain.from_iterable(ids_of(group) for group in _groups(b))):
                ids = memoryview(known + end)
                n, at = len(ids) // 4, 0
                for size in cut(n, capacity, min_cut):
                    doc.append(row)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    total.append(n)
                    at += size
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        ids_of.forget()
    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def _first_fit(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_tokens", "start"], ascending=[False, True, True, True], kind="stable")
        room = np.zeros(0, np.int64)
        bins, offsets = [], []
        for size in pdf["length"].tolist():
            fit = np.flatnonzero(room >= size)
            if not len(fit):
                room = np.append(room, capacity)
                fit = [len(room) - 1]
            at = int(fit[0])
            bins.append(at)
            offsets.append(capacity - int(room[at]))
            room[at] -= size
        return pdf.assign(bin=bins, offset=offsets)
    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         min_cut: int = MIN_CUT, end_id: int = END_ID, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cuts = stage(pieces(docs, tokenizer_path, id_col, text_col, capacity, min_cut, end_id), "pieces")
    return place(cuts, capacity, bucket_pieces)


def place(cuts: DataFrame, capacity: int = CAPACITY, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    buckets = max(1, -(-cuts.count() // bucket_pieces))
    keyed = (cuts.withColumn("class", F.floor(F.lit(capacity) / F.col("length")).cast("long"))
             .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("long")))
    group = W.partitionBy("class", "bucket")
    order = group.orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = stage(keyed.withColumn("nth", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(group))
                     .withColumn("bin", F.floor(F.col("nth") / F.col("class")))
                     .withColumn("full", F.col("bin") < F.floor(F.col("n") / F.col("class"))), "numbered")
    # nth orders a bin's pieces on its own; the offset is the running length of the pieces before.
    in_bin = W.partitionBy("class", "bucket", "bin").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = (numbered.filter("full").withColumn("offset", F.sum("length").over(in_bin) - F.col("length"))
             .select(*columns, _sequence("bucket", "class", "bin"), "offset"))
    kind = dict(cuts.dtypes)["doc_id"]
    left = (numbered.filter("not full").select("bucket", *columns).groupBy("bucket").applyInPandas(
        _first_fit(capacity), f"bucket long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                              "bin long, offset long").withColumn("class", F.lit(0).cast("long")))
    return whole.unionByName(left.select(*columns, _sequence("bucket", "class", "bin"), "offset"))


def _sequence(bucket: str, klass: str, number: str):
    return (F.shiftleft(F.col(bucket), BUCKET_SHIFT) + F.shiftleft(F.col(klass), CLASS_SHIFT) + F.col(number)).cast("long").alias("sequence_id")

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance d meet in a value that lies within half of d of each.  For a maximum of three
bits, half is one and a half: balls of radius one reach only two bits, balls of radius two hold 2,081 values each.
So the bits are dealt into three blocks and each block is left out in turn: a pair that differs in three bits differs
in at most two of the bits that remain once a block with a difference is out, and there radius one is enough.  Every
distinct fingerprint emits its variants within radius one in the three views (about 130 rows instead of 2,081), the
rows are shuffled by (view, variant), and fingerprints that meet are verified on all 64 bits.

General form: a maximum of m bits uses m // 2 as the radius when m is even (one view, no block left out) and
(m - 1) // 2 with three views when m is odd.

Equal fingerprints are one node (however many documents share it); a node costs the same number of rows whatever its
weight.  Fingerprints that meet in one variant are compared in blocks inside their task, and only the links that
connect them (not all pairs) leave it: a spanning forest, which keeps every component whole.

Edge cases: null or empty text, or text of white space, has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle; a null id is a document like any other, and the component's id is its
least id that is not null (null if there is none); repeated rows share a component; extra columns are left behind by
``near_duplicates`` and pass through ``keep_first``; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import batch_texts, free_name, null_safe, stage, texts
from papyra.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
_CHUNK = 1 << 22          # bytes of a text that are split into words at a time


def _pieces(data: bytes):
    """``data`` in pieces of about _CHUNK bytes that end before white space."""
    start = 0
    while start < len(data):
        end = min(len(data), start + _CHUNK)
        while end < len(data) and data[end:end + 1] not in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"):
            end += 1
        yield data[start:end]
        start = end


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 values."""
    digest = xxhash.xxh64_intdigest
    ones, total, tail, first = np.zeros(64, np.int64), 0, [], True
    for piece in _pieces(text.encode("utf-8", "replace").lower()):     # bytes.lower: A-Z only
        words = tail + piece.split()                                    # bytes.split: exactly the six characters
        tail = words[-(shingle - 1):] if shingle > 1 else []
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        end = (start + size)[shingle - 1:]
        h = np.array([digest(joined[a:b], seed) for a, b in zip(start.tolist(), end.tolist())], np.uint64)
        ones += _ones(h)
        total += len(h)
    if not total:
        if not tail:
            return 0
        return digest(b" ".join(tail), seed)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def _ones(h: np.ndarray) -> np.ndarray:
    """How many values have each bit, most significant first."""
    out = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = np.ascontiguousarray(h[i:i + 65_536].astype(">u8")).view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp): a hash of the text, and the fingerprint as a signed 64-bit integer."""
    src = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch_texts(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fp)],
                                             names=["doc_id", "h", "fp"])
    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, h long, fp long")


# ------------------------------------------------------------------------------------------- links

def _views(max_bits: int) -> list[np.ndarray]:
    """The bits that each view keeps."""
    every = np.arange(64)
    if max_bits % 2 == 0:
        return [every]
    return [np.setdiff1d(every, block) for block in np.array_split(every, 3)]


def _offsets(bits: np.ndarray, radius: int) -> np.ndarray:
    """XOR masks of the ball of this radius over ``bits``."""
    one = np.uint64(1) << bits.astype(np.uint64)
    masks = [np.zeros(1, np.uint64)]
    last = [(np.uint64(0), -1)]
    for _ in range(radius):
        last = [(m | one[j], j) for m, i in last for j in range(i + 1, len(bits))]
        masks.append(np.array([m for m, _ in last], np.uint64))
    return np.concatenate(masks)


def _variants(max_bits: int):
    views = _views(max_bits)
    keep = [np.bitwise_or.reduce(np.uint64(1) << v.astype(np.uint64)) for v in views]
    offsets = [_offsets(v, max_bits // 2) for v in views]

    def run(batches):
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fps), 2_000):          # rows out of one call stay bounded
                part = fps[i:i + 2_000]
                for v, (mask, off) in enumerate(zip(keep, offsets, strict=True)):
                    ball = ((part & mask)[:, None] ^ off[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ball), v, np.int8)), pa.array(ball.view(np.int64)),
                         pa.array(np.repeat(part, len(off)).view(np.int64))], names=["view", "variant", "fp"])
    return run


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``fps``: fewer than there are fingerprints."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    out = []
    for i in range(1, len(fps)):
        for j0 in range(0, i, 65_536):
            near = np.flatnonzero(np.bitwise_count(fps[j0:min(i, j0 + 65_536)] ^ fps[i]) <= max_bits) + j0
            for j in near.tolist() if len(near) < 8 else near[np.unique(root[near], return_index=True)[1]].tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((i, j))
    return out


def _meet(max_bits: int):
    """Links among the rows of a partition that is dealt by (view, variant)."""
    def run(batches):
        held = [(b.column("view").to_numpy(), b.column("variant").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if not held:
            return
        view, variant, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((variant, view))
        view, variant, fp = view[order], variant[order], fp[order].view(np.uint64)
        new = np.flatnonzero(np.concatenate(([True], (variant[1:] != variant[:-1]) | (view[1:] != view[:-1]))))
        size = np.diff(np.concatenate((new, [len(fp)])))
        pair = new[size == 2]
        x, y = fp[pair], fp[pair + 1]
        near = np.bitwise_count(x ^ y) <= max_bits
        a, b = [x[near]], [y[near]]
        seen: set[bytes] = set()
        for s, n in zip(new[size > 2].tolist(), size[size > 2].tolist()):
            group = np.sort(fp[s:s + n])
            mark = group.tobytes() if n <= 64 else xxhash.xxh128_digest(group.tobytes())
            if mark in seen:
                continue                                  # the same fingerprints meet in many variants
            seen.add(mark)
            links = _forest(group, max_bits)
            if links:
                ij = np.array(links)
                a.append(group[ij[:, 0]])
                b.append(group[ij[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy().view(np.int64)),
                                          pa.array(both[:, 1].copy().view(np.int64))], names=["a", "b"])
    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS, rows_per_task: int = 2_000_000) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at ``max_bits`` or fewer differing bits, enough of
    them to connect all that such links connect."""
    n = nodes.count()
    each = sum(len(_offsets(v, max_bits // 2)) for v in _views(max_bits))
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * each // rows_per_task))
    spread = nodes.repartition(max(1, min(tasks, n)), "fp") if n else nodes
    return (spread.mapInArrow(_variants(max_bits), "view byte, variant long, fp long")
            .repartition(tasks, "view", "variant").mapInArrow(_meet(max_bits), "a long, b long").distinct())


# ------------------------------------------------------------------------------------------- operator

def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """(doc_id, h, fp, component_id), one row per document."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), max_bits))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    decided = stage(joined, "rooted")
    least = decided.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = decided.join(least, "root").select("fp", "component_id", "root")
    return prints.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least id reachable)."""
    return _rooted(docs, id_col, text_col, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay, with all their columns: of each component one row of its least id (where several rows
    carry that id, the one whose text has the least hash)."""
    found = _rooted(docs, id_col, text_col, shingle, max_bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stage(found.groupBy("root", "doc_id").agg(F.min("h").alias("h")).select("doc_id", "h"), "kept")
    key = free_name(docs, "__text_hash")
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    k = kept.select(F.col("doc_id").alias("__k_id"), F.col("h").alias("__k_h"))
    out = marked.join(k, null_safe([marked[id_col], marked[key]], [k["__k_id"], k["__k_h"]]), "left_semi")
    if found.groupBy("doc_id", "h").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, key])          # rows that are equal in id and text
    return out.drop(key)

"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document is the set of its distinct shingles of five words.  Its signature has CHUNKS x WIDTH components, each the
``BITS`` mixed low bits of one minimum over the set, and the distance of two signatures is the number of components
that differ.  By the pigeonhole rule two signatures at distance CHUNKS * (ERRORS + 1) - 1 or less have a chunk with at
most ERRORS differing components.  So every chunk is emitted once for each way to leave out ERRORS components, and two
such signatures always share an emitted key: all pairs under the threshold meet, none of them by luck.  With the
defaults (60 components, distance 23) a pair of similarity 0.85 is over the threshold once in about a million times.

1. Documents of one shingle set (a 128-bit digest) become one node.
2. Nodes emit (key, node); keys that only one node has go, and the same nodes under many keys count as one bucket.
3. In each bucket signatures are compared; a spanning forest of what is within the threshold leaves the task.
4. Nodes so connected form a candidate group.  Its full shingle sets, read again from the texts of those nodes only,
   meet in blocks of bounded size (every pair of blocks of a larger group is a task's row group of its own), where the
   exact intersection of every pair of different sets is counted and a spanning forest of the links leaves.
5. The links' connected components are the result.

Pairs are never rows: forests have fewer rows than nodes, and what is quadratic (signatures within a bucket, sets within
a candidate group) is array arithmetic inside tasks.  A group with very many different texts costs the square of their
number in such arithmetic, dealt over its pairs of blocks.

Edge cases: null text, empty text and text of white space have no shingle, are linked with nothing and stay; fewer
words than a shingle are one shingle; equal sets are one node whatever their number; a null id is a document like any
other, its component's id is the least id that is not null, and a component without any id has a null id and stays;
rows repeated with one id share a component and are all reported; extra columns are left behind by ``near_duplicates``
and pass through ``keep_first``; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import free_name, mix, null_safe, stage, texts
from papyra.llm.components import components

SHINGLE = 5
PERCENT = 85
CHUNKS, WIDTH, ERRORS, BITS = 12, 5, 1, 16
BLOCK_NODES, BLOCK_SHINGLES = 1_000, 1_000_000     # of a block of a candidate group
ROWS_PER_TASK = 2_000_000
SHINGLES_PER_TASK = 8_000_000
_PIECE = 1 << 20                                    # bytes of a text whose words are hashed at a time
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


# ------------------------------------------------------------------------------------------- shingles

class Shingler:
    """Hashes of the distinct word shingles of a text, sorted."""

    def __init__(self, shingle: int = SHINGLE) -> None:
        self.shingle = shingle
        self._up = self._down = np.ones(1, np.uint64)
        k = np.arange(1, shingle + 1, dtype=np.uint64)
        self._place = mix(k * np.uint64(_BASE)) | np.uint64(1)

    def _powers(self, n: int) -> None:
        if n > len(self._up):
            def table(base: int) -> np.ndarray:
                t = np.full(n, base, np.uint64)
                t[0] = 1
                return np.cumprod(t, dtype=np.uint64)
            self._up, self._down = table(_BASE), table(pow(_BASE, -1, 1 << 64))

    def _words(self, data: bytes) -> np.ndarray:
        b = np.frombuffer(data, np.uint8)
        self._powers(len(b) + 1)
        gap = np.concatenate(([True], _SPACE[b], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[0::2], edge[1::2]
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self._up[:len(b)], out=total[1:])
        return mix((total[end] - total[start]) * self._down[start]
                   + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def words(self, text: bytes) -> np.ndarray:
        text, out, start = text.lower(), [], 0             # bytes.lower: A-Z only
        while start < len(text):
            end = min(len(text), start + _PIECE)
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            out.append(self._words(text[start:end]))
            start = end
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        w = self.words(text)
        n = len(w) - self.shingle + 1
        if n < 1:
            return mix((w * self._place[:len(w)]).sum(dtype=np.uint64, keepdims=True)) if len(w) else w
        h = w[:n] * self._place[0]
        for i in range(1, self.shingle):
            h += w[i:i + n] * self._place[i]
        return np.unique(mix(h))


class Signer:
    """The b-bit signature of a set of hashes: one minimum a component, its mixed low bits."""

    def __init__(self, components_: int, bits: int) -> None:
        k = np.arange(1, 2 * components_ + 1, dtype=np.uint64)
        h = mix(k * np.uint64(0xD6E8FEB86659FD93))
        self._flip, self._factor = h[:components_, None], h[components_:, None] | np.uint64(1)
        self._mask = np.uint64((1 << bits) - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self._flip), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 8_192):
            least = np.minimum(least, ((hashes[None, i:i + 8_192] ^ self._flip) * self._factor).min(axis=1))
        return (mix(least) & self._mask).astype("<u2")


def _bytes(column: pa.Array):
    for v in column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column:
        yield v.as_py() or b""


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, digest, n_shingles, signature): a hash of the text, a digest of the set, its size, its signature."""
    src = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))

    def run(batches):
        cut, sign = Shingler(shingle), Signer(CHUNKS * WIDTH, BITS)
        for b in batches:
            digest, size, sig = [], [], []
            for t in _bytes(b.column("text")):
                s = cut(t)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                size.append(len(s))
                sig.append(sign(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(digest, pa.binary()), pa.array(size, pa.int64()),
                 pa.array(sig, pa.binary())], names=["doc_id", "h", "digest", "n_shingles", "signature"])
    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, h long, digest binary, n_shingles long, signature binary")


# ------------------------------------------------------------------------------------------- candidates

def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), "<u2").reshape(-1, CHUNKS * WIDTH)


def _keys(batches):
    """(key, node): every chunk of a signature with every choice of ERRORS components left out."""
    keep = [np.setdiff1d(np.arange(WIDTH), out) for out in itertools.combinations(range(WIDTH), ERRORS)]
    for batch in batches:
        for i in range(0, batch.num_rows, 4_000):
            b = batch.slice(i, 4_000)
            sig = _signatures(b.column("signature")).astype(np.uint64).reshape(-1, CHUNKS, WIDTH)
            out = []
            for v, cols in enumerate(keep):
                h = np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(len(keep)) + np.uint64(v)
                for c in cols:
                    h = mix(h * np.uint64(_BASE) + sig[:, :, c])
                out.append(h)
            key = np.stack(out, axis=2).reshape(len(sig), -1)
            node = np.repeat(b.column("node").to_numpy(), key.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])


def _shared(batches):
    """(bucket, node) of the keys that several nodes have; a bucket is named by its nodes."""
    held = [(b.column("key").to_numpy(), b.column("node").to_numpy()) for b in batches]
    if not held:
        return
    key, node = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    first, size = first[size > 1], size[size > 1]
    seen: set[int] = set()
    bucket, member = [], []
    for s, n in zip(first.tolist(), size.tolist()):
        nodes = node[s:s + n]
        name = xxhash.xxh3_64_intdigest(nodes.tobytes())
        if name not in seen:
            seen.add(name)
            bucket.append(np.full(n, name, np.uint64))
            member.append(nodes)
    if bucket:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bucket).view(np.int64)),
                                          pa.array(np.concatenate(member))], names=["bucket", "node"])


def _runs(batches, column: str):
    """The rows of each value of ``column``, one run at a time; the partition is sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        value = b.column(column).to_numpy()
        cuts = np.flatnonzero(value[1:] != value[:-1]) + 1
        bounds = [0, *cuts.tolist(), b.num_rows]
        for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
            part = b.slice(s, e - s)
            if held and held[-1].column(column)[0].as_py() != part.column(column)[0].as_py():
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near_forest(threshold: int, percent: int):
    """Links that connect what is connected within a bucket by signatures at ``threshold`` or less whose sets' sizes
    allow the similarity: a search from node to node that compares each with those not yet reached."""
    def run(batches):
        for t in _runs(batches, "bucket"):
            node, size = t.column("node").to_numpy(), t.column("n_shingles").to_numpy()
            sig = _signatures(t.column("signature").combine_chunks())
            a, b = [], []
            rest = np.arange(len(node))
            while len(rest) > 1:
                queue, rest = [int(rest[0])], rest[1:]
                while queue and len(rest):
                    i = queue.pop()
                    near = np.concatenate([(sig[part] != sig[i]).sum(axis=1) <= threshold
                                           for part in np.array_split(rest, -(-len(rest) // 100_000))])
                    near &= 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
                    found, rest = rest[near], rest[~near]
                    a += [node[i]] * len(found)
                    b += node[found].tolist()
                    queue += found.tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _tasks(df: DataFrame, amount: int, each: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def candidate_groups(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root): the candidate group of every node whose signature is near another's."""
    n = nodes.count()
    emitted = CHUNKS * len(list(itertools.combinations(range(WIDTH), ERRORS)))
    tasks = _tasks(nodes, n * emitted, ROWS_PER_TASK)
    buckets = (nodes.select("node", "signature").repartition(tasks, "node").mapInArrow(_keys, "key long, node long")
               .repartition(tasks, "key").mapInArrow(_shared, "bucket long, node long").distinct())
    threshold = CHUNKS * (ERRORS + 1) - 1
    edges = (buckets.join(nodes.select("node", "n_shingles", "signature"), "node")
             .repartition(tasks, "bucket").sortWithinPartitions("bucket")
             .mapInArrow(_near_forest(threshold, percent), "a long, b long"))
    return components(edges)


# ------------------------------------------------------------------------------------------- exact check

def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs.  Hashes that many sets hold are columns of a dense product, the
    others are counted from their short lists of holders."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.int64)
    dense = np.flatnonzero(times > max(8, n // 16))
    column = np.full(len(times), -1)
    column[dense] = np.arange(len(dense))
    at = column[value]
    for c in range(0, len(dense), 4_096):
        hit = (at >= c) & (at < c + 4_096)
        table = np.zeros((n, min(4_096, len(dense) - c)), np.float32)
        table[owner[hit], at[hit] - c] = 1
        out += (table @ table.T).astype(np.int64)
    few = (at < 0) & (times[value] > 1)
    order = np.argsort(value[few], kind="stable")
    holder, key = owner[few][order], value[few][order]
    codes, waiting, step = [], 0, 1

    def count() -> None:
        nonlocal codes, waiting
        if codes:
            both = np.bincount(np.concatenate(codes), minlength=n * n).reshape(n, n)
            np.add(out, both, out=out)
            np.add(out, both.T, out=out)
        codes, waiting = [], 0

    while len(key) > step:                     # the holders of one hash, each with the one ``step`` places on
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        codes.append(holder[same] * n + holder[same + step])
        waiting += len(same)
        if waiting > 4_000_000:
            count()
        step += 1
    count()
    return out


def _linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union."""
    size = np.array([len(s) for s in sets])
    both = _overlaps(sets)
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    rest, out = np.arange(len(sets)), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near[i, rest]
            out += [(i, int(j)) for j in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return out


def _exact_forest(percent: int):
    def run(batches):
        for t in _runs(batches, "meeting"):
            node = t.column("node").to_numpy()
            flat, ends = [], t.column("hashes").combine_chunks()
            offsets, values = ends.offsets.to_numpy(), ends.values.to_numpy()
            flat = [values[s:e] for s, e in zip(offsets[:-1], offsets[1:])]
            found = _linked(flat, percent)
            if found:
                ij = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(node[ij[:, 0]]), pa.array(node[ij[:, 1]])], names=["a", "b"])
    return run


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, root, hashes) of ``wanted`` (node, root, rep, digest), from the texts of the rows named by ``rep``."""
    src = texts(docs, id_col, text_col).select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("rep"), "text")
    # One row of each set: copies under other ids stay behind, so a text with very many copies is no hot key.
    found = src.join(wanted.select(F.col("rep").alias("w")), F.col("rep").eqNullSafe(F.col("w")), "left_semi")

    def run(batches):
        cut = Shingler(shingle)
        for b in batches:
            sets = [cut(t) for t in _bytes(b.column("text"))]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["digest", "hashes"])
    sets = found.mapInArrow(run, "digest binary, hashes array<long>")
    once = sets.groupBy("digest").agg(F.first("hashes").alias("hashes"))       # rows repeated with id and text
    return once.join(wanted.select("digest", "node", "root"), "digest").select("node", "root", "hashes")


def exact_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = SHINGLE, percent: int = PERCENT, block_nodes: int = BLOCK_NODES,
                block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): links between nodes of one candidate group, enough to connect all that exact links connect."""
    wanted = stage(groups.join(nodes, "node").select("node", "root", "rep", "digest", "n_shingles"), "wanted")
    totals = wanted.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n_shingles").alias("shingles"),
                                        F.max("n_shingles").alias("most"))
    # Blocks by a hash of the node; where sets differ much in size a block is planned for the larger ones.
    blocks = F.greatest(F.ceil(F.col("nodes") / block_nodes), F.ceil(F.col("shingles") / block_shingles)).cast("int")
    plan = totals.select("root", "nodes", "shingles", F.when(F.col("nodes") <= 2, 1).otherwise(blocks).alias("blocks"))
    plan = stage(plan, "blocks")
    amount = plan.agg(F.sum(F.col("shingles") * F.col("blocks")).alias("n")).first()["n"] or 0
    tasks = _tasks(docs, amount, SHINGLES_PER_TASK)
    sets = _sets(docs, wanted, id_col, text_col, shingle).join(plan.select("root", "blocks"), "root")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0))))
    dealt = (sets.withColumn("own", own).withColumn("other", other)
             # of several blocks, a pair of two different ones also compares each block with itself
             .filter((F.col("blocks") == 1) | (F.col("own") != F.col("other")))
             .select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"),
                     "node", "hashes"))
    return (dealt.repartition(tasks, "meeting").sortWithinPartitions("meeting")
            .mapInArrow(_exact_forest(percent), "a long, b long"))


# ------------------------------------------------------------------------------------------- operator

def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(doc_id, h, digest, n_shingles, component_id), one row per document."""
    found = stage(prints(docs, id_col, text_col, shingle), "shingle-prints")
    nodes = stage(found.filter("n_shingles > 0").groupBy("digest")
                  .agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("rep"),
                       F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
                  .withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")
    groups = stage(candidate_groups(nodes, percent), "candidate-groups")
    roots = components(exact_links(docs, nodes, groups, id_col, text_col, shingle, percent))
    decided = stage(nodes.join(roots, "node", "left").select(
        "digest", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = decided.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = decided.join(least, "root").select("digest", "component_id", "root")
    some, none = found.filter("n_shingles > 0"), found.filter("n_shingles = 0")
    return some.join(by_set, "digest").select("doc_id", "h", "n_shingles", "component_id", "root").unionByName(
        none.select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable by links), kept."""
    return _rooted(docs, id_col, text_col, shingle, percent).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with all their columns: those whose id is their component's."""
    found = stage(_rooted(docs, id_col, text_col, shingle, percent)
                  .filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "h").distinct(), "kept")
    key = free_name(docs, "__text_hash")
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    k = found.select(F.col("doc_id").alias("__k_id"), F.col("h").alias("__k_h"))
    return marked.join(k, null_safe([marked[id_col], marked[key]], [k["__k_id"], k["__k_h"]]), "left_semi").drop(key)

"""Exact de-duplication against immutable snapshots, screened by static binary-fuse filters.

A snapshot is the written table of the distinct digests of what was admitted before, dealt into shards of bounded
size, with one 3-wise binary-fuse filter per shard, built once and never changed.  An incoming batch is reduced to
its distinct digests (its own duplicates are grouped on the way), each digest is screened by its shard's filter, and
only positives are joined with the snapshot's exact buckets; a filter has no false negatives, so nothing is missed.

Digests decide nothing alone: of every digest that occurs more than once the texts are compared byte by byte (the
least and the greatest text of the digest, taken per salt before they meet), and where they differ the text itself
becomes the key.

Texts are equal when identical after each run of white space (``[\\x20\\x09-\\x0D]+``) is replaced by one space.

Edge cases: null text counts as empty, and empty texts are equal to each other; a row without id belongs to its
group but stays only if the group has no id at all; of repeated rows (same id, same text) one stays; extra columns
are left behind by ``groups`` and pass through ``keep_first``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.llm.common import free_name, mix, null_safe, stage, texts

SPACES = "[\\x20\\x09-\\x0D]+"
SHARD_KEYS = 50_000       # digests a filter holds on average: bounds a shard's task
SALTS = 16                # parts in which the texts of one digest are compared before they meet
_FILTER = "shard int, seed long, segment int, length int, cells binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(normal: Column) -> Column:
    return F.unhex(F.sha2(normal, 256))


# ------------------------------------------------------------------------------------- binary-fuse filter

def _layout(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of cells for n keys."""
    segment = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    segment = min(segment, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
    starts = max(1, -(-int(n * factor + 16) // segment) - 2)
    return segment, (starts + 2) * segment


def _cells(keys: np.ndarray, seed: int, segment: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of each key, in three consecutive segments, and its 8-bit print."""
    h = mix(keys ^ np.uint64(seed))
    starts = length // segment - 2
    first = ((h >> np.uint64(32)) * np.uint64(starts) >> np.uint64(32)).astype(np.int64) * segment
    mask = segment - 1
    g = mix(h + np.uint64(0x9E3779B97F4A7C15))
    cells = np.stack([first + (g.astype(np.int64) & mask),
                      first + segment + ((g >> np.uint64(20)).astype(np.int64) & mask),
                      first + 2 * segment + ((g >> np.uint64(40)).astype(np.int64) & mask)])
    return cells, (h & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, length, cells) of the filter that holds the distinct ``keys``.  Peeling goes in rounds: all
    cells that hold one key give it up at once (no two such keys share their cells), and the rounds are filled
    backwards.  A seed whose keys cannot all be peeled is replaced."""
    keys = np.unique(keys)
    segment, length = _layout(len(keys))
    for attempt in range(1, 200):
        seed = int(mix(np.array([attempt], np.uint64))[0])
        cells, prints = _cells(keys, seed, segment, length)
        order = _peel(cells, length)
        if order is not None:
            table = np.zeros(length, np.uint8)
            for ids, own in reversed(order):
                value = prints[ids].copy()
                for i in range(3):
                    value ^= np.where(cells[i, ids] == own, np.uint8(0), table[cells[i, ids]])
                table[own] = value
            return seed, segment, length, table.tobytes()
        if attempt % 10 == 0:
            length += segment
    raise RuntimeError("binary-fuse filter: no seed peels the keys")


def _peel(cells: np.ndarray, length: int):
    n = cells.shape[1]
    ids = np.arange(n, dtype=np.int64)
    count = np.bincount(cells.ravel(), minlength=length)
    left = np.zeros(length, np.int64)                  # sum of the keys in a cell: the key itself where one is left
    for i in range(3):
        left += np.bincount(cells[i], weights=ids, minlength=length).astype(np.int64)
    rounds, done = [], 0
    ready = np.flatnonzero(count == 1)
    while len(ready):
        key, at = np.unique(left[ready], return_index=True)       # a key alone in several cells goes once
        rounds.append((key, ready[at]))
        done += len(key)
        touched = cells[:, key]
        for i in range(3):
            np.subtract.at(count, touched[i], 1)
            np.subtract.at(left, touched[i], key)
        touched = np.unique(touched)
        ready = touched[count[touched] == 1]
    return rounds if done == n else None


def in_filter(keys: np.ndarray, seed: int, segment: int, length: int, cells: bytes) -> np.ndarray:
    table = np.frombuffer(cells, np.uint8)
    at, prints = _cells(keys, seed, segment, length)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == prints


def _keys(digests: Iterable[bytes]) -> np.ndarray:
    """The first 64 bits of each digest, spread again (a short digest is zero-padded)."""
    return mix(np.frombuffer(b"".join((bytes(d) + b"\0" * 8)[:8] for d in digests), np.uint64))


# ------------------------------------------------------------------------------------------- snapshots

@dataclass
class Snapshot:
    """Written once: ``buckets`` (shard, digest, first_id, n), one row per distinct digest, and ``filters``."""
    buckets: DataFrame
    filters: DataFrame
    shards: int


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def grouped(digests: DataFrame) -> DataFrame:
    """(digest, first_id, n): duplicates within a batch, counted before the shuffle and after it."""
    return digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def build_snapshot(digests: DataFrame, shard_keys: int = SHARD_KEYS) -> Snapshot:
    groups = stage(grouped(digests), "snapshot-groups")
    shards = max(1, -(-groups.count() // shard_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, length, cells = build_filter(_keys(pdf["digest"]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": np.array([seed], np.uint64).view(np.int64),
                             "segment": [segment], "length": [length], "cells": [cells]})
    buckets = groups.withColumn("shard", _shard(F.col("digest"), shards))
    filters = stage(buckets.select("shard", "digest").groupBy("shard").applyInPandas(build, _FILTER),
                    "snapshot-filters")
    return Snapshot(buckets, filters, shards)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests of a batch (distinct) that the filter of their shard does not rule out."""
    def probe(key, digests: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(digests) or not len(filters):
            return digests[["digest"]].iloc[:0]
        f = filters.iloc[0]
        seed = int(np.array([f["seed"]], np.int64).view(np.uint64)[0])
        hit = in_filter(_keys(digests["digest"]), seed, int(f["segment"]), int(f["length"]), f["cells"])
        return digests.loc[hit, ["digest"]]
    dealt = batch.select(_shard(F.col("digest"), snapshot.shards).alias("shard"), "digest")
    return (dealt.groupBy("shard").cogroup(snapshot.filters.groupBy("shard"))
            .applyInPandas(probe, "digest binary"))


def join_snapshot(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``batch`` (digest, first_id, n) with what the snapshot holds of it: seen_id, seen_n (null, 0: new)."""
    exact = screen(batch, snapshot).join(snapshot.buckets, "digest").select(
        "digest", F.col("first_id").alias("seen_id"), F.col("n").alias("seen_n"), F.lit(1).alias("seen"))
    return batch.join(exact, "digest", "left").withColumn("seen_n", F.coalesce("seen_n", F.lit(0)))


# ------------------------------------------------------------------------------------------- operator

def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest), one row per document, written."""
    src = texts(docs, id_col, text_col)
    return stage(src.select("doc_id", digest(normalised(F.col("text"))).alias("digest")), "digests")


def merge_batches(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size): the lower half of the ids as the snapshot, the rest as the incoming batch."""
    middle = digests.agg(F.percentile_approx("doc_id", 0.5).alias("m")).first()["m"]
    first = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    snapshot = build_snapshot(digests.filter(first))
    merged = stage(join_snapshot(grouped(digests.filter(~first)), snapshot), "screened")
    new = merged.select("digest", F.least("first_id", "seen_id").alias("keep_id"),
                        (F.col("n") + F.col("seen_n")).alias("group_size"))
    old = snapshot.buckets.join(merged.filter("seen = 1").select("digest"), "digest", "left_anti").select(
        "digest", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size"))
    return stage(new.unionByName(old), "groups")


def different_texts(docs: DataFrame, repeated: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The digests of ``repeated`` that stand for texts that are not the same bytes.  A digest's texts are compared
    in SALTS parts first, so a text that many documents share is not gathered in one task."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    normal = normalised(F.col("text"))
    rows = docs.select(digest(normal).alias("digest"), salt.alias("salt"), normal.alias("normal"))
    wanted = repeated.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    part = (rows.join(wanted, ["digest", "salt"], "left_semi").groupBy("digest", "salt")
            .agg(F.min("normal").alias("low"), F.max("normal").alias("high"))
            .select("digest", "low", "high"))
    # Parts whose least and greatest text agree meet as one text each.
    return (part.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            .filter(~F.col("low").eqNullSafe(F.col("high"))).select("digest"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, digest."""
    src = texts(docs, id_col, text_col)
    digests = digest_table(docs, id_col, text_col, digest)
    decided = merge_batches(digests)
    bad = stage(different_texts(src, decided.filter("group_size > 1"), digest), "collisions")
    out = digests.join(decided, "digest")
    if bad.limit(1).count():
        normal = normalised(F.col("text"))
        mixed = src.select("doc_id", digest(normal).alias("digest"), normal.alias("normal")).join(bad, "digest", "left_semi")
        by_text = mixed.groupBy("digest", "normal").agg(F.min("doc_id").alias("keep_id"),
                                                        F.count(F.lit(1)).alias("group_size"))
        fixed = mixed.join(by_text, ["digest", "normal"]).select(
            "doc_id", F.col("keep_id"), "group_size", "digest", F.sha2("normal", 256).alias("text_sha256"))
        out = out.join(bad, "digest", "left_anti")
    else:
        fixed = None
    hexed = F.lower(F.hex("digest")) if digest is sha256 else None
    if hexed is None:      # a digest of another kind: the text's own SHA-256 is read again
        own = src.select("doc_id", digest(normalised(F.col("text"))).alias("digest"),
                         F.sha2(normalised(F.col("text")), 256).alias("text_sha256")).distinct()
        o = own.select(F.col("doc_id").alias("__d"), F.col("digest").alias("__g"), "text_sha256")
        out = out.join(o, null_safe([out.doc_id, out.digest], [F.col("__d"), F.col("__g")]))
    else:
        out = out.withColumn("text_sha256", hexed)
    out = out.select("doc_id", "keep_id", "group_size", "digest", "text_sha256")
    if fixed is not None:
        out = out.unionByName(fixed)
    nth = F.row_number().over(W.partitionBy("doc_id", "text_sha256").orderBy("keep_id"))
    return out.withColumn("nth", nth).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256", "digest")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each group of equal texts the one with the smallest id."""
    decided = groups(docs, id_col, text_col)
    kept = stage(decided.groupBy("doc_id", "digest", "keep_id").agg(F.count(F.lit(1)).alias("times"))
                 .filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest", "times"), "kept")
    key = free_name(docs, "__digest")
    marked = docs.withColumn(key, sha256(normalised(F.col(text_col))))
    k = kept.select(F.col("doc_id").alias("__k_id"), F.col("digest").alias("__k_digest"), F.col("times").alias("__k_n"))
    cond = null_safe([marked[id_col], marked[key]], [k["__k_id"], k["__k_digest"]])
    if not kept.filter("times > 1").limit(1).count():
        return marked.join(k, cond, "left_semi").drop(key)
    once = marked.join(k.filter("__k_n = 1"), cond, "left_semi")
    again = marked.join(k.filter("__k_n > 1"), cond, "left_semi").dropDuplicates([id_col, key])
    return once.unionByName(again).drop(key)

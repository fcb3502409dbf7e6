"""How an ordered chain of filters acts: every order's effect, by a recursive common table expression.

Each document gets a mask of the filters that it fails, and documents with one mask are one cell of their part (at
most 2 ** filters cells a part).  A recursive query starts with the empty prefix and extends it with one unused filter
a level, joins the part's cells, carries the bits that the prefix has applied and emits that step's counts.  A prefix
is counted once for all the orders that begin with it (325 prefixes for 120 orders of five filters); the orders then
look up their five prefixes.

The five filters (a document fails):
  A  under 100 words                                   D  it holds one of # $ % & * |
  B  100 * distinct words < 80 * words                 E  its text is that of a row with a smaller id, removed or not
  C  100 * A-Z characters > 10 * code points
Words are maximal runs of characters other than the six ASCII white-space characters, case-sensitive.

Edge cases: null text counts as empty (it fails A, and E if another empty text has a smaller id); a null part is the
empty string and shares its rows with an empty one; a row with a null id never fails E and makes no other row fail it;
rows repeated with one id are counted each, and none of them is a copy of the other (no smaller id); several labels for
an id count as 1 if one of them is 1, null labels as none; extra columns are left behind; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import stage

LETTERS = "ABCDE"
LEAST_WORDS = 100
_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_PIECE = 1 << 22                  # bytes of a text that are split into words at a time
_GAPS = b" \t\n\x0b\x0c\r"


def _words(data: bytes) -> tuple[int, int]:
    """How many words a text has, and how many distinct ones."""
    if len(data) <= _PIECE:
        w = data.split()                                   # bytes.split: exactly the six characters
        return len(w), len(set(w))
    n, seen, start = 0, set(), 0
    while start < len(data):
        end = min(len(data), start + _PIECE)
        while end < len(data) and data[end] not in _GAPS:
            end += 1
        w = data[start:end].split()
        n += len(w)
        seen.update(w)
        start = end
    return n, len(seen)


def text_mask(data: bytes) -> int:
    """The bits of A, B, C and D (1, 2, 4, 8) that a text, in UTF-8, fails."""
    words, distinct = _words(data)
    points = len(data.decode("utf-8", "replace"))
    upper = len(data) - len(data.translate(None, _UPPER))
    marked = len(data.translate(None, _MARKS)) < len(data)
    return ((words < LEAST_WORDS) | (100 * distinct < 80 * words) << 1 | (100 * upper > 10 * points) << 2 | marked << 3)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          test: Callable[[bytes], int] = text_mask) -> DataFrame:
    """(doc_id, part, mask, digest): the filters that a row's own text decides, and the SHA-256 of the text."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            mask, digest = [], []
            for v in b.column("text"):
                t = v.as_py()
                mask.append(test(t))
                digest.append(hashlib.sha256(t).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(mask, pa.int32()),
                                              pa.array(digest, pa.binary())], names=["doc_id", "part", "mask", "digest"])
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, part string, mask int, digest binary")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many rows fail exactly the filters of the mask."""
    own = stage(masks(docs, id_col, text_col, part_col), "masks")
    # The first row of each text is found by (digest, id): a text that very many rows share is not one join key.
    first = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    marked = own.join(first.withColumn("first", F.lit(1)), ["digest", "doc_id"], "left")
    is_one = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
             .agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")))
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << LETTERS.index("E")).otherwise(0)
    one = marked.select("doc_id", "part", (F.col("mask") + copy).alias("mask"))
    # Rows without a label meet the labels too: the label side has one row an id, and a null id is no key.
    return (one.join(known, "doc_id", "left").groupBy("part", "mask")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"),
                 F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("toxic")))


# A level extends each prefix with every unused letter; the counts are sums over the part's cells, an array of at most
# 2 ** letters of them.  ``applied`` holds the bits of the prefix before its last letter.
_ENUMERATE = """
WITH RECURSIVE chain(part, prefix, bit, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT part, prefix, bit, applied,
         aggregate(filter(cells, c -> c.mask & (applied | bit) = 0), 0L, (s, c) -> s + c.n),
         aggregate(filter(cells, c -> c.mask & bit > 0 AND c.mask & applied = 0), 0L, (s, c) -> s + c.n),
         aggregate(filter(cells, c -> c.mask & bit > 0 AND c.mask & applied > 0), 0L, (s, c) -> s + c.n),
         aggregate(filter(cells, c -> c.mask = bit), 0L, (s, c) -> s + c.n),
         aggregate(filter(cells, c -> c.mask & bit > 0 AND c.mask & applied = 0), 0L, (s, c) -> s + c.good),
         aggregate(filter(cells, c -> c.mask & bit > 0 AND c.mask & applied = 0), 0L, (s, c) -> s + c.toxic)
  FROM (SELECT p.part, concat(p.prefix, letter) AS prefix, 1 << (instr('{letters}', letter) - 1) AS bit,
               p.applied | p.bit AS applied, m.cells
        FROM (SELECT part, prefix, bit, applied,
                     explode(filter(split('{letters}', ''), l -> l > '' AND instr(prefix, l) = 0)) AS letter FROM chain) p
        JOIN {cells} m ON m.part = p.part))
SELECT part, prefix, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM chain WHERE prefix > ''
"""
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def prefixes(cells_: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, prefix, counts): what the last filter of every prefix does after those before it, written.  The row
    limit that guards endless recursion is off meanwhile: levels are as many as letters, rows as many as parts ask."""
    spark = cells_.sparkSession
    rows = stage(cells_.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "cells")
    was = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        return stage(spark.sql(_ENUMERATE.format(cells="{cells}", letters=letters), cells=rows), "prefixes")
    finally:
        spark.conf.set(_ROW_LIMIT, was)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang", letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley, the removed of the step's filter summed over all orders."""
    steps = prefixes(cells(docs, labels, id_col, text_col, part_col), letters)
    orders = steps.filter(F.length("prefix") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    rows = (orders.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
            .withColumn("prefix", F.expr("left(filter_order, step)")).join(steps, ["part", "prefix"])
            .withColumn("letter", F.expr("right(prefix, 1)")))
    share = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(share, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

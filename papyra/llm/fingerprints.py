"""Document fingerprints: one-permutation MinHash with optimal densification, in column expressions only.

Every shingle of five words is hashed once; the top bits of the hash name its bin and each of BINS bins keeps its least
hash.  An empty bin j borrows from the first filled bin of its own fixed probing sequence: PROBES random bins given by
a hash of (j, attempt), then all bins in the order of another hash of (j, bin), which always ends.  The sequence does
not depend on the document, so two documents borrow alike.  Of each bin the low BITS bits are stored, packed as hex.
Unequal bins agree by chance with probability c = 2^-BITS; the likeness of two fingerprints is
(share of equal bins - c) / (1 - c), not below 0.

The hashes of a document are sorted together with the greatest value of each bin; the first of each run of equal top
bits is then the bin's minimum, or its greatest value if the bin is empty: all within the row, without exploding
shingles or shuffling them.

Edge cases: null text counts as empty; a text of fewer than five words is one shingle, one without words the empty
shingle (so empty texts equal each other); equal texts have equal fingerprints; rows with one id are ordered by a hash
of their text, and rows equal in id and text are one document in that order; a null id comes first; extra columns are
left behind; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.llm.common import null_safe, stage, texts

SHINGLE = 5
BINS = 128
_VALUE_BITS = 57          # a hash is 7 bits of bin and 57 of value
BITS = 8
PROBES = 12
GROUP_ROWS = 200_000      # rows of one ordered group when neighbours are sought


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in lower case; one empty word if there is none."""
    flat = F.lower(text)
    for c in "\t\n\x0b\x0c\r":      # plain replacements and a one-character split: no regular expression over the text
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    parts = lambda t: F.split(t, " ")                                                  # noqa: E731
    return let(F.btrim(flat), lambda t: F.when(
        F.contains(t, F.lit("  ")), F.filter(parts(t), lambda w: w != "")).otherwise(parts(t)))


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """The 64-bit hash of every run of ``shingle`` words."""
    def hashes(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - shingle),
                           lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
        return F.when(F.size(w) >= shingle, runs).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    return let(words(text), hashes)


def signature(text: Column, shingle: int = SHINGLE) -> Column:
    """The densified low bits of the bins, packed as a hex string (BITS / 4 digits a bin)."""
    tops = F.transform(F.sequence(F.lit(1 - BINS // 2).cast("long"), F.lit(BINS // 2 - 1).cast("long")),
                       lambda b: F.shiftleft(b, _VALUE_BITS) - 1)
    ends = F.concat(tops, F.array(F.lit((1 << 63) - 1)))       # the greatest hash of each bin stands for "empty"
    empty = F.lit((1 << _VALUE_BITS) - 1)

    def minima(h: Column) -> Column:
        """The least hash of each bin, in the bins' order: the first of each run of equal top bits."""
        return F.filter(h, lambda x, i: F.when(i == 0, F.lit(True)).otherwise(
            F.shiftrightunsigned(x.bitwiseXOR(F.get(h, i - 1)), _VALUE_BITS) != 0))

    def dense(v: Column) -> Column:
        def borrow(j: Column) -> list[Column]:
            tries = [F.get(v, F.xxhash64(j, F.lit(t)).bitwiseAND(F.lit(BINS - 1).cast("long")).cast("int"))
                     for t in range(PROBES)]
            last = F.array_min(F.transform(v, lambda h, b: F.when(
                h.isNotNull(), F.struct(F.xxhash64(j, b, F.lit(-1)).alias("o"), h.alias("h")))))
            return [*tries, last["h"]]
        low = lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))), BITS // 4, "0")
        return F.lower(F.array_join(F.transform(v, lambda h, j: low(F.coalesce(h, *borrow(j)))), ""))
    return let(F.sort_array(F.concat(shingle_hashes(text, shingle), ends)), lambda h: let(
        F.transform(minima(h), lambda x: F.when(x.bitwiseAND(empty) != empty, x)), dense))


def likeness(a: Column, b: Column) -> Column:
    """The estimated resemblance of two fingerprints (0 to 1), corrected for chance agreement of the stored bits."""
    width = BITS // 8
    chance = 2.0 ** -BITS

    def share(s: Column) -> Column:
        x, y = s["a"], s["b"]
        same = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)),
                        lambda i: F.substring(x, i * width + 1, F.lit(width)) == F.substring(y, i * width + 1, F.lit(width)))
        return F.size(same) / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (let(F.struct(F.unhex(a).alias("a"), F.unhex(b).alias("b")), share) - chance) / (1 - chance))


# ------------------------------------------------------------------------------------------- neighbours

def next_in_order(keys: DataFrame) -> DataFrame:
    """(doc_id, h, next_id, next_h) for distinct (doc_id, h) in ascending order; the last is followed by the first.

    The keys are dealt by range into groups of bounded size; within a group the next row follows, and a group's last
    row is followed by the first of the next group that has rows.  Only one row a group meets in one place."""
    n = keys.count()
    groups = max(1, -(-n // GROUP_ROWS), int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stage(keys.repartitionByRange(groups, "doc_id", "h").withColumn("g", F.spark_partition_id()), "key-order")
    order = W.partitionBy("g").orderBy("doc_id", "h")
    inner = dealt.withColumn("next", F.lead(F.struct("doc_id", "h")).over(order))
    firsts = dealt.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "h")).alias("f"))
    ends = W.orderBy("g")       # one row a group
    after = firsts.select(F.col("g").alias("g2"), F.coalesce(
        F.lead("f").over(ends), F.first("f").over(ends.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("f"))
    joined = inner.join(after, inner.g == after.g2)
    pick = lambda c: F.when(F.col("next").isNotNull(), F.col(f"next.{c}")).otherwise(F.col(f"f.{c}"))
    return joined.select("doc_id", "h", pick("doc_id").alias("next_id"), pick("h").alias("next_h"))


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's."""
    src = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    sizes = stage(src.select("doc_id", "h", F.char_length("text").cast("long").alias("n_chars")), "sizes")
    keys = sizes.distinct()
    order = stage(next_in_order(keys.select("doc_id", "h")), "neighbours")
    k = keys.select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"), F.floor(F.col("n_chars") / 2).alias("take"))
    wanted = stage(order.join(k, null_safe([order.doc_id, order.h], [k.k_id, k.k_h])).select(
        F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), "next_id", "next_h", "take"), "wanted")
    # The next document hands over only the code points that are asked for.
    heads = src.join(wanted, null_safe([src.doc_id, src.h], [wanted.next_id, wanted.next_h])).select(
        "to_id", "to_h", "next_id", "next_h", F.substring(F.col("text"), F.lit(1), F.col("take").cast("int")).alias("head"))
    if keys.count() < sizes.count():      # rows equal in id and text hand over the same code points: one is enough
        heads = heads.groupBy("to_id", "to_h", "next_id", "next_h").agg(F.min("head").alias("head"))
    n = F.char_length("text")
    keep = F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 2)).cast("int"))
    both = src.join(heads, null_safe([src.doc_id, src.h], [heads.to_id, heads.to_h]))
    out = stage(both.select(
        "doc_id", "h", "next_id", "next_h", n.cast("long").alias("n_chars"), "text", F.concat(keep, "head").alias("edited"))
        .select("doc_id", "h", "next_id", "next_h", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                signature(F.col("text"), shingle).alias("fingerprint"),
                signature(F.col("edited"), shingle).alias("edited_fingerprint")), "fingerprints")
    other = out.select(F.col("doc_id").alias("o_id"), F.col("h").alias("o_h"), F.col("fingerprint").alias("o_print")).distinct()
    return out.join(other, null_safe([out.next_id, out.next_h], [other.o_id, other.o_h])).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("o_print")).alias("near_next"))

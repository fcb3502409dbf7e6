"""Temperature mixing of sources, realised as budgeted block permutations.

The token share p_s of each source is raised to an exponent alpha and normalised: q_s = p_s^alpha / sum p^alpha.
alpha = 1 keeps the corpus as it is, alpha = 0 gives every source the same weight.  The exponent is the least one in
[0, 1] that keeps the entropy of q at or under ``entropy`` (a share of the greatest possible entropy) and repeats no
source more than ``max_repeats`` times; both grow more even as alpha falls, so both are met by bisection.  Mixing never
makes the sources less even than they are: where the corpus itself is above the target entropy, alpha is 1, the mixture
is the corpus, and the target is not met.  ``Mix.entropy`` is the share reached, ``Mix.met`` whether it is at or under the
target.  Each job
over the (small, distributed) source table evaluates all midpoints of the next five halvings.

A source's budget is q_s * B tokens.  Its documents are dealt by hash into blocks of bounded size; an epoch is a
permutation of the blocks (by hash of source, epoch and block; first of groups of blocks, then of the blocks in a
group), and the schedule takes whole epochs and then the blocks of one more until the budget is used: the last block
is cut where the next document would exceed it.  ``mix_position`` (0 to 1) is a copy's place in its source's budget;
ordering all copies by it interleaves the sources at their weights at any prefix.

The default budget is the least one under which every source is emitted whole at least once, so mixing repeats small
sources and loses no document; a budget in tokens cuts large sources instead.

Sums run in two levels (groups of blocks, blocks in a group, documents in a block), so neither a source with a third
of all rows nor a large number of blocks lands in one task.

Edge cases: a document counts its words and one end token (null and empty text: 1); a null source is a source of its
own; repeated rows are documents of their own; with a single source every exponent gives weight 1; extra columns pass
through ``apply``; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.llm.common import free_name, stage

ENTROPY = 0.95            # target entropy as a share of log(number of sources)
MAX_REPEATS = 2.0         # times a source may be repeated
BLOCK_TOKENS = 65_536
HALVINGS = 40


def tokens(text: Column) -> Column:
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and that no other source shares."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


@dataclass
class Mix:
    alpha: float
    budget: float             # tokens over all sources
    weights: DataFrame        # key, n_tokens, n_docs, weight, budget_tokens, repeats
    entropy: float = 0.0      # of the weights, as a share of log(number of sources); 0 for fewer than two sources
    met: bool = True          # whether that is at or under the target


def solve_alpha(sources: DataFrame, entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """Bisection: the exponent's interval, 32 parts of it a job.  ``sources`` has n_tokens."""
    first = sources.agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("hi"), F.min("n_tokens").alias("lo"),
                        F.count(F.lit(1)).alias("n")).first()
    if first["n"] < 2 or (entropy is None and max_repeats is None):
        return 1.0
    total, log_n = float(first["t"]), math.log(first["n"])
    p = F.col("n_tokens") / F.lit(total)
    lo, hi = 0.0, 1.0

    def fits(alphas: list[float]) -> list[bool]:
        sums = [s for a in alphas for s in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]
        row = sources.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        out = []
        for i, a in enumerate(alphas):
            z, zl = row[2 * i], row[2 * i + 1]
            h = math.log(z) - a * zl / z                               # entropy of q
            share = lambda n: (n / total) ** a / z                     # noqa: E731, B023 - q of a source of n tokens
            b = budget if budget is not None else first["hi"] / share(first["hi"])
            repeats = share(first["lo"]) * b / first["lo"]
            out.append((entropy is None or h <= entropy * log_n + 1e-12)
                       and (max_repeats is None or repeats <= max_repeats * (1 + 1e-12)))
        return out
    if fits([0.0])[0]:
        return 0.0
    for _ in range(HALVINGS // 5):
        mids = [lo + (hi - lo) * i / 32 for i in range(1, 32)]
        ok = fits(mids)
        at = next((i for i, x in enumerate(ok) if x), 31)              # both limits hold from some exponent on
        lo, hi = ([lo] + mids)[at], (mids + [hi])[at]
    return hi


def weigh(docs: DataFrame, source_col: str = "source", text_col: str = "text", entropy: float | None = ENTROPY,
          max_repeats: float | None = MAX_REPEATS, budget: int | None = None) -> Mix:
    """Token counts over all documents, the exponent, and each source's weight and budget."""
    counted = docs.select(source_key(F.col(source_col)).alias("key"), tokens(F.col(text_col)).alias("n"))
    return weigh_counts(counted, entropy, max_repeats, budget)


def weigh_counts(counted: DataFrame, entropy: float | None, max_repeats: float | None, budget: int | None) -> Mix:
    sources = stage(counted.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs")), "sources")
    alpha = solve_alpha(sources, entropy, max_repeats, budget)
    first = sources.agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("hi")).first()
    if not first["t"]:
        return Mix(alpha, 0.0, sources.select("*", *[F.lit(0.0).alias(c) for c in ("weight", "repeats")],
                                              F.lit(0).cast("long").alias("budget_tokens")))
    raw = F.pow(F.col("n_tokens") / F.lit(float(first["t"])), F.lit(alpha))
    sums = sources.agg(F.sum(raw).alias("z"), F.sum(raw * F.log(raw)).alias("zl"), F.count(F.lit(1)).alias("n")).first()
    z = sums["z"]
    reached = (math.log(z) - sums["zl"] / z) / math.log(sums["n"]) if sums["n"] > 1 else 0.0
    whole = budget is None
    b = float(budget) if not whole else first["hi"] / ((first["hi"] / first["t"]) ** alpha / z)
    w = sources.withColumn("weight", raw / F.lit(z))
    # With the default budget every source is taken whole at least once: rounding must not cut it.
    spend = F.round(F.col("weight") * F.lit(b)).cast("long") if whole else F.floor(F.col("weight") * F.lit(b)).cast("long")
    spend = F.greatest(F.col("n_tokens"), spend) if whole else spend
    w = w.withColumn("budget_tokens", spend).withColumn("repeats", F.col("budget_tokens") / F.col("n_tokens"))
    return Mix(alpha, b, w, reached, entropy is None or reached <= entropy + 1e-9)


def schedule(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", source_col: str = "source",
             text_col: str = "text", entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS,
             budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """One row per emitted copy: doc_id, row_key, same (rows equal in id and
    text), source, tokens, epoch, block, mix_position."""
    rows = stage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("key"),
        tokens(F.col(text_col)).alias("n"), row_key(docs, id_col, text_col).alias("row_key")), "mix-rows")
    if mix is None:
        mix = weigh_counts(rows.select("key", "n"), entropy, max_repeats, budget)
    weights = mix.weights.select(
        "key", "n_tokens", "budget_tokens", F.ceil(F.col("n_tokens") / F.lit(block_tokens)).cast("long").alias("blocks"))
    # Source rows are few per source; a hot source's documents are split by Spark's skew handling, not gathered.
    dealt = stage(rows.join(weights.select("key", "blocks"), "key").withColumn(
        "block", F.pmod(F.col("row_key"), F.col("blocks"))).drop("blocks"), "mix-dealt")
    sizes = dealt.groupBy("key", "block").agg(F.sum("n").alias("size"))
    steps = stage(_block_steps(sizes.join(weights, "key"), seed), "mix-blocks")
    inside = W.partitionBy("key", "block").orderBy(F.xxhash64("row_key", F.lit(seed)), "row_key", "doc_id").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    equal = W.partitionBy("key", "block", "row_key", "doc_id")
    placed = dealt.withColumn("end", F.sum("n").over(inside)).withColumn("same", F.count(F.lit(1)).over(equal))
    return (placed.join(steps, ["key", "block"])
            .filter(F.col("before") + F.col("end") <= F.col("budget_tokens"))
            .select("doc_id", "row_key", "same", "source", F.col("n").alias("tokens"), "epoch", "block",
                    ((F.col("before") + F.col("end") - F.col("n")) / F.col("budget_tokens")).alias("mix_position")))


def _block_steps(blocks: DataFrame, seed: int) -> DataFrame:
    """(key, block, epoch, before, budget_tokens): the tokens of the source's schedule that come before the block in
    each epoch that it may take part in.  Two levels of running sums: groups of blocks, blocks in a group."""
    groups = F.greatest(F.lit(1), F.ceil(F.sqrt("blocks"))).cast("long")
    epochs = F.ceil(F.col("budget_tokens") / F.col("n_tokens")).cast("int")
    each = (blocks.withColumn("group", F.pmod(F.xxhash64("block", F.lit(seed)), groups))
            .filter("budget_tokens > 0")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1))))
    by_group = (each.groupBy("key", "epoch", "group").agg(F.sum("size").alias("group_size")))
    up_to = W.partitionBy("key", "epoch").orderBy(F.xxhash64("key", "epoch", "group", F.lit(seed)), "group").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    by_group = by_group.withColumn("group_before", F.sum("group_size").over(up_to) - F.col("group_size")).drop("group_size")
    within = W.partitionBy("key", "epoch", "group").orderBy(
        F.xxhash64("key", "epoch", "block", F.lit(seed)), "block").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = each.withColumn("in_group", F.sum("size").over(within) - F.col("size"))
    return placed.join(by_group, ["key", "epoch", "group"]).select(
        "key", "block", "epoch", (F.col("epoch") * F.col("n_tokens") + F.col("group_before") + F.col("in_group")).alias("before"),
        "budget_tokens")


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A hash of id and text: spreads documents over blocks and tells rows with one id apart."""
    return F.xxhash64(docs[id_col], docs[text_col])


def apply(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The documents as the schedule emits them: all columns, a row per copy."""
    plan = schedule(docs, None, id_col, source_col, text_col, **limits)
    copies = stage(plan.groupBy("row_key", "doc_id").agg(
        F.count(F.lit(1)).alias("copies"), F.max("same").alias("same"))
        .withColumnsRenamed({"row_key": "__m_key", "doc_id": "__m_id", "copies": "__m_copies", "same": "__m_same"}), "mix-copies")
    key, nth, part = (free_name(docs, c) for c in ("__row_key", "__row_nth", "__row_copy"))
    marked = docs.withColumn(key, row_key(docs, id_col, text_col))
    cond = (marked[key] == F.col("__m_key")) & marked[id_col].eqNullSafe(F.col("__m_id"))

    def emit(rows: DataFrame, times) -> DataFrame:
        return rows.withColumn(part, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*docs.columns)
    out = emit(marked.join(copies.filter("__m_same = 1"), cond), F.col("__m_copies"))
    if copies.filter("__m_same > 1").limit(1).count():
        # Rows equal in id and text share their copies out among themselves.
        again = marked.join(copies.filter("__m_same > 1"), cond)
        again = again.withColumn(nth, F.row_number().over(W.partitionBy(key, id_col).orderBy(key)))
        share = F.floor(F.col("__m_copies") / F.col("__m_same")) + (
            F.col(nth) <= F.col("__m_copies") % F.col("__m_same")).cast("int")
        out = out.unionByName(emit(again, share))
    return out

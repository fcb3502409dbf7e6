"""The registered queries of this sub-package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import (exact_dedup, filter_audit, fingerprints, lexical, line_dedup, minhash_join, mixing, packing, quality,
                        quotes, secrets, simhash, toxicity)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the byte-level tokenizer, read where it is installed."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_fm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), metadata=["n_chars"])
    return quality.score(docs, model, metadata=["n_chars"])


def op2_temperature_mixing(spark, sf_dir):
    return mixing.schedule(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "tokens", "epoch", "block", "mix_position")


def op3_line_edit_join(spark, sf_dir):
    return line_dedup.line_classes(table(spark, sf_dir, "documents"), max_edits=None)


def op4_harmonic_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity_ordinal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_exact_dedup_fuse(spark, sf_dir):
    return exact_dedup.groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_secret_forest(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_quotation_links(spark, sf_dir):
    return quotes.link_conversations(table(spark, sf_dir, "conversations"))


def op9_simhash_balls(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_one_permutation_minhash(spark, sf_dir):
    return fingerprints.edited_report(table(spark, sf_dir, "documents"))


def op11_accumulator_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hamming_minhash(spark, sf_dir):
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


def op13_recursive_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_fm, op2_temperature_mixing, op3_line_edit_join, op4_harmonic_packing, op5_toxicity_ordinal,
    op6_exact_dedup_fuse, op7_secret_forest, op8_quotation_links, op9_simhash_balls, op10_one_permutation_minhash, op11_accumulator_search,
    op12_hamming_minhash, op13_recursive_filter_audit, pipeline)}

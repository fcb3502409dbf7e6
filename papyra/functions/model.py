"""Pluggable text model (E2) and document parser (C4) calls, batched through Arrow.

A model is any Python callable ``list[str] -> list[str]`` (one answer per prompt).  It runs inside
``mapInArrow`` tasks, so Spark spreads the calls over executors; the driver never sees a prompt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TextModel = Callable[[list[str]], list[str]]
_HASHED = (T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType)


def md5_model(prompts: list[str]) -> list[str]:
    """Deterministic stand-in model: answers with the MD5 of the prompt (checkable in SQL)."""
    return [None if p is None else hashlib.md5(p.encode("utf-8")).hexdigest() for p in prompts]


def extract_stand_in(prompts: list[str]) -> list[str]:
    """Deterministic stand-in extraction: one answer in sixteen is not JSON, the others carry the prompt's MD5."""
    out = []
    for p in prompts:
        h = hashlib.md5(p.encode("utf-8")).hexdigest()
        out.append("sem dados" if h[0] == "0" else f'{{"tipo_contrato": "{h}", "valor_total": {int(h[:4], 16)}}}')
    return out


def _failing(prompts: list[str], digits: str) -> None:
    if any(hashlib.md5(p.encode("utf-8")).hexdigest()[0] in digits for p in prompts):
        raise RuntimeError("model is away")


def failing_summary(prompts: list[str]) -> list[str]:
    """``md5_model`` with an endpoint that is away for one prompt in eight."""
    _failing(prompts, "ef")
    return md5_model(prompts)


def failing_extract(prompts: list[str]) -> list[str]:
    """``extract_stand_in`` with an endpoint that is away for one prompt in eight."""
    _failing(prompts, "cd")
    return extract_stand_in(prompts)


def parse_lines(content: bytes) -> dict:
    """Stand-in for a parser of a binary format: an element a line; it cannot read files whose size is a multiple of 5."""
    if len(content) % 5 == 0:
        raise ValueError("unreadable")
    return {"metadata": {"version": "2.0"}, "document": {"elements": [{"content": x} for x in content.decode().split("\n")]}}


def _answer_chunk(model: TextModel, prompts: list[str]) -> tuple[list[str | None], list[str | None]]:
    """One model request; if it fails or miscounts, one request per prompt to isolate the failing rows."""
    try:
        answers = list(model(prompts))
        if len(answers) == len(prompts):
            return answers, [None] * len(prompts)
    except Exception:  # noqa: BLE001 - retried per prompt below
        pass
    answers, errors = [], []
    for p in prompts:
        try:
            answers.append(model([p])[0])
            errors.append(None)
        except Exception as e:  # noqa: BLE001
            answers.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return answers, errors


def _call_batches(model: TextModel, prompt_col: str, key_col: str, batch_size: int
                  ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One record batch a request: the prompts of a request are all that a worker unpacks at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch_size):
                part = b.slice(i, batch_size)
                answers, errors = _answer_chunk(model, part.column(prompt_col).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(key_col), pa.array(answers, pa.string()), pa.array(errors, pa.string())],
                    names=[key_col, "response", "model_error"])
    return run


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def prompt_prefix(key: Column) -> Column:
    """The folder of a prompt's answer in a cache: the first two hex digits of its key (256 folders)."""
    return F.substring(key, 1, 2)


def infer_text(df: DataFrame, prompt_col: str, model: TextModel, out_col: str = "response",
               cache: DataFrame | None = None, keep_key: bool = False, batch_size: int = 64,
               partitions: int | None = None, staged: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One model answer per row, each distinct prompt sent once.

    Prompts are keyed by SHA-256; distinct keys are computed with a partial aggregate (a prompt repeated by
    many copies is reduced map-side), prompts already in ``cache`` (``prompt_key, response``) are skipped,
    and the answers are joined back by key.  Prompts go to the model ``batch_size`` at a time (one
    request each) in ``partitions`` tasks; per-row failures land in ``model_error``.  ``staged`` writes the answers (one
    row a key, no prompts) and reads them back, for callers whose result is evaluated more than once.
    """
    keyed = df.select(prompt_key(F.col(prompt_col)).alias("_pk"), "*")
    todo = (keyed.filter(F.col(prompt_col).isNotNull())
            .groupBy("_pk").agg(F.first(prompt_col).alias("_prompt")))
    if cache is not None:
        todo = todo.join(cache.select(F.col("prompt_key").alias("_pk")), "_pk", "left_anti")
    # Model calls are slow and prompts few: spread them on purpose, or small partitions are merged into one task.
    spread = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answered = todo.repartition(spread, "_pk").mapInArrow(_call_batches(model, "_prompt", "_pk", batch_size),
                                "_pk string, response string, model_error string")
    if cache is not None:
        answered = answered.unionByName(
            cache.select(F.col("prompt_key").alias("_pk"), "response", F.lit(None).cast("string").alias("model_error")))
    if staged is not None:
        answered = staged(answered)
    # Rows without a prompt have no key and no answer: they are dealt by their own hash, not all to one task.
    own = [f.name for f in df.schema.fields if isinstance(f.dataType, _HASHED)]
    key = F.coalesce("_pk", F.concat(F.lit("-"), F.xxhash64(*own).cast("string"))) if own else F.col("_pk")
    out = keyed.withColumn("_jk", key).join(answered.withColumnRenamed("_pk", "_jk"), "_jk", "left").drop("_jk")
    out = out.withColumnRenamed("_pk", "prompt_key") if keep_key else out.drop("_pk")
    if out_col != "response":
        out = out.withColumnRenamed("response", out_col)
    return out

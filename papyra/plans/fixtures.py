"""Test inputs derived from the driver tables with Spark (recipes in FIXTURES.md).

Every fixture is a lazy DataFrame over the given parquet tables, so its size grows with them.  The DuckDB
twin of each recipe is in ``papyra.plans.fixtures_sql``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.columns import file_extension
from papyra.functions.partitioning import spread
from papyra.schemas import PENDING, PROCESSED

# Fixed values of the fixture recipes.
FILES_ROOT = "dbfs:/Volumes/main/docs/files/"
CONTRACTS_ROOT = "dbfs:/Volumes/main/docs/contracts/"
EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC
CONTRACT_KINDS = ["Prestação de Serviços", "Compra e Venda", "Locação", "Licenciamento de Software"]
CURRENCIES = ["BRL", "USD", "EUR"]
SAMPLE_RATE = 24000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------------------------------------- files

def _ext(doc_id: Column) -> Column:
    m = doc_id % 3
    return F.when(m == 0, ".pdf").when(m == 1, ".txt").otherwise(".PDF")


def files(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """File inventory rows, one per document."""
    d = table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    name = F.concat(F.lit("doc_"), doc_id.cast("string"), _ext(doc_id))
    cols = [
        doc_id,
        name.alias("file_name"),
        file_extension(name).alias("type"),
        F.col("n_chars").alias("size"),
        F.concat(F.lit(FILES_ROOT), F.col("source"), F.lit("/"), name).alias("file_path"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + doc_id * 3600).alias("upload_time"),
        F.lit(None).cast("timestamp").alias("processed_time"),
        F.md5(F.col("text")).alias("file_hash"),
    ]
    if with_text:
        cols.append(F.col("text"))
    return d.select(cols)


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry before this run: 30% of the files, even ids already processed."""
    f = files(spark, sf_dir).filter(F.col("doc_id") % 10 < 3)
    done = F.col("doc_id") % 2 == 0
    return f.select(
        "file_name", "type", "size",
        F.when(done, F.lit(PROCESSED)).otherwise(F.lit(PENDING)).alias("processed"),
        "file_path", "upload_time",
        F.when(done, F.col("upload_time") + F.expr("INTERVAL 5 MINUTES")).alias("processed_time"),
        "file_hash",
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new directory listing that overlaps the registry by name (and, through exact copies, by hash)."""
    return files(spark, sf_dir).filter(F.col("doc_id") % 10 >= 2).drop("doc_id")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their bytes, as a binary scan would return them: ``(path, content)``."""
    f = files(spark, sf_dir, with_text=True)
    return f.select(F.col("file_path").alias("path"), F.encode(F.col("text"), "UTF-8").alias("content"))


# ----------------------------------------------------------------------------------------------- parse

def doc_id_of(path: Column) -> Column:
    return F.regexp_extract(path, r"doc_(\d+)\.[^./]*$", 1).cast("long")


def fixture_parser(df: DataFrame) -> DataFrame:
    """Stand-in for a binary document parser, keyed on the file id: ``(path, content) -> (path, parsed)``.

    Lines of the decoded text become elements; every 4th file uses the ``pages`` form with version
    ``'1.0'``; every 13th reports ``PARSE_FAILED``; every 17th yields only null contents.
    """
    doc_id = doc_id_of(F.col("path"))
    lines = F.split(F.col("content").cast("string"), "\n")
    nulls = F.col("_id") % 17 == 0
    elems = F.transform(lines, lambda x: F.struct(F.when(~nulls, x).alias("content")))
    as_pages = F.col("_id") % 4 == 0
    failed = F.col("_id") % 13 == 0
    doc = F.struct(F.when(as_pages, elems).alias("pages"), F.when(~as_pages, elems).alias("elements"))
    parsed = F.struct(
        F.struct(F.when(as_pages, "1.0").otherwise("2.0").alias("version")).alias("metadata"),
        F.when(failed, F.lit("PARSE_FAILED")).alias("error_status"),
        F.when(~failed, doc).alias("document"),
    )
    return (df.withColumn("_id", doc_id)
            .select("path", F.parse_json(F.to_json(parsed)).alias("parsed")))


# ----------------------------------------------------------------------------------------------- contracts

def contract_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-truth contract records rendered from orders (and the ordering customer)."""
    o = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    signed = F.to_date(F.col("o_orderdate"))
    kinds = F.array(*[F.lit(x) for x in CONTRACT_KINDS])
    curr = F.array(*[F.lit(x) for x in CURRENCIES])
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
            .select(
                k,
                F.concat(F.lit(CONTRACTS_ROOT), F.lit("contrato_"), k.cast("string"), F.lit(".pdf")).alias("path"),
                F.element_at(kinds, (k % 4 + 1).cast("int")).alias("tipo_contrato"),
                F.concat(F.lit("Contrato nº "), k.cast("string")).alias("nome_contrato"),
                F.col("c_name").alias("contratante"),
                F.lit("Fornecedora Exemplo Ltda").alias("contratado"),
                F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("valor_total"),
                F.element_at(curr, (k % 3 + 1).cast("int")).alias("moeda"),
                signed.alias("data_assinatura"),
                F.date_add(signed, 10).alias("data_inicio_vigencia"),
                F.when(k % 5 != 0, F.date_add(signed, 365)).alias("data_fim_vigencia"),
                F.lit("12 meses").alias("prazo_vigencia"),
                F.concat(F.lit("Fornecimento conforme pedido "), k.cast("string")).alias("objeto_contrato"),
                F.lit("Transferência").alias("forma_pagamento"),
                F.lit("30/60/90 dias").alias("condicoes_pagamento"),
                F.lit("Aviso prévio de 30 dias").alias("clausula_rescisao"),
                ((k % 3 + 1) * 5).cast("double").alias("multa_rescisao"),
                F.lit("Seguro garantia").alias("garantias"),
                F.lit("Sigilo por 5 anos").alias("confidencialidade"),
                F.col("o_orderpriority").alias("foro"),
                F.concat(F.lit("Status "), F.col("o_orderstatus")).alias("observacoes"),
            ))


def model_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text model answered for each contract, with the usual noise: code fences (k%7), a quoted
    number (k%9), a non-JSON answer (k%11), an impossible date (k%13), an empty string (k%6)."""
    from papyra.operators.extraction import render_summary
    from papyra.schemas import CONTRACT_FIELDS, DATE_FIELDS

    t = contract_truth(spark, sf_dir)
    k = F.col("o_orderkey")
    fields = []
    for f in CONTRACT_FIELDS:
        c = F.col(f)
        if f in DATE_FIELDS:
            c = F.date_format(c, "yyyy-MM-dd")
        if f == "data_assinatura":
            c = F.when(k % 13 == 0, F.lit("2024-13-45")).otherwise(c)
        if f == "observacoes":
            c = F.when(k % 6 == 0, F.lit("")).otherwise(c)
        fields.append(c.alias(f))
    # A quoted number and a plain number cannot share one struct field type, so render both forms.
    plain = F.to_json(F.struct(*fields))
    quoted = F.to_json(F.struct(*[
        (F.col("valor_total").cast("string").alias("valor_total") if f == "valor_total" else fields[i])
        for i, f in enumerate(CONTRACT_FIELDS)
    ]))
    js = F.when(k % 9 == 0, quoted).otherwise(plain)
    resp = (F.when(k % 11 == 0, F.lit("Desculpe, não foi possível extrair os dados deste documento."))
            .when(k % 7 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
            .otherwise(js))
    return t.select(k, "path", render_summary(t).alias("summarize"), resp.alias("response"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.operators.extraction import render_summary
    t = contract_truth(spark, sf_dir)
    return t.select("o_orderkey", "path", render_summary(t).alias("summarize"))


WRAP = "e o que mais constar"        # fixed value: the second line of a wrapped summary value


def wrapped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries; every fourth has its values run on over a second line, which carries the citation."""
    s = summary(spark, sf_dir)
    return s.withColumn("summarize", F.when(F.col("o_orderkey") % 4 == 0, F.replace(
        F.col("summarize"), F.lit(" [página "), F.lit(f"\n  {WRAP} [página "))).otherwise(F.col("summarize")))


# ----------------------------------------------------------------------------------------------- chat

def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns wrapped in the two response shapes a serving endpoint returns (by ``turn % 3``)."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    t = F.col("turn") % 3
    run_id = F.concat(F.lit("run--"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    out_form = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("content")))
                                  .alias("output")))
    msg = lambda i, r, txt: F.struct(i.alias("id"), F.lit(r).alias("role"), txt.alias("content"))
    with_run = F.to_json(F.struct(F.array(
        msg(F.lit("msg-0"), "user", F.lit("pergunta")),
        msg(run_id, "assistant", F.col("text")),
    ).alias("messages")))
    last_assistant = F.to_json(F.struct(F.array(
        msg(F.lit("msg-0"), "assistant", F.lit("rascunho")),
        msg(F.lit("msg-1"), "assistant", F.col("text")),
        msg(F.lit("msg-2"), "user", F.lit("obrigado")),
    ).alias("messages")))
    body = F.when(t == 0, out_form).when(t == 1, with_run).otherwise(last_assistant)
    return c.select("conv_id", "turn", body.alias("response"))


# ----------------------------------------------------------------------------------------------- events

def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio-track writes: track = user, length = ``k`` of props, interrupts where event_type = error."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("track_id"), "event_id", "ts",
        F.get_json_object("props", "$.k").cast("long").alias("length"),
        (F.col("event_type") == "error").alias("is_interrupt"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation items with versions: item = conversation, seq = turn; fields blanked by ``turn % 3``."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn") % 3
    return c.select(
        F.col("conv_id").alias("item_id"), F.col("turn").alias("seq"),
        F.when(F.col("role") != "system", F.col("role")).alias("role"),
        F.when(F.col("role") == "system", F.lit("function_call_output")).otherwise(F.lit("message")).alias("type"),
        F.when(t == 0, F.lit(None).cast("string")).when(t == 1, F.lit("")).otherwise(F.col("text")).alias("transcript"),
        F.col("text").alias("text"),
        (t == 1).alias("has_audio"),
    )


def deleted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.filter(F.col("conv_id") % 10 == 0).select(F.col("conv_id").alias("item_id")).distinct()


# ----------------------------------------------------------------------------------------------- signals

def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors as sample arrays: ``channel = vec_id % 2``, ``signal_id = vec_id div 2``."""
    e = spread(table(spark, sf_dir, "embeddings"), "vec_id")
    return e.select(
        "vec_id",
        (F.col("vec_id") % 2).cast("int").alias("channel"),
        F.floor(F.col("vec_id") / 2).cast("long").alias("signal_id"),
        F.col("embedding").alias("samples"),
    )


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as decibel spectra: ``-100 + 70*|v|``."""
    s = signals(spark, sf_dir)
    return s.select("vec_id", F.transform("samples", lambda v: F.lit(-100.0) + F.lit(70.0) * F.abs(v.cast("double")))
                    .alias("db"))


# ----------------------------------------------------------------------------------------------- landing

def land_documents(spark: SparkSession, sf_dir: str, landing: str, only: str = "true", suffix: str = "") -> int:
    """Write every document as its own file ``doc_<id><ext>`` into ``landing`` (a shared folder); ``only`` (a SQL
    condition) and ``suffix`` (appended to the text) replace some of them later.

    The writes happen inside Spark tasks through ``pyarrow.fs`` (local, HDFS or object-store URIs), so the
    driver only sees the file count.  Returns the number of files written.
    """
    from papyra.sources.files import _file_system, qualified
    folder = qualified(spark, landing)

    def write(batches):
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for i, doc_id in enumerate(ids):
                ext = [".pdf", ".txt", ".PDF"][doc_id % 3]
                with fs.open_output_stream(f"{base}/doc_{doc_id}{ext}") as out:
                    out.write(((texts[i].as_py() or "") + suffix).encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64())], names=["n"])

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text").filter(only), "doc_id")
    # Counted by the tasks that write: a count of its own would deal all the texts a second time.
    return docs.mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0

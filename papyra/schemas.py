"""Declared schemas of the stored tables and in-flight shapes."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------------------
# Fixed values that must equal the application's: the contract record's 19 fields in their declared order,
# which of them are numbers and which are dates.
CONTRACT_FIELDS = [
    "tipo_contrato", "nome_contrato", "contratante", "contratado", "valor_total", "moeda",
    "data_assinatura", "data_inicio_vigencia", "data_fim_vigencia", "prazo_vigencia", "objeto_contrato",
    "forma_pagamento", "condicoes_pagamento", "clausula_rescisao", "multa_rescisao", "garantias",
    "confidencialidade", "foro", "observacoes",
]
DOUBLE_FIELDS = ["valor_total", "multa_rescisao"]
DATE_FIELDS = ["data_assinatura", "data_inicio_vigencia", "data_fim_vigencia"]
# Registry status flags: 'N' = pending, 'S' = processed.
PENDING, PROCESSED = "N", "S"
# ---------------------------------------------------------------------------------------------------------

FILE_INVENTORY = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("upload_time", T.TimestampType()),
    T.StructField("processed_time", T.TimestampType()),
    T.StructField("file_hash", T.StringType()),
])

CONTRACT_TRACK = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("processed", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("upload_time", T.TimestampType()),
    T.StructField("processed_time", T.TimestampType()),
    T.StructField("file_hash", T.StringType()),
])

CONTRACT_PARSED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("raw_parsed", T.VariantType()),
    T.StructField("text", T.StringType()),
    T.StructField("summarize", T.StringType()),
    T.StructField("error_status", T.StringType()),
])


def _field_type(name: str, dates_as_string: bool) -> T.DataType:
    if name in DOUBLE_FIELDS:
        return T.DoubleType()
    if name in DATE_FIELDS and not dates_as_string:
        return T.DateType()
    return T.StringType()


# Struct bound to the model's JSON answer: dates are text here, DATE in the stored table.
EXTRACTION_STRUCT = T.StructType([T.StructField(f, _field_type(f, True)) for f in CONTRACT_FIELDS])
# Lenient read schema: every field as text, typed afterwards with try-casts (see operators.extraction).
EXTRACTION_TEXT_STRUCT = T.StructType([T.StructField(f, T.StringType()) for f in CONTRACT_FIELDS])

CONTRACT_EXTRACT = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("summarize", T.StringType())]
    + [T.StructField(f, _field_type(f, False)) for f in CONTRACT_FIELDS]
)

# As the ingestion run stores them: with the content hash of the identity, and how the extraction went.
STORED_PARSED = T.StructType(CONTRACT_PARSED.fields + [T.StructField("file_hash", T.StringType())])
STORED_EXTRACT = T.StructType(CONTRACT_EXTRACT.fields + [T.StructField("file_hash", T.StringType()),
                                                         T.StructField("extract_status", T.StringType())])

CHAT_MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

"""Summary and structured extraction.

The model is injected (E2); everything around it is native: prompt assembly, JSON hardening, typing,
null and field rules, the summary renderer and its reader.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.columns import blank_to_null
from papyra.functions.model import TextModel, infer_text
from papyra.schemas import CONTRACT_FIELDS, DATE_FIELDS, DOUBLE_FIELDS, EXTRACTION_TEXT_STRUCT

# ---------------------------------------------------------------------------------------------------------
# The summary template's section titles and labelled lines, in order, and the citation
# format.  ``head`` lines are bold titles (optionally with a value), ``item`` lines are ``- label: value``,
# ``text`` lines are ``- value``.  The third entry is the contract field printed there.
SUMMARY_TEMPLATE = [
    ("head", "Tipo de Contrato", "tipo_contrato"),
    ("head", "Nome/Identificação do Contrato", "nome_contrato"),
    ("head", "Partes Envolvidas", None),
    ("item", "Contratante", "contratante"),
    ("item", "Contratado", "contratado"),
    ("head", "Valores e Condições Financeiras", None),
    ("item", "Valor Total", "valor_total"),
    ("item", "Moeda", "moeda"),
    ("item", "Forma de Pagamento", "forma_pagamento"),
    ("item", "Condições de Pagamento", "condicoes_pagamento"),
    ("head", "Datas e Prazos", None),
    ("item", "Data de Assinatura", "data_assinatura"),
    ("item", "Início da Vigência", "data_inicio_vigencia"),
    ("item", "Fim da Vigência", "data_fim_vigencia"),
    ("item", "Prazo de Vigência", "prazo_vigencia"),
    ("head", "Objeto do Contrato", None),
    ("text", None, "objeto_contrato"),
    ("head", "Cláusulas Importantes", None),
    ("item", "Rescisão", "clausula_rescisao"),
    ("item", "Multas", "multa_rescisao"),
    ("item", "Garantias", "garantias"),
    ("item", "Confidencialidade", "confidencialidade"),
    ("head", "Aspectos Legais", None),
    ("item", "Foro", "foro"),
    ("head", "Observações Relevantes", None),
    ("text", None, "observacoes"),
]
CITATION = "[página {}]"
MISSING_VALUE = "Não informado"
OBJECT_MAX_CHARS = 500
# ---------------------------------------------------------------------------------------------------------

SUMMARY_INSTRUCTIONS = (
    "Você resume contratos. Leia o documento e responda seguindo exatamente este modelo, "
    "com uma linha por item e a citação [página X] depois de cada informação:\n"
    + "\n".join(
        f"**{t}:**" if k == "head" else (f"- {t}:" if k == "item" else "- (descrição)")
        for k, t, _ in SUMMARY_TEMPLATE)
    + "\n\nTEXT: "
)
EXTRACTION_INSTRUCTIONS = (
    "Você extrai dados de contratos. Responda somente com um objeto JSON, sem cercas de código, com as "
    "chaves " + ", ".join(CONTRACT_FIELDS) + ". Valores monetários apenas como número (ex: 1234.56); "
    "datas no formato YYYY-MM-DD; objeto_contrato com no máximo 500 caracteres; use null para o que não "
    "existir e nunca string vazia.\n\nextract_from: "
)


# ----------------------------------------------------------------------------------------------- E1 / E2 / E3

def build_prompt(text: str | Column, kind: str = "summary") -> Column:
    """Instruction + document text; NULL text gives a NULL prompt (``concat`` propagates NULL)."""
    head = SUMMARY_INSTRUCTIONS if kind == "summary" else EXTRACTION_INSTRUCTIONS
    return F.concat(F.lit(head), F.col(text) if isinstance(text, str) else text)


def summarize_documents(df: DataFrame, text_col: str, model: TextModel, out_col: str = "summarize",
                        error_col: str | None = None, staged: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """E3 (model path): prompt + one model call per distinct document.  ``error_col`` names a column that keeps the
    text of a failed call (a NULL summary without one comes from a NULL text); ``staged``: see ``infer_text``."""
    p = df.withColumn("_prompt", build_prompt(text_col, "summary"))
    out = infer_text(p, "_prompt", model, out_col=out_col, staged=staged).drop("_prompt")
    return out.withColumnRenamed("model_error", error_col) if error_col else out.drop("model_error")


def _render_value(f: str) -> Column:
    c = F.col(f)
    if f in DATE_FIELDS:
        c = F.date_format(c, "yyyy-MM-dd")
    elif f in DOUBLE_FIELDS:
        c = F.format_string("%.2f", c)
    return F.coalesce(c.cast("string"), F.lit(MISSING_VALUE))


def render_summary(df: DataFrame | None = None, page: Column | None = None) -> Column:
    """E3 (native path): the summary template filled from structured fields, one line per entry."""
    if page is None:
        page = (F.col("o_orderkey") % 5 + 1) if df is not None and "o_orderkey" in df.columns else None
    cite = (lambda: F.concat(F.lit(" [página "), page.cast("string"), F.lit("]"))) if page is not None \
        else (lambda: F.lit(""))
    lines = []
    for kind, title, field in SUMMARY_TEMPLATE:
        if kind == "head" and field is None:
            lines.append(F.lit(f"**{title}:**"))
        elif kind == "head":
            lines.append(F.concat(F.lit(f"**{title}:** "), _render_value(field), cite()))
        elif kind == "item":
            lines.append(F.concat(F.lit(f"- {title}: "), _render_value(field), cite()))
        else:
            lines.append(F.concat(F.lit("- "), _render_value(field), cite()))
    return F.concat_ws("\n", *lines)


# ----------------------------------------------------------------------------------------------- E4

# A title or a bullet begins an entry ("* " and "• " read as "- "; bold titles are no bullets); what follows up to the
# next one continues it.
_ENTRY = re.compile(r"\n(?=\*\*|[ \t]*[*•-][ \t]+)")
_HEAD = re.compile(r"(?s)\*\*([^*]+):\*\*(.*)\Z")
_ITEM = re.compile(r"(?s)[ \t]*[*•-][ \t]+([^:\n]+): ?(.*)\Z")
_BULLET = re.compile(r"(?s)[ \t]*[*•-][ \t]+(.*)\Z")
_CITE = re.compile(r"\[página ([0-9]+)\]")
_SPACE = " \t\n\x0b\f\r"
_CITED = re.compile(rf"[{_SPACE}]*\[página [0-9]+\]")
_BREAK = re.compile(rf"[{_SPACE}]*\n[{_SPACE}]*")
_ROWS_OUT = 20_000


def _value(text: str) -> tuple[str, int | None]:
    """A value without its citations and on one line, and its first page."""
    page = None
    if "[página " in text:
        first = _CITE.search(text)
        page = int(first[1]) if first else None
        text = _CITED.sub("", text)
    if "\n" in text:
        text = _BREAK.sub(" ", text)
    return text.strip(" "), page


def summary_entries(text: str) -> Iterator[tuple[int, str | None, str | None, str, int | None]]:
    """(line_no, section, label, value, page) of the entries of one summary that have a value."""
    line, section = 1, None
    for entry in _ENTRY.split(text):
        label, value = None, ""
        if entry.startswith("**"):
            head = _HEAD.match(entry)
            if head and head[1].strip(" "):
                label = section = head[1].strip(" ")
                value = head[2]
        else:
            item = _ITEM.match(entry)
            if item and item[1].strip(" "):
                label, value = item[1].strip(" "), item[2]
            else:
                bullet = _BULLET.match(entry)
                value = bullet[1] if bullet else ""
        if value.strip(" "):
            yield (line, section, label, *_value(value))
        line += entry.count("\n") + 1


def _summary_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
    for b in batches:
        texts, owner, rows = b.column(1), [], []
        for i in range(b.num_rows):
            found = [*summary_entries(texts[i].as_py())] if texts[i].is_valid else []
            owner += [i] * len(found)
            rows += found
            if rows and (len(rows) >= _ROWS_OUT or i + 1 == b.num_rows):
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), *cols],
                                                 names=[b.schema.names[0], "line_no", "section", "label", "value", "page"])
                owner, rows = [], []


def parse_summary(df: DataFrame, text_col: str = "summarize", key: str = "path") -> DataFrame:
    """Read a template summary back into ``(key, line_no, section, label, value, page)`` rows.

    One pass over the entries of a text inside the row's task, which carries the line number and the section and matches
    each entry once (a fold of column expressions is interpreted, and matches an entry anew at each mention).  A value
    runs on over the lines up to the next title or bullet, joined by a space, with the citations on all of them (``page``
    is the first one).  Text before the first title or bullet is not a value.
    """
    kind = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("line_no", T.IntegerType()),
                         *[T.StructField(c, T.StringType()) for c in ("section", "label", "value")],
                         T.StructField("page", T.IntegerType())])
    return df.select(F.col(key), F.col(text_col)).mapInArrow(_summary_rows, kind)


# ----------------------------------------------------------------------------------------------- E5 - E10

_LENIENT = T.StructType(EXTRACTION_TEXT_STRUCT.fields + [T.StructField("_corrupt_record", T.StringType())])


def json_object_text(response: str | Column) -> Column:
    """Strip code fences and keep the outermost ``{...}`` block (empty string when there is none)."""
    r = F.col(response) if isinstance(response, str) else response
    text = F.coalesce(r, F.lit(""))
    no_fence = F.when(text.contains("```"), F.regexp_replace(text, r"```[A-Za-z]*", "")).otherwise(text)
    return F.regexp_extract(no_fence, r"(?s)(\{.*\})", 1)


def to_number(c: Column) -> Column:
    """Money/percent text to DOUBLE: drops currency signs and spaces; ``1.234,56`` and ``1,234.56`` both
    read as 1234.56; anything else that is not a number is NULL (never an error).  Plain numbers, which no other reading
    fits (``1.234`` has one), are read as they stand."""
    plain = c.rlike(r"^-?[0-9]+(\.[0-9]{1,2})?\z")
    s = F.regexp_replace(F.trim(c), r"[^0-9,.eE+\-]", "")
    br = s.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$") | s.rlike(r"^-?[0-9]+,[0-9]+$")
    us = s.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$")
    norm = (F.when(br, F.translate(F.regexp_replace(s, r"\.", ""), ",", "."))
            .when(us, F.regexp_replace(s, ",", "")).otherwise(s))
    return F.when(plain, c.try_cast("double")).otherwise(norm.try_cast("double"))


DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy")


def coerce_date(c: Column) -> Column:
    """``YYYY-MM-DD`` text to DATE (``DD/MM/YYYY``, a common deviation, is accepted too); impossible
    dates become NULL.  Text of the first form is cast: a failing formatter costs an exception for each value."""
    t = F.trim(c)
    return (F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), t.try_cast("date"))
            .otherwise(F.coalesce(*[F.try_to_date(t, fmt) for fmt in DATE_FORMATS])))


def extract_text_fields(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Hardened JSON read: every field as text plus ``extract_status`` (ok / no_json / invalid_json)."""
    obj = F.col("_o")
    parsed = F.from_json(obj, _LENIENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    status = (F.when(obj == "", F.lit("no_json"))
              .when(F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull(), F.lit("invalid_json"))
              .otherwise(F.lit("ok")))
    # The block has a column of its own, since it is used more than once.
    return (df.withColumn("_o", json_object_text(response_col)).withColumn("_j", parsed)
            .withColumn("extract_status", status)
            .withColumn("raw_fields", F.when(F.col("extract_status") == "ok", F.struct(
                *[F.col(f"_j.{f}").alias(f) for f in CONTRACT_FIELDS])))
            .drop("_j", "_o"))


def typed_fields(raw: str = "raw_fields", cap_object: bool = False) -> list[Column]:
    """E8 + E9 + E10: text fields to their declared types with blank values as NULL.  A value longer than the
    model was asked for is kept whole (``field_rules`` reports it); ``cap_object`` cuts it on request."""
    out = []
    for f in CONTRACT_FIELDS:
        c = F.col(f"{raw}.{f}")
        if f in DOUBLE_FIELDS:
            out.append(to_number(c).alias(f))
        elif f in DATE_FIELDS:
            out.append(coerce_date(c).alias(f))
        else:
            c = blank_to_null(c)
            if f == "objeto_contrato" and cap_object:
                c = F.left(c, F.lit(OBJECT_MAX_CHARS))
            out.append(c.alias(f))
    return out


def extract_fields(df: DataFrame, response_col: str = "response") -> DataFrame:
    """E5: model answer to a typed 19-field struct ``info`` plus ``extract_status``.

    Fenced JSON, quoted numbers and impossible dates no longer null the whole record; a non-JSON answer
    gives an all-NULL struct with ``extract_status = 'no_json'``/``'invalid_json'``.
    """
    t = extract_text_fields(df, response_col)
    return t.withColumn("info", F.struct(*typed_fields())).drop("raw_fields")


def expand_struct(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Struct to columns."""
    keep = keep if keep is not None else ["path", "summarize"]
    return df.select(*keep, "info.*")


def null_rules(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Empty or blank strings become NULL."""
    cols = cols or [f for f in CONTRACT_FIELDS if f not in DOUBLE_FIELDS + DATE_FIELDS]
    return df.select(*[blank_to_null(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def field_rules(df: DataFrame, response_col: str = "response") -> DataFrame:
    """How many answers break each stated rule, one row per rule (a single partial aggregate)."""
    t = extract_text_fields(df, response_col)
    rf = lambda f: F.col(f"raw_fields.{f}")
    numeric = r"^-?[0-9]+(\.[0-9]+)?$"
    strings = [f for f in CONTRACT_FIELDS if f not in DOUBLE_FIELDS + DATE_FIELDS]
    checks = {
        "code_fence": F.col(response_col).contains("```"),
        "invalid_json": F.col("extract_status") != "ok",
        "objeto_over_500": F.length(rf("objeto_contrato")) > OBJECT_MAX_CHARS,
        "money_not_numeric": F.greatest(*[(rf(f).isNotNull() & ~F.trim(rf(f)).rlike(numeric)).cast("int")
                                          for f in DOUBLE_FIELDS]) == 1,
        "bad_date": F.greatest(*[(rf(f).isNotNull() & coerce_date(rf(f)).isNull()).cast("int")
                                 for f in DATE_FIELDS]) == 1,
        "empty_string": F.greatest(*[(rf(f) == "").cast("int") for f in strings]) == 1,
    }
    agg = t.agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(k) for k, c in checks.items()])
    stack = "stack({n}, {pairs}) as (rule, violations)".format(
        n=len(checks), pairs=", ".join(f"'{k}', {k}" for k in checks))
    return agg.selectExpr(stack)


def write_extract(parsed: DataFrame, existing: DataFrame | None, response_col: str = "response") -> DataFrame:
    """Extract rows for parsed documents not yet extracted (anti join on path): re-running a batch adds
    nothing, unlike a plain append."""
    todo = parsed if existing is None else parsed.join(existing.select("path"), "path", "left_anti")
    return expand_struct(extract_fields(todo, response_col))

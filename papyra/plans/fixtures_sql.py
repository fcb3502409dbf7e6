"""DuckDB twins of the Spark fixtures (``papyra.plans.fixtures``), as CTE text for the oracle queries.

Each function returns ``name AS (...)`` fragments over the driver's pre-registered views; ``with_ctes``
assembles them in dependency order.
"""

from __future__ import annotations

from papyra.operators.extraction import MISSING_VALUE, SUMMARY_TEMPLATE
from papyra.plans.fixtures import CONTRACT_KINDS, CONTRACTS_ROOT, CURRENCIES, FILES_ROOT
from papyra.schemas import CONTRACT_FIELDS, DATE_FIELDS, DOUBLE_FIELDS


def _sql_list(vals: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in vals) + "]"


CTE = {
    "files": f"""files AS (
  SELECT doc_id, file_name,
         CASE doc_id % 3 WHEN 1 THEN 'txt' ELSE 'pdf' END AS type,
         n_chars AS size,
         '{FILES_ROOT}' || source || '/' || file_name AS file_path,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS upload_time,
         CAST(NULL AS TIMESTAMP) AS processed_time,
         md5(text) AS file_hash, text
  FROM (SELECT *, 'doc_' || CAST(doc_id AS VARCHAR)
                  || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' ELSE '.PDF' END AS file_name
        FROM documents) d)""",
    "track": """track AS (
  SELECT file_name, type, size, CASE WHEN doc_id % 2 = 0 THEN 'S' ELSE 'N' END AS processed,
         file_path, upload_time,
         CASE WHEN doc_id % 2 = 0 THEN upload_time + INTERVAL 5 MINUTE END AS processed_time,
         file_hash, doc_id
  FROM files WHERE doc_id % 10 < 3)""",
    "incoming": """incoming AS (
  SELECT file_name, type, size, file_path, upload_time, processed_time, file_hash, doc_id
  FROM files WHERE doc_id % 10 >= 2)""",
    "new_files": """new_files AS (
  SELECT i.file_name, i.type, i.size, 'N' AS processed, i.file_path, i.upload_time, i.processed_time,
         i.file_hash, i.doc_id
  FROM incoming i
  WHERE NOT EXISTS (SELECT 1 FROM track t WHERE i.file_name = t.file_name OR i.file_hash = t.file_hash))""",
    "registry": """registry AS (
  SELECT file_name, type, size, processed, file_path, upload_time, processed_time, file_hash FROM track
  UNION ALL
  SELECT file_name, type, size, processed, file_path, upload_time, processed_time, file_hash FROM new_files)""",
    "truth": f"""truth AS (
  SELECT o.o_orderkey,
         '{CONTRACTS_ROOT}contrato_' || CAST(o.o_orderkey AS VARCHAR) || '.pdf' AS path,
         {_sql_list(CONTRACT_KINDS)}[o.o_orderkey % 4 + 1] AS tipo_contrato,
         'Contrato nº ' || CAST(o.o_orderkey AS VARCHAR) AS nome_contrato,
         c.c_name AS contratante,
         'Fornecedora Exemplo Ltda' AS contratado,
         CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS valor_total,
         {_sql_list(CURRENCIES)}[o.o_orderkey % 3 + 1] AS moeda,
         CAST(o.o_orderdate AS DATE) AS data_assinatura,
         CAST(o.o_orderdate AS DATE) + 10 AS data_inicio_vigencia,
         CASE WHEN o.o_orderkey % 5 <> 0 THEN CAST(o.o_orderdate AS DATE) + 365 END AS data_fim_vigencia,
         '12 meses' AS prazo_vigencia,
         'Fornecimento conforme pedido ' || CAST(o.o_orderkey AS VARCHAR) AS objeto_contrato,
         'Transferência' AS forma_pagamento,
         '30/60/90 dias' AS condicoes_pagamento,
         'Aviso prévio de 30 dias' AS clausula_rescisao,
         CAST((o.o_orderkey % 3 + 1) * 5 AS DOUBLE) AS multa_rescisao,
         'Seguro garantia' AS garantias,
         'Sigilo por 5 anos' AS confidencialidade,
         o.o_orderpriority AS foro,
         'Status ' || o.o_orderstatus AS observacoes
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)""",
    # What extraction must return for each contract, given the noise in the model answers.
    "extracted": """extracted AS (
  SELECT o_orderkey, path,
         {fields}
  FROM truth)""",
}


def _extracted_fields() -> str:
    out = []
    for f in CONTRACT_FIELDS:
        expr = f
        if f == "data_assinatura":
            expr = f"CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {f} END"
        if f == "observacoes":
            expr = f"CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {f} END"
        null = "CAST(NULL AS DOUBLE)" if f in DOUBLE_FIELDS else ("CAST(NULL AS DATE)" if f in DATE_FIELDS
                                                                 else "CAST(NULL AS VARCHAR)")
        out.append(f"CASE WHEN o_orderkey % 11 = 0 THEN {null} ELSE {expr} END AS {f}")
    return ",\n         ".join(out)


CTE["extracted"] = CTE["extracted"].format(fields=_extracted_fields())


def render_value_sql(f: str) -> str:
    if f in DATE_FIELDS:
        e = f"strftime({f}, '%Y-%m-%d')"
    elif f in DOUBLE_FIELDS:
        e = f"printf('%.2f', {f})"
    else:
        e = f
    return f"coalesce({e}, '{MISSING_VALUE}')"


def summary_sql() -> str:
    """The rendered summary text, built the same way in SQL."""
    cite = "' [página ' || CAST(o_orderkey % 5 + 1 AS VARCHAR) || ']'"
    parts = []
    for kind, title, field in SUMMARY_TEMPLATE:
        if kind == "head" and field is None:
            parts.append(f"'**{title}:**'")
        elif kind == "head":
            parts.append(f"'**{title}:** ' || {render_value_sql(field)} || {cite}")
        elif kind == "item":
            parts.append(f"'- {title}: ' || {render_value_sql(field)} || {cite}")
        else:
            parts.append(f"'- ' || {render_value_sql(field)} || {cite}")
    return " || chr(10) || ".join(parts)


CTE["summary"] = f"""summary AS (
  SELECT o_orderkey, path, {summary_sql()} AS "summarize" FROM truth)"""

_DEPS = {
    "files": [], "track": ["files"], "incoming": ["files"], "new_files": ["track", "incoming"],
    "registry": ["new_files"], "truth": [], "extracted": ["truth"], "summary": ["truth"],
}


def with_ctes(*names: str, extra: str = "") -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [CTE[n] for n in order]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"

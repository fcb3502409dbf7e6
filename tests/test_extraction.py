import json
from datetime import date

from pyspark.sql import functions as F

from papyra.operators import extraction as ext
from papyra.schemas import CONTRACT_FIELDS


def _resp(spark, rows):
    return spark.createDataFrame(rows, "path string, response string")


def _good(**over):
    d = {f: None for f in CONTRACT_FIELDS}
    d.update(tipo_contrato="Locação", valor_total=1500.5, data_assinatura="2024-01-15", objeto_contrato="x" * 600)
    d.update(over)
    return json.dumps(d, ensure_ascii=False)


def test_hardened_json(spark):
    df = _resp(spark, [
        ("plain", _good()),
        ("fenced", "```json\n" + _good() + "\n```"),
        ("quoted", _good(valor_total="1.234,56", multa_rescisao="10%")),
        ("bad_date", _good(data_assinatura="2024-13-45")),
        ("br_date", _good(data_assinatura="15/01/2024")),
        ("empty", _good(tipo_contrato="  ")),
        ("prose", "Não consegui ler o contrato."),
        ("broken", '{"tipo_contrato": "A", '),
        ("null", None),
    ])
    out = {r.path: r for r in ext.expand_struct(ext.extract_fields(df), keep=["path", "extract_status"]).collect()}
    assert out["plain"].valor_total == 1500.5 and out["plain"].data_assinatura == date(2024, 1, 15)
    assert len(out["plain"].objeto_contrato) == 600      # kept whole; the rule report counts it
    assert {r.rule: r.violations for r in ext.field_rules(df).collect()}["objeto_over_500"] > 0
    assert out["fenced"].tipo_contrato == "Locação" and out["fenced"].extract_status == "ok"
    assert out["quoted"].valor_total == 1234.56 and out["quoted"].multa_rescisao == 10.0
    assert out["bad_date"].data_assinatura is None and out["bad_date"].tipo_contrato == "Locação"
    assert out["br_date"].data_assinatura == date(2024, 1, 15)
    assert out["empty"].tipo_contrato is None
    assert out["prose"].extract_status == "no_json" and out["prose"].tipo_contrato is None
    assert out["broken"].extract_status in ("no_json", "invalid_json") and out["broken"].tipo_contrato is None
    assert out["null"].extract_status == "no_json"


def test_summary_round_trip(spark):
    from papyra.plans import fixtures as fx
    from conftest import SF0001
    t = fx.contract_truth(spark, SF0001).limit(3)
    s = t.select("o_orderkey", "path", ext.render_summary(t).alias("summarize"))
    rows = ext.parse_summary(s).collect()
    by = {(r.path, r.label): r for r in rows if r.label}
    one = t.first()
    assert by[(one.path, "Contratante")].value == one.contratante
    assert by[(one.path, "Contratante")].page == one.o_orderkey % 5 + 1
    assert by[(one.path, "Tipo de Contrato")].section == "Tipo de Contrato"


def test_prompt_is_null_for_null_text(spark):
    df = spark.createDataFrame([("a", None), ("b", "texto")], "path string, t string")
    got = {r.path: r.p for r in df.select("path", ext.build_prompt("t").alias("p")).collect()}
    assert got["a"] is None and got["b"].endswith("texto")


def test_summary_bullet_variants(spark):
    text = "**Partes Envolvidas:**\n* Contratante: ACME [página 2]\n• Contratado: Beta\n  - Foro: SP"
    df = spark.createDataFrame([("p", text)], "path string, summarize string")
    got = {r.label: (r.section, r.value, r.page) for r in ext.parse_summary(df).collect()}
    assert got == {"Contratante": ("Partes Envolvidas", "ACME", 2), "Contratado": ("Partes Envolvidas", "Beta", None),
                   "Foro": ("Partes Envolvidas", "SP", None)}


def test_model_calls_are_chunked_and_failures_isolated(spark):
    from papyra.functions.model import infer_text
    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "k int, prompt string").coalesce(1)

    def model(prompts):
        if len(prompts) > 3:
            raise RuntimeError("request too large")
        if "p7" in prompts and len(prompts) == 1:
            raise ValueError("bad prompt")
        if "p7" in prompts:
            raise ValueError("batch with a bad prompt")
        return [p.upper() for p in prompts]

    out = {r.k: (r.response, r.model_error) for r in infer_text(df, "prompt", model, batch_size=3).collect()}
    assert out[0] == ("P0", None) and out[9] == ("P9", None)
    assert out[7][0] is None and out[7][1].startswith("ValueError")
    assert out[6] == ("P6", None) and out[8] == ("P8", None)  # siblings of the bad prompt still answered


def test_summary_values_run_on_over_lines(spark):
    text = ("Resumo do contrato\n**Partes Envolvidas:**\n- Contratante: ACME\n  Ltda, com sede [página 1]\n  em São Paulo [página 2]\n\n"
            "* Contratado: X\n**Objeto do Contrato:**\ntexto livre\nem duas linhas [página 3]\n**Aspectos Legais:**\n- sem rótulo\n  continua\n"
            "• Foro: Recife")
    df = spark.createDataFrame([("p", text), ("q", None), ("r", "")], "path string, summarize string")
    got = [tuple(r)[1:] for r in ext.parse_summary(df).orderBy("line_no").collect()]
    assert got == [
        (3, "Partes Envolvidas", "Contratante", "ACME Ltda, com sede em São Paulo", 1),
        (7, "Partes Envolvidas", "Contratado", "X", None),
        (8, "Objeto do Contrato", "Objeto do Contrato", "texto livre em duas linhas", 3),
        (12, "Aspectos Legais", None, "sem rótulo continua", None),
        (14, "Aspectos Legais", "Foro", "Recife", None)]


def test_answer_is_cut_to_its_json_once(spark):
    t = ext.extract_fields(_resp(spark, [("a", "```json\n" + _good() + "\n```")]))
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("```[A-Za-z]*") == 1


def test_plain_values_read_as_by_their_patterns(spark):
    rows = [("1234.5", "2024-02-29"), ("1.234", "2023-02-29"), ("1.2E7", "29/02/2024"), ("-0.25", "2024-02-29\n"), ("x", "2024-2-9")]
    df = spark.createDataFrame(rows, "n string, d string").select(ext.to_number(F.col("n")), ext.coerce_date(F.col("d")))
    assert [tuple(r) for r in df.collect()] == [(1234.5, date(2024, 2, 29)), (1234.0, None), (1.2e7, date(2024, 2, 29)),
                                                (-0.25, None), (None, None)]


def test_summary_is_read_without_an_interpreted_fold(spark):
    text = "intro\n**Valores:**\n- Total: 5 [página 3]\n  e mais [página 4]\n• solto\n** :** x\n**Foro:** Rio"
    df = ext.parse_summary(spark.createDataFrame([("a", text), ("b", None)], "path string, summarize string"))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in df.orderBy("line_no").collect()] == [
        ("a", 3, "Valores", "Total", "5 e mais", 3), ("a", 5, "Valores", None, "solto", None), ("a", 7, "Foro", "Foro", "Rio", None)]


def test_rows_without_a_prompt_are_dealt_over_the_tasks(spark):
    """rows without a prompt have a null key; one task got all of them wherever the join is by shuffle."""
    from papyra.functions.model import infer_text, md5_model
    df = spark.range(400).selectExpr("id", "CASE WHEN id % 4 = 0 THEN concat('p', id % 8) END AS prompt")
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = infer_text(df, "prompt", md5_model).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert sorted(r.id for r in rows) == list(range(400))
    assert all(r.response == (md5_model([r.prompt])[0]) and r.model_error is None for r in rows)
    assert len({r.part for r in rows if r.prompt is None}) > 1

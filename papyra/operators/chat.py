"""Chat context and response data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.sequence import neighbour

# The context cap, the separator between summaries, the message used when there are no
# contracts, the text returned when a response message has no content, and the run-message id prefix.
CONTEXT_MAX_CHARS = 2000
CONTEXT_SEPARATOR = "\n\n"
NO_CONTRACTS_MESSAGE = "Nenhum contrato encontrado no banco de dados."
EMPTY_ANSWER = "⚠️ Resposta vazia do modelo."
RUN_PREFIX = "run--"

SYSTEM_PROMPT_HEAD = ("Você é um assistente jurídico que analisa contratos. Responda em português, de forma "
                      "clara e objetiva, usando como fonte os dados abaixo:\n")
SYSTEM_PROMPT_TAIL = ("\n\nSe os dados não bastarem para responder, diga isso. Destaque valores, prazos, partes "
                      "e cláusulas relevantes.")


def chat_context(contracts: DataFrame, max_chars: int = CONTEXT_MAX_CHARS, text_col: str = "summarize",
                 order_col: str = "path") -> DataFrame:
    """G1: all non-null summaries in ``order_col`` order joined by a blank line, cut to ``max_chars``.

    Only the first ``max_chars // 2 + 1`` summaries (each cut to ``max_chars``) can reach the cut: every
    summary after the first adds at least the 2-character separator.  So a distributed top-k bounds the
    state regardless of the table size.  One output row: ``(context, n_contracts)``; the fixed message
    appears only when there are no contract rows at all.
    """
    k = max_chars // 2 + 1
    item = F.struct(F.col(order_col).alias("o"), F.left(F.col(text_col), F.lit(max_chars)).alias("s"))
    top = (contracts.filter(F.col(text_col).isNotNull()).select(item.alias("item"))
           .orderBy(F.col("item.o")).limit(k).select("item", F.lit(0).cast("long").alias("n")))
    count = contracts.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast(top.schema["item"].dataType).alias("item"), "n")
    u = top.unionByName(count)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["s"]), CONTEXT_SEPARATOR)
    agg = u.agg(F.sum("n").alias("n_contracts"), joined.alias("_j"))
    return agg.select(
        F.when(F.col("n_contracts") == 0, F.lit(NO_CONTRACTS_MESSAGE))
         .otherwise(F.left(F.col("_j"), F.lit(max_chars))).alias("context"),
        "n_contracts")


def system_prompt(context: Column) -> Column:
    return F.concat(F.lit(SYSTEM_PROMPT_HEAD), context, F.lit(SYSTEM_PROMPT_TAIL))


def chat_prompt(questions: DataFrame, context: DataFrame, text_col: str = "text") -> DataFrame:
    """The system + user message pair for each question, as columns and as a request JSON.

    The one-row context enters as a scalar subquery (evaluated once, broadcast), not a join."""
    ctx = context.select("context").scalar()
    sys_c = system_prompt(ctx)
    msgs = F.array(F.struct(F.lit("system").alias("role"), sys_c.alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col(text_col).alias("content")))
    return questions.select("*", sys_c.alias("system_content"), F.col(text_col).alias("user_content"),
                            F.to_json(F.struct(msgs.alias("input"))).alias("request_json"))


_MSGS = "array<struct<id:string,role:string,content:string>>"


def extract_answer(df: DataFrame, response_col: str = "response") -> DataFrame:
    """First non-empty of ``output[0].content[0].text``; the first message whose id starts with
    ``run--``; the last assistant message; else the whole response text."""
    v = F.try_parse_json(F.col(response_col))
    out_text = F.try_variant_get(v, "$.output[0].content[0].text", "string")
    msgs = F.try_variant_get(v, "$.messages", _MSGS)
    run = F.try_element_at(F.filter(msgs, lambda m: F.startswith(F.coalesce(m["id"], F.lit("")), F.lit(RUN_PREFIX))),
                           F.lit(1))
    last = F.try_element_at(F.filter(msgs, lambda m: m["role"] == F.lit("assistant")), F.lit(-1))
    answer = F.coalesce(
        F.when(out_text != "", out_text),
        F.when(run.isNotNull(), F.coalesce(run["content"], F.lit(EMPTY_ANSWER))),
        F.when(last.isNotNull(), F.coalesce(last["content"], F.lit(EMPTY_ANSWER))),
        F.col(response_col))
    return df.withColumn("answer", answer)


def append_turn(history: DataFrame, exchanges: DataFrame, order: str | None = None) -> DataFrame:
    """Append ``(conv_id, question, answer)`` to each conversation as two new turns after its last.  Several
    exchanges of one conversation follow each other by ``order`` (a column), else by question and answer."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_t"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(*([order] if order else []), "question", "answer")) - 1
    e = (exchanges.withColumn("_n", nth).join(last, "conv_id", "left")
         .withColumn("_t", F.coalesce("_t", F.lit(-1)) + 2 * F.col("_n")))
    new = (e.select("conv_id", (F.col("_t") + 1).alias("turn"), F.lit("user").alias("role"),
                    F.col("question").alias("text"))
           .unionByName(e.select("conv_id", (F.col("_t") + 2).alias("turn"), F.lit("assistant").alias("role"),
                                 F.col("answer").alias("text"))))
    return history.select("conv_id", "turn", "role", "text").unionByName(new)


def turn_pairs(chat: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Each user message with the assistant reply that directly follows it."""
    n = neighbour(chat, "conv_id", F.col("turn"), ["turn"], ["role", "text"], "next", width)
    return (n.filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
            .select("conv_id", "turn", F.col("text").alias("question"), F.col("next_text").alias("answer")))


def history_view(chat: DataFrame) -> DataFrame:
    """Messages as ``[text, 'user'|'bot']``."""
    return chat.select("conv_id", "turn", "text",
                       F.when(F.col("role") == "user", F.lit("user")).otherwise(F.lit("bot")).alias("speaker"))


def skip_blank_input(chat: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop blank messages."""
    return chat.filter(F.col(text_col).isNotNull() & (F.trim(F.col(text_col)) != ""))

"""Conversations from quoting messages: quotation linking.

Each message is parsed into its own lines and its quoted passages: a run of lines with one quote level (the number of
``>`` before the text), with lines that announce a quote ("... wrote:") left out.  Passages, their paragraphs and their
longer lines are normalised (white space, case) and hashed; the same units of every message's own text form the index.
A quoted unit is linked to the first message that says it: in the same conversation (an earlier turn), else anywhere
earlier (conversation, turn).  A whole passage meets a whole message of its own conversation at any length; parts, and
links to other conversations, take units of ``LEAST_CHARS`` or more, which no two people say by chance.  The index holds one row per unit, however many messages repeat it, so a very common
phrase is one row too.  Of a message's links the one with the longest unit of the outermost level wins and is the
message it replies to; without one it replies to the message before it in its conversation.

Conversations whose messages quote each other form a thread (connected components over conversations).  Replies refer
to earlier (conversation, turn) only, so ordering by these keeps every reply behind what it replies to; a position
within the conversation is counted in two levels (blocks of turns), not in one task per conversation.

Edge cases: null text is empty; a message of quotes only has an empty body and stays; null conversations are one
conversation, null turns come first; repeated rows are messages of their own that follow each other; extra columns are
left behind; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.llm.common import null_safe, stage
from papyra.llm.components import components

LEAST_CHARS = 16          # shorter units link whole passages to whole messages of one conversation only
BLOCK = 1_024             # turns of a conversation that are numbered in one task

_MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SPACE = re.compile(r"\s+")
# Ends of lines that announce a quotation, in the corpus' languages.
_ANNOUNCE = re.compile(r"(wrote|writes|schrieb|a écrit|écrit|escribió|escribio)\s*:\s*$", re.IGNORECASE)


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(body, passages): the message's own text, and its quoted passages as (level, text) in order."""
    own, passages, level = [], [], 0
    for line in text.split("\n"):
        line = line.rstrip("\r")
        m = _MARK.match(line)
        depth = m.group(1).count(">") if m else 0
        if depth:
            if level == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and _ANNOUNCE.search(own[-1]):
                    own.pop()
            rest = line[m.end():]
            if depth == level:
                passages[-1][1].append(rest)
            else:
                if passages and level and _ANNOUNCE.search(passages[-1][1][-1]) and depth > level:
                    passages[-1][1].pop()
                passages.append((depth, [rest]))
        else:
            own.append(line)
        level = depth
    out = [(d, "\n".join(ls).strip()) for d, ls in passages]
    return "\n".join(own).strip(), [(d, t) for d, t in out if t]


def units(text: str) -> dict[bytes, int]:
    """Hash -> length of the normalised whole, paragraphs and lines of a text."""
    parts = [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]
    out = {}
    for k, p in enumerate(parts):
        norm = _SPACE.sub(" ", p).strip().lower()
        if len(norm) >= LEAST_CHARS or norm and k == 0:
            out[xxhash.xxh128_digest(norm.encode("utf-8", "replace"))] = len(norm)
    return out


_UNIT = "array<struct<level: int, hash: binary, chars: int>>"


def parsed(messages: DataFrame) -> DataFrame:
    """(key, conv_id, turn, nth, role, body, said, quoted): units of the own text and of the quoted passages."""
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("chars", pa.int32())]))
    keep = ["conv_id", "turn", "nth", "role"]

    def run(batches):
        for b in batches:
            body, said, quoted = [], [], []
            for t in b.column("text"):
                own, passages = parse(t.as_py() or "")
                body.append(own)
                said.append([{"level": 0, "hash": h, "chars": n} for h, n in units(own).items()])
                least: dict[bytes, tuple[int, int]] = {}
                for level, text in passages:
                    for h, n in units(text).items():
                        least[h] = min(least.get(h, (level, n)), (level, n))
                quoted.append([{"level": lv, "hash": h, "chars": n} for h, (lv, n) in least.items()])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(body, pa.string()), pa.array(said, kind), pa.array(quoted, kind)],
                names=[*keep, "body", "said", "quoted"])
    kinds = dict(messages.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in keep)
    return messages.mapInArrow(run, f"{head}, body string, said {_UNIT}, quoted {_UNIT}")


def _numbered(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The messages with nth: 0, or a number that tells rows with one conversation and turn apart."""
    src = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                          F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    same = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    return src.withColumn("nth", F.row_number().over(same) - 1)


def link_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text") -> DataFrame:
    """One row per message: thread_id, conv_id, position, turn, role, body, reply_conv_id, reply_turn, link
    ('quote', 'sequence' or 'root') and quoted_chars (length of the unit that linked it)."""
    rows = stage(parsed(_numbered(messages, conv_col, turn_col, role_col, text_col)), "parsed")
    at = F.struct(F.col("conv_id").isNotNull().alias("k"), "conv_id", F.col("turn").isNotNull().alias("t"), "turn", "nth")
    quoted = rows.select("conv_id", "turn", "nth", at.alias("at"), F.explode("quoted").alias("q")).select(
        "conv_id", "turn", "nth", "at", "q.*")
    wanted = quoted.select("hash").distinct()
    said = (rows.select("conv_id", at.alias("at"), F.explode("said").alias("s")).select("conv_id", "at", F.col("s.hash").alias("hash"))
            .join(wanted, "hash", "left_semi"))
    inside = said.groupBy("conv_id", "hash").agg(F.min("at").alias("here")).withColumnsRenamed({"conv_id": "i_conv", "hash": "i_hash"})
    ever = said.groupBy("hash").agg(F.min("at").alias("first"))
    found = (quoted.join(inside, null_safe([quoted.conv_id, quoted.hash], [inside.i_conv, inside.i_hash]), "left")
             .join(ever, "hash", "left")
             .withColumn("source", F.when(F.col("here") < F.col("at"), F.col("here"))
                         .when((F.col("chars") >= LEAST_CHARS) & (F.col("first") < F.col("at")), F.col("first")))
             .filter(F.col("source").isNotNull()))
    best = stage(found.groupBy("conv_id", "turn", "nth").agg(
        F.max_by(F.struct("source", "chars"), F.struct(-F.col("level"), "chars", F.col("here").isNotNull(), F.hash("hash"))).alias("b"))
        .select(F.col("conv_id").alias("b_conv"), F.col("turn").alias("b_turn"), F.col("nth").alias("b_nth"),
                F.col("b.source.conv_id").alias("r_conv"), F.col("b.source.turn").alias("r_turn"), F.col("b.chars").alias("chars")),
        "reply-links")
    placed = _positions(rows.select("conv_id", "turn", "nth", "role", "body"))
    out = placed.join(best, null_safe([placed.conv_id, placed.turn, placed.nth], [best.b_conv, best.b_turn, best.b_nth]), "left")
    threads = _threads(best)
    named = out.join(threads, null_safe([out.conv_id], [threads.t_conv]), "left")
    # b_nth is set exactly where a quotation was linked (its conversation and turn may be null themselves).
    by_quote, after = F.col("b_nth").isNotNull(), F.col("position") > 0
    return named.select(
        F.coalesce("thread", "conv_id").alias("thread_id"), "conv_id", "position", "turn", "role", "body",
        F.when(by_quote, F.col("r_conv")).when(after, F.col("conv_id")).alias("reply_conv_id"),
        F.when(by_quote, F.col("r_turn")).when(after, F.col("last_turn")).alias("reply_turn"),
        F.when(by_quote, "quote").when(after, "sequence").otherwise("root").alias("link"),
        F.coalesce("chars", F.lit(0)).alias("quoted_chars"))


def _positions(rows: DataFrame) -> DataFrame:
    """``rows`` with position (0-based place in the conversation) and last_turn (the turn before), counted within
    blocks of turns and then over blocks."""
    block = F.floor(F.col("turn") / F.lit(BLOCK))
    dealt = rows.withColumn("block", block)
    inner = W.partitionBy("conv_id", "block").orderBy("turn", "nth")
    each = dealt.withColumn("at", F.row_number().over(inner) - 1).withColumn("before", F.lag(F.struct("turn")).over(inner))
    sizes = dealt.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"), F.max("turn").alias("end"))
    over = W.partitionBy("conv_id").orderBy("block")
    sizes = sizes.select(F.col("conv_id").alias("s_conv"), F.col("block").alias("s_block"),
                         (F.sum("size").over(over.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")).alias("offset"),
                         F.lag("end").over(over).alias("last_end"))
    joined = each.join(sizes, null_safe([each.conv_id, each.block], [sizes.s_conv, sizes.s_block]))
    return joined.select(*rows.columns, (F.col("at") + F.col("offset")).alias("position"),
                         F.when(F.col("before").isNotNull(), F.col("before.turn")).otherwise(F.col("last_end")).alias("last_turn"))


def _threads(best: DataFrame) -> DataFrame:
    """(t_conv, thread): the least conversation of those that quotations connect."""
    edges = best.filter(F.col("b_conv").isNotNull() & F.col("r_conv").isNotNull() & (F.col("b_conv") != F.col("r_conv"))).select(
        F.col("b_conv").alias("a"), F.col("r_conv").alias("b"))
    return components(edges).select(F.col("node").alias("t_conv"), F.col("root").alias("thread"))


def chat_messages(linked: DataFrame) -> DataFrame:
    """The linked messages as chat records, a JSON object each, to be read in the order of (thread_id, conv_id,
    position): role and content without quotes."""
    return linked.select("thread_id", "conv_id", "position", F.to_json(F.struct(
        F.coalesce("role", F.lit("user")).alias("role"), F.col("body").alias("content"))).alias("message"))

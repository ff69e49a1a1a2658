"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is a sequence of ``<|im_start|>role<|im_sep|>text<|im_end|>``. The parser is deterministic: it splits at the
end marks, and a piece is a turn only if it begins with a start mark, holds one separator and no other reserved string.
Each turn is rendered as it is and parsed again; where the result is not the turn, reserved strings in it are escaped: a
backslash is put behind the first character of each, before those that may stand there already, so that ``</s>``
becomes ``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``. Parsing takes one away, whatever the text held. Finally the whole
conversation is parsed and compared with its source; a difference is an error.

The loss mask lists the code points of assistant texts in the formatted conversation.

Defined results: null roles and texts are empty; rows without a conversation form one conversation; turns are ordered by
turn (nulls first), then role, then text, so repeated rows are repeated turns; an empty table gives no rows; columns
of other names are not looked at. A conversation becomes one value, so it must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What follows the first character of the reserved strings, as patterns.
RESERVED = r"(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])"
LOSS_ROLE = "assistant"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + RESERVED, r"$1\\$2$3")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + RESERVED, "$1$2$3")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(SEP), text, F.lit(END))


def parsed_turn(piece: Column) -> Column:
    """role and text of a piece without its end mark; null if it is not a turn."""
    inner = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
    parts = F.split(inner, r"<\|im_sep\|>", -1)
    fits = piece.startswith(START) & (F.size(parts) == 2) & ~F.exists(parts, lambda p: F.rlike(p, F.lit(r"[<\[]" + RESERVED)))
    return F.when(fits, F.struct(unescaped(parts[0]).alias("role"), unescaped(parts[1]).alias("text")))


def pieces_of(formatted: Column) -> Column:
    """The pieces before the end marks; what follows the last mark must be nothing."""
    parts = F.split(formatted, r"<\|im_end\|>", -1)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: key, formatted, mask (start, end, turn number, start of the turn; in code points)."""
    rows = turns.select(F.col(key), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = rendered(F.col("role"), F.col("text"))
    once = F.split(plain, r"<\|im_end\|>", -1)
    again = parsed_turn(once[0])
    same = (F.size(once) == 2) & (again["role"] == F.col("role")) & (again["text"] == F.col("text"))
    rows = rows.withColumn("clean", F.coalesce(same, F.lit(False)))
    rows = rows.withColumns({"r": F.when(F.col("clean"), F.col("role")).otherwise(escaped(F.col("role"))), "t": F.when(F.col("clean"), F.col("text")).otherwise(escaped(F.col("text")))})
    rows = rows.withColumn("n", F.length("r") + F.length("t") + len(START + SEP + END))
    order = Window.partitionBy(key).orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"i": F.row_number().over(order), "at": F.sum("n").over(upto) - F.col("n")})
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "role", "text", "r", "t", "at", "n"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda x: rendered(x["r"], x["t"])), "")
    head = lambda x: x["at"] + F.length(x["r"]) + len(START + SEP)
    mask = F.transform(
        F.filter("turns", lambda x: x["role"] == LOSS_ROLE),
        lambda x: F.struct(head(x).alias("start"), (x["at"] + x["n"] - len(END)).alias("end"), x["i"].alias("turn"), x["at"].alias("turn_start")),
    )
    done = whole.select(key, "turns", formatted.alias("formatted"), mask.alias("mask"))
    back = F.transform(pieces_of(F.col("formatted")), parsed_turn)
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    checked = F.when(back == source, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not parse back to its turns")).cast("string"))
    return done.select(key, checked.alias("formatted"), "mask")


def read_back(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of the turns and of the text under the mask, read from the formatted conversations."""
    opened = chats.select(key, "formatted", "mask", pieces_of(F.col("formatted")).alias("pieces"))
    turns = F.transform("pieces", parsed_turn)
    under = F.transform("mask", lambda m: unescaped(F.substring(F.element_at("pieces", m["turn"].cast("int")), (m["start"] - m["turn_start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    opened = opened.withColumns({"turns": turns, "loss": F.array_join(under, "")})
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return opened.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    chats = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_chats(chats.unionAll(extra)))


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) + 32 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: the formatted turns before it are
context, and only that reply is under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: What the extra conversation of the query says in both of its turns.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    r"""``<``, k backslashes, ``|`` gets one more backslash, so no control string is left in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # a backslash pair is one backslash, backslash-n is a line feed; the placeholder cannot occur after START
    plain = F.replace(unescape(role), F.lit("\\\\"), F.lit(START))
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit(START), F.lit("\\"))


def format_examples(turns: DataFrame) -> DataFrame:
    """One row per training example of every conversation.

    Output: conv_id, example (0, 1, ...), target_turn (position of the reply in
    its conversation, null for a tail), formatted, loss_start, loss_end (code
    points of ``formatted`` under the loss mask).

    * A conversation that does not end with an assistant turn also gets a tail
      example that holds all of its turns and an empty mask, so no turn is lost.
    * Null text or role is empty text. Turns go by ``turn`` (null last), then
      role and text; repeated rows are kept as turns of their own.
    * A null conv_id is a conversation of its own. An empty table gives no rows.
    * Only conv_id, turn, role and text are read; other columns do not matter.
    """
    turn = F.struct(
        F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = grouped.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.transform("turns", lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("texts"),
    )
    n = F.size("roles")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("roles", i) == "assistant")
    tail = F.when(F.element_at("roles", -1) != "assistant", F.array(n + 1)).otherwise(F.array().cast("array<int>"))
    rows = pieces.select("*", F.posexplode(F.concat(targets, tail)).alias("example", "at"))
    turns_before = F.transform(
        F.slice("heads", F.lit(1), F.col("at") - 1), lambda h, i: F.concat(h, F.element_at("texts", i + 1), F.lit(END))
    )
    context = F.array_join(turns_before, "")
    is_target = F.col("at") <= n
    reply = F.when(is_target, F.get("texts", F.col("at") - 1)).otherwise("")
    parts = rows.select(
        "conv_id", "example", F.when(is_target, F.col("at") - 1).alias("target_turn"),
        F.concat(context, F.when(is_target, F.get("heads", F.col("at") - 1)).otherwise("")).alias("before"),
        reply.alias("reply"), F.when(is_target, F.lit(END)).otherwise("").alias("after"),
    )
    return parts.select(
        "conv_id", "example", "target_turn", F.concat("before", "reply", "after").alias("formatted"),
        F.length("before").cast("long").alias("loss_start"),
        (F.length("before") + F.length("reply")).cast("long").alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say when parsed: turns, and text under the mask."""
    masked = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("all_turns"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("example", masked.alias("text")))), lambda e: e["text"]), ""
        ).alias("loss_text"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    cut = F.split("all_turns", r"<\|im_end\|>\n", -1)
    parsed = whole.select(
        "conv_id", "loss_text", "formatted_chars",
        F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda p: F.split(p, "\n", 2)).alias("turns"),
    )
    return parsed.select(
        "conv_id", "loss_text", "formatted_chars",
        F.transform(
            "turns",
            lambda t: F.struct(
                _unescape_role(F.substring(t[0], len(START) + 1, 1 << 30)).alias("role"), unescape(t[1]).alias("text")
            ),
        ).alias("turns"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    back = read_back(format_examples(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n,
    CAST(length(replace(role, '\', '\\')) + length(role) - length(replace(role, chr(10), ''))
      + len(regexp_extract_all(role, '<\\*\|')) + 13
      + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 11 AS BIGINT) AS piece
  FROM t),
c AS (SELECT *, CAST(sum(piece) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS upto FROM o)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR pos = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
text is trainable. A conversation that does not end with an assistant turn gives one more example
that holds all its turns and trains nothing, so that no turn is lost.

The template writes a turn as ``<s>role`` + line break + text + ``</s>``. Control strings of this
and of common other templates inside a text are broken by a backslash after their first character;
backslashes already there get one more, so removing one brings back the text. Roles are
percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<s>", "</s>"
#: First character, backslashes, rest of: <s> </s> [INST] [/INST] <<SYS>> <</SYS>> <|
_REST = r"(/?s>|/?INST\]|</?SYS>>|\|)"
CONTROL = r"([<\[])(\\*)" + _REST
ESCAPED = r"([<\[])\\(\\*)" + _REST


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def expand(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per example: the conversation, _own, example (number of the turn it ends with, from 0),
    formatted, loss_start and loss_end (code points of ``formatted``), whole (holds all turns).

    Turns are ordered by turn, then role and text; repeated rows are turns of their own. NULL roles
    and texts count as empty. Rows without a conversation are conversations of one turn each, told
    apart by ``_own``. Other columns are not looked at; an empty table gives no examples. A
    conversation is one training text, so its turns meet in one row.
    """
    own = F.when(F.col(conversation).isNull(), F.monotonically_increasing_id())
    turns = rows.select(
        F.col(conversation).alias("_conversation"),
        own.alias("_own"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    together = turns.groupBy("_conversation", "_own").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    heads = F.transform("_turns", lambda t: F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n")))
    marked = together.select(
        "_conversation",
        "_own",
        F.transform("_turns", lambda t: t["role"] == trained).alias("_trained"),
        heads.alias("_heads"),
        F.transform("_turns", lambda t: escape(t["text"])).alias("_texts"),
    )
    last = F.size("_texts") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("_trained", i) | (i == last))
    examples = marked.select("*", F.explode(ends).alias("example"))
    before = F.zip_with(
        F.slice("_heads", 1, F.col("example")), F.slice("_texts", 1, F.col("example")), lambda h, t: F.concat(h, t, F.lit(CLOSE))
    )
    prompt = F.concat(F.concat_ws("", before), F.get("_heads", F.col("example")))
    target = F.get("_texts", F.col("example"))
    built = examples.select(
        "_conversation", "_own", "example", prompt.alias("_prompt"), target.alias("_target"),
        F.get("_trained", F.col("example")).alias("_trains"), (F.col("example") == last).alias("whole"),
    )
    start = F.length("_prompt")
    return built.select(
        F.col("_conversation").alias(conversation),
        "_own",
        "example",
        F.concat("_prompt", "_target", F.lit(CLOSE)).alias("formatted"),
        start.alias("loss_start"),
        F.when(F.col("_trains"), start + F.length("_target")).otherwise(start).alias("loss_end"),
        "whole",
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.split(formatted, CLOSE)
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    return F.transform(
        turns,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )


def trained_text(formatted: Column, loss_start: Column, loss_end: Column) -> Column:
    """What is under the loss mask, unescaped."""
    return unescape(F.substr(formatted, loss_start + 1, loss_end - loss_start))


def summary(examples: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.when(F.col("whole"), turns_of(F.col("formatted")))
    read = examples.select(
        conversation, "_own", "example", turns.alias("_turns"), F.length("formatted").alias("_chars"),
        trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("_trained"),
    )
    lines = F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    digested = read.select(
        conversation, "_own", "example", "_trained", "_chars", F.size("_turns").alias("_n"),
        F.when(F.col("_turns").isNotNull(), F.sha2(lines, 256)).alias("_sha"),
    )
    replies = F.sort_array(F.collect_list(F.struct("example", "_trained")))
    found = digested.groupBy(conversation, "_own").agg(
        F.max("_n").cast("long").alias("n_turns"),
        F.max("_sha").alias("turns_sha256"),
        F.concat_ws("", F.transform(replies, lambda r: r["_trained"])).alias("_loss"),
        F.sum("_chars").alias("formatted_chars"),
    )
    return found.select(
        conversation,
        "n_turns",
        "turns_sha256",
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, 8 + length(url_encode(role)) + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|)', '\1\\\2\3', 'g')) AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM t),
u AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE last OR role = 'assistant')::BIGINT AS formatted_chars FROM u GROUP BY conv_id"""

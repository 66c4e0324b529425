"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into blocks by
slices of that array; and the blocks are concatenated:

    [INST]role[/INST]text<s>text of the next turn of the same role</s>

Texts and roles are escaped so that no control string can stand in them: a backslash is doubled, and the first
character of a control string becomes \\l (for <) or \\b (for [). Reading reverses all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.native import let, parts_of, run_of, sums

OPEN, CLOSE, NEXT, END = "[INST]", "[/INST]", "<s>", "</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (NEXT, END):
        out = F.replace(out, F.lit(control), F.lit("\\l" + control[1:]))
    for control in (OPEN, CLOSE):
        out = F.replace(out, F.lit(control), F.lit("\\b" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    plain = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _blocks(turns: Column) -> Column:
    """Sorted turns, those of one role that follow each other merged."""
    starts = F.filter(run_of(F.size(turns)), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))
    ends = lambda s: F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(turns)))
    return let(starts, lambda s: F.zip_with(s, ends(s), lambda a, b: F.struct(turns[a]["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("parts"))))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss), one row for each conversation.

    loss is the array of (start, end) code points of the assistant's texts, escaped as they stand in formatted.
    Turns go by turn number; equal numbers by role and then text, and a null number comes first. A null text or
    role is empty. Rows without conv_id form one conversation with a null id; repeated rows are turns of their own.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.select(F.col(id_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = chats.select("conv_id", let(F.col("turns"), _blocks).alias("blocks"))
    shown = F.transform("blocks", lambda b: F.struct((b["role"] == "assistant").alias("learn"), F.concat(F.lit(OPEN), escape(b["role"]), F.lit(CLOSE)).alias("head"), F.transform(b["parts"], escape).alias("parts")))
    shown = blocks.select("conv_id", shown.alias("blocks"))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["parts"], NEXT), F.lit(END))), "")
    return shown.select("conv_id", whole.alias("formatted"), _mask(F.col("blocks")).alias("loss"))


def _mask(blocks: Column) -> Column:
    """Where the parts of the blocks to learn stand in the formatted text, by running sums of all lengths."""

    def sized(b: Column) -> Column:
        before = lambda j: F.when(j == 0, F.length(b["head"]) + len(END)).otherwise(F.lit(len(NEXT)))
        return F.transform(b["parts"], lambda p, j: F.struct(b["learn"].alias("learn"), F.length(p).alias("n"), (F.length(p) + before(j)).alias("all")))

    def spans(parts: Column) -> Column:
        ends = sums(F.transform(parts, lambda p: p["all"]))
        end = lambda e: e - len(END)  # no end stands before the first block
        every = F.zip_with(parts, ends, lambda p, e: F.struct(p["learn"].alias("learn"), F.struct((end(e) - p["n"]).alias("start"), end(e).alias("end")).alias("span")))
        return F.transform(F.filter(every, lambda x: x["learn"]), lambda x: x["span"])

    return let(F.flatten(F.transform(blocks, sized)), spans)


def read_conversation(formatted: Column) -> Column:
    """The turns, array<(role, text)>, of a formatted conversation."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substring(b, F.lit(len(OPEN) + 1), F.length(b)), CLOSE, 1)
        body = F.substring(b, F.length(role) + len(OPEN) + len(CLOSE) + 1, F.length(b))
        return F.transform(F.split(body, NEXT, -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learnt_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return parts_of(formatted, lambda part: F.array_join(F.transform(loss, lambda s: unescape(part(s["start"], s["end"]))), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted rows."""
    read = formatted.select("conv_id", "formatted", read_conversation(F.col("formatted")).alias("turns"), learnt_text(F.col("formatted"), F.col("loss")).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The query in DuckDB.
ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]')) AS n, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS head FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN head THEN 17 + length(role) ELSE 3 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

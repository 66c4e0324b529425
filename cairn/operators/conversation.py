"""Conversation windows, budgets and citations (C1-C23). Messages: (session, seq, role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import message_text, token_estimate

#: Fixed values.
SAFETY, SOFT_SHARE, TOOL_FLOOR, WINDOW_CAP = 1.2, 0.8, 512, 200_000
ITEM_BUDGET, TOTAL_BUDGET = 6000, 12000


def with_turns(messages: DataFrame, session: str = "conv_id", seq: str = "turn", role: str = "role") -> DataFrame:
    """turn_no counts user messages so far; what stands before the first one has 0."""
    so_far = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn_no", F.sum((F.col(role) == "user").cast("int")).over(so_far))


def last_turns(messages: DataFrame, n: int, keep_system: bool = True, session: str = "conv_id", seq: str = "turn", role: str = "role") -> DataFrame:
    """The last n turns; a session without a user message stays whole; the first system message may stay."""
    rows = with_turns(messages, session, seq, role)
    whole = Window.partitionBy(session)
    turns = F.max("turn_no").over(whole)
    first_system = F.min(F.when(F.col(role) == "system", F.col(seq))).over(whole)
    recent = (F.col("turn_no") > turns - n) & (F.col("turn_no") > 0) | (turns == 0)
    kept = recent | (F.col(seq) == first_system) if keep_system else recent
    return rows.withColumn("__keep", F.coalesce(kept, F.lit(False))).filter("__keep").drop("__keep")


def drop_orphan_tools(messages: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """A tool row stays if an earlier message of its session made that call."""
    calls = messages.select(F.col(session).alias("__s"), F.col(seq).alias("__at"), F.explode("tool_calls").alias("c")).select("__s", F.col("c.id").alias("__call"), "__at").groupBy("__s", "__call").agg(F.min("__at").alias("__at"))
    met = messages.join(calls, (F.col(session) == F.col("__s")) & (F.col("tool_call_id") == F.col("__call")), "left")
    return met.filter((F.col("role") != "tool") | F.coalesce(F.col("__at") < F.col(seq), F.lit(False))).select(*messages.columns)


def token_window(messages: DataFrame, most: int, least_turns: int = 1, session: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """C4: whole turns from the end while their tokens fit, or up to least_turns; most <= 0 keeps nothing.

    The first turn that doesn't fit ends the window, even if an earlier one would.
    """
    if most <= 0:
        return with_turns(messages, session, seq, role).limit(0)
    rows = with_turns(messages, session, seq, role).withColumn("__t", token_estimate(F.col(text)))
    turns = rows.groupBy(session, "turn_no").agg(F.sum("__t").alias("__n"))
    back = Window.partitionBy(session).orderBy(F.desc("turn_no"))
    turns = turns.withColumn("__sum", F.sum("__n").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__i", F.row_number().over(back))
    kept = turns.filter((F.col("__sum") <= most) | (F.col("__i") <= least_turns)).select(session, "turn_no")
    return rows.join(kept, [session, "turn_no"]).drop("__t")


def budget(parts: DataFrame, window: int, reserve: int, session: str = "conv_id", section: str = "role", text: str = "text") -> DataFrame:
    """Tokens by section, and whether a session uses more than its share of the soft limit."""
    soft = window - reserve
    used = parts.groupBy(session, section).agg(F.sum(token_estimate(F.col(text))).alias("tokens"))
    return used.groupBy(session).agg(F.sum("tokens").alias("used"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(section, "tokens")))).alias("breakdown")).withColumn("over", F.col("used") > soft * SOFT_SHARE)


def shrink_tools(messages: DataFrame, overflow: Column, session: str = "session_id", seq: str = "seq", text: str = "content") -> DataFrame:
    """The oldest tool outputs are cut to the floor until what they free covers the overflow."""
    rows = messages.withColumn("__t", token_estimate(F.col(text)))
    saves = F.when(F.col("role") == "tool", F.greatest(F.col("__t") - TOOL_FLOOR, F.lit(0))).otherwise(0)
    before = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__saves", saves).withColumn("__before", F.coalesce(F.sum("__saves").over(before), F.lit(0)))
    cut = (F.col("__saves") > 0) & (F.col("__before") < overflow)
    return rows.withColumn("shrunk", cut).withColumn(text, F.when(cut, F.left(F.col(text), F.lit(TOOL_FLOOR * 4))).otherwise(F.col(text))).drop("__t", "__saves", "__before")


def context_limit(models: DataFrame, limits: DataFrame) -> DataFrame:
    """The declared window of a model, by its plain name, at most the cap."""
    name = F.lower(F.element_at(F.split("model", "/"), -1))
    return models.withColumn("name", name).join(limits.withColumnRenamed("model", "name"), "name", "left").withColumn("window", F.least(F.coalesce("context", F.lit(WINDOW_CAP)), F.lit(WINDOW_CAP)))


def assign_aliases(seen: DataFrame, session: str = "session_id", chunk: str = "chunk_id", at: str = "pos") -> DataFrame:
    """c1, c2 ... by first appearance in the session."""
    first = seen.groupBy(session, chunk).agg(F.min(at).alias("first_at"))
    n = F.row_number().over(Window.partitionBy(session).orderBy("first_at", chunk))
    return first.withColumn("alias", F.concat(F.lit("c"), n.cast("string")))


def cited(citations: DataFrame, answers: DataFrame, session: str = "session_id") -> DataFrame:
    """Citations whose alias the answer names; none named, none kept."""
    from cairn.functions.text import cited_aliases

    named = answers.select(session, F.explode(cited_aliases(F.col("content"))).alias("alias")).distinct()
    return citations.join(named, [session, "alias"], "left_semi")


def enrich(chunks: DataFrame, files: DataFrame, kb: str) -> DataFrame:
    """Each chunk's file, the asked knowledge base first, then the earliest."""
    rn = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc(F.col("knowledge_base_id") == kb), "create_time", "file_id"))
    one = files.filter("deleted = 0").withColumn("__rn", rn).filter("__rn = 1").select("document_id", "file_id", "file_name")
    return chunks.join(one, "document_id", "left")


def within_budget(items: DataFrame, session: str, order: str, text: str = "text", item: int = ITEM_BUDGET, total: int = TOTAL_BUDGET) -> DataFrame:
    """Each item cut to its budget, items in order while the total fits."""
    rows = items.withColumn(text, F.left(F.col(text), F.lit(item)))
    upto = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__sum", F.sum(F.length(text)).over(upto)).filter(F.col("__sum") <= total).drop("__sum")


def recent(messages: DataFrame, n: int, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    """C20: the last n messages of each session, with their position from the start of the page."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(seq)))
    rows = messages.withColumn("__rn", back).filter(F.col("__rn") <= n)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(seq))).drop("__rn")


def sessions(messages: DataFrame, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    """Counters of each session and its last assistant message."""
    return messages.groupBy(session).agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("turns"), F.max_by("text", F.when(F.col("role") == "assistant", F.col(seq))).alias("last_assistant"))


def compress(messages: DataFrame, n: int, most: int = 200, session: str = "conv_id", seq: str = "turn", text: str = "text") -> DataFrame:
    """What precedes the last n turns becomes one summary message: its texts in order, each cut, joined by lines."""
    rows = with_turns(messages, session, seq)
    old = F.col("turn_no") <= F.max("turn_no").over(Window.partitionBy(session)) - n
    parts = rows.withColumn("__old", old).filter("__old").select(session, F.struct(F.col(seq).alias("s"), F.left(F.col(text), F.lit(most)).alias("t")).alias("x"))
    return parts.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("summary"))


#: What a message costs beside its text, and the factor of the cautious count.
ROLES = ("system", "user", "assistant", "tool")
SAFETY = 1.2


def message_tokens(messages: DataFrame, session: str = "conv_id", text: str = "text", calls: str | None = None) -> DataFrame:
    """(session, tokens, cautious): the estimate of each session's texts, and tool calls where there are some."""
    parts = [F.col(text)] + ([F.col(calls)] if calls else [])
    tokens = F.sum(token_estimate(message_text(*parts))).alias("tokens")
    return messages.groupBy(session).agg(tokens).withColumn("cautious", F.floor(F.col("tokens") * SAFETY))


def history_messages(rows: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Rows as messages: a null text is empty; an unknown role is an error."""
    known = F.when(F.col(role).isin(*ROLES), F.col(role)).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))))
    return rows.withColumn(role, known).withColumn(text, F.coalesce(text, F.lit("")))


def composed(history: DataFrame, system: str, asked: DataFrame, session: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """C11: (session, pos, role, text): the system prompt, the history in order, and the user's message of each asked session."""
    head = asked.select(session, F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("system").alias("role"), F.lit(system).alias("text"))
    said = history.join(asked.select(session), session, "left_semi").select(session, F.lit(1).alias("part"), F.col(seq).cast("long").alias("at"), F.col(role).alias("role"), F.col(text).alias("text"))
    last = asked.select(session, F.lit(2).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("user").alias("role"), F.col(text).alias("text"))
    pos = F.row_number().over(Window.partitionBy(session).orderBy("part", "at")) - 1
    return head.unionByName(said).unionByName(last).select(session, pos.alias("pos"), "role", "text")


def folder_documents(folders: DataFrame, files: DataFrame, folder_id, below: bool = True) -> DataFrame:
    """(document_id) of the files in a folder, and in the folders below it, once each; files without a document are passed over."""
    root = folders.filter(F.col("folder_id") == folder_id).select(F.col("full_path").alias("__root"))
    inside = (F.col("folder_id") == folder_id) | (F.lit(below) & F.startswith("full_path", F.concat("__root", F.lit("/"))))
    chosen = folders.crossJoin(F.broadcast(root)).filter(inside).select("folder_id")  # one row
    return files.join(chosen, "folder_id", "left_semi").filter("document_id IS NOT NULL").select("document_id").distinct()


def file_documents(files: DataFrame, file_id, kb) -> DataFrame:
    """C17: the one document of a file, if the file is in the knowledge base."""
    mine = files.filter((F.col("file_id") == file_id) & (F.col("knowledge_base_id") == kb) & F.col("document_id").isNotNull())
    return mine.select("document_id").distinct().orderBy("document_id").limit(1)


def mentions_resolved(mentions: DataFrame, known: DataFrame, session: str = "session_id", at: str = "pos") -> DataFrame:
    """(session, kind, id, name, pos): mentions once each, as first made; what isn't known is passed over."""
    first = mentions.groupBy(session, "kind", "id").agg(F.min(at).alias("__at"))
    met = first.join(known.select("kind", "id", "name"), ["kind", "id"])
    pos = F.row_number().over(Window.partitionBy(session).orderBy("__at", "kind", "id")) - 1
    return met.select(session, "kind", "id", "name", pos.alias("pos"))

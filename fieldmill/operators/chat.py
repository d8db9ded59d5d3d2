"""Chat sessions, context blocks and request texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import as_col
from .details import lowest_row, wanted
from .ranking import top_n


def last_n(df: DataFrame, key: str, order: Sequence[str], n: int = 6) -> DataFrame:
    """The newest ``n`` rows per key with ``position`` 1..n, oldest first.

    Only ``n`` rows per key and task are shuffled, however long a session is.
    """
    newest = top_n(df, [key], [F.desc(c) for c in order], n, "_back")
    return top_n(newest.drop("_back"), [key], [F.asc(c) for c in order], rank_col="position")


def sessions_to_create(messages: DataFrame, sessions: DataFrame, *, key: str = "session_id") -> DataFrame:
    """Keys of messages that no session row holds yet."""
    return messages.select(key).distinct().join(sessions.select(key), key, "left_anti")


def append_messages(log: DataFrame, messages: DataFrame, sessions: DataFrame, *,
                    key: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """(log, sessions) after the append: every message has a parent session."""
    # a full join adds the missing keys; a union of two sides that are both partitioned by the key is not safe to
    # join on afterwards (see the README)
    with_created = sessions.join(messages.select(key).distinct(), key, "full")
    return log.unionByName(messages, allowMissingColumns=True), with_created.select(*sessions.columns)


def speaker_line(role: Column | str, content: Column | str) -> Column:
    role = as_col(role)
    name = F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.substr(role, F.lit(2))))
    return F.concat(name, F.lit(": "), as_col(content), F.lit("\n"))


def transcript(df: DataFrame, key: str = "session_id", order: Sequence[str] = ("created_at", "id"), n: int = 6, *,
               role: str = "role", content: str = "content") -> DataFrame:
    """One text per session from its newest ``n`` messages in order; ``n`` bounds what a group collects."""
    lines = last_n(df, key, order, n).withColumn("_line", speaker_line(role, content))
    ordered = F.array_sort(F.collect_list(F.struct("position", "_line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_line"]), "").alias("transcript"))


def context_block(name: str = "scholarship_name", text: str = "text", steps: str = "application_process") -> Column:
    def shown(col, default="Not specified"):
        return F.coalesce(F.col(col), F.lit(default))

    return F.concat(
        F.lit("\n### Scholarship: "), shown(name, "Unknown Scholarship"),
        F.lit("\n- Host Country: "), shown("host_country"),
        F.lit("\n- Funding Category: "), shown("funding_category"),
        F.lit("\n- Amount: "), shown("funding_amount"),
        F.lit("\n- Deadline: "), shown("standardized_deadline"),
        F.lit("\n- Link: "), shown("application_link", "No link provided"),
        F.lit("\n\nDescription:\n"), shown(text, ""),
        F.lit("\n\nApplication Process:\n"), shown(steps, "No specific application steps provided."), F.lit("\n"))


def context_blocks(hits: DataFrame, items: DataFrame, *, key: str = "scholarship_name", query_id: str = "query_id",
                   id_col: str = "item_id", steps: str = "application_process") -> DataFrame:
    """(query, context): one formatted block per hit in rank order. Hits hold at most top_k rows per query."""
    heavy = lowest_row(wanted(items, hits, key), key, [steps], id_col)
    blocks = hits.drop(steps).join(heavy, key, "left").withColumn("_block", context_block(name=key, steps=steps))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "_block")))
    return blocks.groupBy(query_id).agg(
        F.array_join(F.transform(ordered, lambda x: x["_block"]), "\n---\n").alias("context"))


# Section headings and the column that fills each, in order.
CHAT_SECTIONS = (("STUDENT PROFILE", "profile_text"), ("CHAT HISTORY", "transcript"),
                 ("RETRIEVED SCHOLARSHIPS CONTEXT", "context"), ("REQUESTED ACTION (INTENT)", "intent"),
                 ("CURRENT MESSAGE", "query"))
LETTER_SECTIONS = (("STUDENT PROFILE", "profile_text"), ("SCHOLARSHIP DETAILS", "details"),
                   ("ADDITIONAL NOTES (Key points to include)", "notes"))
ANSWER_SECTIONS = (("Student Profile", "profile_text"), ("Student's Query", "query"),
                   ("Retrieved Scholarships Context", "context"))
DEFAULT_INTENT = "General Conversation"


def prompts(df: DataFrame, sections: Sequence[tuple[str, str]] = CHAT_SECTIONS, *, instructions: str | Column = "",
            out_col: str = "prompt") -> DataFrame:
    """One request text per row: the caller's instructions, then each heading with its column's text.

    A missing intent reads 'General Conversation'; other missing parts are empty.
    """
    lead = F.lit(instructions) if isinstance(instructions, str) else instructions
    parts = []
    for heading, col in sections:
        value = F.col(col) if col in df.columns else F.lit(None).cast("string")
        if col == "intent":
            value = F.coalesce(F.nullif(value, F.lit("")), F.lit(DEFAULT_INTENT))
        parts.append(F.concat(F.lit(f"{heading}:\n"), F.coalesce(value, F.lit(""))))
    text = F.concat_ws("\n\n", F.nullif(lead, F.lit("")), *parts)
    return df.withColumn(out_col, text)


def letter_instructions(tone: Column | str, kind: Column | str) -> Column:
    """Lead line of a letter request from its tone and document type columns."""
    return F.concat(F.lit("Write a "), as_col(kind), F.lit(" for a scholarship application. Tone: "), as_col(tone),
                    F.lit("."))



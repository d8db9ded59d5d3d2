"""Chat formatting with Spark expressions only: turns in order, neighbours of one role merged, one text per conversation.

Template, for every run of turns of one role::

    <|im_start|>ROLE
    TEXT<|im_sep|>TEXT<|im_end|>

with a line feed after ``<|im_end|>``. Inside a text every ``<|`` gets a backslash between its two characters, and one
more where backslashes stand there already, so no control string can come from a text and the texts can be read back
exactly. In a role, backslashes and line feeds are escaped likewise. The loss mask is a list of spans (start, length
in code points) of the formatted text: the texts of the assistant, without markers.

A conversation is one row of the result, so its turns meet in one task: the output is the bound.

Cases: null text or role: empty. A null turn comes first; turns of one number are ordered by their role and text as
they are in the table, and repeated rows are kept. Rows of a null conversation form one. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import running_sums
from .common import let

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")).otherwise(text)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def marked(turns: Column) -> Column:
    """Sorted turns ``(role, text, learnt, first, last)``, escaped, with marks where a run of one role begins and ends."""
    def one(turn: Column, i: Column) -> Column:
        first = (i == 0) | (turn["role"] != F.get(turns, i - 1)["role"])
        last = (i == F.size(turns) - 1) | (turn["role"] != F.get(turns, i + 1)["role"])
        return F.struct(escape_role(turn["role"]).alias("role"), escape(turn["text"]).alias("text"),
                        (turn["role"] == LEARNT).alias("learnt"), first.alias("first"), last.alias("last"))

    return F.transform(turns, one)


def merged(turns: Column) -> Column:
    """Runs ``(role, texts)`` of marked turns: each run is one slice between two marks."""
    def runs(starts: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            size = F.coalesce(F.get(starts, k + 1), F.size(turns)) - start
            return F.struct(F.get(turns, start)["role"].alias("role"), F.transform(F.slice(turns, start + 1, size), lambda t: t["text"]).alias("texts"))

        return F.transform(starts, run)

    return let(F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: F.get(turns, i)["first"]), runs)


def spans(turns: Column) -> Column:
    """(start, length) of every text of the assistant in the formatted text, from running sums over marked turns."""
    after = lambda t: F.when(t["last"], len(END) + 1).otherwise(0)
    before = lambda t: F.when(t["first"], F.char_length(t["role"]) + len(START) + 1).otherwise(len(SEP))
    ends = running_sums(F.transform(turns, lambda t: before(t) + F.char_length(t["text"]) + after(t)))

    def placed(upto: Column) -> Column:
        every = F.transform(turns, lambda t, i: F.struct(
            (F.get(upto, i) - after(t) - F.char_length(t["text"])).cast("long").alias("start"),
            F.char_length(t["text"]).cast("long").alias("length"), t["learnt"].alias("learnt")))
        learnt = F.filter(every, lambda s: s["learnt"])
        return F.transform(learnt, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

    return let(ends, placed)


def format_chats(conversations: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_spans)``, one row per conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = turns.withColumn("turns", marked(F.col("turns")))
    one = lambda run: F.concat(F.lit(START), run["role"], F.lit("\n"), F.array_join(run["texts"], SEP), F.lit(END + "\n"))
    return turns.select("conv_id", F.array_join(F.transform(merged(F.col("turns")), one), "").alias("formatted"), spans(F.col("turns")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted text, in order and unescaped."""
    def one(block: Column) -> Column:
        role = unescape_role(F.substring_index(block, "\n", 1))
        body = F.substring(block, F.instr(block, "\n") + 1, F.char_length(block))
        texts = F.split(F.substring_index(body, END, 1), escaped(SEP), -1)
        return F.transform(texts, lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    blocks = F.split(formatted, escaped(START), -1)
    return F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), one))


def escaped(marker: str) -> str:
    return marker.replace("|", "\\|")


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the mask, in order and unescaped. Four bytes per code point make every span one copy."""
    return let(F.encode(formatted, "UTF-32"), lambda wide: F.transform(loss_spans, lambda s: unescape(
        F.decode(F.substring(wide, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32"))))


def digests(formatted: DataFrame) -> DataFrame:
    """What a check needs, read back from the formatted text and its mask."""
    turns = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                             F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"),
                        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                        F.char_length("formatted").cast("long").alias("formatted_chars"))

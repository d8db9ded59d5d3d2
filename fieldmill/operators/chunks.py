"""Chunking: markdown sections, size-bounded splits, pruning and the configuration sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K
from ..functions.text import as_col, let, running_sums, strip

SEPARATORS = ("\n\n", "\n", ".", " ")


def visible_lines(text: Column | str) -> Column:
    """Each line stripped and freed of non-printing characters; blank runs become one markdown line break."""
    col = F.regexp_replace(as_col(text), r"[\p{C}\p{Z}&&[^\n ]]+", "")
    col = F.regexp_replace(col, r"(?m)^ +| +$", "")
    return F.regexp_replace(strip(col), r"\n{2,}", "  \n")


def mask_fences(text: Column) -> Column:
    """Hide '#' at line starts inside code fences: the parts between fence lines alternate outside and in."""
    def hide(parts):
        return F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"(?m)^#", "\x01")).otherwise(p))

    def masked(fence):
        return lambda t: F.when(F.contains(t, F.lit(fence)), F.array_join(hide(F.split(t, fence)), fence)).otherwise(t)

    return let(let(text, masked("```")), masked("~~~"))


def header_title(part: Column, mark: str) -> Column:
    """Header text of a part that begins with ``mark``; null for a part before the first header."""
    first = F.substring_index(part, "\n", 1)
    return F.when(F.rlike(first, F.lit(rf"^{mark}(?: |$)")), F.btrim(F.substr(first, F.lit(len(mark) + 1))))


def split_sections(df: DataFrame, text: str, *, id_col: str = "doc_id") -> DataFrame:
    """Rows (…, section_no, document_title, section_title, text), split at ``#`` and ``##`` lines.

    Headers stay in the text; a ``#`` line resets the section title; a title directly followed by its first
    ``##`` line joins that section; neighbours with equal titles are one section. Everything happens inside
    the row (split at ``#``, then at ``##``), so a document is never shuffled or collected.
    """
    blocks = F.split(mask_fences(visible_lines(text)), r"(?m)(?=^# )|(?=^#$)")

    def block_parts(block):
        title = header_title(block, "#")
        return F.transform(F.split(block, r"(?m)(?=^## )|(?=^##$)"), lambda part: F.struct(
            title.alias("document_title"), header_title(part, "##").alias("section_title"),
            # the line break before the next header belongs to neither section
            F.replace(F.regexp_replace(part, r"[ \n]+$", ""), F.lit("\x01"), F.lit("#")).alias("text")))

    parts = F.filter(F.flatten(F.transform(blocks, block_parts)), lambda s: s["text"] != "")

    def bare(prev, cur):
        """A lone header before a deeper part joins it."""
        last_line = F.substring_index(prev["text"], "\n", -1)
        deeper = cur["section_title"].isNotNull() & prev["section_title"].isNull()
        deeper = deeper | (cur["document_title"].isNotNull() & prev["document_title"].isNull()
                           & prev["section_title"].isNull())
        return F.startswith(last_line, F.lit("#")) & deeper

    def same(prev, cur):
        return prev["document_title"].eqNullSafe(cur["document_title"]) & prev["section_title"].eqNullSafe(
            cur["section_title"])

    def merged(parts):
        """Joins need a look at the previous part, so only documents that have one pay for the fold."""
        def step(acc, cur):
            prev = F.try_element_at(acc, F.lit(-1))
            together = F.struct(cur["document_title"].alias("document_title"), cur["section_title"].alias(
                "section_title"), F.concat(prev["text"], F.lit("  \n"), cur["text"]).alias("text"))
            head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            return F.when((F.size(acc) > 0) & (same(prev, cur) | bare(prev, cur)),
                          F.concat(head, F.array(together))).otherwise(F.concat(acc, F.array(cur)))

        empty = F.slice(parts, F.lit(1), F.lit(0))
        return F.aggregate(parts, empty, step)

    pairs = lambda ps: F.exists(F.sequence(F.lit(1), F.greatest(F.size(ps) - 1, F.lit(1))), lambda i: F.coalesce(
        same(F.try_element_at(ps, i), F.try_element_at(ps, i + 1))
        | bare(F.try_element_at(ps, i), F.try_element_at(ps, i + 1)), F.lit(False)) & (F.size(ps) > 1))
    sections = let(parts, lambda ps: F.when(pairs(ps), merged(ps)).otherwise(ps))
    keep = [c for c in df.columns if c != text]
    # outer: a plain explode makes the optimizer test the array's size first, which computes it twice
    rows = df.select(*keep, F.posexplode_outer(sections).alias("section_no", "_s")).filter("_s is not null")
    return rows.select(*keep, "section_no", "_s.*")


LEAF = "array<struct<t:string,node:string,small:boolean>>"


def split_leaves(leaves: Column, mark: str, level: int, size: Column) -> Column:
    """Leaves that are still too long and hold the mark, cut before each mark. Leaves cut from one piece share a node."""
    def cut(leaf, i):
        parts = F.transform(F.split(leaf["t"], mark.replace(".", r"\.").replace("\n", r"\n"), -1), lambda x, j: F.when(j > 0, F.concat(F.lit(mark), x)).otherwise(x))
        node = F.concat(F.lit(f"{level}:"), i.cast("string"))
        pieces = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(
            x.alias("t"), node.alias("node"), (F.length(x) < size).alias("small")))
        return F.when(leaf["small"] | ~F.contains(leaf["t"], F.lit(mark)), F.array(leaf)).otherwise(pieces)

    return F.flatten(F.transform(leaves, cut))


def merged_spans(leaves: Column, ends: Column, size: Column, overlap: Column) -> Column:
    """(start, end) of the chunks, as character places, from leaves and the running sums of their lengths.

    A fold over the leaves of a node that follow each other: one that does not fit closes a chunk, and the next one
    starts at the first leaf within ``overlap`` that leaves room for it. A leaf without any mark is cut by strides.
    """
    def span(start, end):
        return F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"))

    def step(state, i):
        leaf, end = F.get(leaves, i), F.get(ends, i)
        off = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        n = end - off
        start, out = state["start"], state["out"]
        flushed = F.when(start < off, F.array_append(out, span(start, off))).otherwise(out)

        def stride(closed):
            last = F.ceil(F.greatest(n - size, F.lit(0)) / (size - overlap)).cast("int")
            cut = F.transform(F.sequence(F.lit(0), last), lambda k: span(off + k * (size - overlap), F.least(off + k * (size - overlap) + size, end)))
            return F.struct(end.alias("start"), leaf["node"].alias("node"), F.concat(closed, cut).alias("out"))

        # the start may be no earlier than this, and is where a leaf begins
        least = F.greatest(start, off - F.least(overlap, size - n))
        first = F.greatest(i - overlap - 1, F.lit(0))
        near = F.slice(ends, first + 1, i - first)
        restart = F.coalesce(F.get(F.filter(near, lambda x: x >= least), F.lit(0)), off)
        # where no leaf boundary lies before the look-back, the start of the text is one
        restart = F.when((first == 0) & (least <= 0), F.lit(0)).otherwise(restart)

        def state_of(start, out):
            return F.struct(start.alias("start"), leaf["node"].alias("node"), out.alias("out"))

        return (F.when(~leaf["small"], stride(flushed))
                .when(leaf["node"] != state["node"], state_of(off, flushed))
                .when((start < off) & (end - start > size), state_of(restart, F.array_append(out, span(start, off))))
                .otherwise(state_of(start, out)))

    first = F.struct(F.lit(0).alias("start"), F.lit("").alias("node"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    done = F.aggregate(F.sequence(F.lit(0), F.size(leaves) - 1), first, step)
    total = F.get(ends, F.size(ends) - 1)
    return let(done, lambda d: F.when(d["start"] < total, F.array_append(d["out"], span(d["start"], total))).otherwise(d["out"]))


def recursive_pieces(df: DataFrame, text: str, size: Column, overlap: Column, into: str) -> DataFrame:
    """Adds the chunks of a text as an array. A text within ``size`` is its own chunk.

    A longer one is split at the coarsest mark that occurs, kept at the start of its piece, and finer where a piece is
    still too long; short neighbours are merged greedily. The marks only find places: chunks are cut from the text.
    Every step is a projection inside the row.
    """
    leaves, ends = "_leaves", "_ends"
    long = F.length(text) > size
    whole_text = F.struct(F.col(text).alias("t"), F.lit("").alias("node"), F.lit(False).alias("small"))
    df = df.withColumn(leaves, F.when(long, F.array(whole_text)).otherwise(F.array().cast(LEAF)))
    for level, mark in enumerate(SEPARATORS):
        df = df.withColumn(leaves, split_leaves(F.col(leaves), mark, level, size))
    df = df.withColumn(ends, F.when(F.size(leaves) > 0, running_sums(F.transform(leaves, lambda leaf: F.length(leaf["t"])))))
    # the texts of the leaves are not needed any more
    df = df.withColumn(leaves, F.transform(leaves, lambda leaf: F.struct(leaf["node"].alias("node"), leaf["small"].alias("small"))))
    df = df.withColumn(into, F.when(F.size(leaves) > 0, merged_spans(F.col(leaves), F.col(ends), size, overlap)))
    cut = F.transform(into, lambda x: strip(F.substr(F.col(text), x["s"] + 1, x["e"] - x["s"])))
    chunks = F.coalesce(cut, F.array(strip(text)))
    return df.withColumn(into, F.filter(chunks, lambda t: t != "")).drop(leaves, ends)


def stride_pieces(text: Column, size: Column, overlap: Column) -> Column:
    """Native fixed-stride chunks of the whole text: one every ``size - overlap`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), size - overlap)
    return F.filter(F.transform(starts, lambda i: F.substring(text, i + 1, size)), lambda t: t != "")


def _explode_pieces(df: DataFrame, pieces: Column, text_col: str) -> DataFrame:
    keep = [c for c in df.columns if c != text_col]
    rows = df.select(*keep, F.posexplode_outer(pieces).alias("chunk_no", text_col))
    return rows.filter(F.col(text_col).isNotNull())


def split_recursive(df: DataFrame, size: int = 500, overlap: int = 50, *, text_col: str = "text") -> DataFrame:
    """Adds ``chunk_no`` and replaces the text by separator-aware chunks of at most ``size`` characters."""
    cut = recursive_pieces(df, text_col, F.lit(size), F.lit(overlap), "_pieces")
    return _explode_pieces(cut, F.col("_pieces"), text_col).drop("_pieces")


def split_stride(df: DataFrame, size: int = 500, overlap: int = 50, *, text_col: str = "text") -> DataFrame:
    """Adds ``chunk_no`` and replaces the text by fixed-stride chunks."""
    return _explode_pieces(df, stride_pieces(F.col(text_col), F.lit(size), F.lit(overlap)), text_col)


def prune_short(df: DataFrame, col: str = "text", n: int = 30) -> DataFrame:
    return df.filter(F.length(strip(col)) >= n)


def slim_meta(df: DataFrame, drop: Sequence[str] = ("application_process",), *, meta_col: str = "rag_metadata",
              name_col: str = "scholarship_name", sections: Sequence[str] = ()) -> DataFrame:
    """Metadata without heavy fields, plus the section fields, which win on a clash.

    A missing struct keeps only the name, 'Unknown' where that is missing too.
    """
    present = set(df.schema[meta_col].dataType.names)
    gone = [d for d in drop if d in present]
    slim = F.col(meta_col).dropFields(*gone) if gone else F.col(meta_col)
    only_name = F.struct(*[
        (F.coalesce(name_col, F.lit("Unknown")) if n == name_col else F.lit(None).cast("string")).alias(n)
        for n in df.schema[meta_col].dataType.names if n not in gone])
    meta = F.coalesce(slim, only_name)
    for field in sections:
        meta = meta.withField(field, F.col(field))
    return df.withColumn(meta_col, meta)


def chunk_documents(df: DataFrame, *, text_col: str = "rag_document", id_col: str = "doc_id", size: int = 800,
                    overlap: int = 100, min_length: int = 30) -> DataFrame:
    """Documents to chunks: sections, recursive split, pruning. Key: (id, section_no, chunk_no)."""
    sections = split_sections(df, text_col, id_col=id_col)
    return prune_short(split_recursive(sections, size, overlap), "text", min_length)


def sweep_chunk_configs(df: DataFrame, configs: Sequence[tuple[str, int, int]] = K.CHUNK_CONFIGS, *,
                        text_col: str = "text", id_col: str = "doc_id", recursive: bool = True, by_sections: bool = True,
                        min_length: int = 30) -> DataFrame:
    """Chunk count and mean length per configuration, in one scan: the configurations are a literal array.

    The sections of a text are split first, once for all configurations; ``by_sections=False`` cuts the raw text.
    """
    rows = F.array(*[F.struct(F.lit(name).alias("configuration"), F.lit(size).alias("chunk_size"),
                              F.lit(overlap).alias("overlap")) for name, size, overlap in configs])
    if by_sections:
        df = split_sections(df, text_col, id_col=id_col).withColumnRenamed("text", text_col)
    every = df.select(text_col, F.inline(rows))
    size, overlap = F.col("chunk_size"), F.col("overlap")
    if recursive:
        every, pieces = recursive_pieces(every, text_col, size, overlap, "_pieces"), F.col("_pieces")
    else:
        pieces = stride_pieces(F.col(text_col), size, overlap)
    chunks = prune_short(_explode_pieces(every, pieces, text_col), text_col, min_length)
    return chunks.groupBy("configuration", "chunk_size", "overlap").agg(
        F.count("*").alias("total_chunks"), F.round(F.avg(F.length(text_col)), 2).alias("avg_chunk_length"))

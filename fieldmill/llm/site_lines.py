"""Boilerplate lines by site-relative frequency, with Spark expressions only.

Documents are grouped by host. A line is boilerplate where the share of the host's pages that contain it exceeds
a ratio, and it occurs on a least number of its pages; such lines are dropped from all documents of the host. A page is
a distinct list of lines: copies count as one, so that no text is taken for boilerplate because it was copied. Only
distinct lines of a page count, and lines travel as hashes that are counted before they are shuffled. A host can
have at most (mean lines per page) / (ratio) boilerplate lines, however large it is, so they fit one array.

Cases: null text: empty, no lines. Lines without a word are never counted nor dropped. A line is compared without
the white space around it. Hosts of one or two pages show no pattern and keep their lines. A null host is a host of
its own. Repeated rows are one page. A document may lose all its lines: its text is then empty. Empty table: no rows. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import OWN, let, stored, whole

# What a template puts on pages of one section or one period stands on a few per cent of a host's pages, prose does not.
MAX_RATIO = 0.05
# Two pages with a line in common may be a page and its edited copy; a third makes it a pattern of the host.
LEAST_PAGES = 3
BLANKS = " \t\r\x0b\x0c"


def lines_of(text: str | Column) -> Column:
    return F.split(whole(text), "\n", -1)


def line_key(line: Column) -> Column:
    """Hash of a line as it is compared; null for a line without a word."""
    return let(F.btrim(line, F.lit(BLANKS)), lambda x: F.when(x != "", F.xxhash64(x)))


def boilerplate(docs: DataFrame, host_col: str = "source", max_ratio: float = MAX_RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """``(host, lines)``: the hashes of each host's boilerplate lines, from the counts over all documents."""
    host = OWN + "host"
    keyed = docs.select(F.col(host_col).alias(host), F.array_compact(F.transform(lines_of("text"), line_key)).alias("keys"))
    # copies become one page before the shuffle, in each task: two hashes of the list of lines tell pages apart
    pages = keyed.groupBy(host, F.xxhash64("keys").alias("p"), F.xxhash64(F.lit(1), F.size("keys"), F.reverse("keys")).alias("q")).agg(F.first("keys").alias("keys"))
    read = pages.select(host, F.array_distinct("keys").alias("keys"))
    # a page counts once for its host and once for each of its lines: the host's total is the count of the null line
    counted = (read.select(host, F.explode(F.concat(F.array(F.lit(None).cast("long")), "keys")).alias("line"))
               .groupBy(host, "line").agg(F.count("*").alias("n")))
    frequent = counted.filter(F.col("line").isNull() | (F.col("n") >= least))
    totals = frequent.filter(F.col("line").isNull()).select(host, F.col("n").alias("pages"))
    found = frequent.filter(F.col("line").isNotNull()).alias("f").join(totals.alias("t"), F.expr(f"f.{host} <=> t.{host}"))
    return (found.filter(F.col("n") > max_ratio * F.col("pages")).groupBy(F.col(f"f.{host}").alias(host))
            .agg(F.collect_list("line").alias("lines")))


def cleaned(docs: DataFrame, host_col: str = "source", max_ratio: float = MAX_RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and the counts ``__llm_lines`` and ``__llm_dropped``.

    The boilerplate table is written first, so Spark knows its size: small, it is broadcast; large, a host that holds
    many documents is a skewed side of the join, which adaptive execution splits.
    """
    host, lines, kept = OWN + "host", OWN + "all", OWN + "kept"
    known = stored(boilerplate(docs, host_col, max_ratio, least), "boilerplate")
    name = lambda col: F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))
    known = known.select(name(host).alias(host), F.col("lines").alias(OWN + "drop"))
    met = docs.withColumn(host, name(host_col)).join(known, host, "left")
    drop = F.col(OWN + "drop")
    keep = F.filter(lines_of("text"), lambda line: ~F.coalesce(F.array_contains(drop, line_key(line)), F.lit(False)))
    n = F.size(lines_of("text"))
    cut = met.withColumn(kept, F.when(drop.isNull(), F.lit(None)).otherwise(keep))
    text = F.when(F.col(kept).isNull(), whole("text")).otherwise(F.array_join(kept, "\n"))
    out = cut.withColumn(lines, n).withColumn(OWN + "dropped", F.when(F.col(kept).isNull(), 0).otherwise(F.col(lines) - F.size(kept)))
    return out.withColumn("text", text).select(*docs.columns, F.col(lines).alias(OWN + "lines"), OWN + "dropped")


def drop_boilerplate_lines(docs: DataFrame) -> DataFrame:
    """The documents with their site's boilerplate lines gone; ``n_chars`` follows the text where there is one."""
    out = cleaned(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)

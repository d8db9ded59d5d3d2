"""Profiling and data-quality reports. Every report is one or few aggregations with a map-side combine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K, rules as R
from ..functions.text import count_marker, deep_links, strip, word_count
from .ranking import top_n


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the even neighbour, scale back: how the reports round (``round`` rounds half up)."""
    return F.rint(value * 10.0 ** digits) / 10.0 ** digits


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, null for an empty whole."""
    return round_half_even(part * 100.0 / F.nullif(whole, F.lit(0)), digits)


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def per_column(df: DataFrame, cols: Sequence[str], metrics: Mapping[str, Column | object]) -> DataFrame:
    """One row per column from a single pass: ``metrics`` maps a name to a function column -> aggregate."""
    stats = df.agg(*[F.struct(*[f(c).alias(m) for m, f in metrics.items()]).alias(c) for c in cols],
                   F.count("*").alias("_rows"))
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in cols])
    out = stats.select(F.explode(rows).alias("r"), "_rows")
    return out.select("r.column_name", *[F.col(f"r.s.{m}").alias(m) for m in metrics], "_rows")


def overview(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def band(pct: Column) -> Column:
    return (F.when(pct > 50, F.lit("Critical (Drop/Impute)"))
            .when(pct > 20, F.lit("Warning (Needs attention)")).otherwise(F.lit("Healthy")))


def completeness(df: DataFrame, cols: Sequence[str] | None = None, nulls: Sequence[str] = K.PROFILE_NULLS) -> DataFrame:
    """Missing values per column (null or an exact placeholder), percentage and band."""
    cols = list(cols or df.columns)

    def missing(c):
        if df.schema[c].dataType.typeName() == "string":
            return count_where(F.col(c).isNull() | F.col(c).isin(list(nulls)))
        return count_where(F.col(c).isNull())

    out = per_column(df, cols, {"n_missing": missing})
    exact = F.col("n_missing") * 100.0 / F.nullif("_rows", F.lit(0))
    return out.select("column_name", "n_missing", round_half_even(exact, 2).alias("pct_missing"), band(exact).alias("band"))


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows after the first of each key combination; nulls are equal. Copies of a hot key combine in the map."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, n) of several columns in one pass, nulls left out."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(rows)).filter("value is not null").groupBy("column_name", "value").agg(
        F.count("*").alias("n"))


def top_values(df: DataFrame, cols: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` most frequent values per column with share of all rows and the number of distinct values."""
    counts = value_counts(df, cols)
    distinct = counts.groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    total = df.agg(F.count("*")).scalar()
    top = top_n(counts, ["column_name"], [F.desc("n"), F.asc("value")], n)
    # one row per reported column: bounded by the argument list
    return top.join(F.broadcast(distinct), "column_name").select(
        "column_name", "rank", "value", "n", share(F.col("n"), total, 1).alias("pct"), "n_distinct")


def text_stats(df: DataFrame, cols: Sequence[str], placeholders: Sequence[str] = ("N/A", "None", ""),
               dead_below: int = 10, overflow_above: int = 300) -> DataFrame:
    """Words per text column over non-empty texts: min, max, mean, dead (short) texts, overflow flag."""
    counted = df.select(*[F.when(~F.col(c).isin(list(placeholders)), F.nullif(word_count(c), F.lit(0))).alias(c)
                          for c in cols])
    out = per_column(counted, cols, {
        "min_words": F.min, "max_words": F.max, "avg_words": lambda c: F.round(F.avg(c), 1),
        "n_dead": lambda c: count_where(F.col(c) < dead_below)})
    return out.withColumn("overflow", F.col("max_words") > overflow_above).drop("_rows")


def boilerplate(df: DataFrame, col: str, id_col: str, min_repeats: int = 5, n_chars: int = 300,
                placeholder: str = "N/A") -> DataFrame:
    """Texts that occur more than ``min_repeats`` times: (first_id, n, excerpt).

    Only digests are shuffled and counted; the text is read again for the few reported ids.
    """
    texts = df.filter(F.col(col).isNotNull() & (F.col(col) != placeholder))
    repeated = texts.groupBy(F.sha2(col, 256).alias("_h")).agg(
        F.count("*").alias("n"), F.min(id_col).alias("first_id")).filter(F.col("n") > min_repeats)
    return texts.select(F.col(id_col).alias("first_id"), F.substring(col, 1, n_chars).alias("excerpt")).join(
        repeated.select("first_id", "n"), "first_id")


def distinct_by(df: DataFrame, group: str, col: str, n: int = 5) -> DataFrame:
    """The first ``n`` distinct values per group in value order, and how many there are."""
    values = df.filter(F.col(col).isNotNull()).select(group, col).distinct()
    counts = values.groupBy(group).agg(F.count("*").alias("n_distinct"))
    first = top_n(values, [group], [F.asc(col)], n).groupBy(group).agg(
        F.array_sort(F.collect_list(col)).alias("values"))
    return first.join(counts, group)


def suspicious_length(df: DataFrame, col: str, n: int = 40, where: Column | None = None) -> DataFrame:
    """Rows whose value is longer than ``n`` characters (a misplaced field)."""
    rows = df if where is None else df.filter(where)
    return rows.filter(F.length(F.col(col).cast("string")) > n)


def suspicious_report(df: DataFrame, col: str, id_col: str, n: int = 40, where: Column | None = None,
                      samples: int = 3) -> DataFrame:
    """Sample rows by lowest id, each with the total count."""
    rows = suspicious_length(df, col, n, where)
    total = rows.agg(F.count("*")).scalar()
    return rows.select(id_col, col).orderBy(id_col).limit(samples).withColumn("n_suspicious", total)


def pollution(df: DataFrame, flags: Sequence[tuple[str, str]] = K.POLLUTION) -> DataFrame:
    """Count and percentage per (column, hard-coded value), zero counts included, in one pass."""
    flags = [(c, v) for c, v in flags if c in df.columns]
    stats = df.agg(F.count("*").alias("_rows"), *[
        count_where(F.col(c) == v).alias(f"f{i}") for i, (c, v) in enumerate(flags)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(v).alias("bad_value"), F.col(f"f{i}").alias("n"))
                     for i, (c, v) in enumerate(flags)])
    return stats.select(F.inline(rows), "_rows").select(
        "column_name", "bad_value", "n", share(F.col("n"), F.col("_rows")).alias("pct"))


def fallback_ratio(df: DataFrame, col: str, value: str, where: Column) -> DataFrame:
    """Fallback values of the whole table as a percentage of one source's rows; null without such rows."""
    out = df.agg(count_where(F.col(col) == value).alias("n_fallback"), count_where(where).alias("n_source"))
    return out.withColumn("pct", share(F.col("n_fallback"), F.col("n_source")))


def failure_report(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Rows per derived column that still hold the default value."""
    out = per_column(df, list(defaults), {"n_failed": lambda c: count_where(F.col(c) == defaults[c])})
    return out.select("column_name", "n_failed", share(F.col("n_failed"), F.col("_rows"), 1).alias("pct"),
                      F.col("_rows").alias("n_rows"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Count and percentage per value; the total is a scalar subquery, not a window over one partition."""
    rows = df.filter(F.col(col).isNotNull())
    total = rows.agg(F.count("*")).scalar()
    return rows.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).withColumn(
        "pct", share(F.col("n"), total))


def stratified_head(df: DataFrame, group: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per group in a seeded pseudo-random order that does not depend on partitioning."""
    shuffled = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))
    return top_n(df.withColumn("_order", shuffled), [group], [F.asc("_order"), F.asc(id_col)], n).drop("_order")


def mapping_report(df: DataFrame, before: str, after: str) -> DataFrame:
    """How often each (raw, standardised) pair occurs; pairs with a null are left out."""
    rows = df.filter(F.col(before).isNotNull() & F.col(after).isNotNull())
    return rows.groupBy(before, after).agg(F.count("*").alias("frequency_count")).orderBy(
        F.desc("frequency_count"), before, after)


def top_non_default(df: DataFrame, col: str, default: str | None, n: int = 10) -> DataFrame:
    rows = df.filter(F.col(col).isNotNull())
    if default is not None:
        rows = rows.filter(F.col(col) != default)
    return rows.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), F.asc("value")).limit(n)


def deadline_report(df: DataFrame, ref: str | datetime, date_col: str = "parsed_date") -> DataFrame:
    """Dated, undated, expired and active counts; the last two as a share of the dated rows."""
    expired = R.is_expired(date_col, ref)
    out = df.agg(F.count("*").alias("n_total"), count_where(F.col(date_col).isNull()).alias("n_undated"),
                 F.count(date_col).alias("n_dated"), count_where(expired).alias("n_expired"),
                 count_where(F.col(date_col).isNotNull() & ~expired).alias("n_active"))
    return out.select("*", share(F.col("n_undated"), F.col("n_total"), 1).alias("pct_undated"),
                      share(F.col("n_expired"), F.col("n_dated"), 1).alias("pct_expired"),
                      share(F.col("n_active"), F.col("n_dated"), 1).alias("pct_active"))


def status_counts(df: DataFrame, col: str = "scholarship_status") -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def text_diagnostics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing, markup, whitespace noise and mean words per text column."""
    return per_column(df, cols, {
        "n_missing": lambda c: count_where(F.col(c).isNull() | (strip(c) == "")),
        "n_html": lambda c: count_where(F.rlike(c, F.lit(K.HTML_TAG))),
        "n_noise": lambda c: count_where(F.rlike(c, F.lit(K.WHITESPACE_NOISE))),
        # a missing text prints as one word in the reported mean
        "avg_words": lambda c: F.round(F.avg(F.coalesce(word_count(c), F.lit(1))), 1)}).drop("_rows")


def noise_diagnostics(df: DataFrame, cols: Sequence[str], dead: Sequence[str] = K.DEAD_TEXT) -> DataFrame:
    """Rows per text column with each kind of structural noise, and dead (useless or very short) texts."""
    def rx(pattern):
        return lambda c: count_where(F.rlike(c, F.lit(pattern)))

    def is_dead(c):
        text = strip(F.coalesce(c, F.lit("")))
        return count_where(F.lower(text).isin(list(dead)) | F.length(text).between(1, 14))

    return per_column(df, cols, {
        "n_broken_bullets": rx(K.BROKEN_BULLET), "n_separators": rx(K.SEPARATOR), "n_newlines": rx(K.NEWLINES),
        "n_nbsp": lambda c: count_where(F.contains(c, F.lit(K.NBSP))), "n_html": rx(K.HTML_TAG),
        "n_dead": is_dead}).drop("_rows")


def redundancy(df: DataFrame, a: str, b: str, min_len: int = 20) -> DataFrame:
    """Rows whose ``a`` (longer than ``min_len``) occurs inside ``b``."""
    inner, outer = strip(F.coalesce(a, F.lit(""))), strip(F.coalesce(b, F.lit("")))
    out = df.agg(count_where((F.length(inner) > min_len) & F.contains(outer, inner)).alias("n_redundant"),
                 F.count("*").alias("n_rows"))
    return out.withColumn("pct", share(F.col("n_redundant"), F.col("n_rows"), 1))


PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95)


def describe_counts(df: DataFrame, value: Column, percentiles: Sequence[float] = PERCENTILES,
                    flags: Mapping[str, Column] | None = None) -> DataFrame:
    """count, mean, std, min, exact percentiles and max of an integer measure, and the rows of each flag.

    One scan: values are counted per distinct value, and the rest works on (value, frequency) rows, as many as
    there are different word counts or lengths, not as many as there are texts. Sums are exact decimals.
    """
    flags = dict(flags or {})
    hist = df.select(value.cast("bigint").alias("v"), *[c.alias(n) for n, c in flags.items()]).filter(
        "v is not null").groupBy("v").agg(F.count("*").alias("f"), *[count_where(F.col(n)).alias(n) for n in flags])
    v, f = F.col("v").cast("decimal(19,0)"), F.col("f").cast("decimal(19,0)")
    out = hist.agg(
        F.sum("f").alias("n"), F.sum(v * f).cast("decimal(38,0)").alias("s"),
        F.sum((v * v * f).cast("decimal(38,0)")).alias("ss"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.percentile("v", F.array(*[F.lit(p) for p in percentiles]), F.col("f")).alias("p"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in flags])
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    spread = (F.col("ss") * F.col("n") - F.col("s") * F.col("s")).cast("double")
    return out.select(
        F.coalesce("n", F.lit(0)).alias("n"), F.round(F.try_divide(s, n), 4).alias("mean"),
        F.round(F.sqrt(F.try_divide(spread, n * (n - 1))), 4).alias("std"), "min",
        *[F.round(F.col("p")[i], 4).alias(f"p{round(p * 100)}") for i, p in enumerate(percentiles)], "max", *flags)


def size_stats(df: DataFrame, col: str, huge_above: int = 800) -> DataFrame:
    """Word-count statistics of documents, with empty and oversized ones."""
    counted = df.select(word_count(F.coalesce(col, F.lit(""))).alias("n"))
    return describe_counts(counted, F.col("n"), flags={"n_empty": F.col("n") == 0, "n_huge": F.col("n") > huge_above})


def metadata_valid(fields: Sequence[str], meta: str = "rag_metadata") -> Column:
    """Every field of the struct is a non-null string other than 'nan'."""
    return F.forall(F.array(*[F.col(f"{meta}.{f}").cast("string") for f in fields]),
                    lambda x: x.isNotNull() & (F.lower(x) != "nan"))


def metadata_report(df: DataFrame, meta: str = "rag_metadata") -> DataFrame:
    ok = metadata_valid(df.schema[meta].dataType.names, meta)
    return df.agg(F.count("*").alias("n_rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_invalid"))


def marker_counts(df: DataFrame, col: str, markers: Mapping[str, str] | None = None) -> DataFrame:
    """Occurrences of each marker per row."""
    markers = markers or {"n_links": "[LINK]", "n_emails": "[EMAIL]"}
    return df.withColumns({name: count_marker(col, m) for name, m in markers.items()})


def chunk_diagnostics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Length statistics of chunks, those without any header, and nested metadata columns."""
    orphan = F.col("document_title").isNull() & F.col("section_title").isNull()
    nested = sum(1 for f in chunks.schema.fields if f.dataType.typeName() in ("struct", "map")
                 and any(g.dataType.typeName() in ("struct", "map") for g in getattr(f.dataType, "fields", [])))
    return describe_counts(chunks, F.length(text), flags={"n_orphans": orphan}).withColumn(
        "n_nested_columns", F.lit(nested))


def link_report(df: DataFrame, link: str = "application_link", texts: Sequence[str] = ("eligibility",
                "application_process"), deadline: str = "deadline") -> DataFrame:
    """Checked rows, rows without a precise deadline, and all distinct-per-row links."""
    return df.agg(F.count("*").alias("n_rows"), count_where(F.col(deadline) == K.NOT_SPECIFIED).alias(
        "n_missing_deadline"), F.coalesce(F.sum(F.size(deep_links(link, texts))), F.lit(0)).alias("n_links"))



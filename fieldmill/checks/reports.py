"""Profiling and data-quality reports (H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import fixed as K, rules as R
from ..functions.text import clean_text, words as words_of
from ..operators import chunks as C, profile_store as S, quality as Q
from ..session import fresh_path
from .base import check
from .rules import SQL_DEADLINE, _deadlines
from .snippets import clean, q, strip, wc, words
from .texts import SQL_SECTIONS, _markdown

TEXT_COLS = ["description", "eligibility", "scholarship_details", "application_process"]


def union(cols, make):
    return " UNION ALL ".join(make(c) for c in cols)


@check("h1_overview", "SELECT count(*) AS n_rows, CAST(15 AS INT) AS n_columns FROM {listings} AS l")
def h1(t):
    return Q.overview(t.listings)


COMPLETE = ["scholarship_name", "deadline", "funding_type", "eligibility", "application_link", "description", "tags"]


def _complete(c):
    n = f"count(*) FILTER ({c} IS NULL OR {c} IN ('', 'N/A', 'Not Specified'))"
    return (f"SELECT '{c}' AS column_name, {n} AS n_missing, round_even({n} * 100.0 / count(*), 2) AS pct_missing, CASE WHEN {n} * 100.0 / count(*) > 50 THEN "
            f"'Critical (Drop/Impute)' WHEN {n} * 100.0 / count(*) > 20 THEN 'Warning (Needs attention)' ELSE 'Healthy' END AS band FROM {{listings}} AS l")


@check("h2_completeness", union(COMPLETE, _complete))
def h2(t):
    return Q.completeness(t.listings, COMPLETE)


@check("h3_duplicate_rows", "SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM {listings} AS l GROUP BY scholarship_name, application_link) AS g")
def h3(t):
    return Q.duplicate_rows(t.listings, ["scholarship_name", "application_link"])


@check("h3_duplicate_lineitems", "SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_shipdate) AS g")
def h3_lineitem(t):
    return Q.duplicate_rows(t.lineitem, ["l_partkey", "l_shipdate"])


TOP_COLS = ["country", "funding_type", "degree_level", "source_file"]


@check("h4_top_values", f"WITH v AS ({union(TOP_COLS, lambda c: f'SELECT {q(c)} AS column_name, {c} AS value FROM {{listings}} AS l WHERE {c} IS NOT NULL')})" + """,
  g AS (SELECT column_name, value, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank,
    count(*) OVER (PARTITION BY column_name) AS n_distinct FROM g)
SELECT column_name, rank, value, n, round_even(n * 100.0 / (SELECT count(*) FROM {listings} AS l), 1) AS pct, n_distinct FROM r WHERE rank <= 5""")
def h4(t):
    return Q.top_values(t.listings, TOP_COLS)


def _stats(c):
    n = f"CASE WHEN {c} NOT IN ('N/A', 'None', '') THEN nullif({wc(c)}, 0) END"
    return (f"SELECT '{c}' AS column_name, min({n}) AS min_words, max({n}) AS max_words, round(avg({n}), 1) AS avg_words, "
            f"count(*) FILTER ({n} < 10) AS n_dead, max({n}) > 300 AS overflow FROM {{listings}} AS l")


@check("h5_text_stats", union(TEXT_COLS, _stats))
def h5(t):
    return Q.text_stats(t.listings, TEXT_COLS)


@check("h6_boilerplate", """
SELECT min(doc_id) AS first_id, count(*) AS n, substr(text, 1, 300) AS excerpt FROM documents WHERE text <> 'N/A' GROUP BY text HAVING count(*) > 2""")
def h6(t):
    return Q.boilerplate(t.documents, "text", "doc_id", min_repeats=2)


@check("h7_distinct_by", """
SELECT source_file, array_to_string(list_sort(list(DISTINCT degree_level))[1:5], '|') AS values, count(DISTINCT degree_level) AS n_distinct FROM {listings} AS l GROUP BY 1""")
def h7(t):
    return Q.distinct_by(t.listings, "source_file", "degree_level").withColumn("values", F.array_join("values", "|"))


@check("h8_suspicious_length", """
SELECT item_id, deadline, (SELECT count(*) FROM {listings} AS m WHERE length(deadline) > 40 AND source_file NOT LIKE 'DAAD%') AS n_suspicious
FROM {listings} AS l WHERE length(deadline) > 40 AND source_file NOT LIKE 'DAAD%' ORDER BY item_id LIMIT 3""")
def h8(t):
    return Q.suspicious_report(t.listings, "deadline", "item_id", 40, ~F.startswith("source_file", F.lit("DAAD")))


@check("h9_pollution", union(K.POLLUTION, lambda f: (
    f"SELECT {q(f[0])} AS column_name, {q(f[1])} AS bad_value, count(*) FILTER ({f[0]} = {q(f[1])}) AS n, "
    f"round_even(count(*) FILTER ({f[0]} = {q(f[1])}) * 100.0 / count(*), 2) AS pct FROM {{listings}} AS l")))
def h9(t):
    return Q.pollution(t.listings)


@check("h10_fallback_ratio", """
SELECT count(*) FILTER (country = 'USA') AS n_fallback, count(*) FILTER (source_file NOT LIKE 'DAAD%') AS n_source,
  round_even(count(*) FILTER (country = 'USA') * 100.0 / nullif(count(*) FILTER (source_file NOT LIKE 'DAAD%'), 0), 2) AS pct FROM {listings} AS l""")
def h10(t):
    return Q.fallback_ratio(t.listings, "country", "USA", ~F.startswith("source_file", F.lit("DAAD")))


DEFAULTS = {"academic_level": "Unspecified", "eligible_nationality": "International / All", "standardized_deadline": "Not Specified"}


@check("h11_failure_report", union(DEFAULTS.items(), lambda d: (
    f"SELECT {q(d[0])} AS column_name, count(*) FILTER ({d[0]} = {q(d[1])}) AS n_failed, "
    f"round_even(count(*) FILTER ({d[0]} = {q(d[1])}) * 100.0 / count(*), 1) AS pct, count(*) AS n_rows FROM {{items}} AS i")))
def h11(t):
    return Q.failure_report(t.items, DEFAULTS)


@check("h12_distribution", """
SELECT scholarship_status AS value, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(scholarship_status) FROM {items} AS j), 2) AS pct
FROM {items} AS i WHERE scholarship_status IS NOT NULL GROUP BY 1""")
def h12(t):
    return Q.distribution(t.items, "scholarship_status")


@check("h12_distribution_lineitem", "SELECT l_suppkey AS value, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS pct FROM lineitem GROUP BY 1")
def h12_lineitem(t):
    return Q.distribution(t.lineitem, "l_suppkey")


@check("h13_stratified_head", """
SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS STRING) || '-42'), doc_id) AS rank FROM documents) AS x WHERE rank <= 20""")
def h13(t):
    return Q.stratified_head(t.documents.select("doc_id", "source"), "source", "doc_id", 20)


@check("h14_mapping_report", SQL_DEADLINE.replace("SELECT item_id, coalesce(CASE", "SELECT deadline, standardized_deadline, count(*) AS frequency_count FROM (SELECT item_id, coalesce(CASE")
       + ") AS sd JOIN {listings} AS l ON l.item_id = sd.item_id WHERE deadline IS NOT NULL GROUP BY 1, 2")
def h14(t):
    return Q.mapping_report(_deadlines(t), "deadline", "standardized_deadline")


@check("h15_top_non_default", """
SELECT eligible_nationality AS value, count(*) AS n FROM {items} AS i WHERE eligible_nationality <> 'International / All' GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def h15(t):
    return Q.top_non_default(t.items, "eligible_nationality", "International / All")


@check("h16_deadline_report", """
WITH d AS (SELECT CAST(try_strptime(standardized_deadline, '%Y-%m-%d') AS TIMESTAMP) AS d FROM {items} AS i),
  a AS (SELECT count(*) AS n_total, count(*) FILTER (d IS NULL) AS n_undated, count(d) AS n_dated, count(*) FILTER (d < TIMESTAMP '2025-06-15 12:00:00') AS n_expired,
    count(*) FILTER (d >= TIMESTAMP '2025-06-15 12:00:00') AS n_active FROM d)
SELECT *, round_even(n_undated * 100.0 / n_total, 1) AS pct_undated, round_even(n_expired * 100.0 / n_dated, 1) AS pct_expired, round_even(n_active * 100.0 / n_dated, 1) AS pct_active FROM a""")
def h16(t):
    dated = t.items.withColumn("parsed_date", F.try_to_timestamp("standardized_deadline", F.lit("yyyy-MM-dd")))
    return Q.deadline_report(dated, "2025-06-15 12:00:00")


@check("h17_status_counts", "SELECT scholarship_status, count(*) AS n FROM {items} AS i WHERE scholarship_status IS NOT NULL GROUP BY 1")
def h17(t):
    return Q.status_counts(t.items)


def _diag(c):
    return (f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL OR {strip(c)} = '') AS n_missing, count(*) FILTER (regexp_matches({c}, '<[^>]+>')) AS n_html, "
            f"count(*) FILTER (regexp_matches({c}, '\\s{{3,}}|\\n{{2,}}')) AS n_noise, round(avg(coalesce({wc(c)}, 1)), 1) AS avg_words FROM {{listings}} AS l")


@check("h18_text_diagnostics", union(["scholarship_name", *TEXT_COLS], _diag))
def h18(t):
    return Q.text_diagnostics(t.listings, ["scholarship_name", *TEXT_COLS])


def _noise(c):
    s = strip(f"coalesce({c}, '')")
    return (f"SELECT '{c}' AS column_name, count(*) FILTER (regexp_matches({c}, '[•-]\\s*\\n')) AS n_broken_bullets, "
            f"count(*) FILTER (regexp_matches({c}, '-{{3,}}|={{3,}}|\\*{{3,}}')) AS n_separators, count(*) FILTER (regexp_matches({c}, '\\n{{3,}}')) AS n_newlines, "
            f"count(*) FILTER (contains({c}, chr(160))) AS n_nbsp, count(*) FILTER (regexp_matches({c}, '<[^>]+>')) AS n_html, "
            f"count(*) FILTER (lower({s}) IN ('none', 'n/a', 'not specified', 'tba', '') OR length({s}) BETWEEN 1 AND 14) AS n_dead FROM {{listings}} AS l")


@check("h19_noise_diagnostics", union(TEXT_COLS, _noise))
def h19(t):
    return Q.noise_diagnostics(t.listings, TEXT_COLS)


SQL_A, SQL_B = strip("coalesce(description, '')"), strip("coalesce(scholarship_details, '')")


@check("h20_redundancy", f"""
SELECT n_redundant, n_rows, round_even(n_redundant * 100.0 / n_rows, 1) AS pct FROM (SELECT count(*) FILTER (length({SQL_A}) > 20 AND contains({SQL_B}, {SQL_A})) AS n_redundant, count(*) AS n_rows FROM {{listings}} AS l) AS x""")
def h20(t):
    return Q.redundancy(t.listings, "description", "scholarship_details")


DESCRIBE = ("count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, " + ", ".join(
    f"round(quantile_cont(v, {p}), 4) AS p{round(p * 100)}" for p in Q.PERCENTILES) + ", max(v) AS max")


@check("h21_size_stats", f"SELECT {DESCRIBE}, count(*) FILTER (v = 0) AS n_empty, count(*) FILTER (v > 800) AS n_huge FROM (SELECT {wc('text')} AS v FROM documents) AS d")
def h21(t):
    return Q.size_stats(t.documents, "text")


@check("h21_describe_lineitem", f"SELECT {DESCRIBE} FROM (SELECT CAST(l_quantity AS BIGINT) AS v FROM lineitem) AS d")
def h21_lineitem(t):
    return Q.describe_counts(t.lineitem, F.col("l_quantity"))


@check("h22_metadata_valid", "SELECT count(*) AS n_rows, count(*) FILTER (scholarship_status IS NULL OR funding_amount IS NULL OR funding_amount = 'nan') AS n_invalid FROM "
       "(SELECT scholarship_status, CASE WHEN item_id % 6 = 5 THEN 'NaN' ELSE funding_amount END AS fa, CASE WHEN item_id % 6 = 5 THEN 'nan' ELSE funding_amount END AS funding_amount FROM {items} AS i) AS x")
def h22(t):
    items = t.items.withColumn("funding_amount", F.when(F.col("item_id") % 6 == 5, F.lit("NaN")).otherwise(F.col("funding_amount")))
    return Q.metadata_report(items.withColumn("rag_metadata", F.struct("scholarship_status", "funding_amount")))


@check("h22_metadata_built", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_invalid FROM {items} AS i")
def h22_built(t):
    items = t.items
    return Q.metadata_report(items.withColumn("rag_metadata", R.metadata(items.columns)).select("rag_metadata"))


@check("h23_marker_counts", f"""
SELECT item_id, len(regexp_extract_all(c, '\\[LINK\\]')) AS n_links, len(regexp_extract_all(c, '\\[EMAIL\\]')) AS n_emails FROM (SELECT item_id, coalesce({clean('scholarship_details')}, '') AS c FROM {{listings}} AS l) AS x""")
def h23(t):
    cleaned = t.listings.select("item_id", clean_text("scholarship_details").alias("c"))
    return Q.marker_counts(cleaned, "c").drop("c")


@check("h24_chunk_diagnostics", f"""
SELECT {DESCRIBE}, count(*) FILTER (document_title IS NULL AND section_title IS NULL) AS n_orphans, CAST(0 AS INT) AS n_nested_columns
FROM (SELECT length(text) AS v, document_title, section_title FROM ({SQL_SECTIONS}) AS s) AS x""")
def h24(t):
    return Q.chunk_diagnostics(C.split_sections(_markdown(t), "md"))


@check("h25_link_report", """
SELECT count(*) AS n_rows, count(*) FILTER (deadline = 'Not Specified') AS n_missing_deadline, CAST(sum(len(list_distinct(list_filter(list_concat([application_link],
  regexp_extract_all(coalesce(eligibility, '') || coalesce(application_process, ''), '\\[(https?://[^\\s\\]]+)\\]', 1)), lambda x: x IS NOT NULL AND x <> '')))) AS BIGINT) AS n_links FROM {listings} AS l""")
def h25(t):
    return Q.link_report(t.listings)


def _within(column: str, measure: str) -> str:
    """Exact figures of an integer measure, and that the merged sketches are as near as they state."""
    return f"""SELECT '{column}' AS column_name, count(*) AS n_rows, count(*) - count({measure}) AS n_missing, round(avg({measure}), 6) AS mean,
  CAST(min({measure}) AS BIGINT) AS low, CAST(max({measure}) AS BIGINT) AS high, true AS quantiles_near, true AS distinct_near, true AS top_exact FROM """


@check("h12_merged_profiles", f"""
{_within('chars', 'length(text)')} documents UNION ALL {_within('words', f"len({words('text')})")} documents UNION ALL
SELECT 'lang', count(*), count(*) FILTER (WHERE lang IS NULL), NULL, NULL, NULL, true, true, true FROM documents""")
def h12_profiles(t):
    """Sketches per source are stored and merged; the exact figures of the table tell how near they are."""
    docs, path = t.documents, fresh_path(t.spark, "profiles")
    measures = {"chars": F.length("text"), "words": F.size(words_of("text"))}
    S.store_profiles(S.profile_parts(docs, F.col("source"), ["lang"], measures), path)
    changed = docs.filter("source = 'src1'")  # a part that is profiled again replaces its own rows
    S.store_profiles(S.profile_parts(changed, F.col("source"), ["lang"], measures), path)
    found = S.report(S.read_profiles(t.spark, path), percentiles=(0.25, 0.5, 0.95))
    values = docs.select(F.inline(F.array(*[F.struct(F.lit(name).alias("column_name"), m.cast("string").alias("v")) for name, m in (
        *measures.items(), ("lang", F.col("lang")))]))).filter("v IS NOT NULL")
    ranked = values.join(F.broadcast(found.select("column_name", "p25", "p50", "p95")), "column_name")
    shares = [(p, F.try_divide(F.count_if(F.col("v").cast("bigint") < F.col(c)), F.count("p50")), F.try_divide(
        F.count_if(F.col("v").cast("bigint") <= F.col(c)), F.count("p50"))) for p, c in ((0.25, "p25"), (0.5, "p50"), (0.95, "p95"))]
    number = F.col("column_name") != "lang"
    ranked = ranked.withColumn("v", F.when(number, F.col("v")))
    near = ranked.groupBy("column_name").agg(F.coalesce(reduce(lambda a, b: a & b, [
        (below <= p + S.RANK_ERROR) & (upto >= p - S.RANK_ERROR) for p, below, upto in shares]), F.lit(True)).alias("quantiles_near"))
    counts = values.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    true = counts.groupBy("column_name").agg(F.count("*").alias("d"), F.max("n").alias("most"))
    out = found.join(near, "column_name").join(true, "column_name")
    return out.select("column_name", "n_rows", "n_missing", F.round("mean", 6).alias("mean"), "low", "high", "quantiles_near",
                      (F.abs(F.col("n_distinct") - F.col("d")) <= F.greatest(S.DISTINCT_ERROR * F.col("d"), F.lit(1))).alias("distinct_near"),
                      (F.get("top", F.lit(0))["count"] == F.col("most")).alias("top_exact"))

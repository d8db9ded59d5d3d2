"""Field standardisation (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K, rules as R
from ..functions.text import alternation, truncate
from ..operators import documents as D
from ..schemas import METADATA_FIELDS
from .base import check
from .snippets import contains_any, context, null_like, q, safe_meta, strip, wc

CTX_COLS = ["scholarship_name", "description", "eligibility", "scholarship_details"]
REF = "2025-12-31 12:00:00"
BP = K.FUNDING_BOILERPLATE

SQL_FUNDING_TEXT = (
    f"(CASE WHEN contains(lower(coalesce(funding_type, '')), '{BP}') THEN {strip(f'''replace(lower(coalesce(funding_type, '')), '{BP}', '')''')} "
    f"ELSE lower(coalesce(funding_type, '')) END || ' ' || lower({context()}))")
SQL_MONEY = f"nullif({strip(f'regexp_extract(ft, {q(K.MONEY)}, 1)')}, '')"
SQL_TAGS = "coalesce(list_transform(string_split(tags, ','), lambda t: lower(trim(t, ' ''\"[]'))), [])"
SQL_CATEGORY = (f"CASE WHEN {contains_any('ft', K.FUNDING_TAXONOMY['Fully Funded'])} THEN 'Fully Funded' "
                f"WHEN {contains_any('ft', K.FUNDING_TAXONOMY['Partially Funded'])} THEN 'Partially Funded' "
                "ELSE 'Variable / Unspecified' END")


def _context(t):
    return t.listings.withColumn("context", R.expand_context(CTX_COLS))


def _tags(t):
    return t.listings.withColumn("tags", R.split_tags("tags"))


@check("c1_expand_context", f"SELECT item_id, {context()} AS context FROM {{listings}} AS l")
def c1(t):
    return _context(t).select("item_id", "context")


@check("c2_funding_text", f"SELECT item_id, {SQL_FUNDING_TEXT} AS funding_text FROM {{listings}} AS l")
def c2(t):
    return _context(t).select("item_id", R.funding_text("funding_type", "context").alias("funding_text"))


FUNDING_CTE = f"WITH f AS (SELECT item_id, {SQL_FUNDING_TEXT} AS ft FROM {{listings}} AS l)"


@check("c3_money", f"{FUNDING_CTE} SELECT item_id, {SQL_MONEY} AS funding_amount FROM f")
def c3(t):
    return _context(t).select("item_id", R.money(R.funding_text("funding_type", "context")).alias("funding_amount"))


@check("c4_funding_category", f"""{FUNDING_CTE}
SELECT item_id, CASE WHEN {SQL_MONEY} IS NOT NULL THEN 'Fixed Grant' ELSE {SQL_CATEGORY} END AS funding_category,
  {SQL_CATEGORY} AS keyword_category FROM f""")
def c4(t):
    ft = _context(t).select("item_id", R.funding_text("funding_type", "context").alias("ft"))
    return ft.select("item_id", R.funding_category("ft", R.money("ft")).alias("funding_category"),
                     R.first_category("ft", K.FUNDING_TAXONOMY, K.FUNDING_DEFAULT).alias("keyword_category"))


@check("c5_normalise_tags", f"SELECT item_id, array_to_string({SQL_TAGS}, '|') AS tags FROM {{listings}} AS l")
def c5(t):
    return _tags(t).select("item_id", F.array_join("tags", "|").alias("tags"))


LEVEL_CASE = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.LEVEL_TAGS.items())
SQL_TAG_LEVEL = f"list_filter(list_transform({SQL_TAGS}, lambda t: CASE t {LEVEL_CASE} END), lambda x: x IS NOT NULL)[1]"


@check("c6_first_mapped_tag", f"SELECT item_id, {SQL_TAG_LEVEL} AS academic_level FROM {{listings}} AS l")
def c6(t):
    return _tags(t).select("item_id", R.first_mapped_tag("tags").alias("academic_level"))


TERMS = {term: level for level, terms in K.LEVEL_TAXONOMY.items() for term in terms}
RE_TERMS = alternation(list(TERMS))
SQL_TERM = f"regexp_extract(lower({context()}), '(?:^|[^\\p{{L}}\\p{{N}}_])({RE_TERMS})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)"
SQL_PHRASE = f"CASE {SQL_TERM} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in TERMS.items()) + " END"


@check("c7_first_phrase", f"SELECT item_id, {SQL_PHRASE} AS academic_level FROM {{listings}} AS l")
def c7(t):
    return _context(t).select("item_id", R.first_phrase("context").alias("academic_level"))


@check("c8_academic_level", f"""
SELECT item_id, coalesce({SQL_TAG_LEVEL}, {SQL_PHRASE}, 'Unspecified') AS academic_level FROM {{listings}} AS l""")
def c8(t):
    ctx = R.expand_context(CTX_COLS)
    return t.listings.select("item_id", R.academic_level(R.split_tags("tags"), ctx).alias("academic_level"))


SQL_HOST = (f"CASE WHEN list_has_any({SQL_TAGS}, ['germany', 'daad']) THEN 'Germany' "
            f"WHEN list_has_any({SQL_TAGS}, ['college selection', 'usa']) OR lower({strip('country')}) = 'usa' THEN 'USA' "
            "ELSE 'Unspecified' END")
SQL_NATS = ("CASE WHEN list_has_any(tg, ['egypt', 'syria', 'jordan', 'saudi arabia']) THEN array_to_string(list_filter("
            "[CASE WHEN list_contains(tg, 'egypt') THEN 'Egypt' END, CASE WHEN list_contains(tg, 'jordan') THEN 'Jordan' END,"
            " CASE WHEN list_contains(tg, 'saudi arabia') THEN 'Saudi Arabia' END, CASE WHEN list_contains(tg, 'syria') THEN 'Syria' END],"
            " lambda x: x IS NOT NULL), ', ') ELSE 'International / All' END")


@check("c9_host_country", f"SELECT item_id, {SQL_HOST} AS host_country FROM {{listings}} AS l")
def c9(t):
    return _tags(t).select("item_id", R.host_country("tags", "country").alias("host_country"))


@check("c10_target_nationalities", f"""
SELECT item_id, {SQL_NATS} AS eligible_nationality FROM (SELECT item_id, {SQL_TAGS} AS tg FROM {{listings}} AS l) AS s""")
def c10(t):
    return _tags(t).select("item_id", R.target_values("tags").alias("eligible_nationality"))


# every_nationality: what a row names whose host is known, where host keywords do not count
SQL_PLACES = f"""
WITH toks AS (SELECT item_id, regexp_extract_all({context()}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS ts FROM {{listings}} AS l),
  win AS (SELECT item_id, unnest(list_transform(list_filter(generate_series(1, len(ts)), lambda i: ts[i] LIKE 'NATION%'),
            lambda i: ts[i] || '#' || lower(array_to_string(ts[greatest(i - 5, 1):i - 1], ' ')))) AS w FROM toks),
  hits AS (SELECT item_id, string_split(w, '#')[1] AS name, {contains_any('w', K.HOST_KEYWORDS)} AS h, {contains_any('w', K.NATIONALITY_KEYWORDS)} AS n
           FROM win WHERE string_split(w, '#')[1] IN (SELECT n_name FROM nation))
SELECT item_id, string_agg(DISTINCT CASE WHEN h THEN name END, ', ' ORDER BY CASE WHEN h THEN name END) AS hosts,
  string_agg(DISTINCT CASE WHEN n AND NOT h THEN name END, ', ' ORDER BY CASE WHEN n AND NOT h THEN name END) AS nationalities,
  string_agg(DISTINCT CASE WHEN n THEN name END, ', ' ORDER BY CASE WHEN n THEN name END) AS every_nationality
FROM hits WHERE h OR n GROUP BY item_id"""
SQL_C11 = f"SELECT item_id, hosts, nationalities FROM ({SQL_PLACES}) AS p"


@check("c11_context_entities", SQL_C11)
def c11(t):
    return D.context_entities(_context(t), "context", t.nation, id_col="item_id", name_col="n_name")


@check("c11_context_places", SQL_C11)
def c11_row(t):
    """The same lookup inside the row, for a short list of names."""
    names = [f"NATION_{i}" for i in range(25)]
    found = _context(t).select("item_id", D.context_places("context", names).alias("p")).select("item_id", "p.*")
    return found.filter("hosts is not null or nationalities is not null")


@check("c12_parse_date", """
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS parsed, CAST(NULL AS STRING) AS partial FROM orders""")
def c12(t):
    d = F.col("o_orderdate")
    shapes = ["yyyy-MM-dd", "MMMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy", "yyyy/M/d", "EEEE, MMMM d, yyyy"]
    shown = F.date_format(d, shapes[0])
    for i, shape in enumerate(shapes[1:-1], 1):
        shown = F.when(F.col("o_orderkey") % 6 == i, F.date_format(d, shape)).otherwise(shown)
    weekday = F.concat(F.date_format(d, "EEEE"), F.lit(", "), F.date_format(d, "MMMM d"), F.lit("th, "), F.date_format(d, "yyyy"))
    shown = F.when(F.col("o_orderkey") % 6 == 5, weekday).otherwise(shown)
    return t.orders.select("o_orderkey", R.parse_date(shown).alias("parsed"),
                           R.parse_date(F.date_format(d, "MMMM yyyy")).alias("partial"))


SQL_DEADLINE = f"""
WITH s AS (SELECT item_id, {strip("coalesce(deadline, 'none')")} AS v, {context()} AS c FROM {{listings}} AS l),
  u AS (SELECT *, lower(v) IN ('not specified', 'varies', 'nan', 'none', 'rolling', 'continuous') AS useless FROM s),
  w AS (SELECT *, CASE WHEN useless THEN 'Scholarship Details: ' || c ELSE 'Extracted Text: ' || v || ' | Scholarship Details: ' || c END AS txt FROM u)
SELECT item_id, coalesce(CASE WHEN NOT useless AND length(v) < 30 THEN strftime(coalesce(try_strptime(v, '%Y-%m-%d'),
    try_strptime(v, '%B %d, %Y'), try_strptime(v, '%m/%d/%Y')), '%Y-%m-%d') END,
  strftime(try_strptime(regexp_extract(txt, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1), '%Y-%m-%d'), '%Y-%m-%d'), 'Not Specified') AS standardized_deadline
FROM w"""


def _deadlines(t):
    ctx = R.expand_context(CTX_COLS)
    return t.listings.withColumn("standardized_deadline", R.standardise_deadline("deadline", ctx))


@check("c13_standardise_deadline", SQL_DEADLINE)
def c13(t):
    return _deadlines(t).select("item_id", "standardized_deadline")


ORDER_DATE = "CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN CAST('2025-12-31' AS TIMESTAMP) ELSE o_orderdate END"


def _dated(t):
    return t.sql(f"SELECT o_orderkey, {ORDER_DATE} AS d FROM {{orders}}")


@check("c14_is_expired", f"SELECT o_orderkey, coalesce(d < TIMESTAMP '{REF}', false) AS is_expired FROM (SELECT o_orderkey, {ORDER_DATE} AS d FROM orders) AS o")
def c14(t):
    return _dated(t).select("o_orderkey", R.is_expired("d", REF).alias("is_expired"))


@check("c15_status", f"""
SELECT o_orderkey, CASE WHEN d IS NULL THEN 'Rolling/Unspecified' WHEN d < TIMESTAMP '1999-06-01 12:00:00' THEN 'Expired' ELSE 'Active' END AS status
FROM (SELECT o_orderkey, {ORDER_DATE} AS d FROM orders) AS o""")
def c15(t):
    return _dated(t).select("o_orderkey", R.status("d", "1999-06-01 12:00:00").alias("status"))


@check("c16_impute_steps", f"""
SELECT item_id, CASE WHEN lower(s) IN ('nan', 'none', 'n/a', 'not specified', 'tba', '') OR {wc('s')} < 10 THEN {q(K.STEPS_FALLBACK)} ELSE s END AS application_process
FROM (SELECT item_id, {strip("coalesce(application_process, '')")} AS s FROM {{listings}} AS l) AS x""")
def c16(t):
    return t.listings.select("item_id", R.impute_short("application_process").alias("application_process"))


@check("c17_safe_meta", f"""
SELECT item_id, {safe_meta('scholarship_name')} AS name, {safe_meta('country', 'Nowhere')} AS country,
  {safe_meta('application_process', 'Unknown')} AS steps FROM {{listings}} AS l""")
def c17(t):
    return t.listings.select("item_id", R.safe_meta("scholarship_name").alias("name"),
                             R.safe_meta("country", "Nowhere").alias("country"),
                             R.safe_meta("application_process", "Unknown").alias("steps"))


SQL_AMOUNT = (f"CASE WHEN {null_like('funding_amount', ['nan', 'none', 'n/a', ''])} THEN CASE funding_category "
              "WHEN 'Fully Funded' THEN 'Full Coverage' WHEN 'Partially Funded' THEN 'Partial Coverage' ELSE 'Variable' END "
              f"ELSE {strip('funding_amount')} END")


@check("c18_impute_amount", f"SELECT item_id, {SQL_AMOUNT} AS funding_amount FROM {{items}} AS i")
def c18(t):
    return t.items.select("item_id", R.impute_amount("funding_amount", "funding_category").alias("funding_amount"))


@check("c19_metadata", "SELECT item_id, " + ", ".join(
    (SQL_AMOUNT if f == "funding_amount" else safe_meta(f, "Unknown" if f == "scholarship_status" else "Unspecified"))
    + f" AS {f}" for f in METADATA_FIELDS) + " FROM {items} AS i")
def c19(t):
    items = t.items
    return items.select("item_id", R.metadata(items.columns).alias("m")).select("item_id", "m.*")


REPLY = ("CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Sure: ```' || props || '``` done' "
         "WHEN 2 THEN props WHEN 3 THEN 'no json: ' || props ELSE '{{\"other\": 1}}' END")


@check("c20_parse_reply", """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN json_extract_string(props, '$.k') ELSE 'Unspecified' END AS k FROM events""")
def c20(t):
    replies = t.sql(f"SELECT event_id, {REPLY} AS reply FROM {{events}}")
    return replies.select("event_id", R.parse_reply("reply", "k", K.UNSPECIFIED).alias("k"))


@check("c21_truncate", """
SELECT doc_id, substr(text, 1, 1000) AS t1, length(substr(text, 1, 4000)) AS n4, length(substr(text, 1, 8000)) AS n8 FROM documents""")
def c21(t):
    return t.documents.select("doc_id", truncate("text", 1000).alias("t1"), F.length(truncate("text", 4000)).alias("n4"),
                              F.length(truncate("text", 8000)).alias("n8"))

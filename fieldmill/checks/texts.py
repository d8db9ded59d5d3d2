"""Text cleaning, documents (D) and chunks (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text, collapse_ws, deep_links, not_contained, word_count
from ..operators import chunks as C, documents as D
from .base import check
from .snippets import WS, clean, safe_meta, strip, wc

NOISY = "text || chr(10) || chr(10) || chr(10) || chr(10) || '<b>Read more</b> at https://x.example/' || CAST(doc_id AS STRING) || ' === •' || chr(10) || 'me@x.example   end'"


@check("d1_clean_text", f"""
SELECT doc_id, {clean('text')} AS clean, {clean('noisy')} AS clean_noisy FROM (SELECT doc_id, text, {NOISY} AS noisy FROM documents) AS d""")
def d1(t):
    docs = t.sql(f"SELECT doc_id, text, {NOISY} AS noisy FROM {{documents}}")
    return docs.select("doc_id", clean_text("text").alias("clean"), clean_text("noisy").alias("clean_noisy"))


@check("d2_word_count", f"SELECT doc_id, {wc('text')} AS n_words FROM documents")
def d2(t):
    return t.documents.select("doc_id", word_count("text").alias("n_words"))


SQL_DOCUMENT = f"""
WITH c AS (SELECT item_id, {safe_meta('scholarship_name')} AS name, {safe_meta('application_link')} AS link,
    coalesce({clean('description')}, '') AS descr, coalesce({clean('scholarship_details')}, '') AS details,
    coalesce({clean('eligibility')}, '') AS elig FROM {{listings}} AS l)
SELECT item_id, concat_ws(chr(10) || chr(10), '# Scholarship: ' || name,
  CASE WHEN link <> 'Unspecified' THEN '**Application Link:** ' || link END,
  CASE WHEN descr <> '' AND NOT contains(details, substr(descr, 1, 100)) THEN '## Program Description' || chr(10) || descr END,
  CASE WHEN details <> '' THEN '## Scholarship Details' || chr(10) || details END,
  CASE WHEN elig <> '' THEN '## Eligibility Criteria' || chr(10) || elig END) AS rag_document FROM c"""


@check("d3_build_document", SQL_DOCUMENT)
def d3(t):
    return D.build_document(t.listings).select("item_id", "rag_document")


@check("d4_containment", """
SELECT item_id, CASE WHEN description <> '' AND NOT contains(scholarship_details, substr(description, 1, 100)) THEN description END AS description
FROM {listings} AS l""")
def d4(t):
    return t.listings.select("item_id", not_contained("description", "scholarship_details").alias("description"))


@check("d5_collapse_ws", f"""
SELECT doc_id, tx AS text FROM (SELECT doc_id, {strip("regexp_replace(text, '\\s+', ' ', 'g')")} AS tx FROM documents) AS d WHERE length(tx) >= 50""")
def d5(t):
    docs = t.documents.select("doc_id", collapse_ws("text").alias("text"))
    return C.prune_short(docs, "text", 50)


@check("d6_deep_links", """
SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_concat([application_link],
  regexp_extract_all(coalesce(eligibility, '') || coalesce(application_process, ''), '\\[(https?://[^\\s\\]]+)\\]', 1)),
  lambda x: x IS NOT NULL AND x <> ''))), '|') AS links FROM {listings} AS l""")
def d6(t):
    links = deep_links("application_link", ["eligibility", "application_process"])
    return t.listings.select("item_id", F.array_join(F.array_sort(links), "|").alias("links"))


MARKDOWN = ("'intro ' || source || chr(10) || chr(10) || '# Title ' || CAST(doc_id AS STRING) || chr(10) || chr(10) || '## First' || chr(10) || text "
            "|| chr(10) || '##' || lang || chr(10) || '## Second' || chr(10) || chr(10) || 'more  ' || chr(10) || '# Other' || chr(10) || 'tail ' || text")

# An independent line-by-line formulation: headers by flags and running windows.
def sections_ctes(source: str) -> str:
    """CTEs ending in ``sections(doc_id, section_no, document_title, section_title, text)`` of a query (doc_id, md)."""
    return f"""md AS ({source}),
  lines AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS raw, unnest(generate_series(1, len(string_split(md, chr(10))))) AS pos FROM md),
  l2 AS (SELECT doc_id, pos, trim(regexp_replace({strip('raw')}, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g')) AS line FROM lines),
  l3 AS (SELECT *, line = '#' OR line LIKE '# %' AS h1, line = '##' OR line LIKE '## %' AS h2 FROM l2),
  l4 AS (SELECT *, sum(CASE WHEN h1 OR h2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part,
    last_value(CASE WHEN h1 THEN trim(substr(line, 2)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS dt,
    last_value(CASE WHEN h1 OR h2 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS hp FROM l3),
  l5 AS (SELECT l4.*, CASE WHEN h.h2 THEN trim(substr(h.line, 3)) END AS st,
    max(CASE WHEN l4.line <> '' THEN l4.pos END) OVER (PARTITION BY l4.doc_id, l4.part ORDER BY l4.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM l4 LEFT JOIN l3 AS h ON h.doc_id = l4.doc_id AND h.pos = l4.hp),
  parts AS (SELECT doc_id, part, min(dt) AS dt, min(st) AS st, bool_or(h1 OR h2) AS headed, count(*) FILTER (line <> '') AS n,
      string_agg(CASE WHEN prev IS NULL THEN line WHEN prev = pos - 1 THEN chr(10) || line ELSE '  ' || chr(10) || line END, '' ORDER BY pos) FILTER (line <> '') AS txt,
      arg_max(line, pos) FILTER (line <> '') AS last_line
    FROM l5 GROUP BY doc_id, part HAVING count(*) FILTER (line <> '') > 0),
  nxt AS (SELECT *, last_line LIKE '#%' AND ((lead(st) OVER w IS NOT NULL AND st IS NULL) OR (lead(dt) OVER w IS NOT NULL AND dt IS NULL AND st IS NULL)) AS joins
    FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY part)),
  grp AS (SELECT *, sum(CASE WHEN pj THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY part) AS g
    FROM (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY part), false) AS pj FROM nxt) AS x),
  sections AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INT) AS section_no, arg_max(dt, part) AS document_title,
  arg_max(st, part) AS section_title, string_agg(txt, '  ' || chr(10) ORDER BY part) AS text FROM grp GROUP BY doc_id, g)"""


SQL_SECTIONS = f"WITH {sections_ctes(f'SELECT doc_id, {MARKDOWN} AS md FROM documents')} SELECT * FROM sections"


def _markdown(t):
    return t.sql(f"SELECT doc_id, {MARKDOWN} AS md FROM {{documents}}")


@check("e1_split_sections", SQL_SECTIONS)
def e1(t):
    return C.split_sections(_markdown(t), "md")


def recursive_ctes(source: str, size: int, overlap: int, tag: str = "") -> str:
    """CTEs ending in ``chunks{tag}(id, chunk_no, text)`` of a query (id, text): the split said by lists of places and a
    recursion from chunk to chunk."""
    stages, at = [], "s0"
    for k, mark in enumerate(C.SEPARATORS):
        lit = " || ".join(["chr(10)"] * len(mark)) if mark.startswith("\n") else f"'{mark}'"
        parts = (f"list_filter(list_transform(string_split(x.t, {lit}), lambda y, j: CASE WHEN j > 1 THEN {lit} || y ELSE y END), lambda y: y <> '')")
        stages.append(f"""s{k + 1}{tag} AS (SELECT id, text, flatten(list_transform(p, lambda x, i: CASE WHEN x.small OR NOT contains(x.t, {lit}) THEN [x]
    ELSE list_transform({parts}, lambda y: {{'t': y, 'node': '{k}:' || CAST(i AS VARCHAR), 'small': length(y) < {size}}}) END)) AS p FROM {at}{tag})""")
        at = f"s{k + 1}"
    return f"""src{tag} AS ({source}),
  s0{tag} AS (SELECT id, text, [{{'t': text, 'node': '', 'small': false}}] AS p FROM src{tag} WHERE length(text) > {size}),
  {", ".join(stages)},
  leaf{tag} AS (SELECT id, x.node, x.small, length(x.t) AS n, k FROM (SELECT id, unnest(p) AS x, unnest(generate_series(1, len(p))) AS k FROM {at}{tag}) AS u),
  place{tag} AS (SELECT *, CAST(sum(n) OVER w - n AS BIGINT) AS off, CASE WHEN small AND lag(small) OVER w AND lag(node) OVER w = node THEN 0 ELSE 1 END AS new
    FROM leaf{tag} WINDOW w AS (PARTITION BY id ORDER BY k)),
  run{tag} AS (SELECT id, r, bool_and(small) AS small, list_append(list(off ORDER BY k), max(off + n)) AS b FROM
    (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY k) AS r FROM place{tag}) AS x GROUP BY 1, 2),
  rec{tag} AS (SELECT id, r, b, CAST(1 AS BIGINT) AS s, greatest(len(list_filter(b, lambda v: v - b[1] <= {size})), 2) AS e FROM run{tag} WHERE small
    UNION ALL SELECT id, r, b, s2, greatest(len(list_filter(b, lambda v: v - b[s2] <= {size})), e + 1) FROM (SELECT *, greatest(s,
      len(list_filter(b, lambda v: v < b[e] - least({overlap}, {size} - (b[e + 1] - b[e])))) + 1) AS s2 FROM rec{tag} WHERE e < len(b)) AS z),
  span{tag} AS (SELECT id, r, b[s] AS f, b[e] AS u FROM rec{tag} UNION ALL
    SELECT id, r, b[1] + j * {size - overlap}, least(b[1] + j * {size - overlap} + {size}, b[2]) FROM (SELECT id, r, b,
      unnest(generate_series(0, CAST(ceil(greatest(b[2] - b[1] - {size}, 0) / {size - overlap}) AS BIGINT))) AS j FROM run{tag} WHERE NOT small) AS g),
  cut{tag} AS (SELECT id, r, f, {strip('substr(text, CAST(f + 1 AS BIGINT), CAST(u - f AS BIGINT))')} AS text FROM span{tag} JOIN src{tag} USING (id)
    UNION ALL SELECT id, 0, 0, {strip('text')} FROM src{tag} WHERE length(text) <= {size}),
  chunks{tag} AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY r, f) - 1 AS INT) AS chunk_no, text FROM cut{tag} WHERE text <> '')"""


@check("e2_split_recursive", f"""
WITH RECURSIVE {recursive_ctes('SELECT doc_id AS id, text FROM documents', 800, 100)} SELECT id AS doc_id, chunk_no, text FROM chunks""")
def e2(t):
    return C.split_recursive(t.documents.select("doc_id", "text"), 800, 100)


def stride_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return (f"SELECT doc_id, CAST(i AS INT) AS chunk_no, substr(text, CAST(i * {step} + 1 AS BIGINT), {size}) AS text FROM (SELECT doc_id, text, "
            f"unnest(generate_series(0, (greatest(length(text), 1) - 1) // {step})) AS i FROM documents) AS c WHERE length(text) > 0")


@check("e2_split_stride", stride_sql(500, 50))
def e2_stride(t):
    return C.split_stride(t.documents.select("doc_id", "text"), 500, 50)


@check("e3_prune_short", f"SELECT * FROM ({stride_sql(500, 50)}) AS c WHERE length(trim(text, {WS})) >= 30")
def e3(t):
    return C.prune_short(e2_stride(t))


@check("e4_slim_meta", """
SELECT item_id, CASE WHEN item_id % 5 = 0 THEN coalesce(scholarship_name, 'Unknown') ELSE scholarship_name END AS scholarship_name,
  CASE WHEN item_id % 5 = 0 THEN NULL ELSE country END AS country, lang AS section_title, CAST(3 AS INT) AS n_fields FROM {listings} AS l""")
def e4(t):
    meta = F.when(F.col("item_id") % 5 != 0, F.struct(
        "scholarship_name", "country", "application_process", F.lit("old").alias("section_title")))
    df = t.listings.withColumn("rag_metadata", meta).withColumn("section_title", F.col("lang"))
    out = C.slim_meta(df, sections=["section_title"])
    n = len(out.schema["rag_metadata"].dataType.names)
    return out.select("item_id", "rag_metadata.*").withColumn("n_fields", F.lit(n))


def _sweep_sql() -> str:
    from ..functions import fixed as K
    return " UNION ALL ".join(
        f"SELECT '{name}' AS configuration, CAST({size} AS INT) AS chunk_size, CAST({overlap} AS INT) AS overlap, count(*) AS total_chunks, "
        f"round(avg(length(text)), 2) AS avg_chunk_length FROM ({stride_sql(size, overlap)}) AS c WHERE length(trim(text, {WS})) >= 30"
        for name, size, overlap in K.CHUNK_CONFIGS)


@check("e5_sweep_stride", _sweep_sql())
def e5(t):
    return C.sweep_chunk_configs(t.documents, recursive=False, by_sections=False)


OF_SECTIONS = "SELECT {'d': doc_id, 's': section_no} AS id, text FROM sections"


def _sweep_recursive_sql() -> str:
    from ..functions import fixed as K
    ctes = ", ".join(recursive_ctes(OF_SECTIONS, size, overlap, f"_{k}") for k, (_, size, overlap) in enumerate(K.CHUNK_CONFIGS))
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS configuration, CAST({size} AS INT) AS chunk_size, CAST({overlap} AS INT) AS overlap, count(*) AS total_chunks, "
        f"round(avg(length(text)), 2) AS avg_chunk_length FROM chunks_{k} WHERE length(trim(text, {WS})) >= 30"
        for k, (name, size, overlap) in enumerate(K.CHUNK_CONFIGS))
    return f"WITH RECURSIVE {sections_ctes('SELECT doc_id, text AS md FROM documents')}, {ctes} {rows}"


@check("e5_sweep_recursive", _sweep_recursive_sql())
def e5_recursive(t):
    return C.sweep_chunk_configs(t.documents)

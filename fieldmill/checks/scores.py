"""Evaluation (I) and the end-to-end flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators import eligibility as EL, evaluation as E, lexical as B
from ..operators.ranking import broadcast_if_small
from ..plans import etl
from . import retrieval as RT, rules as RL
from .base import check
from .retrieval import BENCH, DOCS, bm25_ctes
from .snippets import clean, safe_meta, words
from .texts import OF_SECTIONS, SQL_DOCUMENT, recursive_ctes, sections_ctes

TRUTH = "SELECT b.item_id AS query_id, d.doc_id FROM {benchmark} AS b JOIN {documents} AS d ON contains(d.text, b.text)"


def truth(t):
    """Which documents hold which benchmark text: a fixed ground truth of the given tables."""
    return E.containment_truth(RT.bench_queries(t), t.documents)


@check("i1_with_distractors", """
SELECT 'real_doc_' || CAST(item_id AS STRING) AS doc_id, 'real' AS type, text FROM benchmark UNION ALL
SELECT 'noise_doc_' || CAST(i AS STRING), 'noise', 'Filler number ' || CAST(i AS STRING) || ' on ' || ['sourdough baking', 'league fixtures', 'bronze age trade', 'bicycle repair', 'tide tables'][i % 5 + 1]
FROM (SELECT unnest(generate_series(0, 69)) AS i) AS n""")
def i1(t):
    return E.with_distractors(t.benchmark, id_col="item_id")


JUDGED = f"""WITH {bm25_ctes(DOCS, BENCH)}, truth AS ({TRUTH}),
  j AS (SELECT t.query_id, min(bm.rank) AS best FROM truth AS t LEFT JOIN bm ON bm.query_id = t.query_id AND bm.doc_id = t.doc_id AND bm.rank <= 5 GROUP BY 1)"""


@check("i2_recall_at_k", JUDGED + " SELECT query_id, CASE WHEN best IS NULL THEN 0.0 ELSE 1.0 END AS recall FROM j")
def i2(t):
    return E.recall_at_k(RT.bm25_hits(t, 5), truth(t))


# passages of one and two words, the second cut short, and one of spaces
SHORT = """SELECT item_id AS query_id, split_part(text, ' ', 1) AS query FROM {benchmark} AS b
  UNION ALL SELECT item_id + 100000, split_part(text, ' ', 2) || ' ' || substr(split_part(text, ' ', 3), 1, 2) FROM {benchmark} AS b
  UNION ALL SELECT item_id + 200000, substr(text, 1, 1 + item_id % 3) FROM {benchmark} AS b
  UNION ALL SELECT 300000, '  '"""


@check("i2_recall_short_passages", f"""WITH {bm25_ctes(DOCS, SHORT)},
  truth AS (SELECT q.query_id, d.doc_id FROM ({SHORT}) AS q JOIN {{documents}} AS d ON contains(d.text, q.query)),
  j AS (SELECT t.query_id, count(DISTINCT t.doc_id) AS n_true, min(bm.rank) AS best FROM truth AS t LEFT JOIN bm ON bm.query_id = t.query_id AND bm.doc_id = t.doc_id AND bm.rank <= 5 GROUP BY 1)
SELECT query_id, n_true, CASE WHEN best IS NULL THEN 0.0 ELSE 1.0 END AS recall FROM j""")
def i2_short(t):
    queries = t.sql(SHORT)
    held = E.containment_truth(queries, t.documents)
    hits = B.bm25_topk(queries, RT.index_of(t.documents), 5)
    return E.recall_at_k(hits, held).join(held.groupBy("query_id").agg(F.count("*").alias("n_true")), "query_id")


@check("i3_reciprocal_rank", JUDGED + " SELECT query_id, round(coalesce(1.0 / best, 0.0), 6) AS reciprocal_rank FROM j")
def i3(t):
    out = E.reciprocal_rank(RT.bm25_hits(t, 5), truth(t))
    return out.withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@check("i3_mrr", JUDGED + " SELECT round(avg(coalesce(1.0 / best, 0.0)), 6) AS mrr FROM j")
def i3_mrr(t):
    return E.mrr(RT.bm25_hits(t, 5), truth(t))


CLEAN_DOCS = f"SELECT doc_id, {clean('text')} AS text FROM documents"


@check("i4_dashboard", JUDGED.replace(DOCS, CLEAN_DOCS) + """
SELECT count(*) AS n_cases, round(avg(CASE WHEN best IS NULL THEN 0.0 ELSE 1.0 END), 6) AS avg_recall, round(avg(coalesce(1.0 / best, 0.0)), 6) AS avg_reciprocal_rank FROM j""")
def flagship(t):
    """Clean the documents, index them, search every benchmark text, score against the ground truth."""
    cleaned = t.documents.select("doc_id", clean_text("text").alias("text"))
    hits = B.bm25_topk(RT.bench_queries(t), RT.index_of(cleaned), 5)
    return E.dashboard(E.retrieval_scores(hits, truth(t)), ["recall", "reciprocal_rank"])


@check("i5_top1_accuracy", JUDGED.replace("bm.rank <= 5", "bm.rank <= 1") + " SELECT round(avg(CASE WHEN best IS NULL THEN 0.0 ELSE 1.0 END), 6) AS top1_accuracy FROM j")
def i5(t):
    return E.top1_accuracy(RT.bm25_hits(t, 5), truth(t))


ANSWER = "CASE WHEN turn % 3 = 0 THEN text || ' **Official Application Link:** https://x.example' WHEN turn % 3 = 1 THEN text ELSE CAST(NULL AS STRING) END"


@check("i6_link_compliance", f"""
SELECT count(*) AS n, round(avg(CASE WHEN contains(coalesce(a, ''), '**Official Application Link:**') THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT {ANSWER} AS a FROM conversations) AS c""")
def i6(t):
    return E.contains_rate(t.sql(f"SELECT {ANSWER} AS answer FROM {{conversations}}"), "answer")


@check("i7_filter_leaks", f"""
WITH r AS ({RT.ASKED}), i AS {{items}} SELECT count(*) AS n_pairs, CAST(0 AS BIGINT) AS n_leaks FROM r, i WHERE {RT.eligible('r', 'i')}""")
def i7(t):
    """The facet join of the filter against the row predicate, over all requests and items: no row may leak."""
    return EL.leak_counts(RT.asked(t), t.items)


@check("i8_hit_diagnostics", RT.HITS + """
SELECT query_id, rank, scholarship_name, academic_level, round(rerank_score, 3) AS score, CASE WHEN contains(p, 'http') OR contains(p, 'www') THEN 'Yes' ELSE 'No' END AS has_link,
  CASE WHEN contains(lower(p), 'step') OR contains(lower(p), 'apply') THEN 'Yes' ELSE 'No' END AS has_steps, substr(p, 1, 150) || '...' AS snippet
FROM (SELECT *, replace(text, chr(10), ' ') AS p FROM hits) AS h""")
def i8(t):
    return E.hit_diagnostics(RT.item_hits(t))


CASES = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'free text ' || CAST(event_id AS STRING) ELSE '' END AS student_profile,
  CASE WHEN event_id % 4 = 0 THEN split('', ',') ELSE split('first,second', ',') END AS contexts FROM {events}"""


@check("i9_parse_cases", f"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(student_profile, '$.k') AS INT) END AS k,
  CASE WHEN event_id % 3 > 0 THEN student_profile END AS profile_raw, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'first' END AS context FROM ({CASES}) AS c""")
def i9(t):
    out = E.parse_cases(t.sql(CASES), "k int")
    return out.select("event_id", F.col("profile.k").alias("k"), "profile_raw", "context")


@check("i10_groundedness", f"""
WITH a AS (SELECT conv_id, turn, list_distinct({words('lower(text)')}) AS aw FROM conversations WHERE role = 'assistant'),
  c AS (SELECT conv_id, turn, list_distinct({words('lower(text)')}) AS cw FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(aw, cw)) / nullif(len(aw), 0), 6) AS groundedness FROM a JOIN c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1""")
def i10(t):
    chat = t.conversations
    before = chat.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    pairs = chat.filter("role = 'assistant'").join(before, ["conv_id", "turn"])
    return E.groundedness(pairs, "text", "context").select("conv_id", "turn", "groundedness")


# ---- the whole way from listings to tables -----------------------------------------------------------------------

MASTER = f"""{RL.FUNDING_CTE},
  fu AS (SELECT item_id, {RL.SQL_MONEY} AS funding_amount, CASE WHEN {RL.SQL_MONEY} IS NOT NULL THEN 'Fixed Grant' ELSE {RL.SQL_CATEGORY} END AS funding_category FROM f),
  le AS (SELECT item_id, coalesce({RL.SQL_TAG_LEVEL}, {RL.SQL_PHRASE}, 'Unspecified') AS academic_level, {RL.SQL_HOST} AS host_country FROM {{listings}} AS l),
  na AS (SELECT item_id, {RL.SQL_NATS} AS eligible_nationality FROM (SELECT item_id, {RL.SQL_TAGS} AS tg FROM {{listings}} AS l) AS s),
  de AS ({RL.SQL_DEADLINE}), dc AS ({SQL_DOCUMENT}), pl AS ({RL.SQL_PLACES}),
  m AS (SELECT fu.*, le.academic_level, le.host_country, na.eligible_nationality, de.standardized_deadline, dc.rag_document,
    CASE WHEN standardized_deadline = 'Not Specified' THEN 'Rolling/Unspecified' WHEN standardized_deadline < '2026-01-01' THEN 'Expired' ELSE 'Active' END AS scholarship_status
    FROM fu JOIN le USING (item_id) JOIN na USING (item_id) JOIN de USING (item_id) JOIN dc USING (item_id))"""
MASTER_COLS = ("item_id", "funding_amount", "funding_category", "academic_level", "host_country", "eligible_nationality",
               "standardized_deadline", "scholarship_status", "rag_document")


@check("m1_master_table", MASTER + f" SELECT {', '.join(MASTER_COLS)} FROM m")
def m1(t):
    return etl.master_table(t.listings, "2026-01-01").select(*MASTER_COLS)


PLACED = """ SELECT m.item_id, CASE WHEN host_country = 'Unspecified' THEN coalesce(hosts, host_country) ELSE host_country END AS host_country,
  CASE WHEN eligible_nationality = 'International / All' THEN coalesce(CASE WHEN m.host_country = 'Unspecified' THEN nationalities ELSE every_nationality END, eligible_nationality) ELSE eligible_nationality END AS eligible_nationality
FROM m LEFT JOIN pl ON pl.item_id = m.item_id"""


@check("m2_master_table_with_places", MASTER + PLACED)
def m2(t):
    places = t.nation.select(F.col("n_name").alias("name"))
    return etl.master_table(t.listings, "2026-01-01", gazetteer=places, id_col="item_id").select(
        "item_id", "host_country", "eligible_nationality")


@check("m2_master_table_with_place_list", MASTER + PLACED)
def m2_list(t):
    names = [f"NATION_{i}" for i in range(25)]
    return etl.master_table(t.listings, "2026-01-01", gazetteer=names).select(
        "item_id", "host_country", "eligible_nationality")


@check("m3_chunk_table", MASTER.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {sections_ctes("SELECT item_id AS doc_id, rag_document AS md FROM m WHERE trim(rag_document) <> ''")},
  {recursive_ctes(OF_SECTIONS, 800, 100)}
SELECT m.item_id, id.s AS section_no, chunk_no, document_title, section_title, c.text, {safe_meta('l.scholarship_name')} AS scholarship_name, m.scholarship_status
FROM chunks AS c JOIN sections AS x ON x.doc_id = id.d AND x.section_no = id.s JOIN m ON m.item_id = id.d JOIN {{listings}} AS l ON l.item_id = m.item_id
WHERE length(c.text) >= 30""")
def m3(t):
    chunks = etl.chunk_table(etl.master_table(t.listings, "2026-01-01"), id_col="item_id")
    return chunks.select("item_id", "section_no", "chunk_no", "document_title", "section_title", "text",
                         "rag_metadata.scholarship_name", "rag_metadata.scholarship_status")

"""Retrieval (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.vectors import l2_normalise
from ..operators import dense as V, details as X, eligibility as E, fusion as U, lexical as B
from ..plans import matching as M
from ..session import fresh_path, written
from .base import check
from .snippets import contains_any, strip, words

# ---- oracle fragments -------------------------------------------------------------------------------------------


def bm25_ctes(corpus: str, queries: str) -> str:
    """CTEs ending in ``bm(query_id, doc_id, score, rank)``."""
    return f"""
  corpus AS ({corpus}), queries AS ({queries}),
  dl AS (SELECT doc_id, len({words('text')}) AS dl FROM corpus),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words('text')}) AS term FROM corpus) AS x GROUP BY 1, 2),
  st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
  raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1) AS d, st),
  idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
  qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({words('query')}) AS term FROM queries) AS x GROUP BY 1, 2),
  bs AS (SELECT query_id, tf.doc_id, sum(CAST(qtf * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS DECIMAL(28, 15))) AS score
         FROM qt JOIN idf ON idf.term = qt.term JOIN tf ON tf.term = qt.term JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY 1, 2),
  bm AS (SELECT query_id, doc_id, round(CAST(bs.score AS DOUBLE), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY bs.score DESC, doc_id) AS rank FROM bs WHERE bs.score <> 0)"""


COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
DOCS = "SELECT doc_id, text FROM documents"
BENCH = "SELECT item_id AS query_id, text AS query FROM benchmark"
# nearest vectors of the vectors that stand for the queries
DENSE = f"""
  dsc AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {COSINE} AS score FROM embeddings AS a, embeddings AS b
          WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
  dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dsc)"""

FUNDING = (f"CASE WHEN {contains_any('lower(query)', K.FULL_FUNDING_PHRASES)} THEN 'Fully Funded' "
           f"WHEN {contains_any('lower(query)', K.PARTIAL_FUNDING_PHRASES)} THEN 'Partially Funded' END")
BYPASS = contains_any("lower(query)", K.BYPASS_NAMES)
ENRICHED = (f"concat_ws(' ', nullif({strip('query')}, ''), '(' || concat_ws(' | ', 'Academic Focus: ' || academic_major, "
            "CASE WHEN research_interests <> '' THEN 'Research: ' || research_interests END, "
            "CASE WHEN len(skills) > 0 THEN 'Skills: ' || array_to_string(skills, ', ') END) || ')')")
ASKED = f"""SELECT r.query_id, r.session_id, query, {FUNDING} AS target_funding, {BYPASS} AS bypass_filters, {ENRICHED} AS search_query,
  nationality, academic_level FROM {{requests}} AS r JOIN {{profiles}} AS p ON p.session_id = r.session_id"""


def eligible(r: str, i: str) -> str:
    """Line-by-line statement of the filter, written without the facet idea of the Spark side."""
    return f"""{i}.scholarship_status <> 'Expired' AND ({r}.target_funding IS NULL OR {r}.target_funding = {i}.funding_category)
  AND ({r}.bypass_filters OR ((contains(lower({i}.eligible_nationality), lower({r}.nationality)) OR {i}.eligible_nationality ILIKE '%International%'
    OR {i}.eligible_nationality ILIKE '%Unspecified%' OR {i}.eligible_nationality ILIKE '%All%' OR {i}.eligible_nationality ILIKE '%World%')
   AND ({i}.academic_level = 'Unspecified' OR ({r}.academic_level = 'Bachelor' AND {i}.academic_level = 'Undergraduates')
    OR ({r}.academic_level = 'Master' AND {i}.academic_level = 'Graduates')
    OR ({r}.academic_level IN ('PhD', 'Postdoc') AND {i}.academic_level = 'Doctoral/PhD'))))"""


# ---- shared Spark inputs ----------------------------------------------------------------------------------------


def bench_queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def index_of(docs):
    return B.stored_index(docs, "doc_id", "text", fresh_path(docs.sparkSession, "bm25"))


def bm25_hits(t, k):
    return B.bm25_topk(bench_queries(t), index_of(t.documents), k)


def query_vectors(t):
    return t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def dense_hits(t, k):
    return V.knn(query_vectors(t), t.embeddings, k).withColumnRenamed("vec_id", "doc_id")


def asked(t):
    return M.prepare_requests(t.requests, t.profiles)


# ---- queries ----------------------------------------------------------------------------------------------------


@check("f1_detect_intents", f"SELECT query_id, {BYPASS} AS bypass_filters, {FUNDING} AS target_funding FROM {{requests}} AS r")
def f1(t):
    return E.detect_intents(t.requests).select("query_id", "bypass_filters", "target_funding")


@check("f2_eligible_pairs", f"""
WITH r AS ({ASKED}), i AS {{items}} SELECT r.query_id, i.item_id FROM r, i WHERE {eligible('r', 'i')}""")
def f2(t):
    return E.eligible_pairs(asked(t), t.items, request_id="query_id")


@check("f2_eligible_counts", f"""
WITH p AS (SELECT *, CAST(NULL AS STRING) AS target_funding, false AS bypass_filters FROM {{profiles}} AS pp), i AS {{items}},
  n AS (SELECT nationality, academic_level, count(*) AS n, min(item_id) AS low FROM (SELECT DISTINCT nationality, academic_level, target_funding, bypass_filters FROM p) AS r, i
        WHERE {eligible('r', 'i').replace('r.', 'r.')} GROUP BY 1, 2)
SELECT p.session_id, coalesce(n, 0) AS n_eligible, low AS first_item FROM p LEFT JOIN n ON n.nationality = p.nationality AND n.academic_level = p.academic_level"""
       .replace("SELECT nationality, academic_level, count(*)", "SELECT r.nationality, r.academic_level, count(*)"))
def f2_counts(t):
    return E.eligible_counts(t.profiles, t.items)


@check("f3_level_map", """
SELECT session_id, unnest(CASE academic_level WHEN 'Bachelor' THEN ['Undergraduates', 'Unspecified'] WHEN 'Master' THEN ['Graduates', 'Unspecified']
  WHEN 'PhD' THEN ['Doctoral/PhD', 'Unspecified'] WHEN 'Postdoc' THEN ['Doctoral/PhD', 'Unspecified'] ELSE ['Unspecified'] END) AS item_level
FROM {profiles} AS p""")
def f3(t):
    return t.profiles.select("session_id", F.explode(E.item_levels("academic_level")).alias("item_level"))


@check("f4_enrich_query", f"""
SELECT query_id, {ENRICHED} AS search_query FROM {{requests}} AS r JOIN {{profiles}} AS p ON p.session_id = r.session_id""")
def f4(t):
    return E.enrich_query(t.requests.join(t.profiles, "session_id")).select("query_id", "search_query")


@check("f5_knn", f"""
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, {COSINE} AS score FROM embeddings AS a, embeddings AS b) AS s) AS r WHERE rank <= 5""")
def f5(t):
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return V.knn(queries, t.embeddings, 5)


@check("f5_knn_prefiltered", f"""
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, {COSINE} AS score FROM embeddings AS a JOIN embeddings AS b
    ON b.label = a.label OR b.label = (a.label + 1) % 10) AS s) AS r WHERE rank <= 15""")
def f5_filtered(t):
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")
    wanted = asked.select("query_id", F.explode(F.array("label", (F.col("label") + 1) % 10)).alias("number"))
    queries = asked.join(V.facet_bits(wanted, "query_id", "number"), "query_id")
    return V.knn(queries, t.embeddings, 15, facet="label", query_facets="facets")


@check("f5_knn_among", f"""
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, {COSINE} AS score FROM embeddings AS a JOIN embeddings AS b ON b.label = a.label
    WHERE a.vec_id IN (SELECT item_id FROM benchmark)) AS s) AS r WHERE rank <= 15""")
def f5_among(t):
    queries = query_vectors(t)
    labelled = t.embeddings.select(F.col("vec_id").alias("query_id"), "label").join(queries, "query_id", "left_semi")
    pairs = labelled.join(t.embeddings.select("vec_id", "label"), "label").select("query_id", "vec_id")
    return V.knn_among(pairs, queries, t.embeddings, 15)


@check("f6_l2_normalise", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 7)) AS v FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 7 > 0 THEN array_to_string(list_transform(v, lambda x: CAST(round(x / sqrt(list_inner_product(v, v)) * 1000000) AS BIGINT)), ',') END AS unit FROM s""")
def f6(t):
    scaled = t.embeddings.withColumn("v", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7)))
    unit = F.transform(l2_normalise("v"), lambda x: F.round(x * 1000000).cast("bigint").cast("string"))
    return scaled.select("vec_id", F.array_join(unit, ",").alias("unit"))


INDEX = f"WITH {bm25_ctes(DOCS, BENCH)} "


@check("f7_bm25_terms", INDEX + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def f7(t):
    index = B.bm25_index(t.documents, "doc_id", "text")
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@check("f7_bm25_postings", INDEX + "SELECT doc_id, term, tf FROM tf")
def f7_postings(t):
    return B.postings(B.tokenised(t.documents, "doc_id", "text"))


@check("f7_bm25_stats", INDEX + "SELECT n_docs, round(avgdl, 6) AS avgdl, round((SELECT avg(r) FROM raw), 6) AS mean_idf FROM st")
def f7_stats(t):
    stats = B.bm25_index(t.documents, "doc_id", "text").stats
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


@check("f8_bm25_topk_stored", INDEX + "SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 15")
def f8_stored(t):
    path = fresh_path(t.spark, "bm25")
    B.stored_index(t.documents, "doc_id", "text", path)
    return B.bm25_topk(bench_queries(t), B.read_index(t.spark, path), 15)


@check("f8_bm25_topk", INDEX + "SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 45")
def f8(t):
    return bm25_hits(t, 45)


@check("f9_post_filter", f"""
WITH r AS ({ASKED}), i AS {{items}}, ok AS (SELECT r.query_id, i.item_id AS doc_id FROM r, i WHERE {eligible('r', 'i')}), {bm25_ctes(DOCS, BENCH)}
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY was) AS rank
FROM (SELECT query_id, doc_id, score, rank AS was FROM bm WHERE rank <= 45 AND (query_id, doc_id) IN (SELECT query_id, doc_id FROM ok)) AS x
QUALIFY rank <= 15""")
def f9(t):
    hits = bm25_hits(t, 45)
    fit = M.eligible_hits(hits.withColumn("item_id", F.col("doc_id")), asked(t), t.items)
    return B.post_filter(hits, fit, 15)


RRF = f"""
WITH {bm25_ctes(DOCS, BENCH)}, {DENSE},
  u AS (SELECT query_id, doc_id, rank AS dr, NULL AS sr FROM dn WHERE rank <= 15 UNION ALL SELECT query_id, doc_id, NULL, rank FROM bm WHERE rank <= 15),
  fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + coalesce(dr, sr))), 9) AS score, min(dr) AS dense_rank, min(sr) AS sparse_rank FROM u GROUP BY 1, 2),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) AS rank FROM fu)"""


@check("f10_rrf", RRF + " SELECT * FROM rk")
def f10(t):
    return U.rrf(dense_hits(t, 15), bm25_hits(t, 15))


@check("f10_rrf_equal_texts", f"""
WITH {bm25_ctes(DOCS, BENCH)}, low AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY query_id, text) AS lo, query_id, rank
    FROM bm JOIN corpus USING (doc_id) WHERE rank <= 45),
  fu AS (SELECT query_id, lo AS doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS sparse_rank FROM low GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(NULL AS INT) AS dense_rank, sparse_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sparse_rank, doc_id) AS rank FROM fu""")
def f10_equal(t):
    merged = U.merge_equal_texts(bm25_hits(t, 45), t.documents)
    return U.rrf(merged.limit(0), merged)


@check("f10_rrf_equal_texts_of_both", f"""
WITH {bm25_ctes(DOCS, BENCH)}, {DENSE},
  hits AS (SELECT query_id, doc_id, rank AS dr, NULL AS sr FROM dn WHERE rank <= 15 UNION ALL SELECT query_id, doc_id, NULL, rank FROM bm WHERE rank <= 45),
  low AS (SELECT query_id, dr, sr, min(doc_id) OVER (PARTITION BY query_id, text) AS doc_id FROM (SELECT * FROM hits JOIN corpus USING (doc_id)) AS h),
  fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + coalesce(dr, sr))), 9) AS score, min(dr) AS dense_rank, min(sr) AS sparse_rank FROM low GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) AS rank FROM fu""")
def f10_equal_of_both(t):
    return U.rrf(*U.merge_equal_texts_of(dense_hits(t, 15), bm25_hits(t, 45), t.documents))


@check("f11_cap", RRF + " SELECT query_id, doc_id, rank FROM rk WHERE rank <= 15")
def f11(t):
    return U.cap(U.rrf(dense_hits(t, 15), bm25_hits(t, 15))).select("query_id", "doc_id", "rank")


def jaccard(a: str, b: str) -> str:
    wa, wb = (f"list_distinct({words(f'lower({x})')})" for x in (a, b))
    inter = f"len(list_intersect({wa}, {wb}))"
    return f"CASE WHEN len({wa}) + len({wb}) > 0 THEN {inter} / (len({wa}) + len({wb}) - {inter}) ELSE 0.0 END"


SCORED = f"""
WITH {bm25_ctes(DOCS, BENCH)}, sc AS (SELECT h.query_id, h.doc_id, round(CAST({jaccard('query', 'text')} AS DOUBLE), 12) AS rerank_score
    FROM bm AS h JOIN queries USING (query_id) JOIN corpus USING (doc_id) WHERE rank <= 15)"""


def scored(t):
    hits = bm25_hits(t, 15)
    pairs = hits.join(bench_queries(t), "query_id").join(X.wanted(t.documents.select("doc_id", "text"), hits, "doc_id"), "doc_id")
    return U.rerank(pairs, U.blended_scorer("query", "text"))


@check("f12_rerank", SCORED + " SELECT query_id, doc_id, rerank_score FROM sc")
def f12(t):
    return scored(t).select("query_id", "doc_id", "rerank_score")


@check("f13_threshold_topk", SCORED + """ SELECT query_id, doc_id, rerank_score,
  row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rank FROM sc WHERE rerank_score >= 0.05 QUALIFY rank <= 5""")
def f13(t):
    return U.threshold_topk(scored(t)).select("query_id", "doc_id", "rerank_score", "rank")


HITS = f"""
WITH {bm25_ctes(DOCS, BENCH)}, i AS {{items}},
  hits AS (SELECT query_id, rank, score AS rerank_score, i.* FROM bm JOIN i ON i.item_id = bm.doc_id WHERE rank <= 5)"""


def item_hits(t):
    """Hits with their items: documents are cut to the hits before they meet the labels, so other texts are not moved."""
    hits = bm25_hits(t, 5).withColumnRenamed("score", "rerank_score").withColumnRenamed("doc_id", "item_id")
    documents = X.wanted(t.documents, hits.withColumnRenamed("item_id", "doc_id"), "doc_id")
    return hits.join(t.replaced(documents=documents).items, "item_id")


def stored_hits(t):
    """Hits as a table: a late lookup reads its hits twice."""
    return written(item_hits(t), "hits")


@check("f14_late_enrich", HITS + """, low AS (SELECT scholarship_name, arg_min(application_process, item_id) AS ap FROM
    (SELECT scholarship_name, coalesce(application_process, '') AS application_process, item_id FROM i) AS z GROUP BY 1)
SELECT query_id, rank, h.item_id, text || chr(10) || chr(10) || '## Application Process' || chr(10) || CASE WHEN ap = '' THEN 'Process not specified.' ELSE ap END AS text
FROM hits AS h LEFT JOIN low USING (scholarship_name)""")
def f14(t):
    out = X.late_enrich(stored_hits(t), t.items, key="scholarship_name")
    return out.select("query_id", "rank", "item_id", "text")


MATCH = f"""
WITH r AS ({ASKED}), i AS {{items}},
  ch AS (SELECT doc_id, text, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
  asked AS (SELECT r.*, e.embedding FROM r LEFT JOIN embeddings AS e ON e.vec_id = r.query_id),
  ok AS (SELECT r.query_id, i.item_id FROM r, i WHERE {eligible('r', 'i')}),
  ds AS (SELECT a.query_id, b.doc_id, {COSINE} AS score FROM asked AS a JOIN ok ON ok.query_id = a.query_id JOIN ch AS b ON b.doc_id = ok.item_id
         WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
  dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 15),
  {bm25_ctes('SELECT doc_id, text FROM ch', 'SELECT query_id, search_query AS query FROM asked')},
  sp AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY was) AS rank
         FROM (SELECT bm.query_id, bm.doc_id, bm.rank AS was FROM bm JOIN ok ON ok.query_id = bm.query_id AND ok.item_id = bm.doc_id WHERE rank <= 45) AS z QUALIFY rank <= 15),
  u AS (SELECT query_id, doc_id, rank AS dr, NULL AS sr FROM dn UNION ALL SELECT query_id, doc_id, NULL, rank FROM sp),
  fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + coalesce(dr, sr))), 9) AS score, min(dr) AS d, min(sr) AS s FROM u GROUP BY 1, 2),
  cp AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d NULLS LAST, s NULLS LAST, doc_id) <= 15),
  sc AS (SELECT cp.query_id, cp.doc_id, ch.text, round(0.5 * coalesce(dn.score, 0.0) + 0.5 * CAST({jaccard('asked.search_query', 'ch.text')} AS DOUBLE), 12) AS rerank_score
         FROM cp JOIN asked ON asked.query_id = cp.query_id JOIN ch ON ch.doc_id = cp.doc_id LEFT JOIN dn ON dn.query_id = cp.query_id AND dn.doc_id = cp.doc_id),
  fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rank FROM sc WHERE rerank_score >= 0.05 QUALIFY rank <= 5)"""


def matched(t):
    requests = asked(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), "query_id", "left")
    chunks = t.documents.select("doc_id", "text").join(
        t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").withColumn("item_id", F.col("doc_id"))
    return M.match(requests, t.items, chunks, index_of(chunks))


@check("f15_match", MATCH + """
SELECT query_id, rank, doc_id, rerank_score, scholarship_name, i.academic_level, funding_category, fin.text || chr(10) || chr(10) || '## Application Process' || chr(10)
  || coalesce(nullif(application_process, ''), 'Process not specified.') AS text FROM fin JOIN i ON i.item_id = fin.doc_id""")
def f15(t):
    return matched(t).select("query_id", "rank", "doc_id", "rerank_score", "scholarship_name", "academic_level", "funding_category", "text")


@check("f16_hit_cards", HITS + """
SELECT query_id, rank, count(*) OVER (PARTITION BY query_id) AS total_found, scholarship_name AS title, host_country AS country, academic_level,
  funding_category AS funding_type, substr(text, 1, 200) || '...' AS description, standardized_deadline AS deadline, application_link AS url, rerank_score AS match_score FROM hits""")
def f16(t):
    return X.hit_cards(item_hits(t))


KEYS = "SELECT 'Grant%20' || CAST(doc_id AS STRING) AS key FROM {documents}"
DETAIL = ", ".join(f"coalesce({c}, '{'Not Specified' if c == 'funding_amount' else ''}') AS {c}" for c in X.DETAIL_COLUMNS[1:])


@check("f17_detail_lookup", f"""
WITH i AS (SELECT * FROM {{items}} AS z QUALIFY row_number() OVER (PARTITION BY scholarship_name ORDER BY item_id) = 1)
SELECT key, scholarship_name, {DETAIL} FROM ({KEYS}) AS k JOIN i ON i.scholarship_name = url_decode(key)""")
def f17(t):
    return X.detail_lookup(t.sql(KEYS), t.items)


@check("f17_detail_misses", f"""
SELECT key, url_decode(key) AS scholarship_name FROM ({KEYS}) AS k WHERE url_decode(key) NOT IN (SELECT scholarship_name FROM {{items}} AS i)""")
def f17_misses(t):
    return X.detail_misses(t.sql(KEYS), t.items)


@check("f18_short_details", """
WITH i AS (SELECT * FROM {items} AS z QUALIFY row_number() OVER (PARTITION BY scholarship_name ORDER BY item_id) = 1),
  k AS (SELECT 'Grant ' || CAST(doc_id AS STRING) AS scholarship_name FROM documents)
SELECT k.scholarship_name, 'Scholarship Name: ' || k.scholarship_name || chr(10) || CASE WHEN i.item_id IS NULL THEN 'Details not found.'
  ELSE 'Application Process/Details: ' || coalesce(application_process, 'None') END AS details FROM k LEFT JOIN i ON i.scholarship_name = k.scholarship_name""")
def f18(t):
    keys = t.sql("SELECT 'Grant ' || CAST(doc_id AS STRING) AS scholarship_name FROM {documents}")
    return X.short_details(keys, t.items)

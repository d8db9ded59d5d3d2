"""Hybrid matching for a whole table of requests: filter, two searches, fusion, scoring, late lookup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K
from ..operators.dense import facet_bits, knn
from ..operators.details import late_enrich
from ..operators.eligibility import (accepted_facets, detect_intents, enrich_query, is_eligible, visible_items,
                                     with_facet, with_signature)
from ..operators.fusion import blended_scorer, cap, rerank, rrf, threshold_topk
from ..operators.lexical import BlockIndex, bm25_topk, post_filter
from ..operators.profiles import SEARCH_DEFAULTS
from ..operators.ranking import broadcast_if_small
from ..session import written


def prepare_requests(requests: DataFrame, profiles: DataFrame, *, session: str = "session_id") -> DataFrame:
    """Requests with their profile, intents and enriched query text. A request without a profile gets the default one."""
    joined = requests.join(profiles.withColumn("_known", F.lit(True)), session, "left")
    filled = {name: F.when(F.col("_known"), F.col(name)).otherwise(F.lit(value)) for name, value in SEARCH_DEFAULTS.items()
              if name in profiles.columns}
    return enrich_query(detect_intents(joined.withColumns(filled).drop("_known")))


def numbered_facets(items: DataFrame) -> DataFrame:
    """(facet, number) of the distinct combinations of attributes that visible items have; stored, so numbers hold."""
    return written(with_facet(visible_items(items)).select("facet").distinct().select(
        "facet", F.monotonically_increasing_id().alias("number")), "facets")


def request_facets(requests: DataFrame, items: DataFrame, numbers: DataFrame) -> DataFrame:
    """Requests with the bitmaps of the facets they accept: one bit per distinct combination of attributes."""
    accepted = accepted_facets(requests, items).join(broadcast_if_small(numbers), "facet")
    return with_signature(requests).join(facet_bits(accepted, "signature", "number"), "signature")


def eligible_hits(hits: DataFrame, requests: DataFrame, items: DataFrame) -> DataFrame:
    """The hits (query_id, item_id, …) whose item passes the filter of their request: a predicate on these rows."""
    attributes = items.select("item_id", F.col("academic_level").alias("item_level"), "eligible_nationality",
                              "funding_category", "scholarship_status")
    asked = requests.select("query_id", "nationality", F.col("academic_level").alias("profile_level"),
                            "bypass_filters", "target_funding")
    known = broadcast_if_small(hits, requests).join(attributes, "item_id").join(asked, "query_id")
    return known.filter(is_eligible("nationality", "profile_level", "bypass_filters", "target_funding")).select(*hits.columns)


def match(requests: DataFrame, items: DataFrame, chunks: DataFrame, index: BlockIndex, *, top_k: int = K.TOP_K,
          fetch_k: int = K.FETCH_K, threshold: float = K.MIN_SCORE, overfetch: int = K.OVERFETCH,
          scorer: Column | Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(query_id, rank, doc_id, item_id, rerank_score, text, …) for every request with an answer.

    ``requests``: query_id, search_query, query_vec and the filter inputs (see ``prepare_requests``);
    ``items``: one row per item with its attributes and heavy text; ``chunks``: doc_id, item_id, text,
    embedding; ``index``: BM25 over the chunks.

    * dense: exact search among the chunks of eligible items (the facet filter runs before the ranking);
    * sparse: ``overfetch`` times ``fetch_k`` BM25 hits, then the same eligibility as a predicate on those few
      rows, cut to ``fetch_k``. The cut comes before the filter, so fewer than ``fetch_k`` may remain;
    * fusion, cap, score, threshold, ``top_k``; heavy text is joined to the final hits only.
    """
    attributes = items.select(
        "item_id", "scholarship_name", "host_country", F.col("academic_level").alias("item_level"),
        "eligible_nationality", "funding_category", "funding_amount", "standardized_deadline",
        "scholarship_status", "application_link")

    numbers = numbered_facets(items)
    of_item = with_facet(visible_items(items)).select("item_id", "facet").join(broadcast_if_small(numbers), "facet")
    faceted = chunks.filter("embedding IS NOT NULL").select("doc_id", "item_id", "embedding").join(of_item, "item_id")
    dense = knn(request_facets(requests, items, numbers), faceted, fetch_k, vec_id="doc_id", facet="number",
                query_facets="facets", digits=None).withColumnRenamed("vec_id", "doc_id")

    wide = bm25_topk(requests, index, fetch_k * overfetch, text="search_query")
    # hits grow with the requests alone, so a small request table lets them meet the big tables unshuffled
    known = broadcast_if_small(wide, requests).join(chunks.select("doc_id", "item_id"), "doc_id")
    sparse = post_filter(wide, eligible_hits(known, requests, items), fetch_k).select("query_id", "doc_id", "score", "rank")

    fused = cap(rrf(dense, sparse, dense_score="cosine"), fetch_k)
    pairs = broadcast_if_small(fused.select("query_id", "doc_id", "cosine"), requests).join(
        chunks.select("doc_id", "item_id", "text"), "doc_id").join(requests.select("query_id", "search_query"), "query_id")
    scored = rerank(pairs, blended_scorer("search_query", "text", "cosine") if scorer is None else scorer)
    final = threshold_topk(scored, threshold, top_k)
    # The final hits (at most top_k rows per request) feed the late lookup twice. Writing them cuts the lineage,
    # runs a costly scorer once, and gives the lookup a table of known size.
    final = written(final, "hits")
    final = broadcast_if_small(final).join(attributes, "item_id").withColumnRenamed("item_level", "academic_level")
    return late_enrich(final, items.select("item_id", "application_process"), key="item_id", basis=requests)

"""Rank fusion, candidate caps, scoring and thresholds over (query, document) hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K
from ..functions.text import as_col, let, words
from .ranking import top_n


def rrf(dense: DataFrame, sparse: DataFrame, k: int = K.RRF_K, *, query_id: str = "query_id",
        doc_id: str = "doc_id", digits: int = 9, dense_score: str | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two hit lists (query, document, rank): score is the sum of 1 / (k + rank).

    Ties go to the better dense rank, then the better sparse rank, then the lowest id. ``dense_score`` names a
    column that carries the dense hits' own score along.
    """
    def folded(hits, name, scores=()):
        """One row per document of a list; a document that a list holds twice scores twice."""
        return hits.groupBy(query_id, doc_id).agg(
            F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias(f"{name}_share"), F.min("rank").alias(f"{name}_rank"),
            *[F.max("score").alias(s) for s in scores])

    # A full join, not a union: a union whose sides are already partitioned by query keeps that partitioning in
    # the plan, and adaptive execution may coalesce the two sides differently, which splits a query's rows.
    both = folded(dense, "dense", [dense_score] if dense_score else []).join(
        folded(sparse, "sparse"), [query_id, doc_id], "full")
    score = F.coalesce("dense_share", F.lit(0.0)) + F.coalesce("sparse_share", F.lit(0.0))
    # sums of fractions of ranks: 15 digits drop the noise of their order, never a difference
    fused = both.select(query_id, doc_id, F.round(score, 15).alias("score"), "dense_rank", "sparse_rank",
                        *([dense_score] if dense_score else []))
    ranked = top_n(fused, [query_id], [F.desc("score"), F.asc_nulls_last("dense_rank"),
                                       F.asc_nulls_last("sparse_rank"), F.asc(doc_id)])
    return ranked.withColumn("score", F.round("score", digits))


def merge_equal_texts(hits: DataFrame, texts: DataFrame, *, query_id: str = "query_id", doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Option for chunk copies: hits with the same text become the lowest id per query and keep every rank,
    so a text that a list holds twice scores twice."""
    keyed = hits.join(texts.select(doc_id, F.sha2(F.col(text), 256).alias("_h")), doc_id)
    lowest = keyed.groupBy(query_id, "_h").agg(F.min(doc_id).alias("_low"))
    return keyed.join(lowest, [query_id, "_h"]).withColumn(doc_id, F.col("_low")).drop("_h", "_low")


def merge_equal_texts_of(dense: DataFrame, sparse: DataFrame, texts: DataFrame, *, query_id: str = "query_id",
                         doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Both lists with equal texts as one id, the lowest in either list, so that the lists meet on a text."""
    cells = [query_id, doc_id, "rank", "score"]
    both = dense.select(*cells, F.lit(True).alias("_dense")).unionByName(sparse.select(*cells, F.lit(False).alias("_dense")))
    merged = merge_equal_texts(both, texts, query_id=query_id, doc_id=doc_id, text=text)
    return merged.filter("_dense").drop("_dense"), merged.filter("NOT _dense").drop("_dense")


def cap(hits: DataFrame, n: int = K.FETCH_K) -> DataFrame:
    return hits.filter(F.col("rank") <= n)


def overlap_score(a: Column | str, b: Column | str) -> Column:
    """Jaccard overlap of the lower-cased token sets; 0 for two empty texts."""
    a, b = (F.array_distinct(words(F.lower(as_col(c)))) for c in (a, b))

    def jaccard(s):
        both = F.size(F.array_intersect(s["a"], s["b"]))
        return let(both, lambda n: F.try_divide(n, F.size(s["a"]) + F.size(s["b"]) - n))

    return F.coalesce(let(F.struct(a.alias("a"), b.alias("b")), jaccard), F.lit(0.0))


def blended_scorer(query: str = "query", text: str = "text", cosine: str | None = None,
                   weight: float = 0.5) -> Column:
    """Built-in scorer: token overlap, blended with a cosine column where one is given."""
    lexical = overlap_score(query, text)
    if cosine is None:
        return lexical
    return weight * F.coalesce(F.col(cosine), F.lit(0.0)) + (1 - weight) * lexical


def rerank(pairs: DataFrame, scorer: Column | Callable[[DataFrame], Column], *, out_col: str = "rerank_score",
           digits: int = 12) -> DataFrame:
    """Score every (query, text) row; rounded far below any real difference, so that equal scores tie by id.
    The scorer is a column: native, or the caller's own pandas UDF applied to
    columns of the pairs."""
    score = scorer(pairs) if callable(scorer) and not isinstance(scorer, Column) else scorer
    return pairs.withColumn(out_col, F.round(score.cast("double"), digits))


def threshold_topk(hits: DataFrame, threshold: float = K.MIN_SCORE, k: int = K.TOP_K, *, score: str = "rerank_score",
                   query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Scores at or above the threshold, best first, at most ``k`` per query."""
    kept = hits.filter(F.col(score) >= threshold).drop("rank")
    return top_n(kept, [query_id], [F.desc(score), F.asc(doc_id)], k)

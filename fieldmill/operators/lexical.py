"""BM25 over many queries at once: an impact-ordered block index and ranked search without a scan of the corpus."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..functions import fixed as K
from ..functions.text import let, words
from ..session import written
from .ranking import broadcast_if_small, small_enough, top_n

#: Postings in a block of the stored index.
BLOCK_POSTINGS = 128
#: Text that a task inverts at once.
SEGMENT_BYTES = 16_000_000
#: Postings, or pairs of a posting and a query, that a task of a shuffle is meant to get, whatever the corpus.
TASK_ROWS = 1_000_000
#: Scores are sums of shares rounded to so many digits, so that equal documents have equal scores in whatever order
#: their terms are met. Whole parts and digits are summed apart, as longs.
DIGITS = 15
#: Terms of a query up to which the sum of their digits fits a long.
LONG_TERMS = 9_000


@dataclass(frozen=True)
class Bm25Index:
    """``docs(doc_id, terms(term, tf), dl)``, ``terms(term, df, idf)`` and one row ``stats(n_docs, avgdl, mean_idf)``."""

    docs: DataFrame
    terms: DataFrame
    stats: DataFrame


@dataclass(frozen=True)
class BlockIndex:
    """``terms(term, number, df, idf, top, head)``, ``blocks(term, block, top, doc_ids, weights)`` and ``stats``.

    The postings of a term are cut into blocks by their weight (the part of a score that does not depend on the query);
    ``top`` is the largest weight of a block or term, ``head`` the block that holds it.
    """

    terms: DataFrame
    blocks: DataFrame
    stats: DataFrame


def term_counts(tokens: Column) -> Column:
    """(term, tf) per distinct token: one sort inside the row, then the runs of equal tokens."""
    def counted(s: Column) -> Column:
        place = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(place, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("bigint").alias("tf"))))

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), counted)).otherwise(empty)


def tokenised(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, terms, dl): whitespace tokens, case kept, counted inside the row; dl is null for a null text."""
    tokens = df.select(F.col(doc_id).alias("doc_id"), words(text).alias("tokens"))
    size = F.when(F.col("tokens").isNotNull(), F.size("tokens"))
    return tokens.select("doc_id", term_counts(F.col("tokens")).alias("terms"), size.alias("dl"))


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of documents that ``tokenised`` has counted. No shuffle."""
    return docs.select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.term", "t.tf")


def with_idf(counts: DataFrame, n_docs: Column, epsilon: float) -> tuple[DataFrame, Column]:
    """Term counts with their idf, and the mean idf. A negative idf (a term in more than half of the documents) becomes
    ``epsilon`` times the mean idf over all terms."""
    raw = counts.withColumn("raw_idf", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean_idf = raw.agg(F.avg("raw_idf")).scalar()
    idf = F.when(F.col("raw_idf") < 0, F.lit(epsilon) * mean_idf).otherwise(F.col("raw_idf"))
    return raw.withColumn("idf", idf).drop("raw_idf"), mean_idf


def index_tables(docs: DataFrame, epsilon: float = K.BM25_EPSILON) -> Bm25Index:
    """Term table and statistics of counted documents. Frequent terms are safe: df is a count with a map-side combine."""
    # scalar subqueries: single aggregate rows, computed once and used as literals
    size = docs.agg(F.struct(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).alias("size")).scalar()
    counts = docs.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms, mean_idf = with_idf(counts, size["n_docs"], epsilon)
    stats = docs.sparkSession.range(1).select(
        size["n_docs"].alias("n_docs"), size["avgdl"].alias("avgdl"), mean_idf.alias("mean_idf"))
    return Bm25Index(docs, terms.select("term", "df", "idf"), stats)


def bm25_index(df: DataFrame, doc_id: str, text: str, epsilon: float = K.BM25_EPSILON) -> Bm25Index:
    """Index tables as a lazy plan. Every use reads the text again; searches use ``stored_index``."""
    return index_tables(tokenised(df, doc_id, text), epsilon)


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, term, qtf): a repeated query term counts again."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode_outer(words(text)).alias("term")).filter(
        "term is not null").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K.BM25_K1, b: float = K.BM25_B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def pieces(frame: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``SEGMENT_BYTES`` of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(frame.column("text")), 0).to_numpy().astype(np.int64))
    starts = np.flatnonzero(np.diff(ends // SEGMENT_BYTES, prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), frame.num_rows]):
        yield frame.slice(start, end - start)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The tokens of ``tokenised`` and the place of each one's text. Arrow and Java agree on what white space is."""
    tokens = pc.ascii_split_whitespace(texts)
    flat = tokens.flatten()
    full = pc.not_equal(flat, "")  # at the edge of a text there may be an empty one
    return pc.list_parent_indices(tokens).to_numpy()[full.to_numpy(zero_copy_only=False)], flat.filter(full)


def corpus_size(docs: DataFrame) -> Row:
    """``n_docs, n_texts, n_words`` of (doc_id, text), null texts among the documents only. A row per batch is summed."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (piece for frame in frames for piece in pieces(frame)):
            texts = piece.column("text")
            yield pa.RecordBatch.from_pylist([{"n_docs": len(texts), "n_texts": len(texts) - texts.null_count, "n_words": len(tokens_of(texts)[0])}])

    counted = docs.select("text").mapInArrow(run, "n_docs bigint, n_texts bigint, n_words bigint")
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted.columns]).first()


def in_blocks(docs: DataFrame, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(term, block, top, doc_ids, weights) of (doc_id, text): tasks invert their documents by themselves, a segment of
    about ``SEGMENT_BYTES`` at a time, and cut a term's postings there into blocks, the largest weights first. No shuffle.

    ``weigh`` makes weights of counts and document lengths. Numbers of blocks rise as ``top`` falls (in single precision,
    then a number that tells blocks of equal weight apart), so the least number of a term is that of its head.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * 0x9E3779B1
        for piece in (piece for frame in frames for piece in pieces(frame)):
            owner, tokens = tokens_of(piece.column("text"))
            coded = tokens.dictionary_encode()
            pairs, tfs = np.unique(coded.indices.to_numpy().astype(np.int64) * len(piece) + owner, return_counts=True)
            code, doc = np.divmod(pairs, len(piece))
            weights = weigh(tfs, np.bincount(owner, minlength=len(piece))[doc])
            first = np.flatnonzero(np.diff(code, prepend=-1))
            size = np.diff(first, append=len(code))
            many = np.flatnonzero(np.repeat(size > BLOCK_POSTINGS, size))  # the others are one block as they stand
            order = np.arange(len(code))
            order[many] = many[np.lexsort((-weights[many], code[many]))]
            weights, doc = weights[order], doc[order]
            starts = np.flatnonzero((np.arange(len(code)) - np.repeat(first, size)) % BLOCK_POSTINGS == 0)
            if not len(starts):
                continue
            top = np.maximum.reduceat(weights, starts)
            falling = 0x7FFFFFFF - top.astype(np.float32).view(np.int32).astype(np.int64)
            offsets = pa.array(np.append(starts, len(code)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(code[starts])), pa.array((falling << 32) + (number + np.arange(len(starts))) % 2 ** 32), pa.array(top),
                 pa.ListArray.from_arrays(offsets, piece.column("doc_id").take(pa.array(doc))), pa.ListArray.from_arrays(offsets, pa.array(weights))],
                ["term", "block", "top", "doc_ids", "weights"])
            number += len(starts)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"term string, block bigint, top double, doc_ids array<{id_type}>, weights array<double>")


def stored_index(df: DataFrame, doc_id: str, text: str, path: str, epsilon: float = K.BM25_EPSILON,
                 k1: float = K.BM25_K1, b: float = K.BM25_B) -> BlockIndex:
    """Build and persist the block index, then hand out the stored tables.

    The text is read twice: for the mean length, and to be inverted by the tasks that read it. Postings are not shuffled
    or sorted as a whole; a hot term lies in the blocks of many tasks, and a task holds one segment, whatever the corpus.
    Terms are counted on the blocks.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = corpus_size(docs)
    mean = size["n_words"] / size["n_texts"] if size["n_texts"] else None
    in_blocks(docs, lambda tfs, lengths: bm25_weight(tfs, lengths, mean, k1, b)).write.mode("overwrite").parquet(f"{path}/blocks")
    counts = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(
        F.sum(F.size("doc_ids")).alias("df"), F.max("top").alias("top"), F.min("block").alias("head"))
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    terms, mean_idf = with_idf(spark.read.parquet(f"{path}/counts"), F.lit(size["n_docs"]), epsilon)
    terms.select("term", F.monotonically_increasing_id().alias("number"), "df", "idf", "top", "head").write.mode("overwrite").parquet(f"{path}/terms")
    spark.range(1).select(F.lit(size["n_docs"]).alias("n_docs"), F.lit(mean).cast("double").alias("avgdl"), mean_idf.alias("mean_idf")).write.mode(
        "overwrite").parquet(f"{path}/stats")
    return read_index(spark, path)


def tasks(rows: int | None) -> int:
    return max(1, math.ceil((rows or 0) / TASK_ROWS))


def read_index(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("terms", "blocks", "stats")))


def met_postings(weighted: DataFrame, index: BlockIndex, pairs: int) -> DataFrame:
    """(query_id, doc_id, share): what every posting of a query's terms adds to the score of its document.

    Few queries go to the postings: each posting of an asked term is shuffled once, by its document, whatever the
    number of queries that ask for it, and all rows of a document are then in one task. Many queries meet the blocks.
    """
    posting = F.explode(F.arrays_zip("doc_ids", "weights")).alias("p")
    if not small_enough(weighted):
        met = weighted.select("query_id", "term", "w").join(index.blocks, "term").select("query_id", "w", posting)
        met = met.select("query_id", "w", F.col("p.doc_ids").alias("doc_id"), F.col("p.weights").alias("weight"))
        return met.repartition(tasks(pairs), "doc_id").select("query_id", "doc_id", (F.col("w") * F.col("weight")).alias("share"))
    known = F.broadcast(weighted.select("term", "number").distinct())  # the number stands for its term from here on
    held = index.blocks.join(known, "term").select("number", posting).select(
        "number", F.col("p.doc_ids").alias("doc_id"), F.col("p.weights").alias("weight"))
    met = held.repartition(tasks(pairs), "doc_id").join(F.broadcast(weighted.select("query_id", "number", "w")), "number")
    return met.select("query_id", "doc_id", (F.col("w") * F.col("weight")).alias("share"))


def bm25_topk(queries: DataFrame, index: BlockIndex, k: int, *, query_id: str = "query_id", text: str = "query",
              digits: int | None = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` documents per query; zero scores are left out.

    1. The first block of every term of a query gives some documents a part of their score. The k-th best part is a
       score that the k-th document reaches at least (``least``), whatever the data.
    2. The postings of the asked terms are dealt out by document and meet the queries there, so the scores of a document
       are summed where its postings lie. Those below ``least`` go no further.

    The corpus is not read, the work is one sum per pair of a posting and a query that asks for its term, and the number
    of tasks follows these pairs, so the memory of one task does not. Ranks follow the full score; ``digits`` rounds the
    output. The hits are stored.
    """
    terms = query_terms(queries, query_id, text).join(index.terms, "term")
    weighted = written(terms.select("query_id", "term", "number", "head", "df", "top", (F.col("qtf") * F.col("idf")).alias("w"))
                       .filter("w <> 0"), "query-terms")
    sizes = weighted.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("df").alias("df")).agg(F.max("n").alias("n"), F.sum("df").alias("df")).first()

    # negative weights (a corpus whose mean idf is negative) count in full against the parts
    heads = broadcast_if_small(weighted.filter("w > 0").select("query_id", "term", "w", F.col("head").alias("block")), weighted).join(
        index.blocks.drop("top"), ["term", "block"]).select("query_id", "w", F.explode(F.arrays_zip("doc_ids", "weights")).alias("p"))
    parts = top_n(heads.groupBy("query_id", F.col("p.doc_ids").alias("doc_id")).agg(F.sum(F.col("w") * F.col("p.weights")).alias("part")),
                  ["query_id"], [F.desc("part"), F.asc("doc_id")], k).filter(F.col("rank") == k)
    worst = weighted.groupBy("query_id").agg(F.sum(F.least(F.col("w") * F.col("top"), F.lit(0.0))).alias("worst"))
    least = parts.join(worst, "query_id").select("query_id", (F.col("part") + F.col("worst")).alias("least"))
    least = written(least.select("query_id", (F.col("least") - F.abs("least") * 1e-9 - 1e-12).alias("least")), "least")  # allows for rounding

    whole = F.floor("share")
    rest = F.rint((F.col("share") - whole) * 10.0 ** DIGITS).cast("bigint" if (sizes["n"] or 0) <= LONG_TERMS else "decimal(16,0)")
    sums = met_postings(weighted, index, sizes["df"]).groupBy("query_id", "doc_id").agg(F.sum(whole).alias("whole"), F.sum(rest).alias("rest"))
    about = F.col("whole") + F.col("rest").cast("double") / 10.0 ** DIGITS
    open_docs = sums.join(broadcast_if_small(least, weighted), "query_id", "left").filter(F.col("least").isNull() | (about >= F.col("least")))
    score = F.expr(f"CAST(whole AS DECIMAL(28, {DIGITS})) + CAST(rest AS DECIMAL(21, 0)) * CAST(1e-{DIGITS} AS DECIMAL({DIGITS}, {DIGITS}))")
    exact = open_docs.select("query_id", "doc_id", score.alias("score"))
    ranked = written(top_n(exact.filter("score <> 0"), ["query_id"], [F.desc("score"), F.asc("doc_id")], k), "candidates")
    score = F.col("score").cast("double")
    return ranked.select("query_id", "doc_id", (score if digits is None else F.round(score, digits)).alias("score"), "rank")


def post_filter(hits: DataFrame, allowed: DataFrame, k: int, *, query_id: str = "query_id",
                doc_id: str = "doc_id") -> DataFrame:
    """Keep hits whose (query, document) is allowed and rank again up to ``k``, in the order of their ranks."""
    kept = hits.join(allowed.select(query_id, doc_id), [query_id, doc_id], "left_semi").withColumnRenamed("rank", "_was")
    return top_n(kept, [query_id], [F.asc("_was")], k).drop("_was")

"""Nearest neighbours by randomly rotated one-bit codes.

The index holds a row per vector: the signs of its rotated offset from a centre, packed to one bit a dimension, its
distance from the centre, a correction scalar (the product of the offset's direction and its code's direction) and the
vector itself. A query is rotated the same way. The product of its direction with a code's, divided by the correction,
is an unbiased estimate of the product of the directions; its error is at most ``sqrt((1 - s^2) / s^2 / (d - 1))`` times
a normal-like variable, ``s`` being the correction. ``ERROR_BOUND`` of these make a bound that fails for about one pair
in a thousand, and rarely for one that matters. A vector is reranked on its exact distance unless the lower bound of its
distance is beyond the k-th exact one that its task knows so far.

All rows are indexed and every query meets all codes. Queries come in blocks of ``QUERY_BLOCK`` rows, each broadcast to
the tasks that scan the index where it lies: no row of the index is moved or copied, and a task returns k rows a query.
What reaches the driver is one block of queries at a time and the sample of ``SAMPLE_ROWS`` vectors whose mean is the
centre (any centre is right; a good one makes the bounds tight).

Cases: vectors that are null, zero, or hold null or non-finite entries, or have no entry or another length than most (of
lengths that tie the greater counts), and rows without an id take no part. Repeated rows of one id: as a candidate its
nearest row counts, once; as a query its least vector. Ties go to the smaller id. Fewer candidates than k: all of them.
Distances beyond the range of doubles are infinite. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import stored

NEIGHBOURS = 10
ERROR_BOUND = 3.0
SAMPLE_ROWS = 8_192
QUERY_BLOCK = 16_384
#: Queries and codes that meet at once in a task.
QUERY_TILE, CODE_TILE = 256, 4_096

CODE_SCHEMA = "vec_id long, code binary, distance double, correction double"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part; entries keep their type."""
    finite = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))  # NaN is above all numbers
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0)).filter(finite & F.exists("vector", lambda c: c != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), F.desc("size")).limit(1).collect()
    return rows.filter(F.size("vector") == (usual[0]["size"] if usual else 0))


def matrix(vectors: list) -> np.ndarray:
    """Vectors as the rows of a matrix in double precision."""
    return np.array(vectors).astype(np.float64)


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same for one dimension and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, distances from the centre, corrections) of the rows of ``x``."""
    with np.errstate(over="ignore", invalid="ignore"):
        off = x - centre
        far = np.abs(off).max(1, initial=0.0)
        scaled = off / np.where(far > 0, far, 1.0)[:, None]  # keeps squares within range
        size = np.sqrt((scaled * scaled).sum(1))
        turned = scaled @ turn
        correction = np.abs(turned).sum(1) / np.sqrt(x.shape[1]) / np.where(size > 0, size, 1.0)
        return np.packbits(turned >= 0, axis=1), far * size, np.where(size > 0, correction, 1.0)


def build_index(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id",
                sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, np.ndarray]:
    """The stored index of every usable row, without a shuffle, and its centre (empty if there are no rows)."""
    rows = usable(vectors, vec_col, id_col)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toPandas()["vector"].tolist()
    centre = np.mean(matrix(sample), 0) if sample else np.zeros(0)
    centre = np.where(np.isfinite(centre), centre, 0.0)
    turn = rotation(len(centre)) if sample else np.zeros((0, 0))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), CODE_TILE):
                part = frame.iloc[at:at + CODE_TILE]
                x = matrix(part["vector"].tolist())
                code, distance, correction = encode(x, centre, turn)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "code": [c.tobytes() for c in code], "distance": distance,
                                    "correction": correction, "vector": part["vector"].to_numpy()})

    schema = f"{CODE_SCHEMA}, vector {rows.schema['vector'].dataType.simpleString()}"
    return stored(rows.mapInPandas(run, schema), "bit-codes"), centre


def exact_distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        off = x - q
        return np.sqrt((off * off).sum(1))


class Nearest:
    """The k nearest rows that a task has met, for one query."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.bound = k, np.zeros(0, np.int64), np.zeros(0), np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        near = ~(scores > self.bound)
        ids, scores = np.concatenate([self.ids, ids[near]]), np.concatenate([self.scores, scores[near]])
        order = np.lexsort((ids, scores))
        _, first = np.unique(ids[order], return_index=True)  # the nearest row of each id
        order = order[np.sort(first)][:self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.bound = self.scores[-1]


def lower_bounds(tile: dict, code_signs: np.ndarray, distance: np.ndarray, correction: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, lower bounds) of the distances of a tile of queries (rows) to a tile of codes (columns)."""
    d = code_signs.shape[1]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        seen = (2.0 * (tile["unit"] @ code_signs.T) - tile["unit"].sum(1)[:, None]) / np.sqrt(d)
        product = seen / correction
        slack = bound * np.sqrt(np.maximum(1.0 - correction ** 2, 0.0)) / correction / np.sqrt(max(d - 1, 1))
        a, b = distance[None, :], tile["distance"][:, None]
        apart, twice = (a - b) ** 2, 2.0 * a * b
        guess = np.sqrt(np.maximum(apart + twice * (1.0 - np.minimum(product, 1.0)), 0.0))
        least = np.sqrt(np.maximum(apart + twice * (1.0 - np.minimum(product + slack, 1.0)), 0.0))
        return guess, least * (1.0 - 1e-9) - 1e-9 * (a + b)  # allows for rounding


def search_block(index: DataFrame, centre: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, bound: float) -> DataFrame:
    """The k nearest rows per query and task: one scan of the index, a bounded block of queries in every task."""
    d = len(centre)
    shared = index.sparkSession.sparkContext.broadcast((ids, queries, centre))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries, centre = shared.value
        turn = rotation(d)
        tiles = []
        for at in range(0, len(ids), QUERY_TILE):
            off = queries[at:at + QUERY_TILE] - centre
            far = np.abs(off).max(1, initial=0.0)
            scaled = off / np.where(far > 0, far, 1.0)[:, None]
            size = np.sqrt((scaled * scaled).sum(1))
            tiles.append({"at": at, "unit": (scaled / np.where(size > 0, size, 1.0)[:, None]) @ turn, "distance": far * size})
        found = [Nearest(k) for _ in ids]
        for frame in frames:
            for start in range(0, len(frame), CODE_TILE):
                part = frame.iloc[start:start + CODE_TILE]
                own, vectors = part["vec_id"].to_numpy(np.int64), matrix(part["vector"].tolist())
                packed = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                signs = np.unpackbits(packed, axis=1, count=d).astype(np.float64)
                distance, correction = part["distance"].to_numpy(), part["correction"].to_numpy()
                for tile in tiles:
                    guess, least = lower_bounds(tile, signs, distance, correction, bound)
                    for row in range(len(guess)):
                        number = tile["at"] + row
                        best, query = found[number], queries[number]
                        other = own != ids[number]
                        if best.bound == np.inf or (guess[row] < best.bound).any():
                            # the likely nearest first, so that the bound is tight for the rest
                            likely = np.argpartition(guess[row], min(2 * k, len(part) - 1))[:2 * k]
                            likely = likely[other[likely]]
                            best.add(own[likely], exact_distance(vectors[likely], query))
                        open_rows = np.flatnonzero(other & ~(least[row] > best.bound))  # keeps what can't be compared
                        if len(open_rows):
                            best.add(own[open_rows], exact_distance(vectors[open_rows], query))
        for number, best in enumerate(found):
            if len(best.ids):
                yield pd.DataFrame({"query_id": ids[number], "vec_id": best.ids, "score": best.scores})

    return index.mapInPandas(run, FOUND_SCHEMA)


def nearest(index: DataFrame, centre: np.ndarray, queries: DataFrame, k: int = NEIGHBOURS, bound: float = ERROR_BOUND,
            block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for ``queries`` with ``vec_id`` and ``vector``, all rows of the index but a
    query's own being candidates."""
    spark: SparkSession = index.sparkSession
    single = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    dealt = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, -(-queries.count() // block))))
    single = stored(single.withColumn("block", dealt.cast("int")), "queries")
    parts = []
    for number in sorted(r["block"] for r in single.select("block").distinct().collect()):
        held = single.filter(F.col("block") == number).toPandas()
        part = search_block(index, centre, held["vec_id"].to_numpy(np.int64), matrix(held["vector"].tolist()), k, bound)
        parts.append(stored(best_rows(part, k), "nearest"))
    out = parts[0] if parts else spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "score")


def best_rows(found: DataFrame, k: int) -> DataFrame:
    """The k nearest per query out of the rows of all tasks; an id counts with its nearest row."""
    single = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return single.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, chosen, k: int = NEIGHBOURS, vec_col: str = "embedding", id_col: str = "vec_id",
           bound: float = ERROR_BOUND, block: int = QUERY_BLOCK) -> DataFrame:
    """Index every row and search with the rows for which ``chosen`` (a condition on ``vec_id``) holds."""
    index, centre = build_index(vectors, vec_col, id_col)
    return nearest(index, centre, index.filter(chosen).select("vec_id", "vector"), k, bound, block)

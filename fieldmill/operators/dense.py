"""Exact nearest neighbours over vector columns, many queries at once, in cells with a bound on their cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import dot, norm
from ..session import written
from .ranking import top_n

#: Rows that a cell is meant to hold, cells at most, and the sample that their centroids are fitted on.
CELL_ROWS, MAX_CELLS, SAMPLE_ROWS, FIT_ROUNDS = 4_096, 512, 8_192, 8
#: Bounds on the vectors in a part of a cell and on the queries that meet a part at once.
PART_ROWS, BLOCK_QUERIES = 4_096, 256
#: Parts are dealt into so many bundles, or more where a bundle would hold more than so many vectors, and queries into so
#: many groups at most: a query is shuffled once per bundle that it visits and a vector once per group.
BUNDLES, BUNDLE_ROWS, GROUPS = 16, 131_072, 8
#: Vectors that a block of queries meets at once, so that the products stay in a core's cache; numbers in the vectors that
#: are scored exactly at once; hits that are held before the best of them are taken.
TILE_ROWS, EXACT_NUMBERS, HELD_HITS = 512, 1 << 20, 250_000
#: What a row of a block is, in the order in which they come: vectors, a filter, a query.
PACK, FILTER, QUERY = 0, 1, 2
#: Bounds are taken with this allowance; ranks come from exact scores.
SLACK, ANGLE_SLACK = 1e-9, 1e-7


def unit_rows(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def stacked(lists: pa.ListArray) -> np.ndarray:
    """The vectors of an Arrow column, a row each: single precision as it is, all else as doubles."""
    flat = lists.flatten()
    if len(pc.unique(lists.value_lengths())) > 1:
        raise ValueError("vectors differ in length")
    flat = flat if pa.types.is_float32(flat.type) else flat.cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def as_bytes(rows: np.ndarray) -> pa.BinaryArray:
    """A binary value per row: Spark moves it whole, an array number by number."""
    return pa.array([row.tobytes() for row in rows], pa.binary())


def from_bytes(values: pa.BinaryArray, number: str) -> np.ndarray:
    if len(pc.unique(pc.binary_length(values))) > 1:
        raise ValueError("vectors differ in length")
    return np.frombuffer(b"".join(values.to_pylist()), number).reshape(len(values), -1)


def number_of(vectors: DataFrame) -> str:
    return "float32" if vectors.schema["vec"].dataType.simpleString() == "array<float>" else "float64"


def true_at(flags: np.ndarray) -> np.ndarray:
    """``flatnonzero`` for few hits among many: eight flags are looked at together."""
    flat = flags.ravel()
    whole = len(flat) // 8 * 8
    near = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])


def fit_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids by spherical k-means on a bounded sample. Any centroids give exact results; good ones prune."""
    unit = unit_rows(sample)
    centroids = unit[np.random.default_rng(5).permutation(len(unit))[:cells]]
    for _ in range(FIT_ROUNDS if cells > 1 else 1):
        own = np.argmax(unit @ centroids.T, axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, unit)
        moved = unit_rows(total)
        centroids = np.where(np.abs(moved).sum(1, keepdims=True) > 0, moved, centroids)
    return centroids


def angles(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centroids.T, -1.0, 1.0))


def facet_bits(pairs: DataFrame, key: str, number: str) -> DataFrame:
    """``(key, facets)``: the facet numbers (0 and up) of each key as bitmaps of 32,768 numbers each, by bucket.

    Aggregated map-side; a key holds one bit for a facet instead of its name.
    """
    n = F.col(number) + 1
    bits = pairs.groupBy(key, F.bitmap_bucket_number(n).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))
    return bits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("facets"))


def allowed(numbers: np.ndarray, facets) -> np.ndarray:
    """Which facet numbers (negative: none) the bitmaps hold."""
    out = np.zeros(len(numbers), bool)
    for entry in [] if facets is None else facets:
        here = np.flatnonzero((numbers >= 0) & (numbers // 32_768 + 1 == entry["bucket"]))
        flags = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), bitorder="little")
        out[here] = flags[numbers[here] % 32_768] == 1
    return out


def in_cells(vectors: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    """(vec_id, vec, facet, cell, angle): every vector in the cell of its nearest centroid. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                vec = stacked(part["vec"])
                apart = angles(unit_rows(vec.astype(np.float64)), centroids)
                cell = apart.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part["vec_id"], as_bytes(vec), part["facet"], pa.array(cell, pa.int32()),
                                                  pa.array(apart[np.arange(len(cell)), cell])], names=["vec_id", "vec", "facet", "cell", "angle"])

    return vectors.mapInArrow(run, f"vec_id {id_type}, vec binary, facet bigint, cell int, angle double")


def packed(cells: DataFrame, sizes: Column, id_type: str) -> DataFrame:
    """(cell, part, ids, facets, vectors): large cells dealt into parts of a bounded size, a row per part."""
    def run(table: pa.Table) -> pa.Table:
        ids = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.concat_arrays(table["vec_id"].chunks))
        return pa.table({"cell": table["cell"][:1], "part": table["part"][:1], "ids": ids, "facets": [table["facet"].to_numpy().tobytes()],
                         "vectors": [b"".join(table["vec"].to_pylist())]})

    part = F.pmod(F.xxhash64("vec_id"), F.element_at(sizes, F.col("cell") + 1)).cast("int")
    return cells.withColumn("part", part).groupBy("cell", "part").applyInArrow(
        run, f"cell int, part int, ids array<{id_type}>, facets binary, vectors binary")


class Bundle:
    """The vectors that a task holds, and which of them the filter in force accepts."""

    def __init__(self, packs: list[pa.RecordBatch], number: str):
        lists = [list_ for x in packs for list_ in x["ids"]]
        self.ids = pa.concat_arrays([x.values for x in lists])
        self.tie = pc.rank(self.ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        self.facets = np.frombuffer(b"".join(v for x in packs for v in x["facets"].to_pylist()), np.int64)
        parts = (v for x in packs for v in x["vectors"].to_pylist())
        self.vectors = np.concatenate([np.frombuffer(v, number).reshape(len(list_), -1) for v, list_ in zip(parts, lists)])
        self.sizes, self.unit = np.empty(len(self.ids)), np.empty(self.vectors.shape, np.float32)
        for at in range(0, len(self.ids), PART_ROWS):
            rows = self.vectors[at:at + PART_ROWS].astype(np.float64)
            self.sizes[at:at + PART_ROWS], self.unit[at:at + PART_ROWS] = np.sqrt((rows * rows).sum(1)), unit_rows(rows)
        ends = np.cumsum([0, *map(len, lists)])
        places = [place for x in packs for place in x["place"].to_pylist()]
        self.spans = [*zip(places, ends[:-1].tolist(), ends[1:].tolist())]
        self.tiles = [tile for place, a, b in self.spans for tile in self.cut_up(place, np.arange(a, b), self.unit[a:b])]
        # any order of summing n products of unit vectors in single precision is off by less than n + 3 halves of an ulp of 1
        self.slack = (self.vectors.shape[1] + 8) * 2.0 ** -23

    @staticmethod
    def cut_up(place: int, at: np.ndarray, unit: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        many = math.ceil(len(at) / TILE_ROWS)
        return [(place, *pair) for pair in zip(np.array_split(at, many), np.array_split(unit, many))] if many else []

    def accept(self, facets) -> None:
        self.tiles = []
        for place, a, b in self.spans:
            at = a + np.flatnonzero(allowed(self.facets[a:b], facets))
            self.tiles.extend(self.cut_up(place, at, self.unit[at]))

    def best(self, queries: pa.StructArray, k: int, number: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score): rows of the ``k`` best of the parts that each query visits, by the exact score.

        One matrix product in single precision finds what may be among them; those are scored row by row in double
        precision, so equal vectors score alike. A query's k-th best so far is the least that the next part must reach.
        """
        q = from_bytes(queries.field("q"), number).astype(np.float64)
        sizes, unit = np.sqrt((q * q).sum(1)), unit_rows(q).astype(np.float32)
        floor = queries.field("least").fill_null(-np.inf).to_numpy(zero_copy_only=False).copy()
        visited = np.unpackbits(from_bytes(queries.field("places"), "uint8"), axis=1) == 1
        held, hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        products, flags = np.empty(BLOCK_QUERIES * TILE_ROWS, np.float32), np.empty(BLOCK_QUERIES * TILE_ROWS, bool)

        def cut() -> None:
            nonlocal hits
            who, at, score = map(np.concatenate, zip(*held))
            order = np.lexsort((self.tie[at], -score, who))  # ties go to the lowest id
            who, at, score = who[order], at[order], score[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            floor[who[rank == k - 1]] = score[rank == k - 1]
            held[:], hits = [(who[rank < k], at[rank < k], score[rank < k])], 0

        for place, rows, tile in self.tiles:
            asked = np.flatnonzero(visited[:, place])
            bars = floor - self.slack
            for start in range(0, len(asked), BLOCK_QUERIES):
                block = asked[start:start + BLOCK_QUERIES]
                shape, size = (len(block), len(rows)), len(block) * len(rows)
                near = np.matmul(unit[block], tile.T, out=products[:size].reshape(shape))
                bar = bars[block]
                bare = np.flatnonzero(bar == -np.inf)
                if len(bare) and len(rows) > k:
                    bar[bare] = np.partition(near[bare], len(rows) - k, axis=1)[:, len(rows) - k] - 2 * self.slack
                some = true_at(np.greater_equal(near, bar.astype(np.float32)[:, None], out=flags[:size].reshape(shape)))
                step = max(1, EXACT_NUMBERS // q.shape[1])
                for first in range(0, len(some), step):
                    line, column = np.divmod(some[first:first + step], len(rows))
                    who, at = block[line], rows[column]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        score = (self.vectors[at].astype(np.float64) * q[who]).sum(1) / (self.sizes[at] * sizes[who])
                    good = np.flatnonzero(score >= floor[who])
                    held.append((who[good], at[good], score[good]))
                    hits += len(good)
                    if hits > HELD_HITS:
                        cut()
            if hits and (bars[asked] == -np.inf).any():
                cut()
        cut()
        return held[0]


def scored(blocks: DataFrame, k: int, filtered: bool, q_number: str, v_number: str, q_type: str, v_type: str) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` best of a bundle per query of a group, by the exact score.

    Every (bundle, group) lies in one task, vectors first, then filters, each before its queries. A task holds the
    vectors of one bundle; queries stream by.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, bundle, key = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch[name].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("bundle", "group", "kind", "filter")])
            cuts = [0, *(1 + np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0))).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part, kind, here = batch.slice(a, b - a), marks[2, a], tuple(marks[:2, a])
                if here != key:
                    packs, bundle, key = [], None, here
                if kind == PACK:
                    packs.append(part)
                    continue
                if bundle is None:
                    bundle, packs = Bundle(packs, v_number), []
                if kind == FILTER:
                    bundle.accept(part["accepted"][0].as_py())
                    continue
                queries = part["queries"].flatten()
                who, at, score = bundle.best(queries, k, q_number)
                if len(who):
                    yield pa.RecordBatch.from_arrays([queries.field("query_id").take(pa.array(who)), bundle.ids.take(pa.array(at)), pa.array(score)],
                                                     names=["query_id", "vec_id", "score"])

    columns = ["bundle", "group", "kind", "filter", "place", "ids", "facets", "vectors", "queries", *(["accepted"] if filtered else [])]
    return blocks.select(*columns).mapInArrow(run, f"query_id {q_type}, vec_id {v_type}, score double")


def knn(queries: DataFrame, vectors: DataFrame, k: int, *, query_id: str = "query_id", query_vec: str = "query_vec",
        vec_id: str = "vec_id", vec: str = "embedding", facet: str | None = None, query_facets: str | None = None,
        cell_rows: int = CELL_ROWS, digits: int | None = 6) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` best cosine scores per query, exact. Ties go to the lowest id.

    Vectors lie in cells around centroids; a cell knows the widest angle between its centroid and a member, so the
    angle between a query and the centroid bounds every cosine in the cell. A query first meets its own cell, whose
    k-th best score then rules out all cells with a lower bound. Vectors lie in parts of a bounded size; large cells are
    salted. Parts are dealt into bundles and queries into groups: a query is shuffled once per bundle that holds a part it
    visits, a part once per group. A task holds one bundle, at most about ``BUNDLE_ROWS`` vectors, and returns ``k`` rows
    per query. What reaches the driver is a sample of ``SAMPLE_ROWS`` vectors and one row per cell.

    With ``facet`` (a number column of the vectors) and ``query_facets`` (bitmaps of numbers, see ``facet_bits``)
    only vectors whose facet the query accepts take part: the filter runs before the ranking, inside the task.
    Null and zero vectors and those with a null or non-finite entry take no part. ``score`` is rounded in the output only (``digits`` None: not at all).
    """
    q_type = queries.schema[query_id].dataType.simpleString()
    v_type = vectors.schema[vec_id].dataType.simpleString()
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above all numbers
    live = finite & F.exists("vec", lambda x: x != 0)
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("vec"),
                       (F.coalesce(F.col(facet).cast("bigint"), F.lit(-1)) if facet else F.lit(-1).cast("bigint")).alias("facet")).filter(live)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("vec"),
                       (F.col(query_facets) if facet and query_facets else F.lit(None).cast("array<struct<bucket:bigint,bits:binary>>")).alias("facets")).filter(live)
    v = written(v, "vectors")
    n = v.count()
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vec").toPandas()["vec"]
    if not len(sample):
        return queries.sparkSession.createDataFrame([], f"query_id {q_type}, vec_id {v_type}, score double, rank int")
    centroids = fit_centroids(matrix(sample), max(1, min(MAX_CELLS, math.ceil(n / cell_rows), len(sample))))
    cells = written(in_cells(v, centroids, v_type), "cells")
    known = {r["cell"]: (r["n"], r["wide"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("wide")).collect()}
    parts = [max(1, math.ceil(known.get(c, (0, 0))[0] / PART_ROWS)) for c in range(len(centroids))]
    firsts = np.cumsum([0, *parts])
    first_of = F.element_at(F.array(*[F.lit(int(f)) for f in firsts]), F.col("cell") + 1)
    bundles = int(max(min(BUNDLES, firsts[-1]), math.ceil(n / BUNDLE_ROWS)))
    packs = packed(cells, F.array(*[F.lit(p) for p in parts]), v_type).withColumn("pack", first_of + F.col("part"))
    packs = written(packs.withColumn("bundle", F.col("pack") % bundles).withColumn("place", (F.col("pack") / bundles).cast("int")), "parts")

    live_cells = np.array(sorted(known))
    wide = np.array([known[c][1] for c in live_cells])
    cell_of = np.repeat(np.arange(len(parts)), parts)
    asked_for = written(q.withColumn("filter", F.xxhash64("facets")), "queries")
    filters = written(asked_for.groupBy("filter").agg(F.count("*").alias("n"), F.first("facets").alias("accepted")), "filters")
    groups = max(1, min(GROUPS, math.ceil(asked_for.count() / BLOCK_QUERIES)))
    # a filter goes to as many groups as its queries fill; those that fill more than one are few
    filters = filters.withColumn("spread", F.least(F.lit(groups), F.ceil(F.col("n") / BLOCK_QUERIES)).cast("int"))
    q = asked_for.drop("facets").join(F.broadcast(filters.filter("spread > 1").select("filter", "spread")), "filter", "left")
    salt = F.pmod(F.xxhash64("query_id"), F.coalesce("spread", F.lit(1)))
    q = q.withColumn("group", F.pmod(F.pmod("filter", F.lit(groups)) + salt, F.lit(groups)).cast("int")).drop("spread")
    some_groups = F.transform(F.sequence(F.lit(0), F.col("spread") - 1), lambda i: F.pmod(F.pmod("filter", F.lit(groups)) + i, F.lit(groups)).cast("int"))
    fixed = packs.select("bundle", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(None).cast("bigint").alias("filter"),
                         F.lit(PACK).alias("kind"), "place", "ids", "facets", "vectors")
    if facet:
        fixed = fixed.unionByName(filters.select("filter", "accepted", F.lit(FILTER).alias("kind"), F.explode(some_groups).alias("group")).withColumn(
            "bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))), allowMissingColumns=True)

    def visits(asked: DataFrame, home: bool) -> DataFrame:
        """Queries by the bundles to look into, with flags for the parts there: those of the nearest cell, or all others that may hold a better score."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, PART_ROWS):
                    part = batch.slice(at, PART_ROWS)
                    vec = stacked(part["vec"])
                    apart = angles(unit_rows(vec.astype(np.float64)), centroids[live_cells])
                    own = apart.argmin(axis=1)
                    may = np.zeros((len(own), len(parts)), bool)
                    if home:
                        may[np.arange(len(own)), live_cells[own]] = True
                    else:
                        bound = np.cos(np.clip(apart - wide - ANGLE_SLACK, 0.0, np.pi))
                        least = part["least"].fill_null(-np.inf).to_numpy(zero_copy_only=False)[:, None]
                        may[:, live_cells] = bound >= least - SLACK
                        may[np.arange(len(own)), live_cells[own]] = False
                    part = pa.RecordBatch.from_arrays([*(part[name] for name in names[:4]), as_bytes(vec)], names=names[:5])
                    for bundle in range(bundles):
                        flags = may[:, cell_of[bundle::bundles]]
                        some = np.flatnonzero(flags.any(axis=1))
                        if len(some):
                            yield pa.RecordBatch.from_arrays([*part.take(pa.array(some)).columns, pa.array([bundle] * len(some), pa.int32()),
                                                              as_bytes(np.packbits(flags[some], axis=1))], names=names)

        names = ["query_id", "filter", "group", "least", "q", "bundle", "places"]
        rows = asked.select("query_id", "vec", "filter", "group", "least").mapInArrow(
            run, f"query_id {q_type}, filter bigint, group int, least double, q binary, bundle int, places binary")
        return rows.select("bundle", "group", "filter", F.lit(QUERY).alias("kind"),
                           F.array(F.struct("query_id", "q", "least", "places")).alias("queries"))

    def search(asked: DataFrame, home: bool) -> DataFrame:
        met = fixed.unionByName(visits(asked, home), allowMissingColumns=True)
        # twice as many tasks as there are pairs, so that few meet in one
        met = met.repartition(2 * bundles * groups, "bundle", "group").sortWithinPartitions("bundle", "group", "filter", "kind")
        found = scored(met, k, facet is not None, number_of(q), number_of(v), q_type, v_type)
        return top_n(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)

    near = search(q.withColumn("least", F.lit(None).cast("double")), True)
    if len(live_cells) > 1:
        near = written(near, "near")
        least = near.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        far = search(q.join(least, "query_id", "left"), False)
        near = top_n(near.drop("rank").unionByName(far.drop("rank")), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    return near if digits is None else near.withColumn("score", F.round("score", digits))


def knn_among(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, *, query_id: str = "query_id",
              query_vec: str = "query_vec", vec_id: str = "vec_id", vec: str = "embedding",
              digits: int = 6) -> DataFrame:
    """Exact ranking of given candidate pairs only (query_id, vec_id): equi-joins and native arithmetic."""
    scored_pairs = (pairs.select(query_id, vec_id)
                    .join(queries.select(query_id, query_vec), query_id)
                    .join(vectors.select(vec_id, vec), vec_id))
    cosine = F.try_divide(dot(query_vec, vec), norm(query_vec) * norm(vec))
    scored_pairs = scored_pairs.select(F.col(query_id).alias("query_id"), F.col(vec_id).alias("vec_id"),
                                       cosine.alias("score")).filter("score is not null")
    ranked = top_n(scored_pairs, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    return ranked.withColumn("score", F.round("score", digits))

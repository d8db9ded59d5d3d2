"""Whitening of embeddings by the covariance of their distinct grid vectors.

Every entry ``c`` becomes the integer ``floor(STEP * c)``. Rows with the same grid vector are grouped, each distinct
vector gets a fit weight (one, or how many rows hold it), and the covariance is a weighted product of centred matrices:
a first pass sums the vectors exactly, a second one centres by the mean of these sums and multiplies, task by task, and
Spark adds the partial products up. What comes to the driver is bounded by the dimension alone: the sums (one row per
dimension) and the covariance (one row per pair of dimensions). Its eigenvectors are worked out once, so their signs are
the same for all rows. Every distinct vector is projected once and joined back to its rows by a digest; the few vectors
that a large share of the rows hold are joined from a broadcast of at most ``HOT_VECTORS`` rows, so no task of the join
holds a hot vector.

Cases: rows whose vector is null, holds a null or a non-finite entry, or an entry of ``MAX_ENTRY`` or more, or has no
entry or another length than most vectors (of lengths that tie the greater counts) take no part. Zero vectors do. A null
id stays null, repeated rows stay. A component without variance (one distinct vector, equal columns) has a null
``whitened``; ``explained`` is null where nothing varies, ``identity_error`` where no component does. Less than
``components`` dimensions give less components. ``deviation`` is exact, as a decimal. Empty table: no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import OWN, stored

STEP = 256
COMPONENTS = 4
#: Entries below this bound have grid values under 2 ** 38, whose weighted sums over a batch are exact in 64 bits.
MAX_ENTRY = float(2 ** 30)
#: Vectors that more than this share of the rows hold are joined from a broadcast; there are at most 1 / share of them.
HOT_VECTORS = 2_000
BATCH = 4_096
#: Eigenvalues below this share of the largest are rounding errors of a covariance that lacks full rank.
RANK_TOLERANCE = 1e-12

OUT_SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def grid(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``(vec_id, x)`` of the rows that take part."""
    entry = F.transform(vec_col, lambda c: c.cast("double"))
    fit = F.forall(entry, lambda c: c.isNotNull() & (F.abs(c) < MAX_ENTRY))  # neither NaN nor infinity is below a bound
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col)).filter(F.size(vec_col) > 0).filter(fit)
    sizes = rows.groupBy(F.size(vec_col).alias("size")).agg(F.count("*").alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), F.desc("size")).limit(1).collect()
    if not usual:
        return rows.select("vec_id", F.lit(None).cast("array<bigint>").alias("x")).limit(0)
    whole = F.transform(entry, lambda c: F.floor(c * STEP).cast("long"))
    return rows.filter(F.size(vec_col) == usual[0]["size"]).select("vec_id", whole.alias("x"))


def batches_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Bounded runs of rows with their vectors as one matrix."""
    for frame in frames:
        for at in range(0, len(frame), BATCH):
            part = frame.iloc[at:at + BATCH]
            yield part, np.array(part["x"].tolist(), np.int64)


def sums(distinct: DataFrame) -> tuple[int, list[int], int]:
    """Exact (total weight, weighted sum per dimension, largest absolute entry)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, total, most = 0, None, 0
        for part, x in batches_of(frames):
            w = part["weight"].to_numpy(np.int64)
            low, high = w & 0xFFF, w >> 12  # products of weight and entry stay exact: the weights by parts
            added = (low @ x).astype(object) + (high.astype(object) @ x.astype(object) * 4096 if high.any() else 0)
            weight += int(w.sum())
            total = added if total is None else total + added
            most = max(most, int(np.abs(x).max()))
        if total is not None:
            yield pd.DataFrame({"place": range(-2, len(total)), "value": [str(v) for v in (most, weight, *total)]})

    parts = distinct.select("x", "weight").mapInPandas(run, "place int, value string")
    value = F.col("value").cast("decimal(38,0)")
    rows = {r["place"]: int(r["m"] if r["place"] == -2 else r["s"]) for r in
            parts.groupBy("place").agg(F.sum(value).alias("s"), F.max(value).alias("m")).collect()}
    return rows[-1], [rows[k] for k in range(len(rows) - 2)], rows[-2]


def covariance(distinct: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Weighted covariance, divisor ``n``: centred batches multiplied within tasks, their products added by Spark."""
    mean = np.array([s / n for s in total])
    d = len(mean)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        product = np.zeros((d, d))
        for part, x in batches_of(frames):
            centred = x - mean
            product += (centred * part["weight"].to_numpy(np.float64)[:, None]).T @ centred
        for row in range(d):
            yield pd.DataFrame({"i": row, "j": np.arange(row + 1), "value": product[row, :row + 1]})

    parts = distinct.select("x", "weight").mapInPandas(run, "i int, j int, value double")
    found = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((d, d))
    out[found["i"], found["j"]] = found["value"] / n
    return np.tril(out) + np.tril(out, -1).T


def projected(distinct: DataFrame, n: int, total: list[int], most: int, axes: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Every distinct vector once: ``digest``, ``weight``, ``deviation`` and ``z``, its whitened components."""
    mean = np.array([s / n for s in total])
    small = len(total) * (n * most + max(map(abs, total))) ** 2 < 2 ** 63  # else Python's own integers
    exact = np.array(total, np.int64 if small else object)
    unit = axes / np.where(scale > 0, scale, np.nan)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in batches_of(frames):
            off = (x if small else x.astype(object)) * n - exact
            yield pd.DataFrame({"digest": part["digest"].tolist(), "weight": part["weight"].to_numpy(),
                                "deviation": [str(v) for v in (off * off).sum(1).tolist()], "z": list((x - mean) @ unit)})

    schema = "digest binary, weight long, deviation string, z array<double>"
    return distinct.select("x", "weight", "digest").mapInPandas(run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(white: DataFrame, n: int, live: list[int]) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance (divisor ``n``, centred) minus the identity."""
    if not live:
        return None
    w = F.col("weight")
    means = white.agg(*[(F.sum(w * F.col("z")[k]) / n).alias(f"m{k}") for k in live]).first()
    centred = {k: F.col("z")[k] - means[f"m{k}"] for k in live}
    pairs = [(a, b) for a in live for b in live if a <= b]
    found = white.agg(*[(F.sum(w * centred[a] * centred[b]) / n).alias(f"p{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"p{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one", vec_col: str = "embedding",
           id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, of OUT_SCHEMA. ``weights``: ``one`` or ``count`` of a distinct vector's rows."""
    spark = vectors.sparkSession
    rows = stored(grid(vectors, vec_col, id_col).select("vec_id", "x", F.unhex(F.sha2(F.array_join("x", ","), 256)).alias("digest")), "grid")
    grouped = rows.groupBy("digest", "x").agg(F.count("*").alias("copies"))
    weight = F.lit(1).cast("long") if weights == "one" else F.col("copies")
    distinct = stored(grouped.select("digest", "x", "copies", weight.alias("weight")), "distinct-vectors")
    if distinct.isEmpty():
        return spark.createDataFrame([], OUT_SCHEMA)

    n, total, most = sums(distinct)
    spread = covariance(distinct, n, total)
    values, axes = np.linalg.eigh(spread)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(spread))
    kept = np.where(values[order] > RANK_TOLERANCE * max(values.max(), 0.0), values[order], 0.0)
    white = stored(projected(distinct, n, total, most, axes[:, order], np.sqrt(kept)), "whitened")
    error = identity_error(white, n, [k for k, e in enumerate(kept) if e > 0])

    # hot vectors by a bounded broadcast, all others by a join on their digest
    n_rows = distinct.agg(F.sum("copies")).first()[0]
    hot = distinct.filter(F.col("copies") * HOT_VECTORS > n_rows).select("digest")
    own = rows.select("vec_id", "digest")
    hot_white = F.broadcast(white.join(F.broadcast(hot), "digest", "left_semi").select("digest", "deviation", "z"))
    often = own.join(hot_white, "digest")
    seldom = own.join(F.broadcast(hot), "digest", "left_anti").join(white.select("digest", "deviation", "z"), "digest")
    joined = often.unionByName(seldom)

    shares = F.array(*[F.lit(float(e) / trace if trace > 0 else None).cast("double") for e in kept])
    number = F.posexplode(F.arrays_zip(F.col("z").alias("z"), shares.alias("share"))).alias(OWN + "k", OWN + "v")
    out = joined.select("vec_id", "deviation", number)
    return out.select("vec_id", (F.col(OWN + "k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      F.nanvl(F.col(OWN + "v.z"), F.lit(None).cast("double")).alias("whitened"), F.col(OWN + "v.share").alias("explained"),
                      F.lit(error).cast("double").alias("identity_error"))

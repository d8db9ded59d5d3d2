"""Profiles of table parts that merge: sketches are stored once per part, and a report over any parts reads no rows.

A part (a day, a source, a delivery) is profiled in one aggregation with a map-side combine. Per column it keeps exact
counts, sums and extremes, a KLL sketch of its numbers (quantiles), an HLL sketch of its values (distinct ones) and the
items an approximate top-k tracks. All merge by an aggregation, so a changed part replaces its own rows only.

Errors: a quantile's rank is off by at most ``RANK_ERROR`` (KLL with k = 200, at 99 % confidence), the number of distinct
values by ``DISTINCT_ERROR`` (HLL with 2 ** 12 registers, about three standard errors). Counts of the top items are exact
while no part and no merge holds more than ``TRACKED`` distinct values, else lower bounds. The exact reports are in
``quality``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed as K

RANK_ERROR, DISTINCT_ERROR = 0.0133, 0.05
LG_REGISTERS, TRACKED = 12, 10_000

STORED = ("n_rows", "n_missing", "total", "low", "high", "quantiles", "distinct", "top")


def profile_parts(df: DataFrame, part: Column, values: Sequence[str] = (), numbers: Mapping[str, Column] | None = None,
                  nulls: Sequence[str] = K.PROFILE_NULLS) -> DataFrame:
    """One row per part and column: ``(part, column_name, *STORED)``.

    ``values`` are columns to count missing, distinct and frequent values of, as texts; ``numbers`` maps a name to an
    integer measure. A missing value is null or one of ``nulls``.
    """
    numbers = dict(numbers or {})

    def present(value):
        return F.when(~value.isin(list(nulls)), value)

    rows = df.select(part.cast("string").alias("part"), *[present(F.col(c).cast("string")).alias(f"v_{c}") for c in values],
                     *[m.cast("bigint").alias(f"n_{name}") for name, m in numbers.items()])

    def struct(n_missing, total, low, high, quantiles, distinct, top):
        return F.struct(F.count("*").alias("n_rows"), n_missing.alias("n_missing"), total.alias("total"), low.alias("low"), high.alias("high"),
                        quantiles.alias("quantiles"), distinct.alias("distinct"), top.alias("top"))

    def none(kind):
        return F.lit(None).cast(kind)

    def of_value(c):
        return struct(F.count_if(F.col(c).isNull()), none("decimal(38,0)"), none("bigint"), none("bigint"), none("binary"),
                      F.hll_sketch_agg(c, F.lit(LG_REGISTERS)), F.expr(f"approx_top_k_accumulate({c}, {TRACKED}) FILTER (WHERE {c} IS NOT NULL)"))

    def of_number(c):
        tracked = F.expr(f"approx_top_k_accumulate(CAST({c} AS STRING), {TRACKED}) FILTER (WHERE {c} IS NOT NULL)")
        return struct(F.count_if(F.col(c).isNull()), F.sum(F.col(c).cast("decimal(19,0)")).cast("decimal(38,0)"), F.min(c), F.max(c),
                      F.kll_sketch_agg_bigint(c), F.hll_sketch_agg(c, F.lit(LG_REGISTERS)), tracked)

    stats = rows.groupBy("part").agg(*[of_value(f"v_{c}").alias(f"v_{c}") for c in values],
                                     *[of_number(f"n_{name}").alias(f"n_{name}") for name in numbers])
    named = [(c, f"v_{c}") for c in values] + [(name, f"n_{name}") for name in numbers]
    each = F.array(*[F.struct(F.lit(name).alias("column_name"), F.col(c).alias("s")) for name, c in named])
    return stats.select("part", F.explode(each).alias("r")).select("part", "r.column_name", *[F.col(f"r.s.{c}").alias(c) for c in STORED])


def store_profiles(profiles: DataFrame, path: str) -> None:
    """Write the profiles of some parts; what the store holds of these parts is replaced, other parts stay."""
    profiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profiles of many parts as one per column (and per ``by``), without their rows."""
    return profiles.groupBy(*by, "column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), F.sum("total").cast("decimal(38,0)").alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_bigint("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"), F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"))


def report(profiles: DataFrame, by: Sequence[str] = (), percentiles: Sequence[float] = (0.25, 0.5, 0.75, 0.95), top: int = 5) -> DataFrame:
    """One row per column: exact counts, mean and extremes, approximate percentiles, distinct values and top items."""
    out = merged(profiles, by)
    counted = (F.col("n_rows") - F.col("n_missing")).cast("double")
    known = F.col("low").isNotNull()  # a column of values, or without any number, has an empty sketch
    points = F.when(known, F.kll_sketch_get_quantile_bigint("quantiles", F.array(*[F.lit(p) for p in percentiles])))
    return out.select(
        *by, "column_name", "n_rows", "n_missing", F.try_divide(F.col("total").cast("double"), counted).alias("mean"), "low", "high",
        *[F.get(points, F.lit(i)).alias(f"p{round(p * 100)}") for i, p in enumerate(percentiles)],
        F.hll_sketch_estimate("distinct").alias("n_distinct"), F.expr(f"approx_top_k_estimate(top, {top})").alias("top"))

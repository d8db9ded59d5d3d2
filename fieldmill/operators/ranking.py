"""Top-n per group, and the size check behind every broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_n(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], n: int | None = None,
          rank_col: str = "rank") -> DataFrame:
    """Adds a 1-based rank per group and keeps the first ``n``.

    Spark prunes ``row_number() <= n`` in every task before the shuffle (window group limit), so a group that
    holds a third of all rows sends only ``n`` rows per task. Callers give an order without ties.
    """
    ranked = df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if n is None else ranked.filter(F.col(rank_col) <= n)


BROADCAST_BASIS_BYTES = 4 * 1024 * 1024


def small_enough(basis: DataFrame, limit: int = BROADCAST_BASIS_BYTES) -> bool:
    """Whether the tables that ``basis`` reads are within the limit by Catalyst's file sizes; no job runs.

    The sum over the leaves bounds scans, filters and joins on unique keys. (A plan's own estimate multiplies
    the sizes of joined tables, which says nothing.)
    """
    if not hasattr(basis, "_jdf"):  # no plan statistics over a remote session: take the way that always works
        return False
    leaves = basis._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) <= limit


def broadcast_if_small(df: DataFrame, basis: DataFrame | None = None,
                       limit: int = BROADCAST_BASIS_BYTES) -> DataFrame:
    """Hint a broadcast only where the table that bounds ``df`` is small; otherwise Spark shuffles as usual.

    ``basis`` is the input that ``df`` grows with: the query table for query terms and for top-k hits.
    """
    return F.broadcast(df) if small_enough(df if basis is None else basis, limit) else df

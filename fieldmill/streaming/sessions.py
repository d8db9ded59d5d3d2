"""Session tables fed by streams: message append and profile change log, idempotent per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.profiles import upsert_profiles


def _write_batch(path: str, prepare: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch: a replayed batch replaces its own rows and nothing else
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def append_stream(stream: DataFrame, path: str, checkpoint: str,
                  prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append a stream of messages (or profile changes) to a log table; replays do not duplicate rows."""
    return (stream.writeStream.foreachBatch(_write_batch(path, prepare))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def current_profiles(spark: SparkSession, path: str, base: DataFrame | None = None, **kw) -> DataFrame:
    """Profiles as of the whole change log: the batch upsert over the appended log."""
    return upsert_profiles(base, read_log(spark, path), **kw)

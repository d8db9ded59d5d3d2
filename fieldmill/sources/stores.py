"""Stores and sinks: master table, item store, chunk store, reports and store checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import fixed as K
from ..functions.text import strip


def write_master(df: DataFrame, path: str, fmt: str = "json") -> None:
    """The enriched master table; JSON is written as lines, null fields included."""
    writer = df.write.mode("overwrite")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(fmt).save(path)


def item_columns(df: DataFrame, drop: Sequence[str] = K.STORE_DROPS) -> DataFrame:
    """The store projection: drops redundant columns where present."""
    return df.drop(*drop)


def write_items(df: DataFrame, path: str, drop: Sequence[str] = K.STORE_DROPS,
                partition_by: Sequence[str] = ()) -> None:
    """Replace the item store. Partition by status once it is large: retrieval always filters on it."""
    item_columns(df, drop).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def encode(df: DataFrame, encoder: Callable[[pd.Series], pd.Series], *, text_col: str = "text",
           out_col: str = "embedding") -> DataFrame:
    """Adds vectors from the caller's encoder, a batch of texts to a series of float lists.

    Batches follow ``spark.sql.execution.arrow.maxRecordsPerBatch``; the work stays in the scan's partitions.
    """
    run = F.pandas_udf(encoder, "array<float>")
    return df.withColumn(out_col, run(F.col(text_col)))


def write_chunks(chunks: DataFrame, path: str, encoder: Callable[[pd.Series], pd.Series]) -> None:
    """Encode and replace the chunk store; a second run does not append copies."""
    encode(chunks, encoder).write.mode("overwrite").parquet(path)


def content_digest(*cols: str) -> Column:
    """Digest of a chunk's content; null and empty differ."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def live_chunks(spark: SparkSession, path: str, keys: Sequence[str] = ("doc_id", "section_no", "chunk_no")) -> DataFrame:
    """The chunks of an incremental store: those added and not dropped by a later run."""
    return live_chunks_of(spark.read.parquet(path), keys)


def live_chunks_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    dropped = rows.filter("dropped").select(*keys, "digest", F.col("run").alias("_until"))
    added = rows.filter(~F.col("dropped")).alias("a")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"d.{k}")) for k in (*keys, "digest")]
    alive = added.join(dropped.alias("d"), [*same, F.col("d._until") > F.col("a.run")], "left_anti")
    return alive.drop("dropped")


def _earlier_runs(spark: SparkSession, path: str, run: int) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.parquet(path).filter(F.col("run") < run)
    return None if rows.isEmpty() else rows


def sync_history(spark: SparkSession, path: str) -> DataFrame:
    """(run, n_added, n_dropped): what every run wrote. A run without a change has no rows."""
    return spark.read.parquet(path).groupBy("run").agg(F.count_if(~F.col("dropped")).alias("n_added"), F.count_if("dropped").alias("n_dropped"))


def sync_chunks(chunks: DataFrame, path: str, encoder: Callable[[pd.Series], pd.Series], *, run: int,
                keys: Sequence[str] = ("doc_id", "section_no", "chunk_no"), text_col: str = "text") -> None:
    """Bring an incremental store to the given chunks: encode and write what is new, tombstone what is gone.

    A chunk is known by its key and the digest of its text, so only changed chunks reach the encoder, and a run over
    unchanged chunks writes none. Runs are numbered upwards by the caller; each is a folder of its own, and a run that
    is repeated replaces its folder, so a job that died half-way can simply start again.
    """
    spark = chunks.sparkSession
    new = chunks.withColumn("digest", content_digest(text_col))
    earlier = _earlier_runs(spark, path, run)
    if earlier is None:
        added, gone = new, None
    else:
        own = live_chunks_of(earlier, keys)
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*keys, "digest")]
        added = new.alias("n").join(own.select(*keys, "digest").alias("o"), same, "left_anti")
        gone = own.select(*keys, "digest").alias("o").join(new.select(*keys, "digest").alias("n"), same, "left_anti")
    rows = encode(added, encoder, text_col=text_col).withColumn("dropped", F.lit(False))
    if gone is not None:
        rows = rows.unionByName(gone.withColumn("dropped", F.lit(True)), allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def require_and_filter(df: DataFrame, cols: Sequence[str] = ("scholarship_name", "rag_document", "rag_metadata"),
                       text_col: str = "rag_document") -> DataFrame:
    """Fail on a missing column, drop rows with a blank text."""
    return require_columns(df, cols).filter(F.length(strip(text_col)) > 0)


def verify_store(df: DataFrame, key: str) -> DataFrame:
    """Row count, column count and the lowest key as a sample."""
    return df.agg(F.count("*").alias("n_rows"), F.min(key).alias("sample_key")).withColumn(
        "n_columns", F.lit(len(df.columns)))


def describe_store(df: DataFrame) -> DataFrame:
    """Column names and types as a table."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, column_type string")


def sample_rows(df: DataFrame, cols: Sequence[str], order: str, n: int = 5) -> DataFrame:
    return df.select(*cols).orderBy(order).limit(n)


#: Options to write and read a report with: null and the empty text differ, and white space at the ends stays.
CSV_OPTIONS = {"header": True, "escape": '"', "nullValue": "\\N", "emptyValue": "", "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS | {"emptyValue": '""'}).csv(path)


def read_report_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", True).csv(path)

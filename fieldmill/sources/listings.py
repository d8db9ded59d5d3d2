"""Listing files: multi-file ingest with lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import as_col
from ..schemas import RAW_LISTING

CORRUPT = "_corrupt_record"
DEFAULT_GLOB = "*_scholarships_data*.json"


def _scan(spark: SparkSession, folder: str, glob: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(full).option("multiLine", multi_line).option("pathGlobFilter", glob)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .json(folder))


def _readable(schema: T.StructType):
    """Whether a record parsed. Spark refuses plans that read nothing but the corrupt-record column (a bare
    count), so the test also looks at a data column, without letting it decide."""
    flags = F.array(F.col(CORRUPT).isNull(), F.col(schema.names[0]).isNull())
    return F.array_position(flags, F.lit(True)) == 1


def read_listings(spark: SparkSession, folder: str, glob: str = DEFAULT_GLOB, *,
                  schema: T.StructType = RAW_LISTING, multi_line: bool = True) -> DataFrame:
    """Every matching JSON file of a folder plus ``source_file``; unreadable records are skipped.

    ``multi_line`` reads one JSON array per file, which one task must parse as a whole. Large inputs should be
    JSON lines (``multi_line=False``), which Spark splits.
    """
    raw = with_source_file(_scan(spark, folder, glob, schema, multi_line))
    return raw.filter(_readable(schema)).drop(CORRUPT)


def unreadable_records(spark: SparkSession, folder: str, glob: str = DEFAULT_GLOB, *,
                       schema: T.StructType = RAW_LISTING, multi_line: bool = True) -> DataFrame:
    """What ``read_listings`` skips, per file: the ingest log as a table."""
    raw = with_source_file(_scan(spark, folder, glob, schema, multi_line))
    return raw.filter(~_readable(schema)).groupBy("source_file").agg(F.count("*").alias("n_skipped"))


def with_source_file(df: DataFrame) -> DataFrame:
    """Lineage column: the base name of the file a row came from."""
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def source_family(file_name: Column | str, rules: Sequence[tuple[str, str]] = (("daad", "DAAD"),),
                  default: str = "Scholarships_com") -> Column:
    """Family label by a part of the lower-cased file name."""
    chain = F
    for part, label in rules:
        chain = chain.when(F.contains(F.lower(as_col(file_name)), F.lit(part)), F.lit(label))
    return chain.otherwise(F.lit(default))


def with_source_family(df: DataFrame, col: str = "source_file", **kw) -> DataFrame:
    return df.withColumn("source_script", source_family(col, **kw))

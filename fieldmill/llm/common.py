"""What the training-data operators share: reading a table, naming working columns, shared working tables."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_path

# Columns of the ``documents`` table; filtering stages return exactly these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Whole texts that are handed to Python at once where memory is short. Spark's 10,000 are some 50 MB of a task twice over,
#: in the executor's JVM and in the Python worker.
BATCH_ROWS = 1_000

# Working columns carry this prefix, so they cannot clash with a column that a table brings along.
OWN = "__llm_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """The key columns and the whole text, a null text as the empty one."""
    return docs.select(*keys, whole(text_col).alias(text_col))


def whole(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: work is done once and lineage ends there."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*spent: DataFrame) -> None:
    """Delete tables that ``stored`` has written, once no later step reads them."""
    for df in spent:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Spark hand at most so many rows to Python at once, from here on in this session; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give memory that is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only some C libraries have it
        trim(0)


def releasing(run):
    """A function over the batches of a task that gives memory back at its end: Python workers outlive their tasks, and
    what they keep adds up from stage to stage."""
    @functools.wraps(run)
    def whole_task(frames):
        try:
            yield from run(frames)
        finally:
            release()

    return whole_task


def let(value: Column, body) -> Column:
    """Bind a value once for a body that uses it many times, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)

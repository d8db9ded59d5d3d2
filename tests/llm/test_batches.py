"""The stages of the pipeline hand few texts to Python at once."""

import pyarrow as pa
import pytest

import corpus_pipeline
from fieldmill.llm.common import BATCH_ROWS, small_batches

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def batches(spark):
    kept = spark.conf.get(KEY)
    yield lambda rows: spark.conf.set(KEY, str(rows))
    spark.conf.set(KEY, kept)


@pytest.mark.parametrize("before, after", [(10_000, BATCH_ROWS), (0, BATCH_ROWS), (-1, BATCH_ROWS), (BATCH_ROWS, BATCH_ROWS), (50, 50)])
def test_a_lower_bound_stays(spark, batches, before, after):
    batches(before)
    small_batches(spark)
    assert int(spark.conf.get(KEY)) == after


@pytest.mark.parametrize("stage", [corpus_pipeline.of_quality, corpus_pipeline.without_near_duplicates, corpus_pipeline.packed])
def test_stages_bound_what_python_gets_at_once(spark, batches, stage):
    batches(10_000)
    rows = [(k, f"text {k} " * 30, "en", "src0", 1) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage(spark, docs, "").count()

    def sizes(frames):
        for frame in frames:
            yield pa.RecordBatch.from_pydict({"n": pa.array([frame.num_rows], pa.int64())})

    seen = spark.range(0, 2_500, 1, 1).mapInArrow(sizes, "n long").collect()
    assert max(r["n"] for r in seen) <= BATCH_ROWS and sum(r["n"] for r in seen) == 2_500

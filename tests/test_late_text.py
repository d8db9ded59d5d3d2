"""Queries that add texts to their hits move only the texts of the hits."""

import pytest

from fieldmill.checks import retrieval as R
from fieldmill.checks.base import Tables

WORDS = "grant study germany tuition master stipend field water stone river".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts = [" ".join(WORDS[(k * 7 + j * j) % len(WORDS)] for j in range(3 + k % 5)) + f" only{k}" for k in range(300)]
    docs = [(k, text, "en", "src0", len(text)) for k, text in enumerate(texts)] + [(5, texts[5], "en", "src0", 1), (None, "grant", "en", "src0", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 300, 2)] + [(5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, texts[k]) for k in (3, 5, 8)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def first_join_above_texts(df):
    """The join that the texts of documents meet first, in the optimised plan."""
    lines = [(len(line) - len(line.lstrip(" :+-")), line.lstrip(" :+-")) for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    at = next(k for k, (_, line) in enumerate(lines) if line.startswith("Relation") and "text#" in line and "lang#" in line)
    depth = lines[at][0]
    for level, line in reversed(lines[:at]):
        if level < depth:
            depth = level
            if line.startswith("Join"):
                return line


def test_items_are_cut_to_the_hits_below_their_own_joins(spark, folder):
    t = Tables(spark, folder)
    found = R.item_hits(t)
    assert first_join_above_texts(found).startswith("Join LeftSemi")
    hits = R.bm25_hits(t, 5)
    plain = hits.withColumnRenamed("doc_id", "item_id").join(t.items, "item_id")
    columns = ["query_id", "rank", "item_id", "scholarship_status", "text"]
    rows = sorted(map(repr, plain.select(columns).collect()))
    assert sorted(map(repr, found.select(columns).collect())) == rows
    assert len(rows) > hits.count()  # document 5 and its labels come more than once


def test_scored_texts_are_cut_to_the_hits(spark, folder):
    t = Tables(spark, folder)
    found = R.scored(t)
    assert first_join_above_texts(found).startswith("Join LeftSemi")
    plain = R.bm25_hits(t, 15).join(t.documents.select("doc_id", "text"), "doc_id").select("query_id", "doc_id", "rank", "text")
    assert sorted(map(repr, found.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))

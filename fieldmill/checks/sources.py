"""Scans, sinks and stores (A)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from ..operators.chunks import chunk_documents, split_stride
from ..schemas import RAW_LISTING
from ..session import fresh_path
from ..sources import listings as L, stores as S
from .base import check
from .texts import OF_SECTIONS, recursive_ctes, sections_ctes

LISTING_COLS = ("scholarship_name, country, degree_level, funding_type, awards_available, deadline, description, "
                "scholarship_details, eligibility, application_process, application_link")


def _ingested(t):
    """The listing view written as JSON lines per source and read back through the listing reader."""
    folder = fresh_path(t.spark, "listings")
    rows = t.listings.withColumn("tags", F.split("tags", ", ")).select(*RAW_LISTING.names, "item_id")
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(folder)
    schema = T.StructType(RAW_LISTING.fields + [T.StructField("item_id", T.LongType())])
    return L.read_listings(t.spark, folder, "*.json", schema=schema, multi_line=False)


@check("a1_read_listings", f"SELECT item_id, {LISTING_COLS}, array_to_string(string_split(tags, ', '), '|') AS tags "
       "FROM {listings} AS l")
def a1(t):
    return _ingested(t).withColumn("tags", F.array_join("tags", "|")).drop("source_file")


@check("a2_source_file", "SELECT item_id, CAST(1 AS INT) AS is_part_file FROM {listings} AS l")
def a2(t):
    named = _ingested(t)
    return named.select("item_id", F.rlike("source_file", F.lit(r"^part-.*\.json$")).cast("int").alias("is_part_file"))


def _array_files(t):
    """The listing view as one JSON array per file, some files per source, named like the deliveries."""
    cells = [*RAW_LISTING.names, "item_id"]
    named = t.listings.withColumn("tags", F.split("tags", ", ")).withColumn("file", F.concat(
        F.regexp_replace("source_file", r"\.json$", ""), F.lit("_"), (F.col("item_id") % 4).cast("string"), F.lit(".json")))
    arrays = named.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list(
        F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})), ",\n"), F.lit("]")).alias("value"))
    folder, out = fresh_path(t.spark, "arrays"), fresh_path(t.spark, "deliveries")
    arrays.write.partitionBy("file").text(folder)
    fs_path = t.spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(t.spark._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(out))
    for found in fs.globStatus(fs_path(f"{folder}/file=*/part-*")):
        fs.rename(found.getPath(), fs_path(out, found.getPath().getParent().getName().removeprefix("file=")))
    return out


@check("a1_read_arrays", f"""SELECT item_id, {LISTING_COLS}, array_to_string(string_split(tags, ', '), '|') AS tags,
  regexp_replace(source_file, '\\.json$', '') || '_' || CAST(item_id % 4 AS STRING) || '.json' AS source_file FROM {{listings}} AS l""")
def a1_arrays(t):
    """JSON arrays over several lines, found by the default pattern, with the names of their files."""
    schema = T.StructType(RAW_LISTING.fields + [T.StructField("item_id", T.LongType())])
    return L.read_listings(t.spark, _array_files(t), schema=schema).withColumn("tags", F.array_join("tags", "|"))


@check("a3_source_family", """
SELECT source_file, CASE WHEN contains(lower(source_file), 'daad') THEN 'DAAD' ELSE 'Scholarships_com' END AS source_script,
       count(*) AS n FROM {listings} AS l GROUP BY 1, 2""")
def a3(t):
    return L.with_source_family(t.listings).groupBy("source_file", "source_script").agg(F.count("*").alias("n"))


@check("a4_master_json", "SELECT item_id, scholarship_name, text, funding_amount, scholarship_status FROM {items} AS i")
def a4(t):
    path = fresh_path(t.spark, "master")
    rows = t.items.select("item_id", "scholarship_name", "text", "funding_amount", "scholarship_status")
    S.write_master(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@check("a5_item_store", """
SELECT item_id, scholarship_name, awards_available, description, scholarship_details, eligibility, application_process,
       application_link, source_file, lang FROM {listings} AS l""")
def a5(t):
    path = fresh_path(t.spark, "items")
    S.write_items(t.listings, path)
    return t.spark.read.parquet(path)


def hashing_encoder(texts: pd.Series) -> pd.Series:
    """Stand-in for a caller's model: signed word hashes in 32 buckets, unit length."""
    def one(text):
        v = np.zeros(32, dtype=np.float32)
        for word in (text or "").split():
            h = zlib.crc32(word.encode())
            v[h % 32] += 1.0 if h & 64 else -1.0
        length = float(np.sqrt((v * v).sum()))
        return (v / length if length else v).tolist()

    return texts.map(one)


@check("a6_chunk_store", f"""
WITH RECURSIVE {sections_ctes('SELECT doc_id, text AS md FROM documents')}, {recursive_ctes(OF_SECTIONS, 800, 100)}
SELECT id.d AS doc_id, id.s AS section_no, chunk_no, text, CAST(32 AS INT) AS dim, true AS unit FROM chunks WHERE length(text) >= 30""")
def a6(t):
    path = fresh_path(t.spark, "chunks")
    docs = t.documents.select("doc_id", "text")
    S.write_chunks(chunk_documents(docs, text_col="text"), path, hashing_encoder)
    norm2 = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3)
    return S.read_chunks(t.spark, path).select(
        "doc_id", "section_no", "chunk_no", "text", F.size("embedding").alias("dim"), norm2.isin(0.0, 1.0).alias("unit"))


def _edited(t):
    """The documents of a later delivery: a third changed at the end, a tenth gone."""
    return t.sql("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' added line' ELSE text END AS text FROM {documents} WHERE doc_id % 10 <> 7""")


def _strides(source: str) -> str:
    return (f"SELECT doc_id, i AS chunk_no, substr(text, CAST(i * 700 + 1 AS BIGINT), 800) AS text FROM (SELECT doc_id, text, "
            f"unnest(generate_series(0, (greatest(length(text), 1) - 1) // 700)) AS i FROM ({source}) AS s) AS c WHERE length(text) > 0")


_LATER = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' added line' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7"


@check("a6_chunk_sync", f"""
WITH o AS ({_strides('SELECT doc_id, text FROM documents')}), n AS ({_strides(_LATER)}),
  runs AS (SELECT 1 AS run, (SELECT count(*) FROM o) AS n_added, 0 AS n_dropped UNION ALL
    SELECT 2, (SELECT count(*) FROM n ANTI JOIN o USING (doc_id, chunk_no, text)), (SELECT count(*) FROM o ANTI JOIN n USING (doc_id, chunk_no, text)))
SELECT CAST(run AS INT) AS run, n_added, CAST(n_dropped AS BIGINT) AS n_dropped, (SELECT count(*) FROM n) AS n_live, (SELECT sum(length(text)) FROM n) AS live_chars FROM runs""")
def a6_sync(t):
    """Three deliveries, the third like the second: it writes nothing, so it has no row."""
    path, keys = fresh_path(t.spark, "chunks"), ("doc_id", "chunk_no")
    for run, docs in enumerate((t.documents.select("doc_id", "text"), _edited(t), _edited(t)), 1):
        S.sync_chunks(split_stride(docs, 800, 100), path, hashing_encoder, run=run, keys=keys)
    live = S.live_chunks(t.spark, path, keys).agg(F.count("*").alias("n_live"), F.sum(F.length("text")).alias("live_chars"))
    return S.sync_history(t.spark, path).withColumns({"n_live": live.select("n_live").scalar(), "live_chars": live.select("live_chars").scalar()})


@check("a7_require_and_filter", """
SELECT item_id, description FROM {listings} AS l WHERE length(trim(description, ' ' || chr(9) || chr(10) || chr(13))) > 0""")
def a7(t):
    return S.require_and_filter(t.listings, ("item_id", "description"), "description").select("item_id", "description")


@check("a8_read_chunks", """
SELECT doc_id, CAST(i AS INT) AS chunk_no, substr(text, CAST(i * 700 + 1 AS BIGINT), 800) AS text FROM (
  SELECT doc_id, text, unnest(generate_series(0, (greatest(length(text), 1) - 1) // 700)) AS i FROM documents) AS c
WHERE length(text) > 0""")
def a8(t):
    path = fresh_path(t.spark, "chunks")
    split_stride(t.documents.select("doc_id", "text"), 800, 100).write.mode("overwrite").parquet(path)
    return S.read_chunks(t.spark, path)


@check("a9_verify_store", "SELECT count(*) AS n_rows, min(item_id) AS sample_key, CAST(16 AS INT) AS n_columns FROM {items} AS i")
def a9(t):
    return S.verify_store(t.items, "item_id")


@check("a9_describe_store", """
SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END AS column_type,
  (SELECT count(*) FROM {items} AS n) AS n_rows FROM (DESCRIBE SELECT * FROM {items} AS i)""")
def a9_describe(t):
    return S.describe_store(t.items).join(S.verify_store(t.items, "item_id").select("n_rows"))


@check("a9_sample_rows", """
SELECT item_id, eligible_nationality, academic_level FROM {items} AS i ORDER BY item_id LIMIT 5""")
def a9_sample(t):
    return S.sample_rows(t.items, ["item_id", "eligible_nationality", "academic_level"], "item_id")


@check("a10_report_csv", "SELECT item_id, deadline, coalesce(scholarship_name, '') AS scholarship_name, description FROM {listings} AS l")
def a10(t):
    path = fresh_path(t.spark, "report")
    rows = t.listings.select(
        "item_id", "deadline", F.coalesce("scholarship_name", F.lit("")).alias("scholarship_name"), "description")
    S.write_report_csv(rows, path)
    return S.read_report_csv(t.spark, path, rows.schema)

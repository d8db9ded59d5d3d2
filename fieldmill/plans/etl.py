"""Listings to master table, item store and chunk table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from ..functions.rules import metadata
from ..operators.chunks import chunk_documents, slim_meta
from ..operators.documents import build_document, standardise, with_places
from ..sources.stores import item_columns, require_and_filter


def master_table(listings: DataFrame, ref: str | datetime, *, gazetteer: DataFrame | Sequence[str] | None = None,
                 id_col: str | None = None, major_col: str | None = None) -> DataFrame:
    """Raw listings to the enriched table: standardised columns, document text and metadata.

    Without a gazetteer, or with a list of place names, the plan is a chain of projections over the scan, with
    no shuffle. A gazetteer table adds a join for the rows whose host or nationality is still open.
    """
    out = standardise(listings, ref, major_col=major_col)
    if gazetteer is not None:
        out = with_places(out, gazetteer, id_col=id_col, context_col="_context")
    out = build_document(out.drop("_context"))
    return out.withColumn("rag_metadata", metadata(out.columns))


def item_table(master: DataFrame) -> DataFrame:
    return item_columns(master)


def chunk_table(master: DataFrame, *, id_col: str, size: int = 800, overlap: int = 100,
                min_length: int = 30) -> DataFrame:
    """(id, section_no, chunk_no, titles, text, metadata): ready for an encoder."""
    docs = require_and_filter(master)
    docs = slim_meta(docs).select(id_col, "rag_document", "rag_metadata")
    return chunk_documents(docs, text_col="rag_document", id_col=id_col, size=size, overlap=overlap,
                           min_length=min_length)

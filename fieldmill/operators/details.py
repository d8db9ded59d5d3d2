"""Late lookups of heavy item text and the result projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import as_col
from .ranking import broadcast_if_small

DETAIL_COLUMNS = (
    "scholarship_name", "host_country", "academic_level", "academic_major", "funding_category", "funding_amount",
    "standardized_deadline", "description", "scholarship_details", "eligibility", "application_process",
    "application_link",
)


def lowest_row(items: DataFrame, key: str, cols: Sequence[str], id_col: str) -> DataFrame:
    """One row per key: the one with the lowest id. The choice runs on keys and ids alone, so copies of a name
    combine in the map and heavy columns are only read for the chosen rows."""
    if key == id_col:
        return items.select(key, *cols)
    chosen = items.select(key, id_col).groupBy(key).agg(F.min(id_col).alias(id_col)).select(id_col)
    return items.select(id_col, key, *cols).join(chosen, id_col, "left_semi").drop(id_col)


def wanted(items: DataFrame, keys: DataFrame, key: str, basis: DataFrame | None = None) -> DataFrame:
    """The items whose key is asked for: heavy text is cut down before it is moved. ``basis`` is the table the
    keys grow with (the requests behind a hit list), whose size decides about a broadcast.
    Spark does not move the cut below a join that ``items`` is made of."""
    return items.join(broadcast_if_small(keys.select(key).distinct(), basis), key, "left_semi")


def late_enrich(hits: DataFrame, items: DataFrame, *, key: str, col: str = "application_process",
                text_col: str = "text", id_col: str = "item_id", heading: str = "Application Process",
                default: str = "Process not specified.", basis: DataFrame | None = None) -> DataFrame:
    """Append a heavy column to the text of the final hits only. The hits are read twice, for the keys and for
    the join: pass a written table when they come out of a long plan."""
    heavy = lowest_row(wanted(items, hits, key, basis), key, [col], id_col)
    found = F.when(F.coalesce(col, F.lit("")) == "", F.lit(default)).otherwise(F.col(col))
    out = hits.drop(col).join(heavy, key, "left")
    return out.withColumn(text_col, F.concat(F.col(text_col), F.lit(f"\n\n## {heading}\n"), found)).drop(col)


def hit_cards(hits: DataFrame, *, text_col: str = "text", score: str = "rerank_score", query_id: str = "query_id",
              level_default: Column | None = None) -> DataFrame:
    """Eight card fields per hit with defaults, and the number of hits of the query."""
    level_default = F.lit("Not Specified") if level_default is None else level_default
    # hits hold at most top_k rows per query, so a window over a query stays small
    found = F.count("*").over(Window.partitionBy(query_id))
    return hits.withColumn("total_found", found).select(
        query_id, "rank", "total_found",
        F.coalesce("scholarship_name", F.lit("Unknown Scholarship")).alias("title"),
        F.coalesce("host_country", F.lit("Not Specified")).alias("country"),
        F.coalesce(F.col("academic_level"), level_default).alias("academic_level"),
        F.coalesce("funding_category", F.lit("Not Specified")).alias("funding_type"),
        F.concat(F.substring(text_col, 1, 200), F.lit("...")).alias("description"),
        F.coalesce("standardized_deadline", F.lit("Not Specified")).alias("deadline"),
        F.coalesce("application_link", F.lit("#")).alias("url"),
        F.coalesce(score, F.lit(0.9)).alias("match_score"))


def decoded_key(col: Column | str) -> Column:
    """Percent-decoded key; a plus sign stays a plus sign, and a broken escape leaves the text as it is."""
    plain = F.replace(as_col(col), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plain), as_col(col))


def detail_lookup(keys: DataFrame, items: DataFrame, *, key_col: str = "key", name_col: str = "scholarship_name",
                  id_col: str = "item_id", cols: Sequence[str] = DETAIL_COLUMNS) -> DataFrame:
    """Full details per requested key; a missing amount reads 'Not Specified', other missing fields ''."""
    asked = keys.withColumn(name_col, decoded_key(key_col))
    rest = [c for c in cols if c != name_col]
    found = lowest_row(wanted(items, asked, name_col), name_col, rest, id_col)
    out = asked.select(key_col, name_col).join(found, name_col)
    return out.select(key_col, name_col, *[
        F.coalesce(c, F.lit("Not Specified" if c == "funding_amount" else "")).alias(c) for c in rest])


def detail_misses(keys: DataFrame, items: DataFrame, *, key_col: str = "key",
                  name_col: str = "scholarship_name") -> DataFrame:
    asked = keys.withColumn(name_col, decoded_key(key_col))
    return asked.join(items.select(name_col), name_col, "left_anti")


def short_details(keys: DataFrame, items: DataFrame, *, name_col: str = "scholarship_name",
                  id_col: str = "item_id", steps: str = "application_process") -> DataFrame:
    """One text per asked name, with a fixed text for names that do not exist."""
    found = lowest_row(wanted(items, keys, name_col), name_col, [steps], id_col).withColumn("_found", F.lit(True))
    out = keys.join(found, name_col, "left")
    text = F.when(F.col("_found"), F.concat(
        F.lit("Scholarship Name: "), F.col(name_col), F.lit("\nApplication Process/Details: "),
        F.coalesce(steps, F.lit("None")))).otherwise(
        F.concat(F.lit("Scholarship Name: "), F.col(name_col), F.lit("\nDetails not found.")))
    return out.withColumn("details", text).drop(steps, "_found")

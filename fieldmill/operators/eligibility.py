"""Query intents, profile-item eligibility and query enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K
from ..functions.text import alternation, as_col, strip


def bypass_filters(query: Column | str) -> Column:
    return F.rlike(F.lower(as_col(query)), F.lit(alternation(K.BYPASS_NAMES)))


def target_funding(query: Column | str) -> Column:
    lowered = F.lower(as_col(query))
    return (F.when(F.rlike(lowered, F.lit(alternation(K.FULL_FUNDING_PHRASES))), F.lit("Fully Funded"))
            .when(F.rlike(lowered, F.lit(alternation(K.PARTIAL_FUNDING_PHRASES))), F.lit("Partially Funded")))


def detect_intents(df: DataFrame, query_col: str = "query") -> DataFrame:
    return df.withColumn("bypass_filters", bypass_filters(query_col)).withColumn(
        "target_funding", target_funding(query_col))


def item_levels(level: Column | str, bypass: Column | None = None) -> Column:
    """Item levels a profile may see: by its level, only unspecified for an unknown one."""
    levels = F.create_map(*[x for level_, items in K.PROFILE_LEVELS.items()
                            for x in (F.lit(level_), F.array(*[F.lit(i) for i in items]))])
    return F.coalesce(F.try_element_at(levels, as_col(level)), F.array(F.lit(K.UNSPECIFIED)))


FACETS = ["academic_level", "eligible_nationality", "funding_category"]


def open_to_all(nationality: Column | str) -> Column:
    return F.rlike(as_col(nationality), F.lit(f"(?i){alternation(K.OPEN_MARKERS)}"))


def facet_id(columns: list[str] = FACETS) -> Column:
    """One text key per combination of the filter columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def visible_items(items: DataFrame) -> DataFrame:
    """Items that may be matched at all: a null status is not visible."""
    return items.filter(F.col("scholarship_status") != "Expired")


def with_facet(items: DataFrame) -> DataFrame:
    return items.withColumn("facet", facet_id())


SIGNATURE = ["nationality", "academic_level", "bypass_filters", "target_funding"]


def with_signature(requests: DataFrame) -> DataFrame:
    """The filter inputs of a request as one key; requests with the same inputs share every decision."""
    present = {c: (F.col(c) if c in requests.columns else F.lit(None)) for c in SIGNATURE}
    parts = F.struct(*[present[c].cast("string").alias(c) for c in SIGNATURE])
    return requests.withColumn("signature", F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256))


GRAM = 3


def grams(name: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters."""
    last = F.char_length(name) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(name, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def contained_names(names: DataFrame, places: DataFrame, name: str = "name", place: str = "place") -> DataFrame:
    """(name, place) of the distinct texts of two tables where the place holds the name, whatever the case.

    An inverted index on the places' substrings of one to three characters: a name looks up its rarest one (a name
    of fewer characters itself) by an equi-join, and only what meets there is compared. A name with a substring that
    no place has meets nothing. The empty name is in every place.
    """
    lists = places.select(F.col(place).alias("place")).filter("place IS NOT NULL").distinct().withColumn("low", F.lower("place"))
    parts = F.concat(F.array(F.lit("")), *[grams(F.col("low"), n) for n in range(1, GRAM + 1)])
    index = lists.select("place", "low", F.explode(parts).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    asked = names.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct().withColumn("sought", F.lower("name"))
    size = F.char_length("sought")
    own = F.when(size >= GRAM, grams(F.col("sought"), GRAM)).otherwise(F.array("sought"))
    met = asked.select("name", "sought", F.explode(own).alias("gram")).join(counts, "gram", "left")
    rarest = met.groupBy("name", "sought").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    looked = rarest.select("name", "sought", F.col("r.gram").alias("gram"))
    return looked.join(index, "gram").filter(F.contains("low", "sought")).select("name", "place")


#: The facets of a level are dealt to so many keys, since levels are few.
LEVEL_SALTS = 32


def signatures(requests: DataFrame) -> DataFrame:
    """Distinct filter inputs: (signature, nationality, target_funding, bypass) and one row per item level looked at.

    A bypassing signature looks at all levels, the unknown ones (``*``) included.
    """
    sig = with_signature(requests)
    sig = sig.select("signature", *[(F.col(c) if c in sig.columns else F.lit(None).cast(t)).alias(c) for c, t in (
        ("nationality", "string"), ("academic_level", "string"), ("bypass_filters", "boolean"),
        ("target_funding", "string"))]).distinct()
    bypass = F.coalesce("bypass_filters", F.lit(False))
    levels = F.when(bypass, F.array(*[F.lit(x) for x in K.ITEM_LEVELS + ["*"]])).otherwise(item_levels("academic_level"))
    return sig.select("signature", "nationality", "target_funding", bypass.alias("bypass"), F.explode(levels).alias("level"))


def facet_table(items: DataFrame) -> DataFrame:
    """(facet, place, funding_category, level, open, n, low): distinct attributes of visible items and their items."""
    known = F.col("academic_level").isin(K.ITEM_LEVELS)
    ids = [F.min("item_id").alias("low")] if "item_id" in items.columns else []
    sized = with_facet(visible_items(items)).groupBy("facet", *FACETS).agg(F.count("*").alias("n"), *ids)
    return sized.select(
        "facet", F.col("eligible_nationality").alias("place"), "funding_category",
        F.when(known, F.col("academic_level")).otherwise(F.lit("*")).alias("level"),
        F.coalesce(open_to_all("eligible_nationality"), F.lit(False)).alias("open"), "n", *(["low"] if ids else []))


def funded() -> Column:
    return F.col("target_funding").isNull() | (F.col("target_funding") == F.col("funding_category"))


def named_facets(sig: DataFrame, facets: DataFrame) -> DataFrame:
    """Signatures with the facets that name their nationality and are not open anyway: equi-joins on names only."""
    narrow = sig.filter(~F.col("bypass"))
    closed = facets.filter(~F.col("open"))
    pairs = contained_names(narrow, closed, "nationality", "place").withColumnRenamed("name", "nationality")
    return narrow.join(pairs, "nationality").join(closed, ["place", "level"]).filter(funded())


def accepted_facets(requests: DataFrame, items: DataFrame) -> DataFrame:
    """(signature, facet): which combinations of item attributes a request's filter inputs accept.

    Two ways: facets that name the nationality, by an index on names (``contained_names``); facets open to all, or
    looked at by a bypassing signature, by their level (every row of that join is a result, but for the funding).
    """
    sig, facets = signatures(requests), facet_table(items)
    named = named_facets(sig, facets).select("signature", "facet")
    salted = sig.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LEVEL_SALTS - 1))))
    dealt = facets.withColumn("salt", F.pmod(F.xxhash64("facet"), F.lit(LEVEL_SALTS)).cast("int"))
    free = salted.join(dealt, ["level", "salt"]).filter(funded() & (F.col("bypass") | F.col("open")))
    return named.unionByName(free.select("signature", "facet"))


def eligible_pairs(requests: DataFrame, items: DataFrame, *, request_id: str = "session_id",
                   item_id: str = "item_id") -> DataFrame:
    """(request, item) for every item that passes the request's filter.

    The result is as large as the answer; ``eligible_counts`` and the facet filter of the vector search give
    what they need without listing it.
    """
    accepted = accepted_facets(requests, items)
    per_item = accepted.join(with_facet(visible_items(items)).select(item_id, "facet"), "facet")
    return with_signature(requests).select(request_id, "signature").join(per_item, "signature").select(
        request_id, item_id)


def eligible_counts(requests: DataFrame, items: DataFrame, *, request_id: str = "session_id",
                    item_id: str = "item_id") -> DataFrame:
    """(request, n_eligible, first_item): sizes of the eligible sets without listing them.

    Open facets are summed per level and funding before they meet a signature; only facets that name a nationality
    meet one by one.
    """
    sig, facets = signatures(requests), facet_table(items.withColumnRenamed(item_id, "item_id"))
    named = named_facets(sig, facets).select("signature", "n", "low")
    sums = facets.groupBy("level", "funding_category", "open").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    free = sig.join(sums, "level").filter(funded() & (F.col("bypass") | F.col("open"))).select("signature", "n", "low")
    per_sig = named.unionByName(free).groupBy("signature").agg(F.sum("n").alias("n_eligible"), F.min("low").alias("first_item"))
    out = with_signature(requests).select(request_id, "signature").join(per_sig, "signature", "left")
    return out.select(request_id, F.coalesce("n_eligible", F.lit(0)).cast("bigint").alias("n_eligible"), "first_item")


def leak_counts(requests: DataFrame, items: DataFrame) -> DataFrame:
    """One row ``(n_pairs, n_leaks)``: pairs of requests and items that the facet filter accepts, and those of them
    that the row predicate refuses. Both are decided per signature and facet and weighed by their sizes."""
    accepted = accepted_facets(requests, items)
    asked = with_signature(requests).groupBy("signature").agg(
        F.count("*").alias("n_requests"), *[F.first(c).alias(c) for c in SIGNATURE])
    offered = with_facet(visible_items(items)).groupBy("facet").agg(
        F.count("*").alias("n_items"), F.first("scholarship_status").alias("scholarship_status"), *[F.first(c).alias("item_" + c) for c in FACETS])
    rule = is_eligible("nationality", "academic_level", "bypass_filters", "target_funding", item_nationality="item_eligible_nationality",
                       item_level="item_academic_level", item_funding="item_funding_category")
    pairs = F.col("n_requests") * F.col("n_items")
    met = accepted.join(asked, "signature").join(offered, "facet")
    return met.agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("n_pairs"),
                   F.coalesce(F.sum(F.when(F.coalesce(rule, F.lit(False)), 0).otherwise(pairs)), F.lit(0)).alias("n_leaks"))


def is_eligible(nationality: Column | str, level: Column | str, bypass: Column | str, funding: Column | str, *,
                status: str = "scholarship_status", item_nationality: str = "eligible_nationality",
                item_level: str = "item_level", item_funding: str = "funding_category") -> Column:
    """The same rule as one predicate, for a (request, item) row that already exists."""
    place = open_to_all(item_nationality) | F.contains(F.lower(item_nationality), F.lower(as_col(nationality)))
    funded = as_col(funding).isNull() | (as_col(funding) == F.col(item_funding))
    fits = place & F.array_contains(item_levels(level), F.col(item_level))
    return (F.col(status) != "Expired") & funded & (F.coalesce(as_col(bypass), F.lit(False)) | fits)


def enriched_query(query: Column | str, major: Column | str, interests: Column | str, skills: Column | str) -> Column:
    """``query (Academic Focus: … | Research: … | Skills: a, b)``; empty parts are left out."""
    interests, skills = as_col(interests), as_col(skills)
    context = F.concat_ws(
        " | ",
        F.concat(F.lit("Academic Focus: "), F.coalesce(as_col(major), F.lit("None"))),
        F.when(interests != "", F.concat(F.lit("Research: "), interests)),
        F.when(F.size(skills) > 0, F.concat(F.lit("Skills: "), F.array_join(skills, ", "))))
    return F.concat_ws(" ", F.nullif(strip(query), F.lit("")), F.concat(F.lit("("), context, F.lit(")")))


def enrich_query(df: DataFrame, *, query: str = "query", major: str = "academic_major",
                 interests: str = "research_interests", skills: str = "skills",
                 out_col: str = "search_query") -> DataFrame:
    return df.withColumn(out_col, enriched_query(query, major, interests, skills))

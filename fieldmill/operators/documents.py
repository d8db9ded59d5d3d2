"""Documents: standardised fields, context entities and the markdown text of a listing."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K, rules as R
from ..functions.text import alternation, as_col, clean_text, let, not_contained

TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SECTIONS = (("Scholarship Details", "scholarship_details"), ("Eligibility Criteria", "eligibility"))


def tokens(col: Column | str) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(as_col(col), F.lit(TOKENS), F.lit(0))


def mentions(col: Column | str, window: int, keywords: Sequence[str], max_words: int,
             starts: Callable[[Column], Column]) -> Column:
    """Name candidates whose ``window`` preceding tokens hold a keyword: array<struct<name, before>>.

    Candidates are the runs of 1..max_words tokens whose first token ``starts`` a name. Windows are built for those
    places only, and the keyword test is row-local: little of a text ever leaves its row.
    """
    pattern = F.lit(alternation(keywords))

    def at(toks):
        def before(i):
            first = F.greatest(i - window, F.lit(1))
            return F.lower(F.array_join(F.slice(toks, first, F.least(i - 1, F.lit(window))), " "))

        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1))),
                          lambda i: starts(F.coalesce(F.get(toks, i - 1), F.lit(""))))
        near = F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), before(i).alias("before"))),
                        lambda m: F.rlike(m["before"], pattern))

        def runs(n):
            return F.transform(near, lambda m: F.struct(
                F.array_join(F.slice(toks, m["i"], F.lit(n)), " ").alias("name"), m["before"].alias("before")))

        return F.flatten(F.array(*[runs(n) for n in range(1, max_words + 1)]))

    return let(tokens(col), at)


def roles(before: Column, host_open: Column, host_keywords: Sequence[str], nat_keywords: Sequence[str]) -> tuple[Column, Column]:
    """(names a host, names a nationality): a host keyword only counts while the host of the row is open."""
    host = F.rlike(before, F.lit(alternation(host_keywords))) & host_open
    return host, F.rlike(before, F.lit(alternation(nat_keywords))) & ~host


def context_entities(df: DataFrame, text: str, gazetteer: DataFrame, *, id_col: str, name_col: str = "name",
                     window: int = 5, host_open: Column | None = None, host_keywords: Sequence[str] = K.HOST_KEYWORDS,
                     nat_keywords: Sequence[str] = K.NATIONALITY_KEYWORDS) -> DataFrame:
    """(id, hosts, nationalities): place names by the keywords in the tokens before them.

    A host keyword wins over a nationality keyword where ``host_open`` holds (default: everywhere). Names join the
    gazetteer by their tokens, so Spark broadcasts a small gazetteer and shuffles against a large one. How many tokens
    its longest name has, and whether all names begin with a capital, is asked of the gazetteer once: one row. Values
    are distinct, sorted and joined; rows without any hit are absent.
    """
    names = gazetteer.select(F.col(name_col).alias("known"), tokens(name_col).alias("toks")).filter(F.size("toks") > 0)
    most, capital = names.agg(F.max(F.size("toks")), F.bool_and(F.rlike(F.get("toks", F.lit(0)), F.lit(r"^\p{Lu}")))).first()
    start = F.lit(r"^\p{Lu}" if capital else r"^[\p{L}\p{N}_]")
    # explode_outer: a plain explode makes the optimizer test the array's size first, which computes it twice
    found = df.select(F.col(id_col), (F.lit(True) if host_open is None else host_open).alias("open"), F.explode_outer(mentions(
        text, window, list(host_keywords) + list(nat_keywords), most or 1, lambda tok: F.rlike(tok, start))).alias("m"))
    host, nat = roles(F.col("m.before"), F.col("open"), host_keywords, nat_keywords)
    found = found.filter("m is not null").select(F.col(id_col), F.col("m.name").alias("name"), host.alias("is_host"), nat.alias("is_nat"))
    keys = names.select(F.array_join("toks", " ").alias("name"), "known").distinct()
    hits = found.filter("is_host or is_nat").join(keys, "name")

    def joined(keep):
        kept = F.array_sort(F.collect_set(F.when(keep, F.col("known"))))
        return F.when(F.size(kept) > 0, F.array_join(kept, ", "))

    return hits.groupBy(id_col).agg(joined(F.col("is_host")).alias("hosts"), joined(F.col("is_nat")).alias("nationalities"))


def context_places(text: Column | str, names: Sequence[str], *, window: int = 5, host_open: Column | None = None,
                   host_keywords: Sequence[str] = K.HOST_KEYWORDS,
                   nat_keywords: Sequence[str] = K.NATIONALITY_KEYWORDS) -> Column:
    """struct<hosts, nationalities> for a short list of names, inside the row: no join and no shuffle.

    The names become a literal of the plan; a gazetteer of more than a few thousand names belongs in a table
    (``context_entities``).
    """
    split = {name: re.findall(r"\w+|[^\w\s]", name) for name in dict.fromkeys(names)}
    split = {name: toks for name, toks in split.items() if toks}
    if not split:
        return F.struct(F.lit(None).cast("string").alias("hosts"), F.lit(None).cast("string").alias("nationalities"))
    keys = F.array(*[F.lit(" ".join(toks)) for toks in split.values()])
    known = F.array(*[F.lit(name) for name in split])
    firsts = F.array(*[F.lit(tok) for tok in sorted({toks[0] for toks in split.values()})])

    def joined(found, role):
        def kept(m):
            return roles(m["before"], F.lit(True) if host_open is None else host_open, host_keywords, nat_keywords)[role]

        names_of = F.transform(F.filter(found, kept), lambda m: F.get(known, F.array_position(keys, m["name"]).cast("int") - 1))
        return F.nullif(F.array_join(F.array_sort(F.array_distinct(names_of)), ", "), F.lit(""))

    near = F.filter(mentions(text, window, list(host_keywords) + list(nat_keywords), max(map(len, split.values())),
                             lambda tok: F.array_contains(firsts, tok)), lambda m: F.array_contains(keys, m["name"]))
    return let(near, lambda found: F.struct(joined(found, 0).alias("hosts"), joined(found, 1).alias("nationalities")))


def with_places(df: DataFrame, gazetteer: DataFrame | Sequence[str], *, context_col: str, id_col: str | None = None,
                **kw) -> DataFrame:
    """Fill unresolved host countries and open nationalities from the context.

    Only rows that still hold a default have their text searched; where the host is known, a mention after a host
    keyword can still name a nationality. A list of names is looked up inside the row; a table joins by name and its
    findings join back on ``id_col``.
    """
    host_open, nat_open = F.col("host_country") == K.UNSPECIFIED, F.col("eligible_nationality") == K.ANY_NATIONALITY
    if isinstance(gazetteer, DataFrame):
        if id_col is None:
            raise ValueError("a gazetteer table needs id_col")
        found = context_entities(df.filter(host_open | nat_open), context_col, gazetteer, id_col=id_col, host_open=host_open, **kw)
        out = df.join(found, id_col, "left")
    else:
        found = context_places(context_col, gazetteer, host_open=host_open, **kw)
        out = df.withColumn("_places", F.when(host_open | nat_open, found))
        out = out.withColumns({c: F.col(f"_places.{c}") for c in ("hosts", "nationalities")}).drop("_places")
    return out.withColumns({
        "host_country": F.when(host_open, F.coalesce("hosts", "host_country")).otherwise(F.col("host_country")),
        "eligible_nationality": F.when(nat_open, F.coalesce("nationalities", "eligible_nationality")).otherwise(
            F.col("eligible_nationality")),
    }).drop("hosts", "nationalities")


def build_document(df: DataFrame, out_col: str = "rag_document", *, name: str = "scholarship_name",
                   link: str = "application_link", description: str = "description",
                   sections: Sequence[tuple[str, str]] = SECTIONS) -> DataFrame:
    """Adds the markdown text of a listing: title, link line, description and cleaned sections, blank line between.

    The description is left out when the first section already holds its beginning. Each text is cleaned once,
    in a projection of its own; the pieces then only refer to it.
    """
    def pick(col: str) -> Column:
        return F.col(col) if col in df.columns else F.lit(None).cast("string")

    cleaned = {f"_clean_{c}": clean_text(pick(c)) for c in [description, *[c for _, c in sections]]}
    url = R.safe_meta(pick(link))
    kept = not_contained(f"_clean_{description}", f"_clean_{sections[0][1]}")
    parts = [
        F.concat(F.lit("# Scholarship: "), R.safe_meta(pick(name))),
        F.when(url != K.UNSPECIFIED, F.concat(F.lit("**Application Link:** "), url)),
        F.concat(F.lit("## Program Description\n"), kept),
    ]
    for title, col in sections:
        text = F.col(f"_clean_{col}")
        parts.append(F.when(text != "", F.concat(F.lit(f"## {title}\n"), text)))
    return df.withColumns(cleaned).withColumn(out_col, F.concat_ws("\n\n", *parts)).drop(*cleaned)


def standardise(df: DataFrame, ref: str | datetime, *, major_col: str | None = None) -> DataFrame:
    """All row-local standardised columns of a raw listing table, in one projection chain without a shuffle.

    The academic major is a model reply in practice: name its reply column with ``major_col`` and it is parsed.
    """
    context = R.expand_context(["scholarship_name", "description", "eligibility", "scholarship_details"])
    tags = R.normalise_tags("tags", df.schema["tags"].dataType)
    out = df.withColumn("_context", context).withColumn("_tags", tags)
    out = out.withColumn("_funding_text", R.funding_text("funding_type", "_context"))
    out = out.withColumn("funding_amount", R.money("_funding_text"))
    major = R.parse_reply(major_col, "academic_major", K.UNSPECIFIED) if major_col else F.lit(K.UNSPECIFIED)
    return (out
            .withColumn("funding_category", R.funding_category("_funding_text", "funding_amount"))
            .withColumn("academic_level", R.academic_level("_tags", "_context"))
            .withColumn("academic_major", major)
            .withColumn("host_country", R.host_country("_tags", F.coalesce("country", F.lit(""))))
            .withColumn("eligible_nationality", R.target_values("_tags"))
            .withColumn("standardized_deadline", R.standardise_deadline("deadline", "_context"))
            .withColumn("parsed_date", F.try_to_timestamp("standardized_deadline", F.lit("yyyy-MM-dd")))
            .withColumn("is_expired", R.is_expired("parsed_date", ref))
            .withColumn("scholarship_status", R.status("parsed_date", ref))
            .withColumn("application_process", R.impute_short("application_process"))
            .drop("_tags", "_funding_text"))

"""Field standardisation rules as ``Column`` functions; taxonomies come in as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, functions as F, types as T

from . import fixed as K
from .text import alternation, as_col, has_words, is_null_like, let, strip, title_case


def expand_context(cols: Sequence[Column | str], nulls: Sequence[str] = K.CONTEXT_NULLS) -> Column:
    """Join text columns by one space without the null-like ones (compared untrimmed; empty ones stay)."""
    parts = F.array(*[as_col(c) for c in cols])
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & ~F.lower(p).isin(list(nulls))), " ")


def funding_text(col: Column | str, context: Column | str, boilerplate: str = K.FUNDING_BOILERPLATE) -> Column:
    """Lower-cased funding field without its boilerplate phrase, a space, and the lower-cased context."""
    raw = F.lower(F.coalesce(as_col(col), F.lit("")))
    without = F.when(F.contains(raw, F.lit(boilerplate)), strip(F.replace(raw, F.lit(boilerplate)))).otherwise(raw)
    return F.concat(without, F.lit(" "), F.lower(as_col(context)))


def money(col: Column | str, pattern: str = K.MONEY) -> Column:
    """First amount with a currency, or null."""
    return let(F.regexp_extract(as_col(col), f"(?i){pattern}", 1), lambda m: F.when(m != "", strip(m)))


def first_category(col: Column | str, taxonomy: Mapping[str, Sequence[str]], default: str | None) -> Column:
    """First category, in taxonomy order, any of whose terms occurs as a substring."""
    col = as_col(col)
    chain = None
    for category, terms in taxonomy.items():
        hit = F.rlike(col, F.lit(alternation(terms)))
        chain = F.when(hit, category) if chain is None else chain.when(hit, category)
    return chain.otherwise(F.lit(default))


def funding_category(text: Column | str, amount: Column | str) -> Column:
    """An amount beats the keywords."""
    return F.when(as_col(amount).isNotNull(), F.lit(K.FIXED_GRANT)).otherwise(
        first_category(text, K.FUNDING_TAXONOMY, K.FUNDING_DEFAULT))


def split_tags(col: Column | str) -> Column:
    """A bracketed, comma-separated tag string as a lower-cased array; null gives an empty array."""
    parts = F.transform(F.split(as_col(col), ","), lambda t: F.lower(F.btrim(t, F.lit(" '\"[]"))))
    return F.coalesce(parts, F.array().cast("array<string>"))


def lower_tags(col: Column | str) -> Column:
    return F.coalesce(F.transform(as_col(col), lambda t: F.lower(t)), F.array().cast("array<string>"))


def normalise_tags(col: Column | str, dtype: T.DataType | None = None) -> Column:
    """Lower-cased tags from an array column, or (default) from its string form."""
    return lower_tags(col) if isinstance(dtype, T.ArrayType) else split_tags(col)


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def first_mapped_tag(tags: Column | str, mapping: Mapping[str, str] = K.LEVEL_TAGS) -> Column:
    """Mapped value of the first tag, in tag order, that the mapping knows."""
    lookup = literal_map(mapping)
    known = F.filter(F.transform(as_col(tags), lambda t: F.try_element_at(lookup, t)), lambda x: x.isNotNull())
    return F.try_element_at(known, F.lit(1))


def first_phrase(col: Column | str, taxonomy: Mapping[str, Sequence[str]] = K.LEVEL_TAXONOMY) -> Column:
    """Category of the earliest whole-token, case-insensitive phrase; null without one."""
    by_term = {term: category for category, terms in taxonomy.items() for term in terms}
    pattern = rf"(?iU)(?<!\w)({alternation(list(by_term))})(?!\w)"
    return F.try_element_at(literal_map(by_term), F.lower(F.regexp_extract(as_col(col), pattern, 1)))


def academic_level(tags: Column | str, context: Column | str) -> Column:
    return F.coalesce(first_mapped_tag(tags), first_phrase(context), F.lit(K.UNSPECIFIED))


def host_country(tags: Column | str, raw: Column | str, rules=K.HOST_TAGS, raw_value: str = "usa",
                 raw_host: str = "USA") -> Column:
    """Host by tag, then by the exact raw country, else unspecified."""
    tags = as_col(tags)
    chain = F
    for host, names in rules:
        chain = chain.when(F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names])), F.lit(host))
    return chain.when(F.lower(strip(raw)) == raw_value, F.lit(raw_host)).otherwise(F.lit(K.UNSPECIFIED))


def target_values(tags: Column | str, allowed: Sequence[str] = K.TARGET_NATIONALITIES,
                  default: str = K.ANY_NATIONALITY) -> Column:
    """Known values among the tags, title-cased, sorted and joined."""
    found = F.array_intersect(as_col(tags), F.array(*[F.lit(a) for a in allowed]))
    titled = F.array_sort(F.transform(found, lambda x: title_case(x)))
    return F.when(F.size(found) > 0, F.array_join(titled, ", ")).otherwise(F.lit(default))


# Full-date shapes tried in order after normalisation: (shape, pattern).
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "y.M.d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.y"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^[a-z]{3} \d{1,2} \d{4}$", "MMM d y"),
    (r"^[a-z]+ \d{1,2} \d{4}$", "MMMM d y"),
    (r"^\d{1,2} [a-z]{3} \d{4}$", "d MMM y"),
    (r"^\d{1,2} [a-z]+ \d{4}$", "d MMMM y"),
)


CLOCK = (r"(?:,? at)?,?[ t]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[ap]\.?m\.?)?"
         r"(?: ?(?:z|[a-z]{3,4}|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?))?$")


def parse_date(col: Column | str, formats=DATE_FORMATS) -> Column:
    """Strict full-date parse to ``yyyy-MM-dd`` text, or null.

    A leading weekday, commas, ordinal endings, the point of a shortened month and a trailing clock time with its
    zone are ignored; a year of two digits belongs to this century. A date with a missing part is not completed
    from the clock.
    """
    text = F.lower(strip(col))
    text = F.regexp_replace(text, r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? +", "")
    text = F.regexp_replace(text, r"(\d)(?:st|nd|rd|th)\b", "$1")
    text = F.regexp_replace(text, CLOCK, "")
    text = F.regexp_replace(F.regexp_replace(text, r"\bsept\b", "sep"), r"\b([a-z]{3,})\.", "$1 ")
    text = strip(F.regexp_replace(text, r"[ ,]+", " "))

    def first_fit(t):
        return F.coalesce(*[F.when(F.rlike(t, F.lit(shape)), F.try_to_timestamp(F.initcap(t), F.lit(fmt)))
                            for shape, fmt in formats])

    return F.date_format(let(text, first_fit), "yyyy-MM-dd")


def find_date(col: Column | str) -> Column:
    """First ISO date inside a text that is a real date, or null."""
    found = F.regexp_extract(as_col(col), r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    return F.date_format(F.try_to_timestamp(found, F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def standardise_deadline(raw: Column | str, context: Column | str, *, max_len: int = 30,
                         nulls: Sequence[str] = K.DEADLINE_NULLS) -> Column:
    """Short raw values parse strictly; otherwise the first date in the whole labelled text decides."""
    value = strip(F.coalesce(as_col(raw), F.lit("none")))
    useless = F.lower(value).isin(list(nulls))
    labelled = F.when(useless, F.concat(F.lit("Scholarship Details: "), as_col(context))).otherwise(
        F.concat(F.lit("Extracted Text: "), value, F.lit(" | Scholarship Details: "), as_col(context)))
    exact = F.when(~useless & (F.length(value) < max_len), parse_date(value))
    return F.coalesce(exact, find_date(labelled), F.lit(K.NOT_SPECIFIED))


def reference_time(ref: str | datetime) -> Column:
    """The clock as a parameter; a plan never reads the wall clock."""
    return F.lit(str(ref)).cast("timestamp")


def is_expired(date_col: Column | str, ref: str | datetime) -> Column:
    return F.coalesce(as_col(date_col).cast("timestamp") < reference_time(ref), F.lit(False))


def status(date_col: Column | str, ref: str | datetime) -> Column:
    """A deadline on the reference day is already expired unless the reference time is midnight."""
    ts = as_col(date_col).cast("timestamp")
    return (F.when(ts.isNull(), F.lit("Rolling/Unspecified"))
            .when(ts < reference_time(ref), F.lit("Expired"))
            .when(ts >= reference_time(ref), F.lit("Active"))
            .otherwise(F.lit("Unknown")))


def impute_short(col: Column | str, nulls: Sequence[str] = K.STEPS_NULLS, min_words: int = 10,
                 message: str = K.STEPS_FALLBACK) -> Column:
    def imputed(text):
        return F.when(~F.lower(text).isin(list(nulls)) & has_words(text, min_words), text).otherwise(F.lit(message))

    return let(strip(F.coalesce(as_col(col), F.lit(""))), imputed)


def safe_meta(col: Column | str, default: str = K.UNSPECIFIED) -> Column:
    """A non-null string: null-like values give the default."""
    col = as_col(col)
    return F.when(is_null_like(col, K.META_NULLS), F.lit(default)).otherwise(strip(col))


def impute_amount(amount: Column | str, category: Column | str) -> Column:
    category = as_col(category)
    by_category = (F.when(category == "Fully Funded", F.lit("Full Coverage"))
                   .when(category == "Partially Funded", F.lit("Partial Coverage"))
                   .otherwise(F.lit("Variable")))
    amount = as_col(amount)
    return F.when(is_null_like(amount, K.META_NULLS), by_category).otherwise(strip(amount))


def metadata(columns: Sequence[str]) -> Column:
    """The flat metadata struct: ten strings, none null. Columns missing from the input count as null."""
    def pick(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast("string")

    category = safe_meta(pick("funding_category"))
    return F.struct(
        safe_meta(pick("scholarship_name")).alias("scholarship_name"),
        safe_meta(pick("host_country")).alias("host_country"),
        safe_meta(pick("eligible_nationality")).alias("eligible_nationality"),
        safe_meta(pick("academic_level")).alias("academic_level"),
        safe_meta(pick("academic_major")).alias("academic_major"),
        category.alias("funding_category"),
        impute_amount(pick("funding_amount"), category).alias("funding_amount"),
        safe_meta(pick("standardized_deadline")).alias("standardized_deadline"),
        safe_meta(pick("scholarship_status"), "Unknown").alias("scholarship_status"),
        safe_meta(pick("application_link")).alias("application_link"),
    )


def reply_body(col: Column | str) -> Column:
    """The text inside the first code fence (a json fence first), or the whole text."""
    col = as_col(col)
    fenced_json = F.regexp_extract(col, r"(?s)```json(.*?)(?:```|$)", 1)
    fenced = F.regexp_extract(col, r"(?s)```(.*?)(?:```|$)", 1)
    return strip(F.when(F.contains(col, F.lit("```json")), fenced_json)
                 .when(F.contains(col, F.lit("```")), fenced).otherwise(col))


def parse_reply(col: Column | str, key: str, default: str | None, dtype: str = "string") -> Column:
    """One key of a JSON reply; the default on malformed JSON or a missing key."""
    parsed = F.from_json(reply_body(col), f"`{key}` {dtype}")
    return F.coalesce(parsed.getField(key), F.lit(default).cast(dtype))

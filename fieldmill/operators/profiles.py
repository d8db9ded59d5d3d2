"""Profiles: standardisation, validation, keyed upserts and profile text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import as_col, strip, title_case

PROFILE_FIELDS = ("nationality", "academic_level", "academic_major", "gpa", "research_interests",
                  "target_countries", "skills", "age")
# Values of a new profile, and of a search without one.
INSERT_DEFAULTS = {"nationality": "Unknown", "academic_level": "Bachelor", "academic_major": "Unknown", "gpa": 0.0}
EMPTY_FORM = {"nationality": "", "academic_level": "", "academic_major": "", "gpa": None, "research_interests": ""}
SEARCH_DEFAULTS = {**INSERT_DEFAULTS, "research_interests": ""}


def level_synonym(col: Column | str) -> Column:
    """Canonical level by the first matching part, or null: the row is then rejected."""
    v = F.lower(as_col(col))

    def has(*parts):
        return F.rlike(v, F.lit("|".join(parts)))

    return (F.when(has("bachelor", "undergrad", "bsc"), F.lit("Bachelor"))
            .when(has("master", "postgrad", "msc"), F.lit("Master"))
            .when(has("phd", "doctorate"), F.lit("PhD"))
            .when(has("postdoc"), F.lit("Postdoc")))


def standardise_profile(df: DataFrame) -> DataFrame:
    """Trimmed strings, title-cased places and the canonical level in ``level_standard``."""
    out = df.withColumns({c: strip(c) for c in ("nationality", "academic_level", "academic_major",
                                                "research_interests") if c in df.columns})
    out = out.withColumn("nationality", title_case("nationality")).withColumn(
        "level_standard", level_synonym("academic_level"))
    if "target_countries" in df.columns:
        out = out.withColumn("target_countries", F.transform("target_countries", lambda c: title_case(strip(c))))
    return out


def profile_errors() -> Column:
    """Names of the broken rules of a standardised profile, in a fixed order."""
    rules = [
        (F.col("nationality").isNull(), "nationality missing"),
        (F.col("academic_level").isNull(), "academic_level missing"),
        (F.col("academic_level").isNotNull() & F.col("level_standard").isNull(), "academic_level unknown"),
        (F.col("academic_major").isNull(), "academic_major missing"),
        (F.col("gpa").isNull(), "gpa missing"),
        ((F.col("gpa") < 0) | (F.col("gpa") > 100), "gpa out of range"),
        ((F.col("age") < 16) | (F.col("age") > 65), "age out of range"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]), lambda e: e.isNotNull())


def validate_profile(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): the valid ones carry the canonical level, the rejected ones their errors."""
    checked = standardise_profile(df).withColumn("errors", profile_errors())
    valid = checked.filter(F.size("errors") == 0).withColumn("academic_level", F.col("level_standard"))
    return valid.drop("level_standard", "errors"), checked.filter(F.size("errors") > 0).drop("level_standard")


def latest_fields(changes: DataFrame, fields: Sequence[str], *, key: str = "session_id", seq: str = "seq",
                  set_fields: str | None = "set_fields") -> DataFrame:
    """Per key and field the value last set, and whether it was set at all.

    ``set_fields`` lists the fields a change carries, so an explicit null overwrites and an absent field keeps;
    without it a null means absent. One mergeable aggregation: a key with very many changes combines in the map.
    """
    aggs = []
    for f in fields:
        is_set = F.array_contains(set_fields, f) if set_fields else F.col(f).isNotNull()
        at = F.when(is_set, F.col(seq))
        aggs += [F.max_by(F.col(f), at).alias(f), (F.max(at).isNotNull()).alias(f"{f}_set")]
    return changes.groupBy(key).agg(*aggs)


def upsert_profiles(current: DataFrame | None, changes: DataFrame, fields: Sequence[str] = PROFILE_FIELDS, *,
                    key: str = "session_id", seq: str = "seq", set_fields: str | None = "set_fields",
                    defaults: Mapping[str, object] = INSERT_DEFAULTS) -> DataFrame:
    """Apply a change log to a keyed table: set fields overwrite, others keep, new keys start from defaults."""
    new = latest_fields(changes, fields, key=key, seq=seq, set_fields=set_fields)

    def default(f):
        return F.lit(defaults.get(f)).cast(changes.schema[f].dataType)

    if current is None:
        return new.select(key, *[F.when(F.col(f"{f}_set"), F.col(f)).otherwise(default(f)).alias(f) for f in fields])
    old, fresh = current.select(key, *fields, F.lit(True).alias("known")).alias("old"), new.alias("new")
    out = old.join(fresh, key, "full")
    kept = {f: F.when(F.col("old.known"), F.col(f"old.{f}")).otherwise(default(f)) for f in fields}
    return out.select(key, *[
        F.when(F.coalesce(F.col(f"new.{f}_set"), F.lit(False)), F.col(f"new.{f}")).otherwise(kept[f]).alias(f)
        for f in fields])


def profiles_or_default(sessions: DataFrame, profiles: DataFrame, fields: Sequence[str] = PROFILE_FIELDS, *,
                        key: str = "session_id", defaults: Mapping[str, object] = EMPTY_FORM) -> DataFrame:
    """Every session with its profile; defaults and ``is_new_user`` where none is stored."""
    stored = profiles.select(key, *fields, F.lit(True).alias("_known"))
    out = sessions.select(key).join(stored, key, "left")
    new = F.col("_known").isNull()

    def default(f):
        kind = profiles.schema[f].dataType
        return F.array().cast(kind) if kind.typeName() == "array" else F.lit(defaults.get(f)).cast(kind)

    return out.select(key, *[F.when(new, default(f)).otherwise(F.col(f)).alias(f) for f in fields],
                      new.alias("is_new_user"))


def shown_value(col: str, dtype) -> Column:
    return F.array_join(col, ", ") if dtype.typeName() == "array" else F.col(col).cast("string")


def profile_text(df: DataFrame, style: str = "list", fields: Sequence[str] = PROFILE_FIELDS,
                 out_col: str = "profile_text") -> DataFrame:
    """Profile as text. ``list``: one line per non-empty field; ``facts``: every field under a heading;
    ``line``: the fixed short form used for answers."""
    if style == "line":
        text = F.concat(
            F.lit("Major: "), F.coalesce("academic_major", F.lit("None")), F.lit(", Level: "),
            F.coalesce("academic_level", F.lit("None")), F.lit(", Nationality: "),
            F.coalesce("nationality", F.lit("None")),
            F.when(F.coalesce("research_interests", F.lit("")) != "",
                   F.concat(F.lit("\nInterests: "), F.col("research_interests"))).otherwise(F.lit("")))
        return df.withColumn(out_col, text)
    lines = []
    for f in fields:
        dtype = df.schema[f].dataType
        title, value = f.replace("_", " ").title(), shown_value(f, dtype)
        if style == "facts":
            lines.append(F.concat(F.lit(f"- {title}: "), F.coalesce(value, F.lit("None"))))
        else:
            full = F.size(f) > 0 if dtype.typeName() == "array" else (
                F.col(f) != ("" if dtype.typeName() == "string" else 0))
            lines.append(F.when(full, F.concat(F.lit(f"- {title}: "), value)))
    text = F.concat_ws("\n", *lines)
    if style == "facts":
        text = F.concat(F.lit("Student Profile Information:\n"), text)
    return df.withColumn(out_col, text)

"""Explicit table schemas; nothing is inferred."""

from pyspark.sql import types as T

RAW_LISTING = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "scholarship_name", "country", "degree_level", "funding_type", "awards_available", "deadline")]
    + [T.StructField("tags", T.ArrayType(T.StringType()))]
    + [T.StructField(name, T.StringType()) for name in (
        "description", "scholarship_details", "eligibility", "application_process", "application_link")]
)

METADATA_FIELDS = (
    "scholarship_name", "host_country", "eligible_nationality", "academic_level", "academic_major",
    "funding_category", "funding_amount", "standardized_deadline", "scholarship_status", "application_link",
)

METADATA = T.StructType([T.StructField(name, T.StringType(), False) for name in METADATA_FIELDS])

PROFILE = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("nationality", T.StringType()),
    T.StructField("academic_level", T.StringType()),
    T.StructField("academic_major", T.StringType()),
    T.StructField("gpa", T.DoubleType()),
    T.StructField("target_countries", T.ArrayType(T.StringType())),
    T.StructField("research_interests", T.StringType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("age", T.IntegerType()),
])

CHAT_MESSAGE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

EVAL_CASE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("contexts", T.ArrayType(T.StringType())),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("student_profile", T.StringType()),
])

"""Profiles, sessions and context assembly (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat as H, profiles as P
from . import retrieval as RT
from .base import check
from .snippets import strip, title

RAW = """
SELECT 's' || CAST(c_custkey AS STRING) AS session_id,
  CASE c_custkey % 4 WHEN 0 THEN ' cote d' || chr(39) || 'ivoire ' WHEN 1 THEN 'SAUDI arabia' WHEN 2 THEN 'nation_' || CAST(c_nationkey AS STRING) ELSE CAST(NULL AS STRING) END AS nationality,
  CASE c_custkey % 9 WHEN 0 THEN ' BSc honours' WHEN 1 THEN 'Undergrad' WHEN 2 THEN 'msc' WHEN 3 THEN 'Postgraduate' WHEN 4 THEN 'PhD student'
    WHEN 5 THEN 'postdoctorate' WHEN 6 THEN 'PostDoc' WHEN 7 THEN 'diploma' ELSE 'Bachelor of master studies' END AS academic_level,
  ' ' || c_mktsegment || ' ' AS academic_major, c_acctbal / 90 AS gpa,
  CASE WHEN c_custkey % 6 = 0 THEN CAST(NULL AS INT) ELSE CAST(12 + c_custkey % 60 AS INT) END AS age,
  split('new zealand, guinea-bissau', ',') AS target_countries, CAST(NULL AS STRING) AS research_interests
FROM {customer}
"""
LEVEL = """CASE WHEN regexp_matches(lower(academic_level), 'bachelor|undergrad|bsc') THEN 'Bachelor' WHEN regexp_matches(lower(academic_level), 'master|postgrad|msc') THEN 'Master'
  WHEN regexp_matches(lower(academic_level), 'phd|doctorate') THEN 'PhD' WHEN regexp_matches(lower(academic_level), 'postdoc') THEN 'Postdoc' END"""


def raw(t):
    return t.sql(RAW)


@check("g1_standardise_profile", f"""
SELECT session_id, {title(strip('nationality'))} AS nationality, {strip('academic_level')} AS academic_level, {strip('academic_major')} AS academic_major,
  array_to_string(list_transform(target_countries, lambda c: {title(strip('c'))}), '|') AS target_countries FROM ({RAW}) AS r""")
def g1(t):
    out = P.standardise_profile(raw(t))
    return out.select("session_id", "nationality", "academic_level", "academic_major",
                      F.array_join("target_countries", "|").alias("target_countries"))


@check("g2_level_synonym", f"SELECT session_id, {LEVEL} AS level FROM ({RAW}) AS r")
def g2(t):
    return raw(t).select("session_id", P.level_synonym("academic_level").alias("level"))


ERRORS = f"""array_to_string(list_filter([CASE WHEN nationality IS NULL THEN 'nationality missing' END,
  CASE WHEN academic_level IS NOT NULL AND {LEVEL} IS NULL THEN 'academic_level unknown' END,
  CASE WHEN gpa < 0 OR gpa > 100 THEN 'gpa out of range' END, CASE WHEN age < 16 OR age > 65 THEN 'age out of range' END], lambda e: e IS NOT NULL), '|')"""


@check("g3_valid_profiles", f"SELECT session_id, {LEVEL} AS academic_level, gpa, age FROM ({RAW}) AS r WHERE {ERRORS} = ''")
def g3(t):
    return P.validate_profile(raw(t))[0].select("session_id", "academic_level", "gpa", "age")


@check("g3_rejected_profiles", f"SELECT session_id, {ERRORS} AS errors FROM ({RAW}) AS r WHERE {ERRORS} <> ''")
def g3_rejected(t):
    return P.validate_profile(raw(t))[1].select("session_id", F.array_join("errors", "|").alias("errors"))


# Change log: one event is one change of a user's profile.
CHANGES = """
SELECT 'u' || CAST(user_id AS STRING) AS session_id, event_id AS seq,
  CASE WHEN event_id % 4 = 0 THEN CAST(NULL AS STRING) ELSE event_type END AS nationality,
  CASE WHEN event_id % 3 = 0 THEN 'Master' ELSE 'PhD' END AS academic_level, value AS gpa,
  CASE event_type WHEN 'click' THEN split('nationality,gpa', ',') WHEN 'view' THEN split('nationality', ',') WHEN 'error' THEN split('gpa', ',') ELSE split('academic_level', ',') END AS set_fields
FROM {events}
"""
FIELDS = ("nationality", "academic_level", "gpa")
CURRENT = "SELECT 'u' || CAST(c_custkey AS STRING) AS session_id, c_mktsegment AS nationality, 'Bachelor' AS academic_level, c_acctbal AS gpa FROM {customer}"


def _latest(f: str) -> str:
    return f"arg_max({{'v': {f}}}, seq) FILTER (list_contains(set_fields, '{f}')) AS {f}"


SQL_LATEST = f"SELECT session_id, {', '.join(_latest(f) for f in FIELDS)} FROM ({CHANGES}) AS c GROUP BY 1"
INSERTED = {"nationality": "'Unknown'", "academic_level": "'Bachelor'", "gpa": "0.0"}


@check("g4_upsert_new", f"WITH l AS ({SQL_LATEST}) SELECT session_id, " + ", ".join(
    f"CASE WHEN {f} IS NULL THEN {INSERTED[f]} ELSE {f}.v END AS {f}" for f in FIELDS) + " FROM l")
def g4_new(t):
    return P.upsert_profiles(None, t.sql(CHANGES), FIELDS)


@check("g4_upsert_merge", f"WITH l AS ({SQL_LATEST}), c AS ({CURRENT}) SELECT coalesce(l.session_id, c.session_id) AS session_id, " + ", ".join(
    f"CASE WHEN l.{f} IS NOT NULL THEN l.{f}.v WHEN c.session_id IS NOT NULL THEN c.{f} ELSE {INSERTED[f]} END AS {f}" for f in FIELDS)
    + " FROM l FULL JOIN c ON l.session_id = c.session_id")
def g4_merge(t):
    return P.upsert_profiles(t.sql(CURRENT), t.sql(CHANGES), FIELDS)


SESSIONS = "SELECT DISTINCT 's' || CAST(user_id * 7 AS STRING) AS session_id FROM {events}"


@check("g5_profile_or_default", f"""
SELECT s.session_id, coalesce(nationality, CASE WHEN p.session_id IS NULL THEN '' END) AS nationality, coalesce(academic_level, CASE WHEN p.session_id IS NULL THEN '' END) AS academic_level,
  gpa, coalesce(array_to_string(skills, '|'), '') AS skills, age, p.session_id IS NULL AS is_new_user FROM ({SESSIONS}) AS s LEFT JOIN {{profiles}} AS p ON p.session_id = s.session_id""")
def g5(t):
    out = P.profiles_or_default(t.sql(SESSIONS), t.profiles)
    return out.select("session_id", "nationality", "academic_level", "gpa", F.array_join("skills", "|").alias("skills"), "age", "is_new_user")


LAST6 = """SELECT session_id, id, role, content, row_number() OVER (PARTITION BY session_id ORDER BY id) AS position
FROM (SELECT * FROM {chat} AS c QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 6) AS x"""


@check("g6_chat_history", LAST6)
def g6(t):
    return H.last_n(t.chat.drop("turn"), "session_id", ["id"])


KNOWN = "SELECT DISTINCT session_id FROM {chat} AS c WHERE turn > 5"


@check("g7_sessions_to_create", f"SELECT DISTINCT session_id FROM {{chat}} AS c WHERE session_id NOT IN ({KNOWN})")
def g7(t):
    return H.sessions_to_create(t.chat, t.sql(KNOWN))


@check("g7_append_messages", "SELECT session_id, count(*) AS n FROM {chat} AS c GROUP BY 1")
def g7_append(t):
    chat = t.chat
    log, sessions = H.append_messages(chat.filter("turn > 2"), chat.filter("turn <= 2"), t.sql(KNOWN))
    return sessions.join(log, "session_id").groupBy("session_id").agg(F.count("*").alias("n"))


TRANSCRIPT = f"""SELECT session_id, string_agg(upper(role[1:1]) || lower(role[2:]) || ': ' || content || chr(10), '' ORDER BY position) AS transcript
FROM ({LAST6}) AS h GROUP BY session_id"""


@check("g8_transcript", TRANSCRIPT)
def g8(t):
    return H.transcript(t.chat, order=["id"])


@check("g9_profile_text", """
SELECT session_id, concat_ws(chr(10), '- Nationality: ' || nationality, '- Academic Level: ' || academic_level, '- Academic Major: ' || academic_major,
    CASE WHEN research_interests <> '' THEN '- Research Interests: ' || research_interests END, '- Target Countries: ' || array_to_string(target_countries, ', '),
    '- Skills: ' || array_to_string(skills, ', '), CASE WHEN age <> 0 THEN '- Age: ' || CAST(age AS STRING) END) AS listed,
  'Major: ' || academic_major || ', Level: ' || academic_level || ', Nationality: ' || nationality ||
    CASE WHEN coalesce(research_interests, '') <> '' THEN chr(10) || 'Interests: ' || research_interests ELSE '' END AS line,
  'Student Profile Information:' || chr(10) || '- Nationality: ' || nationality || chr(10) || '- Age: ' || coalesce(CAST(age AS STRING), 'None') AS facts FROM {profiles} AS p""")
def g9(t):
    fields = [f for f in P.PROFILE_FIELDS if f != "gpa"]
    out = P.profile_text(t.profiles, "list", fields, "listed")
    out = P.profile_text(out, "line", out_col="line")
    return P.profile_text(out, "facts", ["nationality", "age"], "facts").select("session_id", "listed", "line", "facts")


CONTEXT = RT.HITS + """, low AS (SELECT scholarship_name, arg_min({'v': application_process}, item_id) AS ap FROM i GROUP BY 1),
  blocks AS (SELECT query_id, rank, chr(10) || '### Scholarship: ' || scholarship_name || chr(10) || '- Host Country: ' || host_country || chr(10) || '- Funding Category: ' || funding_category
    || chr(10) || '- Amount: ' || coalesce(funding_amount, 'Not specified') || chr(10) || '- Deadline: ' || standardized_deadline || chr(10) || '- Link: ' || application_link
    || chr(10) || chr(10) || 'Description:' || chr(10) || text || chr(10) || chr(10) || 'Application Process:' || chr(10)
    || coalesce(ap.v, 'No specific application steps provided.') || chr(10) AS block FROM hits LEFT JOIN low USING (scholarship_name)),
  ctx AS (SELECT query_id, string_agg(block, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY 1)"""


@check("g10_context_blocks", CONTEXT + " SELECT query_id, context FROM ctx")
def g10(t):
    return H.context_blocks(RT.stored_hits(t), t.items)


@check("g11_chat_prompts", f"""
WITH tr AS ({TRANSCRIPT}) SELECT c.session_id, 'Be brief.' || chr(10) || chr(10) || 'STUDENT PROFILE:' || chr(10) || 'Major: ' || academic_major || ', Level: ' || academic_level || ', Nationality: ' || nationality ||
    CASE WHEN coalesce(research_interests, '') <> '' THEN chr(10) || 'Interests: ' || research_interests ELSE '' END || chr(10) || chr(10)
  || 'CHAT HISTORY:' || chr(10) || transcript || chr(10) || chr(10) || 'RETRIEVED SCHOLARSHIPS CONTEXT:' || chr(10) || chr(10) || chr(10) || 'REQUESTED ACTION (INTENT):' || chr(10)
  || CASE WHEN c_custkey % 2 = 0 THEN 'compare' ELSE 'General Conversation' END || chr(10) || chr(10) || 'CURRENT MESSAGE:' || chr(10) || 'next step?' AS prompt
FROM tr AS c JOIN customer ON 'c' || CAST(c_custkey AS STRING) = c.session_id JOIN {{profiles}} AS p ON p.session_id = 's' || CAST(c_custkey AS STRING)""")
def g11(t):
    keyed = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("session_id"),
                              F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("profile_id"),
                              F.when(F.col("c_custkey") % 2 == 0, F.lit("compare")).alias("intent"))
    profiles = P.profile_text(t.profiles, "line").select(F.col("session_id").alias("profile_id"), "profile_text")
    rows = g8(t).join(keyed, "session_id").join(profiles, "profile_id").withColumn("query", F.lit("next step?"))
    return H.prompts(rows, instructions="Be brief.").select("session_id", "prompt")


@check("g11_answer_prompts", CONTEXT + """
SELECT query_id, 'Student Profile:' || chr(10) || chr(10) || chr(10) || 'Student''s Query:' || chr(10) || query || chr(10) || chr(10)
  || 'Retrieved Scholarships Context:' || chr(10) || context AS prompt FROM ctx JOIN queries USING (query_id)""")
def g11_answer(t):
    return H.prompts(g10(t).join(RT.bench_queries(t), "query_id"), H.ANSWER_SECTIONS).select("query_id", "prompt")


@check("g11_letter_prompts", """
SELECT session_id, 'Write a ' || CASE WHEN item_id % 2 = 0 THEN 'letter' ELSE 'email' END || ' for a scholarship application. Tone: ' || CASE WHEN item_id % 3 = 0 THEN 'formal' ELSE 'warm' END || '.'
  || chr(10) || chr(10) || 'STUDENT PROFILE:' || chr(10) || 'Major: ' || p.academic_major || ', Level: ' || p.academic_level || ', Nationality: ' || nationality
  || CASE WHEN coalesce(research_interests, '') <> '' THEN chr(10) || 'Interests: ' || research_interests ELSE '' END
  || chr(10) || chr(10) || 'SCHOLARSHIP DETAILS:' || chr(10) || coalesce(scholarship_details, '') || chr(10) || chr(10)
  || 'ADDITIONAL NOTES (Key points to include):' || chr(10) || CASE WHEN item_id % 4 = 0 THEN 'Mention ' || host_country ELSE '' END AS prompt
FROM {profiles} AS p JOIN {items} AS i ON session_id = 's' || CAST(item_id AS STRING)""")
def g11_letter(t):
    asked = t.items.select(F.concat(F.lit("s"), F.col("item_id").cast("string")).alias("session_id"), F.col("scholarship_details").alias("details"),
                           F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("Mention "), "host_country")).alias("notes"),
                           F.when(F.col("item_id") % 2 == 0, "letter").otherwise("email").alias("kind"),
                           F.when(F.col("item_id") % 3 == 0, "formal").otherwise("warm").alias("tone"))
    rows = P.profile_text(t.profiles, "line").select("session_id", "profile_text").join(asked, "session_id")
    return H.prompts(rows, H.LETTER_SECTIONS, instructions=H.letter_instructions("tone", "kind")).select("session_id", "prompt")

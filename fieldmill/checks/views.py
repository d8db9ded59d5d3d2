"""Views over the given tables that stand in for listings, items, profiles, requests and chat.

Written in SQL that Spark and the oracle read alike, so both sides start from the same rows.
"""

LISTINGS = """
SELECT d.doc_id AS item_id,
  CASE WHEN d.doc_id % 29 = 7 THEN CAST(NULL AS STRING) WHEN d.doc_id % 29 = 8 THEN 'N/A'
       ELSE p.p_name || ' ' || p.p_brand || ' grant' END AS scholarship_name,
  CASE p.p_size % 4 WHEN 0 THEN 'USA' WHEN 1 THEN 'Austin, TX ' || CAST(d.doc_id AS STRING) || ' (USA)'
       WHEN 2 THEN ' usa ' ELSE 'Germany' END AS country,
  p.p_type AS degree_level,
  CASE p.p_size % 6 WHEN 0 THEN 'Fully/Partially Funded (Check Details)'
       WHEN 1 THEN '$' || CAST(p.p_size AS STRING) || ',000.50 per year' WHEN 2 THEN 'Partial tuition discount'
       WHEN 3 THEN 'N/A' WHEN 4 THEN '25000 euros' ELSE CAST(NULL AS STRING) END AS funding_type,
  CASE WHEN p.p_size % 2 = 0 THEN 'Varies' ELSE CAST(p.p_size AS STRING) END AS awards_available,
  CASE d.doc_id % 9 WHEN 0 THEN 'Not Specified' WHEN 1 THEN 'Varies'
       WHEN 2 THEN '2025-' || lpad(CAST(1 + d.doc_id % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0')
       WHEN 3 THEN 'March ' || CAST(1 + d.doc_id % 31 AS STRING) || ', 2026'
       WHEN 4 THEN 'Applications close on 2026-02-' || lpad(CAST(1 + d.doc_id % 30 AS STRING), 2, '0') || ', please submit early'
       WHEN 5 THEN 'Rolling' WHEN 6 THEN CAST(NULL AS STRING) WHEN 7 THEN 'N/A' ELSE '12/31/2025' END AS deadline,
  CASE d.doc_id % 6 WHEN 0 THEN '["DAAD", "Egypt", "Graduates", "Germany"]' WHEN 1 THEN '["Undergraduates", "Graduates", "USA"]'
       WHEN 2 THEN '["Saudi Arabia", "Jordan", "Doctoral/PhD"]' WHEN 3 THEN 'College Selection' WHEN 4 THEN '[]'
       ELSE CAST(NULL AS STRING) END AS tags,
  CASE WHEN d.doc_id % 11 = 3 THEN d.text WHEN d.doc_id % 11 = 4 THEN '' ELSE 'The ' || p.p_name || ' programme '
       || CASE p.p_size % 5 WHEN 0 THEN 'offers full tuition and a monthly stipend' WHEN 1 THEN 'covers tuition only with a fee reduction'
          WHEN 2 THEN 'pays a lump sum' WHEN 3 THEN 'supports travel' ELSE 'gives health insurance' END
       || CASE d.doc_id % 4 WHEN 0 THEN ' to every master student' WHEN 1 THEN ' to undergraduate and graduate readers'
          WHEN 2 THEN ' to a post-doc or to masters' ELSE ' to all applicants' END
       || ' who wants to study in NATION_' || CAST(d.doc_id % 25 AS STRING) || '.' END AS description,
  CASE WHEN d.doc_id % 13 = 5 THEN 'N/A' ELSE '<p>' || d.text || '</p>' || chr(10) || chr(10) || chr(10) || chr(10)
       || 'Visit https://x.example/' || CAST(d.doc_id AS STRING) || ' or write to a' || CAST(d.doc_id AS STRING)
       || '@x.example ---- Click here  •' || chr(10) || 'apply' END AS scholarship_details,
  CASE WHEN d.doc_id % 17 = 1 THEN CAST(NULL AS STRING) WHEN d.doc_id % 17 < 9 THEN 'Not Eligible for this round'
       ELSE 'Open to citizens of NATION_' || CAST((d.doc_id + 3) % 25 AS STRING) || ' with a passport from NATION_'
       || CAST((d.doc_id + 9) % 25 AS STRING) || ', see [https://apply.example/' || CAST(d.doc_id AS STRING) || '] and ['
       || 'https://help.example/a] for the rules of ' || p.p_brand END AS eligibility,
  CASE d.doc_id % 5 WHEN 0 THEN 'TBA' WHEN 1 THEN 'Send an email' WHEN 2 THEN CAST(NULL AS STRING) WHEN 3 THEN '  N/A '
       ELSE ' First collect your papers, then fill in the form at [https://help.example/a] and post both to us ' END AS application_process,
  CASE WHEN d.doc_id % 7 = 6 THEN CAST(NULL AS STRING) ELSE 'https://x.example/' || CAST(d.doc_id % 500 AS STRING) END AS application_link,
  CASE WHEN d.source IN ('src0', 'src1') THEN 'DAAD_' ELSE '' END || d.source || '_scholarships_data.json' AS source_file,
  d.lang AS lang
FROM {documents} AS d JOIN {part} AS p ON p.p_partkey = d.doc_id
"""

ITEMS = """
SELECT d.doc_id AS item_id, 'Grant ' || CAST(d.doc_id % 400 AS STRING) AS scholarship_name,
  'NATION_' || CAST(d.doc_id % 25 AS STRING) AS host_country,
  CASE d.doc_id % 7 WHEN 0 THEN 'International / All' WHEN 1 THEN 'Unspecified'
       WHEN 2 THEN 'NATION_' || CAST(d.doc_id % 25 AS STRING) || ', NATION_' || CAST(d.doc_id % 11 AS STRING)
       ELSE 'NATION_' || CAST(d.doc_id % 25 AS STRING) END AS eligible_nationality,
  CASE d.doc_id % 4 WHEN 0 THEN 'Undergraduates' WHEN 1 THEN 'Graduates' WHEN 2 THEN 'Doctoral/PhD' ELSE 'Unspecified' END AS academic_level,
  d.lang AS academic_major,
  CASE d.doc_id % 3 WHEN 0 THEN 'Fully Funded' WHEN 1 THEN 'Partially Funded' ELSE 'Fixed Grant' END AS funding_category,
  CASE d.doc_id % 6 WHEN 2 THEN '$' || CAST(d.n_chars AS STRING) WHEN 3 THEN ' nan ' ELSE CAST(NULL AS STRING) END AS funding_amount,
  CASE WHEN d.doc_id % 3 = 1 THEN 'Not Specified' ELSE '2025-' || lpad(CAST(1 + d.doc_id % 12 AS STRING), 2, '0') || '-15' END AS standardized_deadline,
  CASE WHEN l.quality = 0 THEN 'Expired' WHEN l.quality = 1 THEN 'Active' WHEN d.doc_id % 2 = 0 THEN 'Rolling/Unspecified'
       ELSE CAST(NULL AS STRING) END AS scholarship_status,
  'https://x.example/' || CAST(d.doc_id AS STRING) AS application_link,
  CASE WHEN d.doc_id % 4 = 3 THEN CAST(NULL AS STRING) ELSE 'Apply in ' || CAST(1 + d.doc_id % 5 AS STRING) || ' steps' END AS application_process,
  'About ' || CAST(d.doc_id AS STRING) AS description, d.text AS scholarship_details, d.source AS eligibility, d.text AS text
FROM {documents} AS d LEFT JOIN {labels} AS l ON l.doc_id = d.doc_id
"""

PROFILES = """
SELECT 's' || CAST(c_custkey AS STRING) AS session_id, 'NATION_' || CAST(c_nationkey AS STRING) AS nationality,
  CASE c_custkey % 5 WHEN 0 THEN 'Bachelor' WHEN 1 THEN 'Master' WHEN 2 THEN 'PhD' WHEN 3 THEN 'Postdoc' ELSE 'Other' END AS academic_level,
  c_mktsegment AS academic_major, c_acctbal / 50 AS gpa,
  CASE WHEN c_custkey % 3 = 0 THEN 'topic ' || c_mktsegment WHEN c_custkey % 3 = 1 THEN '' ELSE CAST(NULL AS STRING) END AS research_interests,
  split('germany,new zealand', ',') AS target_countries,
  split('sql,' || lower(c_mktsegment), ',') AS skills,
  CASE WHEN c_custkey % 6 = 0 THEN CAST(NULL AS INT) ELSE CAST(12 + c_custkey % 60 AS INT) END AS age
FROM {customer}
"""

REQUESTS = """
SELECT b.item_id AS query_id, 's' || CAST(b.item_id AS STRING) AS session_id,
  CASE b.item_id % 4 WHEN 0 THEN b.text || ' fully funded' WHEN 1 THEN 'About DAAD: ' || b.text
       WHEN 2 THEN ' Partial funding ' || b.text ELSE b.text END AS query
FROM {benchmark} AS b
"""

CHAT = """
SELECT conv_id * 100 + turn AS id, 'c' || CAST(conv_id AS STRING) AS session_id, role, text AS content, turn
FROM {conversations}
"""

VIEWS = {"listings": LISTINGS, "items": ITEMS, "profiles": PROFILES, "requests": REQUESTS, "chat": CHAT}

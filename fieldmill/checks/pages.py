"""Page extraction (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import Step
from ..operators import pages as P
from .base import check
from .snippets import WS, strip as sql_strip

ROOT = "https://site.example"
ENTITIES = [("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&copy;?", "©"),
            ("&middot;?", "·"), ("&amp;?", "&")]


#: References of all kinds with what they stand for, stated here on their own.
REFERENCES = [("&eacute;", "é"), ("&#233;", "é"), ("&#xE9;", "é"), ("&#8217;", "’"), ("&ndash;", "–"), ("&euro;", "€"), ("&Omega;", "Ω"),
              ("&#x1F393;", "🎓"), ("&copy", "©"), ("&#150;", "–"), ("&amp;lt;", "&lt;"), ("&bogus;", "&bogus;"), ("&notin;", "∉")]


def by_page(values) -> str:
    """One of the values by page number, in SQL that both engines read."""
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"(CASE page_id % {len(values)} {cases} END)"


REF, CHAR = (by_page([pair[k] for pair in REFERENCES]) for k in (0, 1))
ID = "CAST(page_id AS STRING)"


def sql_decode(x: str) -> str:
    x = f"regexp_replace({x}, '&nbsp;?', chr(160), 'g')"
    for name, char in ENTITIES:
        x = f"regexp_replace({x}, '{name}', '{char}', 'g')"
    return x


@check("b1_harvest_links", f"""
WITH found AS (SELECT page_id, list_transform(regexp_extract_all(html, '<a\\b[^>]*\\bhref="[^"]+"'),
        lambda a: regexp_extract(a, 'href="([^"]+)"', 1)) AS hrefs FROM pages),
  places AS (SELECT page_id, unnest(hrefs) AS href, unnest(generate_series(0, len(hrefs) - 1)) AS pos FROM found WHERE len(hrefs) > 0),
  links AS (SELECT CASE WHEN href LIKE '/%' THEN '{ROOT}' || href ELSE href END AS link, page_id, pos FROM places),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) AS rn, count(*) OVER (PARTITION BY link) AS n FROM links)
SELECT link, page_id AS first_page, CAST(pos AS INT) AS first_pos, n AS n_places FROM ranked WHERE rn = 1""")
def b1(t):
    return P.harvest_links(t.pages, ROOT)


@check("b1_list_links", f"""
WITH items AS (SELECT page_id, flatten(list_transform(regexp_extract_all(html, '(?is)<nav(?:\\s[^>]*)?>(.*?)</nav>', 1),
        lambda n: regexp_extract_all(n, '(?is)<li(?:\\s[^>]*)?>(.*?)</li>', 1))) AS lis FROM pages),
  found AS (SELECT page_id, list_transform(list_filter(lis, lambda x: contains(x, 'href="')), lambda x: regexp_extract(x, 'href="([^"]+)"', 1)) AS hrefs FROM items),
  places AS (SELECT page_id, unnest(hrefs) AS href, unnest(generate_series(0, len(hrefs) - 1)) AS pos FROM found WHERE len(hrefs) > 0),
  links AS (SELECT CASE WHEN href LIKE '/%' THEN '{ROOT}' || href ELSE href END AS link, page_id, pos FROM places),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) AS rn, count(*) OVER (PARTITION BY link) AS n FROM links)
SELECT link, page_id AS first_page, CAST(pos AS INT) AS first_pos, n AS n_places FROM ranked WHERE rn = 1""")
def b1_list(t):
    return P.harvest_links(t.pages, ROOT, within=[Step("nav"), Step("ul"), Step("li"), Step("a")])


def sql_first(tag: str) -> str:
    inner = f"regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)"
    text = sql_strip(sql_decode(f"regexp_replace({inner}, '<[^>]+>', '', 'g')"))
    return f"CASE WHEN {text} = '' THEN 'N/A' ELSE {text} END"


@check("b2_page_titles", f"SELECT page_id, url, {sql_first('h1')} AS h1, {sql_first('title')} AS title FROM pages")
def b2_native(t):
    return P.page_titles(t.pages)


# what the fields of a page say, by its number and a reference; {r} is the reference or its character
SAID = {
    "amount": "'$' || " + ID + " || ' {r}'", "date": "'May ' || " + ID + " || ' {r}'", "awards": "CAST(page_id % 40 AS STRING)",
    "tag1": "'Level {r} ' || CAST(page_id % 7 AS STRING)", "tag2": "'Land ' || CAST(page_id % 11 AS STRING)", "first": "'Aim ' || " + ID,
    "second": "'{r}all'", "details": "'Details of ' || " + ID + " || ' {r}'", "one": "'one ' || " + ID, "two": "'two {r}'",
    "steps": "'Step ' || CAST(page_id % 5 AS STRING)"}


def said(name: str, ref: str) -> str:
    return "(" + SAID[name].replace("{r}", "' || " + ref + " || '") + ")"


def _with_fields(t, labels):
    """Pages with the blocks the sibling lookups read, all of them different from page to page; without ``labels`` a
    third of them has a single h5. Not every page has all parts."""
    x = {name: said(name, REF) for name in SAID}
    block = f"""'<h5>' || {x['amount']} || '</h5>' || CASE WHEN page_id % 3 > 0 THEN '<h5>' || {x['date']} || '</h5>' ELSE '' END"""
    if labels:
        block += f""" || '<div class="n' || {ID} || '"><div><span>Awards Available:</span></div><h5> ' || {x['awards']} || ' </h5></div><h5>Qualified Based On:</h5>'
          || '<div><div>' || {x['tag1']} || '</div>' || CASE WHEN page_id % 4 > 0 THEN '<div> <i>' || {x['tag2']} || '</i></div>' ELSE '' END || '</div>'"""
    block += f""" || '<h2>Scholarship Description</h2><div><p> ' || {x['first']} || ' <b>' || {x['second']} || '</b></p><h2>Details</h2><p>' || {x['details']} || '</p>'
      || '<h2>Eligibility</h2><ul><li>' || {x['one']} || '</li><li>' || {x['two']} || '</li></ul>'
      || CASE WHEN page_id % 5 = 0 THEN '<h2>Application Process</h2><section><p>' || {x['steps']} || '</p></section>' ELSE '' END || '</div>'
      || '<div class="contactDetail">Office<br>Austin, TX ' || {ID} || '</div>'"""
    return t.sql(f"SELECT page_id, url, {block} || html AS html FROM {{pages}}")


def _fields_sql(amount: str, deadline: str, awards: str, tags: str) -> str:
    y = {name: said(name, CHAR) for name in SAID}
    return f"""
SELECT page_id, {sql_first('h1')} AS scholarship_name, {amount} AS funding_type, {deadline} AS deadline, {awards} AS awards_available,
  {tags} AS tags, {y['first']} || {y['second']} AS description, {y['details']} AS scholarship_details, {y['one']} || chr(10) || {y['two']} AS eligibility,
  CASE WHEN page_id % 5 = 0 THEN {y['steps']} ELSE 'N/A' END AS application_process, 'Austin, TX ' || {ID} || ' (USA)' AS country FROM pages"""


def _fields(t, strict):
    out = P.extract_fields(_with_fields(t, labels=not strict), strict_pair=strict)
    out = out.withColumn("country", P.location("contact_lines", "page_lines"))
    return out.withColumn("tags", F.array_join("tags", "|")).drop("contact_lines", "page_lines", "url")


# the h5 after the awards label and the tags heading count as h5 elements too
@check("b2_extract_fields", _fields_sql(
    said("amount", CHAR), f"CASE WHEN page_id % 3 > 0 THEN {said('date', CHAR)} ELSE {said('awards', CHAR)} END", said("awards", CHAR),
    f"{said('tag1', CHAR)} || CASE WHEN page_id % 4 > 0 THEN '|' || {said('tag2', CHAR)} ELSE '' END"))
def b2(t):
    return _fields(t, False)


@check("b2a_extract_fields_strict", _fields_sql(
    f"CASE WHEN page_id % 3 > 0 THEN {said('amount', CHAR)} ELSE 'N/A' END",
    f"CASE WHEN page_id % 3 > 0 THEN {said('date', CHAR)} ELSE 'N/A' END", "'N/A'", "''"))
def b2a(t):
    return _fields(t, True)


@check("b3_location", f"""
WITH src AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Office' || chr(10) || ' Austin, TX ' || CAST(doc_id AS STRING) ELSE 'Office' END AS contact,
    CASE WHEN doc_id % 3 = 1 THEN text || chr(10) || 'Provo, UT ' || CAST(doc_id AS STRING) || chr(10) || 'Reno, NV 1' ELSE text END AS body FROM documents),
  lines AS (SELECT doc_id, list_transform(string_split(contact, chr(10)), lambda x: {sql_strip('x')}) AS c,
    list_transform(string_split(body, chr(10)), lambda x: {sql_strip('x')}) AS b FROM src),
  hits AS (SELECT doc_id, coalesce(list_filter(c, lambda x: regexp_matches(x, ', [A-Z]{{2}} \\d+'))[1],
    list_filter(b, lambda x: length(x) < 100 AND regexp_matches(x, ', [A-Z]{{2}} \\d+'))[1]) AS hit FROM lines)
SELECT doc_id, CASE WHEN hit IS NULL THEN 'USA' ELSE hit || ' (USA)' END AS country FROM hits""")
def b3(t):
    src = t.sql("""SELECT doc_id,
        CASE WHEN doc_id % 3 = 0 THEN 'Office' || chr(10) || ' Austin, TX ' || CAST(doc_id AS STRING) ELSE 'Office' END AS contact,
        CASE WHEN doc_id % 3 = 1 THEN text || chr(10) || 'Provo, UT ' || CAST(doc_id AS STRING) || chr(10) || 'Reno, NV 1' ELSE text END AS body
        FROM {documents}""")
    return P.extract_location(src, "contact", "body").select("doc_id", "country")


def sql_page_text() -> str:
    # junk-class elements are covered by unit tests: RE2 has no back reference for their end tag
    x = "html"
    n = "' || chr(1) || '"
    for pattern, replacement in (
        (r"(?is)<script\b.*?</script>", n), (r"(?is)<style\b.*?</style>", n), (r"(?s)<!--.*?-->", n),
        (r'(?is)<a\b[^>]*\bhref="(/[^"]*)"[^>]*>(.*?)</a>', rf"{n}\2 [{ROOT}\1]{n}"),
        (r'(?is)<a\b[^>]*\bhref="([^"]+)"[^>]*>(.*?)</a>', rf"{n}\2 [\1]{n}"),
        (r"(?i)<li(?:\s[^>]*)?>", f"{n}•{n}"), (r"(?i)</?h[23](?:\s[^>]*)?>", f"{n}---{n}"), (r"<[^>]+>", n),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    nodes = (f"list_filter(list_transform(string_split({sql_decode(x)}, chr(1)), lambda s: {sql_strip('s')}), "
             "lambda s: s <> '')")
    joined = f"array_to_string({nodes}, chr(10))"
    joined = f"regexp_replace(regexp_replace({joined}, '##[A-Z]+##', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_strip(joined)


@check("b4_page_text", f"SELECT page_id, url, {sql_page_text()} AS page_text FROM pages")
def b4(t):
    return P.page_text(t.pages, ROOT)


@check("b4_page_text_references", f"""
SELECT page_id, url, page_text || chr(10) || 'Prix {{ref}} ' || {ID} || chr(10) || 'voir' || chr(10) || {CHAR} AS page_text
FROM (SELECT page_id, url, {sql_page_text()} AS page_text FROM pages) AS p""".replace("{ref}", "' || " + CHAR + " || '"))
def b4_references(t):
    """Named, decimal and hexadecimal references, with and without a semicolon."""
    return P.page_text(t.sql(f"SELECT page_id, url, html || '<p>Prix ' || {REF} || ' ' || {ID} || '</p><p>voir</p><p>' || {REF} || '</p>' AS html FROM {{pages}}"), ROOT)


@check("b4_page_text_nested", f"""
SELECT page_id, url, page_text || chr(10) || 'kept ' || CAST(page_id AS STRING) || chr(10) || 'more [{ROOT}/x' || CAST(page_id AS STRING) || ']' AS page_text
FROM (SELECT page_id, url, {sql_page_text()} AS page_text FROM pages) AS p""")
def b4_nested(t):
    """Junk inside junk goes by nesting depth, and addresses may stand in single quotes."""
    return P.page_text(t.sql("""SELECT page_id, url, html || '<div class="a print-only"><div>junk</div>junk <div class=''info-icon-wrapper''>junk</div></div><p>kept '
        || CAST(page_id AS STRING) || '</p><a href=''/x' || CAST(page_id AS STRING) || '''>more</a>' AS html FROM {pages}"""), ROOT)


@check("b5_expand_variants", """
SELECT doc_id, 'Doc ' || CAST(doc_id AS STRING) || ' (' || c || ' - ' || s || ')' AS scholarship_name, s AS degree_level,
  'Germany' AS country, 'DAAD|' || c || '|' || s || '|Germany' AS tags
FROM documents, (VALUES ('Egypt'), ('Syria'), ('Jordan'), ('Saudi Arabia')) AS cs(c),
  (VALUES ('Undergraduates'), ('Graduates'), ('Doctoral candidates/PhD students')) AS ss(s)""")
def b5(t):
    docs = t.documents.select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("scholarship_name"))
    return P.expand_variants(docs).withColumn("tags", F.array_join("tags", "|"))


@check("b6_drop_ineligible", """
SELECT item_id, eligibility FROM {listings} AS l WHERE NOT contains(coalesce(eligibility, ''), 'Not Eligible')
  AND NOT contains(coalesce(eligibility, ''), 'If your status and/or country is not included')""")
def b6(t):
    return P.drop_containing(t.listings.select("item_id", "eligibility"), "eligibility")


@check("b7_description_fallback", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Objective ' || CAST(doc_id AS STRING) ELSE substr(text, 1, 300) || '...' END AS description
FROM documents""")
def b7(t):
    objective = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Objective "), F.col("doc_id").cast("string")))
    return t.documents.select("doc_id", P.description_or_prefix(objective, "text").alias("description"))


def _programs(t):
    """Programme pages out of the given ones: their own paragraphs in containers by id, with a varying set of parts."""
    own = "regexp_extract_all(html, '(?is)<p>([^<]*)</p>', 1)"
    return t.sql(f"""SELECT page_id, url,
      '<div class="x">' || CASE WHEN page_id % 6 = 5 THEN '' ELSE '<div class="tab" id=''ueberblick''><div>Intro ' || {ID} || '</div>'
        || CASE WHEN page_id % 2 = 0 THEN '<h3><i>The Objective</i></h3><p>Aim <b>' || {ID} || '</b> ' || {REF} || '</p>' ELSE '' END
        || '<p>' || coalesce(try_element_at({own}, 1), '') || '</p></div>' END
      || '<div id="voraussetzungen"><ul><li>Rule ' || CAST(page_id % 9 AS STRING) || '</li></ul></div>'
      || CASE WHEN page_id % 4 = 3 THEN '' ELSE '<div id=prozess><p>Send it</p>' || CASE WHEN page_id % 4 = 0 THEN '' ELSE
        '<h3>Application deadline</h3><p>By <b>May</b> | ' || {ID} || '</p><ul><li>first ' || {REF} || '</li> <li>| |</li><li>second</li></ul>' END
        || '<h2 id="next">Next</h2><p>other</p></div>' END || '</div>' || html AS html FROM {{pages}}""")


_PARAGRAPH = sql_strip(sql_decode("coalesce(regexp_extract_all(html, '(?is)<p>([^<]*)</p>', 1)[1], '')"))
_INTRO = "'Intro ' || " + ID
_AIM = "'Aim' || chr(10) || " + ID + " || chr(10) || " + CHAR


@check("b7_program_fields", f"""
WITH p AS (SELECT page_id, url, {_PARAGRAPH} AS par FROM pages),
  d AS (SELECT *, CASE WHEN page_id % 6 = 5 THEN 'N/A' ELSE {_INTRO} || CASE WHEN page_id % 2 = 0 THEN chr(10) || '---' || chr(10) || 'The Objective' || chr(10) || '---'
    || chr(10) || {_AIM} ELSE '' END || CASE WHEN par <> '' THEN chr(10) || par ELSE '' END END AS details FROM p)
SELECT page_id, url, CASE WHEN page_id % 6 = 5 THEN 'N/A' WHEN page_id % 2 = 0 THEN 'Aim' || {ID} || {CHAR} ELSE substr(details, 1, 300) || '...' END AS description,
  details AS scholarship_details, '•' || chr(10) || 'Rule ' || CAST(page_id % 9 AS STRING) AS eligibility,
  CASE page_id % 4 WHEN 3 THEN 'N/A' WHEN 0 THEN 'Send it' || chr(10) || '---' || chr(10) || 'Next' || chr(10) || '---' || chr(10) || 'other'
    ELSE 'Send it' || chr(10) || '---' || chr(10) || 'Application deadline' || chr(10) || '---' || chr(10) || 'By' || chr(10) || 'May' || chr(10) || '| ' || {ID}
      || chr(10) || '•' || chr(10) || 'first ' || {CHAR} || chr(10) || '•' || chr(10) || '| |' || chr(10) || '•' || chr(10) || 'second'
      || chr(10) || '---' || chr(10) || 'Next' || chr(10) || '---' || chr(10) || 'other' END AS application_process,
  CASE WHEN page_id % 4 IN (0, 3) THEN 'Not Specified' ELSE 'By | May | ' || {ID} || chr(10) || 'first ' || {CHAR} || ' | second' END AS deadline
FROM d""")
def b7_program(t):
    return P.program_fields(_programs(t), ROOT)


BLOCK = (f"'<h3>Application deadline</h3><p>Apply by <b>' || {REF} || '</b> | ' || {ID} || '</p><ul><li>first</li> <li>| |</li>"
         f"<li>no. ' || CAST(page_id % 17 AS STRING) || '</li></ul>'")


@check("b8_deadline_block", f"""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Not Specified' ELSE
  'Apply by | ' || {CHAR} || ' | ' || {ID} || chr(10) || 'first | no. ' || CAST(page_id % 17 AS STRING) END AS deadline FROM pages""")
def b8(t):
    pages = t.sql(f"""SELECT page_id, html || CASE WHEN page_id % 4 = 0 THEN '' ELSE {BLOCK} END ||
        '<h2 id="next">Next</h2><p>other</p>' AS html FROM {{pages}}""")
    return pages.select("page_id", P.deadline_block("html").alias("deadline"))


@check("b9_clean_name", f"""
SELECT doc_id, trim(replace('  ' || source || ' grant • DAAD ', '• DAAD', ''), {WS}) AS name FROM documents""")
def b9(t):
    return t.documents.select("doc_id", P.clean_name(
        F.concat(F.lit("  "), F.col("source"), F.lit(" grant • DAAD "))).alias("name"))

"""Fetched pages to records: link harvest, field extraction, page text and variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K
from ..functions.html import (SILENT, VALUE, Step, after_first, attribute, elements, first_element_text, flat_text, from_first,
                              held_by, html_to_text, inner_html, selected, start_of, text_nodes)
from ..functions.text import alternation, as_col, decode_entities, let, strip, strip_literal

ANY_ANCHOR = rf"(?i)<a\b[^>]*(?<![\w-])href\s*=\s*{VALUE}"

QUOTES = """^["']|["']$"""


def harvest_links(pages: DataFrame, root: str, pattern: str = ANY_ANCHOR, *, within: Sequence[Step] = (),
                  id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Distinct absolute links with their first place: (link, first_page, first_pos, n_places).

    Group 1 of the pattern is the address; quotes around it do not count, and an empty one is no link. ``within`` reads
    the anchors of a list instead: the last step is the anchor, the steps before hold it. Then the place counts the
    list's anchors only.
    One aggregation with a map-side combine, so a link that sits on every page stays cheap.
    """
    if within:
        pages = selected(pages, F.regexp_replace(html_col, SILENT, ""), within, "_anchors")
        hrefs = F.transform("_anchors", lambda a: attribute(a, "href"))
    else:
        hrefs = F.transform(F.regexp_extract_all(F.col(html_col), F.lit(pattern), F.lit(1)),
                            lambda href: F.regexp_replace(href, QUOTES, ""))
    # outer: a plain explode makes the optimizer test the array's size first, which computes it twice
    listed = F.posexplode_outer(F.filter(hrefs, lambda href: href != "")).alias("pos", "href")
    found = pages.select(F.col(id_col).alias("page"), listed).filter("href is not null")
    link = F.when(F.startswith("href", F.lit("/")), F.concat(F.lit(root), F.col("href"))).otherwise(F.col("href"))
    if pages.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        firsts = found.groupBy(link.alias("link")).agg(
            F.min(F.struct("page", "pos")).alias("first"), F.count("*").alias("n_places"))
        return firsts.select("link", F.col("first.page").alias("first_page"), F.col("first.pos").alias("first_pos"),
                             "n_places")
    # one number per place (page, then position) keeps this a hash aggregation; a struct would sort every anchor
    base = F.lit(2 ** 31).cast("decimal(10,0)")
    place = (F.col("page").cast("decimal(19,0)") * base + F.col("pos")).cast("decimal(38,0)")
    firsts = found.groupBy(link.alias("link")).agg(F.min(place).alias("first"), F.count("*").alias("n_places"))
    page = F.floor(F.col("first") / base)
    return firsts.select("link", page.cast("bigint").alias("first_page"),
                         (F.col("first") - page * base).cast("int").alias("first_pos"), "n_places")


MISSING = "N/A"
# The labels of a page, each with the element that carries it.
AWARDS = ("span", ["Awards Available:"])
QUALIFIED = ("h5", ["Qualified Based On:", "Eligibility Criteria:"])
MAIN = ("h2", ["Scholarship Description"])
PARTS = {"scholarship_details": "Details", "eligibility": "Eligibility", "application_process": "Application Process"}
CONTACT = "contactDetail"


def labelled(element: str, labels: Sequence[str]) -> str:
    """Pattern of an element whose text, under tags of its own or not, holds a label."""
    return (rf"<{element}(?:\s[^>]*)?>(?:\s*<\w[^>]*>)*[^<]*(?:{alternation(labels)})[^<]*(?:</(?!{element}\b)[^>]*>\s*)*"
            rf"</{element}\s*>")


def or_missing(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(MISSING)).otherwise(text)


def next_inner(html: Column) -> Column:
    """What the next element holds, null where an enclosing one ends first."""
    at = F.regexp_replace(html, r"^[^<]+", "")
    return F.when(F.rlike(at, F.lit(r"^<[A-Za-z]")), inner_html(at, F.regexp_extract(at, r"^<(\w+)", 1)))


def texts_of(html: Column, tag: str) -> Column:
    """The texts of all elements of a kind in page order, those inside another of the kind included."""
    return F.transform(elements(html, Step(tag)), lambda e: flat_text(held_by(e)))


def extract_fields(pages: DataFrame, *, html_col: str = "html", strict_pair: bool = False) -> DataFrame:
    """Adds the page fields, all by column expressions inside the row. A missing text gives 'N/A', a missing list none.

    Amount and deadline are the first two h5; ``strict_pair`` sets them only where two exist. Other fields follow a
    labelled heading: the next h5 (awards), the inner boxes of the next one (tags), and inside the box after the main
    heading its first paragraph and the element after each part's heading. Elements end by nesting depth. Where a page
    misses the element a label announces, the next one of that kind on the page is taken.
    """
    keep = [c for c in pages.columns if c != html_col]
    page = F.coalesce(F.col("_page"), F.lit(""))
    box = start_of("div")
    main = F.coalesce(F.col("_main"), F.lit(""))
    heads = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<h5(?:\s[^>]*)?>(.*?)</h5\s*>"), F.lit(1)), lambda h: flat_text(h))
    awards = F.regexp_extract(page, rf"(?is){labelled(*AWARDS)}.*?<h5(?:\s[^>]*)?>(.*?)</h5\s*>", 1)
    tags_box = inner_html(from_first(after_first(page, labelled(*QUALIFIED)), box), "div")
    nth = {n: F.try_element_at(F.col("_heads"), F.lit(n)) for n in (1, 2)}
    paired = F.size("_heads") >= 2 if strict_pair else F.lit(True)
    paragraph = F.array_join(text_nodes(F.regexp_extract(main, r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>", 1)), "")

    def part(title):
        return F.array_join(text_nodes(next_inner(after_first(main, labelled("h2", [title])))), "\n")

    fields = {
        "scholarship_name": first_element_text(page, "h1"),
        "funding_type": or_missing(F.when(paired, nth[1])),
        "deadline": or_missing(F.when(paired, nth[2])),
        "awards_available": or_missing(flat_text(awards)),
        "tags": F.coalesce(texts_of(tags_box, "div"), F.array().cast("array<string>")),
        "description": or_missing(paragraph),
        **{name: or_missing(part(title)) for name, title in PARTS.items()},
        "contact_lines": lines_of(inner_html(from_first(page, start_of("div", [CONTACT])), "div")),
        "page_lines": lines_of(page),
    }
    # scripts, styles and comments hold no elements; each of these steps is worked out once
    bare = pages.withColumn("_page", F.regexp_replace(html_col, SILENT, ""))
    bare = bare.withColumns({"_main": inner_html(from_first(after_first(F.coalesce("_page", F.lit("")), labelled(*MAIN)), box), "div"),
                             "_heads": heads})
    return bare.select(*keep, *[value.alias(name) for name, value in fields.items()])


def lines_of(html: Column) -> Column:
    """Stripped, non-empty lines of the texts between the tags; none for null."""
    lines = F.flatten(F.transform(text_nodes(html), lambda n: F.transform(F.split(n, "\n"), lambda line: strip(line))))
    return F.coalesce(F.filter(lines, lambda line: line != ""), F.array().cast("array<string>"))


def page_titles(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """Native h1 and title text, without Python."""
    return pages.withColumn("h1", first_element_text(html_col, "h1")).withColumn(
        "title", first_element_text(html_col, "title")).drop(html_col)


def location(contact_lines: Column | str, page_lines: Column | str, *, pattern: str = K.US_ADDRESS,
             max_len: int = 100, default: str = "USA") -> Column:
    """First address line of the contact block, else the first short one of the page, else the default."""
    def hit(line):
        return F.rlike(line, F.lit(pattern))

    contact = F.filter(as_col(contact_lines), hit)
    page = F.filter(as_col(page_lines), lambda line: (F.length(line) < max_len) & hit(line))
    found = F.coalesce(F.try_element_at(contact, F.lit(1)), F.try_element_at(page, F.lit(1)))
    return F.when(found.isNotNull(), F.concat(found, F.lit(" (USA)"))).otherwise(F.lit(default))


def text_lines(text: Column | str) -> Column:
    """Stripped, non-empty lines of a text."""
    return F.filter(F.transform(F.split(as_col(text), "\n"), lambda line: strip(line)), lambda line: line != "")


def extract_location(df: DataFrame, contact_col: str, text_col: str) -> DataFrame:
    return df.withColumn("country", location(text_lines(contact_col), text_lines(text_col)))


def page_text(df: DataFrame, root: str, *, html_col: str = "html") -> DataFrame:
    return df.withColumn("page_text", html_to_text(html_col, root)).drop(html_col)


def expand_variants(df: DataFrame, countries: Sequence[str] = K.VARIANT_COUNTRIES,
                    levels: Sequence[str] = K.VARIANT_LEVELS, *, name_col: str = "scholarship_name",
                    tag: str = "DAAD", host: str = "Germany") -> DataFrame:
    """Every listing once per country and level. The combinations are a literal array: no join is needed."""
    combos = F.array(*[F.struct(F.lit(c).alias("country"), F.lit(s).alias("level")) for c in countries for s in levels])
    out = df.withColumn("_v", F.explode(combos))
    name = F.concat(F.col(name_col), F.lit(" ("), F.col("_v.country"), F.lit(" - "), F.col("_v.level"), F.lit(")"))
    return (out.withColumn(name_col, name)
            .withColumn("degree_level", F.col("_v.level"))
            .withColumn("country", F.lit(host))
            .withColumn("tags", F.array(F.lit(tag), F.col("_v.country"), F.col("_v.level"), F.lit(host)))
            .drop("_v"))


def drop_containing(df: DataFrame, col: str, phrases: Sequence[str] = K.INELIGIBLE) -> DataFrame:
    """Drop rows whose text holds any phrase; a null text stays."""
    hit = F.rlike(F.coalesce(F.col(col), F.lit("")), F.lit(alternation(phrases)))
    return df.filter(~hit)


def description_or_prefix(objective: Column | str, details: Column | str, n: int = 300) -> Column:
    return F.coalesce(as_col(objective), F.concat(F.substring(as_col(details), 1, n), F.lit("...")))


# The containers of a programme page by id, and the heading of its aim.
OVERVIEW, REQUIREMENTS, PROCESS = "ueberblick", "voraussetzungen", "prozess"
OBJECTIVE = "Objective"


def program_fields(pages: DataFrame, root: str, *, html_col: str = "html", n: int = 300) -> DataFrame:
    """Adds the fields of a programme page, read from its containers by id: ``scholarship_details``, ``eligibility`` and
    ``application_process`` as page text, ``deadline`` from the blocks below the heading of the process container, and
    ``description``: the paragraph after the aim's heading in the overview, else the first ``n`` characters of the
    details. A page without a container gets 'N/A' for it ('Not Specified' as deadline).
    """
    keep = [c for c in pages.columns if c != html_col]
    bare = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), SILENT, "")

    def container(name):
        return held_by(F.try_element_at(elements(F.col("_bare"), Step("div", id=name), outermost=True), F.lit(1)))

    boxes = pages.withColumn("_bare", bare).withColumns({f"_{name}": container(name) for name in (OVERVIEW, REQUIREMENTS, PROCESS)})
    texts = {column: html_to_text(f"_{name}", root) for column, name in (
        ("scholarship_details", OVERVIEW), ("eligibility", REQUIREMENTS), ("application_process", PROCESS))}
    out = boxes.withColumns(texts)
    below = after_first(F.col(f"_{OVERVIEW}"), labelled("h3", [OBJECTIVE]))
    aim = F.try_element_at(elements(below, Step("p")), F.lit(1))
    description = F.when(F.col(f"_{OVERVIEW}").isNull(), F.lit(MISSING)).otherwise(
        description_or_prefix(F.array_join(text_nodes(held_by(aim)), ""), "scholarship_details", n))
    deadline = F.coalesce(deadline_block(F.col(f"_{PROCESS}")), F.lit(K.NOT_SPECIFIED))
    return out.withColumns({"description": description, "deadline": deadline}).select(
        *keep, "description", *texts, "deadline")


BLOCK_END = r"(?i)</(?:p|ul|ol|div|table|section|dl)>"


def deadline_block(html: Column | str, heading: str = "Application deadline") -> Column:
    """Text of the blocks between a heading and the next one: one line per block, parts joined by ' | '."""
    body = F.regexp_extract(
        as_col(html), rf"(?is)<h3(?:\s[^>]*)?>[^<]*{heading}[^<]*</h3>(.*?)(?:<h[23][\s>]|$)", 1)

    def block_text(block):
        parts = F.filter(F.transform(F.split(decode_entities(F.regexp_replace(block, K.HTML_TAG, "\x01")), "\x01"),
                                     lambda s: strip(s)), lambda s: s != "")
        return F.regexp_replace(F.array_join(parts, " | "), r"(?:\s*\|\s*)+", " | ")

    lines = F.filter(F.transform(F.split(body, BLOCK_END), block_text), lambda line: line != "")
    return let(F.array_join(lines, "\n"), lambda t: F.when(
        F.coalesce(t, F.lit("")) == "", F.lit(K.NOT_SPECIFIED)).otherwise(t))


def clean_name(col: Column | str, literal: str = "• DAAD") -> Column:
    return strip_literal(col, literal)

"""HTML as column expressions: texts, elements by nesting depth, and page text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed as K
from .text import alternation, as_col, decode_entities, let, running_sums, strip

NODE = "\x01"  # separates text nodes while tags are removed
OPEN, CLOSE = "\x02", "\x03"  # frame the text of a link, whose own nodes join without a gap


def join_links(text: Column) -> Column:
    def unframe(part, i):
        link = strip(F.regexp_replace(F.substring_index(part, CLOSE, 1), rf"\s*{NODE}\s*", ""))
        rest = F.substring(part, F.instr(part, CLOSE) + 1, F.length(part))
        return F.when(i == 0, part).otherwise(F.concat(link, rest))

    return F.array_join(F.transform(F.split(text, OPEN), unframe), "")


VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
SILENT = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
#: The value of an attribute, its quotes included.
VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""


def start_of(tag: str, css: Sequence[str] = ()) -> str:
    """Pattern of a start tag, of one that carries any of the classes where some are named."""
    if not css:
        return rf"<(?:{tag})(?=[\s/>])[^>]*>"
    names = rf"(?<![\w-])(?:{alternation(css)})(?![\w-])"
    return (rf"""<(?:{tag})(?=\s)[^>]*?(?<![\w-])class\s*=\s*(?:"[^">]*?{names}[^">]*"|'[^'>]*?{names}[^'>]*'|{names}(?=[\s>]))[^>]*>""")


@dataclass(frozen=True)
class Step:
    """A kind of element: its tag, and one of its classes or its id where they are named."""

    tag: str
    css: str | None = None
    id: str | None = None

    def start(self) -> str:
        """Pattern of its start tags."""
        if self.id is None:
            return start_of(self.tag, [self.css] if self.css else ())
        name = alternation([self.id])
        own = rf"""<(?:{self.tag})(?=\s)[^>]*?(?<![\w-])id\s*=\s*(?:"{name}"|'{name}'|{name}(?=[\s/>]))[^>]*>"""
        return own if self.css is None else rf"(?={own}){start_of(self.tag, [self.css])}"


def elements(html: Column, step: Step, outermost: bool = False) -> Column:
    """The elements of a kind in page order, each from its start tag on without its end tag.

    The page becomes a stream of its start and end tags of that name with their nesting depths. In the order of depth
    and place every end tag follows the start tag it closes. An element that is not closed reaches to the end. Those
    within another one follow it, or are left out with ``outermost``.
    """
    opens, closes = F.lit(rf"(?i)^<{step.tag}[\s/>]"), F.lit(rf"(?i)^</{step.tag}[\s/>]")

    def of_pieces(pieces):
        kinds = F.transform(pieces, lambda p: F.when(F.rlike(p, closes), -1).when(F.rlike(p, opens), 1).otherwise(0))

        def of_depths(kinds, depths):
            tags = F.filter(F.transform(kinds, lambda k, i: F.struct(
                (F.get(depths, i) + F.when(k < 0, 1).otherwise(0)).alias("depth"), (i + 1).alias("at"), k.alias("kind"))), lambda t: t["kind"] != 0)

            def of_tags(ordered):
                def end(k):
                    after = F.get(ordered, k + 1)
                    own = (after["kind"] < 0) & (after["depth"] == F.get(ordered, k)["depth"])
                    return F.when(F.coalesce(own, F.lit(False)), after["at"]).otherwise(F.size(pieces) + 1)

                spans = F.transform(ordered, lambda t, k: F.struct(t["at"].alias("at"), end(k).alias("end"), t["kind"].alias("kind")))
                fit = F.filter(spans, lambda t: (t["kind"] > 0) & F.rlike(F.get(pieces, t["at"] - 1), F.lit(f"(?is)^{step.start()}")))
                return let(F.array_sort(fit), chosen)

            def chosen(spans):
                if outermost:
                    first = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<at:int,end:int,kind:int>>").alias("all"))
                    spans = F.aggregate(spans, first, lambda s, t: F.when(t["at"] >= s["upto"], F.struct(
                        t["end"].alias("upto"), F.array_append(s["all"], t).alias("all"))).otherwise(s))["all"]
                return F.transform(spans, lambda t: F.array_join(F.slice(pieces, t["at"], t["end"] - t["at"]), ""))

            return let(F.array_sort(tags), of_tags)

        return let(kinds, lambda k: let(running_sums(k), lambda d: of_depths(k, d)))

    return let(cut_at(html, F.lit(step.tag)), of_pieces)


def selected(df: DataFrame, html: Column, steps: Sequence[Step], into: str) -> DataFrame:
    """Adds the elements of the last kind that lie within one of each kind before, outermost to innermost, in page order.

    A step is a projection of its own, which keeps expressions small.
    """
    df = df.withColumn(into, F.array(html))
    for k, step in enumerate(steps):
        df = df.withColumn(into, inside(F.col(into), step, tagged=k > 0, outermost=k + 1 < len(steps)))
    return df


def inside(holders: Column, step: Step, tagged: bool, outermost: bool) -> Column:
    """The elements of a kind in each of the holders, which begin with their own start tag where ``tagged``."""
    return F.flatten(F.transform(holders, lambda h: elements(held_by(h) if tagged else h, step, outermost)))


def held_by(element: Column) -> Column:
    """What an element of ``elements`` holds."""
    return F.regexp_replace(element, r"^<[^>]*>", "")


def attribute(element: Column, name: str) -> Column:
    """An attribute of an element of ``elements``, decoded; '' without it."""
    raw = F.regexp_extract(element, rf"(?is)^<[^>]*?(?<![\w-]){name}\s*=\s*{VALUE}", 1)
    return decode_entities(F.regexp_replace(raw, """^["']|["']$""", ""))


def cut_at(html: Column, tag: Column) -> Column:
    """A page in pieces that each begin with a start or end tag of ``tag``, but for what stands before the first."""
    return F.split(html, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"[\s/>])")))


def held(pieces: Column, tag: Column, depth: Column) -> Column:
    """struct<n, depth>: how many pieces stand before the end tag that brings ``depth`` to zero, and the depth there."""
    def step(s, piece):
        deeper = s["depth"] + F.when(F.rlike(piece, F.concat(F.lit("(?i)^</"), tag, F.lit(r"[\s/>]"))), -1).when(
            F.rlike(piece, F.concat(F.lit("(?i)^<"), tag, F.lit(r"[\s/>]"))), 1).otherwise(0)
        # the first piece opens the element, or is what continues it
        going = (s["n"] == 0) | (s["depth"] > 0)
        return F.when(going, F.struct((s["n"] + F.when(deeper > 0, 1).otherwise(0)).alias("n"), deeper.alias("depth"))).otherwise(s)

    return F.aggregate(pieces, F.struct(F.lit(0).alias("n"), depth.alias("depth")), step)


def inner_html(html: Column, tag: str | Column) -> Column:
    """What the element holds that ``html`` begins with, by nesting depth; up to the end where it is not closed."""
    tag = F.lit(tag) if isinstance(tag, str) else tag

    def inside(pieces):
        n = held(pieces, tag, F.lit(0))["n"]
        return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), F.greatest(n, F.lit(1))), ""), r"^<[^>]*>", "")

    return let(cut_at(html, tag), inside)


def from_first(html: Column, pattern: str) -> Column:
    """The page from the first match of a pattern on, null without one."""
    return F.nullif(F.regexp_extract(html, f"(?is)({pattern}.*)", 1), F.lit(""))


def after_first(html: Column, pattern: str) -> Column:
    """The page after the first match of a pattern, null without one."""
    return let(from_first(html, pattern), lambda rest: F.regexp_replace(rest, f"(?is)^{pattern}", ""))


def drop_elements(html: Column, css: Sequence[str]) -> Column:
    """The page without the elements that carry any of the classes, each with all it holds.

    The page is cut where such elements begin. A fold over these parts keeps the tag and depth of an element that is
    still open, so one within another goes with it; its cost grows with the elements dropped, not with the page's tags.
    """
    start = start_of("[a-z][a-z0-9]*", css)

    def step(s, part):
        begins = F.rlike(part, F.lit(f"(?is)^{start}"))
        own = F.lower(F.regexp_extract(part, r"^<([A-Za-z][A-Za-z0-9]*)", 1))
        is_open = s["depth"] > 0
        tag = F.when(is_open, s["tag"]).otherwise(own)

        def closed(pieces):
            return let(held(pieces, tag, s["depth"]), lambda end: F.when(end["depth"] > 0, F.struct(
                s["out"].alias("out"), tag.alias("tag"), end["depth"].alias("depth"))).otherwise(F.struct(
                    F.concat(s["out"], F.lit(NODE), F.regexp_replace(F.array_join(F.slice(
                        pieces, end["n"] + 1, F.size(pieces)), ""), r"^</[^>]*>", "")).alias("out"),
                    F.lit("").alias("tag"), F.lit(0).alias("depth"))))

        plain = F.struct(F.concat(s["out"], part).alias("out"), F.lit("").alias("tag"), F.lit(0).alias("depth"))
        void = F.struct(F.concat(s["out"], F.regexp_replace(part, r"^<[^>]*>", NODE)).alias("out"), F.lit("").alias("tag"),
                        F.lit(0).alias("depth"))
        return (F.when(~is_open & ~begins, plain).when(~is_open & F.rlike(own, F.lit(f"^(?:{VOID})$")), void)
                .otherwise(let(cut_at(part, tag), closed)))

    first = F.struct(F.lit("").alias("out"), F.lit("").alias("tag"), F.lit(0).alias("depth"))
    parts = F.split(html, f"(?is)(?={start})")
    return F.when(F.size(parts) < 2, F.when(~F.rlike(html, F.lit(f"(?is)^{start}")), html).otherwise(
        F.aggregate(parts, first, step)["out"])).otherwise(F.aggregate(parts, first, step)["out"])


def text_nodes(html: Column) -> Column:
    """Stripped, decoded, non-empty texts between the tags, without scripts, styles and comments."""
    bare = F.regexp_replace(F.regexp_replace(html, SILENT, NODE), K.HTML_TAG, NODE)
    nodes = F.transform(F.split(decode_entities(bare), NODE), lambda n: strip(n))
    return F.filter(nodes, lambda n: n != "")


def flat_text(html: Column) -> Column:
    """Tag-free, decoded, stripped text."""
    return strip(decode_entities(F.regexp_replace(html, K.HTML_TAG, "")))


def first_element_text(html: Column | str, tag: str) -> Column:
    """Tag-free, decoded text of the first ``tag`` element, or 'N/A'."""
    inner = F.regexp_extract(as_col(html), rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    text = strip(decode_entities(F.regexp_replace(inner, K.HTML_TAG, "")))
    return let(text, lambda t: F.when(t == "", F.lit("N/A")).otherwise(t))


def html_to_text(html: Column | str, root: str, junk: list[str] = K.JUNK_CLASSES) -> Column:
    """Page markup as clean text, one text node per line.

    Scripts, styles, comments and junk-class elements go; a link becomes ``text [href]`` with a relative
    address made absolute; list items get a bullet and h2/h3 a ``---`` frame; upper-case ``##`` placeholders
    go and newline runs shrink to two. Empty input gives 'N/A'.
    """
    col = as_col(html)
    text = col
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
        text = F.regexp_replace(text, pattern, NODE)
    text = let(text, lambda t: drop_elements(t, junk))
    for pattern, replacement in (
        # addresses in single quotes or none get double ones
        (rf"(?is)(<a\b[^>]*(?<![\w-])href)\s*=\s*(?:'([^'\"]*)'|([^\s\"'>]+))", '$1="$2$3"'),
        (r'(?is)<a\b[^>]*\bhref="(/[^"]*)"[^>]*>(.*?)</a>', rf"{NODE}{OPEN}$2{CLOSE} [{root}$1]{NODE}"),
        (r'(?is)<a\b[^>]*\bhref="([^"]+)"[^>]*>(.*?)</a>', rf"{NODE}{OPEN}$2{CLOSE} [$1]{NODE}"),
        (r"(?i)<li(?:\s[^>]*)?>", f"{NODE}•{NODE}"),
        (r"(?i)<h[23](?:\s[^>]*)?>", f"{NODE}---{NODE}"),
        (r"(?i)</h[23]>", f"{NODE}---{NODE}"),
        (K.HTML_TAG, NODE),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    nodes = F.filter(F.transform(F.split(decode_entities(join_links(text)), NODE), lambda n: strip(n)), lambda n: n != "")
    joined = F.array_join(nodes, "\n")
    joined = F.regexp_replace(F.regexp_replace(joined, K.PLACEHOLDER, ""), K.NEWLINES, "\n\n")
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit("N/A")).otherwise(strip(joined))

"""Main text of pages by two passes of block rules.

The page is read as a stream of blocks (text between block tags), each with its share of linked characters, its
share of stop words, its length, and the container it stands in. The first pass decides the clear blocks: linked
ones, or those inside a container that says what it is (navigation, page header, footer, aside, form, advert, cookie
notice, comments), are boilerplate; long blocks with enough stop words are text; what is neither stays open. The second pass
gives every open block the label of its nearest decided neighbour; at equal distance and with different labels, the
label of its place (a page that marks its content makes text, any other boilerplate). Where no block is clearly text,
the open ones are.

A container is not boilerplate where it holds a main element, or most of the page's text while no long block and no
article stands outside of it: a form around the page, a layout named after its parts. Names that layouts and sections
of an article bear too (sidebar, header, related, widget) decide nothing: only where what they name is mostly links are
its short blocks boilerplate. A name beside "has", "no" and the like says nothing.

Where the blocks of article or main elements outside of boilerplate hold most of the page's text, only they take part:
links or a container make a block boilerplate there, and a long block without stop words stays open. A page that shows hardly any of the known stop words is in
another language: its long blocks are text where they are hardly linked, wide characters counting twice. Containers of boilerplate are no neighbours. White space inside a block becomes one space; blocks of text are joined in page order by
a line feed.

Cases: null or empty html: empty text. No block of text: empty text. Broken markup is read as far as it goes: unclosed
elements end with an enclosing one or the page, stray end tags are ignored, unclosed scripts swallow the rest. Repeated
rows are read alike. Empty table: no rows. Other columns are kept by ``main_text``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from unicodedata import east_asian_width

import pandas as pd
from pyspark.sql import Column, functions as F

from .common import whole

MAX_LINK_SHARE = 0.4
LONG_CHARS = 80
STOP_SHARE = 0.08
# Share of a page's letters that stand in stop words; prose in the four languages has ten to thirty per cent.
KNOWN_SHARE = 0.04

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
the of and to in is that it for as was with be by on not he his but at are this have from or had an they which you were
der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird
le la les de des et un une du en est que qui dans pour sur pas par plus ce au avec son se il ne sont ou
el los las y que del por con para una su al lo como más pero sus no se es
""".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th
thead title tr ul""".split())
# what these hold is never text of the page
SILENT = frozenset("script style noscript template iframe object svg head title select textarea button canvas audio video".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form dialog menu".split())
CONTENT_TAGS = frozenset("article main".split())
# of these, an article is never inside unless it has a main element of its own
OUTER_TAGS = BOILERPLATE_TAGS - {"form"}
BOILERPLATE_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments
consent cookie cookies disclaimer disqus footer gdpr login masthead menu menubar modal nav navbar navigation
newsletter notification pagination pager popup promo promotion recommended replies reply respond share sharing
signup skip social sponsor sponsored subscribe subscription toolbar topbar""".split())
# of these, words that name other things in compounds (social-science, share-price): there they count as the last word, or
# as the first one before a word for a part of a page
AMBIGUOUS_NAMES = frozenset("disclaimer login notification pager promotion replies reply respond share sharing skip social sponsor subscription".split())
PARTS = frozenset("""area bar bars block body box btn button buttons col column container content count form group header heading icon icons
inner item items label link links list media menu message module nav network networks outer overlay panel row section strip text
title to tool toolbar tools unit widget wrap wrapper""".split())
# names that parts of an article and layouts bear too: what is inside is decided by its own length and links
OPEN_NAMES = frozenset("banner discussion header notice related sidebar tags widget".split())
# beside these a name tells of something else: has-sidebar, no-nav, comments-open
MODIFIERS = frozenset("has no not non with without open closed enabled disabled free".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
# an element of the left kind ends where one of the right kinds begins in the same parent
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
            "th": {"td", "th", "tr"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OF_HEAD = frozenset("head title meta link script style base noscript template basefont bgsound noframes".split())
# kinds of containers that say what they are
OPEN, NAMED, OUTER = range(3)
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[A-Za-z]+")
WORD = re.compile(r"[^\W\d_]+")


class Blocks(HTMLParser):
    """Collects (text, linked characters, innermost named container or -1, is in content, is heading) in page order.

    ``marks`` holds the named containers in page order: container around it or -1, its kind, whether a main element is in it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, bool]] = []  # tag, silent, mark, content
        self.blocks: list[tuple[str, int, int, bool, bool]] = []
        self.marks: list[list] = []
        self.parts: list[str] = []
        self.linked = self.links = self.headings = 0

    def state(self) -> tuple[bool, int, bool]:
        return self.open[-1][1:] if self.open else (False, -1, False)

    def flush(self):
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, mark, content = self.state()
            self.blocks.append((text, self.linked, mark, content, self.headings > 0))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in OF_HEAD:
            self.end_head()
        if tag in BLOCKS:
            self.flush()
            while self.open and tag in ENDED_BY.get(self.open[-1][0], ()):
                self.leave(len(self.open) - 1)
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        silent, mark, content = self.state()
        silent = silent or tag in SILENT or hidden(attrs)
        content = content or tag in CONTENT_TAGS
        kind = OUTER if tag in OUTER_TAGS else NAMED if tag == "form" or (tag == "header" and not content) else (
            None if tag in ("html", "body") else named(attrs))
        if tag in BLOCKS or tag in BOILERPLATE_TAGS:
            self.flush()
        self.links += tag == "a"
        if kind is not None:
            self.marks.append([mark, kind, False])
            mark = len(self.marks) - 1
        if tag == "main" and not silent:
            at = mark
            while at >= 0 and not self.marks[at][2]:
                self.marks[at][2] = True
                at = self.marks[at][0]
        self.headings += tag in HEADINGS
        self.open.append((tag, silent, mark, content))

    def handle_startendtag(self, tag, attrs):
        # a slash does not close an element of html
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if tag in BLOCKS or any(self.open[k][0] in BLOCKS for k in range(at, len(self.open))):
                    self.flush()
                self.leave(at)
                return
            # an inline end tag does not reach out of its block, nor a paragraph's out of its container
            if self.open[at][0] in BLOCKS and (tag not in BLOCKS or tag == "p"):
                return

    def leave(self, at: int):
        self.links -= sum(tag == "a" for tag, *_ in self.open[at:])
        self.headings -= sum(tag in HEADINGS for tag, *_ in self.open[at:])
        del self.open[at:]

    def end_head(self):
        """The end tag of a head may be missing: what belongs to the body ends it."""
        if self.open and self.open[-1][0] == "head":
            self.flush()
            self.leave(len(self.open) - 1)

    def handle_data(self, data):
        if not data.isspace():
            self.end_head()
        if not self.state()[0]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self.flush()


def hidden(attrs) -> bool:
    return any(name == "hidden" or (name == "style" and value and "display:none" in value.replace(" ", "").lower()) for name, value in attrs)


def named(attrs) -> int | None:
    """What the role, class and id of an element make of it."""
    found = None
    for name, value in attrs:
        if name == "role" and value and value.lower() in BOILERPLATE_ROLES:
            return NAMED
        for one in value.split() if name in ("class", "id") and value else ():
            order = [x.lower() for x in NAME.findall(one)]
            words = set(order)
            if not words.isdisjoint(MODIFIERS):
                continue
            says = words & BOILERPLATE_NAMES
            if says - AMBIGUOUS_NAMES or (says and (order[-1] in says or (order[0] in says and order[-1] in PARTS))):
                return NAMED
            if says or not words.isdisjoint(OPEN_NAMES):
                found = OPEN
    return found


def stop_share(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def other_language(texts: list[str]) -> bool:
    """Whether the known stop words are all but missing from a page. By letters, as not all scripts part words."""
    words = [w for text in texts for w in WORD.findall(text.lower())]
    return sum(len(w) for w in words if w in STOP_WORDS) < KNOWN_SHARE * sum(map(len, words))


def width(text: str) -> int:
    return len(text) + sum(east_asian_width(c) in "WF" for c in text)


def first_pass(text: str, linked: int, boilerplate: bool, content: bool, other: bool = False) -> bool | None:
    """True: text. False: boilerplate. None: open. ``other``: the page is in a language without known stop words."""
    if boilerplate or linked > MAX_LINK_SHARE * len(text):
        return False
    if other:
        return True if width(text) >= LONG_CHARS else None
    if len(text) < LONG_CHARS or linked:
        return None
    if stop_share(text) >= STOP_SHARE:
        return True
    return None if content else False


def second_pass(labels: list[bool | None], place: bool) -> list[bool]:
    """Open blocks take the label of the nearest decided block; see the module text for ties."""
    if True not in labels:  # no text is decided anywhere: what is open is all the text there is
        return [label is None for label in labels]
    n, far = len(labels), len(labels) + 1
    before, after = [(far, False)] * n, [(far, False)] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        distance, label = far, False
        for k in order:
            distance += 1
            if labels[k] is not None:
                distance, label = 0, labels[k]
            out[k] = (min(distance, far), label)
    done = []
    for k, label in enumerate(labels):
        (left, a), (right, b) = before[k], after[k]
        if label is None:
            label = place if left == right and a != b else a if left <= right else b
        done.append(label)
    return done


def extract(html: str) -> str:
    reader = Blocks()
    reader.feed(html)
    reader.close()
    keep = decide(reader.blocks, reader.marks)
    return "\n".join(text for (text, *_), kept in zip(reader.blocks, keep) if kept)


def boilerplate_marks(blocks: list[tuple[str, int, int, bool, bool]], marks: list[list]) -> list[bool]:
    """Whether what lies in a named container is boilerplate by it, for every container; see the module text."""
    n = len(marks)
    own, heavy = [0] * (n + 1), [0] * (n + 1)  # by innermost container, the last place for none: characters, blocks that count
    for text, linked, mark, content, _ in blocks:
        own[mark] += len(text) - linked
        heavy[mark] += content or (len(text) >= LONG_CHARS and linked <= MAX_LINK_SHARE * len(text))
    mass, held = own[:], heavy[:]
    for k in range(n - 1, -1, -1):
        mass[marks[k][0]] += mass[k]
        held[marks[k][0]] += held[k]
    gone = [True] * n
    for k, (around, kind, has_main) in enumerate(marks):
        if around >= 0 and gone[around]:
            continue
        if kind == OPEN or has_main:
            gone[k] = False
        elif kind == NAMED and held[k] and 2 * mass[k] > mass[n]:
            gone[k] = held[k] < held[n] and stands_outside(k, marks, gone, heavy)
    return gone


def stands_outside(k: int, marks: list[list], gone: list[bool], heavy: list[int]) -> bool:
    """Whether a block that counts is outside of container ``k`` and not in other boilerplate."""
    if heavy[len(marks)]:
        return True
    inside, seen = [False] * len(marks), [False] * len(marks)
    for m, (around, kind, has_main) in enumerate(marks):
        inside[m] = m == k or (around >= 0 and inside[around])
        seen[m] = (around < 0 or seen[around]) and (kind == OPEN or has_main or not gone[m])
        if heavy[m] and seen[m] and not inside[m]:
            return True
    return False


def decide(blocks: list[tuple[str, int, int, bool, bool]], marks: list[list]) -> list[bool]:
    """Whether each block is text of the page. Where the page marks its content, only what lies inside takes part.
    Containers of boilerplate are no neighbours of the blocks around them."""
    gone = boilerplate_marks(blocks, marks)
    size, links = [0] * len(marks), [0] * len(marks)
    for text, linked, mark, *_ in blocks:
        if mark >= 0:
            size[mark] += len(text)
            links[mark] += linked
    listing = [kind == OPEN and links[k] > MAX_LINK_SHARE * size[k] for k, (_, kind, _) in enumerate(marks)]
    free = [k for k, (*_, mark, _, _) in enumerate(blocks) if mark < 0 or not gone[mark]]
    unlinked = lambda ks: sum(len(blocks[k][0]) - blocks[k][1] for k in ks)
    inside = [k for k in free if blocks[k][3]]
    marked = 2 * unlinked(inside) > unlinked(free)
    part = inside if marked else free
    other = other_language([blocks[k][0] for k in part if blocks[k][1] <= MAX_LINK_SHARE * len(blocks[k][0])])
    labels = []
    for k in part:
        text, linked, mark, _, heading = blocks[k]
        short = mark >= 0 and listing[mark] and len(text) < LONG_CHARS and not heading
        labels.append(first_pass(text, linked, short, marked, other))
    kept = {k for k, label in zip(part, second_pass(labels, marked)) if label}
    return [k in kept for k in range(len(blocks))]


def main_text(html: str | Column = "html") -> Column:
    """Column function: the main text of a column of pages."""
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in series:
            yield pages.map(extract)

    return F.pandas_udf(run, "string")(whole(html))

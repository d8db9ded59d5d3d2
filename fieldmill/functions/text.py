"""Text expressions: JVM-side ``Column`` functions without Python in the row path."""

from __future__ import annotations

import functools
import html.entities
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from . import fixed as K


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def alternation(terms: Sequence[str]) -> str:
    """Quoted terms as one regex alternation, longest first so a longer term wins at the same start."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    return "|".join(re.sub(r"([.^$*+?()\[\]{}\\|])", r"\\\1", t) for t in ordered)


def strip(col: Column | str) -> Column:
    """Remove whitespace of any kind at both ends (Spark's ``trim`` removes spaces only)."""
    return F.btrim(as_col(col), F.lit(K.WHITESPACE))


def is_null_like(col: Column | str, values: Sequence[str], *, trimmed: bool = True) -> Column:
    """Null or one of the (lower-case) spellings. Anchored, so a long text is refused at its first characters."""
    col = as_col(col)
    edge = r"\s*" if trimmed else ""
    return col.isNull() | F.rlike(col, F.lit(rf"(?iU)\A{edge}(?:{alternation(values)}){edge}\z"))


def let(col: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; Spark does not share work between branches of a condition."""
    return F.get(F.transform(F.array(col), body), F.lit(0))


CHUNK = 64


def running_sums(numbers: Column) -> Column:
    """Sums up to each place. Chunks keep the cost in proportion to the length, though arrays are copied to grow."""
    def grown(values: Column) -> Column:
        first = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(values, first, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["all"], s["sum"] + x).alias("all")))["all"]

    def offset(chunks: Column) -> Column:
        before = grown(F.transform(chunks, lambda c: F.get(c, F.size(c) - 1)))
        return let(before, lambda sums: F.flatten(F.transform(chunks, lambda c, k: F.transform(
            c, lambda x: x + F.when(k > 0, F.get(sums, k - 1)).otherwise(0)))))

    starts = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / CHUNK).cast("int"))
    return let(F.transform(starts, lambda k: grown(F.slice(numbers, k * CHUNK + 1, F.lit(CHUNK)))), offset)


def has_words(col: Column | str, n: int) -> Column:
    """Whether a stripped text has at least ``n`` words; looks no further than word ``n``."""
    return F.rlike(as_col(col), F.lit(rf"(?U)^(?:\S++\s++){{{n - 1}}}\S"))


def word_count(col: Column | str) -> Column:
    """Number of whitespace-separated words; null for null."""
    return F.regexp_count(as_col(col), F.lit(r"(?U)\S+"))


def words(col: Column | str) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(as_col(col), r"\s+"), lambda w: w != "")


def clean_text(col: Column | str, min_words: int = 10) -> Column:
    """Sanitise a text in a fixed order of replacements; null-like or short text becomes ''.

    Tags, separator runs and boilerplate phrases become a space, a bullet alone on its line joins the next
    line, links and addresses become markers, newline runs shrink to two and space runs to one.
    """
    col = as_col(col)
    text = col
    for pattern, replacement in (
        (K.HTML_TAG, " "),
        (K.SEPARATOR, " "),
        (K.BROKEN_BULLET, "- "),
        (f"(?U){K.BOILERPLATE}", " "),
        (f"(?U){K.URL}", "[LINK]"),
        (rf"(?U)(?<!\S){K.EMAIL}", "[EMAIL]"),
        (K.NEWLINES, "\n\n"),
        (K.SPACES, " "),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    cleaned = let(strip(text), lambda t: F.when(has_words(t, min_words), t).otherwise(F.lit("")))
    return F.when(is_null_like(col, K.META_NULLS), F.lit("")).otherwise(cleaned)


def collapse_ws(col: Column | str) -> Column:
    """Every whitespace run becomes one space; ends are trimmed."""
    return strip(F.regexp_replace(as_col(col), r"(?U)\s+", " "))


def truncate(col: Column | str, n: int) -> Column:
    return F.substring(as_col(col), 1, n)


def title_case(col: Column | str) -> Column:
    """Upper-case the first letter of every letter run (``initcap`` only looks at spaces)."""
    runs = F.regexp_extract_all(as_col(col), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def strip_literal(col: Column | str, literal: str) -> Column:
    return strip(F.replace(as_col(col), F.lit(literal)))


def not_contained(a: Column | str, b: Column | str, n: int = 100) -> Column:
    """``a``, or null when it is empty or its first ``n`` characters already occur in ``b``."""
    a, b = as_col(a), as_col(b)
    return F.when((a != "") & ~F.contains(b, F.substring(a, 1, n)), a)


def deep_links(link: Column | str, texts: Sequence[Column | str]) -> Column:
    """Distinct bracketed URLs of the joined texts plus the main link."""
    joined = F.concat(*[F.coalesce(as_col(t), F.lit("")) for t in texts])
    found = F.concat(F.array(as_col(link)), F.regexp_extract_all(joined, F.lit(K.DEEP_LINK), F.lit(1)))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != "")))


REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"
# references that pages use most stand first, since a map is searched in order
COMMON_REFERENCES = ("nbsp;", "amp;", "lt;", "gt;", "quot;", "apos;", "copy;", "middot;")


@functools.cache
def named_references() -> tuple[str, str]:
    """All named references of HTML with their characters, and those that are read without a semicolon, as text for
    ``str_to_map``. They come from the standard library."""
    order = [*COMMON_REFERENCES, *(n for n in html.entities.html5 if n not in COMMON_REFERENCES)]
    lists = ([n for n in order if n.endswith(";")], [n for n in order if not n.endswith(";")])
    return tuple("\x01".join(f"{n}\x02{html.entities.html5[n]}" for n in names) for names in lists)


def code_point(number: Column) -> Column:
    """The character of a code point. The numbers 128 to 159 mean those of the Windows code page, where it has one."""
    windows = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    mapped = F.str_to_map(F.lit("\x01".join(f"{n}\x02{c}" for n, c in windows.items() if c)), F.lit("\x01"), F.lit("\x02"))
    none = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (F.when(none, F.lit("\ufffd")).when(number.between(128, 159), F.coalesce(F.try_element_at(mapped, number.cast("string")), char))
            .otherwise(char))


def character_of(reference: Column) -> Column:
    """What one match of REFERENCE stands for; an unknown name stays as it is."""
    with_end, without = (F.str_to_map(F.lit(t), F.lit("\x01"), F.lit("\x02")) for t in named_references())
    longest = max(len(n) for n in html.entities.html5 if not n.endswith(";"))

    def named(name: Column) -> Column:
        starts = [F.try_element_at(without, F.substring(name, 1, n)) for n in range(longest, 1, -1)]
        rest = [F.substring(name, n + 1, 40) for n in range(longest, 1, -1)]
        short = F.coalesce(*[F.concat(c, r) for c, r in zip(starts, rest)])
        return F.coalesce(F.try_element_at(with_end, name), short, F.concat(F.lit("&"), name))

    def numbered(digits: Column, base: int, width: int) -> Column:
        plain = F.regexp_replace(digits, "^0+(?=.)", "")
        number = F.when(F.length(plain) > width, F.lit(0x110000)).otherwise(F.conv(plain, base, 10).cast("int"))
        return let(number, code_point)

    decimal, hexadecimal = F.regexp_extract(reference, "^&#([0-9]+)", 1), F.regexp_extract(reference, "^&#[xX]([0-9a-fA-F]+)", 1)
    return (F.when(F.startswith(reference, F.lit("&#")), F.when(decimal != "", numbered(decimal, 10, 7)).otherwise(numbered(hexadecimal, 16, 6)))
            .otherwise(let(F.substring(reference, 2, 40), named)))


def decode_entities(col: Column) -> Column:
    """The text with every character reference of HTML decoded, named, decimal or hexadecimal, in one pass, so nothing
    is decoded twice. Older names are read without their semicolon too, as browsers do."""
    def decoded(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
        return let(F.split(text, REFERENCE, -1), lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(F.zip_with(
            found, F.slice(parts, F.lit(2), F.size(parts)), lambda r, rest: F.concat(character_of(r), rest)), "")))

    return let(col, lambda text: F.when(F.contains(text, F.lit("&")), decoded(text)).otherwise(text))


def count_marker(col: Column | str, marker: str) -> Column:
    """How often a literal marker occurs."""
    return F.regexp_count(as_col(col), F.lit(alternation([marker])))

"""Oracle-side expressions shared by the checked queries."""

WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def wc(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def sub(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(replacement)}, 'g')"


def null_like(x: str, values) -> str:
    return f"({x} IS NULL OR lower({strip(x)}) IN ({', '.join(q(v) for v in values)}))"


def clean(x: str, min_words: int = 10) -> str:
    from ..functions import fixed as K
    text = x
    for pattern, replacement in ((K.HTML_TAG, " "), (K.SEPARATOR, " "), (K.BROKEN_BULLET, "- "), (K.BOILERPLATE, " "),
                                 (K.URL, "[LINK]"), (K.EMAIL, "[EMAIL]"), (K.NEWLINES, "\n\n"), (K.SPACES, " ")):
        text = sub(text, pattern, replacement)
    text = strip(text)
    return f"CASE WHEN {null_like(x, K.META_NULLS)} OR {wc(text)} < {min_words} THEN '' ELSE {text} END"


def safe_meta(x: str, default: str = "Unspecified") -> str:
    return f"CASE WHEN {null_like(x, ['nan', 'none', 'n/a', ''])} THEN {q(default)} ELSE {strip(x)} END"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), "
            "lambda r: upper(r[1:1]) || lower(r[2:])), '')")


def context(prefix: str = "") -> str:
    cols = ", ".join(f"{prefix}{c}" for c in ("scholarship_name", "description", "eligibility", "scholarship_details"))
    return (f"array_to_string(list_filter([{cols}], lambda p: p IS NOT NULL AND lower(p) NOT IN "
            "('nan', 'n/a', 'none')), ' ')")


def contains_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"

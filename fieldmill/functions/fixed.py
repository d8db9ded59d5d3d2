"""Word lists, patterns and constants that decide results."""

# Money, matched on lower-cased text; group 1 is the amount.
MONEY = (
    r"((?:\$|€|£|eur|usd)\s?\d{1,3}(?:,\d{3})*(?:\.\d+)?"
    r"|\d{1,3}(?:,\d{3})*(?:\.\d+)?\s?(?:€|eur|euros?|usd|\$))"
)
FUNDING_BOILERPLATE = "fully/partially funded (check details)"

# Funding keywords, categories tested in this order.
FUNDING_TAXONOMY = {
    "Fully Funded": [
        "full ride", "fully funded", "covers tuition and living", "full tuition", "monthly payment",
        "monthly payments", "monthly stipend", "stipend", "living expenses", "travel allowance",
        "health insurance", "comprehensive",
    ],
    "Partially Funded": [
        "partial", "covers tuition only", "discount", "contribution", "stipend only", "one-time",
        "lump sum", "fee reduction",
    ],
}
FUNDING_DEFAULT = "Variable / Unspecified"
FIXED_GRANT = "Fixed Grant"

# Level terms (whole tokens) and tag names per level.
LEVEL_TAXONOMY = {
    "Undergraduates": ["undergraduate", "bachelor", "high school", "freshman", "bsc", "b.a", "b.s"],
    "Graduates": ["graduate", "master", "msc", "m.a", "mba", "postgraduate"],
    "Doctoral/PhD": ["phd", "doctoral", "doctorate", "post-doc", "postdoctoral"],
}
LEVEL_TAGS = {
    "undergraduates": "Undergraduates",
    "graduates": "Graduates",
    "doctoral candidates/phd students": "Doctoral/PhD",
    "doctoral/phd": "Doctoral/PhD",
    "postdoctoral researchers": "Doctoral/PhD",
}
UNSPECIFIED = "Unspecified"

# Profile level -> item levels; other levels see only unspecified items.
PROFILE_LEVELS = {
    "Bachelor": ["Undergraduates", "Unspecified"],
    "Master": ["Graduates", "Unspecified"],
    "PhD": ["Doctoral/PhD", "Unspecified"],
    "Postdoc": ["Doctoral/PhD", "Unspecified"],
}
ITEM_LEVELS = ["Undergraduates", "Graduates", "Doctoral/PhD", "Unspecified"]

# Countries.
HOST_TAGS = [("Germany", ["germany", "daad"]), ("USA", ["college selection", "usa"])]
TARGET_NATIONALITIES = ["egypt", "syria", "jordan", "saudi arabia"]
ANY_NATIONALITY = "International / All"
HOST_KEYWORDS = ["study in", "travel to", "universities in", "located in", "host", "tenable in"]
NATIONALITY_KEYWORDS = ["citizens of", "citizenship", "open to", "nationals of", "from", "passport"]

# Null-like spellings; each operator has its own list.
CONTEXT_NULLS = ["nan", "n/a", "none"]
META_NULLS = ["nan", "none", "n/a", ""]
DEADLINE_NULLS = ["not specified", "varies", "nan", "none", "rolling", "continuous"]
STEPS_NULLS = ["nan", "none", "n/a", "not specified", "tba", ""]
PROFILE_NULLS = ["", "N/A", "Not Specified"]
DEAD_TEXT = ["none", "n/a", "not specified", "tba", ""]
NOT_SPECIFIED = "Not Specified"
STEPS_FALLBACK = (
    "Please visit the official scholarship website for detailed application instructions and requirements."
)

# Cleaning patterns.
HTML_TAG = r"<[^>]+>"
SEPARATOR = r"-{3,}|={3,}|\*{3,}"
BROKEN_BULLET = r"[•-]\s*\n"
NEWLINES = r"\n{3,}"
URL = r"https?://\S+|www\.\S+"
EMAIL = r"\S+@\S+"
SPACES = r" {2,}"
BOILERPLATE = (
    r"(?i)\b(click here|read more|all rights reserved|subscribe(?: to)?|download(?: pdf)?|official website"
    r"|apply now|learn more|contact us|faq(?:s)?|frequently asked questions|privacy policy"
    r"|terms (?:of use|and conditions)|cookie policy|copyright|follow us(?: on)?|share this|newsletter)\b"
)
WHITESPACE_NOISE = r"\s{3,}|\n{2,}"
NBSP = "\xa0"
DEEP_LINK = r"\[(https?://[^\s\]]+)\]"
US_ADDRESS = r", [A-Z]{2} \d+"
PLACEHOLDER = r"##[A-Z]+##"

# Text whitespace as a trim set (the characters a plain strip removes).
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Ineligibility phrases and page junk.
INELIGIBLE = ["Not Eligible", "If your status and/or country is not included"]
JUNK_CLASSES = ["print-only", "invisible-print", "visible-de", "hidden-desktop", "info-icon-wrapper"]
VARIANT_COUNTRIES = ["Egypt", "Syria", "Jordan", "Saudi Arabia"]
VARIANT_LEVELS = ["Undergraduates", "Graduates", "Doctoral candidates/PhD students"]

# Query intents.
BYPASS_NAMES = ["daad", "erasmus", "chevening", "fulbright", "eiffel", "mext"]
FULL_FUNDING_PHRASES = ["fully funded", "full funding", "fully-funded", "100% funded", "ممولة بالكامل"]
PARTIAL_FUNDING_PHRASES = ["partially funded", "partial funding", "ممولة جزئيا"]
OPEN_MARKERS = ["International", "Unspecified", "All", "World"]

# Retrieval numbers.
RRF_K = 60
FETCH_K = 15
TOP_K = 5
OVERFETCH = 3
MIN_SCORE = 0.05
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# Stores and reports.
STORE_DROPS = ["country", "degree_level", "funding_type", "deadline", "tags", "parsed_date", "is_expired"]
POLLUTION = [
    ("country", "USA"), ("country", "Germany"),
    ("funding_type", "Fully/Partially Funded (Check Details)"), ("funding_type", "N/A"),
    ("deadline", "N/A"), ("deadline", "Not Specified"),
    ("description", "N/A"),
    ("awards_available", "Varies"), ("awards_available", "N/A"),
]
NOISE_TOPICS = [
    "sourdough baking", "league fixtures", "bronze age trade", "bicycle repair", "tide tables",
]
LINK_FOOTER = "**Official Application Link:**"
CHUNK_CONFIGS = [
    ("Strict/Fine-Grained", 400, 50), ("Balanced (Recommended)", 800, 100), ("Broad Context", 1200, 150),
]

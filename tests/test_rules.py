"""Edge rows of the standardisation rules."""

import pytest
from pyspark.sql import functions as F

from fieldmill.functions import fixed as K, rules as R
from fieldmill.operators.profiles import level_synonym, validate_profile
from fieldmill.functions.text import clean_text, title_case, word_count


@pytest.mark.parametrize("text, amount", [
    ("award of $5000 now", "$500"), ("25000 euros", "000 eur"), ("up to 1,200.50 usd", "1,200.50 usd"),
    ("€ 900 a month", "€ 900"), ("no money", None)])
def test_money(one, text, amount):
    assert one(R.money("x"), x=text) == amount


@pytest.mark.parametrize("text, category", [
    ("$500 and a full ride", "Fixed Grant"), ("stipend only", "Fully Funded"), ("a discount", "Partially Funded"),
    ("nothing", "Variable / Unspecified")])
def test_funding_category(one, text, category):
    assert one(R.funding_category("x", R.money("x")), x=text) == category


def test_first_tag_wins(one):
    assert one(R.first_mapped_tag("t"), t=["graduates", "undergraduates"]) == "Graduates"
    assert one(R.first_mapped_tag("t"), t=["x"]) is None


@pytest.mark.parametrize("text, level", [
    ("for masters", None), ("a Master here", "Graduates"), ("undergraduate", "Undergraduates"), ("a bachelor's", "Undergraduates"),
    ("graduate or undergraduate", "Graduates"), ("post-doc", "Doctoral/PhD"), ("b.a", "Undergraduates"), ("bxa", None)])
def test_first_phrase(one, text, level):
    assert one(R.first_phrase("x"), x=text) == level


def test_tags_from_text(one):
    assert one(R.split_tags("x"), x="['DAAD', \"Egypt\"]") == ["daad", "egypt"]
    assert one(R.split_tags("x"), x=None) == []


def test_host_country(one):
    assert one(R.host_country("t", "c"), t=[], c="Austin, TX 78701 (USA)") == "Unspecified"
    assert one(R.host_country("t", "c"), t=[], c=" USA ") == "USA"
    assert one(R.host_country("t", "c"), t=["usa", "daad"], c="USA") == "Germany"


def test_target_values(one):
    assert one(R.target_values("t"), t=["syria", "saudi arabia", "x"]) == "Saudi Arabia, Syria"
    assert one(R.target_values("t"), t=["x"]) == "International / All"


@pytest.mark.parametrize("text, date", [
    ("2025-03-01", "2025-03-01"), ("March 1st, 2025", "2025-03-01"), ("1 mar 2025", "2025-03-01"), ("13/02/2025", "2025-02-13"),
    ("02/03/2025", "2025-02-03"), ("Saturday, March 1, 2025", "2025-03-01"), ("2025-03-01 10:30", "2025-03-01"),
    ("Sept 5, 2026", "2026-09-05"), ("Jan. 5, 2026", "2026-01-05"), ("12/31/25", "2025-12-31"), ("2026.03.01", "2026-03-01"),
    ("20260301", "2026-03-01"), ("2026-03-01T23:59:00Z", "2026-03-01"), ("March 5, 2026 11:59 PM EST", "2026-03-05"),
    ("September 5, 2026 at 17:00", "2026-09-05"), ("2025-02-30", None), ("March 2025", None), ("soon", None), (None, None)])
def test_parse_date(one, text, date):
    assert one(R.parse_date("x"), x=text) == date


@pytest.mark.parametrize("raw, context, out", [
    ("varies", "apply by 2025-05-01", "2025-05-01"), ("varies", "none", "Not Specified"),
    ("May 1, 2025", "apply by 2024-01-01", "2025-05-01"), ("n/a", "no date", "Not Specified")])
def test_deadline(one, raw, context, out):
    assert one(R.standardise_deadline("r", "c"), r=raw, c=context) == out


def test_status_on_the_reference_day(one):
    day = F.to_date(F.lit("2025-06-01"))
    assert one(R.status(day, "2025-06-01 12:00:00")) == "Expired"
    assert one(R.status(day, "2025-06-01 00:00:00")) == "Active"
    assert one(R.status(F.lit(None).cast("date"), "2025-06-01")) == "Rolling/Unspecified"
    assert one(R.is_expired(F.lit(None).cast("date"), "2025-06-01")) is False


def test_impute_short(one):
    nine, ten = " ".join("a" * 9), " ".join("a" * 10)
    assert one(R.impute_short("x"), x=nine) == K.STEPS_FALLBACK
    assert one(R.impute_short("x"), x=ten) == ten
    assert one(R.impute_short("x"), x=None) == K.STEPS_FALLBACK


def test_clean_text(one):
    assert one(clean_text("x"), x=" ".join(["word"] * 9)) == ""
    assert one(clean_text("x"), x=" N/A ") == ""
    text = "<p>one two three</p> four --- five six seven eight •\n nine read more ten http://a.b me@c.d\n\n\n\nend"
    assert one(clean_text("x"), x=text) == "one two three four five six seven eight - nine ten [LINK] [EMAIL]\n\nend"
    again = one(clean_text("x"), x=one(clean_text("x"), x=text))
    assert again == one(clean_text("x"), x=text)


def test_words_and_titles(one):
    assert one(word_count("x"), x=" a\xa0b \n c ") == 3
    assert one(title_case("x"), x="cote d'ivoire guinea-bissau") == "Cote D'Ivoire Guinea-Bissau"


def test_replies(one):
    assert one(R.parse_reply("x", "k", "d"), x='```json\n{"k": "v"}\n```') == "v"
    assert one(R.parse_reply("x", "k", "d"), x='{"k": "v"') == "d"
    assert one(R.parse_reply("x", "k", "d"), x='{"o": 1}') == "d"


@pytest.mark.parametrize("text, level", [
    ("msc", "Master"), ("postdoctorate", "PhD"), ("PostDoc", "Postdoc"), ("diploma", None), ("Undergrad", "Bachelor")])
def test_level_synonym(one, text, level):
    assert one(level_synonym("x"), x=text) == level


def test_profile_ranges(spark):
    rows = [("a", "syria", "msc", "CS", 4.5, 20), ("b", "syria", "msc", "CS", 100.5, 20), ("c", "syria", "msc", "CS", 3.0, 15),
            ("d", "syria", "msc", "CS", 3.0, None), ("e", "syria", "diploma", "CS", 3.0, None), ("f", None, "msc", "CS", 3.0, None)]
    df = spark.createDataFrame(rows, "session_id string, nationality string, academic_level string, academic_major string, gpa double, age int")
    valid, rejected = validate_profile(df)
    assert {r.session_id for r in valid.collect()} == {"a", "d"}
    assert {r.session_id: list(r.errors) for r in rejected.collect()} == {
        "b": ["gpa out of range"], "c": ["age out of range"], "e": ["academic_level unknown"], "f": ["nationality missing"]}


def test_a_date_far_back_in_the_text_counts(one):
    assert one(R.standardise_deadline(F.lit("varies"), F.lit("word " * 4000 + "2030-05-01"))) == "2030-05-01"

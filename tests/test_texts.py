"""Chunks, documents and pages on small literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from fieldmill.functions.html import Step, elements, html_to_text
from fieldmill.functions.text import decode_entities, running_sums
from fieldmill.operators import chunks as C, documents as D, pages as P


def sections(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, md string")
    return [(r.document_title, r.section_title, r.text) for r in C.split_sections(df, "md").orderBy("section_no").collect()]


def test_sections_and_titles(spark):
    text = "# Title\n\n**Link:** x\n\n## A\nalpha\n\nbeta\n## B\n# Next\ntail"
    assert sections(spark, text) == [
        ("Title", None, "# Title  \n**Link:** x"), ("Title", "A", "## A\nalpha  \nbeta"), ("Title", "B", "## B"),
        ("Next", None, "# Next\ntail")]


def test_lone_title_joins_its_first_section(spark):
    assert sections(spark, "# Title\n\n## A\nalpha") == [("Title", "A", "# Title  \n## A\nalpha")]


def test_equal_titles_merge_and_fences_hide_headers(spark):
    assert sections(spark, "## A\none\n## A\ntwo") == [(None, "A", "## A\none  \n## A\ntwo")]
    assert sections(spark, "# T\nx\n```\n# not a header\n```\ny") == [("T", None, "# T\nx\n```\n# not a header\n```\ny")]
    assert sections(spark, "   ") == []


def merge_pieces(pieces, size, overlap):
    """Greedy runs of neighbouring pieces up to ``size``; each run restarts with the tail within ``overlap``."""
    out, start, total = [], 0, 0
    for end, piece in enumerate(pieces):
        if total + len(piece) > size and end > start:
            out.append("".join(pieces[start:end]))
            while start < end and (total > overlap or total + len(piece) > size):
                total -= len(pieces[start])
                start += 1
        total += len(piece)
    if start < len(pieces):
        out.append("".join(pieces[start:]))
    return [text for text in map(str.strip, out) if text]


def split_text(text, size, overlap, separators=C.SEPARATORS):
    """The split said plainly, by recursion over lists of pieces."""
    level = next((i for i, s in enumerate(separators) if s in text), None)
    if level is None:
        pieces, finer = list(text), None
    else:
        mark, finer = separators[level], separators[level + 1:]
        head, *tail = text.split(mark)
        pieces = [p for p in [head] + [mark + t for t in tail] if p]
    out, run = [], []
    for piece in pieces:
        if len(piece) < size or finer is None:
            run.append(piece)
            continue
        out += merge_pieces(run, size, overlap)
        run = []
        out += split_text(piece, size, overlap, finer)
    return out + merge_pieces(run, size, overlap)


def test_recursive_split_equals_the_plain_recursion(spark):
    rng = random.Random(7)
    parts = ["word ", "a. ", "\n", "\n\n", "\n\n\n", "x", " ", ".", "é🎓 ", "long" * 9, "y" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(150)] + ["", " ", None, "z" * 500, "z" * 500 + " a", ". " * 90]
    for size, overlap in ((40, 10), (80, 20), (120, 0), (50, 49), (10, 3)):
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        got = {}
        for r in C.split_recursive(df, size, overlap).orderBy("id", "chunk_no").collect():
            got.setdefault(r.id, []).append(r.text)
        for i, text in enumerate(texts):
            t = text or ""
            want = split_text(t, size, overlap) if len(t) > size else [t.strip()] if t.strip() else []
            assert got.get(i, []) == want, (size, overlap, t)
            assert all(len(p) <= size for p in want)


def test_recursive_split_of_a_very_long_text(spark):
    text = " ".join(f"word{i}" + (".\n\n" if i % 997 == 0 else "") for i in range(40_000))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert [r.text for r in C.split_recursive(df, 800, 100).orderBy("chunk_no").collect()] == split_text(text, 800, 100)


def test_recursive_split_matches_a_hand_worked_case(spark):
    df = spark.createDataFrame([(1, "aaa bbb ccc ddd"), (2, "short"), (3, "  ")], "id long, text string")
    got = [(r.id, r.chunk_no, r.text) for r in C.split_recursive(df, 8, 4).orderBy("id", "chunk_no").collect()]
    assert got == [(1, 0, "aaa bbb"), (1, 1, "bbb ccc"), (1, 2, "ccc ddd"), (2, 0, "short")]


def test_ghost_chunks(spark):
    df = spark.createDataFrame([("x" * 29 + " ",), ("x" * 30,)], "text string")
    assert [len(r.text) for r in C.prune_short(df).collect()] == [30]


def test_document_quirks(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None, words, words + " and more", None, None), (2, "N", "other " + words, words, "short", "u")]
    df = spark.createDataFrame(rows, "id long, scholarship_name string, description string, scholarship_details string, eligibility string, application_link string")
    docs = {r.id: r.rag_document for r in D.build_document(df).collect()}
    assert docs[1] == f"# Scholarship: Unspecified\n\n## Scholarship Details\n{words} and more"
    assert docs[2] == f"# Scholarship: N\n\n**Application Link:** u\n\n## Program Description\nother {words}\n\n## Scholarship Details\n{words}"


def test_context_entities_window(spark):
    df = spark.createDataFrame([
        (1, "You can study in Germany or travel far. Open to citizens of Egypt and Syria."),
        (2, "from one two three four Egypt"), (3, "from one two three four five Egypt"), (4, "open to study in New Zealand")],
        "id long, text string")
    names = spark.createDataFrame([("Germany",), ("Egypt",), ("Syria",), ("New Zealand",)], "name string")
    got = {r.id: (r.hosts, r.nationalities) for r in D.context_entities(df, "text", names, id_col="id").collect()}
    assert got == {1: ("Germany", "Egypt, Syria"), 2: (None, "Egypt"), 4: ("New Zealand", None)}


@pytest.mark.parametrize("as_table", [True, False])
def test_a_known_host_leaves_host_keywords_to_nationalities(spark, as_table):
    text = "Our host programme is open to Egypt students. Citizens of Republic of South Sudan or Cote d'Ivoire"
    df = spark.createDataFrame([(1, text, "Germany"), (2, text, "Unspecified")], "id long, context string, host_country string")
    df = df.withColumn("eligible_nationality", F.lit("International / All"))
    names = ["Egypt", "Republic of South Sudan", "Cote d'Ivoire", "kraków"]
    places = spark.createDataFrame([(n,) for n in names], "name string") if as_table else names
    rows = {r.id: r for r in D.with_places(df, places, context_col="context", id_col="id").collect()}
    assert (rows[1].host_country, rows[1].eligible_nationality) == ("Germany", "Egypt, Republic of South Sudan")
    assert (rows[2].host_country, rows[2].eligible_nationality) == ("Egypt", "Republic of South Sudan")
    named = D.with_places(df.withColumn("context", F.lit("citizens of Cote d'Ivoire, passport from kraków")), places,
                          context_col="context", id_col="id").first()
    assert named.eligible_nationality == "Cote d'Ivoire, kraków"


PAGE = """<html><body><h1> Name &amp; Co </h1><h5>$1</h5><div><p>x<span>Awards Available:</span></p><h5>3</h5></div>
<h5>Eligibility Criteria:</h5><div><div>A</div><div>B</div></div>
<h2>Scholarship Description</h2><div><p> Short <b>text</b> </p><h2>Details</h2><div><p>d1</p><p>d2</p></div><h2>Eligibility</h2></div>
<div class="contactDetail">Dean<br>Austin, TX 78701</div></body></html>"""


def test_fields(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    rows = {r.page_id: r for r in P.extract_fields(df).withColumn("country", P.location("contact_lines", "page_lines")).collect()}
    r = rows[1]
    assert (r.scholarship_name, r.funding_type, r.deadline, r.awards_available) == ("Name & Co", "$1", "3", "3")
    assert r.tags == ["A", "B"] and r.description == "Shorttext" and r.scholarship_details == "d1\nd2"
    assert r.eligibility == "N/A" and r.application_process == "N/A" and r.country == "Austin, TX 78701 (USA)"
    assert rows[2].scholarship_name == "N/A" and rows[2].tags == [] and rows[2].country == "USA" and rows[3].deadline == "N/A"


def test_strict_pair_needs_two(spark):
    df = spark.createDataFrame([(1, "<h5>a</h5>")], "page_id long, html string")
    assert P.extract_fields(df).collect()[0].funding_type == "a"
    assert P.extract_fields(df, strict_pair=True).collect()[0].funding_type == "N/A"


def test_deep_pages_do_not_overflow(spark):
    df = spark.createDataFrame([(1, "<p><b>" * 5000 + "<h1>x</h1>" + "<div>" * 5000)], "page_id long, html string")
    assert P.extract_fields(df).collect()[0].scholarship_name == "x"


def test_junk_goes_by_nesting_depth(one):
    html = ('a<div class=\'x print-only\'><div>JUNK</div>LEFT<p class="invisible-print">in</p></div>b<img class="print-only">c'
            "<p class=print-only>d</p><div class='print-only-not'>e</div><a href='/x'>f</a><a href=/y>g</a><span class='print-only'>open")
    assert one(html_to_text("x", "https://s.e"), x=html) == "a\nb\nc\ne\nf [https://s.e/x]\ng [https://s.e/y]"


def test_links_in_any_quotes(spark):
    df = spark.createDataFrame([(1, """<a href='/x'>1</a><a href=/z>2</a><a data-href="/no" href="http://y/">3</a>""")], "page_id long, html string")
    assert {r.link for r in P.harvest_links(df, "r:").collect()} == {"r:/x", "r:/z", "http://y/"}


def test_sweep_splits_sections_first(spark):
    df = spark.createDataFrame([(1, "# A\n" + "x" * 40 + "\n# B\n" + "y" * 40)], "doc_id long, text string")
    config = [("one", 400, 0)]
    assert [C.sweep_chunk_configs(df, config, by_sections=s).first().total_chunks for s in (True, False)] == [2, 1]


def test_html_to_text(one):
    html = ('<div><span class="x print-only">gone</span><script>var a=1</script><h3>Head</h3><ul><li>one</li></ul>'
            '<a href="/p">go <b>on</b></a> tail ##ABC##</div>')
    assert one(html_to_text("x", "https://s.e"), x=html) == "---\nHead\n---\n•\none\ngoon [https://s.e/p]\ntail"
    assert one(html_to_text("x", "https://s.e"), x="") == "N/A"


def test_deadline_block(one):
    html = "<h3>Application deadline</h3><p>1 May</p><ul><li>a</li><li>b</li></ul><h3>Next</h3><p>no</p>"
    assert one(P.deadline_block("x"), x=html) == "1 May\na | b"
    assert one(P.deadline_block("x"), x="<p>none</p>") == "Not Specified"


def test_variants(spark):
    df = spark.createDataFrame([("G",)], "scholarship_name string")
    rows = P.expand_variants(df).collect()
    assert len(rows) == 12 and rows[0].scholarship_name == "G (Egypt - Undergraduates)"
    assert rows[0].tags == ["DAAD", "Egypt", "Undergraduates", "Germany"]
    assert "crossJoin" not in P.expand_variants(df)._jdf.queryExecution().executedPlan().toString()


def test_listing_files(spark, tmp_path):
    import json

    from fieldmill.sources import listings as L
    (tmp_path / "daad_scholarships_data.json").write_text(json.dumps([{"scholarship_name": "a", "tags": ["x"]}, {"scholarship_name": "b"}]))
    (tmp_path / "web_scholarships_data_2.json").write_text(json.dumps([{"scholarship_name": "c"}]))
    (tmp_path / "bad_scholarships_data.json").write_text("not json")
    (tmp_path / "other.json").write_text(json.dumps([{"scholarship_name": "z"}]))
    rows = L.with_source_family(L.read_listings(spark, str(tmp_path))).collect()
    assert {(r.scholarship_name, r.source_script) for r in rows} == {("a", "DAAD"), ("b", "DAAD"), ("c", "Scholarships_com")}
    assert L.read_listings(spark, str(tmp_path)).count() == 3
    assert [r.source_file for r in L.unreadable_records(spark, str(tmp_path)).collect()] == ["bad_scholarships_data.json"]


def test_native_operators_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "# T\ntext")], "doc_id long, md string")
    plan = C.split_sections(df, "md")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_every_character_reference_is_decoded(spark):
    import html
    import html.entities
    names = sorted(html.entities.html5)
    texts = [f"a &{n} b&{n}c" for n in names] + [
        "&#233;&#xE9;&#XE9;&#8217;&#128;&#150x;&#0;&#xD800;&#x110000;&#99999999999;&#x1F600;&#0000233;", "&notit; &ampfoo &copy2 &foo; & &; &#; &#x;",
        "&amp;lt; &amp;amp;", "plain", "", "Universit&eacute; d&#8217;&Eacute;t&#233;", "&hellip", "1&2", "a&b;c&nbsp"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", decode_entities(F.col("t")).alias("d")).collect()}
    assert got.pop(-1) is None
    assert [(texts[i], d) for i, d in got.items() if d != html.unescape(texts[i])] == []


def test_running_sums(one):
    for n in (1, 2, 63, 64, 65, 200):
        numbers = [(7 * i) % 11 - 5 for i in range(n)]
        total, want = 0, []
        for x in numbers:
            total += x
            want.append(total)
        assert one(running_sums(F.array(*[F.lit(x) for x in numbers])), x=0) == want


LISTED = ('<div id="a"><ul class="x y"><li class="e">1<ul><li class="e"><a href="/1">z</a></li></ul></li><li><a href="/no">n</a></li></ul></div>'
        "<ul><li class='e f'><a href='/2?a&amp;b'>q</a></ul><a href=/3>r</a><ul class=x><li class=e><a>none</a><A HREF=\"/4\">s</A></li>")


def test_elements_end_by_depth(one):
    assert one(elements(F.col("x"), Step("li")), x=LISTED)[:2] == ['<li class="e">1<ul><li class="e"><a href="/1">z</a></li></ul>', '<li class="e"><a href="/1">z</a>']
    outer = one(elements(F.col("x"), Step("li"), outermost=True), x=LISTED)
    assert [o.count("<li") for o in outer[:2]] == [2, 1]
    assert one(elements(F.col("x"), Step("div", id="a")), x=LISTED)[0].endswith("</ul>")
    assert one(elements(F.col("x"), Step("div", id="b")), x=LISTED) == [] == one(elements(F.col("x"), Step("p")), x="")
    deep = "<div>" * 300 + "x" + "</div>" * 300
    assert [len(e) for e in one(elements(F.col("x"), Step("div")), x=deep)] == [5 + 11 * (299 - k) + 1 for k in range(300)]


def test_links_of_a_list(spark):
    pages = spark.createDataFrame([(1, LISTED), (2, None), (3, ""), (4, "<!--" + LISTED + "-->")], "page_id long, html string")
    steps = [Step("ul", "x"), Step("li", "e"), Step("a")]
    rows = {(r.link, r.first_pos) for r in P.harvest_links(pages, "r:", within=steps).collect()}
    assert rows == {("r:/1", 0), ("r:/4", 1)}
    assert {r.link for r in P.harvest_links(pages.filter("page_id < 4"), "r:", within=[Step("li", "f"), Step("a")]).collect()} == {
        "r:/2?a&b", "r:/3", "r:/4"}  # this item is not closed, so it reaches to the end


def test_program_fields(spark):
    page = ('<div id="ueberblick"><h3><b>Objective</b></h3><div>x</div><p>To <i>learn</i></p><p>more</p></div><p>Objective</p>'
            '<div id="prozess"><div><h3>Application deadline</h3><p>1 May</p></div></div>')
    plain = '<div id="ueberblick"><p>' + "y" * 400 + "</p></div>"
    pages = spark.createDataFrame([(1, page), (2, plain), (3, None)], "page_id long, html string")
    got = {r.page_id: r for r in P.program_fields(pages, "r:").collect()}
    assert (got[1].description, got[1].deadline, got[1].eligibility) == ("Tolearn", "1 May", "N/A")
    assert got[2].description == "y" * 300 + "..." and got[2].deadline == "Not Specified"
    assert got[3].description == got[3].scholarship_details == "N/A"


def test_an_incremental_chunk_store_encodes_only_what_changed(spark, tmp_path):
    from fieldmill.sources import stores as S
    path, keys, seen = str(tmp_path / "store"), ("doc_id", "chunk_no"), spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return texts.map(lambda t: [float(len(t or ""))])

    def sync(run, rows):
        before = seen.value
        S.sync_chunks(spark.createDataFrame(rows, "doc_id long, chunk_no int, text string"), path, encoder, run=run, keys=keys)
        live = sorted(((r.doc_id is None, r.doc_id, r.chunk_no, r.text, r.embedding) for r in S.live_chunks(spark, path, keys).collect()), key=repr)
        assert live == sorted(((i is None, i, n, t, [float(len(t or ""))]) for i, n, t in rows), key=repr)
        return seen.value - before

    first = [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, None), (None, 0, "x"), (4, 0, "")]
    assert sync(1, first) == 6
    assert sync(2, first) == 0
    second = [(1, 0, "a"), (1, 1, "B!"), (3, 0, ""), (None, 0, "x"), (4, 0, ""), (5, 0, "new")]
    assert sync(3, second) == 3
    assert sync(3, second) == 3  # repeated after a failure: the folder of the run is replaced
    assert sync(4, first) == 3  # a chunk may come back
    history = {r.run: (r.n_added, r.n_dropped) for r in S.sync_history(spark, path).collect()}
    assert history == {1: (6, 0), 3: (3, 3), 4: (3, 3)}


def test_merged_profiles_equal_one_profile(spark, tmp_path):
    from fieldmill.operators import profile_store as R
    rng = random.Random(2)
    rows = [(f"p{rng.randint(0, 5)}", rng.choice(["a", "b", None, "N/A", f"v{i}"]), rng.choice([None, rng.randint(0, 10 ** 6)])) for i in range(4000)] + [(None, "a", 5)]
    df = spark.createDataFrame(rows, "part string, word string, n long")
    profile = lambda d: R.profile_parts(d, F.col("part"), ["word"], {"n": F.col("n")})
    R.store_profiles(profile(df), str(tmp_path / "s"))
    R.store_profiles(profile(df.filter("part = 'p1'")), str(tmp_path / "s"))  # one part again
    got = {r.column_name: r for r in R.report(R.read_profiles(spark, str(tmp_path / "s"))).collect()}
    numbers = sorted(n for _, _, n in rows if n is not None)
    words = [w for _, w, _ in rows if w not in (None, "N/A")]
    n, w = got["n"], got["word"]
    assert (n.n_rows, n.n_missing, n.low, n.high) == (len(rows), len(rows) - len(numbers), numbers[0], numbers[-1])
    assert n.mean == pytest.approx(sum(numbers) / len(numbers))
    for p, value in ((0.25, n.p25), (0.5, n.p50), (0.95, n.p95)):
        assert abs(sum(x <= value for x in numbers) / len(numbers) - p) <= R.RANK_ERROR
    assert abs(n.n_distinct - len(set(numbers))) <= R.DISTINCT_ERROR * len(set(numbers))
    assert abs(w.n_distinct - len(set(words))) <= R.DISTINCT_ERROR * len(set(words)) and w.low is None and w.p50 is None
    assert {t["item"]: t["count"] for t in w.top[:2]} == {x: words.count(x) for x in ("a", "b")}
    assert R.report(profile(df.limit(0))).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace
    from fieldmill.session import shared_dir
    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))

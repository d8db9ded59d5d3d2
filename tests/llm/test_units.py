"""Parts without Spark, against brute force."""

import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from fieldmill.llm import html_blocks as H, packing, probminhash as P, repair as R, toxicity as X, weak_rules as Q, wfst
from fieldmill.llm.tokens import Encoder, default_vocabulary

odd = st.text(alphabet=st.sampled_from("ab  \n\n.,'s1é▁日😀\t\xa0!#<|endoftext|>"), max_size=40)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.lists(odd, max_size=6))
def test_memo_gives_the_library_ids(encoder, texts):
    ids, offsets = encoder.encode(texts)
    for k, text in enumerate(texts):
        assert ids[offsets[k]:offsets[k + 1]].tolist() == encoder.library.encode(text, add_special_tokens=False).ids + [0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=60), min_size=1, max_size=6))
def test_repair_round_trip(docs):
    ids, counts = np.array([i for d in docs for i in d], np.int64), np.array([len(d) for d in docs])
    R_pack = R.compress(ids, np.cumsum(counts), 5, min_count=2)
    assert R_pack[3].sum() == len(docs)
    shard = R.Shard(R.pack(ids, counts, 5))
    assert shard.all().tolist() == ids.tolist()
    for k, doc in enumerate(docs):
        assert shard.document(k).tolist() == doc and shard.n_ids(k) == len(doc)


def test_repair_makes_rules_and_keeps_documents_apart():
    ids, counts = np.tile([1, 2, 3, 1], 500), np.full(500, 4)
    shard = R.Shard(R.pack(ids, counts, 5))
    assert len(shard.left) and len(shard.sequence) < 1200 and shard.all().tolist() == ids.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_two_fit_packs_everything(lengths):
    bins = packing.best_two_fit(np.array(lengths, np.int64), 30)
    assert sorted(x for b in bins for x in b) == sorted(lengths)
    assert all(sum(b) <= 30 for b in bins)
    assert len(bins) <= 2 * -(-sum(lengths) // 30) + 1


def test_best_two_fit_replaces_the_smallest():
    # greedy fills 6 + 3 and leaves 1; 2 + 2 fit the gap of 4 exactly
    assert sorted(map(sorted, packing.best_two_fit(np.array([6, 3, 2, 2]), 10)))[0] == [2, 2, 6]


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)]
    assert packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.lists(st.integers(0, 3), min_size=1, max_size=30))
def test_probability_jaccard_is_the_definition(x, y):
    a, b = (P.shingles([str(i) for i in z], 2) for z in (x, y))
    left, right = dict(zip(*a)), dict(zip(*b))
    keys = set(left) | set(right)
    want = sum(1 / sum(max(left.get(e, 0) / left[d], right.get(e, 0) / right[d]) for e in keys) for d in set(left) & set(right))
    assert P.probability_jaccard(a, b) == pytest.approx(want)


def test_registers_estimate_the_similarity():
    rng = random.Random(3)
    gaps = []
    for _ in range(60):
        words = [str(rng.randrange(10 ** 6)) for _ in range(300)]
        other = [w if rng.random() < 0.97 else "x" + w for w in words] + words[:20]
        a, b = P.shingles(words), P.shingles(other)
        s = P.signatures([a, b])
        gaps.append((s[0] == s[1]).mean() - P.probability_jaccard(a, b))
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.08


def test_estimates_miss_no_more_than_the_bands():
    least = math.ceil(P.REGISTERS * (P.SIMILARITY - P.MARGIN))
    p = P.SIMILARITY
    missed = sum(math.comb(P.REGISTERS, k) * p ** k * (1 - p) ** (P.REGISTERS - k) for k in range(least))
    assert missed <= (1 - p ** P.BAND_ROWS) ** (P.REGISTERS // P.BAND_ROWS)


@pytest.fixture(scope="module")
def coder():
    return wfst.Coder(wfst.default_model())


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=wfst.default_model())


@settings(max_examples=150, deadline=None)
@given(st.lists(odd, max_size=6))
def test_pieces_are_those_of_the_library(coder, pieces, texts):
    for text, (ids, weight, restored) in zip(texts, coder.encode(texts)):
        assert ids.tolist() == pieces.encode(text)
        assert restored == (coder.machines.decode(ids) == text) == (wfst.MARK not in text)
        assert weight == sum(coder.machines.byte_weight if pieces.is_byte(i) else coder.machines.rank.get(pieces.id_to_piece(i), 0) for i in ids.tolist())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="▁theans日", min_size=1, max_size=9))
def test_the_lattice_holds_one_path(coder, text):
    """All paths of the whole lattice, brute force: exactly one has only neighbours that may stand side by side."""
    m = coder.machines

    def paths(at, last):
        if at == len(text):
            yield []
        for end in range(at + 1, len(text) + 1):
            piece = text[at:end]
            if (end == at + 1 or piece in m.halves) and (last is None or m.neighbours(last, piece)):
                for rest in paths(end, piece):
                    yield [piece, *rest]

    assert list(paths(0, None)) == [m.shortest_path(text)]


def test_very_long_and_odd_texts(coder, pieces):
    for text in ("a" * 5000, "the " * 4000, "ab" * 500 + " " * 60 + "x", "日本語" * 300, "\n" * 50, " ", "▁ ▁▁ 1", "".join(map(chr, range(32, 1500)))):
        (ids, _, _), = coder.encode([text])
        assert ids.tolist() == pieces.encode(text)


def test_every_text_is_decoded(monkeypatch):
    """``restored`` comes from the decoded pieces, for texts read word by word and for others."""
    coder, many = wfst.Coder(wfst.default_model()), ["two words", "two words\nagain", "two  words", ""]
    seen, real = [], coder.machines.decode
    monkeypatch.setattr(coder.machines, "decode", lambda ids: seen.append(ids.tolist()) or real(ids))
    found = coder.encode(many)
    assert seen == [ids.tolist() for ids, _, _ in found] and [restored for _, _, restored in found] == [True] * 4
    at = coder.machines.value_starts[found[0][0][0]]
    coder.machines.values = coder.machines.values.copy()
    coder.machines.values[at + 1] ^= 1  # the first piece no longer reads back
    assert [restored for _, _, restored in coder.encode(many)] == [False, False, False, True]


def test_other_models_are_refused(tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(wfst.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        wfst.Machines(str(tmp_path / "m.model"))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_windows_against_brute_force(words):
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    assert Q.repeated_window_words(words, 3) == len(covered)


def test_measures():
    counts = dict(zip(Q.MEASURES, Q.measure("a b\n\na b\n\u00c4\u00a0#x! y")))  # a no-break space is part of a word
    assert counts["n_words"] == 6 and counts["word_chars"] == 10 and counts["n_symbols"] == 1 and counts["n_dup_lines"] == 1
    assert set(Q.measure("")) == {0}


def test_em_trusts_what_good_texts_hardly_break():
    rules = len(Q.RULES)
    fine = np.full(rules, Q.GOOD)
    kinds = [fine] + [np.where(np.arange(rules) == k, Q.BAD, Q.GOOD) for k in (0, 1)] + [np.full(rules, Q.ABSTAIN)]
    patterns, counts = np.array(kinds), np.array([8000.0, 700, 600, 10])
    p = Q.posteriors(patterns, *Q.fit(patterns, counts))
    assert p[0] > 0.9 and p[1] < 0.5 and p[2] < 0.5
    assert (Q.decode_votes(Q.encode_votes(patterns)) == patterns).all()


def test_readings():
    assert X.readings("«Word,»") == ("word", "word")
    assert X.readings("l0ser!")[1] == "loseri" or "loser" in X.readings("l0ser")[1]
    assert X.readings("") == ("", "")


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


LONG = "the house of the man is in the garden and it was not for you to see that from there at all"


@pytest.mark.parametrize("html, want", [
    ("", ""), (None or "", ""),
    (page(f"<nav><a href='/'>the home</a></nav><article><h1>A</h1><p>{LONG}<p>b &amp;<br> c</article><footer>x</footer>"), f"A\n{LONG}\nb & c"),
    (page(f"<div class='ad'>{LONG}</div><p>{LONG}</p><p>short</p><div id=comments><p>{LONG}</p></div>"), f"{LONG}\nshort"),
    (page(f"<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>{LONG}</p><aside>no</aside></main>"), f"Title\n{LONG}"),
    ("<p>a<script>var x='</p>'</script>&lt;b&gt;", "a<b>"),
    ("<article><p>one<div class=ad>no</div><p>two</article>", "one\ntwo"),
    ("<style>p{}</style><form>f</form>plain", "plain"),
])
def test_pages(html, want):
    assert H.extract(html) == want


@pytest.mark.parametrize("html, want", [
    (page(f"<div class=entry-content><h1>A</h1><p>{LONG}</p><p>{LONG} too</p></div><article class=comment>{LONG}</article>"), f"A\n{LONG}\n{LONG} too"),
    (page(f"<div class=entry-content><p>{LONG}</p><p>{LONG} too</p></div><article><h2>Teaser</h2><a href=x>more</a></article>"), f"{LONG}\n{LONG} too"),
    (page(f"<div class='layout has-sidebar'><p>{LONG}</p></div>"), LONG),
    (page(f"<main class='no-sidebar'><p>{LONG}</p></main>"), LONG),
    (page(f"<div class='comments-area'><main><p>{LONG}</p></main></div>"), LONG),
    (page(f"<div class='post-header'><h1>Title</h1></div><p>{LONG}</p>"), f"Title\n{LONG}"),
    (page(f"<p>{LONG}</p><section id='related-work'><h2>Related</h2><p>{LONG} too</p></section>"), f"{LONG}\nRelated\n{LONG} too"),
    (page(f"<div class='elementor-widget'><p>{LONG}</p></div><div class='elementor-widget'><p>{LONG} too</p></div>"), f"{LONG}\n{LONG} too"),
    (page(f"<form><div class=menu><a href=x>home</a></div><p>{LONG}</p></form>"), LONG),
    (page(f"<p>{LONG}</p><div class=sidebar><h3><a href=y>News</a></h3><ul><li><a href=x>one</a><li><a href=x>two</a></ul>by us</div>"), LONG),
    (page(f"<p>{LONG}</p><div class=comments><p>{LONG} one</p><p>{LONG} two</p></div>"), LONG),
    (f"<html><head><meta charset=utf-8><title>t</title><body><p>{LONG}</p></body></html>", LONG),
    (f"<head><title>t</title><style>p{{}}</style><p>{LONG}</p>", LONG),
])
def test_pages_keep_their_article(html, want):
    assert H.extract(html) == want


@pytest.mark.parametrize("text", [
    "Дом этого человека стоит в саду, и оттуда его совсем не было видно, пока не подошли ближе к самой калитке у дороги.",
    "Dom tego człowieka stoi w ogrodzie i nie można go było stamtąd zobaczyć, dopóki nie podeszliśmy bliżej furtki przy drodze.",
    "这个人的房子在花园里，从那里根本看不到它，直到我们走近路边的小门，才看见窗户里亮着的灯光和门口坐着的一位老人。",
    "يقع بيت هذا الرجل في الحديقة ولم يكن من الممكن رؤيته من هناك حتى اقتربنا من البوابة الصغيرة الواقعة على جانب الطريق القديم",
])
def test_pages_in_other_languages_keep_their_paragraphs(text):
    html = page(f"<div><h1>{text[:3]}</h1><p>{text}</p><p>{text[::-1]}</p></div><div><a href=a>x</a> <a href=b>y</a></div>")
    assert H.extract(html) == f"{text[:3]}\n{text}\n{text[::-1]}"


def test_long_blocks_without_stop_words_stay_boilerplate_on_known_pages():
    assert H.extract(page(f"<p>{LONG}</p><p>{LONG}</p><div>{'Keyword list item ' * 6}</div>")) == f"{LONG}\n{LONG}"


def test_crc_is_little_endian():
    assert zlib.crc32(np.array([1, 0], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\0\0\0\0")


def test_no_pair_stays_frequent_and_ranges_decode_by_lengths():
    rng = np.random.default_rng(8)
    words = [rng.integers(0, 50, rng.integers(2, 9)) for _ in range(30)]
    docs = [np.concatenate([words[k] for k in rng.integers(0, 30, rng.integers(1, 200))]) for _ in range(60)]
    docs += [np.full(500, 7), np.array([3]), docs[0], docs[0]]
    ids, counts = np.concatenate(docs), np.array([len(d) for d in docs])
    left, _, seq, last = R.compress(ids, np.cumsum(counts), 50)
    codes = ((seq[:-1] << 32) | seq[1:])[~last[:-1]]
    # a run of one id counts every neighbour, though it can be replaced at every other place only
    pairs, often = np.unique(codes, return_counts=True)
    assert len(left) and not (often[(pairs >> 32) != (pairs & 0xFFFFFFFF)] >= R.MIN_COUNT).any()
    shard = R.Shard(R.pack(ids, counts, 50))
    for k, d in enumerate(docs):
        assert (shard.document(k) == d).all() and shard.n_ids(k) == len(d)
        for a, b in rng.integers(-2, len(d) + 3, (6, 2)):
            assert (shard.range(k, int(a), int(b)) == d[max(a, 0):max(b, 0)]).all()


def test_places_in_crowded_buckets(monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 8)
    monkeypatch.setattr(R, "bucket", lambda codes: codes.astype(np.uint64) % np.uint64(8))
    pairs, codes = np.arange(0, 100, 3), np.random.default_rng(1).integers(0, 120, 1000)
    at, found = R.places_of(pairs, codes)
    assert at.tolist() == [i for i, c in enumerate(codes) if c < 100 and c % 3 == 0] and (pairs[found] == codes[at]).all()


@pytest.mark.parametrize("memo", [5, 100_000])
def test_special_strings_are_read_as_the_library_does(memo):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a b", "", "c  d", "a <|endoftext b", "a\nb c d e f g h i j"] * 2
    plain, as_text = Encoder(default_vocabulary(), memo), Encoder(default_vocabulary(), memo, special_as_text=True)
    from tokenizers import Tokenizer
    for own, special in ((plain, False), (as_text, True)):
        library = Tokenizer.from_file(default_vocabulary())
        library.encode_special_tokens = special
        for some in (texts[:3], texts[3:], texts):
            ids, offsets = own.encode(some)
            assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [library.encode(t, add_special_tokens=False).ids + [0] for t in some]


def test_a_word_of_a_compound_name_does_not_drop_an_article():
    text = "The river and the bridge are in the old town, and it is said that they were built by the same people as the walls."
    for name in ("social-science", "share-price", "skip_logic", "login-history"):
        assert H.extract(f'<div class="{name}"><p>{text}</p></div><div class="footer"><p>{text}</p></div>') == text, name
        assert H.extract(f'<div><p>{text}</p><p class="{name}">{text} Again.</p></div>') == f"{text}\n{text} Again.", name
    for name in ("social", "share-buttons", "post-share", "social-media-links", "skip-link", "comment-body", "ad-slot", "site-footer"):
        assert H.extract(f'<div><p>{text}</p><div class="{name}"><p>{text} Again.</p></div></div>') == text, name
    assert H.extract(f"<p>{text} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p>") == text + " x=2"


def test_the_memo_keeps_words_that_come_again():
    encode, asked = Encoder(default_vocabulary(), 20), []
    real = encode.plain
    encode.plain = lambda text: asked.append(text) or real(text)
    for text in ("a " + " ".join(f"once{i}" for i in range(15)), "a late other", "a other late x", "a " + " ".join(f"new{i}" for i in range(9)), "a late once3 other"):
        ids, _ = encode.encode([text], None)
        assert ids.tolist() == encode.library.encode(text, add_special_tokens=False).ids
    assert asked[-1].split() == ["once3"] and encode.starts.tolist() == (np.cumsum(encode.lengths) - encode.lengths).tolist()
    assert len(encode.memo) == len(encode.starts) == len(encode.again) and list(encode.memo.values()) == list(range(len(encode.memo)))


def test_last_marks_of_a_word_are_asked_on_their_own():
    encode, asked = Encoder(default_vocabulary()), []
    real = encode.plain
    encode.plain = lambda text: asked.append(text) or real(text)
    odd = ["a, ab, é, aé. a× ×, a×, a÷! don't. x'. 'll, (b), 1.5%% 3,\n,\nab.%%%\n... ,ab .. ß?! œ, ж, 汉, 汉。 é, ²³, _x_, <|x|>, a<|endoftext|"]
    for texts in (["house, tree."], ["house. tree!!"], odd, ["", "house,"], ["."]):
        ids, cuts = encode.encode(texts)
        for k, text in enumerate(texts):
            assert ids[cuts[k]:cuts[k + 1]].tolist() == encode.library.encode(text, add_special_tokens=False).ids + [0]
    assert sum("house" in text for text in asked) == 1
    assert not any("house." in text or "house," in text for text in asked)


def test_likely_pairs_are_those_of_a_plain_comparison():
    rng = np.random.default_rng(7)
    rows = []
    for bucket in range(30):
        blocks = 1 + bucket % 2
        marks = rng.integers(0, 3, (12, 20)).astype(np.uint16)
        marks[1::3] = marks[0]
        marks[1::3, 7] = 9
        own = rng.integers(0, blocks, 12)
        for i, j in {(0, 0)} if blocks == 1 else {(0, 0), (0, 1), (1, 1)}:
            rows += [(bucket, i, j, int(own[k]), bucket % 4, 100 * bucket + k, k % 5, marks[k].tobytes()) for k in range(12) if own[k] in (i, j)]
    frame = pd.DataFrame(sorted(rows), columns=["bucket", "i", "j", "own", "band", "node", "label", "registers"])
    want = set()
    for _, block in frame.groupby(["bucket", "i", "j"]):
        for x in block.itertuples():
            for y in block.itertuples():
                a, b = np.frombuffer(x.registers, np.uint16), np.frombuffer(y.registers, np.uint16)
                met = x.own == x.i and y.own == y.j and (x.i != x.j or x.node < y.node)
                earlier = (a == b).reshape(-1, 5).all(1)[:x.band].any()
                if met and x.label != y.label and (a == b).mean() >= 0.5 and not earlier:
                    want.add((min(x.node, y.node), max(x.node, y.node)))
    for size in (1, 7, 50, len(frame)):  # blocks are put together again wherever frames end
        got = set()
        for part in P.whole_blocks(frame.iloc[a:a + size] for a in range(0, len(frame), size)):
            for left, right, share in P.likely_pairs(part, 0.5, 5):
                node = part["node"].to_numpy()
                got |= {(min(a, b), max(a, b)) for a, b in zip(node[left].tolist(), node[right].tolist())}
                assert (share >= 0.5).all()
        assert got == want and len(want) > 20

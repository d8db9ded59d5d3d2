"""Operators on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill.llm import (chat_format, html_blocks, order_minhash, packing, probminhash, repair, site_lines, toxicity, weak_rules, wfst)
from fieldmill.llm.common import OWN
from fieldmill.llm.tokens import Encoder, default_vocabulary

LONG = " ".join(f"word{i}" for i in range(3000))
EDGE = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (3, "", "s"), (None, "x y", "s"), (5, LONG, "t"), (6, "  odd \n\n white ", "t")]


def test_repair_rows(docs):
    got = {(r["doc_id"], r["start"]): r for r in repair.encode_documents(docs(EDGE)).collect()}
    assert len(got) == len(EDGE)
    encode, start = Encoder(default_vocabulary()), 0
    for i, text, _ in sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode.library.encode(text or "", add_special_tokens=False).ids + [0]
        row = got[i, start]
        assert (row["n_tokens"], row["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert repair.encode_documents(docs([])).count() == 0


def test_packing_rows(docs):
    rows = packing.pack(docs(EDGE), capacity=100, group_pieces=4).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 5)
    assert [x[0] for x in long] == list(range(len(long))) and all(x[2] == 100 for x in long[1:])
    assert packing.pack(docs([])).count() == 0


def test_pieces_rows(docs):
    rows = {r["doc_id"]: r for r in wfst.encode_documents(docs(EDGE)).collect()}
    assert all(r["restored"] for r in rows.values()) and rows[3]["n_pieces"] == 0
    marked = wfst.encode_documents(docs([(1, "a ▁ b", "s")])).first()
    assert not marked["restored"] and marked["n_pieces"] > 0
    assert wfst.encode_documents(docs([])).count() == 0


def test_near_duplicates(docs):
    base = [f"w{i}" for i in range(200)]
    near = [" ".join(base[:k] + ["other"] + base[k + 1:]) for k in (20, 70, 120)]
    rows = [(10, " ".join(base), "s"), (11, near[0], "s"), (12, near[1], "s"), (13, near[2].upper(), "s"), (9, " ".join(base[100:]), "s"),
            (20, "one two", "s"), (21, "One, two!", "s"), (22, "", "s"), (23, "", "s"), (24, None, "s"), (None, "x", "s"), (10, " ".join(base), "s")]
    table = docs(rows)
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(table).collect()}
    assert {got[i] for i in (10, 11, 12, 13)} == {10} and got[9] == 9 and got[21] == 20
    assert (got[22], got[23], got[24], got[None]) == (22, 23, 24, None)
    kept = probminhash.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 9, 10, 20, 22, 23, 24]
    assert probminhash.near_duplicates(docs([])).count() == 0


def test_pieces_of_a_table_are_those_of_the_library(spark):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=wfst.default_model())
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in wfst.encode_documents(source).collect()}
    assert got == {r["doc_id"]: library.encode(r["text"] or "") for r in source.collect()}


def fetcher(docs_frame):
    return lambda wanted: docs_frame.select(F.col("doc_id").alias("node"), "text").join(wanted.select("node").distinct(), "node")


def test_a_near_copy_of_low_estimate_is_checked(spark, docs):
    # registers of one pair of near copies that agree in 105 of 160 places only, the first band among them
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base), "s"), (2, " ".join([*base[:100], "other", *base[101:]]), "s")]
    n = probminhash.REGISTERS
    a = np.arange(n, dtype=np.uint16)
    b = np.where(np.arange(n) < 105, a, a + 1000).astype(np.uint16)
    nodes = spark.createDataFrame([(1, bytearray(a.tobytes())), (2, bytearray(b.tobytes()))], "node long, registers binary")
    open_rows = probminhash.band_rows(nodes).join(nodes, "node").withColumn("label", F.col("node"))
    least = probminhash.SIMILARITY - probminhash.MARGIN
    found = probminhash.links_across(open_rows, fetcher(docs(rows)), 0.8, least, probminhash.BAND_ROWS).distinct().collect()
    assert [(r["a"], r["b"]) for r in found] == [(1, 2)]
    assert probminhash.near_duplicates(docs(rows)).columns == ["doc_id", "class_id"]


def test_links_across_blocks_join_what_hubs_miss(spark, docs):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:5 * i] + ["o"] + base[5 * i + 1:]), "s") for i in range(12)]
    table = docs(rows)
    nodes = probminhash.sketches(table).select(F.col("doc_id").alias("node"), "registers")
    open_rows = probminhash.band_rows(nodes).join(nodes, "node").withColumn("label", F.col("node"))
    found = probminhash.links_across(open_rows, fetcher(table), 0.8, 0.64, probminhash.BAND_ROWS).collect()
    parent = {i: i for i in range(12)}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for r in found:
        parent[root(r["a"])] = root(r["b"])
    assert len({root(i) for i in range(12)}) == 1 and len(found) < 66


def brute_classes(rows):
    """Least id per class of rows with an id, by all pairs of texts."""
    bags = [(i, probminhash.shingles(probminhash.words_of(t or ""))) for i, t in rows if i is not None]
    parent = list(range(len(bags)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(bags):
        for y, (j, b) in enumerate(bags[:x]):
            if len(a[0]) and len(b[0]) and probminhash.probability_jaccard(a, b) >= 0.8 - 1e-9:
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(bags):
        least[root(x)] = min(i, least.get(root(x), i))
    return {i: min(least[root(x)] for x, (j, _) in enumerate(bags) if j == i) for i, _ in bags}


def test_classes_equal_those_of_all_pairs(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(r["doc_id"], r["text"]) for r in source.collect()]
    rng = np.random.default_rng(6)
    near = []
    for n, (i, text) in enumerate(rows[:60]):  # edits of every weight, so that similarities lie on both sides of the bound
        words = (text or "").split()
        for k in rng.integers(0, max(1, len(words)), 1 + n % 5):
            words[k:k + 1] = ["edited"]
        near.append((10_000 + i, " ".join(words)))
    made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in near], source.schema)
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(source.unionByName(made)).collect()}
    assert got == brute_classes(rows + near)
    kept = {r["doc_id"] for r in probminhash.drop_near_duplicates(source.unionByName(made)).select("doc_id").collect()}
    assert kept == {i for i, c in got.items() if i == c}


def test_different_texts_under_one_id_stay_apart(docs):
    z, b = " ".join(f"z{i}" for i in range(100)), [f"b{i}" for i in range(100)]
    rows = [(1, z, "s"), (1, " ".join(b), "s"), (2, " ".join([*b[:99], "x"]), "s"), (3, "", "s"), (3, "q r", "s"), (3, None, "s"), (3, "q r", "s")]
    got = sorted((r["doc_id"], r["text"] or "") for r in probminhash.drop_near_duplicates(docs(rows)).collect())
    assert got in ([(1, " ".join(b)), (1, z), (3, ""), (3, "q r")], sorted([(1, " ".join(b)), (1, z), (3, ""), (3, "q r")]))
    assert {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(docs(rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_toxicity(spark, docs):
    bad = ["vile", "rotten", "filthy"]
    rows = [(i, f"you are so {bad[i % 3]} and {bad[i % 2]} today {i}" if i % 4 == 0 else f"you are so calm and kind today {i}", "s") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(9999, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    table = docs(rows + [(700, None, "s"), (None, "", "s"), (701, "you are so r0tten and v1le today 5", "s")])
    got = {r["doc_id"]: r[OWN + "score"] for r in toxicity.toxicity(table, labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in held)
    assert got[701] >= 0.7 and 0 <= got[700] < 0.7 and 0 <= got[None] < 0.7
    assert toxicity.drop_toxic(table, labels).columns == table.columns
    assert toxicity.toxicity(docs([]), labels.limit(0)).count() == 0
    assert {r[OWN + "score"] for r in toxicity.toxicity(docs(EDGE), labels.filter("doc_id < 4")).collect()} != set()


def test_toxicity_of_few_and_of_rare_labels(spark, docs):
    bad = ["vile", "rotten", "filthy"]
    toxic = {i for i in range(600) if i % 40 == 0}
    table = docs([(i, f"you are so {' and '.join(bad)} today {i}" if i in toxic else f"you are so calm and kind today {i}", "s") for i in range(600)])
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(600)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled(table, labels, 100).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    n = {r["toxic"]: (r["n"], r["w"]) for r in sample}
    taught = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert n[1] == (len(toxic & set(taught)), len(toxic & set(taught)))
    assert n[0][0] < 130 and n[0][1] == pytest.approx(len(set(taught) - toxic), rel=0.3)
    got = {r["doc_id"]: r[OWN + "score"] for r in toxicity.toxicity(table, labels).collect()}
    assert all((got[i] >= toxicity.REJECT) == (i in toxic) for i in range(600))


def test_quality_rows(docs):
    good = " ".join(f"The word{i} stands here." for i in range(30))
    rows = EDGE + [(100 + i, good + f" Number {i}.", "s") for i in range(40)] + [(200 + i, "Buy! " * 60, "s") for i in range(5)]
    got = {r["doc_id"]: r for r in weak_rules.quality(docs(rows)).collect()}
    assert all(got[100 + i]["kept"] for i in range(40)) and not any(got[200 + i]["kept"] for i in range(5))
    assert got[2]["base_failed"] and got[2]["n_words"] == 0 and got[3]["base_failed"]
    kept = weak_rules.drop_low_quality(docs(rows))
    assert kept.columns == docs([]).columns and kept.filter("doc_id >= 100").count() == 40
    assert weak_rules.quality(docs([])).count() == 0


def test_pages_column(spark):
    table = spark.createDataFrame([(1, None), (2, "<p>x</p>"), (2, "<p>x</p>")], "page_id long, html string")
    assert sorted(r["t"] for r in table.select(html_blocks.main_text().alias("t")).collect()) == ["", "x", "x"]


HOSTILE = ["<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_sep|>", "<\\\\|", "", None, "\\", "a<b|c", "<<||>>"]


def test_chats(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", t) for k, t in enumerate(HOSTILE)] + [
        (2, 0, None, "a"), (2, 0, None, "a"), (2, None, "assistant", "n"), (None, 1, "we\nird\\n", "x"), (3, 5, "assistant", "p"), (3, 6, "assistant", "q")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(table)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        joined = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        loss = "".join(x for *_, r, x in own if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(own), hashlib.sha256(joined.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    merged = chat_format.format_chats(table).filter("conv_id = 3").first()
    assert merged["formatted"] == "<|im_start|>assistant\np<|im_sep|>q<|im_end|>\n" and len(merged["loss_spans"]) == 2
    assert chat_format.digests(chat_format.format_chats(table.limit(0))).count() == 0


def test_turns_of_one_number_are_ordered_as_they_are_in_the_table(spark):
    rows = [(1, 0, "user", "<|a"), (1, 0, "user", "<x"), (1, 0, "user", "<\\|"), (1, None, "user", "z"), (1, 0, "a\nb", "q"), (1, 0, "a\\", "p")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = chat_format.format_chats(table).select(chat_format.read_turns(F.col("formatted")).alias("t")).first()["t"]
    want = sorted(((t is not None, t or 0, r, x) for _, t, r, x in rows))
    assert [(r["role"], r["text"]) for r in row] == [w[2:] for w in want]


def test_a_conversation_of_very_many_turns(spark):
    import time
    n = 32_000
    table = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 5 < 2, "user").otherwise("assistant").alias("role"),
                                  F.concat(F.lit("text <| é🎓 "), F.col("id").cast("string")).alias("text"))
    chat_format.digests(chat_format.format_chats(table.limit(10))).collect()
    start = time.time()
    row = chat_format.digests(chat_format.format_chats(table)).first()
    took = time.time() - start
    texts = [f"text <| é🎓 {i}" for i in range(n)]
    loss = "".join(t for i, t in enumerate(texts) if i % 5 >= 2)
    joined = "".join(f"{'user' if i % 5 < 2 else 'assistant'}\n{t}\n" for i, t in enumerate(texts))
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert row["turns_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and took < 20


def test_site_lines(docs):
    rows = [(i, f"  Menu \nline {i}\n\nMenu\nline {i}", "a") for i in range(6)] + [(10, "Menu\nb", "b"), (11, None, "b"), (12, "Menu", None)]
    got = {r["doc_id"]: r for r in site_lines.cleaned(docs(rows)).collect()}
    assert got[0]["text"] == "line 0\n\nline 0" and got[0][OWN + "dropped"] == 2
    assert got[10]["text"] == "Menu\nb" and got[11]["text"] == "" and got[12]["text"] == "Menu"
    out = site_lines.drop_boilerplate_lines(docs(rows))
    assert out.columns == docs([]).columns and out.filter("doc_id = 0").first()["n_chars"] == 14
    assert site_lines.cleaned(docs([])).count() == 0


def test_site_lines_go_that_stand_on_a_tenth_of_a_large_host(docs):
    rows = [(i, f"text {i}\nAll rights reserved" if i % 10 == 0 else f"text {i}", "large") for i in range(400)]
    rows += [(1000 + i, f"quoted {i // 4}\nown {i}", "prose") for i in range(400)]  # on 1 % of the pages
    rows += [(2000 + i, f"Menu\nown {i}", "small") for i in range(3)]
    got = {r["doc_id"]: r for r in site_lines.cleaned(docs(rows)).collect()}
    assert all(got[i]["text"] == f"text {i}" for i in range(400))
    assert sum(got[i][OWN + "dropped"] for i in range(400)) == 40
    assert all(got[i][OWN + "dropped"] == 0 for i in range(1000, 1400))
    assert all(got[2000 + i]["text"] == f"own {i}" for i in range(3))


def test_copies_of_a_page_are_no_boilerplate(docs):
    copied = "A page of its own\nwith two lines"
    rows = [(i, copied, "host") for i in range(100)] + [(1000 + i, f"text {i}\nMenu" if i % 2 else f"text {i}", "host") for i in range(100)]
    rows += [(2000, copied + " ", "host"), (2001, "with two lines\nMenu\nA page of its own", "host"), (3000, "alone", None)]
    got = {r["doc_id"]: r["text"] for r in site_lines.cleaned(docs(rows)).collect()}
    assert got[0] == copied and got[1001] == "text 1" and got[2001] == "with two lines\nA page of its own" and got[3000] == "alone"


def brute_next(rows):
    order = sorted(rows, key=lambda r: -r[0])
    return {a[0]: b for a, b in zip(order, order[1:] + order[:1])}


def test_order_minhash(docs):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 400, 60)), "s") for i in range(8)] + [(8, "", "s"), (9, "a b", "s"), (10, "r " * 50, "s")]
    got = {r["doc_id"]: r for r in order_minhash.compared(docs(rows)).collect()}
    for i, text, _ in rows:
        n, follower = len(text), brute_next(rows)[i][1]
        edited = text[:n - n // 3] + follower[:n // 3]
        assert got[i]["n_chars"] == n and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1
    assert np.mean([got[i]["near_edited"] for i in range(8)]) > np.mean([got[i]["near_next"] for i in range(8)])
    same = order_minhash.compared(docs([(1, "a b c d", "s"), (2, "a b c d", "s"), (2, "a b c d", "s"), (None, None, "s")])).collect()
    assert len(same) == 4 and len({r["fingerprint"] for r in same if r["doc_id"]}) == 1
    assert order_minhash.compared(docs([])).count() == 0


def test_order_minhash_sees_order_and_repeats(spark):
    a = " ".join(f"x{i}" for i in range(40))
    b = " ".join(f"x{i}" for i in [*range(20, 40), *range(20)])
    table = spark.createDataFrame([(1, a), (2, b), (3, a + " " + a), (4, a + " " + a)], "k long, text string")
    prints = {r["k"]: r["fingerprint"] for r in order_minhash.fingerprints(table, ["k"]).collect()}
    assert prints[1] != prints[2] and prints[3] == prints[4] != prints[1]
    h = spark.createDataFrame([("r r r r r",)], "text string").select(order_minhash.kmers(F.col("text")).alias("k")).first()["k"]
    assert len({x["h"] for x in h}) == 3


def likeness_of(spark, pairs):
    """Likeness of the two texts of every pair, in order."""
    table = spark.createDataFrame([(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)], "k long, text string")
    prints = {r["k"]: r["fingerprint"] for r in order_minhash.fingerprints(table, ["k"]).collect()}
    rows = spark.createDataFrame([(k, prints[2 * k], prints[2 * k + 1]) for k in range(len(pairs))], "k long, a string, b string")
    return [r["n"] for r in rows.select("k", order_minhash.likeness("a", "b").alias("n")).orderBy("k").collect()]


def test_likeness_falls_with_the_edits(spark):
    rng = np.random.default_rng(12)
    edits, per = (0, 1, 4, 16, 64, 200), 24
    pairs = []
    for n in edits:
        for _ in range(per):
            words = [f"w{k}" for k in rng.integers(0, 3000, 300)]
            other = list(words)
            for k in rng.choice(300, n, replace=False):
                other[k] = "edited"
            pairs.append((" ".join(words), " ".join(other)))
    means = np.array(likeness_of(spark, pairs)).reshape(len(edits), per).mean(1)
    assert means[0] == 1 and (np.diff(means) < 0).all() and means[1] > 0.9 and means[-1] < 0.1


def test_likeness_without_spaces_and_of_moved_parts(spark):
    rng = np.random.default_rng(13)
    chinese = ["".join(map(chr, rng.integers(0x4E00, 0x5E00, 280))) for _ in range(12)]
    near = [t[:100] + "的" + t[101:] for t in chinese]
    far = ["".join(map(chr, rng.integers(0x6E00, 0x7E00, 280))) for _ in range(12)]
    moved = [" ".join(f"m{k}" for k in range(200)), " ".join(f"m{k}" for k in [*range(100, 200), *range(100)])]
    got = likeness_of(spark, [*zip(chinese, near), *zip(chinese, far), tuple(moved)])
    assert np.mean(got[:12]) > 0.9 and max(got[12:24]) == 0 and 0 < got[24] < 0.8


def plain_kmers(text):
    units = [u for w in text.strip(" \n\t\r").split() for u in (w if len(w) > order_minhash.LONG_WORD else [w])]
    seen, out = {}, []
    for i in range(len(units) - order_minhash.KMER + 1):
        k = tuple(units[i:i + order_minhash.KMER])
        seen[k] = seen.get(k, -1) + 1
        out.append((k, seen[k]))
    return out


def test_likeness_estimates_a_plain_order_minhash(spark):
    """The chance that two minimal k-mers, one of either half, are the same and in the same order, by plain Python."""
    import random
    rng = random.Random(14)
    a = [f"w{rng.randint(0, 900)}" for _ in range(200)]
    pairs = [(" ".join(a), " ".join(a[:150] + [f"n{i}" for i in range(50)])), (" ".join(a), " ".join(a[100:] + a[:100]))]
    for k, (x, y) in enumerate(pairs):
        sides, hits, n = [plain_kmers(x), plain_kmers(y)], 0, 1500
        for trial in range(n):
            order, half = {}, {}
            for key in sorted({k for s in sides for k in s}):
                order[key], half[key] = rng.random(), rng.random() < 0.5
            marks = []
            for s in sides:
                place = {key: i for i, key in enumerate(s)}
                two = [min((key for key in s if half[key] == h), key=order.get) for h in (True, False)]
                marks.append(tuple(sorted(two, key=place.get)))
            hits += marks[0] == marks[1]
        sketches = 256
        table = spark.createDataFrame([(0, x), (1, y)], "k long, text string")
        prints = {r["k"]: r["fingerprint"] for r in order_minhash.fingerprints(table, ["k"], sketches).collect()}
        equal = sum(prints[0][8 * j:8 * j + 8] == prints[1][8 * j:8 * j + 8] for j in range(sketches)) / sketches
        assert abs(equal - hits / n) < 0.12, k


def test_pipeline_from_the_first_stage_to_the_last(spark):
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{folder}/documents.parquet")
    docs, kept = raw.withColumn("score", F.lit(1)), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == list(corpus_pipeline.DOCUMENT_COLUMNS), name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    before = {r["doc_id"]: r["text"] for r in raw.collect()}
    for held in kept:
        assert held.keys() <= before.keys()
        before = held
    scores = {r["doc_id"]: r[OWN + "score"] for r in toxicity.toxicity(raw.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert kept[0].keys() == {i for i, x in scores.items() if x < toxicity.REJECT}
    assert kept[3].keys() == {i for i, c in brute_classes(list(kept[2].items())).items() if i == c}
    rows = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in rows} == kept[3].keys()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(pieces)] == [0, *ends[:-1]]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, raw.limit(0), folder).count() == 0, name


@pytest.mark.parametrize("n", [0, 1])
def test_successors_of_few(docs, n):
    assert order_minhash.compared(docs([(7, "a b c d", "s")][:n])).count() == n

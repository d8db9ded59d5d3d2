"""Retrieval, sessions and evaluation against brute force and hand-worked rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill.operators import (chat as H, dense as V, details as X, eligibility as E, evaluation as I, fusion as U,
                                 lexical as B, profiles as P, quality as Q, ranking)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(vocab, weights=[30 // (j + 1) + 1 for j in range(30)], k=rng.randint(3, 25)))) for i in range(60)]
    return docs, [(0, "w0 w5 w5 w9"), (1, "w1 missing"), (2, "missing")]


def brute_bm25(docs, query, k):
    tokens = {i: (t or "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / sum(t is not None for _, t in docs)
    df = Counter(w for ws in tokens.values() for w in set(ws))
    idf = {w: math.log(n - c + .5) - math.log(c + .5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (.25 * mean if v < 0 else v) for w, v in idf.items()}
    score = {i: round(sum(idf.get(w, 0) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (.25 + .75 * len(ws) / avg)) for w in query.split()), 12)
             for i, ws in tokens.items()}
    return [(i, pytest.approx(s, abs=1e-6)) for i, s in sorted(score.items(), key=lambda x: (-x[1], x[0])) if s != 0][:k]


def searched(spark, docs, queries, k, path):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    B.stored_index(d, "doc_id", "text", path)
    rows = B.bm25_topk(q, B.read_index(spark, path), k).orderBy("query_id", "rank").collect()
    return {i: [(r.doc_id, r.score) for r in rows if r.query_id == i] for i, _ in queries}


@pytest.mark.parametrize("block, k", [(2, 3), (5, 7), (128, 100)])
def test_bm25_of_blocks_equals_brute_force(spark, corpus, tmp_path, monkeypatch, block, k):
    docs, queries = corpus
    queries = queries + [(3, " ".join(f"w{i}" for i in range(30))), (4, "w29 w28 w0 w1 w2 w29"), (5, "")]
    docs = docs + [(100, None), (101, ""), (102, docs[5][1]), (103, docs[5][1])]
    want = {i: brute_bm25(docs, text, k) for i, text in queries}
    monkeypatch.setattr(B, "BLOCK_POSTINGS", block)
    assert searched(spark, docs, queries, k, str(tmp_path / "a")) == want
    monkeypatch.setattr(ranking, "small_enough", lambda *a, **k: False)
    assert searched(spark, docs, queries, k, str(tmp_path / "b")) == want


def test_bm25_with_a_negative_mean_idf(spark, tmp_path):
    docs = [(1, "a b"), (2, "a b"), (3, "a b c"), (4, "a a b")]
    queries = [(0, "a c"), (1, "a b")]
    assert searched(spark, docs, queries, 2, str(tmp_path / "ix")) == {i: brute_bm25(docs, t, 2) for i, t in queries}


def test_small_scores_are_ranked_in_full(spark, tmp_path):
    docs = [(i, "common " + "x " * (i % 7) + f"own{i}") for i in range(40)]
    want = brute_bm25(docs, "own3 common", 20)
    assert searched(spark, docs, [(0, "own3 common")], 20, str(tmp_path / "ix"))[0] == want


def test_bm25_reads_few_postings_of_frequent_terms(spark, tmp_path, monkeypatch):
    """Every document holds the frequent term; a search for it and rare ones lists and looks up few of its postings."""
    rng = random.Random(1)
    docs = [(i, " ".join(["often"] * rng.randint(1, 9) + [f"r{i % 100}"] * rng.randint(1, 5) + ["z"] * rng.randint(0, 30))) for i in range(4000)]
    docs += [(9000 + i, f"other words stand here {i}") for i in range(4500)]  # so that the frequent term has a positive idf
    seen = []
    real = B.written

    def counted(df, label):
        out = real(df, label)
        seen.append((label, out.count()))
        return out

    monkeypatch.setattr(B, "written", counted)
    assert searched(spark, docs, [(0, "often r7 r8")], 10, str(tmp_path / "ix"))[0] == brute_bm25(docs, "often r7 r8", 10)
    candidates = dict(seen)["candidates"]
    assert candidates <= 80  # the documents with a rare term, not the 4,000 of the frequent one
    blocks = B.read_index(spark, str(tmp_path / "ix")).blocks
    assert blocks.filter("term = 'often'").count() >= 4000 / B.BLOCK_POSTINGS and blocks.selectExpr("max(size(doc_ids)) AS n").first().n <= B.BLOCK_POSTINGS
    tops = [r.top for r in blocks.filter("term = 'often'").orderBy("block").collect()]
    assert tops == sorted(tops, reverse=True)


def test_index_lookups_push_the_terms_down(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    index = B.stored_index(d, "doc_id", "text", str(tmp_path / "ix"))
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,b)]" in index.blocks.filter("term = 'b'")._jdf.queryExecution().toString()
    searching = B.bm25_topk(spark.createDataFrame([(1, "b")], "query_id long, query string"), index, 3)._jdf.queryExecution().toString()
    assert "/docs" not in searching  # no scan of the corpus


@pytest.mark.parametrize("cell_rows, part", [(4096, 4096), (7, 5), (20, 3)])
def test_knn_equals_brute_force(spark, monkeypatch, cell_rows, part):
    rng = np.random.default_rng(1)
    vecs = np.concatenate([rng.normal(size=(40, 6)), rng.normal(size=(60, 6)) * 0.05 + rng.normal(size=(4, 6)).repeat(15, 0)])
    vecs[7] = 0
    vecs[11] = vecs[10] = vecs[60]
    n = len(vecs)
    odd = [(900, None, 0), (901, [float("nan")] * 6, 0), (902, [None] + [1.0] * 5, 0)]
    v = spark.createDataFrame([(i, [float(x) for x in row], i % 4) for i, row in enumerate(vecs)] + odd, "vec_id long, embedding array<float>, label int")
    asked = v.filter("vec_id < 20 OR vec_id >= 900").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")
    wanted = asked.select("query_id", F.explode(F.array("label", F.lit(2))).alias("no"))
    q = asked.join(V.facet_bits(wanted, "query_id", "no"), "query_id")
    vecs = vecs.astype(np.float32).astype(np.float64)
    with np.errstate(invalid="ignore"):
        unit = vecs / np.sqrt((vecs ** 2).sum(axis=1, keepdims=True))
    monkeypatch.setattr(V, "PART_ROWS", part)

    def want(qid, ok):
        s = np.round(unit @ unit[qid], 12)
        return [(i, pytest.approx(s[i], abs=1e-6)) for i in sorted((i for i in range(n) if ok(i) and not np.isnan(s[i])), key=lambda i: (-s[i], i))[:5]]

    def rows(df):
        out = {i: [] for i in range(20)}
        for r in df.orderBy("query_id", "rank").collect():
            out[r.query_id].append((r.vec_id, r.score))
        return out

    plain = rows(V.knn(q, v, 5, cell_rows=cell_rows))
    assert plain == {i: want(i, lambda j: True) for i in range(20)} and plain[7] == []
    faceted = rows(V.knn(q, v, 5, facet="label", query_facets="facets", cell_rows=cell_rows))
    assert faceted == {i: want(i, lambda j, i=i: j % 4 in (i % 4, 2)) for i in range(20)}
    assert V.knn(q, v.limit(0), 5).count() == 0


def test_knn_ranks_differences_far_below_the_printed_digits(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0003]), (2, [1.0, 0.0002]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vec array<double>")
    assert [r.vec_id for r in V.knn(q, v, 3).orderBy("rank").collect()] == [3, 2, 1]
    pairs = v.select(F.lit(0).cast("long").alias("query_id"), "vec_id")
    assert [r.vec_id for r in V.knn_among(pairs, q, v, 3).orderBy("rank").collect()] == [3, 2, 1]


def test_cells_rule_out_what_is_far(spark, monkeypatch):
    """Tight clusters: a query meets its own cell only, so the parts that are read do not grow with the vectors."""
    rng = np.random.default_rng(2)
    middle = np.eye(8)
    rows = [(i, (middle[i % 8] + rng.normal(size=8) * 0.01).tolist()) for i in range(800)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id < 16").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    met = []
    real = V.scored

    def counted(blocks, *args):
        met.append(blocks.select(F.explode("queries")).count())
        return real(blocks, *args)

    monkeypatch.setattr(V, "scored", counted)
    monkeypatch.setattr(V, "PART_ROWS", 10_000)
    out = V.knn(q, v, 5, cell_rows=50)
    assert out.count() == 80 and met[0] == 16
    assert met[1] < 16 * 15 / 2  # of fifteen other cells, those of the same cluster


def test_queries_and_vectors_are_shuffled_a_bounded_number_of_times(spark, monkeypatch):
    """Forty cells in two bundles, many blocks in three groups: a query goes to a bundle once, its filter does not go along."""
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(200, 5))
    v = spark.createDataFrame([(i, row.tolist(), i % 3) for i, row in enumerate(vecs)], "vec_id long, embedding array<double>, label int")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")
    q = asked.join(V.facet_bits(asked.select("query_id", F.col("label").alias("no")), "query_id", "no"), "query_id")
    plans, real = [], V.scored

    def kept(blocks, *args):
        plans.append(blocks._jdf.queryExecution().executedPlan().toString())
        return real(blocks, *args)

    monkeypatch.setattr(V, "scored", kept)
    for name, value in (("BUNDLES", 2), ("GROUPS", 3), ("BLOCK_QUERIES", 7)):
        monkeypatch.setattr(V, name, value)
    got = {}
    for r in V.knn(q, v, 4, facet="label", query_facets="facets", cell_rows=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = unit @ unit.T
    assert got == {i: [j for j in np.argsort(-near[i], kind="stable").tolist() if j % 3 == i % 3][:4] for i in range(200)}
    for plan in plans:
        assert "hashpartitioning(bundle" in plan and "hashpartitioning(cell" not in plan and "facet_bits" not in plan
        assert not [x for x in plan.split("\n") if "bitmap" in x.lower()]  # the bitmaps of the filters are joined to the blocks


def test_a_task_returns_the_best_of_its_bundle_not_of_every_part(spark, monkeypatch):
    """Forty cells in two bundles: at most k rows a query and bundle leave the search, and a query comes to a bundle as one row."""
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(240, 6)).astype(np.float32)
    vecs[100:110] = vecs[7]
    v = spark.createDataFrame([(i, row.tolist(), i % 3) for i, row in enumerate(vecs)], "vec_id long, embedding array<float>, label int")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")
    # most queries share a filter, the others have one each
    wanted = asked.select("query_id", F.explode(F.when(F.col("query_id") < 200, F.array(F.lit(1))).otherwise(F.array("label", F.col("query_id").cast("int")))).alias("no"))
    q = asked.join(V.facet_bits(wanted, "query_id", "no"), "query_id")
    made, real = [], V.scored

    def counted(blocks, *args):
        out = real(blocks, *args)
        made.append((blocks.select(F.explode("queries")).count(), out.count()))
        return out

    monkeypatch.setattr(V, "scored", counted)
    for name, value in (("BUNDLES", 2), ("GROUPS", 3), ("BLOCK_QUERIES", 16), ("TILE_ROWS", 4), ("HELD_HITS", 50), ("EXACT_NUMBERS", 60)):
        monkeypatch.setattr(V, name, value, raising=False)
    unit = vecs.astype(np.float64) / np.linalg.norm(vecs.astype(np.float64), axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 12)

    def found(df):
        got = {}
        for r in df.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        return got

    def want(ok):
        return {i: [j for j in np.argsort(-near[i], kind="stable").tolist() if ok(i, j)][:3] for i in range(240)}

    assert found(V.knn(q, v, 3, cell_rows=6)) == want(lambda i, j: True)
    assert found(V.knn(q, v, 3, facet="label", query_facets="facets", cell_rows=6)) == want(lambda i, j: j % 3 == (1 if i < 200 else i % 3))
    for queries, hits in made:
        assert queries <= 2 * 240 and hits <= 3 * queries


def test_single_precision_bounds_lose_nothing(spark, monkeypatch):
    """Cosines that differ by less than single precision tells, in many tiles; ids that are names."""
    monkeypatch.setattr(V, "TILE_ROWS", 8, raising=False)
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    vecs = base + rng.normal(size=(300, 16)) * 1e-5
    v = spark.createDataFrame([(f"n{i:03d}", row.tolist()) for i, row in enumerate(vecs)], "vec_id string, embedding array<double>")
    q = spark.createDataFrame([("q", base.tolist()), (None, vecs[5].tolist())], "query_id string, query_vec array<double>")
    got = {}
    for r in V.knn(q, v, 7, digits=None).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    sizes = np.sqrt((vecs * vecs).sum(1))
    for name, asked in (("q", base), (None, vecs[5])):
        score = (vecs * asked).sum(1) / (sizes * np.sqrt((asked * asked).sum()))
        order = np.argsort(-score, kind="stable")[:7]
        assert got[name] == [(f"n{i:03d}", score[i]) for i in order]


def test_contained_names(spark):
    rng = random.Random(4)
    places = ["Nigeria, Niger", "International / All", "", None, "Ünited", "NATION_1, NATION_12", "aaa", "x" * 50] + [
        "".join(rng.choices("abn", k=rng.randint(1, 9))) for _ in range(60)]
    names = ["Niger", "nigeria", "", None, "N", "al", "nation_1", "NATION_3", "ünited", "aaaa", "zzz", "%", "_"] + [
        "".join(rng.choices("abN", k=rng.randint(1, 5))) for _ in range(60)]
    got = E.contained_names(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in places], "place string"))
    want = {(x, y) for x in names for y in places if x is not None and y is not None and x.lower() in y.lower()}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int, score double")


def test_rrf_scores_ties_and_input_order(spark):
    dense = hits(spark, [(1, 10, 1, .9), (1, 11, 2, .8), (1, 12, 3, .7)])
    sparse = hits(spark, [(1, 10, 1, 5.), (1, 13, 2, 4.), (1, 14, 3, 3.)])
    rows = U.rrf(dense, sparse).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [10, 11, 13, 12, 14] and rows[0].score == round(2 / 61, 9)
    again = U.rrf(dense.orderBy(F.desc("doc_id")), sparse.orderBy("rank")).orderBy("rank").collect()
    assert again == rows


def test_equal_texts_score_twice(spark):
    texts = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "doc_id long, text string")
    merged = U.merge_equal_texts(hits(spark, [(1, 3, 1, 1.), (1, 2, 2, 1.), (1, 1, 3, 1.)]), texts)
    rows = U.rrf(merged, merged.limit(0)).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == [(1, round(1 / 62 + 1 / 63, 9)), (3, round(1 / 61, 9))]


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(1, 1, .05), (1, 2, .049), (1, 3, .5)], "query_id long, doc_id long, rerank_score double")
    assert [r.doc_id for r in U.threshold_topk(df).orderBy("rank").collect()] == [3, 1]


def test_a_callers_scorer(spark):
    @F.pandas_udf("double")
    def length(text):
        return text.str.len() / 10.0

    df = spark.createDataFrame([(1, 1, "abc")], "query_id long, doc_id long, text string")
    assert U.rerank(df, lambda p: length(p["text"])).collect()[0].rerank_score == .3


ITEMS = [(1, None, "International / All", "Graduates", "Fully Funded"), (2, "Active", "International / All", "Graduates", "Fully Funded"),
         (3, "Active", "Egypt, Syria", "Unspecified", "Fixed Grant"), (4, "Expired", "Egypt", "Graduates", None),
         (5, "Active", "Bangladesh overall", "Graduates", None), (6, "Active", "Jordan", None, "Fully Funded"), (7, "Active", None, "Graduates", None)]


def test_eligibility_quirks(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, scholarship_status string, eligible_nationality string, academic_level string, funding_category string")
    asks = spark.createDataFrame([
        ("a", "Atlantis", "Master", False, None), ("b", "egypt", "PhD", False, None), ("c", "Atlantis", "Other", True, "Fully Funded"),
        ("d", "Eg%t", "Master", None, None)],
        "session_id string, nationality string, academic_level string, bypass_filters boolean, target_funding string")
    got = {}
    for r in E.eligible_pairs(asks, items).collect():
        got.setdefault(r.session_id, set()).add(r.item_id)
    # open markers, substring match of 'all', null status out, a bypass sees a null level, wildcards are literal
    assert got == {"a": {2, 5}, "b": {3}, "c": {2, 6}, "d": {2, 5}}
    counts = {r.session_id: (r.n_eligible, r.first_item) for r in E.eligible_counts(asks, items).collect()}
    assert counts == {k: (len(v), min(v)) for k, v in got.items()}
    sizes = E.leak_counts(asks, items).first()
    assert (sizes.n_pairs, sizes.n_leaks) == (sum(map(len, got.values())), 0)


def test_intents(one):
    assert one(E.target_funding("q"), q="A Fully-Funded or partially funded one") == "Fully Funded"
    assert one(E.target_funding("q"), q="منحة ممولة جزئيا") == "Partially Funded"
    assert one(E.bypass_filters("q"), q="the Fulbright grant") and not one(E.bypass_filters("q"), q="any")


def test_enriched_query(one):
    build = E.enriched_query("q", "m", "i", "s")
    assert one(build, q=" hi ", m="CS", i=None, s=["a", "b"]) == "hi (Academic Focus: CS | Skills: a, b)"
    assert one(build, q="  ", m="CS", i="X", s=[]) == "(Academic Focus: CS | Research: X)"


def test_late_enrichment_takes_the_lowest_id(spark):
    items = spark.createDataFrame([(2, "n", "second"), (1, "n", "first"), (3, "m", None)], "item_id long, name string, application_process string")
    rows = spark.createDataFrame([(1, "n", "t"), (2, "m", "t"), (3, "gone", "t")], "query_id long, name string, text string")
    out = {r.query_id: r.text for r in X.late_enrich(rows, items, key="name").collect()}
    assert out == {1: "t\n\n## Application Process\nfirst", 2: "t\n\n## Application Process\nProcess not specified.",
                   3: "t\n\n## Application Process\nProcess not specified."}


def test_decoded_key(one):
    assert one(X.decoded_key("k"), k="A%20b+c") == "A b+c"
    assert one(X.decoded_key("k"), k="100% free") == "100% free"


def test_history_and_transcript(spark):
    rows = [("s", i, "user", f"m{i}") for i in range(8)] + [("t", 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "session_id string, id long, role string, content string")
    kept = [r.id for r in H.last_n(df, "session_id", ["id"]).filter("session_id = 's'").orderBy("position").collect()]
    assert kept == [2, 3, 4, 5, 6, 7]
    texts = {r.session_id: r.transcript for r in H.transcript(df, order=["id"], n=2).collect()}
    assert texts == {"s": "User: m6\nUser: m7\n", "t": "Assistant: x\n"}


def test_upsert_tells_absent_from_null(spark):
    schema = "session_id string, seq long, nationality string, gpa double, set_fields array<string>"
    changes = spark.createDataFrame([("a", 1, "x", 1.0, ["nationality", "gpa"]), ("a", 2, None, 9.0, ["nationality"]), ("b", 1, None, 2.0, ["gpa"])], schema)
    current = spark.createDataFrame([("b", "old", 0.5), ("c", "keep", 0.1)], "session_id string, nationality string, gpa double")
    got = {r.session_id: (r.nationality, r.gpa) for r in P.upsert_profiles(current, changes, ["nationality", "gpa"]).collect()}
    assert got == {"a": (None, 1.0), "b": ("old", 2.0), "c": ("keep", 0.1)}
    new = {r.session_id: (r.nationality, r.gpa) for r in P.upsert_profiles(None, changes, ["nationality", "gpa"]).collect()}
    assert new == {"a": (None, 1.0), "b": ("Unknown", 2.0)}


def test_stream_log_is_idempotent(spark, tmp_path):
    from fieldmill.streaming import sessions as S
    schema = "session_id string, seq long, nationality string, set_fields array<string>"
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    for seq, value in ((1, "x"), (2, "y")):
        spark.createDataFrame([("a", seq, value, ["nationality"])], schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        S.append_stream(stream, log, str(tmp_path / "ck")).awaitTermination()
    S._write_batch(log, lambda df: df)(spark.createDataFrame([("a", 2, "y", ["nationality"])], schema), 1)  # a replay
    assert S.read_log(spark, log).count() == 2
    assert [(r.session_id, r.nationality) for r in S.current_profiles(spark, log, fields=["nationality"]).collect()] == [("a", "y")]


def test_bands_and_repeats(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 500, "").otherwise("x").alias("a"), F.when(F.col("id") < 501, "N/A").otherwise("x").alias("b"),
                                  F.when(F.col("id") < 201, None).otherwise("x").alias("c"), F.when(F.col("id") < 200, "n/a").otherwise("x").alias("d"))
    bands = {r.column_name: r.band.split()[0] for r in Q.completeness(df).collect()}
    assert bands == {"a": "Warning", "b": "Critical", "c": "Warning", "d": "Healthy"}
    rows = spark.createDataFrame([(i, "five" if i < 5 else "six") for i in range(11)], "id long, text string")
    assert [(r.first_id, r.n, r.excerpt) for r in Q.boilerplate(rows, "text", "id").collect()] == [(5, 6, "six")]


def test_describe_matches_numpy(spark):
    values = [3, 3, 8, 1, 1, 1, 40, 7]
    r = Q.describe_counts(spark.createDataFrame([(v,) for v in values], "v long"), F.col("v")).collect()[0]
    assert (r.n, r.min, r.max) == (8, 1, 40)
    assert r["mean"] == round(np.mean(values), 4) and r["std"] == round(np.std(values, ddof=1), 4)
    assert [r.p25, r.p50, r.p95] == [round(float(np.quantile(values, p)), 4) for p in (.25, .5, .95)]
    assert Q.describe_counts(spark.createDataFrame([], "v long"), F.col("v")).collect()[0].n == 0


def test_recall_and_rank(spark):
    found = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 6)], "query_id long, doc_id long, rank int")
    truth = spark.createDataFrame([(1, 6), (2, 7), (3, 1)], "query_id long, doc_id long")
    got = {r.query_id: (r.recall, r.reciprocal_rank) for r in I.retrieval_scores(found, truth).collect()}
    assert got == {1: (1.0, .5), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_cases(spark):
    rows = [(1, '{"a": 1}', ["c"]), (2, "plain", []), (3, "", None), (4, '{"a": ', ["x", "y"])]
    df = spark.createDataFrame(rows, "id long, student_profile string, contexts array<string>")
    got = {r.id: (r.profile.a if r.profile else None, r.profile_raw, r.context) for r in I.parse_cases(df, "a int").collect()}
    assert got == {1: (1, None, "c"), 2: (None, "plain", ""), 3: (None, "", ""), 4: (None, '{"a": ', "x")}


def test_top_n_prunes_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = ranking.top_n(df, ["g"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Partial") and "WindowGroupLimit" in plan


def test_bm25_plan_of_few_queries_stays_in_the_jvm(spark, corpus, tmp_path):
    docs, queries = corpus
    index = B.stored_index(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", str(tmp_path / "ix"))
    path = str(tmp_path / "q")
    spark.createDataFrame(queries, "query_id long, query string").write.parquet(path)
    plan = B.bm25_topk(spark.read.parquet(path), index, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_a_request_without_profile_searches_with_the_default_one(spark):
    from fieldmill.plans.matching import prepare_requests
    requests = spark.createDataFrame([(1, "a", "grants"), (2, "none", "grants")], "query_id long, session_id string, query string")
    profiles = spark.createDataFrame([("a", "Egypt", "PhD", "Physics", 3.5, "optics", ["lasers"])],
                                     "session_id string, nationality string, academic_level string, academic_major string, gpa double, research_interests string, skills array<string>")
    got = {r["query_id"]: r for r in prepare_requests(requests, profiles).collect()}
    assert got[1]["nationality"] == "Egypt" and got[1]["academic_level"] == "PhD"
    assert got[2]["nationality"] == "Unknown" and got[2]["academic_level"] == "Bachelor" and got[2]["gpa"] == 0.0


def test_containment_of_passages_of_any_length(spark):
    rng = random.Random(11)
    vocab = ["a", "ab", "of", "the", "stone", "bridge", "river", "é🎓", "x", "longer-word", "b"]
    docs = [(i, "".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(0, 80)))) for i in range(80)] + [(900, None), (901, "")]
    passages = []
    for n in range(150):
        text = rng.choice(docs[:80])[1]
        at = rng.randint(0, max(0, len(text) - 1))
        passages.append((n, text[at:at + rng.choice([0, 1, 2, 3, 5, 9, 20, 60, 150, 400])]))
    passages += [(500, None), (501, "zzz"), (502, "the  stone of nothing here at all that could be anywhere in these few short texts"), (503, "  ")]
    got = I.containment_truth(spark.createDataFrame(passages, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, text string"))
    rows = [tuple(r) for r in got.collect()]
    want = {(q, d) for q, p in passages for d, t in docs if p is not None and t is not None and p in t}
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    empty = spark.createDataFrame([], "query_id long, query string")
    assert I.containment_truth(empty, spark.createDataFrame(docs, "doc_id long, text string")).count() == 0

def test_a_search_deals_every_posting_out_once(spark, tmp_path, monkeypatch):
    """Many queries that ask for the same frequent terms: only the postings are shuffled, not a row per query and posting."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices(["a", "b", "c", "d"], k=6) + [f"r{i}"])) for i in range(400)]
    docs += [(900 + i, f"x{i}") for i in range(500)]  # so that the frequent terms have a positive idf
    queries = [(i, f"a b c d r{i}") for i in range(40)]
    asked = []
    real = B.met_postings

    def met(weighted, index, pairs):
        out = real(weighted, index, pairs)
        asked.append((pairs, out.count(), out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(doc_id")))
        return out

    monkeypatch.setattr(B, "met_postings", met)
    monkeypatch.setattr(B, "TASK_ROWS", 500)
    got = searched(spark, docs, queries, 4, str(tmp_path / "ix"))
    assert got == {i: brute_bm25(docs, t, 4) for i, t in queries}
    (pairs, rows, exchanges), = asked
    assert pairs == rows > 40 * 400 and exchanges == 1
    assert B.tasks(pairs) > 30 and B.tasks(0) == B.tasks(None) == 1  # more tasks for more postings


def test_bm25_index_is_built_without_a_shuffle_of_postings(spark, tmp_path, monkeypatch):
    """Segments of a few texts, blocks of two postings, odd white space, ids that are strings or null or come twice."""
    rng = random.Random(5)
    docs = [(f"d{i:02}", "".join(w + rng.choice([" ", "\t\x0b", "\r\n", "\f ", " \x1f\u00a0"]) for w in rng.choices([f"w{j}" for j in range(9)], k=rng.randint(0, 14))))
            for i in range(40)]
    docs += [("e0", " \n "), ("e1", ""), ("e2", None), ("e3", " w0 \u2003w1"), ("r0", "rare"), ("r1", "rare")] + [(f"x{i}", f"own{i}") for i in range(50)]
    monkeypatch.setattr(B, "BLOCK_POSTINGS", 2)
    monkeypatch.setattr(B, "SEGMENT_BYTES", 200, raising=False)
    for name in ("repartition", "repartitionByRange"):
        monkeypatch.setattr(type(spark.range(0)), name, lambda *a: pytest.fail("postings are shuffled"))
    d = spark.createDataFrame(docs, "doc_id string, text string").union(spark.createDataFrame([(None, "rare w0"), ("d01", docs[1][1])], "doc_id string, text string"))
    index = B.stored_index(d, "doc_id", "text", str(tmp_path / "ix"))
    kept = Counter((r.term, r.doc_id) for r in index.blocks.selectExpr("term", "explode(doc_ids) AS doc_id").collect())
    rows = [*docs, (None, "rare w0"), docs[1]]
    split = re.compile("[ \t\n\x0b\f\r]+")
    want = Counter((w, i) for i, t in rows for w in {*split.split(t or "")} - {""})
    assert kept == want
    assert {r.term: r.df for r in index.terms.collect()} == Counter(w for w, _ in want.elements())
    sizes = [len({*split.split(t)} - {""}) and len([w for w in split.split(t) if w]) for _, t in rows if t is not None]
    stats = index.stats.first()
    assert (stats.n_docs, stats.avgdl) == (len(rows), pytest.approx(sum(sizes) / len(sizes)))
    for r in index.terms.filter("df > 2").collect():  # blocks are numbered from the largest weight down
        own = index.blocks.filter(F.col("term") == r.term).orderBy("block").collect()
        assert [b.top for b in own] == sorted((b.top for b in own), reverse=True) and own[0].block == r.head
        assert all(b.top == max(b.weights) and len(b.doc_ids) <= 2 for b in own)


@pytest.mark.parametrize("long_terms", [0, 9_000])
def test_bm25_sums_of_many_terms_tie(spark, tmp_path, monkeypatch, long_terms):
    """Documents with equal shares of different terms tie, whatever the order of their sums."""
    monkeypatch.setattr(B, "LONG_TERMS", long_terms)
    docs = [(10 - i, " ".join(f"{c}{i}" for c in "pqrstuv")) for i in range(6)] + [(50 + i, "other") for i in range(9)]
    query = " ".join(f"{c}{i}" for i in range(6) for c in "pqrstuv")
    got = searched(spark, docs, [(0, query)], 4, str(tmp_path / "ix"))[0]
    assert [d for d, _ in got] == [5, 6, 7, 8] and len({s for _, s in got}) == 1 and got == brute_bm25(docs, query, 4)


def test_fewer_hits_are_the_first_of_more_where_ids_repeat(spark, tmp_path):
    """A document that comes twice scores twice, more than any one posting of its terms lets expect."""
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choices([f"w{j}" for j in range(12)], weights=[12 - j for j in range(12)], k=rng.randint(2, 9)))) for i in range(80)]
    docs = docs + docs[::3] + [(500 + i, f"x{i}") for i in range(120)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choices([f"w{j}" for j in range(12)], k=7))) for i in range(6)], "query_id long, query string")
    index = B.stored_index(d, "doc_id", "text", str(tmp_path / "ix"))
    few, many = ({(r.query_id, r.rank): (r.doc_id, r.score) for r in B.bm25_topk(q, index, k).collect()} for k in (3, 1000))
    assert len(few) == 18 and few == {key: many[key] for key in few}


def test_texts_are_not_winnowed_where_passages_are_broadcast(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(40))), (2, "w3 w4"), (3, None)], "doc_id long, text string")
    path, calls, real = str(tmp_path / "p"), [], I.winnowed
    spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(3, 30)))], "query_id long, query string").write.parquet(path)
    monkeypatch.setattr(I, "winnowed", lambda w: calls.append(w) or real(w))
    assert [tuple(r) for r in I.containment_truth(spark.read.parquet(path), docs).collect()] == [(7, 1)] and len(calls) == 1  # the passages
    monkeypatch.setattr(I, "small_enough", lambda *a: False)
    assert [tuple(r) for r in I.containment_truth(spark.read.parquet(path), docs).collect()] == [(7, 1)] and len(calls) == 3

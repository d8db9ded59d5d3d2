"""Nearest neighbours, whitening and alignment against brute force, and their odd rows."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill.llm import alignment, bit_codes, queries, whitening
from fieldmill.llm.common import table

FOLDER = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
# null, empty, short, zero, null entry, not finite
ODD = [(901, None), (902, []), (903, [1.0]), (904, [0.0] * 6), (905, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (906, [NAN] + [1.0] * 5), (907, [INF] + [1.0] * 5)]


def vectors(spark, rows):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, code string, block int")
    return frame.withColumn("vector", F.lit("clash"))


# nearest neighbours

def brute_nearest(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q in {i for i, _ in good if i % 100 == 0}:
        own = np.array(min(v.tolist() for i, v in good if i == q))
        near = {}
        for i, v in good:
            if i != q:
                near[i] = min(near.get(i, INF), math.sqrt(((v - own) ** 2).sum()))
        out[q] = sorted((s, i) for i, s in near.items())[:k]
    return out


def test_nearest_with_ties_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.standard_normal(6).tolist()) for i in range(380)]
    rows += [(400 + i, rows[100][1]) for i in range(30)] + [(7, rng.standard_normal(6).tolist()), (200, rows[3][1]), (None, rows[0][1])] + ODD
    rows += [(1000, [3e38] * 6), (1100, [1e-38] * 6)]
    want = brute_nearest(rows, 10)
    got = bit_codes.search(vectors(spark, rows), F.col("vec_id") % 100 == 0, bound=6.0, block=3).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert found.keys() == want.keys() and len(got) == 10 * len(want)
    for q, near in want.items():
        assert [i for _, i in found[q]] == [i for _, i in near], q
        assert [s for s, _ in found[q]] == pytest.approx([s for s, _ in near])


def test_nearest_of_few_and_of_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 2.0])]
    got = bit_codes.search(vectors(spark, rows), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 0.0), (2, 2, 1.0)]
    for few in ([], ODD[:2], [(0, [1.0])]):
        assert bit_codes.search(vectors(spark, few), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_with_the_usual_bound(spark):
    source = table(spark, FOLDER, "embeddings")
    rows = source.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in bit_codes.search(source, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, found in got.items():
        gap = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        gap[ids == q] = np.inf
        hits += len(found & set(ids[np.lexsort((ids, gap))[:10]].tolist()))
    assert len(got) == (ids % 10 == 0).sum() and hits >= 0.99 * 10 * len(got)


def test_lower_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((4000, 48)), rng.standard_normal((20, 48))
    centre, turn = x.mean(0), bit_codes.rotation(48)
    code, distance, correction = bit_codes.encode(x, centre, turn)
    off = q - centre
    size = np.sqrt((off ** 2).sum(1))
    tile = {"unit": off / size[:, None] @ turn, "distance": size}
    guess, least = bit_codes.lower_bounds(tile, np.unpackbits(code, axis=1, count=48).astype(float), distance, correction, bit_codes.ERROR_BOUND)
    true = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    assert (least > true).mean() < 0.005 and abs((guess - true).mean()) < 0.05
    assert turn @ turn.T == pytest.approx(np.eye(48), abs=1e-9)


# whitening

def brute_whitening(rows, weights="one"):
    x = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows]
    counts = Counter(v for _, v in x)
    fit = np.array([v for v, n in counts.items() for _ in range(n if weights == "count" else 1)], float)
    n, total = len(fit), fit.sum(0)
    spread = np.cov(fit.T, bias=True)
    e, axes = np.linalg.eigh(spread)
    e, axes = e[::-1][:4], axes[:, ::-1][:, :4]
    z = (np.array([v for _, v in x], float) - total / n) @ axes / np.sqrt(e)
    deviation = [sum((n * c - int(t)) ** 2 for c, t in zip(v, total)) for _, v in x]
    return n, z, deviation, e / np.trace(spread)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * [3, 2, 1, 0.8, 0.5, 0.1]).tolist()) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(70)] + [(5, rows[5][1]), (300, [-0.0] * 6)]
    taken = rows + [(904, [0.0] * 6)]
    n, z, deviation, share = brute_whitening(taken, weights)
    got = whitening.whiten(vectors(spark, rows + ODD + [(None, None), (908, [1e30] * 6)]), weights=weights).collect()
    assert len(got) == 4 * len(taken) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    for k in range(4):
        own = sorted((r["vec_id"], r["whitened"], int(r["deviation"]), r["explained"]) for r in got if r["component"] == k + 1)
        order = sorted(range(len(taken)), key=lambda i: taken[i][0])
        mine = np.array([r[1] for r in own])
        ids = [r[0] for r in own]
        assert ids == [taken[i][0] for i in order]
        assert [r[2] for r in own] == [deviation[i] for i in order]
        sign = np.sign((mine * z[order, k]).sum())
        assert sorted(mine * sign) == pytest.approx(sorted(z[order, k]), abs=1e-8)
        assert own[0][3] == pytest.approx(share[k], rel=1e-9)


def test_whitening_without_variance(spark):
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(one) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["n"] == 1 and r["deviation"] == 0 for r in one)
    line = whitening.whiten(vectors(spark, [(k, [float(k), float(k), 7.0]) for k in range(4)])).collect()
    assert {r["component"] for r in line} == {1, 2, 3}
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line)
    assert {round(r["explained"], 9) for r in line} == {1.0, 0.0} and max(r["identity_error"] for r in line) < 1e-9
    assert whitening.whiten(vectors(spark, [])).count() == 0 == whitening.whiten(vectors(spark, ODD[:2])).count()


def test_exact_deviations_beyond_a_long(spark):
    rows = [(k, [float(2 ** 29 + 64 * k), 0.0]) for k in range(50)]
    x = [256 * (2 ** 29 + 64 * k) for k in range(50)]
    want = {k: (50 * x[k] - sum(x)) ** 2 for k in range(50)}
    got = whitening.whiten(vectors(spark, rows), components=1).collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == want
    frame = whitening.whiten(vectors(spark, [(0, [1e9, 0.0]), (1, [-1e9, 0.0])]), components=1)
    assert frame.first()["deviation"] == (2 * 256 * 10 ** 9) ** 2


# alignment

def test_diagonals_and_pieces_give_the_whole_merge():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a = np.unique(rng.integers(1, 60, rng.integers(1, 40)))
        b = np.unique(rng.integers(1, 60, rng.integers(1, 40)))
        piece = int(rng.integers(1, 12))
        i, j = alignment.diagonals(a, b, piece)
        merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        for x, y in zip(i.tolist(), j.tolist()):
            assert x == sum(side == 0 for _, side in merged[:x + y])
        assert (np.diff(i + j)[:-1] == piece).all() and (i[-1], j[-1]) == (len(a), len(b))
        x, y = alignment.cuts(a, b, piece)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert x.tolist() == [int((a <= c).sum()) for c in both] and y.tolist() == [int((b <= c).sum()) for c in both]


def brute_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    name = {i: t for t, i in first.get_vocab().items()}
    held, counts = [], Counter()
    for i, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        a_bytes = [alignment.byte_table(name[x]) for x in a]
        b_bytes = [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            held.append((i, None))
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (a_bytes, b_bytes)]
        groups, x, y = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[x:p], b[y:q]))
            x, y = p, q
        links = Counter((s, t) for u, v in groups for s in u for t in v)
        counts.update(links.keys())
        held.append((i, (len(a), len(b), groups, links)))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for i, f in held:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in f[2])
        out.append((i, f[0], f[1], len(f[2]), sum(f[3].values()), sum(m for k, m in f[3].items() if counts[k] == best[k[0]]),
                    sum(m * counts[k] for k, m in f[3].items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


HARD = ["a <|endoftext|> b", "<s> x </s><0x41>", "  two  spaces\n\nline ", " lead", "tab\there   nbsp", "日本語のテキストです。", "🙂🙂 é́ ﬁ", "\n", " ",
        "▁ literal ▁x", "x▁y", "​﻿z", "1234567890" * 30, "z" * 3000, "don't we'll I'M", "a\nb\nc d", None, "", "a b", "a b", "\x00\x01"]


def test_alignment_rows(spark, docs):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(3, "again a b"), (None, "a b c"), (50, " ".join(f"word{i} näh" for i in range(4000)))]
    frame = docs([(i, t, "s") for i, t in rows], "pairs string, times long, row long, part int")
    want = brute_alignment(rows)
    for options in ({}, {"piece": 7, "head_pairs": 5}):
        got = alignment.cross_align(frame, **options).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert alignment.cross_align(docs([])).count() == 0


def test_alignment_of_a_table(spark):
    source = table(spark, FOLDER, "documents")
    want = brute_alignment([(r["doc_id"], r["text"]) for r in source.collect()])
    assert sorted(map(tuple, queries.op12_merge_path(spark, FOLDER).collect()), key=repr) == want


def test_pairs_of_large_groups_are_listed_in_bounded_runs(monkeypatch):
    rng = np.random.default_rng(4)
    n_a, n_b = np.array([300, 2, 1, 50]), np.array([200, 1, 3, 40])
    a, b = rng.integers(0, 9, n_a.sum()), rng.integers(0, 9, n_b.sum())
    doc = np.array([0, 0, 1, 1])
    whole = alignment.linked(a, b, n_a, n_b, doc)
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 100)
    parts = alignment.linked(a, b, n_a, n_b, doc)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and whole[1].sum() == (n_a * n_b).sum()


def test_documents_of_many_pairs_take_several_rows(monkeypatch, docs):
    monkeypatch.setattr(alignment, "ROW_PAIRS", 3)
    found = [(4, 4, 2, 8, "x", np.arange(8), np.ones(8, np.int64)), None]
    import pyarrow as pa
    out = alignment.batch(5, pa.array([1, None], pa.int64()), found).to_pydict()
    assert out["row"] == [5, 5, 5, 6] and out["part"] == [0, 1, 2, 0] and out["pairs"] == [[0, 1, 2], [3, 4, 5], [6, 7], []]

"""Near-duplicates of whole texts by ProbMinHash, banding and an exact check of the probability Jaccard similarity.

A document is the weighted set of its word five-shingles (weight: how often it occurs; a text of fewer words is one
shingle of all of them). Every shingle sends a Poisson process of arrivals at the rate of its weight; each arrival
falls into one of the signature's registers, and a register keeps the shingle that came first. Arrivals later than
the latest register can't matter, so a process ends there: a text of n shingles needs little more than n arrivals.
Two registers agree with the probability Jaccard similarity of the two weighted sets.

A text counts by its words: a node is a distinct word sequence, named by a digest, whichever rows hold it. Candidates
share a band of registers. In each band the members of a bucket are compared with one of them, the first in
one random order of all documents, which links large groups through few hubs and without listing their pairs. Where members of a bucket still lie in
different components, all their pairs across components are estimated in blocks of a bounded size, and the likely ones
are checked there until the components are joined, so no link that would join two components goes unseen. No list of
pairs leaves a task. Links are checked exactly on the texts.

Cases: null and empty texts (no word) are alone in their class. Equal word sequences are one class without a check.
Repeated rows of one id count once; different texts under one id are nodes of their own, and the id gets the least of
their classes. A null id never leaves its row: its class is null. Empty table: no rows. Other columns are ignored. A
class is named by the least id in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import OWN, discard, releasing, stored, texts, whole
from .components import components
from .tokens import gather, runs

SHINGLE_WORDS = 5
SIMILARITY = 0.8
REGISTERS = 160
BAND_ROWS = 5
#: Estimates this far below the threshold are not checked: of 160 registers fewer than 103 agree. For a pair of exactly
#: the threshold that has a chance of 1.4 in a million (binomial), less than sharing none of the 32 bands (3.0).
MARGIN = 0.16
BLOCK = 512
#: Pairs whose registers are compared at once, and distinct shingles of texts that a task keeps while it checks pairs.
PAIRS_AT_ONCE = 32_768
HELD_SHINGLES = 1_000_000
#: Up to so many ids of wanted texts are broadcast; more meet the texts by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words whose numbers a Python worker keeps.
MEMO_WORDS = 100_000

WORD = re.compile(r"\w+")
SKETCH_SCHEMA = "doc_id long, digest binary, registers binary"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


_ODD_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                             0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordNumbers(dict):
    """A stable 64-bit number per word; emptied when large, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = number = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return number


_NUMBERS = WordNumbers()


def digest_of(words: list[str]) -> bytes:
    return hashlib.blake2b("\n".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def shingles(words: list[str], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (ascending) and how often each occurs."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    numbers = np.fromiter(map(_NUMBERS.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    rolled = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        rolled = mix(rolled * _ODD_MULTIPLIERS[k] + numbers[k:len(numbers) - width + 1 + k])
    return np.unique(rolled, return_counts=True)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact: the sum over shared d of 1 / sum over e of max(a_e / a_d, b_e / b_d), in n log n by sorted ratios."""
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])], y[np.searchsorted(keys, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    both = (x > 0) & (y > 0)
    # max(x_e / x_d, y_e / y_d) is the first term exactly where the ratio of e is at least that of d
    above = np.cumsum(x[::-1])[::-1]
    below = np.concatenate([[0.0], np.cumsum(y)[:-1]])
    return float((1.0 / (above[both] / x[both] + below[both] / y[both])).sum())


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row of ``registers`` shingle marks (16 bits each) per bag; every bag has a shingle at least."""
    marks = np.zeros(len(bags) * registers, np.uint64)
    if not bags:
        return marks.reshape(0, registers)
    keys = np.concatenate([k for k, _ in bags])
    rates = np.concatenate([w for _, w in bags]).astype(np.float64)
    owner = np.repeat(np.arange(len(bags)), [len(k) for k, _ in bags])
    first = np.full(len(bags) * registers, np.inf)
    when, step = np.zeros(len(keys)), 0
    while len(keys):
        step += 1
        draw = mix(keys + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
        when = when + gap / rates
        place = owner * registers + ((mix(draw) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        better = np.flatnonzero(when < first[place])
        order = better[np.argsort(-when[better], kind="stable")]  # of equal places the earliest is written last
        first[place[order]] = when[order]
        marks[place[order]] = keys[order]
        limit = first.reshape(-1, registers).max(1)
        alive = when < limit[owner]
        keys, rates, owner, when = keys[alive], rates[alive], owner[alive], when[alive]
    return (mix(marks) >> np.uint64(48)).astype(np.uint16).reshape(-1, registers)


def sketches(docs: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """Per row the digest of its word sequence and its registers (null without a word). No shuffle, whole texts."""
    @releasing
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, whole = frame["doc_id"].tolist(), frame["text"].tolist()
            at = 0
            while at < len(names):  # about a million characters at a time
                ids, digests, bags, size = [], [], [], 0
                while at < len(names) and size < 1_000_000:
                    words = words_of(whole[at])
                    size += len(whole[at])
                    ids.append(names[at])
                    digests.append(digest_of(words))
                    bags.append(shingles(words) if words else None)
                    at += 1
                marks = iter(signatures([b for b in bags if b is not None], registers))
                yield pd.DataFrame({"doc_id": ids, "digest": digests, "registers": [b if b is None else next(marks).tobytes() for b in bags]})

    return texts(docs.filter(F.col("doc_id").isNotNull()), "doc_id").mapInPandas(run, SKETCH_SCHEMA)


def estimate(a: str, b: str, registers: int = REGISTERS):
    """Share of equal registers of two binary columns, on whole arrays."""
    def equal(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, registers) for s in (x, y))
        return pd.Series((left == right).mean(1))

    return F.pandas_udf(equal, "double")(a, b)


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, text)`` of the wanted nodes, stored: each text is fetched once.

    Texts are not shuffled as long as the wanted ids fit a broadcast of ``BROADCAST_IDS``.
    """
    named = stored(wanted.select("node").distinct().join(nodes.select("node", "doc_id", "digest"), "node"), "wanted")
    if named.count() <= BROADCAST_IDS:
        named = F.broadcast(named)

    @releasing
    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:  # of several texts under one id the one that is meant
            fits = [digest_of(words_of(t)) == d for t, d in zip(frame["text"], frame["digest"])]
            yield frame.loc[fits, ["node", "text"]]

    found = texts(docs, "doc_id").join(named, "doc_id").select("node", "text", "digest").mapInPandas(own, "node long, text string")
    return stored(found.groupBy("node").agg(F.min("text").alias("text")), "wanted-texts")


def check_pairs(pairs: DataFrame, held: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Pairs ``(a, b)`` of nodes whose texts (``held``: node, text) reach the threshold exactly."""
    sides = (pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
             .join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))

    @releasing
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known: dict[str, tuple] = {}  # within a batch; many pairs share a text

            def bag(text: str):
                if text not in known:
                    known[text] = shingles(words_of(text))
                return known[text]

            score = [probability_jaccard(bag(x), bag(y)) for x, y in zip(frame["text_a"], frame["text_b"])]
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "similarity": score})

    checked = sides.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, similarity double")
    # the check allows for rounding of equal fractions
    return checked.filter(F.col("similarity") >= threshold - 1e-9)


def band_rows(sketch: DataFrame, registers: int = REGISTERS, rows: int = BAND_ROWS) -> DataFrame:
    """``(node, band, bucket)``: one row per band; the bucket is a hash of the band's number and registers."""
    width = 2 * rows
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("registers", k * width + 1, width)) for k in range(registers // rows)])
    return sketch.select("node", F.posexplode(bands).alias("band", "bucket"))


def in_blocks(buckets: DataFrame) -> DataFrame:
    """Deals the members of each bucket into blocks of a bounded size and every two blocks into a task of their own.

    A bucket of m members makes m / BLOCK blocks, so a row is copied once per block of its bucket.
    """
    key = OWN + "block"
    sized = buckets.join(buckets.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "bucket")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = sized.withColumn("own", own).withColumn(key, F.explode(met))
    dealt = dealt.select(*buckets.columns, "own", f"{key}.i", f"{key}.j").repartition("bucket", "i", "j")
    return dealt.sortWithinPartitions("bucket", "i", "j", "own")


def whole_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task, in frames that hold whole pairs of blocks; one pair of blocks is kept back at most."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if len(frame):
            begin = int(block_starts(frame)[-1])
            if begin:
                yield frame.iloc[:begin]
            rest = frame.iloc[begin:].reset_index(drop=True)
    if rest is not None:
        yield rest


def block_starts(frame: pd.DataFrame) -> np.ndarray:
    """Where each pair of blocks begins."""
    keys = frame[["bucket", "i", "j"]].to_numpy(np.int64)
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))


def likely_pairs(frame: pd.DataFrame, least: float, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of left blocks, rows of right blocks, estimates) of the pairs in different components whose estimate reaches
    ``least``, of a bounded number of pairs at a time.

    A pair that shares several bands is looked at in the first of them only.
    """
    marks = np.frombuffer(b"".join(frame["registers"]), np.uint16).reshape(len(frame), -1)
    label, own, band, i, j = (frame[c].to_numpy() for c in ("label", "own", "band", "i", "j"))
    starts = block_starts(frame)
    sizes = np.diff(starts, append=len(frame))
    # the rows of the left block come first, so a row's partners are those behind it that are of the right block
    rights = np.repeat(starts + np.add.reduceat((own != j).astype(np.int64), starts), sizes)
    left = np.flatnonzero(own == i)
    begin, end = np.maximum(left + 1, rights[left]), np.repeat(starts + sizes, sizes)[left]
    for a, b in runs(end - begin, PAIRS_AT_ONCE):
        n = (end - begin)[a:b]
        x, y = np.repeat(left[a:b], n), gather(np.arange(len(frame)), begin[a:b], n)
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        same = marks[x] == marks[y]
        share = np.count_nonzero(same, axis=1) / marks.shape[1]
        good = np.flatnonzero(share >= least)
        equal = same[good].reshape(len(good), marks.shape[1] // rows, rows).all(2)
        first = np.where(equal.any(1), equal.argmax(1), equal.shape[1])
        good = good[first >= band[x[good]]]
        yield x[good], y[good], share[good]


def links_across(buckets: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: float, least: float, rows: int) -> DataFrame:
    """Links between components within buckets that hold several: (bucket, band, node, label, registers) in.

    First the members with a likely partner in another component are found, then these meet again with their texts
    (``fetch`` gives them by node) and the likely pairs are checked, best estimate first. Pairs that are connected already are passed over, so a
    task returns a forest at most, whatever the number of its pairs. Small buckets are compared many at a time.
    """
    @releasing
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_blocks(frames):
            hit = np.zeros(len(frame), bool)
            for k, others, _ in likely_pairs(frame, least, rows):
                hit[k] = hit[others] = True
            yield frame.loc[hit, ["bucket", "node"]].drop_duplicates()

    @releasing
    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[int, int] = {}  # of joined labels only
        bags: dict[int, tuple] = {}
        held = 0

        def root(x):
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        def bag(k):
            nonlocal held
            if (name := int(node[k])) not in bags:
                if held > HELD_SHINGLES:
                    bags.clear()
                    held = 0
                bags[name] = shingles(words_of(text[k]))
                held += len(bags[name][0])
            return bags[name]

        for frame in whole_blocks(frames):
            node, label, text = frame["node"].to_numpy(), frame["label"].tolist(), frame["text"].tolist()
            out = []
            for left, right, share in likely_pairs(frame, least, rows):
                order = np.argsort(-share, kind="stable")
                for k, o in zip(left[order].tolist(), right[order].tolist()):
                    a, b = root(label[k]), root(label[o])
                    if a != b and probability_jaccard(bag(k), bag(o)) >= threshold - 1e-9:
                        above[a] = b
                        out.append((min(node[k], node[o]), max(node[k], node[o])))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    met = in_blocks(buckets).mapInPandas(find, "bucket long, node long").distinct()
    flagged = stored(buckets.join(met, ["bucket", "node"]), "open-buckets")
    return in_blocks(flagged.join(fetch(flagged), "node")).mapInPandas(check, "a long, b long")


@dataclass
class Classes:
    """``sketch(doc_id, digest, registers)`` of every row with an id, and ``of(digest, doc_id, label)``: a row per distinct
    word sequence with its least id and the label of its class."""
    sketch: DataFrame
    of: DataFrame


def classes(docs: DataFrame, threshold: float = SIMILARITY, registers: int = REGISTERS, rows: int = BAND_ROWS) -> Classes:
    least = threshold - MARGIN
    sketch = stored(sketches(docs, registers), "sketches")
    # exact copies of the word sequence: one node
    first = sketch.filter("registers IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "registers")).alias("r"))
    nodes = stored(first.select(F.monotonically_increasing_id().alias("node"), "digest", "r.doc_id", "r.registers"), "nodes")
    marks = nodes.select("node", "registers")

    def fetch(wanted: DataFrame) -> DataFrame:
        return texts_of(wanted, nodes, docs)

    buckets = band_rows(marks, registers, rows)
    hubs = (buckets.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("hub"), F.count("*").alias("n"))
            .filter("n > 1").select("bucket", F.col("hub.node").alias("hub")))
    shared = stored(buckets.join(hubs, "bucket"), "buckets")
    pairs = (shared.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    marked = (pairs.join(marks.select(F.col("node").alias("a"), F.col("registers").alias("ra")), "a")
              .join(marks.select(F.col("node").alias("b"), F.col("registers").alias("rb")), "b"))
    likely = stored(marked.select("a", "b", estimate("ra", "rb", registers).alias("e")).filter(F.col("e") >= least).select("a", "b"), "likely")
    held = fetch(likely.select(F.explode(F.array("a", "b")).alias("node")))
    links = stored(check_pairs(likely, held, threshold), "links").select("a", "b")
    discard(held, likely)
    labels = components(links)

    # buckets whose members still lie in several components
    placed = shared.select("bucket", "band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    open_rows = stored(placed.join(mixed, "bucket").join(marks, "node"), "mixed-buckets")
    found = stored(links_across(open_rows, fetch, threshold, least, rows).distinct(), "links")
    discard(open_rows, shared)
    if not found.isEmpty():
        discard(labels)
        labels = components(links.unionByName(found).distinct())
    of = nodes.select("node", "digest", "doc_id").join(labels, "node", "left").select("digest", "doc_id", F.coalesce("label", "node").alias("label"))
    return Classes(sketch, of)


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, registers: int = REGISTERS,
                    rows: int = BAND_ROWS) -> DataFrame:
    """``(doc_id, class_id)`` for every distinct id (and a null row where ids are null)."""
    found = classes(docs, threshold, registers, rows)
    named = found.of.join(found.of.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("digest", "class_id")
    grouped = found.sketch.select("doc_id", "digest").distinct().join(named, "digest").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = docs.select("doc_id").distinct().join(grouped, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Keeps one row of every class, that of its least id, and of each id without a word. Rows without an id stay.

    Which of several texts under one id is meant is told by the digest of their words; it is worked out for such ids
    only.
    """
    found = classes(docs, threshold)
    chosen = found.of.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("c")).select("c.doc_id", "c.digest")
    wordless = found.sketch.filter("registers IS NULL").select("doc_id", "digest").distinct()
    kept = chosen.unionByName(wordless).groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))
    several = found.sketch.groupBy("doc_id").agg((F.countDistinct("digest") > 1).alias("several"))
    id_c, several_c, digests_c, digest_c = (OWN + c for c in ("doc_id", "several", "digests", "digest"))
    kept = kept.join(several, "doc_id").select(F.col("doc_id").alias(id_c), F.col("several").alias(several_c),
                                               F.when(F.col("several"), F.col("digests")).alias(digests_c))
    met = docs.join(kept, F.col("doc_id") == F.col(id_c)).withColumn(digest_c, digest_column(F.when(F.col(several_c), whole("text"))))
    met = met.filter(~F.col(several_c) | F.array_contains(digests_c, F.col(digest_c)))
    return met.dropDuplicates(["doc_id", digest_c]).select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def digest_column(text):
    """The digest of a text column's words; null for null."""
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda t: None if t is None else digest_of(words_of(t)))

    return F.pandas_udf(run, "binary")(text)

"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The labelled rows that may be learnt from are dealt into three folds by a hash of their id. Each fold is described by a
lexicon (words and word beginnings that toxic texts hold far more often than chance allows) that the other two taught,
and judged by trees that they taught, so the isotonic calibration sees no row judged by what it taught. The final
lexicon and trees come from all folds. All have a documented bound on the rows they are fitted on (``FIT_ROWS``), drawn
from both labels apart, toxic rows first, and weighted back to their shares; every document is scored on its whole text.

Features: densities of lexicon words and beginnings in the text and how many there are, lexicon words near the
second person, shares of capitals, exclamation and other punctuation, obfuscated words (letters mixed with digits or
symbols, also read through the usual replacements), and length.

Cases: null and empty texts have all features 0 and are scored like any other text. Repeated labels of one id count
as toxic if one says so. Labels null, or without a document: not used. Fewer than two labels of a kind teach nothing: the
score is then the share of toxic rows among the labels (0 without labels). Empty table: no rows. Other columns are kept.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import OWN, releasing, stored, texts, whole
from .tokens import batches

#: Bound on the labelled rows that lexicon, trees and calibration are fitted on, all together.
FIT_ROWS = 24_000
#: Bound on the entries of the lexicon.
LEXICON_ENTRIES = 2_000
REJECT = 0.7
CROSSED_FOLDS = 3
#: What a Python worker keeps at once: tokens it has read and keys it counts (some 200 bytes each), characters of texts.
MEMO_TOKENS, MEMO_KEYS, BATCH_CHARS = 100_000, 200_000, 1_000_000
#: A key enters the lexicon if chance would put it among toxic texts as often with at most this probability (Chernoff).
#: Of a million keys that say nothing one in twenty fits lets one in.
CHANCE = 5e-8

LEAST_TEXTS = 2

BEGINNINGS = (4, 5, 6)
# Second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())
# Characters that stand for letters.
REPLACED = str.maketrans("013457@$!|", "oieastasil")

TOKEN = re.compile(r"\S+")
EDGES = string.punctuation
MIXERS = frozenset("0123456789@$!*#|")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*[\d@$!*#|]).+", re.DOTALL)
LETTERS = re.compile(r"[^\W\d_]+")

FEATURES = ("lexicon_words", "lexicon_word_density", "lexicon_beginnings", "lexicon_beginning_density", "heaviest",
            "total_weight", "near_second_person", "second_person", "capitals", "exclamation", "punctuation", "obfuscated",
            "length")


def readings(token: str) -> tuple[str, str]:
    """A token without its edge punctuation, in lower case: as it stands, and with replaced characters read back."""
    bare = EDGE.sub("", token).lower()
    plain = "".join(LETTERS.findall(token.lower().translate(REPLACED))) if MIXED.match(token) else bare
    return bare, plain


def keys_of(word: str) -> list[str]:
    """The lexicon keys of a word: itself and its beginnings, marked by length."""
    return ["=" + word] + [f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n]


def key_counts(sample: DataFrame) -> DataFrame:
    """``(key, fold, clean, toxic)``: how many texts of each label hold a key, stored; ``sample`` has ``text``, ``toxic``
    and ``fold``. Texts are counted per task first, so only distinct keys are shuffled."""
    @releasing
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, tuple[Counter, Counter]] = {}
        for frame in frames:
            for text, toxic, fold in zip(frame["text"], frame["toxic"], frame["fold"]):
                words = {r for token in set(TOKEN.findall(text)) for r in readings(token) if r}
                counts.setdefault(int(fold), (Counter(), Counter()))[int(toxic)].update({k for w in words for k in keys_of(w)})
                if sum(len(c) for both in counts.values() for c in both) > MEMO_KEYS:
                    yield from rows_of(counts)
                    counts.clear()
        yield from rows_of(counts)

    def rows_of(counts) -> Iterator[pd.DataFrame]:
        for fold, both in counts.items():
            for toxic, counter in enumerate(both):
                keys = iter(counter.items())
                while some := list(islice(keys, 50_000)):
                    names, n = zip(*some)
                    zero = [0] * len(n)
                    yield pd.DataFrame({"key": names, "fold": fold, "clean": zero if toxic else n, "toxic": n if toxic else zero})

    counted = sample.select("text", "toxic", "fold").mapInPandas(count, "key string, fold long, clean long, toxic long")
    return stored(counted.groupBy("key", "fold").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "keys")


def learn_lexicon(counts: DataFrame, n_clean: int, n_toxic: int, entries: int = LEXICON_ENTRIES) -> dict[str, float]:
    """Log odds of the keys that toxic texts hold far more often, from rows of ``key_counts`` over so many texts.

    How many texts must hold a key follows from the sample: a key that few texts hold enters if none of them, or
    hardly one, is clean. Where the sample is too small for any key, keys of ``LEAST_TEXTS`` toxic texts and no clean
    one enter. At most ``entries`` rows come back.
    """
    if not n_toxic or not n_clean:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    # the divergence of a key's share of toxic texts from that of all texts, times the texts that hold it
    held, base = F.col("toxic") + F.col("clean"), n_toxic / (n_toxic + n_clean)
    share = F.col("toxic") / held
    apart = share * F.log(share / base) + F.when(F.col("clean") > 0, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    sums = (counts.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .filter(F.col("toxic") >= LEAST_TEXTS).withColumn("odds", odds).filter(F.col("odds") >= math.log(8)))
    sums = stored(sums.select("key", "odds", "clean", (held * apart).alias("evidence")), "lexicon")

    def best(of: DataFrame) -> dict[str, float]:
        return {r["key"]: r["odds"] for r in of.orderBy(F.desc("evidence"), "key").limit(entries).collect()}

    return best(sums.filter(F.col("evidence") >= -math.log(CHANCE))) or best(sums.filter("clean = 0"))


class Reader(dict):
    """Features of texts. What a token says is worked out once and kept as a row of numbers, within ``MEMO_TOKENS``."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.words = {k[1:]: odds for k, odds in lexicon.items() if k[0] == "="}
        self.beginnings = {k[1:]: odds for k, odds in lexicon.items() if k[0] != "="}  # their length tells them apart
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.facts = np.zeros((1_024, 8), np.float32)

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        self.fresh.append(token)
        return number

    def heaviest(self, word: str) -> tuple[float, float]:
        """Odds of a word, and of its heaviest beginning."""
        return (self.words.get(word, 0.0), max((self.beginnings.get(word[:n], 0.0) for n in BEGINNINGS if len(word) > n), default=0.0))

    def token(self, token: str) -> tuple:
        core = token.strip(EDGES)
        if core.isalpha() and (core is token or MIXERS.isdisjoint(token)):  # a plain word, as most tokens are
            bare = core.lower()
            word, begin = self.heaviest(bare)
            return (word, begin, bare in SECOND_PERSON, len(core) > 1 and core.isupper() and bare.upper() == core, token.count("!"),
                    len(token) - len(core), False, len(token))
        bare, plain = readings(token)
        both = [self.heaviest(r) for r in {bare, plain}]
        letters = sum(map(len, LETTERS.findall(token)))
        return (max(w for w, _ in both), max(b for _, b in both), bare in SECOND_PERSON,
                len(bare) > 1 and bare.upper() in token and bare.isalpha(), token.count("!"), len(token) - letters, bare != plain, len(token))

    def features(self, texts: list[str]) -> list[list[float]]:
        if len(self) > MEMO_TOKENS:
            self.forget()
        known = len(self)
        words = [text.split() for text in texts]
        numbers = [np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in words]
        if self.fresh:
            if len(self) > len(self.facts):
                self.facts = np.concatenate([self.facts[:known], np.zeros((2 * len(self) - known, 8), np.float32)])
            self.facts[known:len(self)] = [self.token(t) for t in self.fresh]
            self.fresh = []
        return [describe(self.facts[n]) if len(n) else [0.0] * len(FEATURES) for n in numbers]


def describe(facts: np.ndarray) -> list[float]:
    n = len(facts)
    word, begin, you = facts[:, 0], facts[:, 1], facts[:, 2] > 0
    hit = np.flatnonzero((word > 0) | (begin > 0))
    words, begins = int((word > 0).sum()), int((begin > 0).sum())
    near = 0
    if len(hit) and you.any():
        places = np.flatnonzero(you)
        after = np.searchsorted(places, hit)
        gap = np.minimum(np.abs(places[np.minimum(after, len(places) - 1)] - hit), np.abs(hit - places[np.maximum(after - 1, 0)]))
        near = int((gap <= 5).sum())
    heaviest = float(np.maximum(word, begin).max())
    weight = float(np.maximum(word, begin).sum())
    chars = max(1.0, facts[:, 7].sum())
    return [float(words), 100 * words / n, float(begins), 100 * begins / n, heaviest, weight, near / n, you.sum() / n,
            facts[:, 3].sum() / n, facts[:, 4].sum() / n, facts[:, 5].sum() / chars, facts[:, 6].sum() / n, math.log1p(n)]


def features(lexicon: dict[str, float]):
    """Column function: the dense features of a text column."""
    @releasing
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(lexicon)
        for texts_ in series:
            whole_texts = texts_.tolist()
            out: list[list[float]] = []
            for a, b in batches(whole_texts, BATCH_CHARS):
                out += reader.features(whole_texts[a:b])
            yield pd.Series(out)

    return F.pandas_udf(run, "array<double>")


def fold_of(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3. Remainder 1 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(3))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """A sample of at most about ``fit_rows`` labelled texts outside the held-out fold.

    Toxic rows come first, up to half of the bound or what clean rows leave; ``weight`` gives each label its share back.
    """
    usable = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of() != 1))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    toxic = min(n_toxic, max(fit_rows // 2, fit_rows - n_clean))
    share = F.when(F.col("toxic") == 1, toxic / max(n_toxic, 1)).otherwise(min(1.0, (fit_rows - toxic) / max(n_clean, 1)))
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1_000_000_000)) / F.lit(1e9)
    picked = stored(usable.withColumn("share", share).filter(dealt < F.col("share")).select(
        "doc_id", "toxic", (1 / F.col("share")).alias("weight")), "picked")
    if picked.count() <= 2 * fit_rows:  # its size is that of the bound, but for chance: no text is shuffled
        picked = F.broadcast(picked)
    return stored(texts(docs, "doc_id").join(picked, "doc_id"), "labelled")


def described(sample: DataFrame, lexicon: dict[str, float], *keys: str) -> DataFrame:
    return sample.select(*keys, "weight", F.col("toxic").cast("double").alias("label"), features(lexicon)("text").alias("x"))


def grown(rows: DataFrame, least: int = 5) -> GBTClassificationModel:
    return GBTClassifier(maxIter=24, maxDepth=3, stepSize=0.2, subsamplingRate=0.9, seed=7, minInstancesPerNode=least,
                         weightCol="weight").fit(rows)


def judged_by(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).select("label", "weight", vector_to_array("probability")[1].alias("raw"))


def calibrated(raw: DataFrame) -> IsotonicRegressionModel:
    return IsotonicRegression(labelCol="label", featuresCol="raw", weightCol="weight").fit(raw)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit by crossed folds: every row teaches, and none is judged for the calibration by what it taught."""
    sample = labelled(docs, labels, fit_rows)
    found = {r["toxic"]: (r["n"], r["w"]) for r in sample.groupBy("toxic").agg(
        F.countDistinct("doc_id").alias("n"), F.sum("weight").alias("w")).collect()}
    total = sum(w for _, w in found.values())
    base = found[1][1] / total if 1 in found else 0.0
    rarest = min((n for n, _ in found.values()), default=0)
    folds = min(CROSSED_FOLDS, rarest)
    if folds < 2 or len(found) < 2:
        return Model({}, None, None, base)
    # ids only, within the bound of the sample
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
    dealt = sample.select("doc_id", "toxic").distinct().select("doc_id", F.pmod(F.row_number().over(order), F.lit(folds)).alias("fold"))
    sample = stored(sample.join(F.broadcast(dealt), "doc_id"), "folds")
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    counts = key_counts(sample)

    def lexicon(without: int | None = None) -> dict[str, float]:
        n_clean, n_toxic = (sum(n for (fold, toxic), n in sizes.items() if toxic == label and fold != without) for label in (0, 1))
        return learn_lexicon(counts if without is None else counts.filter(F.col("fold") != without), n_clean, n_toxic)

    parts = [described(sample.filter(F.col("fold") == k), lexicon(k), "fold") for k in range(folds)]
    rows = stored(reduce(DataFrame.unionByName, parts), "features").coalesce(4)
    rows = rows.withColumn("features", array_to_vector("x")).cache()
    least = max(1, min(5, rarest // 4))
    raw = [judged_by(grown(rows.filter(F.col("fold") != k), least), rows.filter(F.col("fold") == k)) for k in range(folds)]
    calibration = calibrated(stored(reduce(DataFrame.unionByName, raw), "raw"))
    trees = grown(rows, least)
    rows.unpersist()
    return Model(lexicon(), trees, calibration, base)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns of ``docs`` and the calibrated score. Trees and calibration run inside Spark's own expressions."""
    if model.trees is None:
        return docs.withColumn(into, F.lit(float(model.base)))
    vector, raw, level = OWN + "vector", OWN + "raw", OWN + "level"
    known = docs.withColumn(vector, array_to_vector(features(model.lexicon)(whole("text"))))
    trees = (model.trees.copy().setFeaturesCol(vector).setProbabilityCol(OWN + "p").setRawPredictionCol(OWN + "r")
             .setPredictionCol(OWN + "c"))
    calibration = model.calibration.copy().setFeaturesCol(raw).setPredictionCol(level)
    judged = trees.transform(known).withColumn(raw, vector_to_array(OWN + "p")[1])
    # the steps of the calibration tie many scores; a trace of the trees' own score keeps their order
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.99 * F.col(level) + 0.01 * F.col(raw)))
    return calibration.transform(judged).withColumn(into, value).select(*docs.columns, into)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and score every document."""
    return score(docs, fit(docs, labels, fit_rows), OWN + "score")


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    scored = toxicity(docs, labels)
    return scored.filter(F.col(OWN + "score") < reject).select(docs.columns)

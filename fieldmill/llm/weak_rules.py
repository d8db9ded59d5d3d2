"""Quality by weak supervision: rules vote or abstain, EM estimates how far each can be trusted, a posterior decides.

Every rule votes good, bad or abstains on a whole text. Nobody says which votes are right: expectation-maximisation
fits the share of good texts and, for every rule, how often it votes bad on good and on bad texts, from the counts of
the vote patterns of all documents. The posterior probability of quality of a text follows from its votes. So one vote
of a rule that good texts hardly ever break can outweigh many that bad texts satisfy too.

Only the distinct vote patterns come to the driver, each with its count: at most 3 to the number of rules, whatever
the number of documents. Two base conditions stand apart from the rules and always reject.

Cases: null and empty texts have no words; all rules but the shortest-length one abstain and the base condition
rejects them. Repeated rows are judged alike. Empty table: no rows. Ties (posterior exactly at the threshold) are
kept. Other columns are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import OWN, releasing, stored, whole

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP = 0.5

# name, measure, good when below / bad when above (or the other way round where the first bound is the larger one)
RULES = (
    ("symbols", "symbol_share", 0.01, 0.04),
    ("capitals", "upper_share", 0.15, 0.35),
    ("exclamations", "exclaimed_share", 0.05, 0.2),
    ("repeated_lines", "dup_line_share", 0.1, 0.35),
    ("repeated_windows", "repeat_share", 0.1, 0.3),
    ("most_frequent_word", "top_word_share", 0.12, 0.25),
    ("same_word_again", "echo_share", 0.05, 0.2),
    ("word_length_high", "mean_word", 9.0, 13.0),
    ("word_length_low", "mean_word", 3.4, 2.2),
    ("sentence_ends", "ended_share", 0.02, 0.002),
    ("length", "n_words", 40.0, 20.0),
)
RULE_NAMES = tuple(name for name, *_ in RULES)
GOOD, ABSTAIN, BAD = 2, 1, 0
#: The most of the good texts that a rule may call bad.
MAX_FALSE_ALARMS = 0.003
#: The largest share of good texts that EM may settle on; keeps a corpus without bad texts from trusting no vote.
MAX_GOOD = 0.97
PRIOR = 4.0

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
            "n_exclaimed", "top_word", "n_echo", "n_ended")
_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def words_of(text: str) -> list[str]:
    """Words: runs of anything but a space and the characters 9 to 13."""
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def repeated_window_words(words: list[str], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    # a hash finds windows that may repeat; those are then compared word by word
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + mixed[k:n + k]
    order = np.argsort(rolled, kind="stable")
    ordered = rolled[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    maybe = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)[maybe]
    _, back, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    hits = maybe[counts[back.ravel()] > 1]
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, hits, 1)
    np.add.at(covered, hits + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts named in ``MEASURES``."""
    words = words_of(text)
    lines, seen, dup = [line for line in text.split("\n") if words_of(line)] if words else [], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    letters = sum(map(str.isalpha, text))
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), dup, repeated_window_words(words), len(lines),
            sum(map(str.isupper, text)), letters, sum("!" in w for w in words),
            Counter(words).most_common(1)[0][1] if words else 0, sum(a == b for a, b in zip(words, words[1:])),
            sum(w[-1] in ".?!…" for w in words))


def shares(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n = np.maximum(counts["n_words"], 1).astype(float)
    return {"symbol_share": counts["n_symbols"] / np.maximum(counts["word_chars"], 1),
            "upper_share": counts["n_upper"] / np.maximum(counts["n_letters"], 1),
            "exclaimed_share": counts["n_exclaimed"] / n, "dup_line_share": counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1),
            "repeat_share": counts["n_repeat_words"] / n, "top_word_share": counts["top_word"] / n, "echo_share": counts["n_echo"] / n,
            "mean_word": counts["word_chars"] / n, "ended_share": counts["n_ended"] / n, "n_words": counts["n_words"].astype(float)}


def votes(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of all rules (columns) on all texts (rows). Between its two bounds a rule abstains."""
    values, out = shares(counts), np.full((len(counts["n_words"]), len(RULES)), ABSTAIN)
    for k, (name, of, good, bad) in enumerate(RULES):
        x = values[of]
        out[x <= good if good < bad else x >= good, k] = GOOD
        out[x >= bad if good < bad else x <= bad, k] = BAD
        if name != "length":
            # shares of a handful of words say nothing
            out[counts["n_words"] < (MIN_WORDS if of in ("top_word_share", "ended_share", "repeat_share") else 1), k] = ABSTAIN
    return out


def encode_votes(table: np.ndarray) -> np.ndarray:
    return (table * 3 ** np.arange(table.shape[1])).sum(1)


def decode_votes(code: np.ndarray, rules: int = len(RULES)) -> np.ndarray:
    return np.asarray(code)[:, None] // 3 ** np.arange(rules) % 3


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """EM over vote patterns: (share of good texts, chance of a bad vote by class and rule where the rule votes).

    Abstaining says nothing. Class 1 is good: there a rule votes bad at most ``MAX_FALSE_ALARMS`` of the time, which
    is what makes it a rule, and keeps a kind of bad text that only one rule sees from passing as noise of that rule.
    A bad text breaks at least one rule on average, so the bad class can't absorb texts that break none.
    Every chance has pseudo-counts as if ``PRIOR`` texts had been seen.
    """
    bad, voted = (patterns == BAD).astype(float), (patterns != ABSTAIN).astype(float)
    prior = np.array([0.5, MAX_FALSE_ALARMS / 2])
    chances = np.repeat(np.array([[0.3], [MAX_FALSE_ALARMS / 2]]), patterns.shape[1], axis=1)
    good = 0.8
    for _ in range(rounds):
        posterior = posteriors(patterns, good, chances)
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        fresh = (weight @ bad + PRIOR * prior[:, None]) / (weight @ voted + PRIOR)
        fresh[1] = np.minimum(fresh[1], MAX_FALSE_ALARMS)
        fresh[0] = np.maximum(fresh[0], 2 * fresh[1])
        fresh[0] = np.minimum(fresh[0] * max(1.0, 1.0 / fresh[0].sum()), 0.95)
        share = min((weight[1].sum() + 1) / (counts.sum() + 2), MAX_GOOD)
        moved = max(abs(share - good), float(np.abs(fresh - chances).max()))
        good, chances = share, fresh
        if moved < 1e-9:
            break
    return good, chances


def posteriors(patterns: np.ndarray, good: float, chances: np.ndarray) -> np.ndarray:
    """Probability of quality of each vote pattern."""
    bad, fine = patterns == BAD, patterns == GOOD
    logs = bad @ np.log(chances).T + fine @ np.log1p(-chances).T
    gap = logs[:, 1] - logs[:, 0] + np.log(good) - np.log1p(-good)
    return 1 / (1 + np.exp(-np.clip(gap, -700, 700)))


def measured(docs: DataFrame, into: str = OWN + "m") -> DataFrame:
    """All columns of ``docs`` and a struct of the measures with the encoded votes. No shuffle, whole texts."""
    @releasing
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            frame = pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES)).astype("int64")
            frame["pattern"] = encode_votes(votes({c: frame[c].to_numpy() for c in MEASURES})).astype("int64")
            yield frame

    schema = ", ".join(f"{c} long" for c in MEASURES) + ", pattern long"
    return docs.withColumn(into, F.pandas_udf(run, schema)(whole("text")))


def base_failed(of: str):
    n = F.col(f"{of}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{of}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def posterior_table(rows: DataFrame, of: str = OWN + "m") -> dict[int, float]:
    """Posterior by vote pattern, from the counts of all rows."""
    found = rows.groupBy(F.col(f"{of}.pattern").alias("pattern")).agg(F.count("*").alias("n")).collect()
    if not found:
        return {}
    codes, counts = np.array([r["pattern"] for r in found]), np.array([r["n"] for r in found], float)
    order = np.argsort(codes)
    patterns = decode_votes(codes[order])
    return dict(zip(codes[order].tolist(), posteriors(patterns, *fit(patterns, counts[order])).tolist()))


def judged(rows: DataFrame, table: dict[int, float], of: str = OWN + "m") -> DataFrame:
    """Adds ``posterior`` and ``kept`` to measured rows."""
    pairs = [x for code, p in sorted(table.items()) for x in (F.lit(code), F.lit(p))]
    posterior = F.element_at(F.create_map(*pairs), F.col(f"{of}.pattern")) if pairs else F.lit(0.0)
    return (rows.withColumn(OWN + "posterior", posterior)
            .withColumn(OWN + "kept", ~base_failed(of) & (F.col(OWN + "posterior") >= KEEP)))


def quality(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, ``base_failed``, the posterior and the verdict."""
    of = OWN + "m"
    rows = stored(measured(docs.select("doc_id", "text")).select("doc_id", of), "measures")
    return judged(rows, posterior_table(rows)).select(
        "doc_id", *[F.col(f"{of}.{c}").alias(c) for c in MEASURES], base_failed(of).alias("base_failed"),
        F.col(OWN + "posterior").alias("posterior"), F.col(OWN + "kept").alias("kept"))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """Keeps the documents of quality. The measures are taken once and written, with the rows they belong to."""
    rows = stored(measured(docs), "measured")
    return judged(rows, posterior_table(rows)).filter(F.col(OWN + "kept")).select(docs.columns)

"""Alignment of two tokenizers over whole texts by merge-path partitioning, and how often their ids meet.

Both tokenizers cut the same bytes (the text after one space): A is a byte-level vocabulary of the ``tokenizers``
library, B a SentencePiece model, which adds that space itself. The ends of A's and of B's tokens are two ascending
lists. Their merge is a path of ``len(a) + len(b)`` steps; a binary search on every ``PIECE``-th diagonal finds where the
path crosses it, which cuts the merge into pieces of equal work whatever the lengths of the texts. A piece merges its two
slices alone and emits the overlaps it can close: the places where a token of A and one of B both end. Stitching puts the
pieces one after the other, adds the ends whose A side is the last step of a piece and whose B side is the first of the
next, and so closes the groups that run across pieces.

Spark counts in how many documents an id pair is linked, from the distinct pairs of each document. Pairs go back to their
documents in two ways: the commonest ones, at most ``HEAD_PAIRS`` by a histogram of the counts, are broadcast, so no
hot pair is ever shuffled; the others, each with a small share of the rows, meet by a join.

Cases: null or empty texts, and texts whose tokens do not give the bytes back, have no tokens: zeros and an empty digest.
Repeated rows (also of one id) are documents of their own. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored, texts
from .tokens import Encoder, default_vocabulary, gather, picked

PIECE = 1 << 15
TEXT_CHARS = 1_000_000
#: Ids of either vocabulary take so many bits in a pair's number; texts of one batch take the rest.
ID_BITS = 20
#: Pairs listed at once within a task, and pairs in one row of the stored table.
PAIRS_AT_ONCE = 1 << 21
ROW_PAIRS = 1 << 16
HEAD_PAIRS = 200_000

FACTS_SCHEMA = ("row long, part int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                "pairs array<long>, times array<long>")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def byte_table(token: str) -> bytes:
    """The bytes of a byte-level token."""
    return bytes(_BYTES[c] for c in token)


def _byte_characters() -> dict[str, int]:
    """Printable characters stand for their own byte, the other bytes for characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


_BYTES = _byte_characters()


class TwoEncoders(Encoder):
    """Ids of both tokenizers, asked once per distinct word where both take a text word by word."""

    first_mark = ""  # the first word follows the added space

    def __init__(self, vocabulary: str, model: str):
        import sentencepiece
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode("utf-8", "surrogatepass")
                        for i, n in enumerate(names)]
        # a piece never crosses the beginning of a word or a line feed, and no normaliser looks beyond a word
        self.by_words = not any("▁" in n.lstrip("▁") or "\n" in n for n in names) and plain_model(model)
        super().__init__(vocabulary, special_as_text=True)
        self.b_starts, self.b_counts, self.b_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.sound = np.zeros(0, bool)
        table = {i: t for t, i in self.library.get_vocab().items()}
        self.a_bytes = [byte_table(table[i]) if set(table.get(i, "")) <= _BYTES.keys() else table[i].encode("utf-8") for i in range(len(table))]
        if max(len(table), len(names)) > 1 << ID_BITS:
            raise ValueError("a vocabulary is too large for the numbers of pairs")
        self.b_lengths = np.array([len(b) for b in self.b_bytes], np.int64)

    def _keep(self, words: np.ndarray) -> None:
        super()._keep(words)
        self.sound = self.sound[words]
        self.b_ids, self.b_starts, self.b_counts = picked(self.b_ids, self.b_starts[words], self.b_counts[words])

    def _learn(self):
        new = self.memo.fresh
        super()._learn()
        for at in range(0, len(new), 50_000):
            some = new[at:at + 50_000]
            # a word after a line feed has no mark of its own: the added one is dropped
            ids = [x[1:] if w[:1] == "\n" else x for w, x in zip(some, self.pieces.encode(some, num_threads=1))]
            counts = np.array([len(x) for x in ids], np.int64)
            sound = [b"".join(map(self.b_bytes.__getitem__, x)) == (w if w[:1] == "\n" else " " + w).encode("utf-8", "surrogatepass")
                     for w, x in zip(some, ids)]
            self.b_starts = np.concatenate([self.b_starts, len(self.b_ids) + np.cumsum(counts) - counts])
            self.b_counts = np.concatenate([self.b_counts, counts])
            self.b_ids = np.concatenate([self.b_ids, np.array([i for x in ids for i in x], np.int32)])
            self.sound = np.concatenate([self.sound, np.array(sound, bool)])

    def both(self, many: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Per text the ids of A and of B, or None where it has no tokens."""
        split = [self.by_words and self.splits(t) for t in many]
        numbers, cuts = self.numbered([t for t, s in zip(many, split) if s])
        out, at = [], 0
        for text, s in zip(many, split):
            n = numbers[cuts[at]:cuts[at + 1]] if s else None
            at += s
            if n is not None and self.sound[n].all():
                out.append((gather(self.ids, self.starts[n], self.lengths[n]), gather(self.b_ids, self.b_starts[n], self.b_counts[n])))
            else:
                out.append(self.of_whole(text))
        return out

    def of_whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        if not text:
            return None
        a, b = self.plain(" " + text), np.array(self.pieces.encode([text], num_threads=1)[0], np.int32)
        want = (" " + text).encode("utf-8", "surrogatepass")
        same = all(b"".join(map(table.__getitem__, ids.tolist())) == want for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        return (a, b) if same else None


def plain_model(model: str) -> bool:
    """Whether a model file states that it neither normalises nor drops spaces and marks words at their beginning."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # without the reader of model files every text goes to the library as a whole
        return False
    stated = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        stated.ParseFromString(f.read())
    rules = stated.normalizer_spec
    return (rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
            and not stated.trainer_spec.treat_whitespace_as_suffix)


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending lists crosses every ``piece``-th diagonal: (taken from a, taken from b).

    Of equal values the one of ``a`` comes first. All diagonals are searched at once.
    """
    steps = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(steps - len(b), 0), np.minimum(steps, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        # is the element a[mid] among the first ``steps`` of the merge? then more of a is taken
        more = (low < high) & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(steps - mid - 1, 0, len(b) - 1)])
        low, high = np.where(more, mid + 1, low), np.where(more | (low >= high), high, mid)
    return low, steps - low


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends that both slices hold: how many elements of each slice they close."""
    place = np.searchsorted(b, a)
    both = np.flatnonzero(place < len(b))
    both = both[b[place[both]] == a[both]]
    return both + 1, place[both] + 1


def stitch(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, pieces: list) -> tuple[np.ndarray, np.ndarray]:
    """The cuts of all pieces in order: how many tokens of A and of B lie before each."""
    out = []
    for k, (x, y) in enumerate(pieces):
        if k and i[k] and j[k] < len(b) and a[i[k] - 1] == b[j[k]]:  # one end, dealt to two pieces
            out.append((i[k:k + 1], j[k:k + 1] + 1))
        out.append((x + i[k], y + j[k]))
    return tuple(np.concatenate(side) for side in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def cuts(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and B end at or before each byte where both do, piece by piece."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = diagonals(a, b, piece)
    pieces = [merge_piece(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]]) for k in range(len(i) - 1)]
    return stitch(a, b, i, j, pieces)


def linked(a_ids: np.ndarray, b_ids: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, id of A, id of B) numbers, ascending, and their links, of groups given by their token counts.

    Every token of A meets the tokens of B of its group; a bounded number of pairs is listed at a time.
    """
    group = np.repeat(np.arange(len(n_a)), n_a)
    first = (np.cumsum(n_b) - n_b)[group]
    codes = (doc[group] << 2 * ID_BITS) | (a_ids.astype(np.int64) << ID_BITS)
    ends = np.cumsum(n_b[group])
    found, at = [], 0
    while at < len(codes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        n = n_b[group[at:upto]]
        found.append(np.unique(np.repeat(codes[at:upto], n) | gather(b_ids, first[at:upto], n), return_counts=True))
        at = upto
    if len(found) == 1:
        return found[0]
    numbers, place = np.unique(np.concatenate([x for x, _ in found] or [np.zeros(0, np.int64)]), return_inverse=True)
    times = np.zeros(len(numbers), np.int64)
    np.add.at(times, place, np.concatenate([t for _, t in found] or [np.zeros(0, np.int64)]))
    return numbers, times


def names(n: int) -> dict[str, np.ndarray]:
    """Decimal ids with each sign that may follow."""
    return {sign: np.array([f"{i}{sign}" for i in range(n)], object) for sign in ",|;"}


def written(a_ids: np.ndarray, b_ids: np.ndarray, i: np.ndarray, j: np.ndarray, words: dict[str, np.ndarray]) -> np.ndarray:
    """All ids as text, in the order of the groups: those of A, then those of B."""
    out = np.empty(len(a_ids) + len(b_ids), object)
    n_a, n_b = np.diff(i, prepend=0), np.diff(j, prepend=0)
    a_at = np.arange(len(a_ids)) + np.repeat(j - n_b, n_a)
    b_at = np.arange(len(b_ids)) + np.repeat(i, n_b)
    out[a_at], out[b_at] = words[","][a_ids], words[","][b_ids]
    out[a_at[i - 1]], out[b_at[j - 1]] = words["|"][a_ids[i - 1]], words[";"][b_ids[j - 1]]
    return out


def align(pairs: list[tuple[np.ndarray, np.ndarray]], a_sizes: np.ndarray, b_sizes: np.ndarray, words: dict[str, np.ndarray],
          piece: int = PIECE) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
    """Per text with tokens: numbers of tokens of A and B, of groups and links, the digest, distinct pairs and links.

    The texts stand one after the other, so their ends are ends of both tokenizers and no group crosses them.
    """
    a_ids, b_ids = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    i, j = cuts(np.cumsum(a_sizes[a_ids]), np.cumsum(b_sizes[b_ids]), piece)
    n_a, n_b = np.diff(i, prepend=0), np.diff(j, prepend=0)
    last = np.searchsorted(i, np.cumsum([len(a) for a, _ in pairs]))  # the last group of each text
    doc = np.searchsorted(last, np.arange(len(i)))
    numbers, times = linked(a_ids, b_ids, n_a, n_b, doc)
    edges = np.searchsorted(numbers, np.arange(len(pairs) + 1) << 2 * ID_BITS)
    numbers = numbers & ((1 << 2 * ID_BITS) - 1)
    links = np.cumsum(n_a * n_b)
    text, out, before = written(a_ids, b_ids, i, j, words), [], -1
    for k, end in enumerate(last.tolist()):
        tokens = text[i[before] + j[before] if k else 0:i[end] + j[end]]
        digest = hashlib.sha256("".join(tokens.tolist())[:-1].encode()).hexdigest()
        out.append((len(pairs[k][0]), len(pairs[k][1]), end - before, int(links[end] - (links[before] if k else 0)), digest,
                    numbers[edges[k]:edges[k + 1]], times[edges[k]:edges[k + 1]]))
        before = end
    return out


_ENCODERS: dict[tuple[str, str], TwoEncoders] = {}


def two_encoders(vocabulary: str, model: str) -> TwoEncoders:
    """One pair of encoders per Python worker."""
    if (vocabulary, model) not in _ENCODERS:
        _ENCODERS[vocabulary, model] = TwoEncoders(vocabulary, model)
    return _ENCODERS[vocabulary, model]


def facts(docs: DataFrame, vocabulary: str, model: str, piece: int = PIECE) -> DataFrame:
    """Per document its own figures and its distinct linked pairs, in as many rows as ``ROW_PAIRS`` asks. No shuffle."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = two_encoders(vocabulary, model), TaskContext.get().partitionId() << 33
        words = names(max(len(encode.a_bytes), len(encode.b_bytes)))
        for frame in frames:
            ids, whole = frame.column("doc_id"), frame.column("text").to_pylist()
            at = 0
            while at < len(whole):
                start, size = at, 0
                while at < len(whole) and (size < TEXT_CHARS):
                    size += len(whole[at])
                    at += 1
                tokens = encode.both(whole[start:at])
                with_tokens = [k for k, t in enumerate(tokens) if t is not None]
                found = dict(zip(with_tokens, align([tokens[k] for k in with_tokens], encode.byte_lengths, encode.b_lengths, words, piece)
                                 if with_tokens else []))
                yield batch(row, ids.slice(start, at - start), [found.get(k) for k in range(at - start)])
                row += at - start

    return texts(docs, "doc_id").mapInArrow(run, FACTS_SCHEMA)


NO_TOKENS = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def batch(row: int, ids: pa.Array, found: list) -> pa.RecordBatch:
    """Rows of FACTS_SCHEMA; further rows of a document hold pairs only."""
    found = [f or NO_TOKENS for f in found]
    where = [(k, part) for k, f in enumerate(found) for part in range(max(1, -(-len(f[5]) // ROW_PAIRS)))]
    own = [k for k, _ in where]
    cut = [slice(part * ROW_PAIRS, (part + 1) * ROW_PAIRS) for _, part in where]
    offsets = np.cumsum([0, *(len(found[k][5][c]) for k, c in zip(own, cut))]).astype(np.int32)

    def lists(place):
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([found[k][place][c] for k, c in zip(own, cut)])))

    columns = [pa.array(row + np.array(own, np.int64)), pa.array(np.array([p for _, p in where], np.int32)),
               ids.take(pa.array(own)).cast(pa.int64()), *(pa.array([found[k][place] for k in own], pa.int64()) for place in range(4)),
               pa.array([found[k][4] for k in own]), lists(5), lists(6)]
    return pa.RecordBatch.from_arrays(columns, ["row", "part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def pair_counts(own: DataFrame) -> DataFrame:
    """``(pair, count, best)``: documents that hold a pair linked, and whether no pair of its A id is in more."""
    counts = stored(own.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    a_id = F.shiftright("pair", ID_BITS)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("most"))  # a row per id of A: broadcast
    held = counts.withColumn("a", a_id).join(F.broadcast(most), "a")
    return stored(held.select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-counts")


def head_level(counts: DataFrame, head_pairs: int) -> int:
    """The least level (quarter powers of two) from which on at most ``head_pairs`` pairs have their counts."""
    sizes = counts.groupBy(level().alias("level")).agg(F.count("*").alias("pairs")).collect()  # some 250 rows at most
    total, least = 0, 1 << 20
    for row in sorted(sizes, key=lambda r: -r["level"]):
        total += row["pairs"]
        if total > head_pairs:
            break
        least = row["level"]
    return least


def level():
    return F.floor(4 * F.log2("count")).cast("int")


def cross_align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, piece: int = PIECE,
                head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """One row per row of ``docs`` with the columns of ``COLUMNS``."""
    own = stored(facts(docs, vocabulary or default_vocabulary(), model or default_model(), piece), "alignments")
    counts = pair_counts(own)
    least = head_level(counts, head_pairs)
    head, tail = counts.filter(level() >= least), counts.filter(level() < least)
    zipped = F.explode(F.arrays_zip("pairs", "times")).alias("z")
    links = own.select("row", zipped).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    common = links.join(F.broadcast(head), "pair")
    rare = links.join(F.broadcast(head.select("pair")), "pair", "left_anti").join(tail, "pair")

    # one aggregation over both: two aggregates side by side would share their partitioning, which adaptive execution
    # may coalesce apart
    met = common.select("row", "times", "count", "best").unionByName(rare.select("row", "times", "count", "best"))
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"),
                                  F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    out = own.filter("part = 0").drop("pairs", "times", "part").join(sums, "row", "left").na.fill(0, ["count_sum", "n_best"])
    return out.select(*COLUMNS)

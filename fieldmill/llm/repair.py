"""Token ids in binary shards compressed by Re-Pair, with random access to each document.

A shard is one row of a Parquet file: which documents it holds and one binary payload. Re-Pair replaces frequent
pairs of neighbouring ids by a new id (a rule) until no pair is frequent; a round counts the pairs of the shard and
replaces those within 1 / ``ROUND_SHARE`` of the most frequent one, the more frequent first where two overlap. Counts
of old pairs only fall, so later rounds look at pairs that were frequent before or hold a new id. A pair never crosses
the end of a document, so a document is a slice of the compressed sequence and decodes alone, and so does any range of
it: the stored expansion lengths tell which symbols hold the range.

Payload, little-endian: magic ``FMRP``, then uint32 ``terminals, rules, symbols, documents``; rules as two uint32
arrays (left, right) and one of expansion lengths; the sequence as uint32; the first symbol of each document and one
past the last as uint32 (``documents + 1``). ``doc_ids`` and ``n_tokens`` stand beside the payload.

Cases: null or empty text: the end id alone. Empty table: no shards, no rows. Repeated rows: each is stored. Equal
ids are ordered by text. A null id sorts first. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_path
from .common import releasing, texts
from .tokens import ENCODE_CHARS, batches, default_vocabulary, encoder, gather, runs

MAGIC = b"FMRP"
SHARD_TOKENS = 1 << 20
#: A pair is frequent if a shard holds it so often.
MIN_COUNT = 16
ROUND_SHARE = 32

SHARD_SCHEMA = ("partition int, shard int, start_in_task long, n_ids long, doc_ids array<long>, n_tokens array<int>, "
                "payload binary")
IDS_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bucket(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)


BUCKETS = 1 << 17


def places_of(pairs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers): where ``codes`` holds one of the ascending ``pairs``, and which.

    A table by hash gives one pair per bucket; only where several pairs share a bucket a place is searched.
    """
    own, hashed = bucket(pairs), bucket(codes)
    table = np.full(BUCKETS, -1, np.int32)
    table[own] = np.arange(len(pairs))
    crowded = np.bincount(own.astype(np.int64), minlength=BUCKETS) > 1
    spot = table[hashed]
    near = np.flatnonzero(spot >= 0)
    found = spot[near].astype(np.int64)
    open_ = np.flatnonzero((pairs[found] != codes[near]) & crowded[hashed[near]])
    found[open_] = np.minimum(np.searchsorted(pairs, codes[near[open_]]), len(pairs) - 1)
    right = pairs[found] == codes[near]
    return near[right], found[right]


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (left, right, sequence, last) where ``last`` marks the last symbol of each document.

    ``ends`` holds one past the last id of each document; every document has an id at least.
    """
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    left, right, known = [], [], terminals
    look = np.ones(len(seq), bool)  # where a pair starts that may be frequent
    while True:
        look &= ~last  # the last symbol of all is the last of its document
        at = np.flatnonzero(look)
        codes = (seq[at] << 32) | seq[at + 1]
        ordered = np.sort(codes)
        starts = np.flatnonzero(np.diff(ordered, prepend=-1))
        counts = np.diff(starts, append=len(ordered))
        often = np.flatnonzero(counts >= min_count)
        if not len(often):
            break
        pairs, counts = ordered[starts[often]], counts[often]
        rank = np.empty(len(pairs), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(pairs))
        near, found = places_of(pairs, codes)
        look[:] = False
        look[at[near]] = True
        now = counts[found] >= int(counts.max()) // ROUND_SHARE
        near, found = at[near[now]], found[now]
        # of two overlapping pairs the more frequent one is taken; in a run of one id every other pair
        key = 2 * rank[found]
        touch = np.diff(near) == 1
        same = np.concatenate([[False], touch & (found[1:] == found[:-1])])
        if same.any():
            places = np.arange(len(near))
            key += (places - np.maximum.accumulate(np.where(same, 0, places))) & 1
        less = key[1:] < key[:-1]
        take = np.ones(len(near), bool)
        take[1:] &= ~touch | less
        take[:-1] &= ~touch | ~less
        places, chosen = near[take], found[take]
        used = np.bincount(chosen, minlength=len(pairs)) >= 2
        if not used.any():
            break
        places, chosen = places[used[chosen]], chosen[used[chosen]]
        numbers = np.cumsum(used) - 1 + known
        left.append(pairs[used] >> 32)
        right.append(pairs[used] & 0xFFFFFFFF)
        seq[places] = numbers[chosen]
        last[places] = last[places + 1]
        look[places] = True
        look[np.maximum(places - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq, last, look = seq[keep], last[keep], look[keep]
        known += int(used.sum())
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none]), seq, last


def rule_lengths(left: np.ndarray, right: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule stands for. A rule only uses symbols made before it, so waves settle in a few passes."""
    lengths = np.concatenate([np.ones(terminals, np.int64), np.zeros(len(left), np.int64)])
    while not lengths.all():
        open_rules = np.flatnonzero(lengths[terminals:] == 0)
        a, b = lengths[left[open_rules]], lengths[right[open_rules]]
        ready = (a > 0) & (b > 0)
        lengths[terminals + open_rules[ready]] = (a + b)[ready]
    return lengths[terminals:]


def pack(ids: np.ndarray, counts: np.ndarray, terminals: int) -> bytes:
    """The payload of a shard; ``counts`` holds the ids of each document."""
    left, right, seq, last = compress(ids, np.cumsum(counts), terminals)
    first = np.concatenate([[0], np.flatnonzero(last) + 1])
    head = np.array([terminals, len(left), len(seq), len(counts)], "<u4")
    parts = (head, left, right, rule_lengths(left, right, terminals), seq, first)
    return MAGIC + b"".join(np.asarray(x).astype("<u4").tobytes() for x in parts)


class Shard:
    """A payload opened for decoding: all of it, or one document at a time."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        words = np.frombuffer(payload, "<u4", offset=4)
        self.terminals, rules, symbols, docs = (int(x) for x in words[:4])
        cuts = np.cumsum([4, rules, rules, rules, symbols, docs + 1])
        self.left, self.right, self.rule_lengths, self.sequence, self.first = (
            words[a:b].astype(np.int64) for a, b in zip(cuts[:-1], cuts[1:]))
        self._table = None

    def _expansions(self):
        """All rules written out: (ids, starts, lengths) by symbol."""
        if self._table is None:
            n = self.terminals
            ids, starts = np.arange(n, dtype=np.int64), np.concatenate([np.arange(n), np.zeros(len(self.left), np.int64)])
            lengths = np.concatenate([np.ones(n, np.int64), self.rule_lengths])
            done = n
            while done < n + len(self.left):
                # the rules from here on whose parts are written out already
                later = np.maximum(self.left[done - n:], self.right[done - n:]) >= done
                upto = done + (int(np.argmax(later)) if later.any() else len(later))
                rules = slice(done - n, upto - n)
                both = np.stack([self.left[rules], self.right[rules]], 1).ravel()
                starts[done:upto] = len(ids) + np.cumsum(lengths[done:upto]) - lengths[done:upto]
                ids = np.concatenate([ids, gather(ids, starts[both], lengths[both])])
                done = upto
            self._table = ids, starts, lengths
        return self._table

    def all(self) -> np.ndarray:
        ids, starts, lengths = self._expansions()
        return gather(ids, starts[self.sequence], lengths[self.sequence])

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols: every pass opens one level of rules."""
        while (rule := symbols >= self.terminals).any():
            place = np.cumsum(1 + rule) - 1 - rule
            out = np.empty(len(symbols) + int(rule.sum()), np.int64)
            out[place[~rule]] = symbols[~rule]
            numbers = symbols[rule] - self.terminals
            out[place[rule]], out[place[rule] + 1] = self.left[numbers], self.right[numbers]
            symbols = out
        return symbols

    def document(self, k: int) -> np.ndarray:
        """The ids of one document, from its own symbols only."""
        return self.expanded(self.sequence[self.first[k]:self.first[k + 1]])

    def range(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of one document: the stored lengths find the symbols that hold them, and only
        these are expanded."""
        symbols = self.sequence[self.first[k]:self.first[k + 1]]
        ends = np.cumsum(self.lengths_of(symbols))
        start, stop = max(start, 0), min(stop, int(ends[-1]))
        if start >= stop:
            return symbols[:0]
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expanded(symbols[a:b])[start - before:stop - before]

    def lengths_of(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for, without decoding it."""
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.terminals
        out[rule] = self.rule_lengths[symbols[rule] - self.terminals]
        return out

    def n_ids(self, k: int) -> int:
        """Ids of one document by the stored lengths, without decoding it."""
        return int(self.lengths_of(self.sequence[self.first[k]:self.first[k + 1]]).sum())


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None,
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write shards in ascending ``doc_id`` order.

    One range shuffle by id; the shards of a task follow each other, and so do the tasks, so ``(partition, shard)``
    is the order of the whole set. A task holds one shard at a time.
    """
    vocabulary = vocabulary or default_vocabulary()

    @releasing
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, partition, shard = encoder(vocabulary), TaskContext.get().partitionId(), 0
        terminals = encode.library.get_vocab_size()
        held_ids, held_docs, held_counts, held, done = [], [], [], 0, 0

        def close():
            nonlocal held_ids, held_docs, held_counts, held, shard, done
            counts = np.concatenate(held_counts)
            row = {"partition": partition, "shard": shard, "start_in_task": done, "n_ids": held, "doc_ids": held_docs,
                   "n_tokens": counts.tolist(), "payload": pack(np.concatenate(held_ids), counts, terminals)}
            done += held
            held_ids, held_docs, held_counts, held, shard = [], [], [], 0, shard + 1
            return pd.DataFrame([row])

        for frame in frames:
            names, whole = [None if pd.isna(x) else int(x) for x in frame["doc_id"]], frame["text"].tolist()
            for a, b in batches(whole, ENCODE_CHARS):
                ids, offsets = encode.encode(whole[a:b])
                counts = np.diff(offsets)
                for c, d in runs(counts, shard_tokens // 4):
                    held_ids.append(ids[offsets[c]:offsets[d]])
                    held_docs += names[a + c:a + d]
                    held_counts.append(counts[c:d])
                    held += int(offsets[d] - offsets[c])
                    if held >= shard_tokens:
                        yield close()
        if held:
            yield close()
        encode.shrink()

    ordered = texts(docs, "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decode every shard: per document where its ids start in the whole set, how many they are, and their crc32.

    The ids before a shard are those of the tasks before its own, and of its task's shards before it, which it
    states itself. Only one total per writing task comes to the driver.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    before, start = {}, 0
    for row in sorted(shards.groupBy("partition").agg(F.sum("n_ids").alias("n_ids")).collect()):
        before[row["partition"]] = start
        start += row["n_ids"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ids = Shard(row.payload).all().astype("<u4")
                counts = np.array(row.n_tokens, np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pd.DataFrame({"doc_id": pd.array([x if x == x else None for x in row.doc_ids], "Int64"),
                                    "start": before[row.partition] + row.start_in_task + ends - counts, "n_tokens": counts,
                                    "ids_crc32": crc})

    return shards.select("partition", "start_in_task", "doc_ids", "n_tokens", "payload").mapInPandas(run, IDS_SCHEMA)


def encode_documents(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Write the shards (to ``path`` or the shared folder), read them back and return the checked rows."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "repair-shards")
    write_shards(docs, path, vocabulary)
    return read_ids(spark, path)

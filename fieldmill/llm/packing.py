"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents longer than a sequence are cut into full pieces; the first piece takes the remainder. Pieces are dealt at
random into groups of a bounded size, and every group is packed on its own: a sequence is filled greedily, each time
with the longest unpacked piece that fits; then its smallest piece is taken out if two unpacked pieces fill the
widened gap more tightly. Only what is left in a group's last sequences is lost against packing all pieces at once.

Cases: null or empty text: one piece that holds the end id alone. Empty table: no rows. Repeated rows: each is packed.
Ties between pieces of one length: by (doc_id, piece). Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import OWN, releasing, stored, texts
from .tokens import ENCODE_CHARS, default_vocabulary, encoder, runs

SEQUENCE_TOKENS = 2048
GROUP_PIECES = 16_384

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = SEQUENCE_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every whole text, with the checksum of their ids. No shuffle."""
    vocabulary = vocabulary or default_vocabulary()

    @releasing
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for frame in frames:
            names, column = frame.column("doc_id").cast(pa.int64()), frame.column("text")
            for a, b in runs(pc.utf8_length(column).to_numpy(), ENCODE_CHARS):
                whole = column.slice(a, b - a).to_pylist()  # only these texts are Python's at a time
                ids, offsets = encode.encode(whole)
                raw = memoryview(ids.astype("<u4").tobytes())
                rows = [(a + k, i, start, length, zlib.crc32(raw[4 * (offsets[k] + start):4 * (offsets[k] + start + length)]))
                        for k in range(b - a) for i, (start, length) in enumerate(cut(int(offsets[k + 1] - offsets[k]), capacity))]
                at, piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
        encode.shrink()

    return texts(docs, "doc_id").mapInArrow(run, PIECE_SCHEMA)


class Shelf:
    """Unpacked pieces by length."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        order = np.argsort(lengths, kind="stable")
        self.counts = np.bincount(lengths, minlength=capacity + 1)
        ends = np.cumsum(self.counts)
        self.order, self.ends = order, ends
        self.sizes = np.arange(capacity + 1)

    def floors(self) -> np.ndarray:
        """For every gap the longest unpacked piece that fits (0: none)."""
        return np.maximum.accumulate(np.where(self.counts > 0, self.sizes, 0))

    def take(self, length: int) -> None:
        self.counts[length] -= 1

    def put(self, length: int) -> None:
        self.counts[length] += 1


def best_two_fit(lengths: np.ndarray, capacity: int = SEQUENCE_TOKENS) -> list[list[int]]:
    """Lengths (1 to ``capacity``) of the pieces in each sequence."""
    shelf = Shelf(lengths, capacity)
    left, bins = len(lengths), []
    while left:
        floor = shelf.floors()
        content, gap = [], capacity
        while gap and (size := int(floor[gap])):
            content.append(size)
            shelf.take(size)
            gap -= size
            left -= 1
            if not shelf.counts[size]:
                floor = shelf.floors()
        if gap and left >= 2 and len(content) > 1:
            smallest = content[-1]  # greedy filling takes the longest first
            room = gap + smallest
            one = np.flatnonzero(shelf.counts[:room // 2 + 1])
            if len(one):
                two = floor[room - one]
                # a pair of equal pieces needs two of them
                alone = (two == one) & (shelf.counts[one] < 2)
                total = np.where((two >= one) & ~alone, one + two, 0)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    content[-1:] = [int(two[best]), int(one[best])]
                    shelf.put(smallest)
                    shelf.take(int(two[best]))
                    shelf.take(int(one[best]))
                    left -= 1
        bins.append(content)
    return bins


def pack_group(frame: pd.DataFrame, capacity: int = SEQUENCE_TOKENS) -> pd.DataFrame:
    """Sequence number within the group and offset of every piece."""
    frame = frame.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
    lengths = frame["length"].to_numpy(np.int64)
    bins = best_two_fit(lengths, capacity)
    sizes = np.array([size for content in bins for size in content], np.int64)
    number = np.repeat(np.arange(len(bins)), [len(content) for content in bins])
    before = np.concatenate([size_starts(content) for content in bins])
    # the frame is sorted by length, so the pieces of one length follow each other in the order they are used
    where = np.argsort(sizes, kind="stable")
    out = frame.copy()
    out["sequence_id"] = number[where]
    out["offset"] = before[where]
    return out


def size_starts(content: list[int]) -> np.ndarray:
    sizes = np.array(content, np.int64)
    return np.cumsum(sizes) - sizes


def pack(docs: DataFrame, capacity: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES,
         vocabulary: str | None = None) -> DataFrame:
    """Every piece with its sequence and place. Groups are dealt by row number, so no document makes one large."""
    cut_up = stored(pieces(docs, capacity, vocabulary), "pieces")
    groups = max(1, -(-cut_up.count() // group_pieces))
    key = OWN + "group"

    def run(key_value: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = pack_group(frame.drop(columns=key), capacity)
        out["sequence_id"] += np.int64(key_value[0]) << 32
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = cut_up.withColumn(key, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy(key).applyInPandas(run, PACKED_SCHEMA)

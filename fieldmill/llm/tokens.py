"""Byte-pair ids of whole texts by the ``tokenizers`` library, with a memo of its answers per word.

The pre-tokenizer of the byte-level vocabulary always starts a new piece at a single space or line feed between two
characters that are no white space, and such a line feed is a piece of its own. So the ids of a text are the ids of its
words (each with the space or line feed before it), one after the other, and the library has to be asked once per
distinct word. It starts a new piece between a letter or digit and a punctuation mark as well, so a word that ends in
marks is asked without them, and the marks on their own. A text with any other white space next to a space or line feed
is given to the library as a whole, and so is a text that holds the string of a special token where the library reads
these strings as their tokens.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0

#: Characters of texts that are encoded at once: the more, the fewer words are looked up twice.
ENCODE_CHARS = 4_000_000
#: Words that the encoder of a Python worker keeps.
WORKER_WORDS = 300_000

# White space (or what some Unicode versions count as such) next to which a space or line feed may not start a piece.
_ODD = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")

# Marks that are cut off the end of a word; an apostrophe may belong to the letters after it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
_ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def by_words(text: str) -> bool:
    """Whether the ids of a text are those of its words: no white space stands next to a space or line feed."""
    return not ("  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[0] in " \n" or text[-1] in " \n"
                # what counts as printable holds none of them, and is told faster
                or not text.replace("\n", " ").isprintable() and _ODD.search(text) is not None)


def words_of(text: str) -> list[str] | None:
    """The words of a text: its parts before single spaces and single line feeds, a line feed staying with its word.

    The first word gets a line feed too. None where white space stands next to a space or line feed.
    """
    return ("\n" + text.replace("\n", " \n")).split(" ") if by_words(text) else None


class Memo(dict):
    """Words by number, in the order they are first met."""

    def __init__(self, words: Iterable[str] = ()):
        super().__init__(zip(words, count()))
        self.fresh: list[str] = []

    def add(self, words: list[str]) -> None:
        self.update(zip(words, count(len(self))))
        self.fresh += words


class ByWords:
    """What is known of words, looked up for many texts at once. Memory is bounded: of more than ``memo_words`` words the
    memo keeps those that were met again, half as many at most; the first ones are the frequent ones."""

    first_mark = "\n"  # stands before the first word, so that it does not take a space

    def __init__(self, memo_words: int):
        self.memo, self.memo_words = Memo(), memo_words
        self.again = np.zeros(0, bool)  # which words of the memo a later call met

    def _learn(self) -> None:
        """Work out the words that ``memo.fresh`` holds, in this order, and empty it."""
        raise NotImplementedError

    def _keep(self, words: np.ndarray) -> None:
        """Drop what is known of all but the words of these numbers, which are ascending."""
        raise NotImplementedError

    def shrink(self, keep: int = 150_000) -> None:
        """Keep words that were met again; at the end of a task fewer, as the worker may go on with other work."""
        if len(self.memo) > keep > 0:
            kept, words = np.flatnonzero(self.again)[:keep], list(self.memo)
            self.memo, self.again = Memo(words[n] for n in kept.tolist()), self.again[kept]
            self._keep(kept)

    def distinct(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(words, places, offsets): the distinct words of texts that are read word by word, and where they stand.

        Arrow cuts the texts and finds the distinct words; only these are looked up one by one.
        """
        lists = pc.split_pattern(pa.array([self.first_mark + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy()

    def known(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words in the memo, which learns those it does not hold."""
        if len(self.memo) > self.memo_words:
            self.shrink(self.memo_words // 2)
        asked = words.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        numbers = np.fromiter(map(self.memo.get, asked, repeat(-1)), np.int64, len(asked))
        new = np.flatnonzero(numbers < 0)
        self.again[numbers[numbers >= 0]] = True
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        numbers[new] = len(self.memo) + np.arange(len(new))
        self.memo.add([asked[k] for k in new.tolist()])
        self._learn()
        return numbers

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, offsets): the words of texts that are read word by word, by their numbers in the memo."""
        words, places, offsets = self.distinct(texts)
        return self.known(words)[places], offsets


class Encoder(ByWords):
    """Ids of many texts at once.

    Strings of special tokens inside a text become their ids, as is the library's default, unless ``special_as_text``.
    """

    def __init__(self, path: str, memo_words: int = 200_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        size = self.library.get_vocab_size()
        lengths = np.zeros(size, np.int64)
        for token, i in self.library.get_vocab().items():
            lengths[i] = len(token)  # one character stands for one byte
        super().__init__(memo_words)
        self.byte_lengths = lengths
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _keep(self, words: np.ndarray) -> None:
        self.ids, self.starts, self.lengths = picked(self.ids, self.starts[words], self.lengths[words])

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def splits(self, text: str) -> bool:
        """Whether a text is read word by word."""
        return bool(text) and by_words(text) and not any(s in text for s in self.special)

    def _learn(self):
        """Ask the library for the words that the memo met since last time, many in one text."""
        new, self.memo.fresh = self.memo.fresh, []
        for at in range(0, len(new), 20_000):
            some = [w if w[:1] == "\n" else " " + w for w in new[at:at + 20_000]]
            ids = self.plain("".join(some))
            ends = np.cumsum(pc.binary_length(pa.array(some, pa.large_string())).to_numpy())
            cuts = np.searchsorted(np.cumsum(self.byte_lengths[ids]), ends) + 1
            lengths = np.diff(cuts, prepend=0)
            self.starts = np.concatenate([self.starts, len(self.ids) + cuts - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths): the ids of distinct words, those of their last marks from the memo on their own."""
        stems, cut, marks = without_marks(words)
        # after a line feed marks are pieces of their own, so its id comes before theirs
        feed, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        parts = pa.concat_arrays([stems, pc.binary_join_element_wise(feed, marks, nothing)]).dictionary_encode()
        numbers = self.known(parts.dictionary)[parts.indices.to_numpy()]
        skip = (np.arange(len(numbers)) >= len(words)).astype(np.int64)
        order = np.argsort(np.concatenate([np.arange(len(words)), cut]), kind="stable")  # marks behind their stem
        starts, lengths = (self.starts[numbers] + skip)[order], (self.lengths[numbers] - skip)[order]
        own = self.lengths[numbers[:len(words)]]
        own[cut] += self.lengths[numbers[len(words):]] - 1
        return gather(self.ids, starts, lengths), np.cumsum(own) - own, own

    def encode(self, texts: list[str], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets): the ids of text k are ``ids[offsets[k]:offsets[k + 1]]``."""
        split = [self.splits(t) for t in texts]
        words, places, cuts = self.distinct([t for t, s in zip(texts, split) if s])
        ids, starts, lengths = self.of_words(words)
        ids = gather(ids, starts[places], lengths[places])
        ends = np.concatenate([[0], np.cumsum(lengths[places])])[cuts]
        tail = np.array([end_id] if end_id is not None else [], np.int32)
        out, sizes, at = [], np.zeros(len(texts), np.int64), 0
        for k, (text, s) in enumerate(zip(texts, split)):
            if s:  # the first id is that of the mark before the first word
                own = ids[ends[at] + 1:ends[at + 1]]
                at += 1
            else:
                own = self.plain(text)
            out += [own, tail]
            sizes[k] = len(own) + len(tail)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)])


def without_marks(words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(stems, cut, marks): words without the marks at their end, which words were cut, and the marks of these.

    Only words are cut whose marks follow an ASCII letter or digit or a letter of two bytes from À to ÿ.
    """
    stems = pc.ascii_rtrim(words, characters=MARKS)
    sizes, left = pc.binary_length(words).to_numpy(), pc.binary_length(stems).to_numpy()
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1:words.offset + 1 + len(words)]
    cut = np.flatnonzero((left < sizes) & (left > 1))
    at = ends[cut] - sizes[cut] + left[cut]  # where the marks begin
    last, before = raw[at - 1], raw[at - 2]
    cut = cut[_ALNUM[last] | ((before == 0xC3) & (last != 0x97) & (last != 0xB7))]
    lengths = sizes[cut] - left[cut]
    marks = gather(raw, ends[cut] - lengths, lengths)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    is_cut = np.zeros(len(words), bool)
    is_cut[cut] = True
    return (pc.if_else(pa.array(is_cut), stems, words), cut,
            pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(offsets), pa.py_buffer(marks.tobytes())))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[start:start + length]``, one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    shift = starts - (np.cumsum(lengths) - lengths)
    return values[np.repeat(shift, lengths) + np.arange(total)]


def picked(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs that ``gather`` takes, with their new starts and their lengths."""
    return gather(values, starts, lengths).copy(), np.cumsum(lengths) - lengths, lengths


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept between its tasks; what it learnt is bounded by ``memo_words``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, WORKER_WORDS)
    return _ENCODERS[path]


def runs(lengths, limit: int = 1_000_000):
    """Index ranges of about ``limit`` characters, at least one text each, from the lengths of texts."""
    start = size = 0
    for k, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, k
            start, size = k, 0
        size += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def batches(texts, limit: int = 1_000_000):
    """Index ranges of about ``limit`` characters, at least one text each."""
    return runs([len(text) for text in texts], limit)

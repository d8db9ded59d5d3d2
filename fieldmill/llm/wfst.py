"""SentencePiece encoding and decoding by weighted finite-state transducers.

Machines compiled from a model file: the normaliser (a mark before the text and for every space), an acceptor of the
pieces (a trie, then one state per piece that was read last) and the byte fallback (a character that no piece holds to
its byte pieces). The model merges neighbours by rank, so two pieces can stand side by side only if no merge across
their border would have come before the merges inside them; the acceptor has an arc between two pieces only then.
Composed with a text it spans a lattice of (place, last piece). A text is encoded as the model does it exactly where all
its neighbours may stand side by side, for every beginning of a text too, so at each place one state is reached, and
the least path under the tropical semiring (ranks add along a path; a byte piece is dearer than any other) is the
model's encoding. Which pieces may be neighbours is worked out when a pair is first met, from the last merges of both.

The lattice falls apart where a word begins, if no piece runs across, so every distinct word is searched once.

Decoding inverts the machines: byte pieces back to characters, marks back to spaces, the added first mark dropped. The
pieces of every text are decoded again, also where its words were looked up.

Cases: null or empty text: no pieces, weight 0. A literal mark in a text is read as a space, as the model defines it, so
such a text is not ``restored``. Repeated rows are encoded alike. Empty table: no rows. Other columns are ignored. A model
with a character map of its own, or without merge ranks, is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import texts
from .tokens import ByWords, batches, by_words, gather, picked

MARK = "▁"
#: Pairs of neighbours whose verdict a worker keeps.
MEMO_PAIRS = 500_000
SCHEMA = "doc_id long, n_pieces long, weight long, ids array<int>, restored boolean"


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def check_model(path: str) -> None:
    """Refuse a model whose normaliser or kind these machines do not compile."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # the file can't be looked into
        return
    stated = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        stated.ParseFromString(f.read())
    rules, trained = stated.normalizer_spec, stated.trainer_spec
    if (rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or trained.treat_whitespace_as_suffix
            or trained.model_type != trained.BPE or not trained.byte_fallback):
        raise ValueError("the machines are made for a merge model with byte fallback that marks words and changes no text")


class Machines:
    """The compiled machines of one model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        check_model(path)
        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        ordinary = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {names[i]: round(-model.get_score(i)) for i in ordinary if len(names[i]) > 1}
        self.ids = {names[i]: i for i in ordinary}
        #: the last merge of every piece that the merges of its own characters make
        self.halves = {name: halves for name in self.rank if (halves := self.last_merge(name))}
        #: under "" a state of the trie has the longest piece on the way to it
        self.trie: dict = {}
        for name in sorted(self.ids):  # shorter pieces before those that begin with them
            if len(name) == 1 or name in self.halves:
                node, held = self.trie, name[0]
                for c in name:
                    node = node.setdefault(c, {})
                    held = node.setdefault("", held)
                node[""] = name
        #: the longest piece that a piece begins with
        self.shorter = {name: next(name[:k] for k in range(len(name) - 1, 0, -1) if k == 1 or name[:k] in self.halves) for name in self.halves}
        #: the weight of a byte piece is beyond every other
        self.byte_weight = max(self.rank.values(), default=0) + 1
        self.most = max(map(len, self.ids))
        self.weights = {name: self.rank.get(name, 0) for name in self.ids}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.words_apart = not any("\n" in name or MARK in name.lstrip(MARK) for name in self.ids)
        self.known: dict[tuple[str, str], bool] = {}
        values = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if model.is_byte(i)
                  else names[i].replace(MARK, " ").encode("utf-8") for i in range(n)]
        self.value_lengths = np.array([len(v) for v in values], np.int64)
        self.value_starts = np.cumsum(self.value_lengths) - self.value_lengths
        self.values = np.frombuffer(b"".join(values), np.uint8)

    def last_merge(self, name: str) -> tuple[str, str] | None:
        """The two parts that a piece is merged from; None if the merges of its characters do not make it."""
        parts = list(name)
        while len(parts) > 2:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            least = min((r for r in ranks if r is not None), default=None)
            if least is None:
                return None
            k = ranks.index(least)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def neighbours(self, a: str, b: str) -> bool:
        """Whether two pieces may stand side by side: going back through the last merges next to their border, no merge
        across it comes first. Of equal ranks the left merge comes first."""
        limit = float("inf")
        while True:
            across = self.rank.get(a + b)
            if across is not None and across < limit:
                return False
            left, right = self.halves.get(a), self.halves.get(b)
            if left is not None and (right is None or self.rank[a] > self.rank[b]):
                limit, a = self.rank[a], left[1]
            elif right is not None:
                limit, b = self.rank[b] + 1, right[0]
            else:
                return True

    def normalise(self, text: str) -> str:
        """The normaliser: a mark before the text and for every space; all else stays."""
        return MARK + text.replace(" ", MARK) if text else ""

    def longest(self, normal: str, at: int) -> str:
        """The longest piece that a text goes on with; an unknown character stands for its bytes."""
        node = self.trie.get(normal[at])
        if node is None:
            return normal[at]
        for c in normal[at + 1:at + self.most]:
            onward = node.get(c)
            if onward is None:
                break
            node = onward
        return node[""]

    def shortest_path(self, normal: str) -> list[str]:
        """The pieces of the least path through the lattice of a normalised text.

        Depth first, longest piece first. One state is reached at each place, so a complete path is the only one, and a
        place that led nowhere once leads nowhere.
        """
        known, dead, out, at, n = self.known, bytearray(len(normal) + 1), [], 0, len(normal)
        if len(known) > MEMO_PAIRS:
            known.clear()
        piece = self.longest(normal, 0) if n else ""
        while at < n:
            end = at + len(piece)
            fit = not dead[end]
            if fit and out:
                pair = out[-1], piece
                fit = known.get(pair)
                if fit is None:
                    known[pair] = fit = self.neighbours(*pair)
            if fit:
                out.append(piece)
                at = end
                if at < n:
                    piece = self.longest(normal, at)
                continue
            shorter = self.shorter.get(piece)
            if shorter is None:  # no piece goes on from here
                dead[at] = 1
                piece = out.pop()
                at -= len(piece)
            else:
                piece = shorter
        return out

    def encode(self, normal: str) -> tuple[list[int], int]:
        """Ids and weight of the least path."""
        pieces = self.shortest_path(normal)
        try:
            return [self.ids[p] for p in pieces], sum([self.weights[p] for p in pieces])
        except KeyError:  # a character that no piece holds
            raw = [p.encode("utf-8") if p not in self.ids else b"" for p in pieces]
            ids = [i for p, r in zip(pieces, raw) for i in ([self.byte_ids[b] for b in r] or [self.ids[p]])]
            return ids, sum(self.weights.get(p, self.byte_weight * len(r)) for p, r in zip(pieces, raw))

    def decode(self, ids: np.ndarray) -> str:
        raw = gather(self.values, self.value_starts[ids], self.value_lengths[ids]).tobytes()
        return raw.decode("utf-8", "replace")[1:]


class Coder(ByWords):
    """Encodes many texts, each distinct word once."""

    first_mark = ""  # the normaliser's mark stands before the first word

    def __init__(self, path: str, memo_words: int = 300_000):
        super().__init__(memo_words)
        self.machines = Machines(path)
        self.ids, self.starts, self.lengths, self.weights = (np.zeros(0, np.int64) for _ in range(4))

    def _keep(self, words: np.ndarray) -> None:
        self.weights = self.weights[words]
        self.ids, self.starts, self.lengths = picked(self.ids, self.starts[words], self.lengths[words])

    def _learn(self) -> None:
        fresh, self.memo.fresh = self.memo.fresh, []
        if not fresh:
            return
        found = [self.machines.encode(w if w[:1] == "\n" else MARK + w) for w in fresh]
        lengths = np.array([len(ids) for ids, _ in found], np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids, _ in found for i in ids), np.int64)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.weights = np.concatenate([self.weights, np.array([w for _, w in found], np.int64)])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, int, bool]]:
        """(ids, weight, whether decoding restores the text) of every text."""
        split = [bool(t) and self.machines.words_apart and by_words(t) and MARK not in t for t in texts]
        numbers, cuts = self.numbered([t for t, s in zip(texts, split) if s])
        out, at = [], 0
        for text, s in zip(texts, split):
            if s:
                n = numbers[cuts[at]:cuts[at + 1]]
                at += 1
                ids, weight = gather(self.ids, self.starts[n], self.lengths[n]), int(self.weights[n].sum())
            else:
                ids, weight = self.machines.encode(self.machines.normalise(text))
                ids = np.array(ids, np.int64)
            out.append((ids, weight, self.machines.decode(ids) == text))
        return out


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder per Python worker, kept between its tasks; what it learnt is bounded."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: the pieces of its whole text, their weight, and whether decoding restores the text. No shuffle."""
    model = model or default_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(model)
        for frame in frames:
            names, whole = frame["doc_id"].astype("Int64"), frame["text"].tolist()
            for a, b in batches(whole, 1_000_000):
                found = code.encode(whole[a:b])
                yield pd.DataFrame({
                    "doc_id": names.iloc[a:b].array, "n_pieces": [len(ids) for ids, _, _ in found], "weight": [w for _, w, _ in found],
                    "ids": [ids.astype(np.int32) for ids, _, _ in found], "restored": [restored for _, _, restored in found]})

    return texts(docs, "doc_id").mapInPandas(run, SCHEMA)

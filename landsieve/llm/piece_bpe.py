"""Encoding by byte-pair merges through a table of each prefix's last token.

A sequence of tokens is what merging yields for its text exactly if every two neighbours stay apart
when their own text is merged. So each prefix of a text has one encoding, and of the tokens that end
at a position, found by an automaton, exactly one can follow the last token of the prefix before it.
One pass stores that last token for every prefix; the tokens are then read off backwards.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spm_model import SPACE, PieceVocabulary, load_vocabulary
from .store import slices, whole_text

#: Words remembered by a task before it forgets the older half.
REMEMBERED = 400_000
NEVER = float("inf")


class PrefixTable:
    """Token strings by the merges of ``scores``: of all neighbours whose joined text has a score, the best merges first, then the leftmost."""

    def __init__(self, scores: dict[str, float]):
        ranks = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: ranks[s] for piece, s in scores.items()}
        self.steps: dict[str, tuple] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            if len(self.merged(piece)[-1]) == 1:  # others are never the result of merges
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[list[str]]:
        """All states of the text while it is merged, for short texts: from characters to tokens."""
        symbols, states = list(text), [list(text)]
        while True:
            best, at = NEVER, -1
            for i in range(len(symbols) - 1):
                rank = self.rank.get(symbols[i] + symbols[i + 1], NEVER)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                return states
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            states.append(list(symbols))

    def history(self, piece: str) -> list[tuple[str, str, float]]:
        """Before each merge inside the piece and after the last: first symbol, last symbol, rank of the merge to come."""
        if piece not in self.steps:
            states = self.merged(piece)
            coming = []
            for now, then in zip(states, states[1:], strict=False):
                at = next(i for i, (a, b) in enumerate(zip(now, then, strict=False)) if a != b)
                coming.append(self.rank[then[at]])
            self.steps[piece] = tuple((s[0], s[-1], r) for s, r in zip(states, [*coming, NEVER], strict=True))
        return self.steps[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart: no merge across their border is ever due.

        The merges inside both are replayed in the order in which they come, the left one first
        among equals; a merge across the border comes before an equal one on its right.
        """
        known = self.apart.get((left, right))
        if known is None:
            ours, theirs = self.history(left), self.history(right)
            i = j = 0
            known = True
            while True:
                here, there = ours[i][2], theirs[j][2]
                across = self.rank.get(ours[i][1] + theirs[j][0], NEVER)
                if across < here and across <= there and across < NEVER:
                    known = False
                    break
                if here <= there and here < NEVER:
                    i += 1
                elif there < NEVER:
                    j += 1
                else:
                    break
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            self.apart[left, right] = known
        return known

    def encode(self, text: str) -> list[str]:
        """The tokens of a text; a character without a piece is a token of its own."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        matches: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(text):
            matches[end].append(piece)
        apart, compatible = self.apart, self.compatible
        for end in range(n):
            for piece in matches[end]:
                before = last[end + 1 - len(piece)]
                if before is None and end + 1 > len(piece):
                    continue
                if before is None or (known if (known := apart.get((before, piece))) is not None else compatible(before, piece)):
                    last[end + 1] = piece
                    break
            else:
                last[end + 1] = text[end]
        tokens, at = [], n
        while at:
            tokens.append(last[at])
            at -= len(last[at])
        return tokens[::-1]


class PieceEncoder:
    """Ids of whole texts as a sentencepiece BPE model with byte pieces gives them."""

    WORD = re.compile(f"{SPACE}+[^{SPACE}]+|{SPACE}+$")

    def __init__(self, vocabulary: PieceVocabulary):
        self.vocabulary = vocabulary
        self.table = PrefixTable(vocabulary.scores)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        ids = array("i")
        for token in self.table.encode(word):
            known = self.vocabulary.ids.get(token)
            if known is None:
                ids.extend(self.vocabulary.byte_ids[b] for b in token.encode())
            else:
                ids.append(known)
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit numbers in the machine's order.

        A word has the spaces before it in front. No piece reaches over a word's start, so words
        are encoded on their own and remembered.
        """
        if not text:
            return b""
        words = self.WORD.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.new.get, words))
        if None in found:
            if len(self.new) > REMEMBERED:
                self.old, self.new = self.new, {}
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    ids = self.new.get(word)
                    if ids is None:
                        ids = self.old.get(word)
                        if ids is None:
                            ids = self.word(word)
                        if len(word) < 64:
                            self.new[word] = ids
                    found[i] = ids
        return b"".join(found)


_LOADED: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and model, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(load_vocabulary(path))
    return _LOADED[path]


@dataclass(frozen=True)
class PieceTokens:
    """``model``: path of a sentencepiece BPE model, the same on all machines."""

    model: str

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """row_id, ids: whole texts, without begin or end ids. A null text is an empty one and has no ids."""
        path = self.model

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = piece_encoder(path)
            for part in slices(batches, 128):
                ids = [encoder.encode(text) for text in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), listed], ["row_id", "ids"])

        rows = docs.select(F.col(id_col).cast("long").alias("row_id"), whole_text(text_col).alias("text"))
        return rows.mapInArrow(encoded, "row_id long, ids array<int>")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """Adds ``decoded``, the text of ``ids``; other columns are dropped but row_id."""
        path = self.model

        def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            for part in slices(batches, 128):
                # Lists cut from one flat array: far cheaper than a Python object for each id of an Arrow list.
                ends = np.cumsum(np.diff(part.column(1).offsets.to_numpy())).tolist()
                flat = part.column(1).flatten().to_numpy().tolist()
                texts = [model.decode(flat[i:j]) if j > i else "" for i, j in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["row_id", "ids", "decoded"])

        return encoded.select("row_id", "ids").mapInArrow(decoded, "row_id long, ids array<int>, decoded string")

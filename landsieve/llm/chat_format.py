"""Chat formatting at the level of tokens: segments are encoded separately and reserved ids are spliced in.

A turn is ``<|turn|>role<|text|>text<|end|>``. In the ids the three marks are reserved ids that no
text can yield. In roles and texts, control strings are escaped, so they are harmless in the
formatted text as well; escaping is undone exactly.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Store, slices, whole_text

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates.
CONTROL = [
    TURN, TEXT, END, "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>",
    "<|end_header_id|>", "<|begin_of_text|>", "<|end_of_text|>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
]
#: Follows the first character of a control string in a text; one more for each that is there already.
MARK = "\\"
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
#: All control strings begin with one of two signs, so most of a text is passed over quickly.
_FOUND = re.compile(rf"([<\[])({re.escape(MARK)}*)({_REST})")


def escape(text: str) -> str:
    def marked(found: re.Match) -> str:
        first, marks, rest = found.groups()
        return first + marks + MARK + rest

    return _FOUND.sub(marked, text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    """Undoes ``escape`` on any text."""

    def unmarked(found: re.Match) -> str:
        first, marks, rest = found.groups()
        return first + marks[: -len(MARK)] + rest

    return _FOUND.sub(unmarked, text) if MARK in text else text


class Segments:
    """Byte-level BPE by tiktoken, with the three reserved ids behind the vocabulary."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.turn, self.text, self.end = (max(ranks.values()) + 1 + i for i in range(3))

    def assemble(self, role: str, text: str) -> tuple[list[int], int, int]:
        """(ids, where the text's ids begin, where they end)."""
        head = [self.turn, *self.encoding.encode_ordinary(escape(role)), self.text]
        body = self.encoding.encode_ordinary(escape(text))
        return [*head, *body, self.end], len(head), len(head) + len(body)

    def read(self, ids: list[int]) -> str:
        return unescape(self.encoding.decode(ids))


_LOADED: dict[tuple[str, str], Segments] = {}


def segments(path: str, pattern: str) -> Segments:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Segments(path, pattern)
    return _LOADED[path, pattern]


@dataclass(frozen=True)
class ChatFormat:
    """``ranks`` and ``pattern``: a tiktoken vocabulary. ``learn``: roles whose texts are under the loss mask.

    ``stretch``: turns whose offsets are summed together; longer conversations are summed in stretches.
    """

    ranks: str
    pattern: str
    learn: tuple[str, ...] = ("assistant",)
    stretch: int = 4096

    def format(self, turns: DataFrame) -> DataFrame:
        """conv_id, turn, role, place, start, ids, mask, formatted for every row (conv_id, turn, role, text).

        The conversation's sequence is the concatenation of ``ids`` by ``place``; ``start`` is a
        turn's offset in it, ``mask`` is 1 for ids that are learnt. Turns stay rows, so no
        conversation needs to fit into one. Null roles and texts are empty; null conversations are
        one conversation; rows of one turn number follow each other by role and text.
        """
        path, pattern, learn = self.ranks, self.pattern, set(self.learn)

        def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = segments(path, pattern)
            for part in slices(batches):
                ids, masks, shown = [], [], []
                for role, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    tokens, begin, end = tool.assemble(role, text)
                    # +1 where the learnt ids begin, -1 behind them; the prefix sum is the mask.
                    border = np.zeros(len(tokens) + 1, np.int8)
                    if role in learn:
                        border[begin] += 1
                        border[end] -= 1
                    ids.append(tokens)
                    masks.append(np.cumsum(border[:-1], dtype=np.int8))
                    shown.append(f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}")
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8())), pa.array(shown, pa.string())],
                    ["conv_id", "turn", "role", "text", "ids", "mask", "formatted"])

        rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), whole_text("role").alias("role"), whole_text("text").alias("text"))
        rows = rows.mapInArrow(assembled, "conv_id long, turn long, role string, text string, ids array<int>, mask array<byte>, formatted string")
        rows = Store(turns.sparkSession).write(rows, "turns")  # read twice, assembled once
        stretch = F.floor(F.col("turn") / self.stretch)
        inside = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("stretch", stretch)
        rows = rows.withColumn("start", F.coalesce(F.sum(F.size("ids")).over(inside), F.lit(0)).cast("long")).withColumn("place", F.coalesce(F.count("*").over(inside), F.lit(0)))
        sums = rows.groupBy("conv_id", "stretch").agg(F.sum(F.size("ids")).alias("ids"), F.count("*").alias("n"))
        before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(
            F.col("conv_id").alias("of"), F.col("stretch").alias("at"),
            F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
        rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("of")) & F.col("stretch").eqNullSafe(F.col("at")))
        return rows.select(
            "conv_id", "turn", "role", (F.col("place") + F.col("n_before")).alias("place"), (F.col("start") + F.col("ids_before")).alias("start"), "ids", "mask", "formatted")

    def read_back(self, formatted: DataFrame) -> DataFrame:
        """One row for each conversation, from its ids and masks alone but for formatted_chars.

        conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Digests run over
        a conversation's turns in their order, so a conversation is read in one task, turn by turn.
        """
        import hashlib

        path, pattern = self.ranks, self.pattern
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = segments(path, pattern)
            current, state, out = object(), None, []
            for part in slices(batches):
                for conv, ids, mask, shown in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                    if conv != current:
                        if state:
                            out.append(closed(current, state))
                        current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    begin, end = ids.index(tool.text), len(ids) - 1
                    role, text = tool.read(ids[1:begin]), tool.read(ids[begin + 1 : end])
                    learnt = tool.read([i for i, m in zip(ids, mask, strict=True) if m])
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                    state[4] += len(shown)
                if out:
                    yield told(out)
                    out = []
            if state:
                yield told([closed(current, state)])

        def closed(conv, state) -> tuple:
            return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def told(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        ordered = formatted.select("conv_id", "ids", "mask", "formatted", "place").repartition("conv_id").sortWithinPartitions("conv_id", "place")
        return ordered.select("conv_id", "ids", "mask", "formatted").mapInArrow(
            read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Alignment of two tokenizers' tokens by the byte offsets where both end, through merge-path pieces.

The ends of a text's A tokens and of its B tokens are two sorted lists. Merging them walks a path of
one step a token; diagonals across the grid of both lists, each settled by a binary search, cut the
path into pieces of equal work that need nothing of each other. A piece finds the ends that both
lists have in it, which close its groups, and emits the overlaps of whole groups. What is open at its
borders is stitched together, piece after piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store, slices, whole_text

#: Links that are expanded at a time.
CHUNK = 2_000_000
#: Texts with more code points go to the tokenizers library, whose pattern search needs no deep stack.
LONG = 1_000_000
SPACE = "▁"


class Vocabularies:
    """Both tokenizers, with the bytes, the byte lengths and the printed ids of their tokens."""

    def __init__(self, a_ranks: str, a_file: str, pattern: str, b_model: str):
        import sentencepiece
        import tiktoken

        with open(a_ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_file, self._a_long = a_file, None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.b_bytes.append(b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(SPACE, " ").encode())
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.a_length, self.b_length = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # Printed ids with what follows: a comma, or a sign behind the last id of its side of the group.
        self.printed = [b"%d%c" % (i, sign) for n, signs in ((self.n_a, b",|"), (self.n_b, b",;")) for sign in signs for i in range(n)]

    def encode_a(self, text: str) -> np.ndarray:
        if len(text) <= LONG:
            return self.a.encode_to_numpy(text, disallowed_special=())
        if self._a_long is None:
            from tokenizers import Tokenizer

            self._a_long = Tokenizer.from_file(self.a_file)
            self._a_long.encode_special_tokens = True
        return np.array(self._a_long.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Both tokenizers' ids of each text; none where the bytes of either's tokens do not make up space and text."""
        none = np.empty(0, np.uint32)
        for text, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            if text:
                raw = b" " + text.encode()
                a = self.encode_a(" " + text)
                if b"".join(map(self.b_bytes.__getitem__, ids)) == raw and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw:
                    yield a, np.array(ids, np.uint32)
                    continue
            yield none, none


_LOADED: dict[tuple, Vocabularies] = {}


def vocabularies(*names: str) -> Vocabularies:
    """Loaded once per Python worker."""
    if names not in _LOADED:
        _LOADED[names] = Vocabularies(*names)
    return _LOADED[names]


def diagonal(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[int, int]:
    """Where the merge of two sorted lists is after so many steps, equal items of ``a`` first; an equal one of ``b`` is then taken as well."""
    low, high = max(0, steps - len(b)), min(steps, len(a))
    while low < high:
        i = (low + high) // 2
        if a[i] <= b[steps - i - 1]:
            low = i + 1
        else:
            high = i
    i, j = low, steps - low
    if i and j < len(b) and a[i - 1] == b[j]:
        j += 1
    return i, j


def cuts(a: np.ndarray, b: np.ndarray, work: int) -> list[tuple[int, int]]:
    """Borders of the pieces, from (0, 0) to both ends."""
    inner = [diagonal(a, b, steps) for steps in range(work, len(a) + len(b), work)]
    return sorted({(0, 0), *inner, (len(a), len(b))}) if len(a) + len(b) else [(0, 0), (0, 0)]


def linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int, of: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, count) of all links: A and B tokens of a group, each with each. Pairs are a * n_b + b, ``of`` is a group's owner.

    Tokens are in the order of their groups. Links are expanded in bounded chunks and counted at once.
    """
    in_b = np.bincount(group_b, minlength=groups)
    first = np.cumsum(in_b) - in_b
    width = in_b[group_a]
    ends = np.cumsum(width)
    found, start = [], 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        times = width[start:stop]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        group = group_a[start:stop]
        pairs = np.repeat(a[start:stop].astype(np.int64) * n_b, times) + b[np.repeat(first[group], times) + inside]
        found.append(merged([(np.repeat(of[group], times), pairs, np.ones(len(pairs), np.int64))]))
        start = stop
    return found[0] if len(found) == 1 else merged(found)


def merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (owner, pair) summed, in order."""
    if not found:
        return (np.empty(0, np.int64),) * 3
    owner, pair, count = (np.concatenate(c) for c in zip(*found, strict=True))
    span = int(pair.max()) + 1 if len(pair) else 1
    key = owner.astype(np.int64) * span + pair  # owners are rows of one slice
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[new] // span, key[new] % span, np.add.reduceat(count[order], new) if len(new) else np.empty(0, np.int64)


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit numbers of a column of binaries, one after the other, and how many each row has."""
    parts = [np.frombuffer(x, "<u4") for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32), np.array([len(x) for x in parts], np.int64)


@dataclass
class Overlaps:
    """What a slice of pieces has: whole groups with their links, and what is open at either border."""

    tool: Vocabularies
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    def find(self, a_from: np.ndarray, b_from: np.ndarray, first: np.ndarray) -> None:
        """``first``: pieces that begin their text; the others' first group may have begun before."""
        n = len(self.n_a)
        piece_a, piece_b = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        ends = []
        for ids, length, count, start, piece in ((self.a, self.tool.a_length, self.n_a, a_from, piece_a), (self.b, self.tool.b_length, self.n_b, b_from, piece_b)):
            run = np.cumsum(length[ids])
            before = np.concatenate([[0], run])[np.cumsum(count) - count]
            ends.append(run - before[piece] + start[piece])
        span = max([1, *(int(e.max()) + 1 for e in ends if len(e))])
        key_a, key_b = (e + p * span for e, p in zip(ends, (piece_a, piece_b), strict=True))
        at = np.searchsorted(key_b, key_a)
        closing = np.zeros(len(key_a), bool)
        inside = at < len(key_b)
        closing[inside] = key_b[at[inside]] == key_a[inside]
        closes_b = np.zeros(len(key_b), bool)
        closes_b[at[closing]] = True
        # A piece's groups are numbered after the ones before it; its last one is what no end closes.
        self.group_a, self.group_b = np.cumsum(closing) - closing + piece_a, np.cumsum(closes_b) - closes_b + piece_b
        self.closed = np.bincount(piece_a[closing], minlength=n)
        self.of = np.repeat(np.arange(n), self.closed + 1)
        last = np.cumsum(self.closed + 1) - 1
        head = last - self.closed
        self.whole = np.ones(len(self.of), bool)
        self.whole[last] = False
        self.whole[head[~first]] = False
        self.head, self.tail = head, last

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep_a, keep_b = self.whole[self.group_a], self.whole[self.group_b]
        return linked(self.a[keep_a], self.b[keep_b], self.group_a[keep_a], self.group_b[keep_b], len(self.of), self.of, self.tool.n_b)

    def printed(self) -> list[bytes]:
        """The whole groups of each piece: ids with commas between, a bar between the sides, a semicolon behind each group."""
        groups, tool = len(self.of), self.tool
        in_a, in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        kept = np.empty(len(codes), bool)
        through_a, through_b = np.cumsum(in_a), np.cumsum(in_b)
        place_a = np.arange(len(self.a)) + (through_b - in_b)[self.group_a]
        place_b = np.arange(len(self.b)) + through_a[self.group_b]
        codes[place_a] = self.a + tool.n_a * (np.arange(1, len(self.a) + 1) == through_a[self.group_a])
        codes[place_b] = self.b + 2 * tool.n_a + tool.n_b * (np.arange(1, len(self.b) + 1) == through_b[self.group_b])
        kept[place_a], kept[place_b] = self.whole[self.group_a], self.whole[self.group_b]
        ends = np.cumsum(self.n_a + self.n_b)
        ends = np.cumsum(kept)[ends - 1] * (ends > 0) if len(codes) else ends
        words, out, start = list(map(tool.printed.__getitem__, codes[kept].tolist())), [], 0
        for end in ends.tolist():
            out.append(b"".join(words[start:end]))
            start = end
        return out

    def fragment(self, groups: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The tokens of one group of each piece, as bytes."""
        out = []
        for ids, group in ((self.a, self.group_a), (self.b, self.group_b)):
            low, high = np.searchsorted(group, groups), np.searchsorted(group, groups, "right")
            out.append([ids[i:j].astype("<u4").tobytes() for i, j in zip(low, high, strict=True)])
        return out[0], out[1]


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int64)))


SUMS = "n_a long, n_b long, n_groups long, n_links long"
WHOLE = f"row long, doc_id long, {SUMS}, groups_sha256 string, pairs array<long>, counts array<long>"
PARTS = f"row long, doc_id long, piece long, {SUMS}, body binary, pairs array<long>, counts array<long>, closed long, head_a binary, head_b binary, tail_a binary, tail_b binary"
PIECES = "row long, doc_id long, piece long, pieces long, a binary, b binary, a_from long, b_from long"


def names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


@dataclass(frozen=True)
class TokenAlignment:
    """A: byte-level BPE, given as tiktoken ranks with their pattern, and as the tokenizers library's file of the same
    vocabulary for texts of over a million code points. B: a sentencepiece model that puts a space before the text.

    ``work``: steps of the merge path, so tokens, of a piece. ``common``: pairs whose counts are broadcast at most.
    """

    a_ranks: str
    a_file: str
    pattern: str
    b_model: str
    work: int = 1 << 16
    common: int = 1 << 20

    def pieces(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row for each piece of each document: its ids, and the byte offsets where its first tokens begin.

        Null and empty texts, and those that a tokenizer does not give back, have one piece without tokens.
        """
        paths, work = (self.a_ranks, self.a_file, self.pattern, self.b_model), self.work

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = vocabularies(*paths)
            for part in slices(batches, 128):
                out: list[tuple] = []
                for row, doc_id, (a, b) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), tool.encode(part.column(2).to_pylist()), strict=True):
                    if len(a) + len(b) <= work:
                        out.append((row, doc_id, 0, 1, a.tobytes(), b.tobytes(), 0, 0))
                        continue
                    ends_a, ends_b = np.cumsum(tool.a_length[a]), np.cumsum(tool.b_length[b])
                    borders = cuts(ends_a, ends_b, work)
                    for k, ((i, j), (i2, j2)) in enumerate(zip(borders, borders[1:], strict=False)):
                        out.append((row, doc_id, k, len(borders) - 1, a[i:i2].tobytes(), b[j:j2].tobytes(), int(ends_a[i - 1]) if i else 0, int(ends_b[j - 1]) if j else 0))
                if out:
                    kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names(PIECES))

        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
        return rows.mapInArrow(cut, PIECES)

    def overlaps(self, pieces: DataFrame, whole: bool) -> DataFrame:
        """Groups and links of each piece; with ``whole``, of pieces that are a whole document, already hashed."""
        paths = (self.a_ranks, self.a_file, self.pattern, self.b_model)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = vocabularies(*paths)
            for part in slices(batches, 64):
                column = lambda i: part.column(i).to_numpy(zero_copy_only=False)
                (a, n_a), (b, n_b) = numbers(part.column(4)), numbers(part.column(5))
                o = Overlaps(tool, a, b, n_a, n_b)
                o.find(column(6), column(7), column(2) == 0)
                owner, pair, count = o.links()
                groups = np.bincount(o.of[o.whole], minlength=len(n_a))
                sums = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, groups, np.bincount(owner, count, len(n_a)).round())]
                each = np.bincount(owner, minlength=len(n_a))
                body = o.printed()
                if whole:
                    digests = [hashlib.sha256(x[:-1]).hexdigest() if x else "" for x in body]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sums, pa.array(digests, pa.string()), lists(pair, each), lists(count, each)], names(WHOLE))
                    continue
                # A first piece has no head; where no end closes a later one, its only group is the head, and it has no tail.
                (head_a, head_b), (tail_a, tail_b) = o.fragment(o.head), o.fragment(o.tail)
                for i, (first, closed) in enumerate(zip((column(2) == 0).tolist(), o.closed.tolist(), strict=True)):
                    if first:
                        head_a[i] = head_b[i] = b""
                    elif not closed:
                        tail_a[i] = tail_b[i] = b""
                fragments = [pa.array(x, pa.binary()) for x in (head_a, head_b, tail_a, tail_b)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *sums, pa.array(body, pa.binary()), lists(pair, each), lists(count, each), pa.array(o.closed.astype(np.int64)), *fragments], names(PARTS))

        return pieces.select(*names(PIECES)).mapInArrow(found, WHOLE if whole else PARTS)

    def stitch(self, parts: DataFrame) -> DataFrame:
        """Documents of several pieces, read piece after piece: what is open at the borders becomes groups."""
        paths = (self.a_ranks, self.a_file, self.pattern, self.b_model)

        def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = vocabularies(*paths)
            current, state = None, None
            for part in slices(batches, 8):
                for row in part.to_pylist():
                    if row["row"] != current:
                        if state:
                            yield state.told()
                        current, state = row["row"], Stitched(tool, row["row"], row["doc_id"])
                    state.add(row)
            if state:
                yield state.told()

        ordered = parts.repartition("row").sortWithinPartitions("row", "piece")
        return ordered.mapInArrow(stitched, WHOLE)

    def align(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row for each row of ``docs``: doc_id, sums, groups_sha256 and its pairs of ids with the number of links; written.

        ``row`` tells apart rows that share a doc_id; a null doc_id stays null. Pairs are a * (ids of B) + b.
        """
        store = Store(docs.sparkSession)
        pieces = store.write(self.pieces(docs, id_col, text_col), "pieces")
        single = self.overlaps(pieces.filter("pieces = 1"), True)
        # The pieces of long documents are dealt out, so that the work of one document is that of many tasks.
        parts = self.overlaps(pieces.filter("pieces > 1").repartition("row", "piece"), False)
        return store.write(single.unionByName(self.stitch(parts)), "aligned")

    def pair_counts(self, aligned: DataFrame) -> DataFrame:
        """pair, docs, best for every pair of ids: how many rows hold it linked, and whether no pair of its A id is held by more."""
        n_b = self.ids_of_b()
        pairs = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
        pairs = Store(aligned.sparkSession).write(pairs.withColumn("a", F.expr(f"pair div {n_b}")), "pairs")
        highest = pairs.groupBy("a").agg(F.max("docs").alias("highest"))  # a row for each id of A, which its vocabulary bounds
        return pairs.join(F.broadcast(highest), "a").select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best"))

    def ids_of_b(self) -> int:
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.b_model).get_piece_size()

    def frequent(self, pairs: DataFrame) -> tuple[int, list[np.ndarray]]:
        """The least count of the pairs to broadcast, and those pairs: at most ``common``, by a histogram of 8 bins a doubling."""
        bins = pairs.groupBy(F.floor(F.log2("docs") * 8).alias("bin")).agg(F.count("*").alias("n"), F.min("docs").alias("least")).collect()
        least, total = 2**62, 0
        for r in sorted(bins, key=lambda r: -r["bin"]):
            total += r["n"]
            if total > self.common:
                break
            least = r["least"]
        table = pairs.filter(F.col("docs") >= least).toArrow().sort_by("pair")
        return least, [table.column(i).to_numpy() for i in range(3)]

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of ``docs``.

        Frequent pairs, whose number is bounded, are broadcast and looked up where the documents lie; the
        rest are joined. So no frequent pair is ever a join key, and nothing unbounded is broadcast.
        """
        spark = docs.sparkSession
        store = Store(spark)
        aligned = self.align(docs, id_col, text_col)
        pairs = store.write(self.pair_counts(aligned), "counted")
        least, columns = self.frequent(pairs)
        sent = spark.sparkContext.broadcast(columns)

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, docs_of, best = sent.value
            for part in slices(batches, 1024):
                listed, counts = part.column(1), part.column(2).flatten().to_numpy()
                pair, n = listed.flatten().to_numpy(), np.diff(listed.offsets.to_numpy())
                row = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                total, top = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                np.add.at(total, row[hit], counts[hit] * docs_of[at[hit]])
                np.add.at(top, row[hit], counts[hit] * best[at[hit]])
                left = np.bincount(row[~hit], minlength=len(n))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total), pa.array(top), lists(pair[~hit], left), lists(counts[~hit], left)], ["row", "total", "top", "rare", "times"])

        scored = aligned.select("row", "pairs", "counts").mapInArrow(looked_up, "row long, total long, top long, rare array<long>, times array<long>")
        scored = store.write(scored, "scored")
        rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("link")).select("row", F.col("link.rare").alias("pair"), F.col("link.times").alias("times"))
        rare = rare.join(pairs.filter(F.col("docs") < least), "pair")
        rare = rare.select("row", (F.col("times") * F.col("docs")).alias("total"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("top"))
        sums = scored.select("row", "total", "top").unionByName(rare).groupBy("row").agg(F.sum("total").alias("count_sum"), F.sum("top").alias("n_best"))
        return aligned.drop("pairs", "counts").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Stitched:
    """A document of several pieces, while its pieces come by in order."""

    def __init__(self, tool: Vocabularies, row: int, doc_id: int | None):
        self.tool, self.row, self.doc_id = tool, row, doc_id
        self.sums = [0, 0, 0, 0]
        self.digest, self.begun = hashlib.sha256(), False
        self.open: tuple[list[bytes], list[bytes]] = ([], [])
        self.found: list[tuple] = []

    def print(self, groups: bytes) -> None:
        """Groups, the last one's semicolon included, which stands before the next group instead."""
        if groups:
            self.digest.update((b";" if self.begun else b"") + groups[:-1])
            self.begun = True

    def count(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.found.append((np.zeros(len(pairs), np.int64), pairs, counts))
        if sum(len(x[1]) for x in self.found[1:]) > max(CHUNK, len(self.found[0][1])):
            self.found = [merged(self.found)]

    def close(self) -> None:
        a, b = (np.frombuffer(b"".join(x), "<u4") for x in self.open)
        self.open = ([], [])
        none = np.zeros(1, np.int64)
        _, pairs, counts = linked(a, b, np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), 1, none, self.tool.n_b)
        self.count(pairs, counts)
        self.sums[2] += 1
        self.sums[3] += len(a) * len(b)
        self.print(b",".join(b"%d" % i for i in a.tolist()) + b"|" + b",".join(b"%d" % i for i in b.tolist()) + b";")

    def add(self, row: dict) -> None:
        for side, name in zip(self.open, ("head_a", "head_b"), strict=True):
            side.append(row[name])
        if row["piece"] and row["closed"]:
            self.close()
        self.print(row["body"])
        self.sums = [x + row[c] for x, c in zip(self.sums, ("n_a", "n_b", "n_groups", "n_links"), strict=True)]
        self.count(np.array(row["pairs"], np.int64), np.array(row["counts"], np.int64))
        for side, name in zip(self.open, ("tail_a", "tail_b"), strict=True):
            side.append(row[name])

    def told(self) -> pa.RecordBatch:
        _, pairs, counts = merged(self.found)
        n = np.array([len(pairs)])
        sums = [pa.array([x], pa.int64()) for x in (self.row, self.doc_id, *self.sums)]
        return pa.RecordBatch.from_arrays([*sums, pa.array([self.digest.hexdigest()], pa.string()), lists(pairs, n), lists(counts, n)], names(WHOLE))

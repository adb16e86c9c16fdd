"""Near-duplicates by SimHash fingerprints, searched through BK-trees of shards.

A tree over all fingerprints would have to visit most of its nodes: random fingerprints lie about
32 bits apart and leave nothing to prune. So fingerprints are first cut into shards by the bits
that two fingerprints within the radius must share, and each shard has its own BK-tree, sent to
every block of queries of that shard. That is a broadcast within the shard, through the shuffle:
a Spark broadcast of all trees would bring every fingerprint to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .store import Store, slices, whole_text

SEED = 42


def fingerprint(text: str, words: int = 4) -> int:
    """Unsigned 64-bit SimHash: majority bits of the XXH64 of all shingles, repeats included.

    A-Z are lower-cased, words are runs without ASCII blanks. A text of fewer words is one shingle;
    one without words has fingerprint zero.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    data = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(data, SEED)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    begins = [0, *ends[: len(tokens) - words]]
    hashes = [digest(data[a : b - 1], SEED) for a, b in zip(begins, ends[words - 1 :], strict=True)]
    each = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(each), 65536):
        ones += np.unpackbits(each[start : start + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(each)).tobytes(), "big")


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node, children = self.root
        while gap := (node ^ value).bit_count():
            below = children.get(gap)
            if below is None:
                children[gap] = (value, {})
                return
            node, children = below

    def within(self, value: int, radius: int) -> list[int]:
        """Values at most ``radius`` bits away; only edges that can lead there are followed."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            node, children = stack.pop()
            gap = (node ^ value).bit_count()
            if gap <= radius:
                found.append(node)
            if children:
                low, high = gap - radius, gap + radius
                stack += [child for edge, child in children.items() if low <= edge <= high]
        return found


@dataclass(frozen=True)
class SimHashDedup:
    """``radius``: bits that linked fingerprints may differ in. ``shard``: fingerprints aimed at in a shard.

    ``block``: a shard with more is dealt into blocks of about this many, and the tree of each block
    meets every other block, so no task holds more than a few blocks of a shard.
    """

    radius: int = 4
    words: int = 4
    shard: int = 256
    block: int = 4096

    def fingerprints(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marked: bool = False) -> DataFrame:
        """row_id, fp (as signed long) of every row, over whole texts. Null texts count as empty.

        ``marked`` adds ``mark``, a hash of the text.
        """
        words = self.words
        more = ["mark"] if marked else []

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                values = np.array([fingerprint(x, words) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64)), *part.columns[2:]], ["row_id", "fp", *more])

        rows = docs.select(F.col(id_col).cast("long").alias("row_id"), whole_text(text_col).alias("text"), *[F.xxhash64(whole_text(text_col)).alias(c) for c in more])
        return rows.mapInArrow(hashed, "row_id long, fp long" + ", mark long" * len(more))

    def rooted(self, store: Store, rows: DataFrame) -> DataFrame:
        """fp, first (its smallest id), root (of its component) for each fingerprint of ``rows``."""
        distinct = store.write(rows.groupBy("fp").agg(F.min("row_id").alias("first")), "distinct")
        roots = connected_components(store, self.links(store, distinct)).withColumnRenamed("node", "fp")
        return distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))

    def shard_keys(self, fingerprints: int) -> list[tuple[int, ...]]:
        """Which blocks of bits make up each key: two fingerprints within the radius share one at least.

        With ``radius + m`` blocks, at least m of them are equal; m rises with the number of
        fingerprints so that shards of random fingerprints keep their size.
        """
        same = 1
        while same < 16 and fingerprints / 2 ** (64 * same // (self.radius + same)) > self.shard:
            same += 1
        return list(combinations(range(self.radius + same), same))

    def block_masks(self, keys: list[tuple[int, ...]]) -> list[int]:
        blocks = self.radius + len(keys[0])
        edges = [64 * i // blocks for i in range(blocks + 1)]
        mask = lambda b: ((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return [signed(sum(mask(b) for b in key)) for key in keys]

    def links(self, store: Store, distinct: DataFrame) -> DataFrame:
        """(a, b) between distinct fingerprints: links that connect all within the radius, found by shard.

        Each task keeps the links that join two of its parts, so a dense shard yields fewer links
        than it has fingerprints.
        """
        masks = self.block_masks(self.shard_keys(distinct.count()))
        keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
        sharded = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.table", "key.bits")
        large = sharded.groupBy("table", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > self.block)
        large = store.write(large.select("table", "bits", F.ceil(F.col("n") / self.block).alias("blocks")), "large")
        if large.isEmpty():
            sharded = sharded.withColumn("blocks", F.lit(1).cast("long"))
        else:
            sharded = sharded.join(large, ["table", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        units = sharded.withColumn("own", own).withColumn("other", other)
        units = units.select(
            "table", "bits", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("query"),
            (F.col("own") > F.col("other")).alias("asks"), "fp")
        unit = ["table", "bits", "tree", "query"]
        radius = self.radius

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, tree, forest, found = None, BKTree(), Forest(), []
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(6)]
                for table, bits, low, high, asks, fp in zip(*columns, strict=True):
                    key, value = (table, bits, low, high), fp & 0xFFFFFFFFFFFFFFFF
                    if key != current:
                        current, tree, forest = key, BKTree(), Forest()
                    if asks or low == high:
                        found += [(fp, near) for near in tree.within(value, radius) if near != value and forest.join(near, value)]
                    if not asks:
                        tree.add(value)
                if found:
                    yield linked(found)
                    found = []

        def linked(found: list[tuple[int, int]]) -> pa.RecordBatch:
            near = np.array([b for _, b in found], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array(near)], ["a", "b"])

        ordered = units.repartition(*unit).sortWithinPartitions(*unit, "asks")
        return ordered.mapInArrow(searched, "a long, b long")

    def assign(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """row_id, fp (signed long), component_id: the smallest id reachable by links, itself included.

        Equal fingerprints are one node, so copies cost one lookup each and never form pairs.
        Empty tables give an empty result; a row repeated with its id has the same result twice.
        """
        store = Store(docs.sparkSession)
        rows = store.write(self.fingerprints(docs, id_col, text_col), "fingerprints")
        placed = self.rooted(store, rows)
        least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        placed = store.write(placed.join(least, "root").select("fp", "component_id"), "placed")
        return rows.join(placed, "fp").select("row_id", "fp", "component_id")

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row of each component stays, that of the smallest id, with all columns of ``docs``.

        Null ids come last; of rows with one id, that of the smallest fingerprint, then hash of text,
        stays. Rows are found by id and hash of text, so ids that are null or shared by
        different texts cost no component its row.
        """
        store = Store(docs.sparkSession)
        rows = store.write(self.fingerprints(docs, id_col, text_col, marked=True), "fingerprints")
        best = F.min(F.struct(F.col("first").isNull().alias("unknown"), "first", "fp")).alias("best")
        kept = self.rooted(store, rows).groupBy("root").agg(best).select("root", F.col("best.first").alias("first"), F.col("best.fp").alias("fp"))
        found = rows.join(kept, "fp").filter(F.col("row_id").eqNullSafe(F.col("first")))
        found = store.write(found.groupBy("root", "row_id").agg(F.min("mark").alias("mark")), "kept")
        marked = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(whole_text(text_col)).alias("own_mark"))
        joined = marked.join(found, F.col("own_id").eqNullSafe(F.col("row_id")) & (F.col("own_mark") == F.col("mark")))
        return joined.dropDuplicates(["root"]).select("row.*")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

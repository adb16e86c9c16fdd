"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .store import Store


def collision(width: float, distance: float) -> float:
    """Chance that one quantised Gaussian projection puts two points at ``distance`` into one cell of ``width``."""
    t = width / distance
    return erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def usable(vector: str) -> Column:
    """Not null or empty, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def normalised(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class EmbeddingDedup:
    """``miss``: chance to miss a pair just at the threshold; pairs nearer are missed less often.

    ``cell``: width of a projection's cell. ``bucket``: vectors that chance may bring into a bucket;
    the projections per table rise with the logarithm of the number of vectors to keep it, and the
    tables with them to keep ``miss``. ``block``: larger buckets are compared in blocks of this many.
    """

    threshold: float = 0.95
    miss: float = 0.001
    cell: float = 2.0
    bucket: int = 64
    block: int = 2048
    seed: int = 20

    def plan(self, vectors: int) -> tuple[int, int]:
        """(tables, projections per table)."""
        near = collision(self.cell, sqrt(2 - 2 * self.threshold))
        apart = collision(self.cell, sqrt(2))
        each = max(1, ceil(log(max(vectors, 2) / self.bucket) / -log(apart)))
        return ceil(log(self.miss) / log(1 - near**each)), each

    def classes(self, store: Store, vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
        """(members, classes): usable vectors, and one row (rep, least, n, vector) for each different one.

        ``rep`` is a number given when the classes are written, since ids may be null or shared by different vectors; ``least`` is the smallest id.
        """
        rows = vectors.select(F.col(id_col).cast("long").alias("row_id"), F.col(vector_col).alias("vector"))
        rows = store.write(rows.filter(usable("vector")), "usable")
        classes = rows.groupBy("vector").agg(F.min("row_id").alias("least"), F.count("*").alias("n"))
        return rows, store.write(classes.select(F.monotonically_increasing_id().alias("rep"), "least", "n", "vector"), "classes")

    def coded(self, classes: DataFrame, tables: int, each: int) -> DataFrame:
        """``raw`` (the vector's bytes), and for each table a hash of its quantised projections, as ``keys`` and packed as ``codes``.

        To be written before use: the hashes of a vector have to be the same in all its buckets.
        """
        seed, cell = self.seed, self.cell

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spaces: dict[int, tuple] = {}
            for batch in batches:
                listed = batch.column(2)
                widths = np.diff(listed.offsets.to_numpy())
                flat = listed.flatten().to_numpy(zero_copy_only=False)
                begins = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.int64)
                codes, raw = np.empty((len(widths), tables), np.int32), [b""] * len(widths)
                for width in np.unique(widths):
                    if width not in spaces:
                        chance = np.random.default_rng([seed, int(width)])
                        spaces[width] = (chance.standard_normal((int(width), tables * each)), chance.random(tables * each) * cell, chance.integers(1, 2**62, each, dtype=np.int64) | 1)
                    axes, shifts, mixers = spaces[width]
                    rows = np.flatnonzero(widths == width)
                    x = flat[begins[rows][:, None] + np.arange(width)]
                    cells = np.floor((normalised(x) @ axes + shifts) / cell).astype(np.int64).reshape(len(rows), tables, each)
                    with np.errstate(over="ignore"):
                        mixed = (cells * mixers).sum(axis=2)
                        mixed = (mixed ^ (mixed >> 29)) * np.int64(0x1B873593CC9E2D51 | 1)
                    codes[rows] = (mixed >> 32).astype(np.int32)
                    for i, vector in zip(rows, x, strict=True):
                        raw[i] = vector.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(raw, pa.binary()),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * tables, pa.int32()), pa.array(codes.ravel()))],
                    ["rep", "n", "raw", "codes", "keys"])

        return classes.mapInArrow(hashed, "rep long, n long, raw binary, codes binary, keys array<int>")

    def compared(self, store: Store, coded: DataFrame, kind: str) -> DataFrame:
        """Partial results of all buckets: (a, b null, links) adds links to a; (a, b, 0) joins a and b.

        A pair counts only in the first table that brings it together, so that nothing needs to be
        remembered across buckets and no pair is written out.
        """
        rows = coded.select("rep", "n", "raw", "codes", F.posexplode("keys").alias("table", "key"))
        large = coded.select(F.posexplode("keys").alias("table", "key")).groupBy("table", "key").agg(F.count("*").alias("size")).filter(F.col("size") > self.block)
        large = store.write(large.select("table", "key", F.ceil(F.col("size") / self.block).alias("blocks")), "large")
        if large.isEmpty():
            rows = rows.withColumn("blocks", F.lit(1).cast("long"))
        else:
            rows = rows.join(large, ["table", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.select(
            "table", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).alias("second"), "rep", "n", "raw", "codes")
        unit = ["table", "key", "low", "high"]
        threshold = self.threshold

        def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            current, out = None, []
            for batch in batches:
                for row in zip(*[batch.column(i).to_pylist() for i in range(9)], strict=True):
                    if row[:4] != current:
                        out += settle(held)
                        held, current = [], row[:4]
                    held.append(row)
                if len(out) > 10_000:
                    yield told(out)
                    out = []
            out += settle(held)
            yield told(out)

        def settle(held: list[tuple]) -> list[tuple]:
            if len(held) < 2:
                return []
            table, low, high = held[0][0], held[0][2], held[0][3]
            reps, n = np.array([r[5] for r in held], np.int64), np.array([r[6] for r in held], np.int64)
            second = np.array([r[4] for r in held])
            lengths = np.array([len(r[7]) for r in held])
            links, edges, forest = np.zeros(len(held), np.int64), [], Forest()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                x = normalised(np.frombuffer(b"".join(held[i][7] for i in at), kind).reshape(len(at), -1))
                codes = np.frombuffer(b"".join(held[i][8] for i in at), np.int32).reshape(len(at), -1)[:, :table]
                for start in range(0, len(at), 512):
                    i, j = np.nonzero(x[start : start + 512] @ x.T >= threshold)
                    i += start
                    right = (i < j) if low == high else (~second[at[i]] & second[at[j]])
                    i, j = i[right], j[right]
                    for first in range(0, len(i), 65536):
                        p, q = i[first : first + 65536], j[first : first + 65536]
                        fresh = ~(codes[p] == codes[q]).any(axis=1)
                        p, q = at[p[fresh]], at[q[fresh]]
                        np.add.at(links, p, n[q])
                        np.add.at(links, q, n[p])
                        edges += [(int(reps[u]), int(reps[v]), 0) for u, v in zip(p, q, strict=True) if forest.join(int(u), int(v))]
            some = np.flatnonzero(links)
            return edges + [(int(reps[u]), None, int(links[u])) for u in some]

        def told(out: list[tuple]) -> pa.RecordBatch:
            a, b, links = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], ["a", "b", "links"])

        ordered = rows.repartition(*unit).sortWithinPartitions(*unit)
        return ordered.mapInArrow(checked, "a long, b long, links long")

    def assign(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """row_id, n_links, component_id for every row of ``vectors``.

        Equal vectors are one class: they link with each other and with whatever their class links
        with, and are never expanded into pairs. Unusable vectors (see ``classes``) link with
        nothing, vectors of other lengths neither. Links found have a cosine of the threshold or more.
        Rows that share an id are vectors of their own. A component's id is its smallest, null ids aside; it is null if all are.
        """
        store = Store(vectors.sparkSession)
        members, classes = self.classes(store, vectors, id_col, vector_col)
        tables, each = self.plan(classes.count())
        coded = store.write(self.coded(classes.select("rep", "n", "vector"), tables, each), "coded")
        kind = "f4" if "float" in dict(vectors.dtypes)[vector_col] else "f8"
        found = store.write(self.compared(store, coded, kind), "found")
        links = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
        roots = connected_components(store, found.filter("b IS NOT NULL")).withColumnRenamed("node", "rep")
        rooted = store.write(classes.select("rep", "least").join(roots, "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"), "least"), "rooted")
        components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        components = rooted.select("rep", "root").join(components, "root").select("rep", "component_id")
        placed = classes.join(links, "rep", "left").join(components, "rep").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
        linked = members.join(placed, "vector").select("row_id", "n_links", "component_id")
        rest = vectors.filter(~usable(vector_col)).select(F.col(id_col).cast("long").alias("row_id"))
        return linked.unionByName(rest.select("row_id", F.lit(0).cast("long").alias("n_links"), F.col("row_id").alias("component_id")))

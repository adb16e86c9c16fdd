"""Packing of documents into token windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .differencing import pack_block
from .store import Store, slices, whole_text
from .word_tokens import word_tokens


@dataclass(frozen=True)
class Packing:
    """``window``: tokens of a sequence. ``cut``: what is left of a document after its full windows is cut into
    pieces of at most this many tokens, since finer pieces balance better. ``end_id`` follows each document.

    ``block_windows`` and ``block_pieces`` bound what one task packs at a time.
    """

    tokenizer: str
    window: int = 2048
    cut: int = 512
    end_id: int = 1
    block_windows: int = 512
    block_pieces: int = 8192

    def pieces(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
        """row_id, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens: each id lies in one piece.

        Null and empty texts have the end id alone. Without ``ids``, only their checksum leaves the task.
        """
        path, window, cut, end = self.tokenizer, self.window, self.cut, np.uint32(self.end_id).tobytes()
        schema = T.StructType([T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in ("row_id", "start", "length", "ids", "ids_crc32", "doc_tokens") if ids or n != "ids"])

        def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = word_tokens(path)
            for part in slices(batches):
                out: dict[str, list] = {n: [] for n in schema.names}
                for row_id, found in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    found = memoryview(found + end)
                    tokens = len(found) // 4
                    full = tokens // window * window
                    starts = [*range(0, full, window), *range(full, tokens, cut)]
                    cuts = [found[4 * a : 4 * b] for a, b in zip(starts, [*starts[1:], tokens], strict=True)]
                    out["row_id"] += [row_id] * len(cuts)
                    out["start"] += starts
                    out["length"] += [len(c) // 4 for c in cuts]
                    if ids:
                        out["ids"] += cuts
                    out["ids_crc32"] += map(zlib.crc32, cuts)
                    out["doc_tokens"] += [tokens] * len(cuts)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in out.items()], schema.names)

        rows = docs.select(F.col(id_col).cast("long").alias("row_id"), whole_text(text_col).alias("text"))
        return rows.mapInArrow(tokenised, schema)

    def pack(self, pieces: DataFrame) -> DataFrame:
        """Adds sequence_id and offset to the pieces: rows with a ``length`` of 1 to ``window``; other columns are carried along,
        but for columns named sequence_id and offset, which are replaced.

        The pieces are written first: tokenising is done once, and the windows do not change when a
        task is repeated. They are dealt by a hash into blocks of bounded size; every block is
        packed on its own, so hot documents, which have many pieces, spread over all blocks. So do
        repeated rows, by a number that each piece gets when it is written. Full pieces are windows
        of their own. Sequence ids are unique, not gapless.
        """
        store = Store(pieces.sparkSession)
        pieces = pieces.drop("sequence_id", "offset")
        number, dealt = "piece", "block"
        while number in pieces.columns:
            number += "_"
        while dealt in pieces.columns:
            dealt += "_"
        plain = pieces.schema.fields
        pieces = store.write(pieces.withColumn(number, F.monotonically_increasing_id()), "pieces")
        totals = pieces.filter(F.col("length") < self.window).agg(F.sum("length").alias("tokens"), F.count("*").alias("n")).first()
        blocks = max(1, -(-(totals["tokens"] or 0) // (self.window * self.block_windows)), -(-totals["n"] // self.block_pieces))
        window = self.window
        inner = T.StructType([*plain, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

        def packed(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values(["length", *order, number], ascending=False, kind="stable").drop(columns=[dealt, number]).reset_index(drop=True)
            which, _ = pack_block(block["length"].to_numpy(np.int64), window)
            block["sequence_id"] = (int(key[0]) << 32) + which
            block["offset"] = block.groupby("sequence_id")["length"].cumsum() - block["length"]
            return block

        order = [f.name for f in pieces.schema.fields if f.name in ("row_id", "start")]
        rest = pieces.filter(F.col("length") < window).withColumn(dealt, F.pmod(F.xxhash64(*[c for c, t in pieces.dtypes if t == "bigint"]), F.lit(blocks)))
        filled = rest.groupBy(dealt).applyInPandas(packed, inner)
        own = pieces.filter(F.col("length") >= window).drop(number)
        own = own.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
        return filled.unionByName(own)

"""Token totals by source, language and tokenizer version, maintained by signed deltas in idempotent batches."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import slices, whole_text

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]

_LOADED: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path, pattern] = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


@dataclass(frozen=True)
class TokenizerVersion:
    """A tiktoken vocabulary under the name that totals carry."""

    name: str
    path: str
    pattern: str


def count_tokens(docs: DataFrame, versions: list[TokenizerVersion], text_col: str = "text") -> DataFrame:
    """source, lang, tokenizer, n_tokens, n_chars: a row for each document and version, over whole texts.

    Null texts are empty and have no tokens; null sources and languages stay null and are totalled as such.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(2).to_pylist()
            for version in versions:
                encode = _encoding(version.path, version.pattern).encode_ordinary
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([version.name] * len(texts), pa.string()), pa.array([len(encode(t)) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())],
                    ["source", "lang", "tokenizer", "n_tokens", "n_chars"])

    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(counted, "source string, lang string, tokenizer string, n_tokens long, n_chars long")


#: Bits of the map that tells which ids may be revised, so 4 MB whatever their number; a fuller map only means more texts counted twice.
MAP_BITS = 1 << 25


def id_map(ids: DataFrame, id_col: str = "doc_id") -> np.ndarray:
    """A bit for the hash of each id, set in tasks and united by a grouped OR of words: bounded, and without false absences."""
    bits = ids.select(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(MAP_BITS)).alias("bit"))
    words = bits.selectExpr("shiftright(bit, 6) AS word", "shiftleft(1L, CAST(bit & 63 AS INT)) AS bits")
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(MAP_BITS // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table


def count_once(
    docs: DataFrame, versions: list[TokenizerVersion], may_change: np.ndarray, revise: Callable[[str], str], id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, source, lang, n_tokens, n_chars, new_tokens, new_chars: one row for each document, read and counted once.

    Lists have a number for each version. The new counts are those of the revised text; documents that the map (``id_map``)
    rules out have none. Texts go nowhere: whoever needs some documents' counts joins the counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(may_change)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        encodes = [_encoding(v.path, v.pattern).encode_ordinary for v in versions]
        for part in slices(batches):
            bits = part.column(3).to_numpy()
            changes = (table[bits >> 6] >> (bits & 63) & 1).tolist()
            out: list[tuple] = []
            for text, change in zip(part.column(4).to_pylist(), changes, strict=True):
                counts = [len(encode(text)) for encode in encodes]
                new = revise(text) if change else None
                changed = counts if new == text else None if new is None else [len(encode(new)) for encode in encodes]
                out.append((counts, len(text), changed, None if new is None else len(new)))
            kinds = [pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], COUNTED)

    doc_id = F.col(id_col).cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.pmod(F.xxhash64(doc_id), F.lit(MAP_BITS)).alias("bit"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(counted, "doc_id long, source string, lang string, n_tokens array<long>, n_chars long, new_tokens array<long>, new_chars long")


COUNTED = ["doc_id", "source", "lang", "n_tokens", "n_chars", "new_tokens", "new_chars"]


def by_version(counted: DataFrame, versions: list[TokenizerVersion], new: bool = False) -> DataFrame:
    """The rows of ``count_tokens`` from those of ``count_once``, before or after the revision."""
    tokens, chars = ("new_tokens", "new_chars") if new else ("n_tokens", "n_chars")
    names = F.array(*[F.lit(v.name) for v in versions])
    rows = counted.select("source", "lang", F.explode(F.arrays_zip(names.alias("tokenizer"), F.col(tokens).alias("n"))).alias("v"), F.col(chars).alias("n_chars"))
    return rows.select("source", "lang", F.col("v.tokenizer").alias("tokenizer"), F.col("v.n").alias("n_tokens"), "n_chars")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as deltas: +1 for rows that arrive, -1 for rows that go. A revision is both."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), *[(F.col(c) * sign).alias(c) for c in SUMS[1:]])


@dataclass(frozen=True)
class TokenTotals:
    """Totals in ``folder``: a sub-folder of summed deltas for each committed batch.

    Totals are sums over batches, so the order of batches does not matter and no row is ever read again.
    """

    spark: SparkSession
    folder: str

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds the deltas (KEYS and SUMS) under the batch's name, or does nothing and returns false if that name is there already.

        The summed deltas are written beside, then moved into place in one step: a batch counts
        wholly or not at all, and repeating one whose end was not seen is harmless.
        """
        jvm = self.spark._jvm
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        files = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        place = f"{self.folder}/batch={self.name(batch)}"
        if files.exists(path(place)):
            return False
        beside = f"{self.folder}/_pending-{uuid.uuid4().hex}"
        summed = deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).filter(" OR ".join(f"{c} <> 0" for c in SUMS))
        summed.write.parquet(beside)
        # The rename fails or lands inside ``place`` if another writer was first; ``totals`` then does not see it.
        moved = not files.exists(path(place)) and files.rename(path(beside), path(place))
        files.delete(path(beside), True)
        return bool(moved)

    @staticmethod
    def name(batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError("batch names are letters, digits, '-', '_' and '.'")
        return batch

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars over all committed batches; groups without documents are gone."""
        schema = ", ".join([*[f"{k} string" for k in KEYS], *[f"{c} long" for c in SUMS]])
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        batches = [str(s.getPath()) for s in files.listStatus(folder) if s.getPath().getName().startswith("batch=")] if files.exists(folder) else []
        rows = self.spark.read.schema(schema).parquet(*batches) if batches else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).filter("n_docs <> 0 OR n_tokens <> 0 OR n_chars <> 0")

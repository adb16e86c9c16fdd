"""The operators of this subpackage as queries over the driver tables, each with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import ChatFormat
from .embedding_dedup import EmbeddingDedup
from .exact_dedup import ExactDedup
from .language_id import LanguageId, page_rows
from .line_dedup import LineDedup
from .order_minhash import OrderMinHash
from .packing import Packing
from .piece_bpe import PieceTokens
from .prefix_trie import ConversationTrie, forked, numbered
from .sharding import Sharding, fill_table
from .simhash import SimHashDedup, hexadecimal
from .store import Store, whole_text
from .token_align import TokenAlignment
from .token_counts import TokenizerVersion, TokenTotals, by_version, count_once, id_map, signed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BLANKS = re.compile(r"[\x20\x09-\x0D]+")
SHARDS = tuple(f"shard-{i:03d}" for i in range(96))


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and page; documents declare ``lang`` and have their source for a host."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    operator = LanguageId()
    model = operator.fit(docs)
    none = F.lit(None).cast("string")
    documents = docs.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), none.alias("suffix"), none.alias("domain"),
        F.col("source").alias("host"))
    found = page_rows(pages).withColumn("doc_id", F.lit(None).cast("long"))
    return operator.identify(documents.unionByName(found), model)


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ExactDedup().assign(table(spark, sf_dir, "documents"))
    return rows.select(F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op2_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content ORDER BY chars DESC, doc_id)
"""


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    operator = ChatFormat(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return operator.read_back(operator.format(turns.unionByName(more)))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    operator = PieceTokens(public_tokenizers.path("piece_bpe_32k.model"))
    rows = operator.decode(operator.encode(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        F.col("row_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = EmbeddingDedup().assign(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("row_id").alias("vec_id"), "n_links", "component_id", (F.col("row_id") == F.col("component_id")).alias("kept"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines with the component that they belong to; one line of each component is kept."""
    return LineDedup().assign(table(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    operator = Packing(public_tokenizers.path("word_bpe_49k.json"))
    pieces = operator.pieces(table(spark, sf_dir, "documents"), ids=False)
    return operator.pack(pieces).select(F.col("row_id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = SimHashDedup().assign(table(spark, sf_dir, "documents"))
    return rows.select(F.col("row_id").alias("doc_id"), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents arrive, those labelled toxic go, those of low quality are
    revised (blanks in a row become one), and the first batch is delivered again, which changes nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    versions = [TokenizerVersion(n, public_tokenizers.path(f"{n}.tiktoken"), public_tokenizers.PATTERN) for n in ("byte_bpe_50k", "byte_bpe_multi_50k")]
    store = Store(spark)
    totals = TokenTotals(spark, store.path("totals"))
    marks = store.write(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")), "marks")
    revised = marks.filter("coalesce(toxic, 0) <> 1 AND quality = 0").select("doc_id")
    counted = store.write(count_once(docs, versions, id_map(revised), lambda text: BLANKS.sub(" ", text)), "counted")
    gone = counted.join(marks.filter("toxic = 1"), "doc_id", "left_semi")
    changed = counted.join(revised, "doc_id", "left_semi")
    totals.commit("arrive", signed(by_version(counted, versions), 1))
    totals.commit("remove", signed(by_version(gone, versions), -1))
    totals.commit("revise", signed(by_version(changed, versions), -1).unionByName(signed(by_version(changed, versions, new=True), 1)))
    totals.commit("arrive", signed(by_version(counted, versions), 1))
    return totals.totals()


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = Sharding(SHARDS).place(table(spark, sf_dir, "documents"))
    return placed.select("row.doc_id", "slot", "shard", "shard_name", F.length(whole_text("row.text")).cast("long").alias("n_chars"))


ORACLES["op10_sharding"] = f"""
WITH claimed AS (SELECT [{', '.join(map(str, fill_table(list(SHARDS), Sharding(SHARDS).slots)))}] AS shards),
placed AS (SELECT doc_id, text, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {Sharding(SHARDS).slots} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, shards[slot + 1] AS shard, 'shard-' || lpad(CAST(shards[slot + 1] AS VARCHAR), 3, '0') AS shard_name,
  length(coalesce(text, '')) AS n_chars
FROM placed, claimed
"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    turns, lengths = forked(store, numbered(store, table(spark, sf_dir, "conversations")))
    return ConversationTrie().build(turns, lengths, store)


@query
def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OrderMinHash().compare_edited(table(spark, sf_dir, "documents"))


@query
def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    operator = TokenAlignment(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return operator.score(table(spark, sf_dir, "documents"))

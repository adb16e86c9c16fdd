"""Exact deduplication by skew-safe combining: locally, then by salted digest groups, then over the salt winners.

Texts are equal when identical after deleting every blank character of ``BLANKS``. Of equal texts
the longest original stays, then the smallest id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store, whole_text

#: Deleted before comparing: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@dataclass(frozen=True)
class ExactDedup:
    """``salts``: groups that the rows of a hot digest are dealt to. ``hot_share``: of all rows, from which a digest is hot.

    ``digest`` maps a normalised text to its digest. Correct for any function: contents are compared
    at every stage, and digests shared by different contents are resolved by content.
    """

    salts: int = 64
    hot_share: float = 0.001
    digest: object = sha256

    def groups(self, store: Store, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """(members, groups). Members: row_id, digest, chars. Groups: digest, content, keep_id, group_size.

        ``content`` is null unless its digest has several contents. Spark combines rows of equal
        digest and content within each task before they move. Digests with more than ``hot_share``
        of the rows, at most ``1 / hot_share`` of them, get the salt of the task that they come
        from, so a salted group has one row for each of its tasks; the winners of the salts meet
        last. Other digests have one salt and are final after the second stage, so their content
        moves once and is then dropped. An empty table gives empty results.
        """
        text = whole_text(text_col)
        narrow = docs.select(F.col(id_col).alias("row_id"), text.alias("raw")).withColumn("content", normalized(F.col("raw")))
        narrow = narrow.select("row_id", self.digest(F.col("content")).alias("digest"), "content", F.length("raw").cast("long").alias("chars"))
        members = store.write(narrow.select("row_id", "digest", "chars"), "members")

        total = members.count()
        counts = members.groupBy("digest").count()
        hot = [r["digest"] for r in counts.filter(F.col("count") > max(total * self.hot_share, 2)).select("digest").collect()]
        is_hot = F.col("digest").isin(hot) if hot else F.lit(False)

        best = F.min(F.struct((-F.col("chars")).alias("shorter"), F.col("row_id")))
        salt = F.when(is_hot, F.pmod(F.spark_partition_id(), F.lit(self.salts))).otherwise(0)
        salted = narrow.withColumn("salt", salt).groupBy("digest", "salt", "content").agg(best.alias("best"), F.count("*").alias("n"))
        salted = store.write(salted.select("digest", F.when(is_hot, F.col("content")).alias("content"), "best", "n"), "salted")

        merged = salted.filter(F.col("content").isNotNull()).groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        merged = salted.filter(F.col("content").isNull()).unionByName(merged)
        merged = merged.select("digest", F.lit(None).cast("string").alias("content"), F.col("best.row_id").alias("keep_id"), F.col("n").alias("group_size"))
        shared = merged.groupBy("digest").count().filter("count > 1").select("digest")
        merged = store.write(merged, "groups")
        if not shared.isEmpty():
            shared = store.write(shared, "shared")
            several = narrow.join(shared, "digest", "left_semi").groupBy("digest", "content").agg(best.alias("best"), F.count("*").alias("n"))
            several = several.select("digest", "content", F.col("best.row_id").alias("keep_id"), F.col("n").alias("group_size"))
            merged = store.write(merged.join(shared, "digest", "left_anti").unionByName(several), "groups")
            members = narrow.join(shared, "digest", "left_semi").select("row_id", "digest", "chars", "content").unionByName(
                members.join(shared, "digest", "left_anti").withColumn("content", F.lit(None).cast("string")))
            return members, merged
        return members.withColumn("content", F.lit(None).cast("string")), merged

    def assign(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """row_id, digest, keep_id, group_size, kept for every row, dropped ones too.

        A null text is an empty one; empty and blank texts are one group. Rows repeated with one id
        all count in ``group_size`` and are all marked as kept if their id is the one that stays.
        """
        store = Store(docs.sparkSession)
        members, groups = self.groups(store, docs, id_col, text_col)
        joined = members.alias("m").join(groups.alias("g"), (F.col("m.digest") == F.col("g.digest")) & F.col("m.content").eqNullSafe(F.col("g.content")))
        return joined.select(
            F.col("m.row_id").alias("row_id"), F.col("m.digest").alias("digest"), "keep_id", "group_size",
            (F.col("m.row_id").eqNullSafe(F.col("keep_id"))).alias("kept"))

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows that stay, with all columns of ``docs``; of rows repeated with one id and content, one."""
        store = Store(docs.sparkSession)
        _, groups = self.groups(store, docs, id_col, text_col)
        rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), self.digest(normalized(whole_text(text_col))).alias("digest"))
        best = groups.select("keep_id", F.col("digest").alias("of")).distinct()
        kept = rows.join(best, F.col("digest").eqNullSafe(F.col("of")) & F.col("row_id").eqNullSafe(F.col("keep_id")), "left_semi")
        return kept.dropDuplicates(["digest", "row_id"]).select("row.*")

"""Fingerprints by Order MinHash, as SQL expressions within one row.

A text's k-mers are numbered by occurrence, so that each is an element of its own, and every element
has a 64-bit hash. A signature takes the few elements that come first under one order of the hashes,
puts them back in the order of the text, and hashes that tuple: it survives an edit only if the
chosen k-mers are still there and still in the same order. The orders are rotations of the circle of
hashes: signature j of m begins at j * 2^64 / m. So sorting the elements once serves all signatures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store, whole_text

KEY = ["none", "id", "content"]
#: Steps of binary searches over arrays, which hold fewer than 2^31 elements.
STEPS = f"array({', '.join(str(1 << k) for k in reversed(range(31)))})"


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once for each row."""
    return f"transform(array({value}), {name} -> {body})[0]"


@dataclass(frozen=True)
class OrderMinHash:
    """``width``: tokens of a k-mer. ``chosen``: elements of a signature. ``signatures``: how many.

    Tokens are words, at most ``longest`` code points at a time: what stands between blanks, cut where signs below
    U+0E00 meet others. Signs of scripts that put no blanks between words are tokens of their own.
    """

    width: int = 5
    chosen: int = 2
    signatures: int = 64
    longest: int = 24

    def tokens(self) -> str:
        alone = r"\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u2E80-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{3FFFF}"
        some = f"{{1,{self.longest}}}+"
        return f"'[!-\\\\u0DFF]{some}|[{alone}]|[^\\\\x09-\\\\x0D -\\\\u0DFF{alone}]{some}'"

    def signed(self, text: str) -> Column:
        """The signatures of a text as an array<smallint>; without tokens all are zero.

        Fewer tokens than ``width`` are one k-mer; with fewer elements than ``chosen``, those beyond the last are left out.
        """
        hashes = f"transform(regexp_extract_all({text}, {self.tokens()}, 0), t -> xxhash64(t))"
        kmer = ", ".join(f"get(h, i + {k})" for k in range(self.width))
        kmers = f"IF(size(h) = 0, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, greatest(size(h) - {self.width}, 0)), i -> xxhash64({kmer})))"
        # Equal k-mers stand together in the order of the text: the number of an occurrence is how far the first one lies back.
        back = f"aggregate({STEPS}, 0, (n, step) -> IF(get(s, i - n - step).kmer = x.kmer, n + step, n))"
        number = f"IF(get(s, i - 1).kmer = x.kmer, {back}, 0)"
        numbered = bound("sort_array(transform(k, (x, i) -> struct(x AS kmer, i AS place)))", "s", f"transform(s, (x, i) -> struct(xxhash64(x.kmer, {number}) AS hash, x.place AS place, x.kmer AS kmer))")
        single = "transform(k, (x, i) -> struct(xxhash64(x, 0) AS hash, i AS place, x AS kmer))"
        elements = f"sort_array(IF(size(array_distinct(k)) = size(k), {single}, {numbered}))"
        begins = ", ".join(f"{-(1 << 63) + j * (1 << 64) // self.signatures + (j == 0)}L" for j in range(self.signatures))
        first = "aggregate(steps, 0, (n, step) -> IF(get(e, n + step - 1).hash < begin, n + step, n))"
        if self.chosen == 2:
            taken = "IF(get(c, f).place <= get(c, f + 1).place, xxhash64(get(c, f).kmer, get(c, f + 1).kmer), xxhash64(get(c, f + 1).kmer, get(c, f).kmer))"
        else:
            taken = f"xxhash64(transform(sort_array(transform(slice(c, f + 1, {self.chosen}), x -> struct(x.place AS place, x.kmer AS kmer))), x -> x.kmer))"
        signature = f"CAST(shiftright({taken}, 48) AS SMALLINT)"
        signatures = f"IF(size(e) = 0, array_repeat(CAST(0 AS SMALLINT), {self.signatures}), transform(array({begins}), begin -> {bound(first, 'f', signature)}))"
        circle = bound(f"concat(e, slice(e, 1, {self.chosen}))", "c", bound(f"filter({STEPS}, step -> step <= size(e))", "steps", signatures))
        return F.expr(bound(hashes, "h", bound(kmers, "k", bound(elements, "e", circle))))

    @staticmethod
    def printed(signatures: str) -> Column:
        """Four lowercase hex digits a signature."""
        return F.expr(f"lower(array_join(transform({signatures}, x -> lpad(hex(CAST(x AS INT) & 65535), 4, '0')), ''))")

    def likeness(self, a: str, b: str) -> Column:
        """The share of signatures that are equal, which estimates how much of one text is in the other, in the same order."""
        return F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), same -> same)) / CAST({self.signatures} AS DOUBLE)")

    def fingerprint(self, docs: DataFrame, text_col: str = "text", to: str = "fingerprint") -> DataFrame:
        """``docs`` with its fingerprints; a null text counts as empty, equal texts have equal fingerprints."""
        text = "text"
        while text in docs.columns:
            text += "_"
        rows = docs.withColumn(text, whole_text(text_col))
        return rows.withColumn(to, self.signed(text)).withColumn(to, self.printed(to)).drop(text)

    def followed(self, store: Store, rows: DataFrame) -> DataFrame:
        """Each different (id, text) with the one that follows: by id, nulls first, then by a hash of the text; the first follows the last.

        Only ids, hashes and lengths are sorted, in ranges; a row's rank is its place in its range and the
        rows of the ranges before.
        """
        keys = rows.groupBy(*KEY).agg(F.max("n_chars").alias("n_chars"))
        order = [F.col("none").desc(), F.col("id"), F.col("content")]
        keys = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        keys = store.write(keys, "keys").withColumn("part", F.expr("shiftright(at, 33)"))
        parts = keys.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("least"))  # a row for each task that wrote
        before = parts.select(F.col("part").alias("other"), F.col("n").alias("m"))
        offsets = parts.join(F.broadcast(before), F.col("other") < F.col("part"), "left").groupBy("part", "least").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("offset"))
        total = parts.agg(F.sum("n").alias("total"))
        ranked = keys.join(F.broadcast(offsets), "part").join(F.broadcast(total)).withColumn("rank", F.col("at") - F.col("least") + F.col("offset"))
        ranked = store.write(ranked.select(*KEY, "n_chars", "rank", ((F.col("rank") + 1) % F.col("total")).alias("next")), "ranked")
        after = ranked.select(F.col("rank").alias("next"), *[F.col(c).alias(f"next_{c}") for c in KEY])
        return ranked.join(after, "next").select(*KEY, "n_chars", *[f"next_{c}" for c in KEY])

    def compare_edited(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each row of ``docs``.

        The edited text has the beginning of the next document's text in place of its own last quarter. Rows
        equal in id and text have the same next document, the one behind them all. Null texts are empty.
        """
        store = Store(docs.sparkSession)
        text = whole_text(text_col)
        rows = docs.select(
            F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))
        links = self.followed(store, rows.withColumn("n_chars", F.length("text").cast("long")))
        links = store.write(links, "links")
        # A quarter of each text at most goes to the document before it; the texts themselves move once.
        asked = links.select(*[F.col(f"next_{c}").alias(c) for c in KEY], *[F.col(c).alias(f"of_{c}") for c in KEY], F.expr("n_chars div 4").alias("asked"))
        heads = rows.join(asked, KEY).select(*[F.col(f"of_{c}").alias(c) for c in KEY], *[F.col(c).alias(f"next_{c}") for c in KEY], F.expr("substring(text, 1, CAST(asked AS INT))").alias("head"))
        heads = heads.groupBy(*KEY, *[f"next_{c}" for c in KEY]).agg(F.first("head").alias("head"))
        edited = rows.join(heads, KEY).select(
            *KEY, *[f"next_{c}" for c in KEY], F.length("text").cast("long").alias("n_chars"), "text",
            F.expr("concat(substring(text, 1, length(text) - length(text) div 4), head)").alias("edited"))
        prints = edited.select(
            *KEY, *[f"next_{c}" for c in KEY], "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), self.signed("text").alias("own"), self.signed("edited").alias("changed"))
        prints = store.write(prints, "prints")
        following = prints.groupBy(*[F.col(c).alias(f"next_{c}") for c in KEY]).agg(F.first("own").alias("following"))
        return prints.join(following, [f"next_{c}" for c in KEY]).select(
            F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", self.printed("own").alias("fingerprint"), self.printed("changed").alias("edited_fingerprint"),
            self.likeness("own", "changed").alias("near_edited"), self.likeness("own", "following").alias("near_next"))

"""Language identification by Bayesian fusion of text likelihoods, declared language, address suffix and host priors.

Evidence about a page or document: its whole text under a character n-gram model, the language that
its markup declares, the suffix of its address, and which languages its host, the host's domain and
its suffix have. Priors are smoothed down that hierarchy; the tables of declared languages,
suffixes and hosts are grouped sums of the text posteriors over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Store, slices, whole_text

WORDLIKE = np.array([chr(c).isalpha() for c in range(0x10000)] + [True])


def grams(text: str, width: int, buckets: int) -> np.ndarray:
    """Hashes of all ``width`` characters in a row of the lower-cased text; what is no letter is a blank, blanks in a row are one."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = WORDLIKE[np.minimum(codes, 0x10000)]
    codes = np.where(letters, codes, 32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(codes) < width:
        return np.empty(0, np.int64)
    mixed = np.zeros(len(codes) - width + 1, np.uint64)
    for i in range(width):
        mixed = (mixed ^ codes[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


@dataclass(frozen=True)
class SeenWeights:
    """The weights of many languages: n-grams that a language lacks all have its ``unseen``.

    For n-gram g, the languages ``lang[starts[g] : starts[g + 1]]`` have ``more`` than that.
    """

    unseen: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    more: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def summed(self, found: np.ndarray) -> np.ndarray:
        times = np.bincount(found, minlength=len(self))
        seen = np.flatnonzero(times)
        counts = self.starts[seen + 1] - self.starts[seen]
        at = np.arange(counts.sum()) + np.repeat(self.starts[seen] - np.cumsum(counts) + counts, counts)
        return len(found) * self.unseen + np.bincount(self.lang[at], self.more[at] * np.repeat(times[seen], counts), len(self.unseen))


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of hashed n-grams, one column for each language: naive Bayes with add-``alpha`` smoothing."""

    languages: tuple[str, ...]
    weights: np.ndarray | SeenWeights = field(repr=False)
    width: int = 3

    def scores(self, text: str, evidence: float) -> tuple[np.ndarray, int]:
        """Log likelihoods and the number of n-grams. N-grams overlap, so their sum is scaled as if at most ``evidence`` were independent."""
        found = grams(text, self.width, len(self.weights))
        if len(found) == 0:
            return np.zeros(len(self.languages)), 0
        total = np.zeros(len(self.languages))
        for start in range(0, len(found), 65536):
            part = found[start : start + 65536]
            total += self.weights.summed(part) if isinstance(self.weights, SeenWeights) else self.weights[part].sum(axis=0, dtype=np.float64)
        return total * (min(len(found), evidence) / len(found)), len(found)


@dataclass(frozen=True)
class LanguageId:
    """``sample``: labelled rows the text model is fitted on, an equal share for each language, whole texts.
    All labels are fitted, with up to ``share`` rows each at least. ``dense``: languages up to which each has a weight for all n-grams.

    ``strength``: pseudo-rows of the level above in each smoothed table. ``evidence``: independent
    n-grams that a text counts for at most; it keeps long texts from silencing all else.
    ``reject_below``: posterior of the best language under which a row is rejected.
    """

    sample: int = 4000
    width: int = 3
    buckets: int = 65536
    alpha: float = 0.5
    strength: float = 20.0
    evidence: float = 200.0
    reject_below: float = 0.5
    share: int = 20
    dense: int = 200

    def fit(self, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> TextModel:
        """Fits the text model on a sample bounded for each label, the same for each run: the rows with the smallest hashes of id and text.

        Labels that differ in case are one, as in ``identify``.
        """
        rows = labelled.select(F.xxhash64(F.col(id_col), text_col).alias("draw"), whole_text(text_col).alias("text"), F.lower(F.col(label_col).cast("string")).alias("lang")).filter("lang IS NOT NULL AND text <> ''")
        counts = rows.groupBy("lang").count().collect()
        languages = tuple(sorted(r["lang"] for r in counts))
        if not languages:
            return TextModel((), np.zeros((self.buckets, 0)), self.width)
        share = max(self.share, self.sample // len(languages))
        width, buckets, number = self.width, self.buckets, {x: i for i, x in enumerate(languages)}
        # Twice the share by hash on average, so that the window sorts few; the order settles which.
        chance = F.pmod("draw", F.lit(1_000_003)) / 1_000_003
        wanted = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * share + 20) / r["count"])) for r in counts], "lang string, wanted double")
        drawn = rows.join(F.broadcast(wanted), "lang").filter(chance <= F.col("wanted")).withColumn("nth", F.row_number().over(_by_language()))
        drawn = drawn.filter(F.col("nth") <= share).select("lang", "text")

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                pairs = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                both, n = np.unique(np.concatenate([number[lang] * buckets + grams(text, width, buckets) for lang, text in pairs]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both // buckets), pa.array(both % buckets), pa.array(n)], ["lang", "gram", "n"])

        sums = drawn.mapInArrow(counted, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
        lang, gram, n = (sums[c].to_numpy() for c in ("lang", "gram", "n"))
        if len(languages) <= self.dense:
            table = np.full((buckets, len(languages)), self.alpha)
            table[gram, lang] += n
            return TextModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32), width)
        order = np.lexsort((lang, gram))
        unseen = np.log(self.alpha / (self.alpha * buckets + np.bincount(lang, n, len(languages))))
        starts = np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=buckets))])
        return TextModel(languages, SeenWeights(unseen, starts, lang[order].astype(np.int32), np.log1p(n[order] / self.alpha)), width)

    def text_evidence(self, rows: DataFrame, model: TextModel) -> DataFrame:
        """``rows`` without text, with ``grams`` (how many there are), ``loglik`` and ``soft``, the text's own posterior (all zero without n-grams)."""
        size, evidence, sent = len(model.languages), self.evidence, rows.sparkSession.sparkContext.broadcast(model)
        others = [c for c in rows.columns if c != "text"]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for part in slices(batches):
                results = [known.scores(text, evidence) for text in part.column("text").to_pylist()]
                loglik, count = np.array([r[0] for r in results]).reshape(-1, size), np.array([r[1] for r in results], np.int64)
                soft = np.exp(loglik - loglik.max(axis=1, keepdims=True))
                soft *= (count > 0)[:, None] / soft.sum(axis=1, keepdims=True)
                ends = pa.array(np.arange(len(count) + 1, dtype=np.int32) * size)
                listed = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (loglik, soft)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(count), *listed], [*others, "grams", "loglik", "soft"])

        kinds = dict(rows.dtypes)
        return rows.mapInArrow(scored, ", ".join([*[f"`{c}` {kinds[c]}" for c in others], "grams long", "loglik array<double>", "soft array<double>"]))

    def identify(self, rows: DataFrame, model: TextModel) -> DataFrame:
        """Fuses the evidence on ``rows``: text, declared, suffix, domain, host (strings, null if unknown) and any further columns.

        Returns the further columns with language, posterior, text_language and kept. ``kept`` is
        false for texts without a letter, whose language is null, and for rows whose best language
        stays below ``reject_below``. What a row itself adds to a table is taken out before the
        table tells about it, so no evidence counts twice. Ties go to the first language by name.
        Without labelled rows there are no languages and nothing is kept.
        """
        store = Store(rows.sparkSession)
        size = len(model.languages)
        clues = ["declared", "suffix", "domain", "host"]
        if not size:
            none = F.lit(None).cast("string")
            return rows.drop("text", *clues).select("*", none.alias("language"), F.lit(None).cast("double").alias("posterior"), none.alias("text_language"), F.lit(False).alias("kept"))
        rows = rows.withColumns({"text": whole_text("text")} | {c: F.lower(c) for c in clues})
        scored = store.write(self.text_evidence(rows, model), "scored")

        def summed(df: DataFrame, *by: str) -> DataFrame:
            """``sums`` of ``soft``: columns of few languages, rows of many, which would be too much code as columns."""
            if size <= self.dense:
                sums = df.groupBy(*by).agg(*[F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(size)])
                return sums.select(*by, F.array(*[f"s{i}" for i in range(size)]).alias("sums"))
            sums = df.select(*by, F.posexplode("soft").alias("at", "s")).groupBy(*by, "at").agg(F.sum("s").alias("s"))
            sums = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("sums"))
            return sums.select(*by, F.col("sums.s").alias("sums"))

        def table(by: str) -> DataFrame:
            """Expected rows of each language for each value: additive, so combined within tasks before anything moves."""
            return summed(scored.filter(F.col(by).isNotNull()), by).select(F.col(by).alias(f"of_{by}"), F.col("sums").alias(f"{by}_sums"))

        total = summed(scored).first()
        total = np.array([x or 0.0 for x in (total and total["sums"]) or [0.0] * size])
        hosts = scored.select("host", "domain", "suffix").distinct()
        for by in ("suffix", "domain", "host"):
            hosts = hosts.join(table(by), F.col(by) == F.col(f"of_{by}"), "left").drop(f"of_{by}")
        hosts = hosts.withColumnsRenamed({c: f"its_{c}" for c in ("host", "domain", "suffix")})
        same = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in ("host", "domain", "suffix")]
        known = scored.join(hosts, same[0] & same[1] & same[2]).join(table("declared"), F.col("declared") == F.col("of_declared"), "left")
        return self.fused(known.drop("its_host", "its_domain", "its_suffix", "of_declared", *clues), model.languages, total)

    def fused(self, rows: DataFrame, languages: tuple[str, ...], total: np.ndarray) -> DataFrame:
        size, strength, least = len(languages), self.strength, self.reject_below
        tables = ["suffix_sums", "domain_sums", "host_sums", "declared_sums"]
        own = [c for c in rows.columns if c not in (*tables, "grams", "loglik", "soft")]
        everywhere = (total + 1) / (total + 1).sum()

        def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = np.array(languages, object)
            for part in slices(batches, max(16, min(4096, 16384 // size))):
                n = part.num_rows

                def matrix(c: str) -> np.ndarray:
                    column, out = part.column(c), np.zeros((n, size))  # noqa: B023
                    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy().reshape(-1, size)
                    return out

                soft, text = matrix("soft"), matrix("loglik")
                prior = np.broadcast_to(everywhere, (n, size))
                for level in ("suffix_sums", "domain_sums", "host_sums"):
                    others = np.maximum(matrix(level) - soft, 0)
                    prior = (others + strength * prior) / (others.sum(axis=1, keepdims=True) + strength)
                declared = matrix("declared_sums")
                others = np.maximum(declared - soft, 0)
                share = others.sum(axis=1, keepdims=True) / max(total.sum(), 1)
                # How often the language's other rows declare this; by the declaration's overall share if there are few.
                said = (others + strength * share + 1e-9) / (np.maximum(total - soft, 0) + strength)
                said[part.column("declared_sums").is_null().to_numpy(zero_copy_only=False)] = 1
                score = text + np.log(prior) + np.log(said)
                score -= score.max(axis=1, keepdims=True)
                posterior = np.exp(score)
                posterior /= posterior.sum(axis=1, keepdims=True)
                best, lettered = posterior.argmax(axis=1), part.column("grams").to_numpy() > 0
                top = posterior[np.arange(n), best]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in own], pa.array(np.where(lettered, names[best], None), pa.string()), pa.array(np.where(lettered, top, np.nan), pa.float64(), from_pandas=True),
                     pa.array(np.where(lettered, names[text.argmax(axis=1)], None), pa.string()), pa.array(lettered & (top >= least))],
                    [*own, "language", "posterior", "text_language", "kept"])

        kinds = dict(rows.dtypes)
        return rows.mapInArrow(weighed, ", ".join([*[f"`{c}` {kinds[c]}" for c in own], "language string", "posterior double", "text_language string", "kept boolean"]))

    def keep(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
        """The rows of ``docs`` that are not rejected, with all columns; their declared languages label the text model.

        Rejected rows are found by id and hash of text, and are few, so the rows that stay do not move.
        """
        store = Store(docs.sparkSession)
        model = self.fit(docs, id_col, text_col, declared_col)
        none = F.lit(None).cast("string")
        mark = F.xxhash64(whole_text(text_col))
        rows = docs.select(F.col(id_col).alias("row_id"), mark.alias("mark"), F.col(text_col).alias("text"), F.col(declared_col).alias("declared"), none.alias("suffix"), none.alias("domain"), F.col(host_col).alias("host"))
        rejected = store.write(self.identify(rows, model).filter("NOT kept").select("row_id", "mark").distinct(), "rejected")
        marked = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), mark.alias("own_mark"))
        return marked.join(rejected, F.col("own_id").eqNullSafe(F.col("row_id")) & (F.col("own_mark") == F.col("mark")), "left_anti").select("row.*")


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, suffix, domain, host of web pages (page_id, url, html).

    Text is the markup without scripts, styles, comments and tags. The domain is the last two labels
    of the host, the suffix the last; numeric addresses have neither.
    """
    html = whole_text("html")
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")
    text = F.regexp_replace(text, r"&#?\w+;", " ")
    host = F.lower(F.regexp_extract(whole_text("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    named = host.rlike(r"\.[^0-9.][^.]*$")
    unknown = F.lit(None).cast("string")
    return pages.select(
        "page_id", text.alias("text"), _given(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))).alias("declared"),
        F.when(named, F.regexp_extract(host, r"([^.]+)$", 1)).otherwise(unknown).alias("suffix"),
        F.when(named, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(unknown).alias("domain"), _given(host).alias("host"))


def _given(text: Column) -> Column:
    return F.when(text != "", text)


def _by_language():
    return Window.partitionBy("lang").orderBy("draw", "text")

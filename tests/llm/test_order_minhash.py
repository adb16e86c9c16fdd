"""Order MinHash against plain Python, and what its likeness says of edits."""

import hashlib
import random
import struct
from collections import Counter

import pytest
import regex
import xxhash
from conftest import SMALL, local
from pyspark.sql import functions as F

from landsieve.llm import queries as q
from landsieve.llm.order_minhash import OrderMinHash

ALONE = "฀-໿က-႟ក-៿⺀-鿿豈-﫿\U00020000-\U0003FFFF"


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def chain(values):
    """Spark's hash of several values: each is hashed with the one before as its seed."""
    h = 42
    for kind, v in values:
        h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<q" if kind == "l" else "<i", v), h)
    return signed(h)


def brute_print(text, width=5, chosen=2, signatures=64, longest=24):
    words = regex.findall(rf"[!-෿]{{1,{longest}}}+|[{ALONE}]|[^\x09-\x0D -෿{ALONE}]{{1,{longest}}}+", text or "")
    if not words:
        return "0000" * signatures
    hashes = [chain([("s", w)]) for w in words]
    kmers = [chain([("l", h) for h in hashes[i : i + width]]) for i in range(max(1, len(words) - width + 1))]
    seen, elements = Counter(), []
    for place, kmer in enumerate(kmers):
        elements.append((chain([("l", kmer), ("i", seen[kmer])]), place, kmer))
        seen[kmer] += 1
    elements.sort()
    out = []
    for j in range(signatures):
        begin = -(1 << 63) + j * (1 << 64) // signatures
        first = sum(e[0] < begin for e in elements)
        circle = elements + elements[:chosen]
        taken = sorted(circle[first : first + chosen], key=lambda e: e[1])
        out.append("%04x" % ((chain([("l", e[2]) for e in taken]) % (1 << 64)) >> 48))
    return "".join(out)


def same(a, b):
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def brute(rows):
    """All columns; the next row is the next different (id, text), by id and then by the hash of the text."""
    key = lambda r: (r[0] is not None, r[0] or 0, chain([("s", r[1])]))
    rows = [(i, t or "") for i, t in rows]
    order = sorted(set(rows), key=key)
    after = {r: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    out = []
    for i, text in rows:
        n, following = len(text), after[i, text][1]
        edited = text[: n - n // 4] + following[: n // 4]
        prints = [brute_print(x) for x in (text, edited, following)]
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), *prints[:2], same(prints[0], prints[1]), same(prints[0], prints[2])))
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "one two three four"), (6, "one two three four five"), (7, "one two three four five six"), (8, "x " * 300),
    (9, " ".join(f"word{i % 977}" for i in range(6000))), (10, "日本語のテキスト、漢字とかな。🙂🙃 é — “quoted” ​\x00\x07 한국어 문장"), (11, "b" * 100), (7, "other text of the same id, of a few words"),
    (7, "one two three four five six"), (None, "no id"), (None, "no id"), (None, None), (12, "a b c d e f g a b c d e f g a b c d e z a b c d e"), (10**15, "the last row of all, which the first one follows, so far as ids go"),
]


def test_prints_are_brute_force(spark):
    docs = local(spark, ODD, "doc_id long, text string")
    for operator, more in ((OrderMinHash(), {}), (OrderMinHash(2, 3, 10), dict(width=2, chosen=3, signatures=10)), (OrderMinHash(1, 1, 7, 3), dict(width=1, chosen=1, signatures=7, longest=3))):
        rows = operator.fingerprint(docs.withColumn("text_", F.lit(1))).collect()
        assert [r["fingerprint"] for r in rows] == [brute_print(r["text"], **more) for r in rows]
        assert rows[0].asDict().keys() == {"doc_id", "text", "text_", "fingerprint"}


@pytest.mark.parametrize("ids", [len(ODD), 1, 2])
def test_edited(spark, ids):
    rows = ODD[4 : 4 + ids] if ids < 5 else ODD
    docs = local(spark, rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS content", "2 AS next_id", "true AS none").repartition(5)
    got = sorted(map(tuple, OrderMinHash().compare_edited(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert OrderMinHash().compare_edited(local(spark, [], "doc_id long, text string")).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = q.op12_order_minhash(spark, SMALL)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_order_counts():
    """The same words in another order are far, though their sets of k-mers are near; a small edit is near."""
    random.seed(4)
    blocks = [[f"w{random.randrange(10**6)}" for _ in range(12)] for _ in range(40)]
    text = " ".join(w for b in blocks for w in b)
    moved = " ".join(w for b in reversed(blocks) for w in b)
    edited = text.replace(blocks[3][4], "edit")
    a, b, c = (brute_print(x) for x in (text, moved, edited))
    assert same(a, c) > 0.85 and same(a, b) < 0.35


def test_python_only_in_tests(spark):
    plan = OrderMinHash().compare_edited(local(spark, ODD, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))

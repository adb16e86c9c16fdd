"""The trie of conversation prefixes against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from conftest import SMALL, local
from pyspark.sql import functions as F

from landsieve.llm import queries as q
from landsieve.llm.prefix_trie import ConversationTrie, compact, fat_number, forked, numbered
from landsieve.llm.store import Store

TURNS = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """All nodes by whole prefixes as keys."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    below, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = leaves[key] or 1
        saved[key] += (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
        if key:
            below[key[:-1]] += 1
            leaves[key[:-1]] += leaves[key]
            saved[key[:-1]] += saved[key]
    return sorted((
        m[0], len(key), members[key[:-1]][0] if key else None, len(m), below[key], leaves[key], saved[key], hashlib.sha256(",".join(map(str, ends.get(key, []))).encode()).hexdigest(),
    ) for key, m in members.items())


def plain(df):
    return sorted(map(tuple, df.collect()))


def trie(spark, df, operator):
    store = Store(spark)
    return operator.build(*forked(store, numbered(store, df)), store)


def made(seed, convs=60, depth=9):
    chance = random.Random(seed)
    rows = []
    for c in [*range(convs), *range(200, 200 + convs, 2), 405]:
        for turn in range(chance.randrange(depth)):
            rows.append((c, turn, chance.choice(["user", "assistant"]), chance.choice("ab") * chance.randrange(1, 3)))
    rows += [(700, t, "user", "same") for t in range(50)] + [(c, t, "user", "same") for c in range(701, 716) for t in range(3 * (c - 700))]
    rows += [(8, None, "user", "first"), (8, None, "user", "first"), (9, 3, None, None), (9, 3, "", "x"), (None, 1, "user", "nobody"), (None, None, None, None), (10**12 + 1, 0, "user", "far " * 5000)]
    rows += [(900, 0, "user", "one"), (950, 0, "user", "two")]
    return rows


@pytest.mark.parametrize("operator", [ConversationTrie(), ConversationTrie(slab=4, entering=2, first=3), ConversationTrie(slab=2, entering=1, first=2), ConversationTrie(slab=64, entering=3, first=4)])
def test_trie(spark, operator):
    rows = made(operator.slab)
    df = local(spark, rows, TURNS).selectExpr("*", "1 AS depth", "'x' AS digest", "2 AS at", "3 AS place").repartition(4)
    assert plain(trie(spark, df, operator)) == brute(rows)


def test_conversations_without_turns_and_empty_tables(spark):
    # Conversation 101 keeps none of its own, and conversation 100 does not exist.
    c = next(i for i in range(101, 200) if zlib.crc32(str(i).encode()) % 6 > 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert plain(trie(spark, local(spark, rows, TURNS), ConversationTrie())) == brute(rows)
    assert len(brute(rows)) == 1
    assert trie(spark, local(spark, [], TURNS), ConversationTrie()).count() == 0
    assert trie(spark, local(spark, [(None, 0, "user", "a")], TURNS), ConversationTrie()).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = q.op11_prefix_trie(spark, SMALL)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert plain(got) == brute(rows)


def test_places(spark):
    """Positions in conversations that many ranges cut."""
    rows = [(c, t, "user", f"{t}") for c in (1, 2) for t in range(500)] + [(3, 0, "user", "x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(Store(spark), local(spark, rows, TURNS).repartition(5)).orderBy("conv_id", "place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r["conv_id"], r["place"], r["digest"]) for r in got] == [(c, t, digest("user", x)) for c, t, _, x in sorted(rows)]


def test_fattest(spark):
    from landsieve.llm.prefix_trie import fattest

    for low in range(40):
        for high in range(low + 1, 41):
            f = fat_number(low, high)
            assert low < f <= high and all((f & -f) >= (k & -k) for k in range(low + 1, high + 1))
    got = spark.range(40).selectExpr("id AS low", "explode(sequence(id + 1, 41L)) AS high").select("low", "high", F.expr(fattest("low", "high")).alias("f")).collect()
    assert all(r["f"] == fat_number(r["low"], r["high"]) for r in got)


def test_compact():
    random.seed(5)
    for _ in range(200):
        words = list({"a" + "".join(random.choice("ab") for _ in range(random.randrange(7))) for _ in range(random.randrange(1, 12))})
        paths = [([hash(w[:d]) for d in range(len(w) + 1)], [0] * (len(w) + 1)) for w in words]
        got = {(words[i][:d], up) for d, up, i in compact(paths, 0, 0)}
        explicit = set(words) | {w[:d] for w in words for d in range(1, len(w)) if len({v[d] for v in words if v[:d] == w[:d] and len(v) > d}) > 1}
        assert got == {(e, max((len(u) for u in explicit if u != e and e.startswith(u)), default=0)) for e in explicit}

"""Alignment of two tokenizers against plain Python over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL, local

from landsieve.llm import queries as q
from landsieve.llm.token_align import TokenAlignment, cuts, diagonal, vocabularies

PATHS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def brute(rows):
    """(doc_id, ...) for all rows, by the two libraries' own files and nested loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tool, b_tool = Tokenizer.from_file(PATHS[1]), sentencepiece.SentencePieceProcessor(model_file=PATHS[3])
    a_tool.encode_special_tokens = True
    tool = vocabularies(*PATHS)
    held, docs = Counter(), []
    for doc_id, text in rows:
        text = text or ""
        a = a_tool.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tool.encode(text) if text else []
        sides = []
        for ids, table in ((a, tool.a_bytes), (b, tool.b_bytes)):
            ends, at = [], 0
            for i in ids:
                ends.append(at := at + len(table[i]))
            sides.append(ends)
        if any(b"".join(table[i] for i in ids) != (" " + text).encode() for ids, table in ((a, tool.a_bytes), (b, tool.b_bytes))):
            a, b, sides = [], [], [[], []]
        groups, i, j = [], 0, 0
        for end in sorted(set(sides[0]) & set(sides[1])):
            i2, j2 = sides[0].index(end, i) + 1, sides[1].index(end, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        held.update(set(links))
        printed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(printed.encode()).hexdigest() if a else ""))
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, digest in docs:
        best = sum(n for (x, y), n in links.items() if held[x, y] == highest[x])
        out.append((doc_id, n_a, n_b, n_groups, sum(links.values()), best, sum(n * held[p] for p, n in links.items()), digest))
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (5, "  two  spaces \n\n and lines\t"), (6, "das ▁ Zeichen selbst"), (7, "<|endoftext|></s><s> <0x41> <unk>"),
    (8, "日本語のテキスト、漢字とかな。🙂🙃 é  ​\x00\x07"), (9, "a" * 3000 + "b" * 777), (None, "no id"), (None, "no id"), (10, " ".join(f"wörd{i % 97}" for i in range(4000))),
    (11, "".join(chr(c) for c in range(1, 0x3000, 7) if not 0xD800 <= c < 0xE000)), (12, "0x" + "deadbeef" * 400),
]


@pytest.mark.parametrize("more", [{}, {"work": 50}, {"work": 3, "common": 40}, {"common": 0}])
def test_odd_texts(spark, more):
    docs = local(spark, ODD, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS pairs", "2 AS n_a").repartition(3)
    got = TokenAlignment(*PATHS, **more).score(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(ODD)


def test_empty_table(spark):
    assert TokenAlignment(*PATHS).score(local(spark, [], "doc_id long, text string")).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = q.op13_token_align(spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_diagonals_are_the_merge():
    random.seed(1)
    for _ in range(300):
        a, b = (np.array(sorted(random.sample(range(60), random.randrange(40)))) for _ in range(2))
        path = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        for steps in range(len(path) + 1):
            i, j = diagonal(a, b, steps)
            taken = path[:steps]
            n_a = sum(1 for _, side in taken if side == 0)
            assert i == n_a and j - (steps - n_a) == int(bool(steps < len(path) and taken and path[steps] == (taken[-1][0], 1) and taken[-1][1] == 0))
        borders = cuts(a, b, 5)
        assert borders[0] == (0, 0) and borders[-1] == (len(a), len(b)) and all(x[0] <= y[0] and x[1] <= y[1] for x, y in zip(borders, borders[1:]))
        assert max((y[0] - x[0] + y[1] - x[1] for x, y in zip(borders, borders[1:])), default=0) <= 6


def test_long_texts_have_the_same_ids():
    tool = vocabularies(*PATHS)
    text = " ".join(t or "" for _, t in ODD[:13]) * 3
    want = tool.encode_a(text).tolist()
    import landsieve.llm.token_align as module

    module.LONG, kept = 10, module.LONG
    try:
        assert tool.encode_a(text).tolist() == want
    finally:
        module.LONG = kept

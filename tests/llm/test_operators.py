"""Each operator against brute force or an exact round trip, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import json
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from conftest import SMALL, local
from pyspark.sql import functions as F

from landsieve.llm import queries as q
from landsieve.llm.chat_format import CONTROL, ChatFormat, escape, unescape
from landsieve.llm.components import connected_components
from landsieve.llm.differencing import pack_block
from landsieve.llm.embedding_dedup import EmbeddingDedup
from landsieve.llm.exact_dedup import ExactDedup
from landsieve.llm.language_id import LanguageId, page_rows
from landsieve.llm.line_dedup import LineDedup
from landsieve.llm.packing import Packing
from landsieve.llm.piece_bpe import PieceTokens, PrefixTable, piece_encoder
from landsieve.llm.sharding import Sharding, fill_table
from landsieve.llm.simhash import BKTree, SimHashDedup, fingerprint
from landsieve.llm.store import Store
from landsieve.llm.token_counts import TokenizerVersion, TokenTotals, by_version, count_once, count_tokens, id_map, signed
from landsieve.llm.word_tokens import word_tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(20000))
ODD = [
    (1, "a b  c", "en", "s", 6), (2, "abc", "en", None, 3), (3, " a\tb\nc ", None, "s", 7), (4, None, None, None, None), (5, "", "en", "s", 0), (6, " \n", "en", "s", 2),
    (7, LONG, "en", "s", len(LONG)), (8, LONG + " ", "en", "s", len(LONG) + 1), (9, "abc", "en", "s", 3), (9, "abc", "en", "s", 3), (10, "é é", "fr", "s", 3), (11, "ééé", "fr", "s", 3),
]
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    return local(spark, ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return local(spark, [], DOCS)


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def compare_sql(spark, name, *tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = db.execute(q.ORACLES[name]).fetchdf()
    got = q.QUERIES[name](spark, SMALL).toPandas()
    by = sorted(want.columns)
    assert sorted(got.columns) == by
    order = lambda x: sorted(x[by].astype(str).itertuples(index=False, name=None))
    assert order(got) == order(want)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(spark, name):
    compare_sql(spark, name, "documents")


def test_components(spark):
    random.seed(3)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(1000 - i, 999 - i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in connected_components(Store(spark), local(spark, links, "a long, b long")).collect()}
    want = union_find({n for e in links if e[0] != e[1] for n in e}, links)
    assert got == want
    assert connected_components(Store(spark), local(spark, [], "a long, b long")).count() == 0


# --- exact dedup ---------------------------------------------------------------------------------

def brute_exact(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[(row[1] or "").translate({c: None for c in (32, *range(9, 14))})].append(row)
    best = {k: min(g, key=lambda r: (-len(r[1] or ""), r[0]))[0] for k, g in groups.items()}
    return sorted((r[0], best[k], len(g), r[0] == best[k], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for r in g)


@pytest.mark.parametrize("operator", [
    ExactDedup(), ExactDedup(hot_share=0.0, salts=3),
    ExactDedup(digest=lambda t: F.substring(F.sha2(F.encode(t, "UTF-8"), 256), 1, 1)),  # digests shared by different texts
    ExactDedup(digest=lambda t: F.lit("same"), hot_share=0.0)])
def test_exact(spark, odd, operator):
    rows = operator.assign(odd.repartition(5)).collect()
    want = brute_exact(ODD)
    assert sorted((r["row_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows) == [w[:4] for w in want]
    kept = operator.deduplicate(odd.withColumn("digest", F.lit("x")).withColumn("row_id", F.lit(0)))
    assert kept.columns == [*odd.columns, "digest", "row_id"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[1] for w in want})


def test_exact_empty(empty):
    assert ExactDedup().assign(empty).count() == 0
    assert ExactDedup().deduplicate(empty).count() == 0


# --- simhash -------------------------------------------------------------------------------------

def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    for text in ("", " \n", "One", "a B c", "a b c d", "A b C d e f g", "x " * 50, "É é\x1cz a b c d e"):
        assert fingerprint(text) == brute_fingerprint(text)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % 2**64 == fingerprint("a b c d")


def test_bk_tree():
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(20)]
    values = list({b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(7))) for b in base for _ in range(20)})
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values[:60]:
        assert sorted(tree.within(v, 4)) == sorted(x for x in values if (x ^ v).bit_count() <= 4)


@pytest.mark.parametrize("operator", [SimHashDedup(), SimHashDedup(block=8), SimHashDedup(shard=0.0001)])
def test_simhash_links(spark, operator):
    random.seed(7)
    base = [random.getrandbits(64) for _ in range(12)]
    values = list({b ^ sum(1 << x for x in random.sample(range(64), random.randrange(6))) for b in base for _ in range(25)})
    signed_values = [v - 2**64 if v >> 63 else v for v in values]
    links = operator.links(Store(spark), local(spark, [(v,) for v in signed_values], "fp long")).collect()
    for r in links:
        assert ((r["a"] ^ r["b"]) % 2**64).bit_count() <= 4
    want = [(a, b) for i, a in enumerate(signed_values) for b in signed_values[:i] if ((a ^ b) % 2**64).bit_count() <= 4]
    assert union_find(signed_values, [(r["a"], r["b"]) for r in links]) == union_find(signed_values, want)


def test_simhash(spark, odd, empty):
    rows = SimHashDedup().assign(odd).collect()
    prints = defaultdict(list)
    for r in ODD:
        prints[brute_fingerprint(r[1] or "")].append(r[0])
    roots = union_find(prints, [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 4])
    least = defaultdict(list)
    for fp, ids in prints.items():
        least[roots[fp]] += ids
    want = sorted((i, fp, min(least[roots[fp]])) for fp, ids in prints.items() for i in ids)
    assert sorted((r["row_id"], r["fp"] % 2**64, r["component_id"]) for r in rows) == want
    kept = SimHashDedup().deduplicate(odd.withColumn("fp", F.lit(1)))
    assert kept.columns == [*odd.columns, "fp"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})
    assert SimHashDedup().assign(empty).count() == SimHashDedup().deduplicate(empty).count() == 0


def test_simhash_keeps_a_row_of_each_component(spark):
    """Whatever the ids: null ones, and one shared by different texts, by which other components must not lose their row."""
    random.seed(17)
    text = [" ".join(random.choice("abcdefghijklmnop") * 5 for _ in range(40)) for _ in range(6)]
    prints = [brute_fingerprint(x) for x in text]
    assert min((a ^ b).bit_count() for i, a in enumerate(prints) for b in prints[:i]) > 4
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (5, text[2]), (7, text[3]), (7, text[4]), (7, text[4]), (3, text[4]), (7, text[5]), (9, text[5]), (None, None)]
    kept = SimHashDedup().deduplicate(local(spark, rows, "doc_id long, text string").repartition(4)).collect()
    want = {(None, text[0]), (None, text[1]), (5, text[2]), (7, text[3]), (3, text[4]), (7, text[5]), (None, None)}
    assert len(kept) == len(want) and set(map(tuple, kept)) == want


# --- embeddings ----------------------------------------------------------------------------------

@pytest.mark.parametrize("operator", [EmbeddingDedup(), EmbeddingDedup(block=16)])
def test_embeddings(spark, operator):
    chance = np.random.default_rng(1)
    centres = chance.standard_normal((12, 24))
    near = [c + chance.standard_normal(24) * s for c in centres for s in (0, 0, 0.1, 0.15, 0.2, 0.25, 0.3)]
    vectors = [list(map(float, np.float32(x))) for x in [*near, *(2 * centres), *chance.standard_normal((150, 24))]]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [None] + [1.0] * 23), (904, [float("nan")] + [1.0] * 23), (905, [float("inf")] + [1.0] * 23), (906, vectors[0][:10]), (907, vectors[0])]
    good = {i: np.array(v) for i, v in [*rows[: len(vectors)], rows[-1]]}
    links = set()
    for i, a in good.items():
        for j, b in good.items():
            if i < j and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                links.add((i, j))
    root = union_find([r[0] for r in rows], links)
    count = defaultdict(int)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    got = {r["row_id"]: (r["n_links"], r["component_id"]) for r in operator.assign(local(spark, rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {r[0]: (count[r[0]], root[r[0]]) for r in rows}
    assert operator.assign(local(spark, [], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_with_null_and_shared_ids(spark):
    """Rows that share an id, or have none, are vectors of their own; no component is joined by an id."""
    rows = [
        (7, [0.0, 1.0, 0.0, 0.0]), (7, [1.0, 0.02, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (8, [0.0, 1.0, 0.01, 0.0]), (9, [0.01, 1.0, 0.0, 0.0]), (7, [0.0, 0.0, 0.0, 1.0]),
        (None, [0.0, 0.0, 1.0, 0.0]), (20, [0.0, 0.02, 1.0, 0.0]), (None, [1.0, 0.0, 0.02, 0.0]), (None, [0.0, 1.0, 1.0, 1.0]), (None, [0.0, 1.0, 1.0, 1.0]), (None, None),
    ]
    x = [np.array(v) if v else None for _, v in rows]
    near = lambda a, b: a is not None and b is not None and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    links = [(i, j) for i in range(len(rows)) for j in range(i) if near(x[i], x[j])]
    root = union_find(range(len(rows)), links)
    want = []
    for i, (row_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in root if root[j] == root[i] and rows[j][0] is not None]
        want.append((row_id, sum(i in e for e in links), min(ids, default=None)))
    got = EmbeddingDedup().assign(local(spark, rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_embedding_recall(spark):
    rows = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    got = q.op5_embedding_near_dedup(spark, SMALL).toPandas().set_index("vec_id")["n_links"].reindex(rows["vec_id"]).to_numpy()
    assert (got <= want).all()
    assert got.sum() >= 0.99 * want.sum()


# --- tokens --------------------------------------------------------------------------------------

def test_prefix_table_is_merging():
    random.seed(2)
    for trial in range(30):
        scores, rank = {c: -1000.0 for c in "abc"}, 0
        pool = list("abc")
        while len(pool) < 25:
            piece = random.choice(pool) + random.choice(pool)
            if piece not in scores and len(piece) < 9:
                scores[piece] = -float(rank := rank + 1) if trial % 2 else -random.random()
                pool.append(piece)
        table = PrefixTable(scores)
        for _ in range(150):
            text = "".join(random.choice("abcd") for _ in range(random.randrange(30)))
            assert table.encode(text) == table.merged(text)[-1]


def test_pieces_are_the_library_s(spark, odd, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder = piece_encoder(PIECES)
    random.seed(4)
    signs = list("abcdeinorst  \n\t<>0x▁éü—漢🙂́\x00　\xa0[]s")
    pieces = [model.id_to_piece(i) for i in range(259, 32000)]
    texts = ["", " ", "a" * 3000, " " * 700, "</s><s>[INST]<0x41><unk>", LONG]
    texts += ["".join(random.choice(signs) if random.random() < 0.5 else random.choice(pieces) for _ in range(random.randrange(15))) for _ in range(4000)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == model.encode(text)
    operator = PieceTokens(PIECES)
    got = {r["row_id"]: (r["ids"], r["decoded"]) for r in operator.decode(operator.encode(odd)).collect()}
    assert got == {r[0]: (model.encode(r[1] or ""), model.decode(model.encode(r[1] or ""))) for r in ODD}
    assert operator.decode(operator.encode(empty)).count() == 0


def test_word_tokens_are_the_library_s():
    from tokenizers import Tokenizer

    plain, encoder = Tokenizer.from_file(WORDS), word_tokens(WORDS)
    random.seed(6)
    signs = list("abcdeinorst  \n\t.,'!.,AÉİΣß́\x00\x1c\x85　\xa0/漢🙂9ǅक़") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "."]
    texts = ["", LONG] + ["".join(random.choice(signs) for _ in range(random.randrange(15))) for _ in range(6000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_word_tokens_by_rank():
    """Each token, spelt out, is merged to itself by the listed pairs, so ranks take no other way."""
    model = json.load(open(WORDS, encoding="utf-8"))["model"]
    ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
    for token in map("".join, ranks):
        parts = [*token.removesuffix("</w>")]
        if token.endswith("</w>"):
            parts[-1] += "</w>"
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), 10**9))
            assert (parts[best], parts[best + 1]) in ranks
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [token]


def test_word_tokens_of_printable_signs_and_long_runs():
    from tokenizers import Tokenizer

    plain, encoder = Tokenizer.from_file(WORDS), word_tokens(WORDS)
    random.seed(26)
    signs = [*map(chr, range(32, 127)), "'", "'", *"'stdrevml0123  \n", " the ", "é", "naïve", "漢字", "'s", "'ll", "'VE", "'r", "n't", "x" * 700, "word" * 40]
    texts = ["", "漢" * 3000, "a" * 5000, "'", "''s", "5's", "<|endoftext |>"]
    texts += ["".join(random.choices(signs, k=random.randrange(25))) for _ in range(6000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert all(len(word) <= 64 for word in encoder.new)


def test_packing_keeps_columns_of_clashing_names(spark):
    pieces = local(spark, [(1, 0, 5, "b", 9, 7)], "row_id long, start long, length long, block string, offset long, sequence_id long")
    row = Packing(WORDS).pack(pieces).collect()[0]
    assert (row["block"], row["offset"], row["sequence_id"], row["length"]) == ("b", 0, 0, 5)


def test_word_tokens_of_decomposed_capitals():
    """T, J, H, W and Y do not compose with signs that their small letters compose with."""
    from tokenizers import Tokenizer

    plain, encoder = Tokenizer.from_file(WORDS), word_tokens(WORDS)
    random.seed(16)
    marks = ["\u0308", "\u030a", "\u030c", "\u0331", "\u0323", "\u0344", "\u0338", "\u05b0", "\u1dc5"]
    texts = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZtjhwy" for b in marks]
    texts += ["".join(random.choice([*"TJHWYtjhwyaE .,é", *marks]) for _ in range(random.randrange(15))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, window=2048):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    of, into = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        into[r["sequence_id"]].append(r)
    for pieces in into.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
    assert set(of) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(of[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return sum(r["length"] for r in rows) / (window * len(into))


def test_packing(spark, odd, empty):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    assert check_packing(q.op7_packing(spark, SMALL).collect(), dict(zip(docs["doc_id"], docs["text"], strict=True))) > 0.97
    operator = Packing(WORDS, block_pieces=4)
    unique = odd.dropDuplicates(["doc_id"])
    packed = operator.pack(operator.pieces(unique)).withColumnRenamed("row_id", "doc_id")
    check_packing(packed.collect(), {r[0]: r[1] for r in ODD})
    assert operator.pack(operator.pieces(empty)).count() == 0


def test_packing_spreads_repeated_rows(spark):
    operator = Packing(WORDS, block_pieces=100)
    pieces = operator.pieces(local(spark, [(1, "abc")] * 3000, "doc_id long, text string")).withColumn("piece", F.lit("x"))
    packed = operator.pack(pieces)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    rows = packed.collect()
    assert len(rows) == 3000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["sequence_id"] >> 32] += 1
    assert max(sizes.values()) < 200


def test_differencing():
    chance = np.random.default_rng(8)
    for n in (0, 1, 2, 7, 400):
        sizes = chance.integers(1, 513, n)
        window, count = pack_block(sizes, 2048)
        loads = np.bincount(window, weights=sizes, minlength=count)
        assert len(loads) == count and (n == 0 or loads.max() <= 2048)
        if n == 400:
            assert count <= 1.02 * sizes.sum() / 2048 + 1
    assert pack_block(np.full(5, 2000), 2048)[1] == 5  # the count rises until all fit


# --- chat ----------------------------------------------------------------------------------------

def test_escaping():
    random.seed(9)
    parts = [*CONTROL, "\\", "<", "[", "|", "/", "s>", "a", "INST]", "<\\/s>", "\\\\"]
    for _ in range(20000):
        text = "".join(random.choice(parts) for _ in range(random.randrange(8)))
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROL)


@pytest.mark.parametrize("stretch", [4096, 2])
def test_chat(spark, stretch):
    rows = [(1, t, ("system", "user", "assistant")[t % 3], f"</s>[INST] ok {t}\n<|end|>") for t in range(11)]
    rows += [(2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 5, "assistant", LONG), (3, None, "user", "first"), (None, 0, "assistant", "<\\/s>")]
    operator = ChatFormat(RANKS, public_tokenizers.PATTERN, stretch=stretch)
    formatted = operator.format(local(spark, rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash")))
    got = {r["conv_id"]: r for r in operator.read_back(formatted).collect()}
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(turns)
    for conv, listed in turns.items():
        listed.sort()
        r, learnt = got[conv], "".join(x for _, role, x in listed if role == "assistant")
        assert r["n_turns"] == len(listed)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in listed).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    for conv in turns:
        at = 0
        for r in formatted.filter(F.col("conv_id").eqNullSafe(conv)).orderBy("place").collect():
            assert r["start"] == at and len(r["ids"]) == len(r["mask"])
            at += len(r["ids"])
    none = operator.format(local(spark, [], "conv_id long, turn long, role string, text string"))
    assert operator.read_back(none).count() == 0


# --- lines ---------------------------------------------------------------------------------------

def test_lines(spark, empty):
    random.seed(11)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(300)]
    base = [" ".join(random.sample(words, 25)) for _ in range(12)]
    near = [b.replace(b[k : k + 3], "zé", 1) for b in base for k in (5, 60, 120)]
    far = [" ".join(random.sample(words, 25)) for _ in range(15)]
    lines = [*base, *near, *far, "ok", "ok", "", "  ", base[0] + "  ", LONG]
    random.shuffle(lines)
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(len(lines) // 3 + 1)] + [(99, None)]
    docs = local(spark, rows, "doc_id long, text string").withColumn("line", F.lit(1))
    got = LineDedup().assign(docs).collect()
    flat = [(i, k, x.strip(" \t\r\v\f")) for i, text in rows for k, x in enumerate((text or "").split("\n")) if x.strip(" \t\r\v\f")]
    sets = [{x[j : j + 8] for j in range(max(1, len(x) - 7))} for _, _, x in flat]
    links = [(a, b) for b in range(len(flat)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = union_find(range(len(flat)), links)
    want = {(i, k): flat[root[n]][:2] == (i, k) for n, (i, k, _) in enumerate(flat)}
    assert {(r["doc_id"], r["line_no"]): r["kept"] for r in got} == want
    ours = defaultdict(set)
    for r in got:
        ours[r["component_id"]].add((r["doc_id"], r["line_no"]))
    theirs = defaultdict(set)
    for n, (i, k, _) in enumerate(flat):
        theirs[root[n]].add((i, k))
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))
    assert LineDedup().assign(empty).count() == 0


def test_lines_of_repeated_rows_and_documents_given_back(spark):
    line, other = "one line that is long enough to count as a line of text", "quite another one, also long enough to be told apart from it"
    rows = [(1, f"{line}\n\n{other}", "a"), (1, f"{line}\n\n{other}", "b"), (None, f"  {line}.\n", "c"), (None, f"{other}!\nlast", "d"), (2, None, "e"), (3, "", "f")]
    docs = local(spark, rows, "doc_id long, text string, number string").withColumn("row", F.lit(0))
    kept = [r for r in LineDedup().assign(docs).collect() if r["kept"]]
    assert sorted((r["doc_id"] or 0, r["line_no"]) for r in kept) == [(0, 0), (0, 0), (0, 1)]
    back = LineDedup().deduplicate(docs)
    assert back.columns == docs.columns
    got = {r["number"]: (r["doc_id"], r["text"]) for r in back.collect()}
    assert got == {"a": (1, ""), "b": (1, ""), "c": (None, f"  {line}.\n"), "d": (None, f"{other}!\nlast"), "e": (2, None), "f": (3, "")}


def test_lines_gathered_apart_from_a_pivot(spark):
    """Copies of a text that a pivot is not similar to meet one of them, not each other; shingles of one component make no pair."""
    random.seed(8)
    letters = "abcdefghijklmnop "
    text = lambda n: "".join(random.choice(letters) for _ in range(n))
    head, tail = text(250), text(150)
    other = head + tail
    lines = [head + text(150), other, *[other[:k] + "ZZ" + other[k + 2 :] for k in range(5, 395, 5)]]
    operator = LineDedup()
    texts = local(spark, list(enumerate(lines)), "line_id long, line string")
    compared = operator.compared(local(spark, [(0, i) for i in range(1, len(lines))], "a long, b long"), texts).collect()
    assert max(r["similarity"] for r in compared) < 0.8
    schema = "pivot long, line_id long, size long, common long, outside array<long>, root long, apart boolean"
    rows = [(0, r["b"], r["size_b"], r["common"], r["outside"], r["b"], True) for r in compared]
    company = local(spark, [(i, 100 - i) for i in range(len(lines))], "line_id long, company long")
    unlike = local(spark, [(0, r["b"], r["outside"]) for r in compared], "a long, b long, outside array<long>")
    pairs = operator.gathered(unlike, company).collect()
    assert len(pairs) < 4 * len(lines)
    root = union_find(range(1, len(lines)), [(r["a"], r["b"]) for r in pairs])
    assert len({root[i] for i in range(1, len(lines))}) == 1
    joined = [(*r[:5], 1, True) for r in rows]
    assert operator.meetings(local(spark, joined, schema)).count() == 0


def test_lines_of_an_edited_pivot_meet_by_rare_shingles(spark):
    """The pivot has an edit of its own, so all lines have the same shingles outside it; lines of another component meet none of them by these."""
    random.seed(6)
    letters = "abcdefghijklmnop "
    base = "".join(random.choice(letters) for _ in range(400))
    pivot = base[:200] + "ZZZZ" + base[204:]
    near = [base, *[base[:k] + "YY" + base[k + 2 :] for k in range(10, 190, 6)]]
    far = ["".join("X" if i % 37 == k else c for i, c in enumerate(base)) for k in range(12)]
    operator = LineDedup()
    texts = local(spark, list(enumerate([pivot, *near, *far])), "line_id long, line string")
    rows = operator.compared(local(spark, [(0, i) for i in range(1, len(near) + len(far) + 1)], "a long, b long"), texts).collect()
    assert all((r["similarity"] >= 0.8) == (r["b"] <= len(near)) for r in rows)
    assert all(len(set(r["outside"])) == len(r["outside"]) for r in rows)
    rooted = [(0, r["b"], r["size_b"], r["common"], r["size_a"] - r["common"], r["outside"], 0 if r["b"] <= len(near) else r["b"], r["b"] > len(near)) for r in rows]
    rooted = local(spark, rooted, "pivot long, line_id long, size long, common long, missing long, outside array<long>, root long, apart boolean")
    assert [tuple(r) for r in operator.centres(rooted).collect()] == [(0, 1)]
    assert operator.meetings(rooted).count() < len(near)


def test_lines_run_no_python(spark):
    texts = local(spark, [(0, "a line"), (1, "another line")], "line_id long, line string")
    operator = LineDedup()
    for df in (operator.banded(operator.signatures(texts)), operator.compared(local(spark, [(0, 1)], "a long, b long"), texts)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), plan


def test_meetings_lose_no_similar_lines(spark):
    """Edited copies, some similar to each other but not to the pivot: all similar pairs that are not joined to it meet."""
    random.seed(5)
    letters = "abcdefghijklmnop "
    edit = lambda text, n: "".join(random.choice(letters) if i in at else c for at in [set(random.sample(range(len(text)), n))] for i, c in enumerate(text))
    base = "".join(random.choice(letters) for _ in range(400))
    lines = [base, *[edit(base, random.randrange(1, 16)) for _ in range(25)]]
    lines += [edit(line, 2) for line in lines[1:20]] + [base[:330], base[:320] + "zz", base[40:], "ab", "abc"]
    rows = list(enumerate(dict.fromkeys(lines)))
    sets = {i: {x[j : j + 8] for j in range(max(1, len(x) - 7))} for i, x in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    operator = LineDedup()
    texts = local(spark, rows, "line_id long, line string")
    compared = operator.compared(local(spark, [(0, i) for i, _ in rows[1:]], "a long, b long"), texts).collect()
    for r in compared:
        assert abs(r["similarity"] - alike[0, r["b"]]) < 1e-12 and r["common"] == len(sets[0] & sets[r["b"]]) and r["size_b"] == len(sets[r["b"]])
    rooted = [(0, r["b"], r["size_b"], r["common"], r["outside"], 0 if r["similarity"] >= 0.8 else r["b"], r["similarity"] < 0.8) for r in compared]
    met = operator.meetings(local(spark, rooted, "pivot long, line_id long, size long, common long, outside array<long>, root long, apart boolean"))
    apart = {r[1] for r in rooted if r[6]}
    want = {p for p, s in alike.items() if s >= 0.8 and 0 not in p and apart & set(p)}
    got = {(r["a"], r["b"]) for r in met.collect()}
    assert len(want) > 5 and want <= got
    assert len(got) < sum(1 for p in alike if 0 not in p and apart & set(p)) / 2


# --- language ------------------------------------------------------------------------------------

def test_language(spark, odd, empty):
    got = q.op1_language_id(spark, SMALL).toPandas()
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    both = got.dropna(subset=["doc_id"]).merge(docs[["doc_id", "lang"]], on="doc_id")
    assert len(both) == len(docs) and (both["language"] == both["lang"]).mean() > 0.98
    pages = pd.read_parquet(f"{SMALL}/pages.parquet")
    assert got["page_id"].notna().sum() == len(pages)
    operator = LanguageId()
    kept = operator.keep(odd.withColumn("mark", F.lit(1)).withColumn("host", F.lit("x")))
    assert kept.columns == [*odd.columns, "mark", "host"]
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 7, 8, 9, 10, 11}
    assert operator.keep(empty).count() == 0


def test_language_held_out(spark):
    """Texts alone, of documents that the model was not fitted on."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text IS NOT NULL")
    operator = LanguageId()
    model = operator.fit(docs.filter("doc_id % 2 = 0"))
    none = F.lit(None).cast("string")
    rows = docs.filter("doc_id % 2 = 1").select("doc_id", "text", "lang", *[none.alias(c) for c in ("declared", "suffix", "domain", "host")])
    got = operator.identify(rows, model).toPandas()
    assert (got["language"] == got["lang"]).mean() > 0.97


def test_language_evidence(spark):
    """Where the text says little, the declaration and the host decide."""
    texts = {"en": "the thing that they think of then", "fr": "la chose dont elle parle avec eux"}
    labelled = local(spark, [(i, texts[x], x, "s", 1) for i, x in enumerate(["en", "fr"] * 20)], DOCS)
    operator = LanguageId(strength=1.0)
    model = operator.fit(labelled)
    rows = [(i, texts["fr"], "fr", "fr", "a.fr", "www.a.fr") for i in range(30)] + [(100 + i, texts["en"], "en", "com", "b.com", "b.com") for i in range(30)]
    rows += [(900, "xq", "fr", None, None, None), (901, "xq", None, None, None, "b.com"), (902, "xq", None, "fr", "c.fr", "c.fr"), (903, "123", "fr", None, None, None), (904, None, None, None, None, None)]
    got = {r["k"]: r for r in operator.identify(local(spark, rows, "k long, text string, declared string, suffix string, domain string, host string"), model).collect()}
    assert [got[k]["language"] for k in (0, 100, 900, 902, 903, 904)] == ["fr", "en", "fr", "fr", None, None]
    assert not got[903]["kept"] and not got[904]["kept"] and got[900]["kept"]


def test_all_languages_are_fitted(spark):
    """Of 230 labels in 231 spellings, the rarest are told as well; many languages have the same scores by either kind of weights."""
    random.seed(18)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:03d}": ["".join(random.choice(letters) for _ in range(6)) for _ in range(6)] for i in range(230)}
    text = lambda x: " ".join(random.choice(words[x]) for _ in range(30))
    labels = [x for i, x in enumerate(words) for _ in range(1 if i >= 220 else 2)] + ["L000"]
    labelled = local(spark, [(i, text(x.lower()), x, "s", 1) for i, x in enumerate(labels)], DOCS)
    many, dense = LanguageId().fit(labelled), LanguageId(dense=1000).fit(labelled)
    assert many.languages == dense.languages == tuple(words)
    for some in map(text, ("l000", "l229")):
        assert np.allclose(many.scores(some, 200.0)[0], dense.scores(some, 200.0)[0], rtol=1e-5)
    rows = [(i, text(x), x, None, None, None, None) for i, x in enumerate([*words][::10] + ["l228", "l229"])]
    got = LanguageId().identify(local(spark, rows, "k long, text string, want string, declared string, suffix string, domain string, host string"), many).collect()
    assert len(got) == len(rows) and all(r["language"] == r["want"] and r["kept"] for r in got)


def test_pages(spark):
    html = '<!DOCTYPE html><HTML class="x" LANG=fr-CA><script>var a="</p>";</script><p>Bonjour&nbsp;le <b>monde</b></p><!-- x --></html>'
    rows = page_rows(local(spark, [(1, "https://u@Www.Some.Example.ORG:8080/p?x#y", html), (2, "http://10.0.0.1/x", "plain"), (3, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert tuple(rows[0])[2:] == ("fr", "org", "example.org", "www.some.example.org") and rows[0]["text"].split() == ["Bonjour", "le", "monde"]
    assert (rows[1]["suffix"], rows[1]["domain"], rows[1]["host"]) == (None, None, "10.0.0.1")
    assert tuple(rows[2])[1:] == ("", None, None, None, None)


# --- totals and shards ---------------------------------------------------------------------------

def test_token_totals(spark, odd, empty):
    import base64

    import tiktoken

    version = TokenizerVersion("v1", RANKS, public_tokenizers.PATTERN)
    totals = TokenTotals(spark, Store(spark).path("totals"))
    assert totals.totals().count() == 0
    counts = count_tokens(odd, [version])
    assert totals.commit("one", signed(counts, 1))
    assert not totals.commit("one", signed(counts, 1))
    assert totals.commit("none", signed(count_tokens(empty, [version]), 1))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = defaultdict(lambda: [0, 0, 0])
    for _, text, lang, source, _ in ODD:
        for i, n in enumerate((1, len(plain.encode_ordinary(text or "")), len(text or ""))):
            want[source, lang, "v1"][i] += n
    table = lambda: {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"], r["n_chars"]] for r in totals.totals().collect()}
    assert table() == want
    revised = odd.filter("doc_id = 7").withColumn("text", F.lit("short"))
    assert totals.commit("two", signed(count_tokens(odd.filter("doc_id = 7"), [version]), -1).unionByName(signed(count_tokens(revised, [version]), 1)))
    want["s", "en", "v1"][1] += len(plain.encode_ordinary("short")) - len(plain.encode_ordinary(LONG))
    want["s", "en", "v1"][2] += 5 - len(LONG)
    assert table() == want
    assert totals.commit("gone", signed(count_tokens(odd.filter("doc_id <> 7"), [version]), -1))
    assert list(table()) == [("s", "en", "v1")] and table()["s", "en", "v1"][0] == 1
    with pytest.raises(ValueError):
        totals.commit("../x", signed(counts, 1))


def test_counts_of_revised_documents(spark, odd):
    """Counted once, with the counts after the revision for the documents that may change; extra columns do not matter."""
    versions = [TokenizerVersion("v1", RANKS, public_tokenizers.PATTERN), TokenizerVersion("v2", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)]
    changes = id_map(local(spark, [(1,), (4,), (9,), (None,), (77,)], "doc_id long"))
    shorter = lambda text: text.replace(" ", "")
    rows = count_once(odd.selectExpr("*", "1 AS bit", "2 AS n_tokens"), versions, changes, shorter).collect()
    assert {r["doc_id"] for r in rows if r["new_tokens"] is not None} == {1, 4, 9} and len(rows) == len(ODD)
    key = lambda r: str(tuple(r))
    frame = count_once(odd, versions, changes, shorter)
    assert sorted(by_version(frame, versions).collect(), key=key) == sorted(count_tokens(odd, versions).collect(), key=key)
    revised = local(spark, [(i, shorter(t or ""), lang, s, n) for i, t, lang, s, n in ODD if i in (1, 4, 9)], DOCS)
    assert sorted(by_version(frame.filter("new_tokens IS NOT NULL"), versions, new=True).collect(), key=key) == sorted(count_tokens(revised, versions).collect(), key=key)


def test_token_totals_query(spark):
    """The final totals are those of the documents as they are after all batches."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = pd.read_parquet(f"{SMALL}/labels.parquet").groupby("doc_id").agg(toxic=("toxic", "max"), quality=("quality", "min"))
    toxic, poor = set(labels.index[labels["toxic"] == 1]), set(labels.index[(labels["toxic"] != 1) & (labels["quality"] == 0)])
    rows = [(r["doc_id"], " ".join(r["text"].split(" ")) if r["doc_id"] not in poor else __import__("re").sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["lang"], r["source"], 0) for r in docs.collect() if r["doc_id"] not in toxic]
    versions = [TokenizerVersion(n, public_tokenizers.path(f"{n}.tiktoken"), public_tokenizers.PATTERN) for n in ("byte_bpe_50k", "byte_bpe_multi_50k")]
    want = signed(count_tokens(local(spark, rows, DOCS), versions), 1).groupBy("source", "lang", "tokenizer").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])
    assert sorted(map(tuple, q.op9_token_counts(spark, SMALL).collect())) == sorted(map(tuple, want.collect()))


def test_sharding(spark, odd, empty, tmp_path):
    names = [f"s{i}" for i in range(7)]
    table = fill_table(names, 1009)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    fewer = fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.1 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            fill_table(bad, 1009)
    with pytest.raises(ValueError):
        fill_table(names, 1008)
    operator = Sharding(tuple(names), 1009)
    docs = odd.withColumn("slot", F.lit("clash")).unionByName(local(spark, [(None, "x", "en", "s", 1)], DOCS).withColumn("slot", F.lit("clash")))
    for r in operator.place(docs).collect():
        key = "" if r["row"]["doc_id"] is None else str(r["row"]["doc_id"])
        assert r["slot"] == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 1009 and r["shard"] == table[r["slot"]]
    assert operator.place(empty).count() == 0
    operator.write(docs, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


# --- pipeline ------------------------------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline

    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    rows = list(zip(docs["doc_id"], docs["text"], docs["lang"], docs["source"], docs["n_chars"], strict=True))
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    kept = {w[1] for w in brute_exact(rows)}
    rows = [r for r in rows if r[0] in kept]
    prints = {r[0]: brute_fingerprint(r[1] or "") for r in rows}
    roots = union_find(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    rows = [r for r in rows if roots[r[0]] == r[0]]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert check_packing(got, {r[0]: r[1] for r in rows}) > 0.97
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "packing"]


def test_pipeline_odd(spark, odd, empty):
    import corpus_pipeline

    for docs in (odd.withColumn("digest", F.lit("x")), empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            docs = Store(spark).write(out, "docs")
        corpus_pipeline.packed(spark, docs, SMALL).count()

"""Token ids of whole texts by a word-level BPE of the tokenizers library: new ASCII words by ranks, all words remembered."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Bytes of words and their ids that a task remembers before it forgets the older half.
REMEMBERED = 64 << 20
#: Words of more bytes go to the library and are not remembered.
LONG = 64

CONTROLS = bytes([*range(32), 127])
#: Between words that are encoded together.
APART = b"\x01"
#: What the tokenizer takes apart, in lower-case ASCII, besides runs of letters.
SIGNS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9 \x01]+")


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable signs themselves, the others counted from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [c for c in range(256) if c not in printable]
    return {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(others)}


def rank_encoding(path: str):
    """(encoding, ids): the tokenizer's merges as ranks, a blank for the end of a word, and its id for each rank.

    Ranks merge any two neighbours that make up a token, the file only its listed pairs. Both
    agree where each token, spelt out, is merged to itself by the listed pairs: no other split
    of it can then arise. ``tests/llm`` checks that for the whole vocabulary.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    end, vocabulary, signs = model["end_of_word_suffix"], model["vocab"], byte_signs()

    def raw(token: str) -> bytes:
        closed = token.endswith(end)
        return bytes(signs[c] for c in (token.removesuffix(end) if closed else token)) + b" " * closed

    letters = sorted(signs, key=signs.get)
    merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    tokens = [*letters, *[c + end for c in letters], *["".join(pair) for pair in merges]]
    encoding = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks={raw(t): i for i, t in enumerate(tokens)}, special_tokens={})
    return encoding, np.array([vocabulary[t] for t in tokens], "<u4")


class WordTokens:
    """For a tokenizer that drops white space, lower-cases, and encodes words on their own.

    Such a tokenizer's ids for a text are those of its blank-separated chunks in order, so a chunk
    seen before costs one lookup. New chunks of ASCII are taken apart by one pattern and encoded by ranks, all
    of a call at a time; the others, and those with control signs, go to the library, where chunks that
    end in full stops or commas after a letter fall apart. Texts that may hold one of the
    tokenizer's special strings are encoded directly, since those are recognised before lower-casing.

    The tokenizer composes signs before it lower-cases. A-Z compose with signs of U+0300 to U+037F
    alone (bytes CC and CD), and some capitals do not where their small letters do; so in texts with
    such signs, chunks that are not ASCII reach the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.encoding, self.ids = rank_encoding(path)
        self.apart = self.encoding.encode_ordinary(APART.decode() + " ")[0]
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.used = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Words of letters alone are encoded in one text and told apart by the ids that end a word."""
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        out: list[bytes] = [b""] * len(words)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in plain])], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) == len(plain):
            raw, start = ids.tobytes(), 0
            for i, end in zip(plain, ends, strict=True):
                out[i] = raw[4 * start : 4 * end]
                start = end
        else:  # letters that fall apart when the tokenizer normalises them
            plain = []
        rest = sorted(set(range(len(words))).difference(plain))
        for i, ids in zip(rest, self._encode([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that ``new`` lacks; they are added to it."""
        old = self.old
        learnt: dict[bytes, bytes] = {}
        whole, parted, parts = [], [], set()
        for word in words:
            if (ids := old.get(word)) is not None:
                learnt[word] = ids
            elif word[-1] not in b".,":
                whole.append(word)
            else:
                core = word.rstrip(b".,")
                # Other bytes may end a combining mark, which the tokenizer counts as a sign.
                if core[-1:].isalpha():
                    tail = word[len(core) :]
                    parted.append((word, core, tail))
                    parts.add(core)
                    parts.add(tail)
                else:
                    whole.append(word)
        self.new.update(learnt)
        parts.difference_update(whole)
        whole += [x for x in parts if x not in self.new]
        learnt.update(zip(whole, self._encode_words(whole), strict=True))
        self.new.update(learnt)
        known = self.new
        for word, core, tail in parted:
            known[word] = learnt[word] = known[core] + known[tail]
        return learnt

    def _by_rank(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word of printable ASCII, in small letters."""
        text = (b" " + APART + b" ").join(words).decode() + " "
        ranks = self.encoding.encode_to_numpy(SIGNS.sub(spaced, text), disallowed_special=())
        ids, ends = self.ids[ranks].tobytes(), (4 * np.flatnonzero(ranks == self.apart)).tolist()
        return [ids[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(ids)], strict=True)]

    def _ids_of(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new chunks; short ones are remembered."""
        plain, once, others = [], [], []
        old, found = self.old, {}
        for word in words:
            if len(word) > LONG:
                once.append(word)
            elif (ids := old.get(word)) is not None:
                found[word] = ids
            elif word.isascii():
                plain.append(word)
            else:
                others.append(word)
        joined = b"".join(plain)
        if len(joined.translate(None, CONTROLS)) < len(joined):
            odd = [len(w.translate(None, CONTROLS)) < len(w) for w in plain]
            others += [w for w, x in zip(plain, odd, strict=True) if x]
            plain = [w for w, x in zip(plain, odd, strict=True) if not x]
        if plain:
            found.update(zip(plain, self._by_rank(plain), strict=True))
        self.new.update(found)
        found.update(self._learn(others))
        self.used += sum(map(len, found)) + sum(map(len, found.values())) + 128 * len(found)
        found.update(zip(once, self._encode([w.decode() for w in once]), strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        lowered = [t.encode().lower() for t in texts]
        direct = [i for i, t in enumerate(lowered) if any(s in t for s in self.special)]
        for i in direct:
            lowered[i] = b""
        split = [t.split() for t in lowered]
        for i, t in enumerate(lowered):
            if b"\xcc" in t or b"\xcd" in t:
                split[i] = [w.lower() if w.isascii() else w for w in texts[i].encode().split()]
        if self.used > REMEMBERED:
            self.old, self.new, self.used = self.new, {}, 0
        words = list(set().union(*split))
        here = dict(zip(words, map(self.new.get, words), strict=True))
        here.update(self._ids_of([w for w, ids in here.items() if ids is None]))
        known = here.__getitem__
        out = [b"".join(map(known, words)) for words in split]
        for i, ids in zip(direct, self._encode([texts[i] for i in direct]), strict=True):
            out[i] = ids
        return out


def spaced(found: re.Match) -> str:
    return f" {found[0]} "


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One encoder per Python worker and file, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]

"""Word hashes and token ids against plain code and the tokenizers library."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import bpe, near, rules, vec
from lectern.llm.bpe import Codec, PrefixCounts
from lectern.llm.tokens import PrefixTable

RNG = random.Random(5)
ALPHABET = "ab c'sTeéèÉß\n\t  .,!?|#'tllrevemd0123 　漢字İΣσς́e\x00\x1c\x85é😀"
TEXTS = ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(0, 60))) for _ in range(400)]
TEXTS += ["", " ", "a" * 3000, "don't I'll 's x's\n's !'s", "a<|endoftext|>b", "<|startoftext|>x<|endoftext|>", " ".join(f"word{i}" for i in range(2000))]


@pytest.mark.parametrize("limit", [7, 100, vec.SLICE])
def test_words(monkeypatch, limit):
    monkeypatch.setattr(vec.slices, "__defaults__", (limit,))
    h, off = vec.words(TEXTS)
    seen = {}
    for i, t in enumerate(TEXTS):
        want = re.findall(r"[^\x20\x09-\x0D]+", t)
        got = h[off[i] : off[i + 1]].tolist()
        assert len(got) == len(want)
        for w, x in zip(want, got, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_hash_map():
    m = vec.HashMap(4)
    keys = vec.mix(np.arange(1, 5000, dtype=np.uint64)) & ~np.uint64(1)
    m.put(keys[:3000], np.arange(3000))
    m.put(keys[3000:4000], np.arange(3000, 4000))
    assert (m.get(keys[:4000]) == np.arange(4000)).all()
    assert (m.get(keys[4000:]) == -1).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("limit", [50, vec.SLICE])
def test_ids_are_the_librarys(monkeypatch, name, limit):
    monkeypatch.setattr(vec.slices, "__defaults__", (limit,))
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    for room in (5000, 10**8):
        codec = Codec(path, room=room)
        ids, off = codec.encode(TEXTS)
        for i, e in enumerate(lib.encode_batch(TEXTS, add_special_tokens=False)):
            assert ids[off[i] : off[i + 1]].tolist() == e.ids, TEXTS[i]
        assert (Codec(path, count_only=True).counts(TEXTS) == np.diff(off)).all()


def test_prefix_counts():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, codec = Tokenizer.from_file(path), Codec(path)
    rows = PrefixCounts(codec.v)
    for word in ("understanding", "tionthe", "xqzxqz", "éèß"):
        raw = word.encode()
        for i, n in enumerate(rows.rows(word)[1:], 1):
            try:
                part = raw[:i].decode()
            except UnicodeDecodeError:
                continue
            assert n == len(lib.encode(part, add_special_tokens=False).ids)
    text = "The quick brown fox, jumping 123 times; didn't it?"
    table = PrefixTable(text, codec)
    counts = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert [table.count(k) for k in range(len(text) + 1)] == counts
    for budget in range(counts[-1] + 2):
        cut = table.fit(budget)[0]
        assert counts[cut] <= budget and (cut == len(text.rstrip()) or counts[cut] <= budget < max(counts[cut:]) or budget >= counts[-1])


def test_prefix_counts_with_special_strings():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for text in ("hey!!<|endoftext|>you, <|startoftext|><|endoftext|> don't", "<|endoftext|>", "a <|endof b"):
        table = PrefixTable(text, Codec(path, count_only=True))
        assert [table.count(k) for k in range(len(text) + 1)] == [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("letters", ["ab", "qe", "xe"])
@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomials_confuse(letters, n):
    a, b = letters
    one, two = thue_morse(n, a, b), thue_morse(n, b, a)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        lib = Tokenizer.from_file(path)
        ids, off = Codec(path).encode([one, two])
        assert [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:], strict=True)] == [lib.encode(t, add_special_tokens=False).ids for t in (one, two)]
        assert Codec(path, count_only=True).counts([one, two]).tolist() == np.diff(off).tolist()
    assert rules.Rules()([f"{one} u v {two} u v", f"{one} u v {one} u v"])["n_repeat_words"].tolist() == [0, 6]
    g, _, off = near.shingles([f"{one} u v w x", f"{two} u v w x"])
    assert len(set(g.tolist())) == 2


def test_ids_do_not_rest_on_hashes(monkeypatch):
    """With three hashes for all words, ids and counts are still right."""
    weak = lambda codes, s, e: vec.mix((e - s).astype(np.uint64) % np.uint64(3) + np.uint64(8))
    monkeypatch.setattr(bpe, "span_hashes", weak)
    monkeypatch.setattr(rules, "span_hashes", weak)
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, codec = Tokenizer.from_file(path), Codec(path, room=3000)
    texts = ["the cat sat on the mat " * 20, "dog cow pig hen the cat sat", "x" * 50 + " yy " + "z" * 49]
    for _ in range(3):
        ids, off = codec.encode(texts)
        assert [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:], strict=True)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert rules.Rules()(["a b c a b d a b c", "aa bb cc", "a a a a"])["n_repeat_words"].tolist() == [6, 0, 4]


@pytest.mark.parametrize("text", ["<|endoftext|>" * 60000, "x" * 700_000, " " * 700_000, "9" * 300_000, "ab " * 250_000])
def test_long_texts_take_seconds(text):
    start = time.process_time()
    Codec(public_tokenizers.path("byte_bpe_50k.json")).encode([text])
    Codec(public_tokenizers.path("word_bpe_49k.json"), count_only=True).counts([text])
    rules.Rules()([text])
    assert time.process_time() - start < 25


def test_prefixes_of_a_long_word():
    rows = PrefixCounts(Codec(public_tokenizers.path("word_bpe_49k.json")).v)
    start = time.process_time()
    assert len(rows.rows("ab" * 10000)) == 20001
    assert time.process_time() - start < 5


def test_decode():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, codec = Tokenizer.from_file(path), Codec(path)
    ids, off = codec.encode(TEXTS)
    for a, b in zip(off[:-1], off[1:], strict=True):
        assert codec.decode(ids[a:b]).decode("utf-8", "replace") == lib.decode(ids[a:b].tolist(), skip_special_tokens=False)

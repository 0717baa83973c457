"""Keys of words and shingles from arrays of bytes: equal where the words are, without a step of Python a word."""

import random
import sys

import numpy as np
import pytest

from foliant.llm import ngram_jaccard

TEXTS = [b"", b" \t\n\x0b\x0c\r", b"a", b"a\x00 a", b"\x1ca \x1c", b"The CAT sat on the mat the cat sat on the mat", b"12345678 123456789 12345678\x00 1234567812345678 1234567", "É é ÉTÉ été  nbsp 漢字".encode(), b"\xff\xfe \xff", b"x" * 5000 + b" " + b"x" * 5001]


def drawn(rng):
    return bytes(rng.choice(b"aAbB \t\n\x00\xc3") for _ in range(rng.randrange(60)))


def sets_by_words(text, k):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def test_word_keys_are_equal_where_the_words_are():
    rng = random.Random(1)
    texts = TEXTS + [drawn(rng) for _ in range(500)]
    ids, n = ngram_jaccard.word_ids(texts)
    words = [t.lower().split() for t in texts]
    assert n.tolist() == list(map(len, words))
    every = [w for t in words for w in t]
    assert len(set(every)) == len(set(ids.tolist())) == len(set(zip(every, ids.tolist(), strict=True)))


@pytest.mark.parametrize("k", [1, 4, 5])
def test_shingle_sets_are_those_of_each_text_alone(k):
    rng = random.Random(k)
    texts = TEXTS + [drawn(rng) for _ in range(300)]
    sets = ngram_jaccard.shingle_sets(texts, k)
    brute = [sets_by_words(t, k) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in brute]
    for text, keys in zip(texts, sets, strict=True):
        assert (keys == ngram_jaccard.shingle_set(text, k)).all() and (keys[1:] > keys[:-1]).all()
    for a, x in zip(sets[::7], brute[::7], strict=True):
        for b, y in zip(sets[::11], brute[::11], strict=True):
            assert len(np.intersect1d(a, b)) == len(x & y)
    every, n = np.unique(ngram_jaccard.all_shingles(texts, k), return_counts=True)
    assert every.tolist() == np.unique(np.concatenate(sets)).tolist()
    assert n.sum() == sum(max(1, w - k + 1) for t in texts if (w := len(t.split())))


@pytest.mark.parametrize(("bits", "n"), [(37, 0), (37, 1), (37, 5000), (50, 5000), (12, 3000)])
def test_counts_of_keys(bits, n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << bits, n, dtype=np.uint64), np.arange(min(n, 200), dtype=np.uint64)]))
    counts = rng.integers(1, 1 << 32, len(keys)).astype(np.uint32)
    asked = np.concatenate([keys, rng.integers(0, 1 << bits, 2000, dtype=np.uint64), np.array([0, (1 << bits) - 1], np.uint64)])
    known = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert ngram_jaccard._Counts(keys, counts, bits).of(asked).tolist() == [known.get(x, 0) for x in asked.tolist()]


def test_words_take_no_step_of_python_each():
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)).encode() for i in range(20)]
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += 1

    sys.setprofile(count)
    try:
        ngram_jaccard.shingle_sets(texts, 4)
    finally:
        sys.setprofile(None)
    assert steps < 2000

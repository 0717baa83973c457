"""Words of texts as arrays of code points: the same words and vectors as one by one, without a step of Python for each."""

import random

import numpy as np
import pytest
import regex

from foliant.llm import language_id

LANGS = ("de", "el", "en", "ja", "ru", "th")
SEEN = {"de": "straße über die häuser", "el": "ο λόγος της θάλασσας", "en": "the house near the river", "ja": "日本語のかな漢字カナ", "ru": "слово и дело", "th": "ภาษาไทยที่ดี"}
TEXTS = [
    "",
    " \t\n",
    "12 %%% ½",
    "The HOUSE near_the river, don't; x2y",
    "ΛΟΓΟΣ ΣΑΣ λόγοςabc ΌΣ",
    "İstanbul ŞİŞLİ Straße ǅ",
    "Wortслово漢字かなカナ這是一個沒有空格的句子 слово",
    "́̂abc á̂ ́ x́",
    "ภาษาไทยที่ดีและน้ำ ที่ ๑๒",
    "한국어 العربية हिन्दी \U00020000\U00020001 \U0001f600 a\U0001f600b",
    "end�  nbsp word ªº",
]


def model():
    grams = []
    for i, lang in enumerate(LANGS):
        for word in language_id.WORD.findall(SEEN[lang]):
            w = f"<{word}>"
            grams += [(lang, w[a : a + n], 1 + i, 0) for n in range(2, language_id.ORDER + 1) for a in range(len(w) - n + 1)]
    return language_id.LanguageModel(grams)


def one_by_one(text):
    return [(m.start() + a, m.start() + b) for m in regex.finditer(r"[^\x20\x09-\x0D]+", text) for a, b in language_id.words_in(m[0])]


def drawn(rng):
    return "".join(rng.choice("abzÄßΣσςслЖ漢字かカไท่́̂̇İ 12.\n한") for _ in range(rng.randrange(40)))


def test_spans_and_vectors_equal_those_of_words_one_by_one():
    rng = random.Random(4)
    fitted = model()
    labeller = language_id.Labeller(fitted)
    for text in [*TEXTS, *(drawn(rng) for _ in range(400))]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, ends = language_id.word_spans(points)
        spans = one_by_one(text)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == spans, text
        labeller.label_all([text.encode()])
        if spans:
            assert set(labeller.words) == {text[a:b] for a, b in spans}
            for word, row in labeller.words.items():
                assert (labeller.vectors[row] == fitted.words([word])[0]).all(), word


def test_texts_labelled_together_are_labelled_as_alone():
    rng = random.Random(5)
    texts = [t.encode() for t in [*TEXTS, *SEEN.values(), *(drawn(rng) for _ in range(100))]] + [b"cut \xe6\xbc", b"\xff house"]
    labeller = language_id.Labeller(model())
    assert labeller.label_all(texts) == [labeller.label_all([t])[0] for t in texts]


def test_ordinary_words_take_no_step_of_python_each(monkeypatch):
    fitted = model()
    labeller = language_id.Labeller(fitted)
    text = " ".join("".join(random.Random(i).choice("abcdefgslöов") for _ in range(8)) for i in range(2000)).encode()
    asked = []
    monkeypatch.setattr(language_id.LanguageModel, "gram_rows", lambda self, word: asked.append(word) or [0])
    labeller.label_all([text])
    assert not asked


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_rows_of_keys(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    found = language_id._Rows(keys, np.arange(len(keys)))
    assert (found.rows_of(keys, -7) == np.arange(len(keys))).all()
    assert (found.rows_of(rng.integers(1 << 63, (1 << 64) - 1, 3000, dtype=np.uint64), -7) == -7).all()

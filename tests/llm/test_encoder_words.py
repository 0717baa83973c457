"""Chunks of ASCII letters are one word: their ids need no pattern, and are the tokenizer's."""

from array import array

from foliant.llm.encoding import WordEncoder, default_tokenizer

TEXTS = [b"The HOUSE near the river Zzyzx", b"don't it's a1b2 x\x00y \x7f\x7f a_b <|endoftext|> <|x", "ÉTÉ été İstanbul ıota naïve ß 漢字 \x1c".encode(), b"", b"q" * 70 + b" " + b"Q" * 70]


def test_ids_are_those_of_the_tokenizer():
    encoder = WordEncoder(default_tokenizer())
    for _ in range(2):
        for text in TEXTS:
            whole = encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids
            assert array("I", encoder.encode(text)).tolist() == whole, text


def test_letters_alone_need_no_pattern():
    encoder, asked = WordEncoder(default_tokenizer()), []
    encoder.find = lambda text: asked.append(text) or []
    encoder.encode(b"The HOUSE near the river Zzyzx")
    assert not asked

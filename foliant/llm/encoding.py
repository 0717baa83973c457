"""Token ids of whole texts, by a public tokenizer's own file."""

from __future__ import annotations

from array import array

from .common import one_cache

#: Entries kept per worker, in two generations of so many: a full one takes the place of the older one, so that what is met often stays. This bounds
#: memory and never changes a result.
CACHE_CHUNKS, CACHE_WORDS = 250_000, 100_000


def default_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """The letter that byte-level tokenizers write for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: 0x100 + i for i, b in enumerate(others)}


def encoder_for(path: str) -> WordEncoder:
    """One encoder a process and tokenizer, so that its caches outlive a task."""
    return one_cache(f"encoder {path}", lambda: WordEncoder(path))


class WordEncoder:
    """Ids of a text as little-endian uint32 bytes, for tokenizers that drop white space and never join across it.

    Such a tokenizer gives the same ids for a text as for its white-space-free chunks one by one, so the ids of a
    chunk are kept. A chunk of characters below U+0250 is split further into the tokenizer's own words (`words`), whose ids
    come from its byte-level model and are kept too; every other chunk goes to the tokenizer whole.
    """

    def __init__(self, path: str, words: str = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = regex.compile(words).findall
        self.plain = regex.compile(r"[\x00-įı-ɏ]*").fullmatch
        self.model = self.tokenizer.model
        self.byte_letters = byte_letters()
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_chunks: dict[bytes, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self.old_words.get(word)
            if got is None:
                # a printable ASCII character is its own letter
                symbols = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.byte_letters)
                got = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
            if len(self.words) >= CACHE_WORDS:
                self.words, self.old_words = {}, self.words
            if len(word) <= 64:
                self.words[word] = got
        return got

    def _chunk(self, chunk: bytes) -> bytes:
        """The ids of a chunk that is not among `chunks`."""
        got = self.old_chunks.get(chunk)
        if got is None:
            text = chunk.decode("utf-8", "replace")
            if chunk.isalpha():  # ASCII letters alone are one word
                got = self._word(text.lower())
            elif "<|" in text or not (chunk.isascii() or self.plain(text)):
                got = self._ids(text)
            else:
                got = b"".join(map(self._word, self.find(text.lower())))
        if len(self.chunks) >= CACHE_CHUNKS:
            self.chunks, self.old_chunks = {}, self.chunks
        if len(chunk) <= 64:
            self.chunks[chunk] = got
        return got

    def encode(self, text: bytes) -> bytes:
        get, chunk = self.chunks.get, self._chunk
        return b"".join([ids if (ids := get(c)) is not None else chunk(c) for c in text.split()])

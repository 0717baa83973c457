"""LM scoring: a bigram model whose quantised log-counts sit in Bloom filters that are probed level by level.

The filter of words is broadcast; its size is bounded. The filter of bigrams grows with the corpus, so it is cut by ranges
of keys into filters of about SEGMENT_BYTES of text each, with as many bits an entry at every size, and the packed keys of the
texts to be scored meet their range's filter. Smoothing is absolute discounting, with a discount and a backed-off share per
level of the history's count, both from counts over the whole training corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_groups, one_cache, remainder, removed, scratch_folder, staged, table, task, text_bytes

#: Counts are stored as 1 + floor(log_BASE(count)) entries.
BASE = 1.5
BITS_PER_ENTRY, PROBES = 10, 4
#: Entries of the broadcast filter of words. Where the words need more, those below some level are met by a join, block by block of the texts.
WORD_ENTRIES = 24_000_000
#: Most frequent words whose exact counts are broadcast; all other exact counts are joined.
HEAD_WORDS = 1_000_000
#: Tokens handled together before they are sent on, and bytes of text a range of keys is sized for.
FLUSH_TOKENS, SEGMENT_BYTES = 1_000_000, 16 << 20
CACHE_WORDS = 200_000
#: Discounts are kept within these bounds where few counts tell them.
LEAST_DISCOUNT, MOST_DISCOUNT = 0.1, 0.95
#: Texts handled together.
GROUP_BYTES = 4 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit keys."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_key(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


END, START = b" end", b" start"  # no word holds a space


def bigram_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _U(0x9E3779B97F4A7C15) + (word ^ (word >> _U(32))) + _U(1))


def tokens(text: bytes) -> list[bytes]:
    """Words of the text with A-Z in lower case; the end token is not among them."""
    return text.lower().split()


class _Keys(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        key = word_key(word)
        if len(word) <= 64:
            self[word] = key
        return key


def _segments(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    return 1 << min(18, max(3, math.ceil(math.log2(max(1, size / SEGMENT_BYTES)))))


def _token_keys(texts: list[bytes]) -> np.ndarray:
    """Keys of the texts' tokens, the start key before each text and the end key behind."""
    find = one_cache("tokens", _Keys).__getitem__
    start, end = word_key(START), word_key(END)
    parts = []
    for text in texts:
        words = tokens(text)
        ids = np.empty(len(words) + 2, np.uint64)
        ids[0], ids[-1] = start, end
        ids[1:-1] = np.fromiter(map(find, words), np.uint64, len(words))
        parts.append(ids)
    return np.concatenate(parts)


def _flushes(batches, column: int, most: int):
    """Token keys of the batches' texts, about `most` at a time."""
    held, size = [], 0
    for batch in batches:
        for part in in_groups(batch.column(column).to_pylist(), GROUP_BYTES):
            held.append(_token_keys(part))
            size += len(held[-1])
            if size >= most:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _batch(rows, types, names):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _by_key(batches, width: int):
    """(key, rows) of batches sorted by their first column; rows without it."""
    at, parts = None, []
    for batch in batches:
        for key, *row in zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True):
            if at != key and parts:
                yield at, parts
                parts = []
            at = key
            parts.append(row)
    if parts:
        yield at, parts


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def count_words(texts: DataFrame, segments: int) -> DataFrame:
    """(segment, keys, counts, words, total, occurrences) by ranges of keys: sorted keys of words and their counts; words and occurrences by level; total occurrences."""
    import pyarrow as pa

    shift = _U(64 - (segments.bit_length() - 1))

    def pack(batches):
        for keys in _flushes(batches, 0, FLUSH_TOKENS):
            keys, n = np.unique(keys[keys != word_key(START)], return_counts=True)
            cuts = np.searchsorted(keys >> shift, np.arange(segments + 1, dtype=np.uint64))
            rows = [(i, keys[cuts[i] : cuts[i + 1]].tobytes(), n[cuts[i] : cuts[i + 1]].astype(np.uint32).tobytes()) for i in np.flatnonzero(np.diff(cuts)).tolist()]
            yield _batch(rows, [pa.int32(), pa.binary(), pa.binary()], ["segment", "keys", "counts"])

    def merge(batches):
        for segment, parts in _by_key(batches, 3):
            keys, n = _summed(*(np.concatenate([np.frombuffer(p[i], t) for p in parts]).astype(to) for i, t, to in ((0, np.uint64, np.uint64), (1, np.uint32, np.int64))))
            levels = levels_of(n)
            row = (segment, keys.tobytes(), n.tobytes(), np.bincount(levels, minlength=64).tolist(), np.bincount(levels, n, 64).astype(np.int64).tolist())
            yield _batch([row], [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())], ["segment", "keys", "counts", "words", "occurrences"])

    dealt = texts.mapInArrow(task(pack), "segment int, keys binary, counts binary").repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(task(merge), "segment int, keys binary, counts binary, words array<long>, occurrences array<long>")


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def level_counts() -> np.ndarray:
    """The count that each level stands for: the middle of the counts it holds; 0 for level 0."""
    low = BASE ** np.arange(0, 64)
    return np.concatenate([[0.0], (np.ceil(low) + np.maximum(np.ceil(low), np.ceil(low * BASE) - 1)) / 2])


def _bits(keys: np.ndarray, level: int, shift: np.uint64, blocks: int) -> list[np.ndarray]:
    """Bit positions, within the whole filter, of an entry; all in one block of 512 bits of the key's segment."""
    h = mix(keys + _U(level * 0xD1B54A32D192ED03 % (1 << 64)))
    region = keys >> shift if shift < 64 else np.zeros(len(keys), np.uint64)
    block = (region * _U(blocks) + (h >> _U(40)) % _U(blocks)) << _U(9)
    return [block + ((h >> _U(9 * i)) & _U(511)) for i in range(PROBES)]


@dataclass
class LogFrequencyFilter:
    bits: np.ndarray
    segments: int
    blocks: int

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        shift = _U(64 - (self.segments.bit_length() - 1))
        found = np.ones(len(keys), bool)
        for at in _bits(keys, level, shift, self.blocks):
            found &= (self.bits[(at >> _U(3)).astype(np.int64)] >> (_U(7) - (at & _U(7))).astype(np.uint8)) & 1 > 0
        return found

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level of an unbroken run of hits from level 1 up."""
        out = np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        level = 1
        while len(at) and level < 63:
            at = at[self.has(keys[at], level)]
            out[at] = level
            level += 1
        return out


def filled(keys: np.ndarray, counts: np.ndarray, blocks: int, segment: int = 0, segments: int = 1) -> bytes:
    """The bits of one range of keys: an entry for each level of each count."""
    shift = _U(64 - (segments.bit_length() - 1))
    region = np.zeros(blocks * 512, bool)
    levels, level = levels_of(counts), 1
    while len(keys):
        for at in _bits(keys, level, shift, blocks):
            region[(at - _U(segment * blocks * 512)).astype(np.int64)] = True
        level += 1
        keys, levels = keys[levels >= level], levels[levels >= level]
    return np.packbits(region).tobytes()


@dataclass
class Model:
    """What is known of words: their filter, totals n and v, the mean count of each level, and exact counts of the most frequent."""

    filter: LogFrequencyFilter
    n: int
    v: int
    mean: np.ndarray
    start_level: int
    head_keys: np.ndarray
    head_counts: np.ndarray
    head_least: int
    #: Words of lower levels are not in the filter.
    least_level: int = 1

    def one(self) -> np.ndarray:
        """The probability of a word by its level."""
        return np.minimum((self.mean + 1.0) / (self.n + self.v + 1), 1.0)


def train_words(words: DataFrame, segments: int) -> Model:
    """The model of counted words; its filter has at most WORD_ENTRIES entries, its head HEAD_WORDS words."""
    import pyarrow as pa

    total = words.select(F.posexplode(F.arrays_zip("words", "occurrences")).alias("level", "x")).groupBy("level").agg(F.sum("x.words").alias("w"), F.sum("x.occurrences").alias("c")).collect()
    w, c = np.zeros(64, np.int64), np.zeros(64, np.int64)
    for r in total:
        w[r["level"]], c[r["level"]] = r["w"], r["c"]
    entries = np.cumsum((w * np.arange(64))[::-1])[::-1]  # of words of each level or higher
    least_level = next(i for i in range(1, 64) if entries[i] <= WORD_ENTRIES or i == 63)
    head_level = next(i for i in range(1, 64) if w[i:].sum() <= HEAD_WORDS or i == 63)
    blocks = max(1, int(entries[least_level]) * BITS_PER_ENTRY // 512 // segments + 1)

    def parts(batches):
        for batch in batches:
            for segment, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, n = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                levels = levels_of(n)
                stored, head = levels >= least_level, levels >= head_level
                docs = int(n[keys == _U(word_key(END))].sum())
                row = (segment, filled(keys[stored], n[stored], blocks, segment, segments), keys[head].tobytes(), n[head].tobytes(), docs)
                yield _batch([row], [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()], ["segment", "bits", "keys", "counts", "docs"])

    whole, docs = np.zeros((segments, blocks * 64), np.uint8), 0
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for r in words.select("segment", "keys", "counts").mapInArrow(parts, "segment int, bits binary, keys binary, counts binary, docs long").collect():  # bounded by WORD_ENTRIES and HEAD_WORDS
        whole[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
        keys.append(np.frombuffer(r["keys"], np.uint64))
        counts.append(np.frombuffer(r["counts"], np.int64))
        docs += r["docs"]
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    # a count that is only known to lie below the head's still has its level
    least = int(np.ceil(BASE ** (head_level - 1) - 1e-9)) if head_level > 1 else 0
    mean = np.where(w > 0, c / np.maximum(w, 1), level_counts()[:64])
    mean[0] = 0.0
    return Model(LogFrequencyFilter(whole.reshape(-1), segments, blocks), int(c.sum()), int(w.sum()), mean, int(levels_of(np.array([docs]))[0]) if docs else 0, keys, counts, least, least_level)


class _Words(dict):
    """Index of each word met, with arrays of its key, level and exact count (-1: not among the frequent ones)."""

    def __init__(self):
        super().__init__()
        self.new: list[int] = []
        self.known = 0
        self.keys, self.levels, self.exact = np.empty(1 << 12, np.uint64), np.empty(1 << 12, np.uint8), np.empty(1 << 12, np.int64)
        #: Sorted keys, and levels, of what the filter leaves out of the texts at hand.
        self.left = np.empty(0, np.uint64), np.empty(0, np.uint8)

    def forget(self) -> None:
        self.clear()
        self.known, self.new = 0, []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = self.known + len(self.new)
        self.new.append(word_key(word))
        return at

    def learn(self, m: Model) -> None:
        a, b = self.known, self.known + len(self.new)
        if b > len(self.keys):
            grow = lambda x: np.concatenate([x, np.empty(max(b, 2 * len(x)) - len(x), x.dtype)])
            self.keys, self.levels, self.exact = grow(self.keys), grow(self.levels), grow(self.exact)
        keys = np.array(self.new, np.uint64)
        exact = np.zeros(len(keys), np.int64) - (m.head_least > 0)
        if len(m.head_keys):
            at = np.minimum(np.searchsorted(m.head_keys, keys), len(m.head_keys) - 1)
            exact = np.where(m.head_keys[at] == keys, m.head_counts[at], exact)
        levels = m.filter.levels(keys)
        if m.least_level > 1:  # what has a lower level by the filter is not in it
            rare, left = levels < m.least_level, self.left[0]
            at = np.minimum(np.searchsorted(left, keys), max(len(left) - 1, 0))
            levels[rare] = np.where(left[at] == keys, self.left[1][at], 0)[rare] if len(left) else 0
        levels[keys == _U(word_key(START))] = m.start_level
        self.keys[a:b], self.levels[a:b], self.exact[a:b] = keys, levels, exact
        self.known, self.new = b, []


def _tokens_of(words: _Words, model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the texts' tokens, with the start token before each text, and where each text begins."""
    if len(words) > CACHE_WORDS:
        words.forget()
    start, end = words[START], words[END]
    parts = []
    for text in texts:
        found = tokens(text)
        ids = np.empty(len(found) + 2, np.int64)
        ids[0], ids[-1] = start, end
        ids[1:-1] = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        parts.append(ids)
    words.learn(model)
    return np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])


def _rare(words: DataFrame, least) -> DataFrame:
    """(key, c) of the counted words that least(counts), an array of booleans, tells."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, c = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                there = least(c)
                yield pa.RecordBatch.from_arrays([pa.array(k[there]), pa.array(c[there])], ["key", "c"])

    return words.select("keys", "counts").mapInArrow(run, "key long, c long")


def in_blocks(rows: DataFrame, words: DataFrame, model, segments: int) -> DataFrame:
    """rows (id, t, held_out) by blocks of texts, each behind a row that holds the words of its block that the filter leaves out, with their levels."""
    import pyarrow as pa

    least = model.value.least_level
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(segments)).cast("int"))

    def ask(batches):
        for at, part in _parts(batches):
            m, keys = model.value, np.unique(_token_keys(part.column("t").to_pylist()))
            keys = keys[m.filter.levels(keys) < least]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), at, np.int32)), pa.array(keys.view(np.int64))], ["block", "key"])

    asked = blocks.select("block", "t").repartition("block").sortWithinPartitions("block").mapInArrow(task(ask), "block int, key long").distinct()
    found = asked.join(_rare(words, lambda c: levels_of(c) < least), "key")
    kept = found.groupBy("block").agg(F.collect_list("key").alias("keys"), F.collect_list("c").alias("counts"))
    texts = blocks.withColumns({"keys": F.lit(None).cast("array<long>"), "counts": F.lit(None).cast("array<long>")})
    left = kept.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("t"), F.lit(None).cast("boolean").alias("held_out"), "block", "keys", "counts")
    return texts.unionByName(left).repartition("block").sortWithinPartitions("block", F.col("keys").isNull(), "id", "t")


def _parts(batches):
    """(block, rows) of batches in order of their column block."""
    for batch in batches:
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield int(blocks[a]), batch.slice(a, b - a)


def _by_block(batches, words: _Words):
    """(whether a block begins, its texts' rows) of rows as in_blocks gives them, words being told what its filter leaves out; other batches as they are."""
    at = None
    for batch in batches:
        if "block" not in batch.schema.names:
            yield False, batch
            continue
        for block, part in _parts([batch]):
            fresh = block != at
            if fresh:
                at, words.left = block, (np.empty(0, np.uint64), np.empty(0, np.uint8))
                words.forget()
            kept = part.column("keys").is_valid()
            for keys, counts in zip(*(part.filter(kept).column(c).to_pylist() for c in ("keys", "counts")), strict=True):
                keys, counts = np.array(keys, np.int64).view(np.uint64), np.array(counts, np.int64)
                order = np.argsort(keys)
                words.left = keys[order], levels_of(counts[order]).astype(np.uint8)
            yield fresh, part.filter(part.column("keys").is_null())


def count_pairs(texts: DataFrame, model, segments: int) -> DataFrame:
    """(segment, blocks, bits, types, tokens, ones, twos) by ranges of keys: the filter of the bigrams' counts, and by level of the history
    the number of bigrams, of their occurrences, and of bigrams seen once and twice. model is broadcast.

    A bigram is known by the first 32 + log2(segments) bits of its key.
    """
    import pyarrow as pa

    bits = segments.bit_length() - 1
    low = _U(0xFFFFFFFF)

    def flush(held):
        packed = np.sort(np.concatenate(held))
        new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        n = np.diff(np.append(new, len(packed)))
        packed = packed[new]
        cuts = np.searchsorted(packed >> _U(38), np.arange(segments + 1, dtype=np.uint64))
        rows = []
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            part, times = packed[cuts[i] : cuts[i + 1]], n[cuts[i] : cuts[i + 1]]
            key, level, once = ((part >> _U(6)) & low).astype(np.uint32), (part & _U(63)).astype(np.uint8), times == 1
            rows.append((i, key[once].tobytes(), level[once].tobytes(), key[~once].tobytes(), level[~once].tobytes(), times[~once].astype(np.uint32).tobytes()))
        return _batch(rows, [pa.int32(), *[pa.binary()] * 5], ["segment", "once", "once_level", "more", "more_level", "times"])

    def pack(batches):
        m, words = model.value, one_cache("lm count", _Words)
        words.forget()
        held, size = [], 0
        for _, batch in _by_block(batches, words):
            for part in in_groups(batch.column(0).to_pylist(), GROUP_BYTES):
                ids, starts = _tokens_of(words, m, part)
                pair = np.ones(len(ids), bool)
                pair[starts] = False
                pair = np.flatnonzero(pair)
                keys = bigram_keys(words.keys[ids[pair - 1]], words.keys[ids[pair]]) >> _U(32 - bits)
                held.append((keys << _U(6)) | words.levels[ids[pair - 1]].astype(np.uint64))
                size += len(held[-1])
                if size >= max(FLUSH_TOKENS, 64 * segments):
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def merge(batches):
        for segment, parts in _by_key(batches, 6):
            joined = lambda k, lv: (np.concatenate([np.frombuffer(p[k], np.uint32) for p in parts]).astype(np.uint64) << _U(6)) | np.concatenate([np.frombuffer(p[lv], np.uint8) for p in parts])
            once, n = np.unique(joined(0, 1), return_counts=True)
            times = np.concatenate([np.frombuffer(p[4], np.uint32) for p in parts]).astype(np.int64)
            packed, n = _summed(np.concatenate([once, joined(2, 3)]), np.concatenate([n, times]))
            level = (packed & _U(63)).astype(np.int64)
            blocks = max(1, int(levels_of(n).sum()) * BITS_PER_ENTRY // 512 + 1)
            types, ones, twos = (np.bincount(level[x], minlength=64).tolist() for x in (slice(None), n == 1, n == 2))
            row = (segment, blocks, filled(mix(packed >> _U(6)), n, blocks), types, np.bincount(level, n, 64).astype(np.int64).tolist(), ones, twos)
            yield _batch([row], [pa.int32(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4], ["segment", "blocks", "bits", "types", "tokens", "ones", "twos"])

    dealt = texts.mapInArrow(task(pack), "segment int, once binary, once_level binary, more binary, more_level binary, times binary").repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(task(merge), "segment int, blocks long, bits binary, types array<long>, tokens array<long>, ones array<long>, twos array<long>")


def discounts(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The discount and the backed-off share of each level of a history's count, from all counts: n1 / (n1 + 2 n2), and discount * types / tokens."""
    names = ("types", "tokens", "ones", "twos")
    found = pairs.select(F.posexplode(F.arrays_zip(*names)).alias("level", "x")).groupBy("level").agg(*[F.sum(f"x.{c}").alias(c) for c in names]).collect()
    x = {c: np.zeros(64) for c in names}
    for r in found:
        for c in names:
            x[c][r["level"]] = r[c]
    discount = np.clip(x["ones"] / np.maximum(x["ones"] + 2 * x["twos"], 1), LEAST_DISCOUNT, MOST_DISCOUNT)
    share = np.where(x["tokens"] > 0, discount * x["types"] / np.maximum(x["tokens"], 1), 1.0)
    return discount, share


def pair_probability(count: np.ndarray, history: np.ndarray, one: np.ndarray, discount: np.ndarray, share: np.ndarray) -> np.ndarray:
    """P(word | history) of a pair seen `count` times, whose history is seen `history` times; one is the word's own probability."""
    seen = np.maximum(np.minimum(count, history) - discount, 0.0) / np.maximum(history, 1.0)
    return np.minimum(np.where(history > 0, seen + share * one, one), 1.0)


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows where held_out is false. Null and empty texts are the end token alone. Without training
    rows nothing is known and both scores are 0 or the log of the little that is left. Repeated rows repeat.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    folder = scratch_folder(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("t"), held_out.alias("held_out"))
    in_order = rows
    learned = rows.where(~F.col("held_out")).select("t")
    segments = _segments(rows.select("t"))
    words = staged(count_words(learned, segments))
    model = train_words(words, segments)
    shared = spark.sparkContext.broadcast(model)  # bounded by WORD_ENTRIES and HEAD_WORDS
    if model.least_level > 1:
        in_order = in_blocks(rows, words, shared, segments)
        learned = in_order.where("NOT held_out OR keys IS NOT NULL").drop("id", "held_out")
    pairs = staged(count_pairs(learned, shared, segments), folder)
    discount, share = discounts(pairs)
    bits, one, mean, of_level = segments.bit_length() - 1, model.one(), model.mean, level_counts()

    # rows of three kinds meet by segment: 0 its filter, 1 packed bigrams of many texts, 2 what is known of a text, dealt evenly
    names = ["row", "id", "held_out", "n_tokens", "known", "base", "rest", "kind", "first", "segment", "keys", "history", "word", "docs"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]

    def asked(first: int, n_docs: int, held: list[tuple]):
        """Rows of packed bigrams by ranges of their keys, each with its levels and its text's place behind the first."""
        keys, history, word, doc = (np.concatenate([h[i] for h in held]) for i in range(4))
        segment = keys >> _U(32)
        order = np.argsort(segment.astype(np.uint16) if segments <= 1 << 16 else segment, kind="stable")
        keys, history, word, doc = keys[order].astype(np.uint32), history[order], word[order], doc[order]
        doc = doc.astype(np.uint16 if n_docs <= 1 << 16 else np.uint32)
        cuts = np.searchsorted(segment[order], np.arange(segments + 1, dtype=np.uint64))
        none = (None,) * 7
        out = [(*none, 1, first, i, *(x[cuts[i] : cuts[i + 1]].tobytes() for x in (keys, history, word, doc))) for i in np.flatnonzero(np.diff(cuts)).tolist()]
        return _batch(out, types, names)

    def run(batches):
        m, found = shared.value, one_cache("lm score", _Words)
        found.forget()
        held, size, first, n_docs = [], 0, -1, 0
        for fresh, batch in _by_block(batches, found):
            if fresh and held:  # the block's row stands between the numbers of texts
                yield asked(first, n_docs, held)
                held, size, first, n_docs = [], 0, -1, 0
            ids, texts, outs, numbers = (batch.column(i).to_pylist() for i in (1, 2, 3, 0))
            at, out = 0, []
            for part in in_groups(texts, GROUP_BYTES):
                first = numbers[at] if first < 0 else first
                tok, starts = _tokens_of(found, m, part)
                doc = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(tok))))
                pair = np.ones(len(tok), bool)
                pair[starts] = False
                pair = np.flatnonzero(pair)
                doc, before, word = doc[pair], tok[pair - 1], tok[pair]
                keys = bigram_keys(found.keys[before], found.keys[word]) >> _U(32 - bits)
                held.append((keys, found.levels[before], found.levels[word], (doc + n_docs).astype(np.uint32)))
                size, n_docs = size + len(pair), n_docs + len(part)
                exact = found.exact[word]
                known = np.bincount(doc, exact > 0, len(part)).astype(np.int64).tolist()
                base = np.bincount(doc, np.log10(np.maximum(exact, 0) + 1.0), len(part)).tolist()
                lengths = np.bincount(doc, minlength=len(part)).tolist()
                rest = [[]] * len(part)
                if m.head_least:
                    cuts = np.cumsum(lengths)[:-1]
                    rest = [k[e < 0].astype(np.int64) for k, e in zip(np.split(found.keys[word], cuts), np.split(exact, cuts), strict=True)]
                out += [(numbers[at + i], ids[at + i], outs[at + i], lengths[i], known[i], base[i], rest[i], 2, None, (numbers[at + i]) % segments, None, None, None, None) for i in range(len(part))]
                at += len(part)
                if size >= max(FLUSH_TOKENS, 64 * segments):
                    yield asked(first, n_docs, held)
                    held, size, first, n_docs = [], 0, -1, 0
            yield _batch(out, types, names)
        if held:
            yield asked(first, n_docs, held)

    schema = "row long, id long, held_out boolean, n_tokens long, known long, base double, rest array<long>, kind int, first long, segment int, keys binary, history binary, word binary, docs binary"
    both = in_order.select(F.monotonically_increasing_id().alias("row"), "id", "t", "held_out", *in_order.columns[3:]).mapInArrow(task(run), schema)

    def probe(batches):
        """Sums by text of packed bigrams, which follow their segment's filter; rows of texts as they are."""
        at = filter_ = None
        for batch in batches:
            kinds = batch.column(7).to_numpy(zero_copy_only=False)
            asked = batch.filter(pa.array(kinds < 2))
            out = []
            for kind, first, segment, keys, history, word, doc in zip(*(asked.column(i).to_pylist() for i in range(7, 14)), strict=True):
                if kind == 0:
                    at, filter_ = segment, LogFrequencyFilter(np.frombuffer(keys, np.uint8), 1, first)
                    continue
                key = np.frombuffer(keys, np.uint32).astype(np.uint64)
                history, word, doc = np.frombuffer(history, np.uint8), np.frombuffer(word, np.uint8), np.frombuffer(doc, np.uint16 if len(doc) == 2 * len(word) else np.uint32)
                seen = of_level[filter_.levels(mix(key))] if at == segment else np.zeros(len(key))
                p = pair_probability(seen, mean[history], one[word], discount[history], share[history])
                there, where = np.unique(doc, return_inverse=True)
                out.append((first, there.astype(np.uint32).tobytes(), np.bincount(where, np.log10(p)).tobytes()))
            known = batch.filter(pa.array(kinds == 2))
            firsts, docs_, sums = zip(*out, strict=True) if out else ([], [], [])
            columns = [pa.concat_arrays([c.cast(t) if c.type != t else c, pa.nulls(len(out), t)]) for c, t in zip(known.columns[:7], types[:7], strict=True)]
            columns += [pa.concat_arrays([pa.nulls(len(known), t), pa.array(c, t)]) for c, t in zip((firsts, docs_, sums), (pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*names[:7], "first", "docs", "sums"])

    def add(batches):
        for first, parts in _by_key(batches, 3):
            doc, sums = (np.concatenate([np.frombuffer(p[i], t) for p in parts]) for i, t in ((0, np.uint32), (1, np.float64)))
            there, where = np.unique(doc, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64) + first), pa.array(np.bincount(where, sums))], ["row", "score"])

    nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(names[:7], ("long", "long", "boolean", "long", "long", "double", "array<long>"), strict=True)]
    filters = pairs.select(*nothing, F.lit(0).alias("kind"), F.col("blocks").alias("first"), "segment", F.col("bits").alias("keys"), *[F.lit(None).cast("binary").alias(c) for c in ("history", "word", "docs")])
    met = filters.unionByName(both).repartition("segment").sortWithinPartitions("segment", "kind")
    met = staged(met.mapInArrow(task(probe), "row long, id long, held_out boolean, n_tokens long, known long, base double, rest array<long>, first long, docs binary, sums binary"), folder)
    scored = staged(met.where("first IS NULL").select("row", "id", "held_out", "n_tokens", "known", "base", "rest"))
    scores = staged(met.where("first IS NOT NULL").select("first", "docs", "sums").repartition("first").sortWithinPartitions("first").mapInArrow(task(add), "row long, score double"))
    removed(spark, folder)

    least = model.head_least

    out = scored.drop("rest").join(scores, "row")
    if least:
        rest = _rare(words, lambda c: c < least)
        counted = scored.select("row", F.explode("rest").alias("key")).groupBy("row", "key").count()
        found = counted.join(rest, "key").groupBy("row").agg(F.sum("count").alias("known2"), F.sum(F.col("count") * F.log10(F.col("c") + 1.0)).alias("base2"))
        out = out.join(found, "row", "left")
    else:
        out = out.withColumns({"known2": F.lit(0), "base2": F.lit(0.0)})
    whole = math.log10(model.n + model.v + 1)
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
    )


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)

"""Alignment of two tokenizers: where tokens of both end together, and how often ids meet there in the whole corpus."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_groups, one_cache, sized_join, staged, table, task, text_bytes
from .encoding import byte_letters, default_tokenizer

#: What the byte-level tokenizer's own pattern takes as white space (Unicode's property), and the characters of it that texts are cut at.
WHITE, CUTS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))), " \n\t"
#: Marks that end words.
MARKS = ".,;:!?"
#: The pattern by which the byte-level tokenizer cuts a text before it merges. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units and windows that a worker keeps, in two generations of so many each; the bound never changes a result.
CACHE_UNITS, CACHE_WINDOWS = 220_000, 20_000
#: Units with which a worker waits for its next task; it lets go of more.
KEPT_UNITS = 60_000
#: Links after which a block is closed: the rows that one task of the last step holds are those of a block.
BLOCK_LINKS = 2_000_000
#: Bytes of texts whose unknown units are looked up together.
GROUP_BYTES = 1 << 20


class Kept:
    """A dictionary in two generations: a full one takes the place of the older, so that what is met often stays."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def put(self, key, value):
        if len(self.new) >= self.size:
            self.new, self.old = {}, self.new
        self.new[key] = value
        return value


class TwoTokenizers:
    """Ids of both tokenizers for the bytes of a space and a text.

    Both are run over the whole text, unit by unit: a unit begins at a blank, line end or tab that follows something
    other than white space. The first tokenizer's pattern has no match over such a place, and no piece of the second holds
    such a character further inside (`cuts` has only those for which that is so, which is looked up in its vocabulary), so a unit's ids
    are those it has in the text.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        others = byte_letters()
        letters = {others.get(byte, byte): byte for byte in range(256)}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[ord(c)] for c in token) if all(ord(c) in letters for c in token) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.text_a, self.text_b = [f"{i}|" for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]
        self.lengths_a, self.lengths_b = [len(t) for t in self.bytes_a], [len(t) for t in self.bytes_b]
        words = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        inner = {c for p in words for c in p.replace("▁", " ").lstrip(" ")}
        self.cuts = "".join(c for c in CUTS if c not in inner)
        other = "".join(c for c in WHITE if c not in self.cuts)
        cuts = re.escape(self.cuts)
        self.units = re.compile(rf"[{cuts}]*[^{cuts}]+(?:(?<=[{other}])[{cuts}]+[^{cuts}]*)*|[{cuts}]+").findall if " " in self.cuts else lambda text: [text]
        self.blank = self.b.piece_to_id("▁")
        self.ahead = self.b.encode("\n")  # what stands before a unit without a blank, so that nothing is put before it
        # marks behind a letter of the Latin script that no piece holds there and that the pattern parts from it: what ends in them is two units
        behind = {y for p in words for x, y in zip(p, p[1:], strict=False) if x.isalpha()}
        marks = re.escape("".join(c for c in MARKS if c not in behind)) if "\n" in self.cuts else ""
        self.tail = re.compile(rf"(.*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f])([{marks}]+)", re.DOTALL).fullmatch if marks else lambda unit: None
        # where ids are in the order of the merges, ranks of bytes say the same as the file and are faster for short units of letters that no version of Unicode disputes
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in json.loads(self.a.to_str())["model"]["merges"]]
        ids = [vocabulary.get(x + y, -1) for x, y in merges]
        ordered = all(i < j for i, j in zip(ids, ids[1:], strict=False)) and ids[:1] > [-1]
        self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.bytes_a) if t and i < len(merges) + 256}, special_tokens={}).encode_ordinary if ordered else None
        self.plain = re.compile("[\x20-\x7e\xa1-\u024f]{1,64}").fullmatch

    def ids(self, units: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of each unit by both, or None where their bytes are not those of the unit."""
        ranked, plain, bytes_a, bytes_b = self.ranked, self.plain, self.bytes_a, self.bytes_b
        side_b = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
        ahead, n_ahead = self.ahead, len(self.ahead)
        out: list[tuple[list[int], list[int]] | None] = []
        for u, b in zip(units, side_b, strict=True):
            a = ranked(u) if ranked and plain(u) else self.a.encode(u, add_special_tokens=False).ids
            if u == " ":
                b = [self.blank]
            elif u[0] != " ":
                b = b[n_ahead:] if b[:n_ahead] == ahead else [0]
            raw = u.encode()
            same = b"".join([bytes_a[i] for i in a]) == raw and b"".join([bytes_b[i] for i in b]) == raw
            out.append((a, b) if same else None)
        return out


class Alignments:
    """Alignments of units, and of the windows in them by the ids of both sides.

    A unit's entry is [stamp, places, counts, groups, pairs]: the block that met it last, the places of its pairs there, its tokens of both sides and
    links as one number (see unpacked), its groups as text, and for each link the ids' code a << 32 | b. Units whose bytes a tokenizer does not
    give back have the entry [].
    """

    def __init__(self, tokens: TwoTokenizers):
        self.tokens = tokens
        self.units = Kept(CACHE_UNITS)
        self.windows = Kept(CACHE_WINDOWS)

    def _window(self, a: tuple, b: tuple) -> tuple[str, list[int]]:
        key = (a, b)
        found = self.windows.new.get(key) or self.windows.old.get(key)
        if found is None:
            length_a, length_b = self.tokens.lengths_a.__getitem__, self.tokens.lengths_b.__getitem__
            text_a, text_b = self.tokens.text_a, self.tokens.text_b
            ends = {end: y for y, end in enumerate(accumulate(map(length_b, b)), 1)}
            groups, pairs, i, j = [], [], 0, 0
            for x, end in enumerate(accumulate(map(length_a, a)), 1):
                y = ends.get(end)
                if y is not None:
                    groups.append(text_a[a[i]] + text_b[b[j]] if x - i == 1 == y - j else f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
                    pairs.append(a[x - 1] << 32 | b[y - 1])
                    i, j = x, y
            found = (";".join(groups), pairs)
            if len(a) + len(b) <= 64:
                self.windows.put(key, found)
        return found

    def _windows(self, a: list[int], b: list[int]):
        """A unit's ids cut before tokens of both sides that are marked by a space and begin at the same byte, a shared end that the sums of lengths verify."""
        t = self.tokens
        starts, at = {}, 0
        for x, i in enumerate(a):
            if t.bytes_a[i][:1] == b" ":
                starts[at] = x
            at += t.lengths_a[i]
        from_a = from_b = at = 0
        for y, i in enumerate(b):
            if t.bytes_b[i][:1] == b" " and at in starts and y:
                yield tuple(a[from_a : starts[at]]), tuple(b[from_b:y])
                from_a, from_b = starts[at], y
            at += t.lengths_b[i]
        yield tuple(a[from_a:]), tuple(b[from_b:])

    def _entry(self, unit: str, ids) -> list:
        if ids is None:
            return []
        a, b = ids
        if unit.rfind(" ") <= 0:  # no token further inside is marked by a space
            groups, pairs = self._window(tuple(a), tuple(b))
        else:
            windows = [self._window(*w) for w in self._windows(a, b)]
            groups, pairs = ";".join([w[0] for w in windows]), [p for w in windows for p in w[1]]
        return [None, None, len(a) << 80 | len(b) << 40 | len(pairs), groups, pairs]

    @staticmethod
    def _both(first: list, second: list) -> list:
        """The entry of a unit that is two."""
        return [None, None, first[2] + second[2], f"{first[3]};{second[3]}", first[4] + second[4]] if first and second else []

    def entries(self, texts: list[bytes]) -> list[list[list] | None]:
        """The entries of each text's units in order, with a space before the text; None for texts that are empty or not UTF-8."""
        split: list[list[str] | None] = []
        for text in texts:
            try:
                split.append(self.tokens.units(" " + text.decode()) if text else None)
            except UnicodeDecodeError:
                split.append(None)
        new, old = self.units.new, self.units.old
        met = {u: old.get(u) for units in split if units for u in units if u not in new}
        cut = {u: m.groups() for u, e in met.items() if e is None and (m := self.tokens.tail(u))}
        for parts in cut.values():
            for u in parts:
                if u not in met:
                    met[u] = new.get(u) or old.get(u)
        missing = [u for u, e in met.items() if e is None and u not in cut]
        for u, ids in zip(missing, self.tokens.ids(missing) if missing else [], strict=True):
            met[u] = self._entry(u, ids)
        for u, (word, marks) in cut.items():
            met[u] = self._both(met[word], met[marks])
        get, other = new.get, met.get
        out = [[get(u) or other(u, []) for u in units] if units else None for units in split]
        for u, e in met.items():
            if len(u) <= 64:
                self.units.put(u, e)
        return out


    def trim(self) -> None:
        if len(self.units.new) + len(self.units.old) > KEPT_UNITS:
            self.units, self.windows = Kept(CACHE_UNITS), Kept(CACHE_WINDOWS)


def unpacked(counts: int) -> tuple[int, int, int]:
    """(n_a, n_b, n_links) of summed counts."""
    return counts >> 80, counts >> 40 & 0xFFFFFFFFFF, counts & 0xFFFFFFFFFF


_ROWS = "block long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, place int, pair long, times long"


def align_texts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Rows of documents, and between them rows of the id pairs that they link, block by block; see documents_of and pairs_of.

    A document has doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (or the groups themselves, with keep_groups) and
    links: for each link the place of its pair among the block's pairs, so a pair is told once a block. A block is documents one after
    another, closed at block_links links. Null, empty, undecodable texts and texts that a tokenizer does not give back have zeros and ''.
    Repeated rows and ids are aligned each; ids may be null; very long texts are aligned whole and close their block; other columns are not
    looked at, whatever their names.
    """
    import pyarrow as pa

    path_a, path_b = path_a or default_tokenizer("byte_bpe_50k.json"), path_b or default_tokenizer("piece_bpe_32k.model")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(F.col(f"`{text_col}`")).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]

    owner, make = f"alignment {path_a} {path_b}", lambda: Alignments(TwoTokenizers(path_a, path_b))

    def run(batches):
        import gc

        gc.disable()  # the caches are many small lists without cycles, which it would walk over and over
        try:
            yield from aligned(batches)
        finally:
            gc.enable()
            one_cache(owner, make).trim()

    def aligned(batches):
        from pyspark import TaskContext

        known = one_cache(owner, make)
        stamp: object = object()
        block = TaskContext.get().partitionId() << 32
        places: dict[int, int] = {}
        times = np.zeros(0, np.int64)
        linked = 0
        names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "place", "pair", "times"]
        types = [pa.int64(), pa.null(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64()]

        def made(columns: list) -> pa.RecordBatch:
            n = next(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def closed():
            nonlocal places, times, linked, block, stamp
            pairs = list(places)
            for i in range(0, len(pairs), 10_000):
                part = pairs[i : i + 10_000]
                yield made([[block] * len(part), None, None, None, None, None, None, None, np.arange(i, i + len(part)), part, times[i : i + len(part)]])
            places, times, linked, block, stamp = {}, np.zeros(0, np.int64), 0, block + 1, object()

        def row(doc_id, entries):
            nonlocal linked, times
            if entries is None or not all(entries):
                return block, doc_id, 0, 0, 0, 0, "", []
            for e in entries:
                if e[0] is not stamp:
                    e[0], e[1] = stamp, [places.setdefault(p, len(places)) for p in e[4]]
            links = np.array([p for e in entries for p in e[1]], np.int32)
            if len(times) < len(places):
                times = np.concatenate([times, np.zeros(len(places), np.int64)])
            times += np.bincount(links, minlength=len(times))
            n_a, n_b, n_links = unpacked(sum([e[2] for e in entries]))
            linked += n_links
            groups = ";".join([e[3] for e in entries])
            return block, doc_id, n_a, n_b, n_links, n_links, groups if keep_groups else hashlib.sha256(groups.encode()).hexdigest(), links

        for batch in batches:
            types[1] = batch.schema.field("doc_id").type
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for group in in_groups(texts, GROUP_BYTES):
                out = []
                for entries in known.entries(group):
                    out.append(row(ids[at], entries))
                    at += 1
                    if linked >= block_links:
                        yield made([*map(list, zip(*out, strict=True)), None, None, None])
                        yield from closed()
                        out = []
                if out:
                    yield made([*map(list, zip(*out, strict=True)), None, None, None])
        yield from closed()

    return rows.mapInArrow(task(run, keep_cache=True), _ROWS.format(id=kind))


def documents_of(aligned: DataFrame) -> DataFrame:
    """The documents' rows of staged alignments."""
    return aligned.where("pair IS NULL").drop("place", "pair", "times")


def pairs_of(aligned: DataFrame) -> DataFrame:
    """(block, place, pair, times): the pairs that each block's documents link."""
    return aligned.where("pair IS NOT NULL").select("block", "place", "pair", "times")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best) over all blocks: count is the number of links of the pair, best whether no pair with the same second id has more.

    The highest counts are one row an id of the second tokenizer, which its vocabulary bounds.
    """
    counts = staged(pairs.groupBy("pair").agg(F.sum("times").alias("count")))
    second = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(second.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", second).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """Documents of staged alignments with n_best and count_sum.

    A block's pairs meet the counts by a join, one row a pair and block instead of one a link, and go back to their block's
    documents; blocks are bounded by align_texts.
    """
    import pyarrow as pa

    pairs = pairs_of(aligned)
    told = sized_join(pairs, staged(pair_counts(pairs)), ["pair"]).select(F.col("block").alias("of_block"), "place", "count", "best")
    docs = documents_of(aligned)
    out = [c for c in docs.columns if c not in ("block", "links")]

    def run(left, right):
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        links = left.column("links").combine_chunks()
        flat = links.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(links.value_lengths().fill_null(0).to_numpy())])
        kept = left.select(out)
        for name, x in (("n_best", best), ("count_sum", count)):
            upto = np.concatenate([[0], np.cumsum(x[flat])])
            kept = kept.append_column(name, pa.array(np.diff(upto[ends]), pa.int64()))
        return kept

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*out).dtypes) + ", n_best long, count_sum long"
    return docs.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(run, schema)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_counts(staged(align_texts(table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

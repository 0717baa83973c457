"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty labels spans."""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from functools import cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_groups, one_cache, remainder, slices, table, task, text_bytes
from .lm_scores import mix

#: Most documents per language that the word model is fitted on; which ones is decided by a hash of their text.
SAMPLE_DOCS = 448
SAMPLE_PARTS = 64
#: One in so many parts measures how well a model of the others fits texts of its language; the model itself has them all.
HELD_PARTS = 8
#: Longest character n-grams of the word model, and the pseudo-count of unseen ones.
ORDER, SMOOTHING = 4, 0.5
#: Cost, in nats, of changing the language between two words.
SWITCH = 9.0
#: Words whose vectors are worked out at once: each of their n-grams takes a number a language meanwhile.
LEARN_WORDS = 4_096
UNKNOWN = "und"

# First code point of each script's range, by Unicode blocks; ranges end where the next begins. Fixed values.
SCRIPT_STARTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"),
    (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "cherokee"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"),
    (0x2E80, "han"), (0x3040, "kana"), (0x3130, "hangul"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "yi"), (0xA640, "cyrillic"), (0xA720, "latin"), (0xAC00, "hangul"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
)
_STARTS = [s for s, _ in SCRIPT_STARTS]
SCRIPTS = sorted({"other", *(name for _, name in SCRIPT_STARTS)})
# Letters only: \w also holds number characters such as fractions and superscripts.
LETTER = regex.compile(r"\p{L}")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_U, _ODD = np.uint64, np.uint64(0x9E3779B97F4A7C15)


def script_of(letter: str) -> str:
    at = bisect_right(_STARTS, ord(letter)) - 1
    return SCRIPT_STARTS[at][1] if at >= 0 else "other"


class _Rows:
    """Rows of 64-bit keys, for many keys at once: a table of slots, where a key takes the next free one."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = _U(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.rows[at[left]] < 0]
            put = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[put]], self.rows[at[put]] = keys[put], rows[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)

    def rows_of(self, keys: np.ndarray, missing: int) -> np.ndarray:
        at = self._slot(keys)
        found = self.rows[at]
        look = np.flatnonzero((self.keys[at] != keys) & (found >= 0))
        while len(look):
            at[look] = (at[look] + 1) & self.last
            found[look] = self.rows[at[look]]
            look = look[(self.keys[at[look]] != keys[look]) & (found[look] >= 0)]
        found[found < 0] = missing
        return found


class LanguageModel:
    """Log-probability vectors of words, one entry a language."""

    def __init__(self, counts: list[tuple[str, str, int, int]]):
        """counts: (lang, gram, n, held), held being the part of n from the documents that `fit` is measured on."""
        self.langs = sorted({lang for lang, *_ in counts})
        where = {lang: i for i, lang in enumerate(self.langs)}
        totals = np.zeros((ORDER + 1, len(self.langs)))
        table_: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        held_: dict[str, np.ndarray] = {}
        held_totals = np.zeros((ORDER + 1, len(self.langs)))
        for lang, gram, n, held in counts:
            held_.setdefault(gram, np.zeros(len(self.langs)))[where[lang]] += held
            held_totals[len(gram), where[lang]] += held
            table_.setdefault(gram, np.zeros(len(self.langs)))[where[lang]] += n
            totals[len(gram), where[lang]] += n
            for letter in gram.strip("<>")[:1]:
                scripts.setdefault(script_of(letter), np.zeros(len(self.langs)))[where[lang]] += n
        kinds = np.bincount([len(g) for g in table_], minlength=ORDER + 1) if table_ else np.ones(ORDER + 1)
        # the first rows are for n-grams of length 2, 3, ... that were never seen
        unseen = [np.log(SMOOTHING / (totals[n] + SMOOTHING * (kinds[n] + 1))) for n in range(2, ORDER + 1)]
        seen = [np.log((c + SMOOTHING) / (totals[len(g)] + SMOOTHING * (kinds[len(g)] + 1))) for g, c in table_.items()]
        self.table = np.array(unseen + seen)
        self.row = {g: i + ORDER - 1 for i, g in enumerate(table_)}
        self.found = []
        for n in range(2, ORDER + 1):
            grams = [g for g in table_ if len(g) == n]
            letters = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
            keys = letters[:, 0]
            for i in range(1, n):
                keys = keys * _ODD + letters[:, i]
            self.found.append(_Rows(keys, np.array([self.row[g] for g in grams], np.int64)))
        self.key = uuid.uuid4().hex
        self._calibrate(table_, totals, held_, held_totals, kinds)
        share = {s: c / np.maximum(totals[2:].sum(0), 1) for s, c in scripts.items()}
        self.scripts = {s: np.where(c >= 0.01, 0.0, -50.0) for s, c in share.items() if (c >= 0.01).any()}

    def _calibrate(self, table_, totals, held_, held_totals, kinds) -> None:
        """usual and noise: log-probability a letter of documents that the model without them has not seen, and of random letters of the language.

        A language with no such documents, or hardly any others, is not measured: both are nan.
        """
        k = len(self.langs)
        self.usual, self.noise = np.full(k, np.nan), np.full(k, np.nan)
        rest = totals - held_totals
        of = lambda c, n: np.log((c + SMOOTHING) / (rest[n] + SMOOTHING * (kinds[n] + 1)))
        scores = np.array([of(0, n) for n in range(2, ORDER + 1)] + [of(c - held_[g], len(g)) for g, c in table_.items()])
        all_held = np.array([np.zeros(k)] * (ORDER - 1) + list(held_.values()))
        rng = np.random.default_rng(0)
        for i in range(k):
            if held_totals[:, i].sum() and rest[:, i].sum() > held_totals[:, i].sum():
                letters = sorted({x for g, c in table_.items() if c[i] for x in g.strip("<>")})
                words = ["".join(rng.choice(letters, n)) for n in rng.integers(3, 11, 1000)]
                rows = np.fromiter(chain.from_iterable(map(self.gram_rows, words)), np.int64)
                usual, noise = (all_held[:, i] * scores[:, i]).sum() / all_held[:, i].sum(), scores[rows, i].mean()
                if usual > noise:
                    self.usual[i], self.noise[i] = usual, noise

    def fit(self, lang: int, value: float) -> float:
        """0 to 1: where a log-probability a letter lies between random letters and the usual of the language; 1 if that is not measured."""
        low, high = self.noise[lang], self.usual[lang]
        return 1.0 if math.isnan(low) else float(min(1.0, max(0.0, (value - low) / (high - low))))

    def gram_rows(self, word: str) -> list[int]:
        """Rows of `table` for the n-grams of a lower-case word; the row n - 2 where an n-gram is unseen."""
        get, w = self.row.get, f"<{word}>"
        return [get(w[i : i + n], n - 2) for n in range(2, ORDER + 1) for i in range(len(w) - n + 1)]

    def words(self, words: list[str]) -> np.ndarray:
        """A vector a word: log-probabilities summed over its n-grams of all orders, averaged over the orders, and its script's mask, less the
        greatest; then that greatest, and the word's letters, below 0 for a word whose script no language uses; its other numbers are 0 then."""
        if not words:
            return np.empty((0, len(self.langs) + 2))
        rows = [self.gram_rows(w.lower()) for w in words]
        starts = np.cumsum([0, *map(len, rows[:-1])])
        scripts = np.array([SCRIPTS.index(script_of(w[0])) for w in words])
        return self._summed(np.fromiter(chain.from_iterable(rows), np.int64), starts, scripts, np.fromiter(map(len, words), np.float64, len(words)))

    def _summed(self, rows: np.ndarray, starts: np.ndarray, scripts: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The vectors of words from the rows of their n-grams: those of a word begin at its place in starts."""
        scores = np.add.reduceat(self.table[rows], starts, axis=0) / (ORDER - 1)
        masks = np.array([self.scripts.get(s, np.zeros(len(self.langs))) for s in SCRIPTS])
        scores += masks[scripts]
        most = scores.max(axis=1, keepdims=True)
        letters = letters[:, None]
        met = np.array([s in self.scripts for s in SCRIPTS])[scripts][:, None]
        return np.hstack([np.maximum(scores - most, -60.0) * met, most * met, np.where(met, letters, -letters)])

    def vectors(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The vectors, as `words` has them, of the words at these places of a text of code points."""
        out = np.empty((len(starts), len(self.langs) + 2))
        for at in range(0, len(starts), LEARN_WORDS):
            part = slice(at, at + LEARN_WORDS)
            out[part] = self._vectors(points, starts[part], ends[part])
        return out

    def _vectors(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, scripts, lower = code_points()
        n = ends - starts + 2  # with the signs of its start and end
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        letters = lower[points[np.clip(np.repeat(starts - 1, n) + place, 0, len(points) - 1)]].astype(np.uint64)
        letters[first], letters[first + n - 1] = ord("<"), ord(">")
        left = np.repeat(n, n) - place
        each = [np.maximum(n - size + 1, 0) for size in range(2, ORDER + 1)]
        total = np.sum(each, axis=0)
        begin = np.cumsum(total) - total
        rows, at, keys = np.empty(total.sum(), np.int64), begin.copy(), letters
        for size, number in zip(range(2, ORDER + 1), each, strict=True):
            keys = keys[:-1] * _ODD + letters[size - 1 :]
            there = np.flatnonzero(left[: len(keys)] >= size)
            rows[np.repeat(at, number) + place[there]] = self.found[size - 2].rows_of(keys[there], size - 2)
            at += number
        out = self._summed(rows, begin, scripts[points[starts]], (n - 2).astype(np.float64))
        odd = np.flatnonzero(np.minimum.reduceat(letters, first) == 0)
        if len(odd):
            out[odd] = self.words([points[starts[i] : ends[i]].tobytes().decode("utf-32-le") for i in odd])
        return out


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word: the sum of scores less `switch` per change; ties keep the language, then the smaller index."""
    n, k = scores.shape
    # A path's stretches off the best single language gain over it what `run` grows by. With that language in the path each of them costs a
    # change, so none pays if no stretch gains more than a change costs. Without it the first is a prefix and the last a suffix of the
    # text, and there is one change less than stretches, so none pays if the best prefix and suffix together gain no more either.
    best = int(scores.sum(0).argmax())
    run = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.vstack([np.zeros((1, k)), np.minimum(np.minimum.accumulate(run, axis=0), 0.0)[:-1]]) if n else run
    if n and (run - low).max() <= switch and run.max() + (run[-1] - low).max() <= switch:
        return np.full(n, best)
    if not n:
        return np.empty(0, np.int64)
    value, steps = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        moved = top - switch
        steps.append((value, moved, top))
        value = [(v if v >= moved else moved) + s for v, s in zip(value, row, strict=True)]
    at = value.index(max(value))
    path = [at]
    for before, moved, top in reversed(steps):
        if before[at] < moved:
            at = before.index(top)
        path.append(at)
    return np.array(path[::-1], np.int64)


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """A model from at most sample_docs (rounded up to whole parts) documents of each language; rows without text or language teach nothing."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    spread = known.withColumn("h", F.xxhash64("text")).withColumn("part", F.pmod("h", F.lit(SAMPLE_PARTS)))
    few = Window.partitionBy("lang", "part").orderBy("h", "text")  # in parts, so that no language meets in one task
    chosen = spread.withColumn("r", F.row_number().over(few)).where(F.col("r") <= -(-sample_docs // SAMPLE_PARTS))
    held = (F.col("part") % HELD_PARTS == 0).cast("long").alias("held")
    # the words that a text is labelled by: letters with their marks, in pieces where a script has no blanks
    pieces = lambda w: F.when(w.rlike(UNSPACED_WORD), F.regexp_extract_all(w, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))).otherwise(F.array(w))
    found = F.flatten(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}[\p{L}\p{M}]*+)"), F.lit(1)), pieces))
    words = chosen.select("lang", held, F.explode(found).alias("w"))
    words = words.groupBy("lang", "w").agg(F.count("*").alias("count"), F.sum("held").alias("held")).withColumn("g", F.concat(F.lit("<"), "w", F.lit(">")))
    sizes = F.sequence(F.lit(2), F.lit(ORDER))
    every = F.flatten(F.transform(sizes, lambda n: F.when(F.length("g") >= n, F.transform(F.sequence(F.lit(1), F.length("g") - n + 1), lambda i: F.substring(F.col("g"), i, n))).otherwise(F.array().cast("array<string>"))))
    counts = words.select("lang", "count", "held", F.explode(every).alias("gram")).groupBy("lang", "gram").agg(F.sum("count").alias("n"), F.sum("held").alias("held"))
    return LanguageModel([tuple(r) for r in counts.collect()])  # bounded by the sample


#: A run of letters of one script is a word; scripts written without blanks between words are cut into pieces of so many letters.
PIECE = 4
SCRIPTS_FROM = chr(0x0370)  # all letters below are Latin
UNSPACED_WORD = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}\p{IsYi}]"
UNSPACED = ("han", "kana", "thai", "lao", "khmer", "myanmar", "tibetan", "yi")


def words_in(chunk: str) -> list[tuple[int, int]]:
    """(start, end) of the words of a run without white space: runs of letters and their marks, cut where the script changes."""
    if chunk.isascii() or max(chunk) < SCRIPTS_FROM:
        if chunk.isalpha():
            return [(0, len(chunk))]
        return [m.span() for m in WORD.finditer(chunk)]
    found = []
    for m in WORD.finditer(chunk):
        start, script = m.start(), script_of(m[0][0])
        for i in range(m.start(), m.end()):
            now = script_of(chunk[i]) if LETTER.match(chunk[i]) else script
            if now != script and not {now, script} <= {"han", "kana"} or script in UNSPACED and i - start >= PIECE:
                found.append((start, i))
                start, script = i, now
        found.append((start, m.end()))
    return found


@cache
def code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: kind (1 for a letter, 2 for a mark, else 0), its script as an index into SCRIPTS, and its lower-case code point, 0 where that
    is not one or depends on the neighbours."""
    every = "".join(map(chr, range(0x110000)))
    kind, lower = np.zeros(len(every), np.uint8), np.arange(len(every), dtype=np.uint32)
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{M}+")):
        for m in regex.finditer(pattern, every):
            kind[m.start() : m.end()] = value
    for at in np.flatnonzero(kind).tolist():
        small = every[at].lower()
        lower[at] = ord(small) if len(small) == 1 else 0
    lower[ord("\u03a3")] = 0  # another letter at the end of a word
    ranges = np.array([SCRIPTS.index("other"), *(SCRIPTS.index(name) for _, name in SCRIPT_STARTS)], np.uint8)
    return kind, ranges[np.searchsorted(_STARTS, np.arange(len(every)), "right")], lower


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text of code points, as words_in has them."""
    kinds, scripts, _ = code_points()
    kind = kinds[points]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], kind > 0, [False]])))
    starts, ends = edges[::2], edges[1::2]
    letters = np.flatnonzero(kind == 1)
    if not len(letters):
        return letters, letters
    for i in np.flatnonzero(kind[starts] == 2).tolist():  # marks before the first letter belong to no word
        at = np.searchsorted(letters, starts[i])
        starts[i] = min(letters[at], ends[i]) if at < len(letters) else ends[i]
    starts, ends = starts[starts < ends], ends[starts < ends]
    if points.max() < ord(SCRIPTS_FROM):
        return starts, ends

    script = np.where(scripts == SCRIPTS.index("kana"), SCRIPTS.index("han"), scripts)  # not cut between these
    of_letter = script[points[letters]]
    changes = letters[1:][of_letter[1:] != of_letter[:-1]]
    run = np.searchsorted(starts, changes, "right") - 1
    mixed = np.zeros(len(starts), bool)
    mixed[run[changes > starts[run]]] = True
    unspaced = np.isin(script[points[starts]], [SCRIPTS.index(x) for x in UNSPACED])
    n = np.where(unspaced & ~mixed, -(-(ends - starts) // PIECE), 1)
    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first, last = np.repeat(starts, n) + piece * PIECE, np.repeat(ends, n)
    last = np.where(np.repeat(n, n) > 1, np.minimum(first + PIECE, last), last)
    if not mixed.any():
        return first, last
    cut = [(a + x, a + y) for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True) for x, y in words_in(points[a:b].tobytes().decode("utf-32-le"))]
    plain = ~np.repeat(mixed, n)
    first, last = (np.concatenate([whole[plain], np.array(parts, np.int64)]) for whole, parts in zip((first, last), zip(*cut, strict=True), strict=True))
    order = np.argsort(first, kind="stable")
    return first[order], last[order]


def same_words(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, the same for equal words, and for each number the first word that has it. Words are told apart by 64-bit keys."""
    import pyarrow as pa

    n = ends - starts
    offsets = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(offsets, n)
    letters = points[np.repeat(starts, n) + place].astype(np.uint64)
    found = pa.array(np.add.reduceat(mix((place.astype(np.uint64) << _U(32)) + letters + _U(1)), offsets)).dictionary_encode()
    rows = found.indices.to_numpy()
    first = np.empty(len(found.dictionary), np.int64)
    first[rows[::-1]] = np.arange(len(rows))[::-1]
    return rows, first


class Labeller:
    """Labels texts by a model; the words of the texts that are labelled together get their vectors once. Nothing is kept of earlier texts."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.vectors = np.empty((0, len(model.langs) + 2))
        self._of_words: tuple = (np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64))

    @property
    def words(self) -> dict[str, int]:
        """The different words of the texts labelled last, with their rows in `vectors`."""
        points, starts, ends = self._of_words
        return {points[a:b].tobytes().decode("utf-32-le"): i for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))}

    def label_all(self, texts: list[bytes]) -> list[tuple[str, float, str]]:
        """(language, score, spans) of each text."""
        if not self.model.langs:
            return [(UNKNOWN, 0.0, "")] * len(texts)
        whole = [t.decode("utf-8", "replace") for t in texts]
        points = np.frombuffer("\n".join(whole).encode("utf-32-le"), np.uint32)
        starts, ends = word_spans(points)
        if not len(starts):
            return [(UNKNOWN, 0.0, "")] * len(texts)
        rows, first = same_words(points, starts, ends)
        self._of_words = points, starts[first], ends[first]
        self.vectors = self.model.vectors(*self._of_words)
        base = np.cumsum([0, *(len(t) + 1 for t in whole)])
        cuts = np.searchsorted(starts, base).tolist()
        return [self._label(points, at, rows[a:b], starts[a:b], ends[a:b]) for at, a, b in zip(base.tolist(), cuts, cuts[1:], strict=False)]

    def _label(self, points: np.ndarray, base: int, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[str, float, str]:
        """The label of a text from the rows and places of its words; the text begins at `base`."""
        langs = self.model.langs
        if not len(rows):
            return UNKNOWN, 0.0, ""
        vectors = self.vectors[rows]
        scores, most, letters, known = vectors[:, :-2], vectors[:, -2], vectors[:, -1], vectors[:, -1] > 0
        total_letters = np.abs(letters).sum()
        if not known.any():  # no letter of a script that the model has met: the likeliest language, without any evidence
            return langs[int(scores.sum(0).argmax())], 0.0, ""
        letters = np.maximum(letters, 0.0)
        path, total = viterbi(scores), scores.sum(0)
        if (path == path[0]).all():
            top, share, end = int(path[0]), float(letters.sum() / total_letters), int(ends[-1])
            while code_points()[0][points[end - 1]] != 1:  # without the marks behind the last letter
                end -= 1
            spans = f"{int(starts[0]) - base}:{end - base}:{langs[top]}"
        else:
            by_lang = np.bincount(path, letters, len(langs))
            top = int(by_lang.argmax())
            share = float(by_lang[top] / total_letters)
            cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            spans = ",".join(f"{int(starts[x]) - base}:{int(ends[y - 1]) - base}:{langs[path[x]]}" for x, y in zip(cut, cut[1:], strict=False))
        others = np.delete(total, top)
        margin = float(total[top] - others.max()) if len(others) else 50.0
        mine = path == top
        fit = self.model.fit(top, float((most[mine] + scores[mine, top]).sum() / max(letters[mine].sum(), 1.0)))
        return langs[top], share * fit * (1.0 - 0.5 * math.exp(-max(0.0, min(margin, 50.0)))), spans


def labeller_for(model: LanguageModel) -> Labeller:
    """One labeller a process and model, so that its caches outlive a task."""
    return one_cache(f"language {model.key}", lambda: Labeller(model))


#: Texts labelled together, in bytes.
LABEL_BYTES = 2 << 20


def label(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score, spans ('start:end:lang' in code points, comma-joined).

    A null text, one without letters, or a model that has learned nothing gives 'und', 0.0 and no spans; letters of
    scripts alone that the model has not met give the likeliest language with 0.0 and no spans. A document's language is the one with the most letters; ties go to the first by code point.
    score is its share of the letters, times its fit to the model, times 0.5 to 1 by its lead over the next language.
    Repeated rows repeat their results.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "id long, lang_pred string, score double, spans string"

    def run(batches):
        labeller = labeller_for(shared.value)
        for batch in slices(batches):
            out = [x for part in in_groups(batch.column(1).to_pylist(), LABEL_BYTES) for x in labeller.label_all(part)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.string())], ["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("t"))
    return rows.mapInArrow(task(run, keep_cache=True), schema).withColumnRenamed("id", id_col)


#: Least score that a document needs to stay; random letters score near 0, half-mixed texts near 0.5, common ones near 1.
LEAST_SCORE = 0.3


def keep_known(docs: DataFrame, model: LanguageModel, least: float = LEAST_SCORE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose language is known with at least that score; a null language is filled in.

    Null texts, texts without letters and texts in scripts that the model has not met go. A model that has learned nothing rejects only those.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        labeller = labeller_for(shared.value)
        for batch in slices(batches):
            keep, langs, texts = [], [], batch.column(at).to_pylist()
            labels = [x for part in in_groups([(t or "").encode("utf-8", "replace") for t in texts], LABEL_BYTES) for x in labeller.label_all(part)]
            for text, lang, (found, score, _) in zip(texts, batch.column(lang_at).to_pylist(), labels, strict=True):
                keep.append(score >= least if found != UNKNOWN else not labeller.model.langs and bool(LETTER.search(text or "")))
                langs.append(lang if lang is not None or found == UNKNOWN else found)
            columns = list(batch.columns)
            columns[lang_at] = pa.array(langs, batch.schema.field(lang_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task(run, keep_cache=True), docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held_out))
    return label(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")

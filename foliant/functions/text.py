"""Text semantics as Column expressions; `portable` forms mean the same in other SQL engines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[^\p{L}\p{N}_]+"
NOT_TOKEN = r"[^\p{L}\p{N}]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?:\+[0-9]{1,3} ?)?\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}"
LEGAL_FORM = r"(?i)\b(gmbh|ug|ag|kg|ohg|gbr|se|ltd|llc|inc|sarl)\b"


def ascii_fold(c: Column) -> Column:
    """A-Z to a-z and nothing else, as a NOCASE comparison does."""
    return F.translate(c, UPPER, LOWER)


def like_literal(c: Column, needle: str) -> Column:
    """Contains, with A-Z folded on both sides and no wildcards in the needle."""
    return ascii_fold(c).contains(needle.translate(str.maketrans(UPPER, LOWER)))


def identity_key(c: Column) -> Column:
    """Lower case, runs of non-word characters to one space, trimmed (portable form)."""
    return F.trim(F.regexp_replace(F.lower(c), NOT_WORD, " "))


def strict_fold(c: Column) -> Column:
    """NFKC and casefold, which SQL functions do not offer; in Arrow batches."""

    @F.pandas_udf("string")
    def fold(values):
        return values.str.normalize("NFKC").str.casefold()

    return fold(c)


def strict_identity_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(strict_fold(c), NOT_WORD, " "))


def search_tokens(c: Column) -> Column:
    """Search tokens in order: runs of letters and digits, A-Z folded."""
    return F.filter(F.split(ascii_fold(c), NOT_TOKEN), lambda t: F.length(t) > 0)


def token_line(c: Column) -> Column:
    """Tokens joined by spaces, with a space at both ends: phrase search is then contains."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_fold(c), NOT_TOKEN, " ")), F.lit(" "))


def has_prefix_tokens(c: Column, words: list[str]) -> Column:
    """Every word begins some token."""
    folded, out = ascii_fold(c), F.lit(True)
    for w in words:
        out &= folded.rlike(rf"(^|{NOT_TOKEN[:-1]})" + re.escape(w.translate(str.maketrans(UPPER, LOWER))))
    return out


def collapse(c: Column) -> Column:
    """Lower case, runs of space, tab, CR and LF to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n]+", " "))


def family_key(c: Column) -> Column:
    """Hash of the collapsed text; empty for an empty one."""
    return F.transform(F.array(collapse(c)), lambda t: F.when(t == "", F.lit("")).otherwise(F.sha2(t, 256)))[0]  # collapsed once


def document_key(source: Column, path: Column, separator: str = "|") -> Column:
    return F.sha2(F.concat(source, F.lit(separator), path), 256)


def emails(c: Column) -> Column:
    """Addresses in order, trailing dots stripped."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({EMAIL})"), F.lit(1)), lambda m: F.regexp_replace(m, r"\.+$", ""))


def email_domain(c: Column) -> Column:
    return F.lower(F.substring_index(c, "@", -1))


def phones(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({PHONE})"), F.lit(1))


def column_letters(n: Column) -> Column:
    """Spreadsheet column letters of a number from 1 on, in bijective base 26, up to three letters."""
    letter = lambda x: F.chr(x + 65)
    last, rest = (n - 1) % 26, F.floor((n - 1) / 26)
    middle, first = (rest - 1) % 26, F.floor((rest - 1) / 26)
    return F.concat(F.when(first > 0, letter(first - 1)).otherwise(""), F.when(rest > 0, letter(middle)).otherwise(""), letter(last))


def excerpt(c: Column, most: int = 600) -> Column:
    return F.substring(c, 1, most)


def document_priority(name: Column, body: Column, important: list[str], cues: list[str], technical: list[str]) -> Column:
    """Points of a document by its name and its head of 12 000 characters, which is all that counts here.

    15 per important word in the name and 4 in the head, 5 per cue in the head, 10 off per technical word in the name and 2 in the
    head, and a point for each 100 letters of the head up to 5.
    """
    head = strict_fold(F.substring(body, 1, 12_000))
    points = F.lit(0)
    for words, where, n in ((important, strict_fold(name), 15), (important, head, 4), (cues, head, 5), (technical, strict_fold(name), -10), (technical, head, -2)):
        for w in words:
            points += F.when(where.contains(w), n).otherwise(0)
    return points + F.floor(F.least(F.length(F.regexp_replace(F.substring(body, 1, 12_000), r"[^\p{L}]", "")), F.lit(500)) / 100).cast("int")


def ascii_has(c: Column, word: str) -> Column:
    """Contains, with A-Z folded on both sides, without a folded copy of the text; for words of ASCII."""
    return c.rlike("(?i)" + re.escape(word))


def letters_to(c: Column, most: int) -> Column:
    """The number of letters of a text, or `most` where it has more: what follows a head with so many letters is not counted."""
    count = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    head = F.substring(c, 1, 4 * most)
    return F.when(F.length(c) <= 4 * most, F.least(count(c), F.lit(most))).when(count(head) >= most, F.lit(most)).otherwise(F.least(count(c), F.lit(most)))


def priority(text: Column, important: list[str], cues: list[str], technical: list[str]) -> Column:
    """The portable form of document_priority, without a name and over the whole text but for the cues: A-Z folded only."""
    head = F.substring(text, 1, 12_000)
    points = F.lit(0)
    for words, where, n in ((important, text, 4), (cues, head, 5), (technical, text, -2)):
        for w in words:
            points += F.when(ascii_has(where, w), n).otherwise(0)
    return points + F.floor(letters_to(text, 500) / 100).cast("int")


#: What reading a file can come to. Fixed values.
EXTRACTION_STATUSES = ("ok", "partial", "no_text", "unsupported", "too_large", "encrypted", "tool_missing", "timeout", "error")


def display_number(value: Column, mask: Column) -> Column:
    """A number as its sheet shows it where the mask only pads a whole number with zeros; else plain, whole numbers without a fraction."""
    first = F.regexp_replace(F.regexp_replace(F.substring_index(mask, ";", 1), '"', ""), r"\\\\", "")
    whole = value == F.floor(value)
    plain = F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))
    zeros = F.length(F.regexp_replace(first, "[^0]", ""))
    digits = F.lpad(F.abs(F.floor(value)).cast("string"), zeros, "0")
    fits = whole & first.rlike(r"^[0 ()+/-]+$") & (zeros > 0) & (F.length(F.abs(F.floor(value)).cast("string")) <= zeros)
    # each 0 of the mask takes the next digit: the number of zeros up to a place is the digit's
    places = F.sequence(F.lit(1), F.length(first))
    letter = lambda i: F.substr(first, i, F.lit(1))
    filled = F.transform(places, lambda i: F.when(letter(i) == "0", F.substr(digits, F.length(F.regexp_replace(F.substr(first, F.lit(1), i), "[^0]", "")), F.lit(1))).otherwise(letter(i)))
    return F.when(fits, F.concat(F.when(value < 0, "-").otherwise(""), F.array_join(filled, ""))).otherwise(plain)


def version_hash(*parts: Column) -> Column:
    """Hash of texts parted by NUL: a document's version under a parser's fingerprint."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def record_hash(*columns: str) -> Column:
    """Hash of a record's JSON with its fields in order of their names; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)

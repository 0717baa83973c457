"""Secret scans: name-literal pairs from source and configuration syntax, with constants propagated and literals scored by their target's name."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, task, text_bytes

# Base patterns, fixed by the contract: kind, pattern, least length of the measured group.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "named", "constant")

#: Words of a target's name that make its literal sensitive, with their weight.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "authorization": 0.8, "bearer": 0.8, "auth": 0.6, "key": 0.4,
}
#: A literal is reported from this score on: name weight times strength of the literal.
THRESHOLD = 0.45

# The lexer: a target (bare, quoted, dotted or dashed), an assignment sign, and a value made of literals, names and '+'.
# Possessive repeats and a name taken as one token, with or without a sign behind it, keep the scan linear at any length.
NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
PAIR = re.compile(rf"""(?<![A-Za-z0-9_])(?P<name>{NAME})(?P<sign>(?P<q>["']?)(?:[ \t]*+:[ \t]*+[A-Za-z_][A-Za-z0-9_.<>\[\]|]*+(?=[ \t]*+=))?[ \t]*+(?::=|=>|=(?!=)|:(?!:|//))[ \t]*+)?+""")
PREFIX = r"(?:(?i:[bf]r?|r[bf]?|u8?|l)|\$)?"
VALUE = re.compile(
    rf"""(?P<joined>[ \t]*+\+[ \t]*+)"""
    rf"""|{PREFIX}\"{{3}}(?P<double3>(?:[^"\\]++|\\.|"(?!""))*+)\"{{3}}|{PREFIX}'{{3}}(?P<single3>(?:[^'\\]++|\\.|'(?!''))*+)'{{3}}"""
    rf"""|{PREFIX}"(?P<double>(?:[^"\n\\]++|\\.)*+)"|{PREFIX}'(?P<single>(?:[^'\n\\]++|\\.)*+)'"""
    rf"""|{PREFIX}"(?P<double_lines>(?:[^"\\]++|\\.)*+)"|{PREFIX}'(?P<single_lines>(?:[^'\\]++|\\.)*+)'"""
    rf"""|\$\{{?(?P<ref>{NAME})\}}?|(?P<bare>[A-Za-z0-9+/_.=\-]++)""",
    re.S,
)
#: Frame lines of keys, and line breaks as such or written as escapes, with the indent behind: no part of a literal's strength.
FRAME = re.compile(r"-----[A-Z0-9 ]++-----|(?:\\r|\\n|\\?[\r\n])[ \t]*+")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")


def name_weight(name: str) -> float:
    """The greatest weight among the name's words and pairs of neighbouring words."""
    words = [w.lower() for w in CAMEL.findall(name)]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *(a + b for a, b in zip(words, words[1:], strict=False))]), default=0.0)


class Value(NamedTuple):
    """What is kept of a value: how often each character occurs, its first characters, the span of the literals in its own assignment
    (-1 without any), and the numbers of the assignments that its names stand for.

    Values grow by being joined; counts stay as small as the alphabet, however often a text joins a value with itself.
    """

    counts: Counter
    head: str
    start: int = -1
    end: int = -1
    needs: tuple[int, ...] = ()

    def joined(self, other: Value) -> Value:
        spans = [v for v in (self, other) if v.start >= 0]
        start, end = min((v.start for v in spans), default=-1), max((v.end for v in spans), default=-1)
        return Value(self.counts + other.counts, (self.head + other.head)[:16], start, end, self.needs + other.needs)


def literal(text: str, start: int, end: int) -> Value:
    part = FRAME.sub("", text[start:end])
    return Value(Counter(part), part[:16], start, end)


def strength(value: Value) -> float:
    """0 to 1: bits of the literal by its own character frequencies, against 40 bits; placeholders and addresses have none.

    Words parted by blanks may be a passphrase: their bits count half, and not at all with the marks of a sentence.
    """
    counts, n = value.counts, sum(value.counts.values())
    if n < 8 or set(counts) <= set("x*.-_<>") or value.head.startswith(("${", "<", "http://", "https://")):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n) * min(n, 1 << 20)  # counts of joined values may be beyond any float
    if counts[" "]:
        return 0.0 if counts[" "] < 2 or any(counts[c] for c in ".,:;!?()%{}<>") else min(1.0, bits / 80)
    lower, upper = any(c.islower() for c in counts), any(c.isupper() for c in counts)
    mixed = any(c.isdigit() or c in "+/=_-" for c in counts) or lower and upper
    return min(1.0, bits / 40) * (1.0 if mixed else 0.6)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def assignments(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(target name, parts) of each assignment, in order; parts are ('literal' or 'name', start, end), quoted parts joined by '+' in one list."""
    found = []
    at = 0
    while m := PAIR.search(text, at):
        if m["sign"] is None or m["q"] and text[m.start() - 1 : m.start()] != m["q"]:
            at = m.end("name")
            continue
        at = start = m.end()
        parts, joined = [], True
        while v := VALUE.match(text, at):
            if v["joined"] is not None:
                if joined:
                    break
                joined, at = True, v.end()
                continue
            if not joined:
                break
            kind = v.lastgroup
            a, b = v.span(kind)
            if kind.endswith(("_lines", "3")):  # it may hold pairs of its own, or its quote may be a stray one: it is read for pairs as well
                parts.append(("literal", a, b))
                at = a
                break
            named = kind == "ref" or kind == "bare" and IDENTIFIER.match(v[kind])
            parts.append(("ref" if kind == "ref" else "name" if named else "literal", a, b))
            joined, at = False, v.end()
        if parts:
            found.append((m["name"], parts))
        at = max(at, start)
    return found


def values_of(text: str, found: list[tuple[str, list[tuple[str, int, int]]]]) -> list[Value | None]:
    """The value of each assignment.

    Constants are propagated both ways: a name stands for the value assigned to it last before the place it is used, or, where there
    is none, first after it; a bare name that is never assigned stands for itself, a reference `$NAME` or `${NAME}` for nothing. Names that
    lead back to themselves end there.
    """
    places: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(found):
        places.setdefault(name, []).append(i)

    def meant(name: str, i: int) -> int | None:
        at = places.get(name)
        if at is None:
            return None
        before = bisect_left(at, i)
        after = at[before + (before < len(at) and at[before] == i)] if before + (before < len(at) and at[before] == i) < len(at) else None
        return at[before - 1] if before else after

    values: list[Value | None] = [None] * len(found)
    state = [0] * len(found)  # 1: begun, 2: known
    for first in range(len(found)):
        todo = [first]
        while todo:
            i = todo[-1]
            if state[i] == 2:
                todo.pop()
                continue
            name, parts = found[i]
            needs = [meant(text[a:b], i) for kind, a, b in parts if kind != "literal"]
            if state[i] == 0:
                state[i] = 1
                todo += [j for j in needs if j is not None and state[j] == 0]
                continue
            whole: Value | None = None
            for kind, a, b in parts:
                j = None if kind == "literal" else meant(text[a:b], i)
                part = values[j] if j is not None and state[j] == 2 else None
                if part is not None:
                    part = Value(part.counts, part.head, needs=(j,))
                elif kind != "ref" and j is None:
                    part = literal(text, a, b)
                if part is not None:
                    whole = part if whole is None else whole.joined(part)
            values[i], state[i] = whole, 2
            todo.pop()
    return values


def method_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the literals behind names that reach the threshold; kind constant where they came through another name."""
    if "=" not in text and ":" not in text:
        return []
    found = assignments(text)
    values = values_of(text, found)
    spans, todo = set(), []
    for (name, _), value in zip(found, values, strict=True):
        weight = name_weight(name)
        if value is not None and weight and weight * strength(value) >= THRESHOLD:
            if value.start >= 0:
                spans.add((value.start, "named", value.end))
            todo += value.needs
    seen = set()
    while todo:
        i = todo.pop()
        if i not in seen:
            seen.add(i)
            if values[i].start >= 0:
                spans.add((values[i].start, "constant", values[i].end))
            todo += values[i].needs
    return list(spans)


def ordered(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_spans and spans ('kind:start:end', code points, by start).

    Null and empty texts have no spans; repeated rows give repeated results; a null id is carried. An empty table
    gives no rows. Texts are read once from left to right, each span's length is bounded only by the text.
    """
    import pyarrow as pa

    names = ["id", "n_assign", "n_access", "n_hex", "base_spans", "spans"]

    def scan(batches):
        for batch in slices(batches):
            out = []
            for raw in batch.column(1).to_pylist():
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                kinds = Counter(k for _, k, _ in base)
                out.append((kinds["assign"], kinds["access"], kinds["hex"], ordered(base), ordered(base + method_spans(text))))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("t"))
    schema = "id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"
    return rows.mapInArrow(task(scan), schema).withColumnRenamed("id", id_col)


def mask_spans(text: str, spans: list[tuple[int, str, int]], mask: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """docs with the secrets of its text column masked; all other columns, null texts and clean texts stay as they are.

    chars_col, if given, holds the number of code points and follows the masked text.
    """
    import pyarrow as pa

    where = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col else -1

    def mask(batches):
        for batch in slices(batches):
            columns = list(batch.columns)
            texts = columns[where].to_pylist()
            chars = columns[chars_at].to_pylist() if chars_col else []
            for i, text in enumerate(texts):
                if text is not None and (found := base_spans(text) + method_spans(text)):
                    texts[i] = mask_spans(text, found)
                    if chars_col:
                        chars[i] = len(texts[i])
            columns[where] = pa.array(texts, batch.schema.field(where).type)
            if chars_col:
                columns[chars_at] = pa.array(chars, batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(task(mask), docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")

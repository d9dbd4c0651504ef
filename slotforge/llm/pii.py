"""Personal data, with disguises undone and spans kept in source characters (operator 2).

Base spans come from four fixed patterns, leftmost and non-overlapping for each kind. The method adds spans: a
chain of transducers rewrites the text (homoglyphs and full-width forms to ASCII, spelled digits to digits, at/dot
disguises to ``@`` and ``.``), each keeping for every output character the source range it stands for; the same
patterns then run on the normalised text, and what they find is mapped back. An added span never replaces a base
span: one that overlaps a base span of its kind is dropped. Only texts with a trace of a disguise are rewritten.

Work and memory grow with a text's length, whatever it holds. Cases: null or empty text has no spans (the digest is that of the empty string); each row, repeated or with a null
id, is judged alone; of added spans of a kind that overlap the first stays; an empty table gives an empty result; other columns are not read (``redact`` keeps them).
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm import textops

KINDS = ("email", "ip", "card", "phone")
SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Where a run of digits fails as an address, so do its tails: no digit stands before a match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """The pattern ``local@domain``, from its at signs: each match holds exactly one."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def _phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


_FINDERS = dict(zip(KINDS, (_emails, _ips, _cards, _phones), strict=True))


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; code points, end exclusive."""
    return [(kind, a, b) for kind in KINDS for a, b in _FINDERS[kind](text)]


#: Letters that look like ASCII ones, beside what compatibility forms (full-width, mathematical) give.
HOMOGLYPHS = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABEKMHOPCTYXaeopcyxijsdhABEZHIKMNOPTYXoav", strict=True))
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5",
    "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5",
    "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "|".join(sorted(DIGITS, key=len, reverse=True))
#: Spelled digits count in runs of at least four, possibly after "plus" or among digits.
_SPELLED = re.compile(rf"(?i)(?:\b(?:plus|\+)[ -])?\b(?:(?:{_NUMBER}|[0-9])[ ,.-]{{1,2}}){{3,}}(?:{_NUMBER}|[0-9])\b")
_SPELLED_ONE = re.compile(rf"(?i)\bplus[ -]|[ ,.-]*({_NUMBER}|[0-9])")
#: Blanks before a match are taken with it.
_AT = re.compile(r"(?i)(?:[\[({<]\s*+(?:at|arroba|ät|chez)\s*+[\])}>])\s*+|(?<=[A-Za-z0-9])\s++at\s++(?=[A-Za-z0-9-]++(?:\s*+[\[({<]\s*+dot|\s++dot\s))")
_DOT = re.compile(r"(?i)[\[({<]\s*+(?:dot|punkt|point|punto)\s*+[\])}>]\s*+|(?<=[A-Za-z0-9])\s++dot\s++(?=[A-Za-z0-9])")
#: A trace of a disguise; without one the text is its own normal form.
_TRACE_AT = re.compile(r"(?i)[\[({<]\s*+(?:at|arroba|ät|chez|dot|punkt|point|punto)\s*+[\])}>]|\sat\s++\S++\s++dot\s")
_TRACE_DIGITS = re.compile(rf"(?i)\b(?:{_NUMBER})[ ,.-]{{1,2}}(?:{_NUMBER}|[0-9])\b")


class Traced:
    """A text with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.at = text, np.arange(len(text), dtype=np.int64)
        self.to = self.at + 1

    def rewrite(self, pattern: re.Pattern, put, blanks: bool = False) -> None:
        """Each match (with ``blanks``, and the blanks before it) becomes put(match), whose characters stand for all of it."""
        out, at, to, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            new, start, end = put(m), m.start(), m.end()
            if new is None or end == start:
                continue
            while blanks and start > last and self.text[start - 1].isspace():
                start -= 1
            out += [self.text[last:start], new]
            at += [self.at[last:start], np.full(len(new), self.at[start])]
            to += [self.to[last:start], np.full(len(new), self.to[end - 1])]
            last = end
        self.text = "".join(out) + self.text[last:]
        self.at, self.to = np.concatenate([*at, self.at[last:]]), np.concatenate([*to, self.to[last:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.at[start]), int(self.to[end - 1])


@functools.lru_cache(maxsize=1 << 12)
def _plain(c: str) -> str:
    """The ASCII character that a character looks like, or itself."""
    new = HOMOGLYPHS.get(c) or unicodedata.normalize("NFKC", c)
    return new if new.isascii() and new.isprintable() and len(new) == 1 else c


_STRANGE = re.compile("[Ͱ-ԯ -⁯①-⓿＀-￯\U0001d400-\U0001d7ff]")


def _spelled(m: re.Match) -> str:
    found = m[0].lstrip().lower()
    plus = "+" if found.startswith(("plus", "+")) else ""
    return plus + "".join(DIGITS.get(x, x) for x in re.findall(rf"{_NUMBER}|[0-9]", found.removeprefix("plus")))


def normalise(text: str) -> Traced | None:
    """The text with disguises undone, or None where it has none."""
    glyphs = not text.isascii() and _STRANGE.search(text)
    lower = text.lower() if glyphs else text
    if not glyphs and not _TRACE_AT.search(lower) and not _TRACE_DIGITS.search(lower):
        return None
    traced = Traced(text)
    if glyphs:
        traced.text = _STRANGE.sub(lambda m: _plain(m[0]), text)  # one for one: places stay
    traced.rewrite(_SPELLED, _spelled)
    traced.rewrite(_AT, lambda m: "@", blanks=True)
    traced.rewrite(_DOT, lambda m: ".", blanks=True)
    return traced


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans)."""
    base, others = _both(text)
    ends = {kind: [d for k, _, d in base if k == kind] for kind in KINDS}
    starts = {kind: [c for k, c, _ in base if k == kind] for kind in KINDS}
    added, last = [], dict.fromkeys(KINDS, 0)
    for kind, a, b in others:
        # spans of a kind do not overlap and both lists are in order: the first base span that ends after a decides
        near = bisect.bisect_right(ends[kind], a)
        if a >= last[kind] and (near == len(ends[kind]) or starts[kind][near] >= b):
            added.append((kind, a, b))
            last[kind] = b
    return base, added


def _both(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the text, and those of its normal form where that is another, in characters of the text."""
    base, traced = detect(text), normalise(text)
    if traced is None or traced.text == text:
        return base, []
    return base, [(kind, *traced.source(a, b)) for kind, a, b in detect(traced.text)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def scan(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of base spans by kind, their digest and all spans, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, 1):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    base, added = find(text or "")
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    rows.append((doc, *counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(base + added), len(added)))
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                kinds = [pa.string() if "string" in c else pa.int64() for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return textops.keyed(docs, {"doc_id": id_column, "text": text_column}).mapInArrow(textops.releasing(run), SCHEMA)


def mask(text: str) -> str:
    """The text with personal data replaced by its kind in angle brackets.

    Spans of the text and of its normal form count alike here: what overlaps is one stretch, and is replaced as a whole,
    so that no disguised part of an identifier is left beside the plain one. It is named by its first and longest span.
    """
    merged: list[list] = []
    base, others = _both(text)
    for kind, a, b in sorted(base + others, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, last = [], 0
    for kind, a, b in merged:
        out += [text[last:a], f"<{kind}>"]
        last = b
    return "".join(out) + text[last:]


def redact(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """All columns and rows, with personal data in the text replaced; a null text stays null."""
    textops.bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(mask, na_action="ignore")

    return docs.withColumn(text_column, run(F.col(f"`{text_column}`")))

"""Personal data in texts: identifiers as written, and identifiers behind disguises.

Transducers undo look-alike letters, spelled digits and at/dot disguises one after the other. Each keeps, for
every character it writes, the range of characters it read; so a span found in the normalised text is
mapped back to the characters of the source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column_or

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind string, start int, end int, base boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits does; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at + 1), at
        if domain:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            done = domain.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(zip(KINDS, (_emails, _ips, _cards, _phones), strict=True))

# Letters of other scripts that look like a Latin letter, and that letter.
_ALIKE = {
    "а": "a", "в": "B", "е": "e", "к": "k", "м": "M", "н": "H", "о": "o", "р": "p", "с": "c", "т": "T", "у": "y", "х": "x",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "і": "i", "І": "I", "ј": "j", "Ј": "J", "ѕ": "s", "Ѕ": "S", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u", "հ": "h",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹢": "+", " ": " ",
    "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
}
#: Characters that only a disguise would put into an identifier; full-width forms stand 0xFEE0 above ASCII.
_ODD = re.compile("[" + re.escape("".join(_ALIKE)) + "！-～٠-٩۰-۹०-९\U0001d7ce-\U0001d7ff]")

# The digits in words.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_GLUE = r"(?:[\s,]+|\s*-\s*)"
_UNIT = rf"(?:{_WORD}|[0-9]+)"
#: Digits in words, with digits, "plus" and "dot" among them; which of these count as a disguise, _spelled decides.
_RUN = re.compile(rf"\b(?:plus{_GLUE})?{_UNIT}(?:{_GLUE}(?:dot{_GLUE})?{_UNIT})+\b", re.IGNORECASE)
#: What every run that counts has: "plus" before a digit, or a digit in words beside another part of the run.
_HINT = re.compile(rf"\bplus{_GLUE}{_UNIT}|\b{_WORD}{_GLUE}(?:dot\b|{_UNIT})|(?:[0-9]|\bdot){_GLUE}{_WORD}\b", re.IGNORECASE)

# White space is only taken from where it begins, which keeps long runs of it linear.
_OPEN, _CLOSE = r"(?:(?<!\s)\s+)?[\[({<]\s*", r"\s*[\])}>]\s*"
_AT = re.compile(rf"{_OPEN}(?:at|@|arroba|ät){_CLOSE}", re.IGNORECASE)
_DOT = re.compile(rf"{_OPEN}(?:dot|\.|punkt|punto|point){_CLOSE}", re.IGNORECASE)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", re.IGNORECASE)
#: A bare "at" counts only before a host name that ends in a common top-level domain.
_BARE_AT = re.compile(r"(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:com|org|net|edu|gov|io|de|fr|es|info|co)\b)", re.IGNORECASE)
_DISGUISE = re.compile(r"[\[({<]\s*(?:at|@|arroba|ät|dot|\.|punkt|punto|point)\s*[\])}>]|\s(?:at|dot)\s", re.IGNORECASE)


class Tracked:
    """A text and, for each of its characters, the range of the source it stands for and whether it is new."""

    def __init__(self, text: str) -> None:
        self.text, n = text, len(text)
        self.start, self.end, self.new = np.arange(n), np.arange(1, n + 1), np.zeros(n, dtype=bool)

    def replaced(self, pattern: re.Pattern, write: Callable[[re.Match], str]) -> Tracked:
        parts, starts, ends, news, done = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            out, (a, b) = write(m), m.span()
            if a == b or out == m[0]:
                continue
            parts += [self.text[done:a], out]
            starts += [self.start[done:a], np.full(len(out), self.start[a])]
            ends += [self.end[done:a], np.full(len(out), self.end[b - 1])]
            news += [self.new[done:a], np.ones(len(out), dtype=bool)]
            done = b
        if not done:
            return self
        result = Tracked("")
        result.text = "".join([*parts, self.text[done:]])
        result.start, result.end = np.concatenate([*starts, self.start[done:]]), np.concatenate([*ends, self.end[done:]])
        result.new = np.concatenate([*news, self.new[done:]])
        return result


def _plain(m: re.Match) -> str:
    c = m[0]
    if c in _ALIKE:
        return _ALIKE[c]
    return chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else str(unicodedata.digit(c))


def _spelled(m: re.Match) -> str:
    """A run written in digits if it begins with "plus" or has two words and more, one of them a digit: "one" alone is no disguise."""
    units = re.findall(r"\w+", m[0].lower())
    out = [{"plus": "+", "dot": "."}.get(unit) or _SPELLED.get(unit, unit) for unit in units]
    words = sum(a != b for a, b in zip(units, out, strict=True))
    counts = units[0] == "plus" or (words > 1 and any(unit in _SPELLED for unit in units))
    return "".join(out) if counts and sum(len(x) for x in out) >= 4 else m[0]


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Identifiers that show only once disguises are undone, as spans of ``text``."""
    odd = not text.isascii() and _ODD.search(text) is not None
    tracked = Tracked(text) if odd else None
    if odd:
        tracked = tracked.replaced(_ODD, _plain)
    now = tracked.text if tracked else text
    for hint, steps in (
        (_HINT, [(_RUN, _spelled)]),
        (_DISGUISE, [(_DOT, lambda m: "."), (_AT, lambda m: "@"), (_BARE_DOT, lambda m: "."), (_BARE_AT, lambda m: "@")]),
    ):
        if hint.search(now):
            tracked = tracked or Tracked(text)
            for pattern, write in steps:
                tracked = tracked.replaced(pattern, write)
            now = tracked.text
    if tracked is None:
        return []
    changed = np.concatenate(([0], np.cumsum(tracked.new)))
    found = [(kind, a, b, int(tracked.start[a]), int(tracked.end[b - 1])) for kind, find in FINDERS.items() for a, b in find(tracked.text)]
    # Nothing is written for a removed character, but the source's range is longer by it.
    return [(kind, start, end) for kind, a, b, start, end in found if changed[b] > changed[a] or end - start > b - a]


def personal_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) in code points by start, then kind; those that only undoing shows are not base.

    Base spans stay; an undone span stands beside one that it overlaps unless the base span covers it.
    """
    if not text:
        return []
    base = [(kind, a, b, True) for kind, find in FINDERS.items() for a, b in find(text)]
    more = []
    for kind, a, b in disguised(text):
        if not any(k == kind and s <= a and b <= e for k, s, e, _ in base):
            more.append((kind, a, b, False))
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans, a null doc_id stays null, repeated rows give repeated rows; further
    columns are ignored and an empty table gives an empty result.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in personal_spans(text.as_py())]
                for text in column_or(batch, "text")
            ]
            yield pa.RecordBatch.from_arrays([column_or(batch, "doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with [EMAIL], [IP], [CARD] or [PHONE] in place of each span of its text; other columns stay.

    Overlapping spans become one, named by the first. A null text stays null; n_chars, if there, is counted anew.
    """

    def clean(text: str | None) -> str | None:
        parts, done = [], 0
        for kind, a, b, _ in personal_spans(text):
            if a >= done:
                parts += [text[done:a], f"[{kind.upper()}]"]
            done = max(done, b)
        return "".join([*parts, text[done:]]) if parts else text

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = pa.array([clean(x.as_py()) for x in batch.column(k)], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), texts)

    out = docs.mapInArrow(rewrite, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

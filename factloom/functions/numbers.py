"""Numbers, magnitudes, currencies, percentages and units as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import SPACE, blank_to_null, let

# Magnitude words, currency names and number words, in the order that breaks ties of length.
MAGNITUDES = {
    "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "crore": 1e7, "crores": 1e7, "cr": 1e7, "thousand": 1e3, "thousands": 1e3,
    "000": 1e3, "m": 1e6, "mn": 1e6, "mm": 1e6, "million": 1e6, "millions": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "billions": 1e9,
    "t": 1e12, "tn": 1e12, "trillion": 1e12, "trillions": 1e12,
}
CURRENCIES = {
    "$": "USD", "us$": "USD", "usd": "USD", "us dollar": "USD", "us dollars": "USD", "u.s. dollar": "USD", "u.s. dollars": "USD",
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "£": "GBP", "gbp": "GBP", "pound sterling": "GBP", "pounds sterling": "GBP",
    "¥": "JPY", "jpy": "JPY", "yen": "JPY", "inr": "INR", "₹": "INR", "rupee": "INR", "rupees": "INR", "cad": "CAD",
    "canadian dollar": "CAD", "aud": "AUD", "australian dollar": "AUD",
}
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
FILLERS = "percent|percentage|approximately|approx|about|around|rs|inr|usd"
PERCENT_METRICS = "growth|margin|rate|share|比例|ratio"

LONGEST_MAGNITUDES = sorted(MAGNITUDES, key=lambda x: -len(x))
LONGEST_CURRENCIES = sorted(CURRENCIES, key=lambda x: -len(x))
NUMBER = r"[-+]?\d*\.?\d+"


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


#: A magnitude word that stands alone or after a digit, wherever it does.
_ANY_MAGNITUDE = rf"(?<=^|{SPACE}|[0-9])(?:{'|'.join(LONGEST_MAGNITUDES)})(?=$|{SPACE}|[,.])"


def _pairs(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def magnitude_label(text: Column) -> Column:
    """The longest magnitude word that stands alone or after a digit; null if there is none."""
    places = _pairs({name: k for k, name in enumerate(LONGEST_MAGNITUDES, 1)})
    found = F.regexp_extract_all(F.lower(_text(text)), F.lit(_ANY_MAGNITUDE), F.lit(0))
    names = F.array(*map(F.lit, LONGEST_MAGNITUDES))
    return let(found, lambda x: F.when(F.size(x) > 0, F.element_at(names, F.array_min(F.transform(x, lambda y: places[y])))))


def magnitude(text: Column) -> Column:
    """What a number with this text is multiplied by."""
    return F.coalesce(_pairs(MAGNITUDES)[magnitude_label(text)], F.lit(1.0))


def normalize_currency(value: Column, context: Column | None = None) -> Column:
    """ISO code of the longest currency name contained in value or context."""
    both = F.lower(F.concat(_text(value), F.lit(" "), _text(context if context is not None else F.lit(""))))
    low = F.trim(F.regexp_replace(both, SPACE + "+", " "))
    return let(low, lambda x: F.coalesce(*[F.when(F.contains(x, F.lit(name)), CURRENCIES[name]) for name in LONGEST_CURRENCIES]))


def number_words(text: Column) -> Column:
    """The sum of number words; null if any word is another."""
    table = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, float(v))])
    words = F.split(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), SPACE + "+")
    return F.aggregate(F.transform(words, lambda w: table[w]), F.lit(0.0), lambda total, x: total + x)


def is_numeric_text(text: Column) -> Column:
    """Whether nothing is left but one plain number once currencies, magnitudes and fillers are taken away."""

    def without_currencies(x: Column) -> Column:
        bare = reduce(lambda y, name: F.replace(y, F.lit(name), F.lit(" ")), LONGEST_CURRENCIES, x)
        return F.when(x.rlike("|".join(map(re.escape, CURRENCIES))), bare).otherwise(x)

    def without_magnitudes(x: Column) -> Column:
        bare = reduce(lambda y, name: F.regexp_replace(y, f"(^|[^a-z]){name}([^a-z]|$)", "$1 $2"), LONGEST_MAGNITUDES, x)
        return F.when(x.rlike(f"(^|[^a-z])({'|'.join(LONGEST_MAGNITUDES)})([^a-z]|$)"), bare).otherwise(x)

    def plain(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(x, rf"\b({FILLERS})\b", " "), f"[%,()]|{SPACE}", "")
        return bare.rlike(rf"^{NUMBER}$")

    # What holds no digit leaves no number; what holds no such word is not searched for each of them.
    checked = let(F.lower(_text(text)), lambda x: F.when(x.rlike("[0-9]"), let(without_currencies(x), lambda y: plain(without_magnitudes(y)))))
    return F.coalesce(checked, F.lit(False))


def normalize_number(number: Column, text: Column, unit: Column) -> Column:
    """A tagged value (number, or text where that is null) in units of one; null for texts that are no quantity."""

    def parsed(trimmed: Column) -> Column:
        words = number_words(F.trim(F.regexp_replace(trimmed, r"(?i)\b(percent|percentage)\b", "")))
        found = F.regexp_extract(F.replace(trimmed, F.lit(","), F.lit("")), f"({NUMBER})", 1).try_cast("double")
        scale = magnitude(F.concat(trimmed, F.lit(" "), _text(unit)))
        quantity = let(words, lambda w: F.when(w.isNotNull() | is_numeric_text(trimmed), F.coalesce(found, w) * scale))
        return F.when(trimmed != "", quantity)

    return F.when(number.isNotNull(), number * magnitude(unit)).otherwise(let(F.trim(_text(text)), parsed))


def normalize_percentage(number: Column, text: Column, unit: Column, predicate: Column, value_type: Column, parsed: Column | None = None) -> Column:
    """A share as a fraction, for values that a sign, the metric or the type marks as such; else null.

    ``parsed`` is the value's normalize_number, where that is at hand.
    """
    marked = F.lower(F.concat(_text(text), F.lit(" "), _text(unit))).rlike("%|percent")
    by_metric = F.lower(_text(predicate)).rlike(PERCENT_METRICS)
    by_type = F.lower(_text(value_type)) == "percentage"
    bare = (_text(predicate) == "") & F.coalesce(number.between(0, 1), F.lit(False))
    parsed = normalize_number(number, text, unit) if parsed is None else parsed
    return F.when(marked | by_metric | by_type | bare, let(parsed, lambda x: F.when(x > 1, x / 100).otherwise(x)))


def normalize_unit(unit: Column, text: Column) -> Column:
    """percent, currency, null for magnitudes, else the unit itself."""
    both = F.lower(F.concat(_text(unit), F.lit(" "), _text(text)))
    return (
        F.when(both.rlike("%|percent"), "percent")
        .when(normalize_currency(unit, text).isNotNull(), "currency")
        .when(magnitude_label(unit).isNull(), blank_to_null(F.lower(F.trim(_text(unit)))))
    )


def relative_difference(left: Column, right: Column) -> Column:
    """|left - right| over the larger of both sizes, at least 1; null if either is."""
    # greatest() skips nulls, the subtraction does not
    return F.abs(left - right) / F.greatest(F.abs(left), F.abs(right), F.lit(1.0))


def clamped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))

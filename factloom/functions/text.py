"""Text normalisation as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of the Web: Java's class and the Unicode spaces.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Java tests a class of several ranges by a chain of calls that slows down the more threads of an executor run it. So patterns pass
# over most characters, and over single spaces that would only be replaced by one, by a plain range first.
_RUN = r"(?! ?[!-~])" + SPACE + "+"
_DASHED = "(?![a-z])(?! )[-‐-―−]" + SPACE + "+"
_SIGNS = "(?! ?[a-z])(?! ?[0-9])[^a-z0-9%]+"

# Names of the reporting entity itself, legal forms, metric and scope synonyms.
SELF_NAMES = ("the company", "company", "the group")
LEGAL_FORMS = ("incorporated", "inc", "corp", "corporation", "ltd", "limited", "plc")
PREDICATE_ALIASES = {
    "sales revenue": "revenue", "total revenue": "revenue", "net sales": "revenue", "gross profit": "gross_profit",
    "net income": "net_income", "net earnings": "net_income", "operating income": "operating_income",
    "growth rate": "growth", "growth": "growth",
}
SCOPE_ALIASES = {
    "worldwide": "global", "international": "global", "north america": "north_america", "united states": "us", "u s": "us",
    "consolidated": "consolidated",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _RUN, " "))


def is_blank(text: Column) -> Column:
    """Whether ``collapse_space`` would leave nothing; null counts as blank."""
    return ~F.coalesce(text, F.lit("")).rlike("[^" + SPACE[1:])


def normalize_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def normalize_subject(subject: Column) -> Column:
    plain = normalize_text(subject)
    bare = F.trim(F.regexp_replace(F.regexp_replace(plain, rf"\b({'|'.join(LEGAL_FORMS)})\b", ""), " +", " "))
    return F.when(plain.isin(*SELF_NAMES), "company").otherwise(bare)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for ``key`` or null."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*pairs)[key]


def normalize_predicate(predicate: Column) -> Column:
    plain = normalize_text(predicate)
    return F.coalesce(lookup(plain, PREDICATE_ALIASES), F.replace(plain, F.lit(" "), F.lit("_")))


def normalize_scope(scope: Column) -> Column:
    plain = normalize_text(scope)
    return F.coalesce(lookup(plain, SCOPE_ALIASES), blank_to_null(plain))


def normalize_evidence(text: Column) -> Column:
    """Lower case; quotes, dashes, line-break hyphens and punctuation no longer tell texts apart."""
    joined = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _DASHED, "")
    return F.trim(F.regexp_replace(joined, _SIGNS, " "))


def holds_evidence(small: Column, large: Column) -> Column:
    """``is_grounded`` of texts that ``normalize_evidence`` has been through."""
    strict, wide = F.replace(small, F.lit(" "), F.lit("")), F.replace(large, F.lit(" "), F.lit(""))
    return (small != "") & (large != "") & (large.contains(small) | ((F.length(strict) >= 12) & wide.contains(strict)))


def is_grounded(evidence: Column, chunk: Column) -> Column:
    """Whether the chunk contains the evidence; from 12 characters on, spacing need not agree."""
    return let(normalize_evidence(evidence), lambda small: let(normalize_evidence(chunk), lambda large: holds_evidence(small, large)))


def workspace_name(value: Column) -> Column:
    """A tidy workspace name of at most 40 characters, or null if it has other signs than letters, digits, space, . _ -"""
    tidy = F.substring(collapse_space(F.lower(value)), 1, 40)
    return F.when(tidy.rlike("^[a-z0-9][a-z0-9 ._-]*$"), tidy)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4) + 8


def written_number(value: Column) -> Column:
    """A number as people write it: all its digits, no exponent, no zeros at the end."""
    plain = F.regexp_replace(value.cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(plain)


def stated_value(number: Column, text: Column) -> Column:
    """A fact's value, a number or a text, as text."""
    return F.coalesce(written_number(number), text)


def namespace(kind: str, owner: Column) -> Column:
    """The part of a vector store that holds a workspace's vectors of a kind ('chunks' or 'facts')."""
    return F.concat(F.lit(f"{kind}__"), owner)


def is_record_id(value: Column) -> Column:
    """Whether a text is a record's id: 24 hexadecimal digits."""
    return F.coalesce(value.rlike("^[0-9a-fA-F]{24}$"), F.lit(False))


def describe_fact(subject: Column, predicate: Column, value: Column, unit: Column, currency: Column, period: Column, scope: Column) -> Column:
    """One line that states a fact; blank parts are left out."""

    def framed(before: str, part: Column, after: str) -> Column:
        return F.when(part.isNotNull() & (part != ""), F.concat(F.lit(before), part, F.lit(after)))

    return F.concat_ws(
        " ", blank_to_null(subject), blank_to_null(predicate), framed("= ", value, ""), blank_to_null(unit), blank_to_null(currency),
        framed("(", period, ")"), framed("[", scope, "]"),
    )


def display(value: Column) -> Column:
    return F.coalesce(blank_to_null(value), F.lit("unavailable"))


def _short(value: Column, digits: int) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", value), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")


def display_number(value: Column) -> Column:
    size = F.abs(value)
    grouped = F.regexp_replace(F.regexp_replace(F.format_number(value, 2), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    return (
        F.when(value.isNull(), "unavailable")
        .when(size >= 1e9, F.format_string("%.2f billion", value / 1e9))
        .when(size >= 1e6, F.format_string("%.2f million", value / 1e6))
        .when(size >= 1000, grouped)
        .otherwise(_short(value, 4))
    )


def display_percent(value: Column) -> Column:
    return F.coalesce(F.format_string("%.1f%%", value * 100), F.lit("unavailable"))


def json_payload(reply: Column) -> Column:
    """The JSON text of a model's reply: without thoughts, code fences and words around it."""
    spoken = F.trim(F.regexp_replace(reply, r"(?is)<think>.*?</think>", ""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(spoken, r"(?is)^```(?:json)?\s*", ""), r"\s*```$", ""))
    first = F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)
    return F.when(bare.rlike(r"^[\[{]"), bare).when(first != "", first).otherwise(bare)


def citation_tags(answer: Column) -> Column:
    """The distinct [S<n>] tags of an answer in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[S\d+\]"), F.lit(0)))


def stage_fraction(stage: Column) -> Column:
    """done/total in a stage's name, at most 1; null without them or with a total of 0."""
    done, total = (F.regexp_extract(stage, r"(\d+)/(\d+)", k).try_cast("double") for k in (1, 2))
    share = F.try_divide(done, total)
    return F.when(share > 1, 1.0).otherwise(share)


def status_code(message: Column) -> Column:
    """An HTTP status named in an error message."""
    found = F.coalesce(*[blank_to_null(F.regexp_extract(message, p, 1)) for p in (r"\[(\d{3})\b", r"(?i)status:?\s*(\d{3})\b", r'"status":\s*(\d{3})\b')])
    return found.cast("int")


def suggested_delay_ms(message: Column) -> Column:
    """The wait a provider asks for in an error message, in milliseconds with half a second to spare."""
    found = F.coalesce(*[blank_to_null(F.regexp_extract(message, p, 1)) for p in (r"(?i)retry in ([\d.]+)s", r'"retryDelay":\s*"([\d.]+)s"')])
    return F.ceil(found.try_cast("double") * 1000) + 500

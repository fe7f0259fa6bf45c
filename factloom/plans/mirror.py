"""The normalisation rules as SQL text for DuckDB, the second implementation that queries are held against."""

from __future__ import annotations

from functools import reduce

from factloom.functions import numbers as n
from factloom.functions import periods as p
from factloom.functions import text as t

SPACE = r"[\s\x{0b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def filled(sql: str, inner: object) -> str:
    """``sql`` with ``inner`` in its place, marked %s."""
    return sql.replace("%s", str(inner))


def text_(x: str) -> str:
    return f"coalesce({x}, '')"


def collapse_space(x: str) -> str:
    return f"trim({replaced(x, SPACE + '+', ' ')})"


def normalize_text(x: str) -> str:
    return f"trim({replaced(f'lower({text_(x)})', '[^a-z0-9]+', ' ')})"


def looked_up(key: str, table: dict[str, object]) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else repr(v)}" for k, v in table.items()) + " END)"


def normalize_subject(x: str) -> str:
    bare = f"trim({replaced(replaced(normalize_text(x), rf'\b({"|".join(t.LEGAL_FORMS)})\b', ''), ' +', ' ')})"
    return f"(CASE WHEN {normalize_text(x)} IN ({', '.join(map(quoted, t.SELF_NAMES))}) THEN 'company' ELSE {bare} END)"


def normalize_predicate(x: str) -> str:
    return f"coalesce({looked_up(normalize_text(x), t.PREDICATE_ALIASES)}, replace({normalize_text(x)}, ' ', '_'))"


def normalize_scope(x: str) -> str:
    return f"coalesce({looked_up(normalize_text(x), t.SCOPE_ALIASES)}, nullif({normalize_text(x)}, ''))"


def normalize_evidence(x: str) -> str:
    dashes = replaced(replaced(f"lower({text_(x)})", "[‘’“”]", "'"), r"[\x{2010}-\x{2015}\x{2212}]", "-")
    return f"trim({replaced(replaced(dashes, f'-{SPACE}+', ''), '[^a-z0-9%]+', ' ')})"


def magnitude_label(x: str) -> str:
    low = f"lower({text_(x)})"
    return "(CASE " + " ".join(f"WHEN regexp_matches({low}, {quoted(rf'(?:^|{SPACE}|[0-9]){m}(?:$|{SPACE}|[,.])')}) THEN {quoted(m)}" for m in n.LONGEST_MAGNITUDES) + " END)"


def magnitude(x: str) -> str:
    return f"coalesce({looked_up(magnitude_label(x), n.MAGNITUDES)}::DOUBLE, 1.0::DOUBLE)"


def normalize_currency(x: str, context: str = "''") -> str:
    low = collapse_space(f"lower({text_(x)} || ' ' || {text_(context)})")
    return "(CASE " + " ".join(f"WHEN contains({low}, {quoted(name)}) THEN {quoted(n.CURRENCIES[name])}" for name in n.LONGEST_CURRENCIES) + " END)"


def number_words(x: str) -> str:
    words = f"regexp_split_to_array(replace(lower({x}), '-', ' '), {quoted(SPACE + '+')})"
    values = f"[{looked_up('w', {k: float(v) for k, v in n.NUMBER_WORDS.items()})}::DOUBLE FOR w IN {words}]"
    return f"(CASE WHEN len({values}) = len([v FOR v IN {values} IF v IS NOT NULL]) THEN list_sum({values}) END)"


def is_numeric_text(x: str) -> str:
    low = reduce(lambda a, name: f"replace({a}, {quoted(name)}, ' ')", n.LONGEST_CURRENCIES, f"lower({text_(x)})")
    low = reduce(lambda a, name: replaced(a, f"(^|[^a-z]){name}([^a-z]|$)", r"\1 \2"), n.LONGEST_MAGNITUDES, low)
    low = replaced(replaced(low, rf"\b({n.FILLERS})\b", " "), f"[%,()]|{SPACE}", "")
    return f"regexp_matches({low}, {quoted(rf'^{n.NUMBER}$')})"


def normalize_number(number: str, x: str, unit: str) -> str:
    trimmed = f"trim({text_(x)})"
    words = number_words(f"trim({replaced(trimmed, r'(?i)\b(percent|percentage)\b', '')})")
    found = f"try_cast(regexp_extract(replace({trimmed}, ',', ''), {quoted(f'({n.NUMBER})')}, 1) AS DOUBLE)"
    scale = magnitude(f"({trimmed} || ' ' || {text_(unit)})")
    return (
        f"(CASE WHEN {number} IS NOT NULL THEN {number} * {magnitude(unit)} "
        f"WHEN {trimmed} <> '' AND ({words} IS NOT NULL OR {is_numeric_text(trimmed)}) THEN coalesce({found}, {words}) * {scale} END)"
    )


def is_percentage(number: str, x: str, unit: str, predicate: str, value_type: str) -> str:
    return (
        f"(regexp_matches(lower({text_(x)} || ' ' || {text_(unit)}), '%|percent') OR regexp_matches(lower({text_(predicate)}), {quoted(n.PERCENT_METRICS)}) "
        f"OR lower({text_(value_type)}) = 'percentage' OR ({text_(predicate)} = '' AND coalesce({number} BETWEEN 0 AND 1, false)))"
    )


def normalize_unit(unit: str, x: str) -> str:
    return (
        f"(CASE WHEN regexp_matches(lower({text_(unit)} || ' ' || {text_(x)}), '%|percent') THEN 'percent' "
        f"WHEN {normalize_currency(unit, x)} IS NOT NULL THEN 'currency' "
        f"WHEN {magnitude_label(unit)} IS NULL THEN nullif(lower(trim({text_(unit)})), '') END)"
    )


def period_columns(period: str) -> str:
    """period_type, period_start, period_end, period_label as a list of SELECT items; ``period`` is a column."""
    text, low = f"trim({text_(period)})", f"lower(trim({text_(period)}))"

    def group(source: str, pattern: str, *groups: int) -> str:
        return "coalesce(" + ", ".join(f"nullif(regexp_extract({source}, {quoted(pattern)}, {g}), '')" for g in groups) + ")::INT"

    def date(y: str, m: str, d: str) -> str:
        return f"(make_date({y}, 1, 1) + to_months(({m}) - 1) + to_days(({d}) - 1))::DATE"

    q, qy = group(low, p.QUARTER, 1, 4), group(low, p.QUARTER, 2, 3)
    fy, year = group(low, p.FISCAL_YEAR, 1, 2), group(low, p.YEAR, 1)
    month = f"list_position([{', '.join(map(quoted, p.MONTHS))}], regexp_extract({low}, {quoted(p.YEAR_ENDED)}, 1))"
    ed, ey = group(low, p.YEAR_ENDED, 2), group(low, p.YEAR_ENDED, 3)
    d, m, y = (group(text, p.DAY, g) for g in (1, 2, 3))
    rules = [
        (f"{text} = ''", "NULL", "NULL", "NULL", "NULL"),
        (f"regexp_matches({low}, {quoted(p.QUARTER)})", f"CASE WHEN regexp_matches({low}, 'fy|fiscal') THEN 'fiscalQuarter' ELSE 'quarter' END",
         date(qy, f"({q} - 1) * 3 + 1", "1"), f"last_day({date(qy, f'({q} - 1) * 3 + 3', '1')})", f"'Q' || {q} || ' ' || {qy}"),
        (f"regexp_matches({low}, {quoted(p.FISCAL_YEAR)})", "'fiscalYear'", date(fy, "1", "1"), date(fy, "12", "31"), f"'FY' || {fy}"),
        (f"regexp_matches({low}, {quoted(p.YEAR_ENDED)})", "'date'", date(ey, "1", "1"), date(ey, month, ed), text),
        (f"regexp_matches({low}, {quoted(p.YEAR)}) AND length({low}) <= 12", "'year'", date(year, "1", "1"), date(year, "12", "31"), f"{year}::VARCHAR"),
        (f"regexp_matches({text}, {quoted(p.DAY)})", "'date'", date(y, m, d), date(y, m, d), text),
    ]
    last = ("'text'", "NULL", "NULL", text)
    items = []
    for k, name in enumerate(("period_type", "period_start", "period_end", "period_label"), 1):
        kind = "DATE" if k in (2, 3) else "VARCHAR"
        items.append("CAST(CASE " + " ".join(f"WHEN {r[0]} THEN {r[k]}" for r in rules) + f" ELSE {last[k - 1]} END AS {kind}) AS {name}")
    return ", ".join(items)

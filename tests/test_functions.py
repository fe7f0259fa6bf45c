"""Scalar rules, with expected values as tables."""

import random
import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import numbers as n
from factloom.functions import text as t
from factloom.functions.periods import parse_period
from factloom.operators.chunking import cut_words, fill_batches
from factloom.operators.stateful import FixedWindow
from factloom.sources.tables import html_text, plain_pdf_pages


def values(spark, column, rows, schema):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def test_numbers(spark):
    cases = [
        ("$120M", None, 120e6), ("120 million USD", None, 120e6), ("USD 120,000,000", None, 120e6), ("1.2 thousand", None, 1200.0), ("1.5M", None, 1.5e6),
        ("8,142 crore", None, 8142e7), ("5 lakh", None, 5e5), ("45,977.98", None, 45977.98), ("twenty five", None, 25.0), ("U63090DL2011PLC221234", None, None),
        ("AAACD4471C", None, None), ("5000", None, 5e6), ("12000", None, 12e6), ("(217)", None, 217.0), ("8 142", None, 8.0), ("Rs.500", None, 0.5),
        ("5 lakh crore", None, 5e7), ("8142-8200", None, None), ("", None, None), (None, None, None), ("1.5", "million", 1.5e6),
    ]
    got = values(spark, n.normalize_number(F.lit(None).cast("double"), F.col("v"), F.col("u")), [c[:2] for c in cases], "v string, u string")
    for (text, _, want), found in zip(cases, got, strict=True):
        assert found == (pytest.approx(want) if want is not None else None), text
    assert values(spark, n.normalize_number(F.col("x"), F.lit(None).cast("string"), F.col("u")), [(1.5, "million"), (5000.0, None)], "x double, u string") == [1.5e6, 5000.0]


def test_currency_percent_unit(spark):
    pairs = [("US dollars", ""), ("$", "Canadian dollars"), ("₹", "audited revenue"), ("Rs", "Rs 8,142 crore"), (None, None)]
    assert values(spark, n.normalize_currency(F.col("v"), F.col("c")), pairs, "v string, c string") == ["USD", "CAD", "AUD", None, None]
    share = n.normalize_percentage(F.col("x"), F.col("v"), F.lit(""), F.col("p"), F.lit(""))
    rows = [(None, "25%", ""), (None, "twenty-five percent", ""), (0.25, None, ""), (40.0, None, "revenue_from_operations"), (40.0, None, "revenue_from_services")]
    assert values(spark, share, rows, "x double, v string, p string") == [0.25, 0.25, 0.25, 0.4, None]
    units = [("%", ""), ("crore", "5"), ("", "$5"), (" Employees ", "5"), (None, None)]
    assert values(spark, n.normalize_unit(F.col("u"), F.col("v")), units, "u string, v string") == ["percent", None, "currency", "employees", None]


def test_periods(spark):
    d = datetime.date
    cases = {
        "fiscal year 2024": ("fiscalYear", d(2024, 1, 1), d(2024, 12, 31), "FY2024"), "Q1 FY2024": ("fiscalQuarter", d(2024, 1, 1), d(2024, 3, 31), "Q1 2024"),
        "2023 Q4": ("quarter", d(2023, 10, 1), d(2023, 12, 31), "Q4 2023"), "FY24": ("text", None, None, "FY24"), "31/03/2024": ("year", d(2024, 1, 1), d(2024, 12, 31), "2024"),
        "as at 31/03/2024": ("date", d(2024, 3, 31), d(2024, 3, 31), "as at 31/03/2024"), "2023-24": ("year", d(2023, 1, 1), d(2023, 12, 31), "2023"),
        "FY2023-24": ("fiscalYear", d(2023, 1, 1), d(2023, 12, 31), "FY2023"), "Year ended March 31, 2024": ("date", d(2024, 1, 1), d(2024, 3, 31), "Year ended March 31, 2024"),
        "as of date 31-02-2024": ("date", d(2024, 3, 2), d(2024, 3, 2), "as of date 31-02-2024"), " ": (None, None, None, None), None: (None, None, None, None),
    }
    got = values(spark, parse_period(F.col("p")), [(c,) for c in cases], "p string")
    assert [tuple(x) for x in got] == list(cases.values())


def test_texts(spark):
    one = lambda column, *texts: values(spark, column, [(x,) for x in texts], "v string")
    v = F.col("v")
    assert one(t.normalize_subject(v), "The Company", "Acme Corp. Ltd", None) == ["company", "acme", ""]
    assert one(t.normalize_predicate(v), "Net Sales", "Employee count") == ["revenue", "employee_count"]
    assert one(t.normalize_scope(v), "U.S.", "Worldwide", "EMEA", "") == ["us", "global", "emea", None]
    assert one(t.workspace_name(v), "  ANNA  ", "bad/name", "x" * 60, None) == ["anna", None, "x" * 40, None]
    assert one(t.json_payload(v), '<think>{}</think>```json\n{"a": 1}\n```', 'so: [1, 2] done', "none") == ['{"a": 1}', "[1, 2]", "none"]
    assert one(t.citation_tags(v), "a [S1] b [S12] [S1] [x]") == [["[S1]", "[S12]"]]
    assert one(t.stage_fraction(v), "extracting 3/4", "x 5/0", "9/3", None) == [0.75, None, 1.0, None]
    assert one(t.suggested_delay_ms(v), "retry in 1.5s", '"retryDelay": "2s"', "no") == [2000, 2500, None]
    assert one(t.status_code(v), "[429] slow", 'Status: 503', "no") == [429, 503, None]
    assert values(spark, t.display_number(F.col("x")), [(2.5e9,), (1.234e6,), (1234.5,), (0.12345,), (None,)], "x double") == ["2.50 billion", "1.23 million", "1,234.5", "0.1235", "unavailable"]


def test_grounding(spark):
    chunk = "Revenue was ₹8,142 crore in the “fiscal” year, with long-\nterm growth."
    spans = ["revenue was ₹8,142 crore", "in the 'fiscal' year", "longterm growth", "Revenue was ₹8 ,1 42 crore", "Revenue was ₹9,142 crore", "", None]
    assert values(spark, t.is_grounded(F.col("v"), F.lit(chunk)), [(x,) for x in spans], "v string") == [True, True, True, True, False, False, False]


def test_cut_words_and_batches():
    assert cut_words("one two three four five six", 12) == ["one two", "three four", "five six"]
    assert cut_words("", 5) == [] and cut_words("abcdefgh ij", 5) == ["abcdefgh", "ij"]
    assert fill_batches([5, 5, 5, 20, 1], 2, 10).tolist() == [0, 0, 1, 2, 3]
    draw = random.Random(1)
    for _ in range(50):
        costs, most_items, most_tokens = [draw.randrange(0, 30) for _ in range(draw.randrange(0, 60))], draw.randrange(1, 9), draw.randrange(1, 60)
        want, batch, items, tokens = [], 0, 0, 0
        for cost in costs:
            if items and (items >= most_items or tokens + cost > most_tokens):
                batch, items, tokens = batch + 1, 0, 0
            want.append(batch)
            items, tokens = items + 1, tokens + cost
        assert fill_batches(costs, most_items, most_tokens).tolist() == want


def test_fixed_window():
    window = FixedWindow(60, 3)
    assert [window.hit(t)[0] for t in (0, 1, 2, 59, 60, 61)] == [True, True, True, False, True, True]


def test_page_sources(spark):
    assert values(spark, html_text(F.col("v")), [("<p>a &lt;b&gt;</p><script>x</script><!-- c --> d",)], "v string") == ["a <b> d"]
    pdf = b"%PDF-1.4\n4 0 obj\n<< >>\nstream\nBT (Hello \\(world\\)) Tj ET\nendstream\nendobj"
    assert plain_pdf_pages(pdf) == [(1, "Hello (world)")] and plain_pdf_pages(b"%PDF") == [(1, "")]

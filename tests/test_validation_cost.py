"""Evidence is normalised once for each fact, a chunk once for all of its facts; the results are those of the plain rules."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.operators import facts
from factloom.plans import catalog
from factloom.streaming.maintain import page_facts

STEP = "[^a-z0-9%]+"


def lines(rows, word):
    return [x for x in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if word in x]


def test_a_chunk_is_normalised_once_for_all_of_its_facts(spark):
    text = " ".join(f"Client {c:03d} balance in FY2024 was {c}.00 USD." for c in range(20))
    chunks = spark.createDataFrame([("d", 1, "c1", text, "pending")], "document_id string, page_number int, chunk_id string, text string, status string")
    found = page_facts(chunks, spark.createDataFrame([("d", "w")], "document_id string, owner string"), catalog.balance_statements)
    assert found.count() == 20
    checks = lines(found.select("fact_id"), "_issue")
    assert sum(x.count(STEP) for x in checks) == 1  # the evidence; the chunk's text comes normalised


def test_a_candidate_is_checked_once_however_its_issue_is_used(spark):
    rows = spark.createDataFrame([("f", "s", "p", "said so", "he said so", 0.5, 1.0, "", "")], "fact_id string, subject string, predicate string, source_text string, chunk_text string, confidence double, value_num double, value_text string, object string")
    used = facts.validated(rows).where("issue_type IS NULL").select("fact_id", "issue_type", "issue_message")
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(STEP) == 2 and used.count() == 1


@pytest.mark.parametrize("text", ["It’s “net-\n sales” — 5 %", "a--  b‐ c −d", "-", "", None, "  ’ ", "Ünïcode― x-y", "　﻿"])
def test_fewer_steps_give_the_same_text(spark, text):
    row = spark.createDataFrame([(text,)], "x string")
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("x", F.lit(""))), "[‘’“”]", "'"), "[‐-―−]", "-")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, f"-{t.SPACE}+", ""), STEP, " "))
    got = row.select(t.normalize_evidence(F.col("x")), plain, t.is_blank(F.col("x")), t.collapse_space(F.coalesce("x", F.lit(""))) == "").first()
    assert got[0] == got[1] and got[2] == got[3]


def test_document_counters_validate_once(spark):
    rows = catalog.document_counters(spark, "/root/testdata/sf0.001")
    assert STEP not in rows._jdf.queryExecution().optimizedPlan().toString()  # counts read what is stored
    assert sum(r.facts_count + r.issues_count for r in rows.collect()) == 1500

"""Facts: validation with reasons, normalisation, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import numbers as n
from factloom.functions import text as t
from factloom.functions.periods import parse_period

# What is done about each kind of issue.
ISSUE_HANDLING = {
    "ungrounded_evidence": "Dropped: the quoted evidence does not appear on the page, so the fact cannot be trusted or linked to a source.",
    "missing_field": "Dropped: a required field was missing, so the fact could not be identified or grounded.",
    "invalid_confidence": "Dropped: the model's confidence was not a number between 0 and 1.",
    "no_value": "Dropped: the fact carried neither a value nor a descriptive object, so there was nothing to compare.",
    "malformed_json": "Re-requested once with an explicit JSON-only instruction; the repaired reply was used.",
    "chunk_failed": "Skipped this page after retries and continued with the rest of the document.",
    "adjudication_failed": "Treated the pairs in this batch as different metrics.",
}


def _blank(name: str) -> Column:
    return t.is_blank(F.col(name).cast("string"))


def issue_of(chunk_text: Column, plain: bool = False) -> Column:
    """The first reason to reject a candidate fact, as a struct (type, message); null if there is none.

    ``plain`` tells that the chunk's text has been through ``normalize_evidence``.
    """

    def issue(kind: str, message: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message"))

    quoted = F.col("source_text")
    grounded = t.let(t.normalize_evidence(quoted), lambda small: t.holds_evidence(small, chunk_text)) if plain else t.is_grounded(quoted, chunk_text)
    sure = F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False))
    return (
        F.when(_blank("subject"), issue("missing_field", "Fact subject is required"))
        .when(_blank("predicate"), issue("missing_field", "Fact predicate is required"))
        .when(_blank("source_text"), issue("missing_field", "Fact sourceText is required"))
        .when(~grounded, issue("ungrounded_evidence", "Fact sourceText is not grounded in the chunk"))
        .when(~sure, issue("invalid_confidence", "Fact confidence must be a number between 0 and 1"))
        .when(F.col("value_num").isNull() & _blank("value_text") & _blank("object"), issue("no_value", "Fact has neither a value nor an object"))
    )


def validated(candidates: DataFrame, chunk_text: str = "chunk_text", plain: bool = False) -> DataFrame:
    """Candidates with ``issue_type``, ``issue_message`` and ``handling``, all null for valid ones."""
    # Exploded, as what a later filter or select reads of a plain column would be worked out once for each reference.
    marked = candidates.select("*", F.explode(F.array(issue_of(F.col(chunk_text), plain))).alias("_issue"))
    marked = marked.withColumn("issue_type", F.col("_issue.type")).withColumn("issue_message", F.col("_issue.message")).drop("_issue")
    return marked.withColumn("handling", t.lookup(F.col("issue_type"), ISSUE_HANDLING))


def split_candidates(candidates: DataFrame, chunk_text: str = "chunk_text", plain: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid facts with tidy texts, and issues with the candidate as JSON."""
    marked = validated(candidates, chunk_text, plain)
    tidy = {c: F.trim(c) for c in ("subject", "predicate", "source_text")}
    valid = marked.where("issue_type IS NULL").drop("issue_type", "issue_message", "handling", chunk_text).withColumns(tidy)
    rejected = marked.where("issue_type IS NOT NULL")
    own = [c for c in candidates.columns if c != chunk_text]
    issues = rejected.select("fact_id", "document_id", "issue_type", "issue_message", "handling", F.to_json(F.struct(*own)).alias("candidate"))
    return valid, issues


def normalize_facts(facts: DataFrame) -> DataFrame:
    """Facts with raw_* copies and normalized_*, period_* columns; applying it again changes nothing.

    Selects of Column expressions. ``facts`` has subject, predicate, object, value_num, value_text, value_type,
    unit, currency, period, scope and source_text. period_start and period_end that ``facts`` has already stay where the
    period as written gives none; normalized_period_start and _end have only what it gives.
    """
    raw = {}
    for name in ("subject", "predicate", "value_num", "value_text", "unit", "currency", "period", "scope"):
        kept = f"raw_{name}"
        raw[kept] = F.coalesce(kept, name) if kept in facts.columns else F.col(name)
    facts = facts.withColumns(raw)
    number, text, unit = F.col("raw_value_num"), F.col("raw_value_text"), F.col("raw_unit")
    value = F.coalesce(text, F.lit(""))
    context = F.concat_ws(" ", value, F.coalesce(unit, F.lit("")), F.coalesce("source_text", F.lit("")))
    facts = facts.withColumns({
        "normalized_subject": t.normalize_subject(F.col("raw_subject")),
        "normalized_predicate": t.normalize_predicate(F.col("raw_predicate")),
        "normalized_object": F.when(F.col("object").isNotNull(), t.normalize_text(F.col("object"))),
        "_number": n.normalize_number(number, text, unit),
        "normalized_unit": n.normalize_unit(unit, text),
        "normalized_currency": n.normalize_currency(F.col("raw_currency"), context),
        "normalized_scope": t.normalize_scope(F.col("raw_scope")),
        "_period": parse_period(F.col("raw_period")),
    })
    share = n.normalize_percentage(number, text, unit, F.col("normalized_predicate"), F.col("value_type"), F.col("_number"))
    facts = facts.withColumn("normalized_percentage", share)
    bounds = {c: F.coalesce(f"_period.{c}", F.col(c).cast("date")) if c in facts.columns else F.col(f"_period.{c}") for c in ("period_start", "period_end")}
    return facts.withColumns({
        "normalized_value": F.coalesce("normalized_percentage", "_number"),
        "period_type": F.col("_period.period_type"),
        **bounds,
        "period_label": F.col("_period.period_label"),
        "normalized_period_start": F.col("_period.period_start"),
        "normalized_period_end": F.col("_period.period_end"),
    }).drop("_number", "_period")


def match_text() -> Column:
    """Who, which metric, when and in what scope; values are left out so that differing ones still match."""
    parts = [("normalized_subject", "subject"), ("normalized_predicate", "predicate"), ("period_label", "period"), ("normalized_scope", "scope")]
    texts = [F.trim(F.coalesce(t.blank_to_null(F.col(a)), F.col(b), F.lit(""))) for a, b in parts]
    return F.array_join(F.filter(F.array(*texts), lambda x: x != ""), " | ")

"""Pairs of facts: signals, the decision between four classes, and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import DEFAULTS, Config
from factloom.functions.numbers import clamped, relative_difference
from factloom.functions.text import blank_to_null, display, display_number, display_percent, stated_value

FACT_COLUMNS = (
    "fact_id", "document_id", "page_id", "chunk_id", "page_number", "subject", "predicate", "object", "value_num", "value_text", "value_type",
    "unit", "currency", "period", "scope", "source_text", "confidence", "normalized_subject", "normalized_predicate", "normalized_object", "normalized_value",
    "normalized_percentage", "normalized_unit", "normalized_currency", "normalized_scope", "period_label",
)

# The sentences of results.
REASONS = {
    "subject": "Subject or predicate evidence is insufficient for reconciliation.",
    "corroborated": "Facts have matching subject, metric, context, and values within tolerance.",
    "contradiction": "Facts have matching subject, metric, and period, and materially different values.",
    "change": "Values differ but at least one fact does not state its period, so this may be a change over time rather than a contradiction.",
    "uncertain": "There is not enough normalized evidence to reconcile these facts.",
}
CLASS_REASONS = {
    "corroborated": "The facts describe the same subject and metric in compatible context, and their normalized values are within tolerance.",
    "contradiction": "The facts describe the same subject and metric for the same period and scope, but their normalized values differ materially.",
    "contextual_difference": "The facts describe the same subject and metric, but their period, scope, unit, or currency context differs; this is not treated as a contradiction.",
}
NO_EVIDENCE = "Evidence is unavailable, so the relationship cannot be fully explained."
NO_METADATA = "There is not enough compatible normalized metadata to determine whether the facts corroborate or conflict."


def a(name: str) -> Column:
    return F.col(f"a.{name}")


def b(name: str) -> Column:
    return F.col(f"b.{name}")


def same_or_unknown(name: str) -> Column:
    """Whether both sides have the same value; null if either is null or blank."""
    return blank_to_null(a(name)) == blank_to_null(b(name))


def surely_same(name: str) -> Column:
    return F.coalesce(same_or_unknown(name), F.lit(False))


def fact_struct(facts: DataFrame, alias: str) -> DataFrame:
    """The facts as one struct column; columns a table lacks are null."""
    kinds = {"page_number": "int", "value_num": "double", "confidence": "double", "normalized_value": "double", "normalized_percentage": "double"}
    columns = [F.col(c) if c in facts.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in FACT_COLUMNS]
    return facts.select(F.struct(*columns).alias(alias))


def paired(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (fact_a, fact_b, ...) with the facts themselves as structs a and b; pairs without both are dropped."""
    left = fact_struct(facts, "a").withColumn("fact_a", F.col("a.fact_id"))
    right = fact_struct(facts, "b").withColumn("fact_b", F.col("b.fact_id"))
    return pairs.join(left, "fact_a").join(right, "fact_b")


def with_signals(pairs: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Pairs of structs a and b (and perhaps adjudicated_same, adjudicated_reason, similarity) with comparison signals."""
    judged = F.coalesce(F.col("adjudicated_same"), F.lit(False)) if "adjudicated_same" in pairs.columns else F.lit(False)
    by_value = relative_difference(a("normalized_value"), b("normalized_value"))
    by_share = relative_difference(a("normalized_percentage"), b("normalized_percentage"))
    objects = F.lower(F.trim(a("normalized_object"))) == F.lower(F.trim(b("normalized_object")))
    return pairs.withColumns({
        "same_subject": surely_same("normalized_subject") | judged,
        "same_predicate": surely_same("normalized_predicate") | judged,
        "same_period": same_or_unknown("period_label"),
        "same_scope": same_or_unknown("normalized_scope"),
        "same_unit": same_or_unknown("normalized_unit"),
        "same_currency": same_or_unknown("normalized_currency"),
        "value_difference": F.abs(a("normalized_value") - b("normalized_value")),
        "percentage_difference": F.coalesce(by_value, by_share),
        "objects_equal": objects,
        "values_equal": F.coalesce(by_value <= config.value_tolerance, by_share <= config.percentage_tolerance, objects),
    })


def reconciled(pairs: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Pairs with signals, relationship_type, reason, context and confidence.

    A subject or metric that differs leaves a pair uncertain; a period, scope, unit or currency known to differ
    makes it contextual; equal values corroborate; different ones contradict if the period is known to agree.
    """
    pairs = with_signals(pairs, config)
    similarity = F.col("similarity") if "similarity" in pairs.columns else F.lit(1.0)
    context = F.array_join(
        F.array_compact(F.array(*[F.when(~F.col(f"same_{x}"), f"{x} differs") for x in ("period", "scope", "unit", "currency")])), ", "
    )
    pairs = pairs.withColumn("context", context)
    related, apart = F.col("same_subject") & F.col("same_predicate"), F.col("context") != ""
    differ = ~F.col("values_equal")

    def decided(pick: int) -> Column:
        return (
            F.when(~related, ("uncertain", F.lit(REASONS["subject"]))[pick])
            .when(apart, ("contextual_difference", F.concat(F.lit("Facts share the same metric but "), "context", F.lit(".")))[pick])
            .when(F.col("values_equal"), ("corroborated", F.lit(REASONS["corroborated"]))[pick])
            .when(differ & F.col("same_period"), ("contradiction", F.lit(REASONS["contradiction"]))[pick])
            .when(differ, ("uncertain", F.lit(REASONS["change"]))[pick])
            .otherwise(("uncertain", F.lit(REASONS["uncertain"]))[pick])
        )

    return pairs.withColumns({
        "relationship_type": decided(0),
        "reason": decided(1),
        "context": F.when(related, blank_to_null(F.col("context"))),
        "confidence": F.least(F.coalesce(a("confidence"), F.lit(0.0)), F.coalesce(b("confidence"), F.lit(0.0)), F.coalesce(similarity, F.lit(1.0))),
    })


def reviewed(pairs: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Candidate pairs reconciled in one go, with the judge's word for those it called the same; their status becomes 'reviewed'."""
    return reconciled(pairs, config).withColumn("status", F.lit("reviewed"))


def has_evidence(side: str) -> Column:
    def there(name: str) -> Column:
        return F.coalesce(F.col(f"{side}.{name}").cast("string"), F.lit("")) != ""

    return there("document_id") & there("page_id") & F.col(f"{side}.page_number").isNotNull() & there("chunk_id") & there("source_text")


def evidence(side: str, label: str) -> Column:
    names = ("document_id", "page_id", "page_number", "chunk_id")
    text = blank_to_null(F.col(f"{side}.source_text")).alias("source_text")
    return F.struct(F.lit(label).alias("fact"), *[F.col(f"{side}.{c}").alias(c) for c in names], text, has_evidence(side).alias("evidence_available"))


def explained(pairs: DataFrame) -> DataFrame:
    """Reconciled pairs with key_similarities, key_differences, summary, detailed_reason and evidence."""

    def said(*parts: Column | str) -> Column:
        return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])

    def value(side: str) -> Column:
        return display(F.coalesce(F.col(f"{side}.object"), stated_value(F.col(f"{side}.value_num"), F.col(f"{side}.value_text"))))

    judged = F.coalesce(F.col("adjudicated_same"), F.lit(False)) if "adjudicated_same" in pairs.columns else F.lit(False)
    why = F.coalesce(F.concat(F.lit(": "), blank_to_null(F.col("adjudicated_reason"))), F.lit(".")) if "adjudicated_reason" in pairs.columns else F.lit(".")
    same = [
        F.when(judged, said("Subject '", display(a("subject")), "' / metric '", display(a("predicate")), "' and subject '", display(b("subject")), "' / metric '", display(b("predicate")), "' were judged equivalent", why)),
        F.when(~judged & F.col("same_subject"), said("Both describe subject '", display(a("normalized_subject")), "'.")),
        F.when(~judged & F.col("same_predicate"), said("Both describe metric '", display(a("normalized_predicate")), "'.")),
        F.when(F.col("same_period"), said("Both refer to period '", display(a("period_label")), "'.")),
        F.when(F.col("same_scope"), said("Both refer to scope '", display(a("normalized_scope")), "'.")),
        F.when(F.col("same_unit"), F.lit("Units are compatible.")),
        F.when(F.col("same_currency"), said("Currency is compatible: ", display(a("normalized_currency")), ".")),
    ]
    both = has_evidence("a") & has_evidence("b")
    by_number = said("Values differ by ", display_number(F.col("value_difference")), ", a ", display_percent(F.col("percentage_difference")), " relative difference.")
    by_word = said("Stated values differ: Fact A says '", value("a"), "'; Fact B says '", value("b"), "'.")
    different = [
        F.when(~F.col("same_period"), said("Periods differ: Fact A is '", display(a("period_label")), "'; Fact B is '", display(b("period_label")), "'.")),
        F.when(~F.col("same_scope"), said("Scopes differ: Fact A is '", display(a("normalized_scope")), "'; Fact B is '", display(b("normalized_scope")), "'.")),
        F.when(~F.col("same_unit"), said("Units differ: '", display(a("normalized_unit")), "' versus '", display(b("normalized_unit")), "'.")),
        F.when(~F.col("same_currency"), said("Currencies differ: '", display(a("normalized_currency")), "' versus '", display(b("normalized_currency")), "'.")),
        F.when(~F.col("values_equal"), F.when(F.col("value_difference").isNotNull(), by_number).otherwise(by_word)),
        F.when(~both, F.lit("Evidence is unavailable for one or both facts.")),
    ]
    table = F.create_map(*[F.lit(x) for pair in CLASS_REASONS.items() for x in pair])
    because = F.when(~both, NO_EVIDENCE).otherwise(F.coalesce(table[F.col("relationship_type")], F.lit(NO_METADATA)))
    return pairs.withColumns({
        "key_similarities": F.array_compact(F.array(*same)),
        "key_differences": F.array_compact(F.array(*different)),
        "summary": F.concat("relationship_type", F.lit(": "), because),
        "detailed_reason": said("Fact A states: '", display(a("source_text")), "' Fact B states: '", display(b("source_text")), "'. ", because),
        "classification": F.col("relationship_type"),
        "evidence": F.array(evidence("a", "Fact A"), evidence("b", "Fact B")),
        "confidence": clamped(F.coalesce("confidence", F.lit(0.0))),
    })

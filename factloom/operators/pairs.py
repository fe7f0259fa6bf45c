"""Candidate pairs of facts: identity rules first, a judge for near misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.config import DEFAULTS, Config
from factloom.functions.text import blank_to_null
from factloom.operators.reconcile import a, b, paired, same_or_unknown, surely_same


def type_family(kind: Column) -> Column:
    return F.when(kind.isin("percentage", "date", "text"), kind).otherwise("amount")


def types_compatible(left: Column, right: Column) -> Column:
    """Unknown types agree with all; numbers, currencies and the like are one family."""
    unknown = blank_to_null(left).isNull() | blank_to_null(right).isNull()
    return unknown | (type_family(left) == type_family(right))


def compared(pairs: DataFrame) -> DataFrame:
    """Pairs of structs a and b (and perhaps adjudicated_same, adjudicated_reason) with compatible, score and reason."""
    judged = F.coalesce(F.col("adjudicated_same"), F.lit(False)) if "adjudicated_same" in pairs.columns else F.lit(False)
    why = F.concat(F.lit(" ("), blank_to_null(F.col("adjudicated_reason")), F.lit(")")) if "adjudicated_reason" in pairs.columns else F.lit(None).cast("string")
    subject, predicate = surely_same("normalized_subject"), surely_same("normalized_predicate")
    types = types_compatible(a("value_type"), b("value_type"))
    objects = a("normalized_object").isNotNull() & b("normalized_object").isNotNull() & (a("normalized_object") != b("normalized_object"))

    def kept(differs: Column, name: str) -> Column:
        return F.when(differs, f"{name} differs; preserved for reconciliation").otherwise(f"{name} compatible")

    parts = F.array_compact(
        F.array(
            F.when(judged, F.concat(F.lit("subject and metric judged equivalent by adjudicator"), F.coalesce(why, F.lit("")))).otherwise("subject matches; predicate matches"),
            F.lit("value type compatible"),
            kept(objects, "object"),
            kept(~same_or_unknown("normalized_unit"), "unit"),
            kept(~same_or_unknown("normalized_currency"), "currency"),
            F.when(~same_or_unknown("period_label"), "period differs; preserved for later analysis"),
            F.when(~same_or_unknown("normalized_scope"), "scope differs; preserved for later analysis"),
        )
    )
    refusal = (
        F.when(~judged & ~subject, "subject differs")
        .when(~judged & ~predicate, "predicate differs")
        .when(~types, "value type differs")
    )
    return pairs.withColumns({
        "compatible": refusal.isNull(),
        "score": F.when(refusal.isNotNull(), 0.0).when(judged, 0.9).otherwise(1.0),
        "reason": F.coalesce(refusal, F.array_join(parts, "; ")),
    })


def canonical(matches: DataFrame) -> DataFrame:
    """Matches (fact_id, candidate_id, ...) with fact_a < fact_b as strings and their pair_key."""
    low, high = F.least("fact_id", "candidate_id"), F.greatest("fact_id", "candidate_id")
    return matches.withColumns({"fact_a": low, "fact_b": high, "pair_key": F.concat(low, F.lit(":"), high)})


def first_encounters(matches: DataFrame) -> DataFrame:
    """Of each unordered pair the match met first, by query fact and rank."""
    order = Window.partitionBy("pair_key").orderBy("fact_id", "rank")
    return canonical(matches).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def candidate_pairs(matches: DataFrame, facts: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Pairs that identity rules accept.

    ``matches`` has fact_id, candidate_id, similarity and rank. Pairs of one fact or one document, and such below
    the similarity threshold, are no candidates.
    """
    near = first_encounters(matches.where((F.col("similarity") >= config.similarity_threshold) & (F.col("fact_id") != F.col("candidate_id"))))
    return _accepted(compared(_across_documents(near, facts)), config)


def _across_documents(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    return paired(pairs, facts).where(~a("document_id").eqNullSafe(b("document_id")))


def _accepted(pairs: DataFrame, config: Config) -> DataFrame:
    matching = F.col("similarity") * F.col("score")
    pairs = pairs.withColumn("matching_score", matching).where(
        F.col("compatible") & (F.col("matching_score") >= config.match_confidence_threshold) & (F.col("score") >= config.compatibility_threshold)
    )
    zero = F.lit(0.0)
    return pairs.withColumns({
        "confidence": F.least(F.lit(1.0), F.coalesce(a("confidence"), zero), F.coalesce(b("confidence"), zero), "matching_score"),
        "similarity": F.least(F.lit(1.0), "similarity"),
        "matching_score": F.least(F.lit(1.0), "matching_score"),
        "status": F.lit("pending"),
    })


def adjudication_pool(matches: DataFrame, facts: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Near misses for a judge: similar pairs whose subject or metric differs, the first ones of each document."""
    near = first_encounters(matches.where((F.col("similarity") >= config.adjudication_similarity) & (F.col("fact_id") != F.col("candidate_id"))))
    missed = compared(_across_documents(near, facts)).where(F.col("reason").isin("subject differs", "predicate differs"))
    own = F.when(F.col("fact_id") == F.col("fact_a"), a("document_id")).otherwise(b("document_id"))
    order = Window.partitionBy("document_id").orderBy("fact_id", "rank")
    pool = missed.withColumn("document_id", own).withColumn("encounter", F.row_number().over(order))
    return pool.where(F.col("encounter") <= config.max_adjudication_pairs)


def adjudicated_pairs(pool: DataFrame, verdicts: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Of the pool, the pairs that ``verdicts`` (pair_key, same, reason) call the same, as accepted candidates."""
    agreed = verdicts.where("same").select("pair_key", F.col("same").alias("adjudicated_same"), F.col("reason").alias("adjudicated_reason"))
    return _accepted(compared(pool.drop("compatible", "score", "reason").join(agreed, "pair_key")), config)


def united(deterministic: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """Both sets of accepted pairs, each pair once: by the identity rules where these accept it, else by the judge's word."""
    also = adjudicated.join(deterministic.select("pair_key"), "pair_key", "left_anti")
    return deterministic.unionByName(also, allowMissingColumns=True)

"""Views of documents, facts and answers for readers and for the vector store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import clamped
from factloom.functions.text import collapse_space, display, json_payload, stated_value

OPENING_PAGES, OPENING_CHARACTERS = 3, 6000
COVERAGES = ("full", "partial", "none")


def populated(rows: DataFrame, **references: DataFrame) -> DataFrame:
    """``rows`` with a struct for each reference table, by its ``<name>_id``; null where it lacks the id."""
    for name, table in references.items():
        key = f"{name}_id"
        rows = rows.join(table.select(key, F.struct(*[c for c in table.columns]).alias(name)), key, "left")
    return rows


def opening_texts(pages: DataFrame) -> DataFrame:
    """document_id and the text of its first pages, blank lines between them; ranks are cut before pages are shuffled."""
    first = Window.partitionBy("document_id").orderBy("page_number")
    rows = pages.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= OPENING_PAGES)
    parts = F.sort_array(F.collect_list(F.struct("_n", F.coalesce("text", F.lit("")).alias("text"))))
    return rows.groupBy("document_id").agg(F.substring(F.array_join(parts["text"], "\n\n"), 1, OPENING_CHARACTERS).alias("opening"))


def primary_entities(answers: DataFrame, least: float = 0.5) -> DataFrame:
    """document_id and entity of ``answers`` (document_id, entity, confidence) sure enough to be used, else null."""
    sure = F.coalesce("confidence", F.lit(0.0)) >= least
    return answers.select("document_id", F.when(sure, F.nullif(F.trim("entity"), F.lit(""))).alias("primary_entity"))


def vector_records(facts: DataFrame) -> DataFrame:
    """What a vector store keeps beside a fact's vector, as written and as normalised: blank for what is unknown, 0 for an unknown value."""

    def or_blank(*names: str) -> list[Column]:
        return [F.coalesce(x, F.lit("")).alias(x) for x in names]

    return facts.select(
        F.concat(F.lit("fact_"), "fact_id").alias("vector_id"), "fact_id", "document_id", "page_id", "chunk_id", "subject", "predicate",
        F.coalesce(stated_value(F.col("value_num"), F.col("value_text")), F.lit("")).alias("value"), *or_blank("period", "scope", "normalized_subject", "normalized_predicate"),
        F.coalesce("normalized_value", F.lit(0.0)).alias("normalized_value"), *or_blank("normalized_currency", "period_label", "normalized_scope"),
    )


def chunk_records(chunks: DataFrame, vector: Column) -> DataFrame:
    """What a vector store keeps of the chunks that are read: skipped ones have no vector."""
    kept = chunks.where("status <> 'skipped'")
    return kept.select(F.col("chunk_id").alias("vector_id"), "document_id", "page_number", "chunk_id", "chunk_index", "text", vector.alias("embedding"))


def sanitized_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (answer, confidence, coverage, perhaps notes) with tidy text, confidence held to 0..1, a known coverage and an array of notes."""
    notes = {"notes": F.coalesce("notes", F.array().cast("array<string>"))} if "notes" in answers.columns else {}
    return answers.withColumns({
        "answer": F.trim(F.coalesce("answer", F.lit(""))),
        "confidence": clamped(F.coalesce("confidence", F.lit(0.0))),
        "coverage": F.when(F.col("coverage").isin(*COVERAGES), F.col("coverage")).otherwise("partial"),
        **notes,
    })


def replied_facts(replies: DataFrame) -> DataFrame:
    """``replies`` (reply: bare JSON, a chat envelope, or an object with text or content) with outcome, facts, model and preview.

    outcome is 'ok', 'malformed_json' (preview has its start) or 'no_facts_array'; facts is an array of variants.
    """

    def part(value: str, path: str, kind: str) -> Column:
        return F.try_variant_get(value, path, kind)

    rows = replies.withColumn("_outer", F.try_parse_json(json_payload(F.col("reply"))))
    inner = F.coalesce(*[part("_outer", p, "string") for p in ("$.choices[0].message.content", "$.text", "$.content")])
    rows = rows.withColumn("_inner", F.when(inner.isNull(), F.col("_outer")).otherwise(F.try_parse_json(json_payload(inner))))
    found = part("_inner", "$.facts", "array<variant>")
    return rows.withColumns({
        "facts": found,
        "outcome": F.when(F.col("_inner").isNull(), "malformed_json").when(found.isNull(), "no_facts_array").otherwise("ok"),
        "model": part("_outer", "$.model", "string"),
        "preview": F.when(F.col("_inner").isNull(), collapse_space(F.substring("reply", 1, 200))),
    }).drop("_outer", "_inner")


#: A fixed value: what is said beside a reply that is shown as it came.
VERBATIM = "The model reply was not valid JSON; showing it verbatim."


def parsed_answers(replies: DataFrame) -> DataFrame:
    """``replies`` (reply, as the model wrote it) with answer, confidence, coverage, notes and citations (source, quote).

    A reply that holds no JSON is the answer itself, with a confidence of 0.3.
    """
    found = replies.withColumn("_v", F.try_parse_json(json_payload(F.col("reply"))))

    def part(path: str, kind: str) -> Column:
        return F.try_variant_get("_v", path, kind)

    given = F.col("_v").isNotNull()
    kind = "array<struct<source string, quote string>>"
    rows = found.withColumns({
        "answer": F.when(given, part("$.answer", "string")).otherwise(F.col("reply")),
        "confidence": F.when(given, part("$.confidence", "double")).otherwise(0.3),
        "coverage": F.when(given, part("$.coverage", "string")).otherwise("partial"),
        "notes": F.when(given, part("$.notes", "array<string>")).otherwise(F.array(F.lit(VERBATIM))),
        "citations": F.coalesce(part("$.citations", kind), F.array().cast(kind)),
    })
    return sanitized_answers(rows).drop("_v")


def workspace_totals(facts: DataFrame) -> DataFrame:
    """owner, n_facts and the owner's distinct document ids, sorted."""
    return facts.groupBy("owner").agg(F.count("*").alias("n_facts"), F.array_sort(F.collect_set("document_id")).alias("documents"))


def judge_listing(pool: DataFrame, batch: int) -> DataFrame:
    """Near misses (document_id, encounter, pair_key, structs a and b) as numbered lines for a judge, ``batch`` to a request."""

    def side(x: str) -> Column:
        told = [("subject", display(F.col(f"{x}.subject"))), ("metric", display(F.col(f"{x}.predicate")))]
        told += [(name, F.coalesce(f"{x}.{name}", F.lit(""))) for name in ("period", "scope")]
        told.append(("evidence", F.substring(F.coalesce(f"{x}.source_text", F.lit("")), 1, 220)))
        return F.concat_ws(", ", *[F.concat(F.lit(f'{name}="'), value, F.lit('"')) for name, value in told])

    place = (F.col("encounter") - 1) % batch + 1
    line = F.concat(place.cast("string"), F.lit(". A: "), side("a"), F.lit("\n   B: "), side("b"))
    return pool.select("document_id", ((F.col("encounter") - 1) / batch).cast("int").alias("request"), place.alias("place"), "pair_key", line.alias("line"))


def verdicts_of(replies: DataFrame, listing: DataFrame) -> DataFrame:
    """pair_key, same and reason (200 characters) of a judge's ``replies`` (document_id, request, reply) to a ``listing``.

    A reply that holds no JSON calls no pair the same; nor does a verdict on a place that is not listed.
    """
    parsed = F.try_parse_json(json_payload(F.col("reply")))
    said = F.try_variant_get(parsed, "$.verdicts", "array<struct<pair int, same boolean, reason string>>")
    rows = replies.select("document_id", "request", F.explode(said).alias("v")).select("document_id", "request", F.col("v.pair").alias("place"), "v.same", "v.reason")
    rows = rows.join(listing.select("document_id", "request", "place", "pair_key"), ["document_id", "request", "place"])
    return rows.select("pair_key", F.coalesce("same", F.lit(False)).alias("same"), F.substring(F.coalesce("reason", F.lit("")), 1, 200).alias("reason"))

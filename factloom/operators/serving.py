"""What readers ask for: searches, relationships of a document, sources of an answer, showcase cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import citation_tags


def checked_k(k: int, most: int = 100) -> int:
    if not isinstance(k, int) or not 1 <= k <= most:
        raise ValueError(f"k must be a whole number from 1 to {most}")
    return k


def hydrated(matches: DataFrame, rows: DataFrame, match_id: str, row_id: str) -> DataFrame:
    """Matches with their rows, those without one left out, in the order of the matches."""
    return matches.join(rows.withColumnRenamed(row_id, match_id), match_id).orderBy("rank")


def relationships_touching(relationships: DataFrame, fact_ids: DataFrame) -> DataFrame:
    """Relationships with either end among ``fact_ids`` (fact_id): two semi-joins, never a join on OR."""
    ids = fact_ids.select("fact_id").distinct()
    by_a = relationships.join(ids.withColumnRenamed("fact_id", "fact_a"), "fact_a", "left_semi")
    by_b = relationships.join(ids.withColumnRenamed("fact_id", "fact_b"), "fact_b", "left_semi")
    return by_a.select(*relationships.columns).unionByName(by_b.select(*relationships.columns)).dropDuplicates(["fact_a", "fact_b"])


def neighbours(relationships: DataFrame, fact_ids: DataFrame) -> DataFrame:
    """Facts at the other end of relationships of ``fact_ids`` that are not among them."""
    ids = fact_ids.select("fact_id").distinct()
    ends = relationships.select(F.col("fact_a").alias("fact_id"), F.col("fact_b").alias("other")).unionByName(
        relationships.select(F.col("fact_b").alias("fact_id"), F.col("fact_a").alias("other"))
    )
    near = ends.join(ids, "fact_id", "left_semi").select(F.col("other").alias("fact_id")).distinct()
    return near.join(ids, "fact_id", "left_anti")


def numbered_sources(facts: DataFrame, passages: DataFrame) -> DataFrame:
    """Facts, then passages, numbered S1, S2, ...; both have order_in, chunk_id, document_id, page_number, statement, quote, score."""
    columns = ["kind", "fact_id", "chunk_id", "document_id", "page_number", "statement", "quote", "score"]
    both = facts.withColumns({"kind": F.lit("fact"), "_k": F.lit(0)}).select("_k", "order_in", *columns).unionByName(
        passages.withColumns({"kind": F.lit("passage"), "_k": F.lit(1), "fact_id": F.lit(None).cast("string")}).select("_k", "order_in", *columns)
    )
    number = F.row_number().over(Window.orderBy("_k", "order_in", "document_id"))  # at most k facts, their neighbours and k passages
    return both.withColumn("source_id", F.concat(F.lit("S"), number)).select("source_id", *columns)


def resolved_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations of ``answers`` (answer_id, answer, citations array<struct<source, quote>>) that name a source: listed ones, then tags in the text.

    A citation keeps the quote that came with it; where there is none, it has the source's.
    """
    listed = answers.select("answer_id", F.posexplode("citations").alias("n", "c")).select("answer_id", "n", F.upper("c.source").alias("source_id"), F.nullif("c.quote", F.lit("")).alias("given"))
    tags = answers.select("answer_id", F.posexplode(citation_tags(F.col("answer"))).alias("n", "tag"))
    tagged = tags.select("answer_id", "n", F.regexp_replace("tag", r"[\[\]]", "").alias("source_id"))
    added = tagged.join(listed.select("answer_id", "source_id").distinct(), ["answer_id", "source_id"], "left_anti")
    both = listed.withColumn("listed", F.lit(True)).unionByName(added.withColumns({"listed": F.lit(False), "given": F.lit(None).cast("string")}))
    return both.join(sources, "source_id").withColumn("quote", F.coalesce("given", "quote")).drop("given")


def case_rank() -> Column:
    """Confidence and what makes a case of its class telling."""
    wording = F.col("adjudicated") | F.expr(
        "NOT (lower(a.subject) <=> lower(b.subject) AND lower(a.predicate) <=> lower(b.predicate) AND a.value_num <=> b.value_num"
        " AND a.value_text <=> b.value_text AND coalesce(a.unit, '') = coalesce(b.unit, '') AND coalesce(a.currency, '') = coalesce(b.currency, ''))"
    )
    kind, zero = F.col("relationship_type"), F.lit(0.0)
    return (
        F.coalesce("confidence", zero)
        + F.when((kind == "corroborated") & wording, 0.5).otherwise(0.0)
        + F.when(kind == "contradiction", F.coalesce(F.least(F.lit(0.5), "percentage_difference"), zero)).otherwise(0.0)
        + F.when((kind == "contextual_difference") & F.coalesce(F.col("context").contains("period"), F.lit(False)), 0.25).otherwise(0.0)
        + F.when(F.col("a.page_number").isNotNull() & F.col("b.page_number").isNotNull(), 0.05).otherwise(0.0)
    )


def showcase_cases(relationships: DataFrame, first: int = 60, shown: int = 3) -> DataFrame:
    """Each class's most telling cases: the surest ``first``, across documents, by rank; one scan for all classes.

    ``relationships`` are reconciled pairs with structs a and b and a boolean ``adjudicated``; uncertain shows one less.
    """
    sure = Window.partitionBy("relationship_type").orderBy(F.desc("confidence"), "fact_a", "fact_b")
    rows = relationships.withColumn("_n", F.row_number().over(sure)).where(F.col("_n") <= first)
    rows = rows.where(~F.col("a.document_id").eqNullSafe(F.col("b.document_id"))).withColumn("case_score", case_rank())
    best = Window.partitionBy("relationship_type").orderBy(F.desc("case_score"), F.desc("confidence"), "fact_a", "fact_b")
    rows = rows.withColumn("place", F.row_number().over(best))
    rows = rows.where(F.col("place") <= F.when(F.col("relationship_type") == "uncertain", shown - 1).otherwise(shown))
    return rows.withColumn("is_best", F.col("place") == 1).drop("_n")


def latest_per_type(issues: DataFrame, order: str, tie: str, n: int = 2) -> DataFrame:
    by = Window.partitionBy("issue_type").orderBy(F.desc(order), F.desc(tie))
    return issues.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def class_totals(relationships: DataFrame, kind: str = "relationship_type") -> DataFrame:
    return relationships.groupBy(kind).agg(F.count("*").alias("n"))


def document_counters(documents: DataFrame, **tables: DataFrame) -> DataFrame:
    """``documents`` (document_id) with the number of rows that each table has of it; 0 where it has none."""
    for name, rows in tables.items():
        counted = rows.groupBy("document_id").agg(F.count("*").alias(f"{name}_count"))
        documents = documents.join(counted, "document_id", "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    return documents


def surest_touching(relationships: DataFrame, fact_ids: DataFrame, most: int = 8) -> DataFrame:
    """Of the relationships that touch any of ``fact_ids``, the ``most`` surest: what an answer is told of."""
    return relationships_touching(relationships, fact_ids).orderBy(F.desc("confidence"), "fact_a", "fact_b").limit(most)


def answer_facts(retrieved: DataFrame, relationships: DataFrame) -> DataFrame:
    """fact_id and order_in: the ``retrieved`` facts (fact_id, rank), then those that only ``relationships`` name."""
    ends = relationships.select(F.explode(F.array("fact_a", "fact_b")).alias("fact_id")).distinct()
    more = ends.join(retrieved.select("fact_id"), "fact_id", "left_anti")
    order = F.struct(F.lit(1).alias("k"), F.lit(0).alias("rank"), F.col("fact_id").alias("id"))
    return retrieved.select("fact_id", F.struct(F.lit(0).alias("k"), F.col("rank").cast("int").alias("rank"), F.col("fact_id").alias("id")).alias("order_in")).unionByName(
        more.select("fact_id", order.alias("order_in"))
    )


def named_sources(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """``sources`` with document_name and primary_entity of ``documents`` (document_id, document_name, primary_entity)."""
    named = sources.join(documents.select("document_id", "document_name", "primary_entity"), "document_id", "left")
    return named.withColumn("document_name", F.coalesce("document_name", F.lit("Unknown document")))


def relationship_notes(relationships: DataFrame, sources: DataFrame) -> DataFrame:
    """``relationships``, all columns, with source_a and source_b, the ids of their facts' sources; those with an end that is no source are left out."""
    ids = sources.where("fact_id IS NOT NULL").select("fact_id", "source_id")
    left, right = (ids.select(F.col("fact_id").alias(f"fact_{x}"), F.col("source_id").alias(f"source_{x}")) for x in ("a", "b"))
    return relationships.join(left, "fact_a").join(right, "fact_b")


def in_reading_order(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``place``, from 0, by page and index within their document."""
    order = Window.partitionBy("document_id").orderBy("page_number", "chunk_index")
    return chunks.withColumn("place", F.row_number().over(order) - 1)


def by_creation(rows: DataFrame, listing: str, tie: str) -> DataFrame:
    """``rows`` with ``place``, from 1: oldest first within their listing."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(listing).orderBy("created_at", tie)))


def folded(totals: DataFrame, group: str, name: str, value: str = "n") -> DataFrame:
    """One map of names to values for each group."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(name).cast("string").alias("k"), F.col(value).alias("v"))))
    return totals.groupBy(group).agg(F.map_from_entries(pairs).alias("totals"))


def chunk_counters(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``documents`` (document_id) with their pages, chunks and the chunks that a run went through, failed ones too."""
    n_pages = pages.groupBy("document_id").agg(F.count("*").alias("page_count"))
    by = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.count_if(F.col("status") != "pending").alias("processed_chunk_count"))
    rows = documents.join(n_pages, "document_id", "left").join(by, "document_id", "left")
    return rows.fillna(0, ["page_count", "chunk_count", "processed_chunk_count"])

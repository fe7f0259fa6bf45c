"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import models
from factloom.config import DEFAULTS
from factloom.functions import numbers as n
from factloom.functions import text as t
from factloom.functions.periods import parse_period
from factloom.models import embed
from factloom.operators import chunking, documents, facts, grounding, pairs, reconcile, serving, stateful, vectors
from factloom.plans import mirror as m
from factloom.plans.inputs import CANDIDATES, ORDER_FACTS, REVENUE_FACTS, both
from factloom.sources import vector_table
from factloom.sources.tables import html_text, replaced_by_key, scratch, spread, stored, table, without_documents, without_facts
from factloom.streaming import ingest, limits, maintain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL it is held against."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Text and chunks.


@query(f"SELECT doc_id, md5({m.collapse_space('text')}) AS text_md5, length({m.collapse_space('text')}) AS n_chars_tidy FROM documents")
def page_normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = t.collapse_space(F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(tidy).alias("text_md5"), F.length(tidy).cast("long").alias("n_chars_tidy"))


def chunk_sql(most: int) -> str:
    head = f"""CASE WHEN length(rest) <= {most} THEN rest WHEN contains(substr(rest, 1, {most + 1}), ' ')
               THEN regexp_extract(substr(rest, 1, {most + 1}), '^(.*) ', 1) ELSE split_part(rest, ' ', 1) END"""
    return f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, -1 AS chunk_index, '' AS text, {m.collapse_space(m.text_('text'))} AS rest FROM documents
  UNION ALL
  SELECT doc_id, chunk_index + 1, {head}, substr(rest, length({head}) + 2) FROM cut WHERE rest <> '')
SELECT doc_id AS document_id, 1 AS page_number, chunk_index, 'chunk_' || doc_id || '_1_' || chunk_index AS chunk_id, md5(text) AS text_md5, length(text)::INTEGER AS n_chars,
  len(string_split(text, ' '))::INTEGER AS token_count,
  CASE WHEN length(text) < {DEFAULTS.min_extraction_characters} AND NOT regexp_matches(text, '[0-9]') THEN 'skipped' ELSE 'pending' END AS status
FROM cut WHERE chunk_index >= 0"""


def _chunked(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    pages = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("page_number", F.lit(1))
    return chunking.chunks(pages, "doc_id", "page_number", "text", most)


def _digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text_md5", F.md5("text")).drop("text")


@query(chunk_sql(8000))
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_chunked(spark, sf_dir, 8000))


@query(chunk_sql(1200))
def chunk_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_chunked(spark, sf_dir, 1200))


@query(f"SELECT document_id, status, count(*) AS n, sum(token_count)::BIGINT AS tokens FROM ({chunk_sql(1200)}) GROUP BY ALL")
def chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, 1200).groupBy("document_id", "status").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


@query("SELECT source, sum(ceil(length(coalesce(text, '')) / 4.0) + 8)::BIGINT AS tokens, count(*) AS items FROM documents GROUP BY source")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.token_totals(table(spark, sf_dir, "documents"), "source", "text")


@query(f"""
WITH RECURSIVE c AS (SELECT document_id, chunk_index, (ceil(n_chars / 4.0) + 8)::BIGINT AS cost FROM ({chunk_sql(400)})),
f AS (
  SELECT document_id, chunk_index, cost, 0 AS batch, 1 AS items, cost AS tokens FROM c WHERE chunk_index = 0
  UNION ALL
  SELECT c.document_id, c.chunk_index, c.cost, f.batch + (f.items >= 64 OR f.tokens + c.cost > 40000)::INT,
    CASE WHEN f.items >= 64 OR f.tokens + c.cost > 40000 THEN 1 ELSE f.items + 1 END,
    CASE WHEN f.items >= 64 OR f.tokens + c.cost > 40000 THEN c.cost ELSE f.tokens + c.cost END
  FROM f JOIN c ON c.document_id = f.document_id AND c.chunk_index = f.chunk_index + 1)
SELECT document_id, chunk_index, cost, batch FROM f""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.token_batches(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", 400)


@query("SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 20)::INTEGER AS batch FROM embeddings")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.numbered_batches(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", DEFAULTS.adjudication_batch)


_HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\s\x{0b}]+', ' ', 'g'))"""


@query(f"SELECT page_id, md5({_HTML}) AS text_md5, length({_HTML}) AS n_chars FROM pages")
def web_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


# Scalar rules over all derived facts.


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir, ORDER_FACTS)


@query(f"SELECT fact_id, {m.normalize_subject('subject')} AS s FROM ({ORDER_FACTS})")
def subject_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_facts(spark, sf_dir).select("fact_id", t.normalize_subject(F.col("subject")).alias("s"))


@query(f"SELECT fact_id, {m.normalize_predicate('predicate')} AS p FROM ({ORDER_FACTS})")
def predicate_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_facts(spark, sf_dir).select("fact_id", t.normalize_predicate(F.col("predicate")).alias("p"))


@query(f"SELECT fact_id, {m.normalize_scope('scope')} AS s FROM ({ORDER_FACTS})")
def scope_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_facts(spark, sf_dir).select("fact_id", t.normalize_scope(F.col("scope")).alias("s"))


@query(f"SELECT fact_id, {m.magnitude_label('value_text')} AS label, {m.magnitude('value_text')} AS scale FROM ({ORDER_FACTS})")
def magnitude_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("value_text")
    return _order_facts(spark, sf_dir).select("fact_id", n.magnitude_label(text).alias("label"), n.magnitude(text).alias("scale"))


_NUMBER_SQL = f"SELECT *, {m.normalize_number('value_num', 'value_text', 'unit')} AS number FROM ({ORDER_FACTS})"


@query(f"SELECT fact_id, round(number, 4) AS number, {m.is_numeric_text('value_text')} AS is_numeric FROM ({_NUMBER_SQL})")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = n.normalize_number(F.col("value_num"), F.col("value_text"), F.col("unit"))
    return _order_facts(spark, sf_dir).select("fact_id", F.round(number, 4).alias("number"), n.is_numeric_text(F.col("value_text")).alias("is_numeric"))


_SHARE_SQL = f"""SELECT *, CASE WHEN {m.is_percentage('value_num', 'value_text', 'unit', m.normalize_predicate('predicate'), 'value_type')}
  THEN CASE WHEN number > 1 THEN number / 100 ELSE number END END AS share FROM ({_NUMBER_SQL})"""


@query(f"SELECT fact_id, round(share, 4) AS share FROM ({_SHARE_SQL})")
def percent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = n.normalize_percentage(F.col("value_num"), F.col("value_text"), F.col("unit"), t.normalize_predicate(F.col("predicate")), F.col("value_type"))
    return _order_facts(spark, sf_dir).select("fact_id", F.round(share, 4).alias("share"))


@query(f"SELECT fact_id, {m.normalize_currency('currency', 'value_text')} AS code FROM ({ORDER_FACTS})")
def currency_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_facts(spark, sf_dir).select("fact_id", n.normalize_currency(F.col("currency"), F.col("value_text")).alias("code"))


@query(f"SELECT fact_id, {m.normalize_unit('unit', 'value_text')} AS u FROM ({ORDER_FACTS})")
def unit_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_facts(spark, sf_dir).select("fact_id", n.normalize_unit(F.col("unit"), F.col("value_text")).alias("u"))


@query(f"SELECT fact_id, {m.period_columns('period')} FROM ({ORDER_FACTS})")
def period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_facts(spark, sf_dir).select("fact_id", parse_period(F.col("period")).alias("p")).select("fact_id", "p.*")


NORMALIZED = f"""
SELECT *, coalesce(normalized_percentage, number) AS normalized_value FROM (
SELECT *, CASE WHEN {m.is_percentage('value_num', 'value_text', 'unit', 'normalized_predicate', 'value_type')}
    THEN CASE WHEN number > 1 THEN number / 100 ELSE number END END AS normalized_percentage FROM (
SELECT *, {m.normalize_subject('subject')} AS normalized_subject, {m.normalize_predicate('predicate')} AS normalized_predicate,
  CASE WHEN object IS NOT NULL THEN {m.normalize_text('object')} END AS normalized_object,
  {m.normalize_number('value_num', 'value_text', 'unit')} AS number, {m.normalize_unit('unit', 'value_text')} AS normalized_unit,
  {m.normalize_currency('currency', "coalesce(value_text, '') || ' ' || coalesce(unit, '') || ' ' || coalesce(source_text, '')")} AS normalized_currency,
  {m.normalize_scope('scope')} AS normalized_scope, {m.period_columns('period')}
FROM (%s)))"""
_NORMAL_COLUMNS = ["fact_id", "normalized_subject", "normalized_predicate", "normalized_object", "normalized_unit", "normalized_currency", "normalized_scope", "period_type", "period_start", "period_end", "period_label"]


@query(f"SELECT {', '.join(_NORMAL_COLUMNS)}, round(normalized_value, 4) AS normalized_value, round(normalized_percentage, 4) AS normalized_percentage FROM ({m.filled(NORMALIZED, ORDER_FACTS)})")
def normalize_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.normalize_facts(_order_facts(spark, sf_dir))
    return rows.select(*_NORMAL_COLUMNS, *[F.round(c, 4).alias(c) for c in ("normalized_value", "normalized_percentage")])


_MATCH_TEXT = """array_to_string([x FOR x IN [trim(coalesce(nullif(normalized_subject, ''), subject, '')), trim(coalesce(nullif(normalized_predicate, ''), predicate, '')),
  trim(coalesce(nullif(period_label, ''), period, '')), trim(coalesce(nullif(normalized_scope, ''), scope, ''))] IF x <> ''], ' | ')"""


@query(f"SELECT fact_id, {_MATCH_TEXT} AS match_text FROM ({m.filled(NORMALIZED, ORDER_FACTS)})")
def match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.normalize_facts(_order_facts(spark, sf_dir)).select("fact_id", facts.match_text().alias("match_text"))


_VALUE = r"coalesce(regexp_replace(value_num::VARCHAR, '\.0$', ''), value_text)"


@query(f"""SELECT fact_id, concat_ws(' ', nullif(subject, ''), nullif(predicate, ''), '= ' || nullif(coalesce({_VALUE}, object), ''), nullif(unit, ''), nullif(currency, ''),
  '(' || nullif(period, '') || ')', '[' || nullif(scope, '') || ']') AS statement FROM ({ORDER_FACTS})""")
def fact_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_facts(spark, sf_dir).select("fact_id", _statement().alias("statement"))


def _statement() -> Column:
    value = F.coalesce(t.stated_value(F.col("value_num"), F.col("value_text")), "object")
    return t.describe_fact(F.col("subject"), F.col("predicate"), value, F.col("unit"), F.col("currency"), F.col("period"), F.col("scope"))


_BOUNDED = f"""SELECT *, CASE WHEN page_number % 3 > 0 THEN CAST(created_at AS DATE) END AS period_start, CASE WHEN page_number % 4 > 0 THEN CAST(created_at AS DATE) END AS period_end FROM ({ORDER_FACTS}) AS o"""


@query(f"""SELECT fact_id, coalesce(p.period_start, g.period_start) AS period_start, coalesce(p.period_end, g.period_end) AS period_end,
  p.period_start AS normalized_period_start, p.period_end AS normalized_period_end
FROM ({_BOUNDED}) g JOIN (SELECT fact_id, {m.period_columns('period')} FROM ({ORDER_FACTS})) p USING (fact_id)""")
def fact_period_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that came with a fact stay where its period as written gives none."""
    rows = facts.normalize_facts(both(spark, sf_dir, _BOUNDED))
    return rows.select("fact_id", "period_start", "period_end", "normalized_period_start", "normalized_period_end")


@query(f"""SELECT fact_id, 'facts__' || owner AS facts_space, 'chunks__' || owner AS chunks_space, regexp_matches(md5(fact_id)[:20 + page_number % 10], '^[0-9a-fA-F]{{24}}$') AS is_id FROM ({ORDER_FACTS})""")
def record_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a workspace's vectors lie, and which of some would-be ids are ids."""
    owner = F.col("owner")
    given = F.md5("fact_id").substr(F.lit(1), 20 + F.col("page_number") % 10)
    return _order_facts(spark, sf_dir).select("fact_id", t.namespace("facts", owner).alias("facts_space"), t.namespace("chunks", owner).alias("chunks_space"), t.is_record_id(given).alias("is_id"))


@query(rf"""SELECT c_custkey, CASE WHEN regexp_matches(w, '^[a-z0-9][a-z0-9 ._-]*$') THEN w END AS workspace
FROM (SELECT c_custkey, substr({m.collapse_space("lower(raw)")}, 1, 40) AS w FROM (
  SELECT c_custkey, '  ' || c_name || CASE c_custkey % 4 WHEN 0 THEN ' / x' WHEN 1 THEN '   TEAM_' || c_mktsegment WHEN 2 THEN repeat('x', 60) ELSE '' END AS raw FROM customer))""")
def workspace_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("'  ' || c_name || CASE c_custkey % 4 WHEN 0 THEN ' / x' WHEN 1 THEN '   TEAM_' || c_mktsegment WHEN 2 THEN repeat('x', 60) ELSE '' END")
    return table(spark, sf_dir, "customer").select("c_custkey", t.workspace_name(raw).alias("workspace"))


# Evidence and validation.


_E, _C = m.normalize_evidence("b.text"), "d.large"


@query(f"""
WITH d AS (SELECT doc_id, {m.normalize_evidence('text')} AS large FROM documents)
SELECT b.item_id, d.doc_id FROM benchmark b JOIN d ON {_E} <> '' AND d.large <> ''
  AND (contains({_C}, {_E}) OR (length(replace({_E}, ' ', '')) >= 12 AND contains(replace({_C}, ' ', ''), replace({_E}, ' ', ''))))""")
def evidence_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document that contains it."""
    return grounding.occurrences(table(spark, sf_dir, "benchmark"), spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


_ISSUE_SQL = f"""
SELECT *, CASE WHEN trim(coalesce(subject, '')) = '' THEN 'missing_field' WHEN trim(coalesce(predicate, '')) = '' THEN 'missing_field' WHEN trim(coalesce(source_text, '')) = '' THEN 'missing_field'
  WHEN NOT (contains(c, e) OR (length(replace(e, ' ', '')) >= 12 AND contains(replace(c, ' ', ''), replace(e, ' ', '')))) THEN 'ungrounded_evidence'
  WHEN confidence IS NULL OR NOT confidence BETWEEN 0 AND 1 THEN 'invalid_confidence'
  WHEN value_num IS NULL AND trim(coalesce(value_text, '')) = '' AND trim(coalesce(object, '')) = '' THEN 'no_value' END AS issue_type
FROM (SELECT *, {m.normalize_evidence('source_text')} AS e, {m.normalize_evidence('chunk_text')} AS c FROM ({CANDIDATES}))"""


@query(f"SELECT fact_id, issue_type FROM ({_ISSUE_SQL})")
def fact_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.validated(both(spark, sf_dir, CANDIDATES)).select("fact_id", "issue_type")


@query(f"SELECT issue_type, count(*) AS n FROM ({_ISSUE_SQL}) WHERE issue_type IS NOT NULL GROUP BY issue_type")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, issues = facts.split_candidates(both(spark, sf_dir, CANDIDATES))
    return serving.class_totals(issues, "issue_type")


@query(f"""SELECT issue_type, fact_id, place FROM (SELECT issue_type, fact_id, row_number() OVER (PARTITION BY issue_type ORDER BY created_at DESC, fact_id DESC)::INTEGER AS place
  FROM ({_ISSUE_SQL}) WHERE issue_type IS NOT NULL) WHERE place <= 2""")
def showcase_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = facts.validated(both(spark, sf_dir, CANDIDATES)).where("issue_type IS NOT NULL")
    return serving.latest_per_type(marked, "created_at", "fact_id").select("issue_type", "fact_id", "place")


_REPLY = """SELECT conv_id, turn, CASE (conv_id + turn) % 4
  WHEN 0 THEN '<think>' || substr(role, 1, 4) || ' {x}</think>{"facts": [{"subject": "' || role || '", "turn": ' || CAST(turn AS STRING) || '}]}'
  WHEN 1 THEN '```json\n{"facts": [{"subject": "' || role || '"}]}\n```'
  WHEN 2 THEN 'Here you are: {"facts": []} as asked.' ELSE 'no facts for turn ' || CAST(turn AS STRING) END AS reply FROM conversations"""


@query(f"""WITH r AS (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(reply, '(?is)<think>.*?</think>', '', 'g')), '(?is)^```(?:json)?\\s*', ''), '\\s*```$', '')) AS bare FROM ({_REPLY}))
SELECT conv_id, turn, CASE WHEN regexp_matches(bare, '^[\\[{{]') THEN bare WHEN regexp_extract(bare, '(?s)([\\[{{].*[\\]}}])', 1) <> '' THEN regexp_extract(bare, '(?s)([\\[{{].*[\\]}}])', 1) ELSE bare END AS payload,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS n_facts FROM r""")
def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = t.json_payload(F.col("reply"))
    parsed = F.from_json(payload, "facts array<struct<subject string, turn int>>")
    rows = both(spark, sf_dir, _REPLY)
    return rows.select("conv_id", "turn", payload.alias("payload"), F.when(parsed["facts"].isNotNull(), F.size(parsed["facts"])).alias("n_facts"))


_ENVELOPES = """SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN '{"choices": [{"message": {"content": "```json\\\\n{\\\\"facts\\\\": [{\\\\"subject\\\\": \\\\"' || role || '\\\\"}]}\\\\n```"}}]}'
  WHEN 1 THEN '{"text": "{\\\\"facts\\\\": [{}, {}]}", "model": "m' || CAST(turn AS STRING) || '"}' WHEN 2 THEN '{"content": "{\\\\"facts\\\\": []}"}' WHEN 3 THEN '{"facts": "none"}'
  WHEN 4 THEN 'Sorry, { no facts of ' || role ELSE '<think>hm</think>{"facts": [{"subject": "s"}]} indeed' END AS reply FROM conversations"""


@query(f"""SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 3 THEN 'no_facts_array' WHEN 4 THEN 'malformed_json' ELSE 'ok' END AS outcome,
  CASE (conv_id + turn) % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 5 THEN 1 END AS n_facts, CASE (conv_id + turn) % 6 WHEN 1 THEN 'm' || turn END AS model,
  CASE (conv_id + turn) % 6 WHEN 4 THEN {m.collapse_space("substr(reply, 1, 200)")} END AS preview FROM ({_ENVELOPES.replace(chr(92) * 2, chr(92))})""")
def reply_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as strings, envelopes and objects: what they hold, and what is logged where they hold nothing."""
    rows = documents.replied_facts(both(spark, sf_dir, _ENVELOPES))
    return rows.select("conv_id", "turn", "outcome", F.when(F.col("outcome") == "ok", F.size("facts")).alias("n_facts"), "model", "preview")


# Reconciliation.


def revenue_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's yearly revenue by both books, some hundred facts: added up and normalised once, then read as a table."""
    return stored(facts.normalize_facts(stored(both(spark, sf_dir, REVENUE_FACTS), "books")), "revenue")


def _book_pairs(rows: DataFrame, same_year: bool) -> DataFrame:
    """Facts of the two books on one subject and metric, of the same year or of a year and the one before."""
    left, right = (reconcile.fact_struct(rows, x) for x in ("a", "b"))
    years = "b.page_number = a.page_number" if same_year else "b.page_number = a.page_number - 1"
    return left.join(right, F.expr(f"a.normalized_subject = b.normalized_subject AND a.normalized_predicate = b.normalized_predicate AND {years} AND a.document_id = 'orders-book' AND b.document_id = 'lines-book'"))


def _book_sql(same_year: bool) -> str:
    years = "b.page_number = a.page_number" if same_year else "b.page_number = a.page_number - 1"
    return f"""
WITH f AS ({m.filled(NORMALIZED, REVENUE_FACTS)}),
p AS (SELECT a.fact_id AS fact_a, b.fact_id AS fact_b, a.normalized_subject AS subject, least(a.confidence, b.confidence, 1.0) AS confidence, a.period_label AS pa, b.period_label AS pb,
    a.normalized_value AS va, b.normalized_value AS vb, a.page_number AS year_a, a.source_text AS ta, b.source_text AS tb, a.period_label = b.period_label AS same_period,
    abs(a.normalized_value - b.normalized_value) / greatest(abs(a.normalized_value), abs(b.normalized_value), 1.0) AS percentage_difference
  FROM f a JOIN f b ON a.normalized_subject = b.normalized_subject AND a.normalized_predicate = b.normalized_predicate AND {years}
  AND a.document_id = 'orders-book' AND b.document_id = 'lines-book'),
r AS (SELECT *, CASE WHEN NOT same_period THEN 'contextual_difference' WHEN percentage_difference <= 0.01 THEN 'corroborated' WHEN same_period THEN 'contradiction' ELSE 'uncertain' END AS relationship_type,
  CASE WHEN NOT same_period THEN 'period differs' END AS context FROM p)
SELECT * FROM r"""


@query(f"SELECT fact_a, fact_b, relationship_type, context, round(percentage_difference, 6) AS percentage_difference, confidence FROM ({_book_sql(True)})")
def reconcile_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the order book and the shipped lines agree on a nation's yearly revenue?"""
    rows = reconcile.reconciled(_book_pairs(revenue_facts(spark, sf_dir), True))
    return rows.select(F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"), "relationship_type", "context", F.round("percentage_difference", 6).alias("percentage_difference"), "confidence")


@query(f"SELECT relationship_type, count(*) AS n FROM ({_book_sql(True)}) GROUP BY relationship_type")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.class_totals(reconcile.reconciled(_book_pairs(revenue_facts(spark, sf_dir), True)))


@query(f"SELECT fact_a, fact_b, relationship_type, context FROM ({_book_sql(False)})")
def reconcile_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconcile.reconciled(_book_pairs(revenue_facts(spark, sf_dir), False))
    return rows.select(F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"), "relationship_type", "context")


_SEGMENTS = """SELECT 'seg-' || CAST(c_custkey AS STRING) || '-' || book AS fact_id, book AS document_id, 'p' AS page_id, 'c' AS chunk_id, 1 AS page_number, c_name AS subject,
  'market segment' AS predicate, CASE WHEN book = 'b' AND c_custkey % 3 = 0 THEN 'OTHER' ELSE c_mktsegment END AS object, CAST(NULL AS DOUBLE) AS value_num, CAST(NULL AS STRING) AS value_text,
  'text' AS value_type, CAST(NULL AS STRING) AS unit, CAST(NULL AS STRING) AS currency, CASE WHEN c_custkey % 2 = 0 THEN 'FY2024' END AS period, CAST(NULL AS STRING) AS scope,
  c_name || ' segment' AS source_text, 0.7 AS confidence
FROM customer JOIN (SELECT 'a' AS book UNION ALL SELECT 'b' AS book) AS books ON 1 = 1"""


@query("""SELECT 'seg-' || c_custkey || '-a' AS fact_a, CASE WHEN c_custkey % 3 <> 0 THEN 'corroborated' WHEN c_custkey % 2 = 0 THEN 'contradiction' ELSE 'uncertain' END AS relationship_type FROM customer""")
def reconcile_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.normalize_facts(both(spark, sf_dir, _SEGMENTS))
    left, right = (reconcile.fact_struct(rows, x) for x in ("a", "b"))
    pairs_ = left.where("a.document_id = 'a'").join(right.where("b.document_id = 'b'"), F.expr("a.normalized_subject = b.normalized_subject"))
    return reconcile.reconciled(pairs_).select(F.col("a.fact_id").alias("fact_a"), "relationship_type")


_APART = "abs(va - vb)"


@query(f"""SELECT fact_a, fact_b, relationship_type || ': ' || because AS summary, array_to_string([x FOR x IN sims IF x IS NOT NULL], ' ') AS similar, array_to_string([x FOR x IN diffs IF x IS NOT NULL], ' ') AS differ,
  'Fact A states: ''' || ta || ''' Fact B states: ''' || tb || '''. ' || because AS detailed_reason, 'Fact A ' || fact_a_page || ', Fact B ' || fact_b_page AS evidence FROM (
SELECT *, 'orders-page-' || year_a AS fact_a_page, 'lines-page-' || (year_a - 1) AS fact_b_page,
  CASE relationship_type {' '.join(f"WHEN {m.quoted(k)} THEN {m.quoted(v)}" for k, v in reconcile.CLASS_REASONS.items())} ELSE {m.quoted(reconcile.NO_METADATA)} END AS because,
  ['Both describe subject ''' || subject || '''.', 'Both describe metric ''revenue''.', CASE WHEN same_period THEN 'Both refer to period ''' || pa || '''.' END, 'Both refer to scope ''consolidated''.', 'Currency is compatible: USD.'] AS sims,
  [CASE WHEN NOT same_period THEN 'Periods differ: Fact A is ''' || pa || '''; Fact B is ''' || pb || '''.' END,
   CASE WHEN percentage_difference > 0.01 THEN 'Values differ by ' || CASE WHEN {_APART} >= 1e9 THEN printf('%.2f billion', {_APART} / 1e9) WHEN {_APART} >= 1e6 THEN printf('%.2f million', {_APART} / 1e6)
     WHEN {_APART} >= 1000 THEN regexp_replace(regexp_replace(printf('%,.2f', {_APART}), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') ELSE regexp_replace(regexp_replace(printf('%.4f', {_APART}), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END
     || ', a ' || printf('%.1f%%', percentage_difference * 100) || ' relative difference.' END] AS diffs
FROM ({_book_sql(False)}))""")
def explain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is said of two neighbouring years: what agrees, what differs and by how much, and where it stands."""
    rows = reconcile.explained(reconcile.reconciled(_book_pairs(revenue_facts(spark, sf_dir), False)))
    where = F.array_join(F.transform("evidence", lambda x: F.concat_ws(" ", x["fact"], F.when(x["evidence_available"], x["page_id"]))), ", ")
    return rows.select(
        F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"), "summary", F.array_join("key_similarities", " ").alias("similar"),
        F.array_join("key_differences", " ").alias("differ"), "detailed_reason", where.alias("evidence"),
    )


# Vectors and candidate pairs.


def vector_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as facts: the label is the document, three workspaces, six subjects and five metrics."""
    rows = vectors.usable(table(spark, sf_dir, "embeddings"))
    return rows.select(
        F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("fact_id"), F.concat(F.lit("w"), (F.col("vec_id") % 3).cast("string")).alias("owner"),
        F.concat(F.lit("d"), F.col("label").cast("string")).alias("document_id"), "embedding",
        F.concat(F.lit("subject "), (F.col("vec_id") % 2).cast("string")).alias("normalized_subject"), F.concat(F.lit("metric_"), (F.col("vec_id") % 5 % 2).cast("string")).alias("normalized_predicate"),
        F.expr("CASE vec_id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'currency' WHEN 2 THEN 'percentage' END").alias("value_type"), F.expr("'FY' || CAST(2020 + vec_id % 3 AS STRING)").alias("period_label"),
        F.expr("CAST(vec_id % 101 AS DOUBLE) / 100").alias("confidence"),
        F.expr("CAST(100 + vec_id % 4 AS DOUBLE)").alias("normalized_value"), F.expr("'Company ' || CAST(vec_id % 7 AS STRING)").alias("subject"), F.expr("'Metric No. ' || CAST(vec_id % 11 AS STRING)").alias("predicate"),
        F.expr("CASE WHEN vec_id % 3 > 0 THEN 'fiscal ' || CAST(2020 + vec_id % 3 AS STRING) END").alias("period"), F.lit(None).cast("string").alias("scope"),
        F.expr("'As reported by vector ' || CAST(vec_id AS STRING) || repeat(' again', CAST(vec_id % 60 AS INT))").alias("source_text"),
    )


VECTOR_FACTS = """SELECT 'v' || lpad(vec_id::VARCHAR, 9, '0') AS fact_id, 'w' || (vec_id % 3) AS owner, 'd' || label AS document_id, embedding::DOUBLE[] AS e, 'subject ' || (vec_id % 2) AS s, 'metric_' || (vec_id % 5 % 2) AS p,
  CASE vec_id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'currency' WHEN 2 THEN 'percentage' END AS value_type, 'FY' || (2020 + vec_id % 3) AS period_label, (vec_id % 101)::DOUBLE / 100 AS confidence, (100 + vec_id % 4)::DOUBLE AS v,
  'subject="Company ' || (vec_id % 7) || '", metric="Metric No. ' || (vec_id % 11) || '", period="' || CASE WHEN vec_id % 3 > 0 THEN 'fiscal ' || (2020 + vec_id % 3) ELSE '' END || '", scope="", evidence="'
  || substr('As reported by vector ' || vec_id || repeat(' again', (vec_id % 60)::INT), 1, 220) || '"' AS told
FROM embeddings WHERE list_max([abs(x) FOR x IN embedding]) > 0"""
MATCHES = f"""SELECT * FROM (SELECT q.fact_id, c.fact_id AS candidate_id, q.document_id AS qd, c.document_id AS cd, round(list_cosine_similarity(q.e, c.e), 6) AS similarity,
  row_number() OVER (PARTITION BY q.fact_id ORDER BY round(list_cosine_similarity(q.e, c.e), 6) DESC, c.fact_id)::INTEGER AS rank
  FROM ({VECTOR_FACTS}) q JOIN ({VECTOR_FACTS}) c ON q.owner = c.owner) WHERE rank <= 20"""


@query(f"SELECT fact_id, candidate_id, similarity, rank FROM ({MATCHES})")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_facts(spark, sf_dir)
    return vectors.similar(rows, rows).select("fact_id", "candidate_id", "similarity", "rank")


@query(f"SELECT fact_id, candidate_id, similarity, rank FROM ({MATCHES}) WHERE qd <> cd")
def knn_cross_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.document_matches(vector_facts(spark, sf_dir)).select("fact_id", "candidate_id", "similarity", "rank")


@query("""WITH v AS (SELECT vec_id, 'w' || (vec_id % 3) AS owner, CASE WHEN vec_id % 7 = 0 THEN list_reverse(embedding::DOUBLE[]) ELSE embedding::DOUBLE[] END AS e FROM embeddings
  WHERE vec_id % 11 <> 0 AND list_max([abs(x) FOR x IN embedding]) > 0)
SELECT fact_id, candidate_id, similarity, rank FROM (
  SELECT 'v' || lpad(q.vec_id::VARCHAR, 9, '0') AS fact_id, 'v' || lpad(c.vec_id::VARCHAR, 9, '0') AS candidate_id, round(list_cosine_similarity(q.e, c.e), 6) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, c.e), 6) DESC, c.vec_id)::INTEGER AS rank
  FROM v q JOIN v c ON q.owner = c.owner) WHERE rank <= 10""")
def kept_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each vector in a kept table after a first load, and a change that turns some vectors round, adds some and takes others out."""
    rows = vector_facts(spark, sf_dir).select("fact_id", "owner", "embedding")
    number = F.substring("fact_id", 2, 9).cast("long")
    kept = vector_table.kept(spark, buckets=16)
    kept.change(rows.where(number % 10 < 8), rows.select("fact_id").limit(0), 0)
    turned = rows.withColumn("embedding", F.when(number % 7 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    kept.change(turned.where((number % 11 != 0) & ((number % 10 >= 8) | (number % 7 == 0))), rows.where(number % 11 == 0).select("fact_id"), 1)
    return kept.search(turned.where(number % 11 != 0), 10)


#: The vectors of the tables are far apart, so their thresholds are low.
NEAR = DEFAULTS.__class__(similarity_threshold=0.2, adjudication_similarity=0.25, match_confidence_threshold=0.15)
_FIRST = f"""SELECT *, least(fact_id, candidate_id) AS fact_a, greatest(fact_id, candidate_id) AS fact_b FROM ({MATCHES}) WHERE qd <> cd AND fact_id <> candidate_id AND similarity >= %s
  QUALIFY row_number() OVER (PARTITION BY least(fact_id, candidate_id), greatest(fact_id, candidate_id) ORDER BY fact_id, rank) = 1"""
_COMPARED = f"""SELECT m.*, a.s = b.s AS same_subject, a.p = b.p AS same_predicate, a.value_type IS NULL OR b.value_type IS NULL OR
    CASE a.value_type WHEN 'percentage' THEN 0 ELSE 1 END = CASE b.value_type WHEN 'percentage' THEN 0 ELSE 1 END AS same_type, a.period_label = b.period_label AS same_period, least(a.confidence, b.confidence) AS sure, a.told AS told_a, b.told AS told_b,
    abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1.0) AS apart, abs(a.v - b.v)::INTEGER AS step
  FROM ({_FIRST}) m JOIN ({VECTOR_FACTS}) a ON a.fact_id = m.fact_a JOIN ({VECTOR_FACTS}) b ON b.fact_id = m.fact_b"""
_KEPT = "'; value type compatible; object compatible; unit compatible; currency compatible' || CASE WHEN same_period THEN '' ELSE '; period differs; preserved for later analysis' END"


@query(f"""SELECT fact_a, fact_b, similarity, least(similarity, sure) AS confidence, 'subject matches; predicate matches' || {_KEPT} AS reason
FROM ({m.filled(_COMPARED, NEAR.similarity_threshold)}) WHERE same_subject AND same_predicate AND same_type AND similarity >= {NEAR.match_confidence_threshold}""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_facts(spark, sf_dir)
    found = pairs.candidate_pairs(vectors.document_matches(rows).select("fact_id", "candidate_id", "similarity", "rank"), rows, NEAR)
    return found.select("fact_a", "fact_b", "similarity", "confidence", "reason")


_POOL = f"""SELECT *, row_number() OVER (PARTITION BY qd ORDER BY fact_id, rank)::INTEGER AS encounter
FROM ({m.filled(_COMPARED, NEAR.adjudication_similarity)}) WHERE NOT (same_subject AND same_predicate) QUALIFY encounter <= 400"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_facts(spark, sf_dir)
    return pairs.adjudication_pool(vectors.document_matches(rows).select("fact_id", "candidate_id", "similarity", "rank"), rows, NEAR)


@query(f"SELECT qd AS document_id, encounter, fact_a, fact_b, CASE WHEN NOT same_subject THEN 'subject differs' ELSE 'predicate differs' END AS reason FROM ({_POOL})")
def adjudication_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).select("document_id", "encounter", "fact_a", "fact_b", "reason")


@query(f"""SELECT fact_a, fact_b, similarity, similarity * 0.9 AS matching_score, 'subject and metric judged equivalent by adjudicator (same metric)' || {_KEPT} AS reason
FROM ({_POOL}) WHERE same_predicate AND same_type AND similarity * 0.9 >= {NEAR.match_confidence_threshold}""")
def adjudicated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge stands in that calls pairs with one metric the same."""
    pool = stored(_pool(spark, sf_dir), "pool")
    verdicts = pool.select("pair_key", F.expr("a.normalized_predicate = b.normalized_predicate").alias("same"), F.lit("same metric").alias("reason"))
    return pairs.adjudicated_pairs(pool, verdicts, NEAR).select("fact_a", "fact_b", "similarity", "matching_score", "reason")


_REVIEWED = f"""SELECT fact_a, fact_b, adjudicated, least(sure, similarity) AS confidence, apart, step,
  CASE WHEN NOT same_period THEN 'contextual_difference' WHEN apart <= 0.01 THEN 'corroborated' ELSE 'contradiction' END AS relationship_type FROM (
  SELECT *, false AS adjudicated FROM ({m.filled(_COMPARED, NEAR.similarity_threshold)}) WHERE same_subject AND same_predicate AND same_type AND similarity >= {NEAR.match_confidence_threshold}
  UNION ALL BY NAME SELECT * EXCLUDE (encounter), true AS adjudicated FROM ({_POOL}) WHERE same_predicate AND same_type AND similarity * 0.9 >= {NEAR.match_confidence_threshold})"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the identity rules and pairs that a judge calls the same, reconciled together."""
    rows = stored(vector_facts(spark, sf_dir), "facts")
    matches = stored(vectors.document_matches(rows).select("fact_id", "candidate_id", "similarity", "rank"), "matches")
    pool = stored(pairs.adjudication_pool(matches, rows, NEAR), "pool")
    verdicts = pool.select("pair_key", F.expr("a.normalized_predicate = b.normalized_predicate").alias("same"), F.lit("same metric").alias("reason"))
    found = pairs.united(pairs.candidate_pairs(matches, rows, NEAR), pairs.adjudicated_pairs(pool, verdicts, NEAR))
    rows = reconcile.explained(reconcile.reviewed(found)).withColumn("adjudicated", F.coalesce("adjudicated_same", F.lit(False)))
    return stored(rows.select("fact_a", "fact_b", "adjudicated", "confidence", "relationship_type", "status", "reason", "context", "summary", "key_differences"), "reviewed")


@query(f"SELECT fact_a, fact_b, adjudicated, confidence, relationship_type, 'reviewed' AS status FROM ({_REVIEWED})")
def reviewed_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).select("fact_a", "fact_b", "adjudicated", "confidence", "relationship_type", "status")


# Relationships kept up to date.

_BALANCE = re.compile(r"(Client [0-9]+) (balance) in (FY[0-9]{4}) was (-?[0-9]+\.[0-9]{2}) (USD)")


def balance_statements(text: str) -> list[dict]:
    """What the made-up books of balances state."""
    return [
        {"subject": x[1], "predicate": x[2], "period": x[3], "value_text": x[4], "currency": x[5], "source_text": x[0], "confidence": 0.9}
        for x in _BALANCE.finditer(text)
    ]


#: Three books with a document for each nation, in two deliveries: in the second, the second book of some nations is restated, of
#: others withdrawn, and some get a third.
_BOOKS = """SELECT book || '-' || CAST(c_nationkey AS STRING) AS document_id, 'team ' || CAST(c_nationkey % 2 AS STRING) AS owner, c_custkey,
  CAST(c_custkey % 3 + 1 AS INT) AS page_number, delivery, c_nationkey % 5 AS kind,
  CAST(c_acctbal + CASE WHEN book = 'b' AND delivery = 1 AND c_custkey % 3 = 0 THEN 100 ELSE 0 END AS DECIMAL(18,2)) AS amount,
  CASE WHEN book = 'b' AND c_custkey % 7 = 0 THEN 'FY2023' ELSE 'FY2024' END AS period
FROM customer JOIN (SELECT 'a' AS book, 1 AS delivery UNION ALL SELECT 'b', 1 UNION ALL SELECT 'b', 2 UNION ALL SELECT 'c', 2) AS books ON 1 = 1
WHERE delivery = 1 OR (book = 'b' AND c_nationkey % 5 IN (1, 2)) OR (book = 'c' AND c_nationkey % 5 = 3)"""


def _delivery(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """Pages of one delivery; what is withdrawn has no text."""
    rows = both(spark, sf_dir, _BOOKS).where(F.col("delivery") == number)
    said = F.concat(F.lit("Client "), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(" balance in "), "period", F.lit(" was "), F.col("amount").cast("string"), F.lit(" USD."))
    pages = rows.groupBy("document_id", "owner", "page_number", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", said.alias("said")))), lambda x: x["said"]), " ").alias("text"))
    return pages.select("document_id", "owner", "page_number", F.when(~((F.lit(number) == 2) & (F.col("kind") == 2)), F.col("text")).alias("text"))


@query(f"""WITH f AS (SELECT * FROM ({_BOOKS}) WHERE NOT (document_id LIKE 'b-%' AND (kind = 2 OR (kind = 1 AND delivery = 1))))
SELECT a.document_id AS document_a, b.document_id AS document_b, a.c_custkey AS client,
  CASE WHEN a.period <> b.period THEN 'contextual_difference' WHEN abs(a.amount - b.amount)::DOUBLE / greatest(abs(a.amount), abs(b.amount), 1.0)::DOUBLE <= 0.01 THEN 'corroborated' ELSE 'contradiction' END AS relationship_type
FROM f a JOIN f b ON a.c_custkey = b.c_custkey AND a.document_id < b.document_id""")
def maintained_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships after two deliveries of pages, the second of which restates, withdraws and adds documents."""
    state = maintain.followed(spark, scratch(spark, "maintained"), [lambda: _delivery(spark, sf_dir, 1), lambda: _delivery(spark, sf_dir, 2)], extractor=balance_statements, buckets=16)
    client = F.regexp_extract("fact_group", "client ([0-9]+)", 1).cast("long")
    return state.relationships().select(F.least("document_a", "document_b").alias("document_a"), F.greatest("document_a", "document_b").alias("document_b"), client.alias("client"), "relationship_type")


# Serving.


@query(f"SELECT c.fact_id, c.document_id, m.similarity, m.rank FROM ({MATCHES}) m JOIN ({VECTOR_FACTS}) c ON c.fact_id = m.candidate_id WHERE m.fact_id = 'v000000000' AND m.rank <= 10")
def fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten facts nearest to fact 0 in its workspace."""
    rows = vector_facts(spark, sf_dir)
    found = vectors.similar(rows.where("fact_id = 'v000000000'"), rows, serving.checked_k(10)).select("candidate_id", "similarity", "rank")
    return serving.hydrated(found, rows.select("fact_id", "document_id"), "candidate_id", "fact_id").select(F.col("candidate_id").alias("fact_id"), "document_id", "similarity", "rank")


_RELATIONS = f"SELECT fact_a, fact_b, confidence FROM ({ORACLES['candidate_pairs']})"


@query(f"""WITH r AS ({_RELATIONS}), d AS (SELECT fact_id FROM ({VECTOR_FACTS}) WHERE document_id = 'd1')
SELECT fact_a, fact_b, confidence FROM r WHERE fact_a IN (FROM d) OR fact_b IN (FROM d)""")
def relationships_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = candidate_pairs(spark, sf_dir).select("fact_a", "fact_b", "confidence")
    return serving.relationships_touching(relations, vector_facts(spark, sf_dir).where("document_id = 'd1'"))


@query(f"""WITH r AS ({_RELATIONS}), d AS (SELECT fact_id FROM ({VECTOR_FACTS}) WHERE document_id = 'd1')
SELECT DISTINCT CASE WHEN fact_a IN (FROM d) THEN fact_b ELSE fact_a END AS fact_id FROM r WHERE (fact_a IN (FROM d)) <> (fact_b IN (FROM d))""")
def ask_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = candidate_pairs(spark, sf_dir).select("fact_a", "fact_b", "confidence")
    return serving.neighbours(relations, vector_facts(spark, sf_dir).where("document_id = 'd1'"))


_CASES = f"""SELECT *, round(confidence + CASE relationship_type WHEN 'corroborated' THEN 0.5 WHEN 'contradiction' THEN least(0.5, percentage_difference) WHEN 'contextual_difference' THEN 0.25 ELSE 0 END + 0.05, 6) AS case_score FROM (
  SELECT *, row_number() OVER (PARTITION BY relationship_type ORDER BY confidence DESC, fact_a, fact_b) AS n FROM (SELECT * FROM ({_book_sql(True)}) UNION ALL SELECT * FROM ({_book_sql(False)}))) WHERE n <= 60"""


def _book_relationships(books: DataFrame) -> DataFrame:
    rows = reconcile.reconciled(_book_pairs(books, True).unionByName(_book_pairs(books, False)))
    return rows.withColumns({"fact_a": F.col("a.fact_id"), "fact_b": F.col("b.fact_id"), "adjudicated": F.lit(False)})


@query(f"""SELECT relationship_type, place, fact_a, fact_b, case_score, place = 1 AS is_best FROM (
  SELECT *, row_number() OVER (PARTITION BY relationship_type ORDER BY case_score DESC, confidence DESC, fact_a, fact_b)::INTEGER AS place FROM ({_CASES}))
WHERE place <= CASE relationship_type WHEN 'uncertain' THEN 2 ELSE 3 END""")
def showcase_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serving.showcase_cases(_book_relationships(revenue_facts(spark, sf_dir)))
    return rows.select("relationship_type", "place", "fact_a", "fact_b", F.round("case_score", 6).alias("case_score"), "is_best")


@query(f"""SELECT 'relationships' AS part, relationship_type AS name, count(*) AS n FROM (SELECT * FROM ({_book_sql(True)}) UNION ALL SELECT * FROM ({_book_sql(False)})) GROUP BY ALL
UNION ALL SELECT 'facts', document_id, count(*) FROM ({REVENUE_FACTS}) GROUP BY ALL""")
def showcase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revenue_facts(spark, sf_dir)
    kinds = serving.class_totals(_book_relationships(found)).select(F.lit("relationships").alias("part"), F.col("relationship_type").alias("name"), "n")
    books = serving.class_totals(found, "document_id").select(F.lit("facts").alias("part"), F.col("document_id").alias("name"), "n")
    return kinds.unionByName(books)


@query(f"""SELECT part, map_from_entries(list((name, n) ORDER BY name))::VARCHAR AS totals FROM ({ORACLES["showcase_totals"]}) GROUP BY part""")
def showcase_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals as one map for each part, as a reader gets them."""
    rows = serving.folded(showcase_totals(spark, sf_dir), "part", "name")
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("totals"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ", "), F.lit("}"))
    return rows.select("part", text.alias("totals"))


#: The query vector of a question, and the chunks it is compared with.
QUESTION = "What did the company report as its revenue for the year?"


def vectors_sql(source: str, key: str, text: str) -> str:
    """key and e: the offline model's vector of each row's text."""
    tidy = m.collapse_space(f"lower({m.text_(text)})")
    return f"""SELECT {key}, [x / sqrt(list_sum([y * y FOR y IN s])) FOR x IN s] AS e FROM (
  SELECT {key}, [coalesce(element_at(sums, k)[1], 0)::DOUBLE FOR k IN range(64)] AS s FROM (
    SELECT {key}, map_from_entries(list((slot, n))) AS sums FROM (
      SELECT {key}, (h >> 16) % 64 AS slot, sum(CASE WHEN (h >> 8) % 2 = 1 THEN 1 ELSE -1 END) AS n FROM (
        SELECT {key}, ((unicode(g[1])::BIGINT * 961 + unicode(g[2]) * 31 + unicode(g[3])) * 2654435761) % 4294967296 AS h FROM (
          SELECT {key}, unnest(list_zip(l, l[2:], l[3:])) AS g FROM (
            SELECT {key}, string_split(CASE WHEN w = '' THEN '   ' ELSE ' ' || w || ' ' END, '') AS l FROM (SELECT {key}, {tidy} AS w FROM {source}))) WHERE g[3] IS NOT NULL)
      GROUP BY ALL) GROUP BY ALL))"""


_CHUNKS = chunk_sql(1200).replace("md5(text) AS text_md5", "text AS text")
_PASSAGES = f"""SELECT q.item_id, c.chunk_id, round(list_cosine_similarity(q.e, c.e), 6) AS similarity,
  row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_cosine_similarity(q.e, c.e), 6) DESC, c.chunk_id)::INTEGER AS rank
FROM (%s) q CROSS JOIN ({vectors_sql(f"(SELECT * FROM ({_CHUNKS}) WHERE status <> 'skipped')", "chunk_id", "text")}) c"""


def _chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = stored(documents.chunk_records(_chunked(spark, sf_dir, 1200), embed(F.col("text"))), "chunk_vectors")
    return vectors.checked_dimension(chunks, 64).withColumns({"owner": F.lit("demo"), "fact_id": F.col("chunk_id")})


@query(f"""SELECT p.item_id, p.chunk_id, k.document_id::VARCHAR AS document_id, p.similarity, p.rank, md5(substr(k.text, 1, 1200)) AS quote
FROM ({m.filled(_PASSAGES, vectors_sql("benchmark", "item_id", "text"))}) p JOIN ({_CHUNKS}) k USING (chunk_id) WHERE p.rank <= 6""")
def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six chunks nearest to each benchmark passage, with their documents and the start of their text."""
    chunks = _chunk_vectors(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("fact_id"), F.lit("demo").alias("owner"), embed(F.col("text")).alias("embedding"))
    found = stored(vectors.similar(asked, chunks.select("fact_id", "owner", "embedding"), serving.checked_k(6)).withColumnRenamed("candidate_id", "chunk_id"), "found")
    rows = serving.hydrated(found, chunks.select("chunk_id", "document_id", "text"), "chunk_id", "chunk_id")
    quote = F.md5(F.substring("text", 1, 1200)).alias("quote")
    return rows.select(F.col("fact_id").cast("long").alias("item_id"), "chunk_id", F.col("document_id").cast("string").alias("document_id"), "similarity", "rank", quote)


_TOUCHING = f"""SELECT * FROM ({_REVIEWED}) WHERE fact_a IN (FROM near) OR fact_b IN (FROM near) ORDER BY confidence DESC, fact_a, fact_b LIMIT 8"""
_ASKED = f"""near AS (SELECT candidate_id FROM ({MATCHES}) WHERE fact_id = 'v000000000' AND rank <= 8),
touching AS ({_TOUCHING}),
used AS (SELECT candidate_id AS fact_id, 0 AS k, rank FROM ({MATCHES}) WHERE fact_id = 'v000000000' AND rank <= 8
  UNION ALL SELECT DISTINCT f, 1, 0 FROM (SELECT unnest([fact_a, fact_b]) AS f FROM touching) WHERE f NOT IN (FROM near)),
question AS (SELECT 0 AS item_id, {m.quoted(QUESTION)} AS text),
passages AS (SELECT chunk_id, rank FROM ({m.filled(_PASSAGES, vectors_sql("question", "item_id", "text"))}) WHERE rank <= 4),
sources AS (SELECT 'S' || row_number() OVER (ORDER BY k, rank, coalesce(fact_id, chunk_id)) AS source_id, * FROM (
  SELECT 'fact' AS kind, fact_id, NULL AS chunk_id, k, rank FROM used UNION ALL SELECT 'passage', NULL, chunk_id, 2, rank FROM passages))"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sources and relationships of an answer about fact 0: its eight nearest facts, the surest relationships that touch
    them with the facts at their other ends, and the four passages nearest to a question."""
    rows = vector_facts(spark, sf_dir)
    near = stored(vectors.similar(rows.where("fact_id = 'v000000000'"), rows, serving.checked_k(8, 30)).select(F.col("candidate_id").alias("fact_id"), "rank", "similarity"), "near")
    touching = stored(serving.surest_touching(_reviewed(spark, sf_dir), near), "touching")
    chunks = _chunk_vectors(spark, sf_dir)
    asked = spark.range(1).select(F.lit("question").alias("fact_id"), F.lit("demo").alias("owner"), embed(F.lit(QUESTION)).alias("embedding"))
    passages = vectors.similar(asked, chunks.select("fact_id", "owner", "embedding"), max(3, min(6, -(-8 // 2)))).join(chunks.select(F.col("chunk_id").alias("candidate_id"), "document_id", "page_number", "text"), "candidate_id")
    told = serving.answer_facts(near.select("fact_id", "rank"), touching).join(rows.select("fact_id", "document_id", "source_text", _vector_statement().alias("statement")), "fact_id").join(near.select("fact_id", "similarity"), "fact_id", "left")
    order = F.struct(F.lit(2).alias("k"), F.col("rank").cast("int").alias("rank"), F.col("candidate_id").alias("id"))
    sources = serving.numbered_sources(
        told.select("fact_id", "order_in", "document_id", F.lit(None).cast("int").alias("page_number"), "statement", F.col("source_text").alias("quote"), F.col("similarity").alias("score"), F.lit(None).cast("string").alias("chunk_id")),
        passages.select(order.alias("order_in"), F.col("document_id").cast("string").alias("document_id"), "page_number", F.lit(None).cast("string").alias("statement"), F.substring("text", 1, 1200).alias("quote"), F.col("similarity").alias("score"), F.col("candidate_id").alias("chunk_id")),
    )
    return stored(serving.named_sources(sources, _asked_documents(spark, sf_dir)), "sources"), touching


def _vector_statement() -> Column:
    none = F.lit(None).cast("string")
    value = t.stated_value(F.col("normalized_value"), none)
    return t.describe_fact(F.col("subject"), F.col("predicate"), value, none, none, F.col("period"), F.col("scope"))


_ENTITY_REPLIES = """SELECT DISTINCT 'd' || CAST(label AS STRING) AS document_id, ' Company ' || CAST(label % 7 AS STRING) || ' ' AS entity, CAST(label % 4 AS DOUBLE) / 4 AS confidence FROM embeddings"""
_ENTITIES = f"SELECT document_id, CASE WHEN confidence >= 0.5 THEN trim(entity) END AS primary_entity FROM ({_ENTITY_REPLIES}) AS r"


@query(_ENTITIES)
def primary_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a document is about, where a model's reply is sure enough of it."""
    return documents.primary_entities(both(spark, sf_dir, _ENTITY_REPLIES))


_NAMES = """SELECT DISTINCT 'd' || CAST(label AS STRING) AS document_id, 'Report ' || CAST(label AS STRING) AS document_name FROM embeddings WHERE label % 3 <> 2
UNION ALL SELECT CAST(doc_id AS STRING), source || ' ' || lang FROM documents"""


def _asked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of documents, some unknown, and their entities."""
    return both(spark, sf_dir, _NAMES).join(primary_entities(spark, sf_dir), "document_id", "left")


_TOLD = f"""SELECT vec_id, 'Company ' || (vec_id % 7) || ' Metric No. ' || (vec_id % 11) || ' = ' || (100 + vec_id % 4) || CASE WHEN vec_id % 3 > 0 THEN ' (fiscal ' || (2020 + vec_id % 3) || ')' ELSE '' END AS statement,
  'As reported by vector ' || vec_id || repeat(' again', (vec_id % 60)::INT) AS quote, 'd' || label AS document_id FROM embeddings"""


@query(f"""WITH {_ASKED}, e AS ({_ENTITIES}), n AS ({_NAMES}),
f AS (SELECT s.*, t.document_id, NULL::INTEGER AS page_number, t.statement, t.quote, m.similarity AS score FROM sources s JOIN ({_TOLD}) t ON s.fact_id = 'v' || lpad(t.vec_id::VARCHAR, 9, '0')
  LEFT JOIN (SELECT candidate_id, similarity FROM ({MATCHES}) WHERE fact_id = 'v000000000' AND rank <= 8) m ON m.candidate_id = s.fact_id),
p AS (SELECT s.*, k.document_id::VARCHAR AS document_id, k.page_number, NULL AS statement, substr(k.text, 1, 1200) AS quote, q.similarity AS score FROM sources s JOIN ({_CHUNKS}) k USING (chunk_id)
  JOIN ({m.filled(_PASSAGES, vectors_sql("question", "item_id", "text"))}) q USING (chunk_id))
SELECT source_id, kind, fact_id, chunk_id, u.document_id, coalesce(document_name, 'Unknown document') AS document_name, primary_entity, page_number, statement, md5(quote) AS quote_md5, score
FROM (FROM f UNION ALL FROM p) u LEFT JOIN n ON n.document_id = u.document_id LEFT JOIN e ON e.document_id = n.document_id""")
def ask_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that an answer is told of its sources."""
    columns = ["source_id", "kind", "fact_id", "chunk_id", "document_id", "document_name", "primary_entity", "page_number", "statement"]
    return _asked(spark, sf_dir)[0].select(*columns, F.md5("quote").alias("quote_md5"), "score")


@query(f"""WITH {_ASKED} SELECT t.fact_a, t.fact_b, t.relationship_type, t.confidence, a.source_id AS source_a, b.source_id AS source_b, NULL::VARCHAR AS context,
  CASE relationship_type WHEN 'corroborated' THEN {m.quoted(reconcile.REASONS['corroborated'])} ELSE {m.quoted(reconcile.REASONS['contradiction'])} END AS reason,
  relationship_type || ': ' || {m.quoted(reconcile.NO_EVIDENCE)} AS summary,
  CASE WHEN apart > 0.01 THEN 'Values differ by ' || step || ', a ' || printf('%.1f%%', apart * 100) || ' relative difference. ' ELSE '' END || 'Evidence is unavailable for one or both facts.' AS differ
FROM touching t JOIN sources a ON a.fact_id = t.fact_a JOIN sources b ON b.fact_id = t.fact_b""")
def ask_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer is told of how its facts agree, by the ids of their sources."""
    sources, touching = _asked(spark, sf_dir)
    notes = serving.relationship_notes(touching, sources).withColumn("differ", F.array_join("key_differences", " "))
    return notes.select("fact_a", "fact_b", "relationship_type", "confidence", "source_a", "source_b", "context", "reason", "summary", "differ")


_REPLIES = """SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN '```json\\n{"answer": " Revenue rose [S1]. ", "confidence": ' || CAST(turn AS STRING) || '.5, "coverage": "full", "notes": ["first", "second"], "citations": [{"source": "s2", "quote": "q of ' || role || '"}]}\\n```'
  WHEN 1 THEN 'Plain words of ' || role WHEN 2 THEN '{"answer": "none", "coverage": "odd", "notes": "text"}' ELSE '{"answer": "low", "confidence": -3, "coverage": "none", "citations": []}' END AS reply FROM conversations"""


@query(f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Revenue rose [S1].' WHEN 1 THEN trim(reply) WHEN 2 THEN 'none' ELSE 'low' END AS answer,
  CASE turn % 4 WHEN 0 THEN least(1.0, turn + 0.5) WHEN 1 THEN 0.3 ELSE 0.0 END::DOUBLE AS confidence, CASE turn % 4 WHEN 0 THEN 'full' WHEN 3 THEN 'none' ELSE 'partial' END AS coverage,
  CASE turn % 4 WHEN 0 THEN 'first; second' WHEN 1 THEN {m.quoted(documents.VERBATIM)} ELSE '' END AS notes, CASE turn % 4 WHEN 0 THEN 's2: q of ' || role ELSE '' END AS cited FROM ({_REPLIES.replace(chr(92) + "n", " ")})""")
def answer_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model that answers, as JSON or not, made fit to show."""
    rows = documents.parsed_answers(both(spark, sf_dir, _REPLIES))
    return rows.select("conv_id", "turn", "answer", "confidence", "coverage", F.array_join("notes", "; ").alias("notes"), F.array_join(F.transform("citations", lambda x: F.concat_ws(": ", x["source"], x["quote"])), "; ").alias("cited"))


_ANSWERS = """SELECT o_orderkey AS answer_id, 'Revenue rose [S' || CAST(o_orderkey % 5 + 1 AS STRING) || '] and fell [S' || CAST(o_custkey % 7 + 1 AS STRING) || '] [S99].' AS answer,
  's' || CAST(o_orderkey % 3 + 1 AS STRING) AS cited, CASE o_orderkey % 4 WHEN 0 THEN 'as ordered by ' || o_orderpriority WHEN 1 THEN '' END AS given FROM orders"""
_SOURCES = "SELECT 'S' || CAST(n_nationkey + 1 AS STRING) AS source_id, n_name AS quote FROM nation"


@query(f"""WITH a AS ({_ANSWERS}), s AS ({_SOURCES}), l AS (SELECT answer_id, upper(cited) AS source_id, true AS listed, given FROM a),
g AS (SELECT DISTINCT answer_id, replace(replace(unnest(regexp_extract_all(answer, '\\[S\\d+\\]')), '[', ''), ']', '') AS source_id, false AS listed, NULL AS given FROM a)
SELECT u.answer_id, u.source_id, u.listed, coalesce(nullif(given, ''), s.quote) AS quote FROM (FROM l UNION ALL SELECT * FROM g ANTI JOIN l USING (answer_id, source_id)) u JOIN s USING (source_id)""")
def ask_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = both(spark, sf_dir, _ANSWERS).withColumn("citations", F.array(F.struct(F.col("cited").alias("source"), F.col("given").alias("quote"))))
    return serving.resolved_citations(answers, both(spark, sf_dir, _SOURCES)).select("answer_id", "source_id", "listed", "quote")


@query(f"""SELECT d.document_id, coalesce(f.n, 0) AS facts_count, coalesce(i.n, 0) AS issues_count FROM (SELECT DISTINCT document_id FROM ({ORDER_FACTS})) d
LEFT JOIN (SELECT document_id, count(*) AS n FROM ({_ISSUE_SQL}) WHERE issue_type IS NULL GROUP BY ALL) f USING (document_id)
LEFT JOIN (SELECT document_id, count(*) AS n FROM ({_ISSUE_SQL}) WHERE issue_type IS NOT NULL GROUP BY ALL) i USING (document_id)""")
def document_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both counts read one validation.
    marked = stored(facts.validated(both(spark, sf_dir, CANDIDATES)).select("document_id", "issue_type"), "marked")
    valid, issues = marked.where("issue_type IS NULL"), marked.where("issue_type IS NOT NULL")
    return serving.document_counters(_order_facts(spark, sf_dir).select("document_id").distinct(), facts=valid, issues=issues)


_META = f"SELECT DISTINCT document_id, 'Report ' || document_id AS title FROM ({ORDER_FACTS}) AS f WHERE CAST(substr(document_id, 5) AS INT) % 4 <> 0"


@query(f"SELECT f.fact_id, f.document_id, d.title FROM ({ORDER_FACTS}) f LEFT JOIN ({_META}) d USING (document_id)")
def populated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.populated(_order_facts(spark, sf_dir), document=both(spark, sf_dir, _META))
    return rows.select("fact_id", "document_id", F.col("document.title").alias("title"))


@query("""SELECT source AS document_id, md5(substr(string_agg(coalesce(text, ''), E'\\n\\n' ORDER BY doc_id), 1, 6000)) AS opening_md5
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY source""")
def opening_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening of each source, as if its documents were the pages of one."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), "text")
    return documents.opening_texts(pages).select("document_id", F.md5("opening").alias("opening_md5"))


@query(f"""SELECT 'fact_' || fact_id AS vector_id, subject, predicate, coalesce({_VALUE}, '') AS value, coalesce(period, '') AS period, coalesce(scope, '') AS scope, coalesce(normalized_subject, '') AS normalized_subject,
  coalesce(normalized_predicate, '') AS normalized_predicate, round(coalesce(normalized_value, 0), 4) AS normalized_value, coalesce(normalized_currency, '') AS normalized_currency,
  coalesce(period_label, '') AS period_label, coalesce(normalized_scope, '') AS normalized_scope FROM ({m.filled(NORMALIZED, ORDER_FACTS)})""")
def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.vector_records(facts.normalize_facts(_order_facts(spark, sf_dir)))
    return rows.drop("fact_id", "document_id", "page_id", "chunk_id").withColumn("normalized_value", F.round("normalized_value", 4))


_GIVEN = """SELECT conv_id, turn, '  ' || text || ' ' AS answer, CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(turn AS DOUBLE) / 2 - 1 END AS confidence,
  CASE turn % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'none' WHEN 2 THEN 'all' END AS coverage FROM conversations"""


@query(f"""SELECT conv_id, turn, md5(trim(coalesce(answer, ''))) AS answer_md5, greatest(0.0, least(1.0, coalesce(confidence, 0)))::DOUBLE AS confidence,
  CASE WHEN coverage IN ('full', 'partial', 'none') THEN coverage ELSE 'partial' END AS coverage FROM ({_GIVEN})""")
def sanitized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.sanitized_answers(both(spark, sf_dir, _GIVEN))
    return rows.select("conv_id", "turn", F.md5("answer").alias("answer_md5"), "confidence", "coverage")


@query(f"SELECT document_id, fact_id, row_number() OVER (PARTITION BY document_id ORDER BY created_at, fact_id)::INTEGER AS place FROM ({ORDER_FACTS})")
def fact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's facts, oldest first."""
    return serving.by_creation(_order_facts(spark, sf_dir), "document_id", "fact_id").select("document_id", "fact_id", "place")


@query(f"SELECT owner, count(*) AS n_facts, array_to_string(list_sort(list(DISTINCT document_id)), ',') AS documents FROM ({ORDER_FACTS}) GROUP BY owner")
def workspace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.workspace_totals(_order_facts(spark, sf_dir)).withColumn("documents", F.array_join("documents", ","))


@query(f"""SELECT qd AS document_id, ((encounter - 1) // 20)::INTEGER AS request, (encounter - 1) % 20 + 1 AS place, fact_a || ':' || fact_b AS pair_key,
  ((encounter - 1) % 20 + 1) || '. A: ' || told_a || chr(10) || '   B: ' || told_b AS line FROM ({_POOL})""")
def judge_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.judge_listing(_pool(spark, sf_dir), DEFAULTS.adjudication_batch)


_VERDICTS = f"""SELECT fact_a || ':' || fact_b AS pair_key, (encounter - 1) % 20 % 2 = 0 AS same, 'seen as ' || ((encounter - 1) % 20 + 1) AS reason FROM ({_POOL})
WHERE ((encounter - 1) // 20) % 3 < 2"""


def _odd_places(prompt: str) -> str:
    """A stand-in for a judge that calls pairs in odd places the same, fails on some requests and babbles on others."""
    number = int(prompt[prompt.rindex("#") + 1 :])
    if number % 3 == 2:
        if number % 2:
            raise RuntimeError("no reply")
        return "They look alike to me."
    places = [int(x) for x in re.findall(r"^([0-9]+)\. A: ", prompt, re.MULTILINE)]
    return "Sure: " + json.dumps({"verdicts": [{"pair": x, "same": x % 2 == 1, "reason": f"seen as {x}"} for x in places]})


@query(_VERDICTS)
def judged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge called once for each request: what it says of the pairs. One call in three comes to nothing, so its pairs get no verdict."""
    listing = stored(documents.judge_listing(_pool(spark, sf_dir), DEFAULTS.adjudication_batch), "listing")
    numbered = listing.withColumn("line", F.concat("line", F.lit(" #"), F.col("request").cast("string")))
    replies, _ = models.judged(numbered, _odd_places)
    return documents.verdicts_of(replies, listing)


@query(f"""SELECT DISTINCT qd AS document_id, ((encounter - 1) // 20)::INTEGER AS request, 'adjudication_failed' AS issue_type, {m.quoted(facts.ISSUE_HANDLING["adjudication_failed"])} AS handling
FROM ({_POOL}) WHERE ((encounter - 1) // 20) % 3 = 2""")
def judge_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = documents.judge_listing(_pool(spark, sf_dir), DEFAULTS.adjudication_batch)
    numbered = listing.withColumn("line", F.concat("line", F.lit(" #"), F.col("request").cast("string")))
    return models.judged(numbered, _odd_places)[1].select("document_id", "request", "issue_type", "handling")


@query(_VERDICTS)
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge's replies say of the listing; every third reply is no JSON, so its pairs get no verdict."""
    listing = stored(documents.judge_listing(_pool(spark, sf_dir), DEFAULTS.adjudication_batch), "listing")
    said = F.format_string('{"pair": %d, "same": %s, "reason": "seen as %d"}', "place", F.when(F.col("place") % 2 == 1, "true").otherwise("false"), "place")
    whole = F.concat(F.lit('```json\n{"verdicts": ['), F.array_join(F.collect_list(said), ", "), F.lit(', {"pair": 77, "same": true, "reason": "none"}]}\n```'))
    replies = listing.groupBy("document_id", "request").agg(F.when(F.col("request") % 3 < 2, whole).otherwise("They all differ.").alias("reply"))
    return documents.verdicts_of(replies, listing)


# Limits, leases, progress.


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t0 FROM events),
w AS (SELECT user_id, min(t0) AS opened FROM e GROUP BY user_id
  UNION ALL SELECT w.user_id, (SELECT min(t0) FROM e WHERE e.user_id = w.user_id AND e.t0 >= w.opened + 86400000000) FROM w
  WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.t0 >= w.opened + 86400000000)),
n AS (SELECT e.user_id, e.event_id, e.t0, w.opened, row_number() OVER (PARTITION BY e.user_id, w.opened ORDER BY e.t0, e.event_id) AS k
  FROM e JOIN w ON e.user_id = w.user_id AND e.t0 >= w.opened AND e.t0 < w.opened + 86400000000)
SELECT user_id, event_id, k <= 3 AS admitted, greatest(0, 3 - k)::INTEGER AS remaining, opened + 86400000000 - t0 AS reset_us FROM n""")
def rate_limit_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86_400, 3)


@query(ORACLES["rate_limit_fixed"])
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same limiter as a stateful stream over the event files."""
    return limits.limited_files(spark, f"{sf_dir}/events.parquet", "user_id", "ts", "event_id", 86_400, 3)


@query("""SELECT event_id, user_id, sum(event_id % 500) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)::BIGINT AS spent FROM events""")
def token_window_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("cost", F.col("event_id") % 500)
    return stateful.window_spend(rows, "user_id", "ts", "cost", 86_400).select("event_id", "user_id", "spent")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_id % 500 + 1 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT user_id, event_id, n, t, t AS admitted, [{'at': t, 'c': cost}] AS spent FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n, t, admitted, list_append([s FOR s IN spent IF s['at'] > admitted - 86400000000], {'at': admitted, 'c': cost}) FROM (
    SELECT *, list_min([c FOR c IN list_concat([now], [s['at'] + 86400000000 FOR s IN spent IF s['at'] + 86400000000 > now])
      IF len([s FOR s IN spent IF s['at'] > c - 86400000000]) = 0 OR list_sum([s['c'] FOR s IN spent IF s['at'] > c - 86400000000]) + cost <= 400]) AS admitted FROM (
      SELECT e.user_id, e.event_id, e.n, e.t, e.cost, f.spent, greatest(e.t, f.admitted) AS now FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)))
SELECT user_id, event_id, admitted AS admitted_us, admitted - t AS waited_us FROM f""")
def token_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When requests are let through that share a budget of 400 tokens a day, each user's in turn."""
    rows = table(spark, sf_dir, "events").withColumn("cost", F.col("event_id") % 500 + 1)
    return stateful.token_limited(rows, "user_id", "ts", "event_id", "cost", 400, 86_400, least_wait_us=0)


@query("SELECT user_id, max(ts) AS last_beat, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) > 120000000 AS stale FROM events GROUP BY user_id")
def stale_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.leases(table(spark, sf_dir, "events"), "user_id", "ts")


@query("""SELECT user_id, first_seen, last_type FROM (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_beat, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id)
WHERE last_type <> 'purchase' AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_beat) > 120000000""")
def resume_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interrupted users by their start: last seen without a purchase, and silent for longer than a lease."""
    events = table(spark, sf_dir, "events")
    state = events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    waiting = state.where("last_type <> 'purchase'").join(stateful.leases(events, "user_id", "ts").where("stale"), "user_id")
    return waiting.select("user_id", "first_seen", "last_type").orderBy("first_seen", "user_id")


_STATUS = """SELECT o_orderkey AS document_id, CASE o_orderkey % 8 WHEN 0 THEN 'processed' WHEN 1 THEN 'failed' WHEN 2 THEN 'uploaded' ELSE 'processing' END AS status,
  CASE o_orderkey % 7 WHEN 0 THEN 'waiting' WHEN 1 THEN 'parsing pages' WHEN 2 THEN 'embedding chunks ' || CAST(o_orderkey % 10 AS STRING) || '/10' WHEN 3 THEN 'extracting facts' WHEN 4 THEN 'matching 5/0'
    WHEN 5 THEN 'matching 12/10' ELSE 'tidying up' END AS stage, CAST(o_custkey % 40 AS INT) AS chunk_count, CAST(o_custkey % 50 AS INT) AS processed, o_orderdate AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at FROM orders"""


@query(f"""WITH s AS (SELECT *, least(processed, chunk_count) AS done FROM ({_STATUS})),
r AS (SELECT *, lower(stage) AS l, CASE WHEN nullif(regexp_extract(stage, '(\\d+)/(\\d+)', 2), '')::INT > 0 THEN least(1.0, regexp_extract(stage, '(\\d+)/(\\d+)', 1)::DOUBLE / regexp_extract(stage, '(\\d+)/(\\d+)', 2)::DOUBLE) ELSE 0.0 END AS f FROM s),
k AS (SELECT *, CASE WHEN status = 'processed' THEN 'done' WHEN status = 'failed' THEN 'failed' WHEN status <> 'processing' THEN 'queued' WHEN contains(l, 'waiting') THEN 'queued' WHEN contains(l, 'parsing') THEN 'parsing'
  WHEN contains(l, 'embedding chunks') THEN 'embedding' WHEN contains(l, 'extracting') THEN 'extracting' WHEN contains(l, 'matching') THEN 'matching' ELSE 'processing' END AS stage_key FROM r)
SELECT document_id, stage_key, CASE WHEN status = 'processed' THEN 100 WHEN status = 'failed' THEN CASE WHEN chunk_count > 0 THEN floor(done * 86.0::DOUBLE / chunk_count + 0.5) ELSE 0 END WHEN status <> 'processing' THEN 0
  ELSE CASE stage_key WHEN 'queued' THEN floor(0 + 2 * f + 0.5) WHEN 'parsing' THEN floor(2 + 4 * f + 0.5) WHEN 'embedding' THEN floor(6 + 6 * f + 0.5)
    WHEN 'extracting' THEN floor(14 + 72 * CASE WHEN chunk_count > 0 THEN done::DOUBLE / chunk_count ELSE f END + 0.5) WHEN 'matching' THEN floor(91 + 8 * f + 0.5) ELSE 2 END END::INTEGER AS percent,
  done AS processed_chunks, chunk_count - done AS remaining_chunks,
  floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(started_at)) / 1e6 + 0.5)::BIGINT AS elapsed_seconds FROM k""")
def progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stateful.progress(both(spark, sf_dir, _STATUS), "2002-01-01 00:00:00")
    return rows.select("document_id", "stage_key", "percent", "processed_chunks", "remaining_chunks", "elapsed_seconds")


@query(f"""SELECT doc_id, len(e)::INTEGER AS dimension, round(list_sum([e[k] * k FOR k IN range(1, 65)]), 6) AS digest FROM ({vectors_sql("documents", "doc_id", "text")})""")
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's vector by the offline model, as a weighed sum of its components."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", embed(F.col("text")).alias("v"))
    weighed = F.aggregate(F.transform("v", lambda x, k: x * (k + 1)), F.lit(0.0), lambda total, x: total + x)
    return rows.select("doc_id", F.size("v").alias("dimension"), F.round(weighed, 6).alias("digest"))


# Extraction by chunk status.


def _numbers(text: str) -> list[dict]:
    return [{"subject": "number", "value_text": x, "confidence": 1.0} for x in re.findall("[0-9]+", text)]


def _failing(every: int) -> Callable[[str], tuple[list[dict], list[dict]]]:
    """A stand-in for a model that fails on texts of some lengths."""

    def extract(text: str) -> tuple[list[dict], list[dict]]:
        if len(text) % every == 0:
            raise RuntimeError(f"no reply to {len(text)} characters\nsecond line")
        return _numbers(text), []

    return extract


def _rounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The chunks, a first run over them in which a third fails, the chunks after it, and a second run that sees the failed ones only."""
    chunks = stored(_chunked(spark, sf_dir, 1200), "chunks")
    first = stored(models.extraction_round(chunks, _failing(3)), "first")
    after = models.after_round(chunks, first)
    return chunks, first, after, stored(models.extraction_round(after, _failing(9)), "second")


_RUNS = f"""SELECT *, CASE WHEN status = 'skipped' THEN 'skipped' WHEN n_chars % 3 = 0 THEN 'failed' ELSE 'done' END AS first_status,
  CASE WHEN status = 'skipped' THEN 'skipped' WHEN n_chars % 9 = 0 THEN 'failed' ELSE 'done' END AS last_status FROM ({_CHUNKS})"""


@query(f"""SELECT chunk_id, first_status, last_status AS status, CASE WHEN last_status = 'done' THEN len(regexp_extract_all(text, '[0-9]+')) ELSE 0 END::INTEGER AS n_facts FROM ({_RUNS})""")
def chunk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of extraction: what is done or skipped is not read again, what failed is."""
    _, _, after, second = _rounds(spark, sf_dir)
    return models.after_round(after.withColumn("first_status", F.col("status")), second).select("chunk_id", "first_status", "status", "n_facts")


@query(f"""SELECT document_id::VARCHAR AS document_id, CASE WHEN tried > 0 AND failed = tried THEN 'failed' ELSE 'processed' END AS status,
  CASE WHEN tried > 0 AND failed = tried THEN 'Fact extraction failed for all ' || tried || ' pending chunks' WHEN failed > 0 THEN 'Fact extraction skipped ' || failed || ' of ' || total || ' chunks' END AS error,
  total AS chunk_count, total AS processed_chunk_count, 1 AS page_count
FROM (SELECT document_id, count(*) AS total, count(*) FILTER (first_status <> 'skipped') AS tried, count(*) FILTER (first_status = 'failed') AS failed FROM ({_RUNS}) GROUP BY document_id)""")
def document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after the first run: one fails only if all of its chunks did; and their counters."""
    chunks, first, after, _ = _rounds(spark, sf_dir)
    runs = models.document_runs(chunks, first)
    named = after.withColumn("document_id", F.col("document_id").cast("string"))
    return serving.chunk_counters(runs, named.select("document_id", "page_number").distinct(), named)


@query(f"SELECT document_id, chunk_id, (row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_index) - 1)::INTEGER AS place, lang, source FROM ({_CHUNKS}) JOIN documents ON doc_id = document_id")
def chunk_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks in reading order, with their documents."""
    named = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source")
    rows = documents.populated(serving.in_reading_order(_chunked(spark, sf_dir, 1200)), document=named)
    return rows.select("document_id", "chunk_id", "place", F.col("document.lang").alias("lang"), F.col("document.source").alias("source"))


# Sinks and incremental ingest.


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 3
UNION ALL SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 3""")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = orders.where("o_orderkey % 10 = 3").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    return replaced_by_key(orders, changed, ["o_orderkey"])


@query(f"""WITH g AS (SELECT DISTINCT document_id FROM ({ORDER_FACTS}) WHERE CAST(substr(document_id, 5) AS INT) % 4 = 0)
SELECT document_id, count(*) AS n FROM ({ORDER_FACTS}) WHERE document_id NOT IN (FROM g) GROUP BY document_id""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_facts(spark, sf_dir)
    gone = rows.select("document_id").where("CAST(substr(document_id, 5) AS INT) % 4 = 0").distinct()
    return without_documents(rows, gone).groupBy("document_id").agg(F.count("*").alias("n"))


@query(f"""WITH r AS ({_RELATIONS}), d AS (SELECT fact_id FROM ({VECTOR_FACTS}) WHERE document_id IN ('d1', 'd2'))
SELECT fact_a, fact_b, confidence FROM r WHERE fact_a NOT IN (FROM d) AND fact_b NOT IN (FROM d)""")
def relationships_without_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = candidate_pairs(spark, sf_dir).select("fact_a", "fact_b", "confidence")
    return without_facts(relations, vector_facts(spark, sf_dir).where("document_id IN ('d1', 'd2')"))


@query(chunk_sql(8000))
def pipeline_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages arrive as files; a stream cuts those it has not seen into chunks, twice, and the table holds each page's chunks once."""
    return _digest(ingest.ingested_chunks(spark, f"{sf_dir}/documents.parquet", 8000))

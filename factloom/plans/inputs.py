"""Facts derived from the star schema, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.tables import spread, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Tables whose rows get much work each.
LONG = ("orders", "lineitem", "conversations")


def both(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a portable SELECT over the folder's tables."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    named = {t: spread(table(spark, sf_dir, t)) if t in LONG else table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
    return spark.sql(re.sub(rf"\b({'|'.join(TABLES)})\b(?=\s|,|\)|$)", lambda m: "{" + m[1] + "}", sql), **named) if named else spark.sql(sql)


_DAY = "substr(CAST(o_orderdate AS STRING), 1, 10)"
_YEAR, _MONTH, _DAY_OF = f"substr({_DAY}, 1, 4)", f"substr({_DAY}, 6, 2)", f"substr({_DAY}, 9, 2)"
_AMOUNT = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"

#: One fact for each order: wordings, units, currencies, periods and scopes vary with the key; some are defective.
ORDER_FACTS = f"""
SELECT 'fact-' || lpad(CAST(o_orderkey AS STRING), 10, '0') AS fact_id,
  'doc-' || CAST(o_custkey % 50 AS STRING) AS document_id,
  'page-' || CAST(o_custkey % 50 AS STRING) || '-' || CAST(o_orderkey % 30 + 1 AS STRING) AS page_id,
  'chunk-' || CAST(o_orderkey % 977 AS STRING) AS chunk_id,
  CAST(o_orderkey % 30 + 1 AS INT) AS page_number,
  'team ' || CAST(o_custkey % 3 AS STRING) AS owner,
  CASE o_orderkey % 7 WHEN 0 THEN 'The Company' WHEN 1 THEN c_name || ' Inc.' WHEN 2 THEN c_name || ' Limited' WHEN 3 THEN upper(c_name)
    WHEN 4 THEN c_name || ' Corporation, plc' WHEN 5 THEN 'the Group' ELSE c_name END AS subject,
  CASE o_orderkey % 11 WHEN 0 THEN 'Total Revenue' WHEN 1 THEN 'Net Sales' WHEN 2 THEN 'Revenue from operations' WHEN 3 THEN 'Growth Rate'
    WHEN 4 THEN 'Gross Profit' WHEN 5 THEN 'Operating Margin' WHEN 6 THEN 'Net Earnings' WHEN 7 THEN 'Employee Count' WHEN 8 THEN 'Market Share'
    WHEN 9 THEN 'Chief Executive Officer' ELSE 'Operating Income' END AS predicate,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS object,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS value_num,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CASE o_orderkey % 14
    WHEN 0 THEN '$' || {_AMOUNT} || 'M' WHEN 1 THEN {_AMOUNT} || ' crore' WHEN 2 THEN 'USD ' || {_AMOUNT} WHEN 3 THEN CAST(o_orderkey % 100 AS STRING) || '%'
    WHEN 4 THEN 'twenty-five percent' WHEN 5 THEN 'U63090DL' || CAST(o_orderkey AS STRING) WHEN 6 THEN '(' || CAST(o_orderkey % 900 AS STRING) || ')'
    WHEN 7 THEN '5 lakh' WHEN 8 THEN 'approximately ' || {_AMOUNT} WHEN 9 THEN CAST(o_orderkey AS STRING) || ' thousand euros' WHEN 10 THEN 'Rs.' || CAST(o_orderkey % 1000 AS STRING)
    WHEN 11 THEN '-' || {_AMOUNT} WHEN 12 THEN '₹ 1,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '.50' ELSE 'forty two' END END AS value_text,
  CASE o_orderkey % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'currency' WHEN 2 THEN 'percentage' WHEN 3 THEN 'text' WHEN 4 THEN 'date' END AS value_type,
  CASE o_orderkey % 9 WHEN 0 THEN 'crore' WHEN 1 THEN 'Million' WHEN 2 THEN 'percent' WHEN 3 THEN 'employees' WHEN 4 THEN 'bn' WHEN 5 THEN ' Units ' END AS unit,
  CASE o_orderkey % 8 WHEN 0 THEN 'USD' WHEN 1 THEN 'Rs' WHEN 2 THEN '₹' WHEN 3 THEN '$' WHEN 4 THEN 'euros' WHEN 5 THEN 'Canadian dollars' END AS currency,
  CASE o_orderkey % 13 WHEN 0 THEN 'FY' || {_YEAR} WHEN 1 THEN 'Q' || CAST(o_orderkey % 4 + 1 AS STRING) || ' FY' || {_YEAR} WHEN 2 THEN {_YEAR} || ' Q' || CAST(o_orderkey % 4 + 1 AS STRING)
    WHEN 3 THEN 'fiscal year ' || {_YEAR} WHEN 4 THEN 'year ended March 31, ' || {_YEAR} WHEN 5 THEN {_YEAR} WHEN 6 THEN {_DAY_OF} || '/' || {_MONTH} || '/' || {_YEAR}
    WHEN 7 THEN 'as at ' || {_DAY_OF} || '/' || {_MONTH} || '/' || {_YEAR} WHEN 8 THEN 'FY24' WHEN 9 THEN {_YEAR} || '-24' WHEN 10 THEN 'the Year Ended the last day, February 31 ' || {_YEAR} WHEN 11 THEN ' ' END AS period,
  CASE o_orderkey % 6 WHEN 0 THEN 'Worldwide' WHEN 1 THEN 'North America' WHEN 2 THEN 'Consolidated' WHEN 3 THEN 'U.S.' WHEN 4 THEN 'EMEA region' END AS scope,
  'The audited report of ' || c_name || ' for ' || {_YEAR} || ' states ' || {_AMOUNT} || ' — net-\nsales “as reported”.' AS source_text,
  CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confidence,
  o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey
"""

#: Candidates as a model might give them: every seventh kind of defect in turn, with the text of the chunk they come from.
CANDIDATES = f"""
SELECT fact_id, document_id, page_id, chunk_id, page_number,
  CASE WHEN k = 0 THEN '  ' ELSE subject END AS subject, CASE WHEN k = 1 THEN NULL ELSE predicate END AS predicate,
  CASE WHEN k = 5 THEN NULL ELSE object END AS object, CASE WHEN k = 5 THEN NULL ELSE value_num END AS value_num,
  CASE WHEN k = 5 THEN ' ' ELSE value_text END AS value_text,
  CASE WHEN k = 2 THEN '' WHEN k = 3 THEN 'Another report states 12345678901 in full' ELSE source_text END AS source_text,
  CASE WHEN k = 4 THEN 1.1 ELSE confidence END AS confidence, created_at,
  upper('Page. ' || replace(source_text, 'net-\n', 'net') || ' End of page.') AS chunk_text
FROM (SELECT *, CAST(substr(fact_id, 6) AS BIGINT) % 8 AS k FROM ({ORDER_FACTS}))
"""

_MONEY = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2)))"

#: The yearly revenue of nations, by the order book and by the shipped lines.
REVENUE_FACTS = f"""
SELECT source || '-' || CAST(n_nationkey AS STRING) || '-' || y AS fact_id, source || '-book' AS document_id, source || '-page-' || y AS page_id,
  source || '-chunk-' || y AS chunk_id, CAST(y AS INT) AS page_number, 'demo' AS owner, n_name AS subject,
  CASE source WHEN 'orders' THEN 'Total Revenue' ELSE 'Net Sales' END AS predicate, CAST(NULL AS STRING) AS object, total AS value_num,
  CAST(NULL AS STRING) AS value_text, 'currency' AS value_type, CAST(NULL AS STRING) AS unit, 'USD' AS currency,
  CASE source WHEN 'orders' THEN 'FY' || y ELSE CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 'fiscal year ' || y END END AS period, 'Consolidated' AS scope,
  n_name || ' booked its revenue in ' || y AS source_text, CAST(CASE source WHEN 'orders' THEN 0.9 ELSE 0.8 END AS DOUBLE) AS confidence
FROM (
  SELECT 'orders' AS source, n_nationkey, n_name, {_YEAR} AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name, {_YEAR}
  UNION ALL
  SELECT 'lines' AS source, n_nationkey, n_name, {_YEAR} AS y, CAST(sum({_MONEY}) AS DOUBLE) AS total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_nationkey, n_name, {_YEAR})
"""

"""One thin query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.ann import nearest_neighbours
from factloom.llm.collocations import collocations
from factloom.llm.common import table
from factloom.llm.langid import identify_languages
from factloom.llm.lexical import ranked_documents
from factloom.llm.mixing import curriculum
from factloom.llm.neardup import near_duplicates
from factloom.llm.packing import pack_documents
from factloom.llm.pii import KINDS, find_personal_data
from factloom.llm.quality import classify_quality
from factloom.llm.substrings import without_repeats
from factloom.llm.tokencount import counts_after_edits
from factloom.llm.topk import top_k_products
from factloom.llm.urlfilter import judge_captures, keys_of

COUNTING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")
PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_products(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5, scale=256)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.w, c.w) DESC, c.vec_id)::INTEGER AS rank
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
WHERE rank <= 5
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), PACKING_TOKENIZER, limit=4096, last_id=1)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, similarity=80)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str, base: bool = True) -> Column:
        return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & (s["base"] | F.lit(not base)))).cast("long")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = joined(F.filter("spans", lambda s: s["base"]))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *[count(kind, base=False).alias(f"n_{kind}_all") for kind in KINDS],
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), F.expr("crc32(cast(doc_id AS string)) % 4 = 2"))


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In training order: by the position of the first pass, documents that are not read last."""
    mixed = curriculum(table(spark, sf_dir, "documents"))
    first, second = (F.get("positions", F.lit(p)).alias(c) for p, c in ((0, "position"), (1, "position_again")))
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", "passes", first, second)
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS number
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2.0::DOUBLE * source_size AS cap
  FROM by_source),
levels AS (
  SELECT *, cap / weight AS ratio, row_number() OVER o AS place,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, number)),
targets AS (
  SELECT source, source_size, (CASE number % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE -0.5 END)::DOUBLE AS slope,
         least(cap, coalesce((SELECT arg_min(level, place) FROM levels WHERE level <= ratio) * weight, cap)) AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS middle
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
demanded AS (
  SELECT *, 1 - slope AS flat, CASE WHEN middle < target THEN middle / target END AS x,
         CASE WHEN middle + source_size < target THEN (middle + source_size) / target END AS y
  FROM placed)
SELECT doc_id, size, source_size, target, size * ((x IS NOT NULL)::INT + (y IS NOT NULL)::INT) AS taken,
       (x IS NOT NULL)::INT + (y IS NOT NULL)::INT AS passes,
       2 * x / (flat + sqrt(flat * flat + 4 * slope * x)) AS position,
       2 * y / (flat + sqrt(flat * flat + 4 * slope * y)) AS position_again
FROM demanded
"""


def _dated(seed: Column, days: int) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (seed % days).cast("int"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def op7_url_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of ``pages``, dated by page_id, against lists whose entries and dates follow from the keys of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", _dated(F.col("page_id") * 37, 366))
    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("key")).distinct().withColumn("n", _number(F.col("key")))
    listed = keys.where("n % 3 < 2").withColumn("list", F.expr("CASE WHEN n % 3 = 0 THEN 'deny' ELSE 'allow' END"))
    added = _dated(F.expr("n div 3"), 300)
    removed = F.date_add(added, (F.lit(20) + F.col("n") % 90).cast("int"))
    entries = (
        listed.select("key", "list", F.lit("add").alias("action"), added.alias("dated"))
        .unionByName(listed.where("n % 2 = 0").select("key", "list", F.lit("remove").alias("action"), removed.alias("dated")))
        .unionByName(listed.where("n % 4 = 0").select("key", "list", F.lit("add").alias("action"), F.date_add(removed, 45).alias("dated")))
    )
    return judge_captures(captures, entries)


OP7_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 366)::INT AS fetched_on,
         nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment
  FROM pages),
labelled AS (SELECT *, string_split(host, '.') AS labels FROM captures WHERE host IS NOT NULL),
keyed AS (
  SELECT DISTINCT page_id, fetched_on, key FROM (
    SELECT page_id, fetched_on, host || '/' || segment AS key FROM labelled WHERE segment IS NOT NULL
    UNION ALL SELECT page_id, fetched_on, host FROM labelled
    UNION ALL SELECT page_id, fetched_on, array_to_string(labels[i:], '.')
              FROM labelled, unnest(range(2, len(labels))) AS r(i) WHERE NOT regexp_matches(host, '^[0-9.]+$|^\['))),
numbered AS (
  SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS n FROM (SELECT DISTINCT key FROM keyed)),
listed AS (
  SELECT key, n, CASE WHEN n % 3 = 0 THEN 'deny' ELSE 'allow' END AS list,
         DATE '2024-01-01' + ((n // 3) % 300)::INT AS added,
         DATE '2024-01-01' + ((n // 3) % 300)::INT + (20 + n % 90)::INT AS removed
  FROM numbered WHERE n % 3 < 2),
entries AS (
  SELECT key, list, 'add' AS action, added AS dated FROM listed
  UNION SELECT key, list, 'remove', removed FROM listed WHERE n % 2 = 0
  UNION SELECT key, list, 'add', removed + 45 FROM listed WHERE n % 4 = 0),
spans AS (
  SELECT *, coalesce(lead(dated) OVER (PARTITION BY key, list ORDER BY dated, action), DATE '9999-12-31') AS active_to
  FROM entries),
best AS (
  SELECT k.page_id, s.key, s.list, s.dated AS active_from, s.active_to,
         row_number() OVER (PARTITION BY k.page_id ORDER BY length(s.key) DESC, s.dated DESC, s.list = 'deny' DESC) AS rn
  FROM keyed k JOIN spans s ON k.key = s.key AND s.action = 'add'
   AND s.dated <= k.fetched_on AND k.fetched_on < s.active_to)
SELECT c.page_id, c.url, c.fetched_on, c.host, coalesce(b.list, 'none') AS decision, b.key AS matched_key,
       b.active_from, b.active_to
FROM captures c LEFT JOIN best b ON c.page_id = b.page_id AND b.rn = 1
"""

def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classify_quality(table(spark, sf_dir, "documents"), labels, F.expr("crc32(cast(doc_id AS string)) % 3 = 1"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each, which follow from the document itself."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.length("text"), F.lit(0))
    edits = docs.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("edit_no"), F.floor(size / 4).alias("at"), F.lit(7).alias("removed"), F.lit(" revised").alias("inserted")),
                F.struct(F.lit(2).alias("edit_no"), F.floor(size / 2).alias("at"), F.lit(0).alias("removed"), F.concat_ws(" ", F.lit("\n"), "source", "lang", F.lit("\n")).alias("inserted")),
                F.struct(F.lit(3).alias("edit_no"), F.floor(size * 3 / 4).alias("at"), F.lit(40).alias("removed"), F.lit("").alias("inserted")),
            )
        ).alias("e"),
    ).select("doc_id", "e.*")
    return counts_after_edits(docs, edits, COUNTING_TOKENIZER, public_tokenizers.PATTERN)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_max([abs(x) FOR x IN embedding]) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.w, c.w) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.w, c.w) DESC, c.vec_id)::INTEGER AS rank
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
WHERE rank <= 5
"""


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents"), window=35)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
starts AS (SELECT r, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS k FROM d, unnest(range(1, len(ws) - 33)) AS u(i)),
again AS (SELECT r, i FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1),
words AS (SELECT r, p, ws[p] AS w FROM d, unnest(range(1, len(ws) + 1)) AS u(p)),
judged AS (
  SELECT w.r, w.p, w.w, coalesce(w.p - max(a.i) OVER (PARTITION BY w.r ORDER BY w.p) < 35, false) AS gone
  FROM words w LEFT JOIN again a ON a.r = w.r AND a.i = w.p),
kept AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, covered=50, shown=2000)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM worded, (VALUES (1), (2), (3)) AS o(m), unnest(range(1, len(ws) - m + 2)) AS u(i)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
frequent AS (SELECT *, string_split(phrase, ' ') AS ws FROM counts WHERE f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, k, (1000000::HUGEINT * c.f::HUGEINT * c.f::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT) AS score
  FROM frequent c, unnest(range(1, m)) AS u(k)
  JOIN frequent h ON h.lang = c.lang AND h.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN frequent t ON t.lang = c.lang AND t.phrase = array_to_string(c.ws[k + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(ws[1:m - 1], ' ') AS part FROM frequent WHERE m = 3
    UNION ALL SELECT lang, f, array_to_string(ws[2:], ' ') FROM frequent WHERE m = 3) GROUP BY lang, part),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.phrase WHERE coalesce(100 * longer < 50 * a, true))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=50)


OP13_SQL = rf"""
WITH terms AS (
  SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT d, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT d, sum(tf)::BIGINT AS n FROM tfs GROUP BY d),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, corpus GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (d), corpus GROUP BY item_id, d, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_personal_data": op4_personal_data,
    "op5_language_id": op5_language_id,
    "op6_source_mixture": op6_source_mixture,
    "op7_url_list_filter": op7_url_list_filter,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES: dict[str, str] = {
    "op1_exact_top_k": OP1_SQL,
    "op6_source_mixture": OP6_SQL,
    "op7_url_list_filter": OP7_SQL,
    "op10_nearest_neighbours": OP10_SQL,
    "op11_substring_dedup": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}

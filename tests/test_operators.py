"""Validation, pairs, reconciliation, explanations, serving and ingest on small tables."""

import random

from pyspark.sql import functions as F

from factloom.functions.text import is_grounded, normalize_evidence
from factloom.operators import facts, grounding, pairs, reconcile, serving, vectors
from factloom.sources.tables import pages_from_files, plain_pdf_pages, replaced_by_key, without_facts
from factloom.streaming import ingest

FACT = (
    "fact_id string, document_id string, page_id string, chunk_id string, page_number int, subject string, predicate string, object string, value_num double, value_text string,"
    "value_type string, unit string, currency string, period string, scope string, source_text string, confidence double"
)
GIVEN = dict(
    fact_id="a", document_id="d1", page_id="p", chunk_id="c", page_number=1, subject="Acme Ltd", predicate="Net sales", object=None, value_num=4200.0, value_text=None,
    value_type="number", unit=None, currency="USD", period="FY2024", scope="global", source_text="Net sales were 4200", confidence=0.9,
)


def fact_rows(spark, *changes):
    rows = [GIVEN | {"fact_id": chr(97 + i), "document_id": f"d{i}"} | c for i, c in enumerate(changes)]
    return facts.normalize_facts(spark.createDataFrame([tuple(r.values()) for r in rows], FACT))


def classified(spark, left, right, **more):
    rows = fact_rows(spark, left, right)
    pair = spark.createDataFrame([("a", "b", *more.values())], "fact_a string, fact_b string" + "".join(f", {k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in more.items()))
    return reconcile.explained(reconcile.reconciled(reconcile.paired(pair, rows))).collect()[0]


def test_classes(spark):
    assert classified(spark, {}, {"predicate": "total revenue", "value_num": 4210.0}).relationship_type == "corroborated"
    row = classified(spark, {}, {"value_num": 5100.0})
    assert row.relationship_type == "contradiction" and "Values differ by 900, a 17.6% relative difference." in row.key_differences
    row = classified(spark, {}, {"period": "Q4 2024", "scope": "us"})
    assert row.relationship_type == "contextual_difference" and row.context == "period differs, scope differs"
    assert classified(spark, {}, {"period": None, "value_num": 1.0}).reason == reconcile.REASONS["change"]
    assert classified(spark, {"value_num": None}, {"value_num": None}).relationship_type == "uncertain"
    assert classified(spark, {}, {"unit": "employees", "value_num": 5100.0}).relationship_type == "contradiction"
    assert classified(spark, {}, {"subject": "Other"}).reason == reconcile.REASONS["subject"]
    judged = classified(spark, {}, {"subject": "Other"}, adjudicated_same=True, adjudicated_reason="alias")
    assert judged.relationship_type == "corroborated" and judged.key_similarities[0].endswith("were judged equivalent: alias")
    words = {"value_num": None, "currency": None}
    assert classified(spark, words | {"object": "Anna"}, words | {"object": "Berta"}).relationship_type == "contradiction"
    assert classified(spark, {"source_text": None}, {}).summary == "corroborated: " + reconcile.NO_EVIDENCE


def test_normalising_twice_changes_nothing(spark):
    once = fact_rows(spark, {"value_text": "$120M", "value_num": None}, {"period": "Q1 FY2024", "scope": "North America"})
    assert facts.normalize_facts(once).select(*once.columns).collect() == once.collect()


def test_validation(spark):
    rows = spark.createDataFrame(
        [("1", "d", " ", "p", "s ok", 0.5, 1.0), ("2", "d", "s", None, "s ok", 0.5, 1.0), ("3", "d", "s", "p", "", 0.5, 1.0), ("4", "d", "s", "p", "not there at all", 0.5, 1.0),
         ("5", "d", "s", "p", "s ok", 1.5, 1.0), ("6", "d", "s", "p", "s ok", 0.5, None), ("7", "d", " s ", "p", "s ok", 0.5, 0.0)],
        "fact_id string, document_id string, subject string, predicate string, source_text string, confidence double, value_num double",
    ).withColumns({"value_text": F.lit(None).cast("string"), "object": F.lit(""), "chunk_text": F.lit("It is S, ok?")})
    valid, issues = facts.split_candidates(rows)
    assert [(r.fact_id, r.subject) for r in valid.collect()] == [("7", "s")]
    kinds = ["missing_field"] * 3 + ["ungrounded_evidence", "invalid_confidence", "no_value"]
    assert [r.issue_type for r in issues.orderBy("fact_id").collect()] == kinds
    assert all(r.handling == facts.ISSUE_HANDLING[r.issue_type] for r in issues.collect())


def test_candidate_pairs(spark):
    rows = fact_rows(spark, {}, {"period": "FY2023"}, {"predicate": "headcount"}, {"document_id": "d0"}, {"value_type": "percentage"})
    matches = spark.createDataFrame(
        [("a", "b", 0.92, 1), ("b", "a", 0.92, 1), ("a", "c", 0.99, 2), ("a", "d", 0.95, 3), ("a", "a", 1.0, 4), ("b", "d", 0.5, 5), ("a", "e", 0.9, 6)],
        "fact_id string, candidate_id string, similarity double, rank int",
    )
    found = pairs.candidate_pairs(matches, rows).collect()
    assert [(r.fact_a, r.fact_b) for r in found] == [("a", "b")] and "period differs; preserved" in found[0].reason and found[0].confidence == 0.9
    pool = pairs.adjudication_pool(matches, rows)
    assert [(r.fact_a, r.fact_b, r.reason, r.encounter) for r in pool.collect()] == [("a", "c", "predicate differs", 1)]
    verdicts = spark.createDataFrame([("a:c", True, "same")], "pair_key string, same boolean, reason string")
    assert [round(r.matching_score, 3) for r in pairs.adjudicated_pairs(pool, verdicts).collect()] == [0.891]


def test_similar_counts_own_document_first(spark):
    rows = spark.createDataFrame([("a", "o", "d1", [1.0, 0.0]), ("b", "o", "d1", [1.0, 0.1]), ("c", "o", "d2", [1.0, 0.2]), ("e", "x", "d3", [1.0, 0.0]), ("z", "o", "d4", [0.0, 0.0])],
                                 "fact_id string, owner string, document_id string, embedding array<double>")
    found = vectors.document_matches(vectors.usable(rows), k=2).select("fact_id", "candidate_id").collect()
    assert sorted(map(tuple, found)) == [("b", "c"), ("c", "b")]


def test_serving(spark):
    relations = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "fact_a string, fact_b string")
    ids = spark.createDataFrame([("b",)], "fact_id string")
    assert serving.relationships_touching(relations, ids).count() == 2
    assert sorted(r[0] for r in serving.neighbours(relations, ids).collect()) == ["a", "c"]
    assert [tuple(r) for r in without_facts(relations, ids).collect()] == [("d", "e")]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sorted(map(tuple, replaced_by_key(old, spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_incremental_ingest(spark, tmp_path):
    source, target = str(tmp_path / "in.parquet"), str(tmp_path / "out")
    spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string").write.parquet(source)
    for _ in range(2):
        ingest.ingest_pages(spark, source, target, str(tmp_path / "check"), 7)
    spark.createDataFrame([(3, "four")], "doc_id long, text string").write.mode("append").parquet(source)
    ingest.ingest_pages(spark, source, target, str(tmp_path / "check"), 7)
    assert sorted(r.text for r in spark.read.parquet(target).collect()) == ["four", "one two", "three"]


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\nstream\n(First page) Tj\nendstream\nstream\n[(Sec) (ond)] TJ\nendstream")
    (tmp_path / "b.txt").write_text("no")
    rows = pages_from_files(spark, str(tmp_path), plain_pdf_pages, "*").orderBy("page_number").collect()
    assert [(r.page_number, r.text) for r in rows] == [(1, "First page"), (2, "Second")]


def test_short_evidence_by_force(spark):
    draw = random.Random(3)
    words = ["net", "sales", "up", "the", "cat", "sat", "on", "a", "Q4", "é"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 40))) for _ in range(60)] + ["net  sales up", "thecatsaton", "x thecatsatonthe y", "", None]
    passages = ["net sales up", "the cat sat on", "net sales", "a a a a a a a", "catsat"]
    while len(passages) < 150:
        text = draw.choice(texts[:60]) + " "
        a, n = draw.randrange(len(text)), draw.randrange(8, 16)
        passages.append(text[a : a + n])
    evidence = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, grounding.occurrences(evidence, documents).collect()))
    pairs_of = evidence.withColumnRenamed("text", "e").crossJoin(documents.withColumnRenamed("text", "c"))
    want = pairs_of.where(normalize_evidence(F.col("e")) != "").where(is_grounded(F.col("e"), F.col("c"))).select("item_id", "doc_id").collect()
    assert found == sorted(map(tuple, want)) and len(found) > 300


def test_passages_with_one_opening_meet_few_documents(spark):
    """200 passages that begin alike, and documents that all have that beginning: the rarest windows tell them apart."""
    draw = random.Random(8)
    opening = "According to the audited annual report of the company "
    tails = [" ".join(draw.choice("abcdefghij") * 2 + str(draw.randrange(10**6)) for _ in range(6)) for _ in range(200)]
    evidence = spark.createDataFrame([(i, opening + t) for i, t in enumerate(tails)], "item_id long, text string")
    documents = spark.createDataFrame([(d, f"{opening} nothing. {opening}{tails[d]} and {opening}{tails[(7 * d) % 200]}") for d in range(150)], "doc_id long, text string")
    want = {(d, d) for d in range(150)} | {((7 * d) % 200, d) for d in range(150)}
    assert {(r.item_id, r.doc_id) for r in grounding.occurrences(evidence, documents).collect()} == want
    assert grounding.likely_places(evidence, documents).count() <= 2 * len(want)


def test_vectors_of_another_dimension_fail(spark):
    import pytest

    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "fact_id string, embedding array<double>")
    assert vectors.checked_dimension(rows, 2).count() == 2 and len(vectors.checked_dimension(rows, 2).collect()) == 2
    with pytest.raises(Exception, match="the index has dimension 3, a vector 2"):
        vectors.checked_dimension(rows, 3).collect()


def test_pairs_of_rules_and_judge_are_united(spark):
    rules = spark.createDataFrame([("a:b", 1.0)], "pair_key string, score double")
    judged = spark.createDataFrame([("a:b", 0.9, True), ("a:c", 0.9, True)], "pair_key string, score double, adjudicated_same boolean")
    assert sorted((r.pair_key, r.score, r.adjudicated_same) for r in pairs.united(rules, judged).collect()) == [("a:b", 1.0, None), ("a:c", 0.9, True)]


def test_given_bounds_of_a_period_stay(spark):
    rows = fact_rows(spark, {"period": "FY2024"}, {"period": "some time"}).drop("period_start", "period_end", "normalized_period_start", "normalized_period_end")
    given = rows.withColumns({"period_start": F.lit("2020-02-03").cast("date"), "period_end": F.lit(None).cast("date")})
    got = {r.fact_id: (str(r.period_start), str(r.period_end), str(r.normalized_period_start)) for r in facts.normalize_facts(given).collect()}
    assert got == {"a": ("2024-01-01", "2024-12-31", "2024-01-01"), "b": ("2020-02-03", "None", "None")}
    twice = facts.normalize_facts(facts.normalize_facts(given))
    assert twice.select(*facts.normalize_facts(given).columns).collect() == facts.normalize_facts(given).collect()


def test_chunks_are_cut_as_the_rule_says(spark):
    from factloom.operators.chunking import chunks, cut_words

    draw = random.Random(4)
    texts = [" ".join("x" * draw.randrange(1, 30) for _ in range(draw.randrange(40))) + draw.choice(["", "é😀", " "]) for _ in range(200)]
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "document_id long, page_number int, text string")
    got = {}
    for r in chunks(rows, most=25).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append(r.text)
    assert got == {i: cut_words(t.strip(), 25) for i, t in enumerate(texts) if t.strip()}


def test_requests_of_too_many_files_are_refused_whole(spark):
    from factloom.sources.tables import admitted_requests

    rows = [("r1", f"a{i}.pdf", 5, "application/pdf") for i in range(20)] + [("r1x", "a.PDF", 5, "application/pdf"), ("r1x", "b.pdf", 5, "text/plain"), ("r1x", "c.pdf", 0, "application/pdf")] + [("r2", f"b{i}.pdf", 5, "application/pdf") for i in range(21)]
    found = admitted_requests(spark.createDataFrame(rows, "request_id string, path string, length long, mimetype string"))
    assert {r.request_id: r["n"] for r in found.groupBy("request_id").agg(F.count("*").alias("n")).collect()} == {"r1": 20, "r1x": 1}

"""The pipeline's stages in turn on a small folder, each held against what its operator must do."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from factloom.llm import pii
from factloom.llm.common import materialize
from factloom.llm.langid import fit_languages, keep_labelled
from tests.llm.test_llm_operators import components_by_force


def test_stages(spark, tmp_path):
    draw = random.Random(9)
    vocabulary = {"xx": ["thun", "thor", "thalen", "othe", "ander"], "yy": ["éau", "queré", "leaux", "ment", "oir"]}
    rows = []
    for i in range(160):
        lang = draw.choice(list(vocabulary))
        words = [draw.choice(vocabulary[lang]) + str(draw.randrange(30)) for _ in range(draw.randrange(20, 60))]
        rows.append((i, " ".join(words), lang, f"s{i % 3}", 1))
    rows += [(200 + i, rows[i][1], rows[i][2], "s1", 1) for i in range(10)]
    rows += [(300, "123 456 !!", "xx", "s0", 1), (301, None, "xx", None, 1), (302, rows[3][1] + " write a@b.com", "xx", "s0", 1)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = columns = None
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.read.parquet(path) if docs is None else docs
        columns = columns or docs.columns
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    language, unique, clean, mixed, packed = kept
    assert {r.doc_id for r in language} == {r[0] for r in rows} - {300, 301}
    texts = [r.text for r in sorted(language, key=lambda r: r.doc_id)]
    ids = sorted(r.doc_id for r in language)
    assert {r.doc_id for r in unique} == {ids[i] for i, (_, _, stays) in components_by_force(texts, 5, 80).items() if stays}
    assert all(not pii.personal_spans(r.text) for r in clean) and {r.doc_id for r in clean} == {r.doc_id for r in unique}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean} and len(mixed) > len(clean)
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(r.doc_id for r in mixed)
    assert all(len(r.ids) == r.length for r in packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_language_that_was_not_learned_goes_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND size(split(text, ' ')) >= 40")
    known = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    model = fit_languages(known, F.expr("crc32(cast(doc_id AS string)) % 4 <> 2"))
    kept = keep_labelled(docs.where("crc32(cast(doc_id AS string)) % 4 = 2"), model, corpus_pipeline.LEAST_EVIDENCE)
    have = {r.lang: r["n"] for r in docs.where("crc32(cast(doc_id AS string)) % 4 = 2").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    stay = {r.lang: r["n"] for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert stay.get("de", 0) <= 0.1 * have["de"]
    assert all(stay[x] == have[x] for x in ("en", "es", "fr"))

"""Repeated ids, equal rows and large edits: nothing is lost, nothing multiplied, samples stay bounded."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from factloom.llm import common, langid, packing, quality, tokencount
from factloom.llm.common import materialize
from factloom.llm.mixing import curriculum, mixed_documents
from factloom.llm.packing import pack_documents, windows_of_files
from tests.llm.test_llm_operators import RANKS, TOKENIZER, make_docs


def by_row(table, **mixture):
    """The curriculum as mixed_documents has it: rows are told apart, and ordered, by all columns."""
    keyed = table.select(F.xxhash64(F.struct(*table.columns)).alias("key"), "doc_id", "source", "text")
    names = {r.key: r.doc_id for r in keyed.collect()}
    return [(names[r.doc_id], r) for r in curriculum(keyed.select(F.col("key").alias("doc_id"), "source", "text"), **mixture).collect()]


def test_equal_rows_are_each_read_as_often_as_the_mixture_says(spark):
    docs = make_docs(spark, [" ".join(["w"] * (3 + i % 5)) for i in range(30)], source={i: "s0" if i < 25 else "s1" for i in range(30)})
    equal = spark.range(40).select(F.lit(7).cast("long").alias("doc_id"), F.lit("five words of one row").alias("text"), F.lit("en").alias("lang"), F.lit("s0").alias("source"), F.lit(21).cast("long").alias("n_chars"), F.lit("x").alias("vec_id"))
    table = materialize(docs.where("doc_id <> 7").unionByName(equal).repartition(5), "equal")
    assert curriculum(table).count() == 69
    mixed = by_row(table)
    want = sum(r.passes for d, r in mixed if d == 7)
    assert 40 < want < 80
    out = mixed_documents(table).collect()
    assert sum(r.doc_id == 7 for r in out) == want and len(out) == sum(r.passes for _, r in mixed)
    places = [(r.source, p) for _, r in mixed for p in r.positions]
    assert len(set(places)) == len(places)


def test_crowded_and_missing_ids_take_places_of_their_own(spark, monkeypatch):
    """The words before every row, by force, where a third of the rows has no id and many are equal."""
    rows = [(None if i % 3 == 0 else i, " ".join(["w"] * (1 + i % 4)), "s") for i in range(300)]
    table = materialize(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6), "crowd")
    got = sorted((x for r in curriculum(table, slopes=(0.0,)).collect() for x in r.positions))
    import hashlib

    order = sorted((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), len(t.split())) for d, t, _ in rows)
    total, before, want = sum(n for _, n in order), 0, []
    for _, n in order:
        want += [x / (1.5 * total) for x in (before + n / 2, before + n / 2 + total) if x < 1.5 * total]
        before += n
    assert np.allclose(got, sorted(want))
    monkeypatch.setattr(common, "CROWD", 10)
    assert mixed_documents(table).count() == sum(r.passes for _, r in by_row(table))


def test_a_mixture_comes_in_ranges_of_positions(spark, monkeypatch):
    from factloom.llm import mixing

    monkeypatch.setattr(mixing, "RANGE_WORDS", 500)
    docs = make_docs(spark, [f"d{i} " + "w " * (i % 9) for i in range(200)])
    stored = materialize(mixed_documents(docs), "ranges")
    place = {}
    for d, r in by_row(docs):
        place.setdefault(d, []).extend(r.positions)
    rows = stored.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    files = sorted({r.file_name for r in rows})
    assert len(files) >= 2
    last, read = -1.0, {}
    for r in sorted(rows, key=lambda r: (r.file_name, r.row_index)):
        at = sorted(place[r.doc_id])[read.get(r.doc_id, 0)]
        assert at >= last
        last, read[r.doc_id] = at, read.get(r.doc_id, 0) + 1
    windows = windows_of_files(stored, 2)
    assert {r.window for r in windows.collect()} == {0, 1}
    packed = pack_documents(windows, TOKENIZER, limit=64, with_ids=True).collect()
    where = {}
    for r in windows.collect():
        where.setdefault(r.doc_id, []).append(r.window)
    single = {d: w[0] for d, w in where.items() if len(set(w)) == 1}
    ids = {w: {r.sequence_id for r in packed if single.get(r.doc_id) == w} for w in (0, 1)}
    assert max(ids[0]) < min(ids[1])
    assert all(len(r.ids) == r.length for r in packed)
    assert {r.window for r in windows_of_files(docs, 4).collect()} == {0}


def test_equal_pieces_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "ALIKE", 7)
    table = spark.createDataFrame([(None, None)] * 50 + [(i, "a b c") for i in range(20)], "doc_id long, text string")
    rows = pack_documents(table, TOKENIZER, limit=16).collect()
    assert len(rows) == 70 and len({(r.sequence_id, r.offset) for r in rows}) == 70
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert len(ends) == -(-(50 + 20 * 4) // 16)


def test_other_tokenizers_encode_whole_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.word_by_word(TOKENIZER) and not packing.word_by_word(path)
    texts = ["some  words here", " leading", "", "é\n\nx"]
    rows = pack_documents(make_docs(spark, texts), path, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    assert {r.doc_id: list(r.ids) for r in rows} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_language_samples_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "_fit", lambda labels, pieces, tags: seen.append((labels, pieces, tags)))
    rows = [(7, f"word{i % 50} other words", "xx") for i in range(300)] + [(7, "same text", "xx")] * 300 + [(1, "long " * 5000, "yy"), (2, None, "yy"), (3, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit_languages(docs, F.lit(True), sample=20, stretches=30)
    labels, pieces, tags = seen[0]
    assert labels == ["xx", "yy"] and tags.count(0) == 20 and len({x for x, t in zip(pieces, tags) if t == 0}) == 20
    assert tags.count(1) == 30 and all(len(x.split()) <= 64 for x in pieces)


def test_quality_samples_are_bounded(spark, monkeypatch):
    updates = []
    monkeypatch.setattr(quality.FollowTheLeader, "update", lambda self, at, x, y: updates.append((len(at), y)))
    docs = spark.createDataFrame([(7, f"text number {i} of one id") for i in range(500)] + [(7, "equal text")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 1), (7, 0), (8, 1)], "doc_id long, label int")
    quality.fit_quality(docs, labels, F.lit(True), sample=10)
    assert len(updates) == 10 * quality.EPOCHS
    updates.clear()
    quality.fit_quality(docs, labels, F.lit(True), sample=10, most=60)
    assert 0 < sum(n - 1 for n, _ in updates) <= 60 * quality.EPOCHS


def test_large_insertions_encode_only_what_is_inserted():
    count = tokencount.token_counter(RANKS, public_tokenizers.PATTERN)
    tree = tokencount.CountTree("some words " * 20_000, count)
    before, extra = tree.encoded, "many new words " * 650
    tree.edit(100_000, 3, extra)
    assert tree.encoded - before < len(extra) + 4 * tokencount.LEAF
    draw, text = random.Random(3), tree.text
    for _ in range(200):
        at, removed, inserted = draw.randrange(len(text) + 1), draw.choice([0, 1, 40, 3000]), draw.choice(["", " x", "\n\n", "word " * 700])
        text = text[:at] + inserted + text[at + removed :]
        tree.edit(at, removed, inserted)
    assert tree.text == text and tree.total == count(text)

    def depth(node):
        if node.left is None:
            assert node.height == 0
            return 0
        a, b = depth(node.left), depth(node.right)
        assert abs(a - b) <= 1 and node.height == 1 + max(a, b)
        return node.height

    depth(tree.root)


def test_rows_of_one_id_are_counted_for_themselves(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "CROWD", 10)
    rows = [(7, "some words here")] * 35 + [(7, "other text"), (7, None), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS at")
    edits = spark.createDataFrame([(7, 1, 0, 0, "two more "), (7, 2, 0, 3, None), (None, 1, 0, 1, "q")], "doc_id long, edit_no int, at long, removed long, inserted string")
    count = tokencount.token_counter(RANKS, public_tokenizers.PATTERN)
    got = sorted(((r.doc_id, r.tokens_before, r.tokens_after, r.n_edits) for r in tokencount.counts_after_edits(docs, edits, RANKS, public_tokenizers.PATTERN).collect()), key=str)
    want = [(d, count(t or ""), count(t or "") if d is None else count(("two more " + (t or ""))[3:]), 0 if d is None else 2) for d, t in rows]
    assert got == sorted(want, key=str)

import os

import pytest

from factloom import models
from factloom.operators import documents
from factloom.operators.chunking import chunks


def test_rules_and_seam(spark):
    pages = spark.createDataFrame([("d", 1, "Acme revenue was $120 million. Margin is 5 %."), ("e", 1, "no number here")], "document_id string, page_number int, text string")
    rows = models.extract_facts(chunks(pages)).collect()
    assert [(r.subject, r.predicate, r.value_text, r.unit) for r in rows] == [("Acme", "revenue", "$120", "million"), ("Margin", "Margin", "5", "%")]
    mine = models.extract_facts(chunks(pages), lambda text: [{"subject": text[:4]}])
    assert [r.subject for r in mine.collect()] == ["Acme"]


def test_vectors_are_stable_units():
    assert models.hashed_vector("Net sales") == models.hashed_vector(" net SALES ")
    assert abs(sum(x * x for x in models.hashed_vector(None)) - 1) < 1e-9
    texts = ["Net sales", None, "", "é", "a b c " * 500, "x"]
    assert [x.tolist() for x in models.hashed_vectors(texts)] == [models.hashed_vector(x) for x in texts]


def test_vectors_by_force():
    text, sums = "net sales é😀", [0.0] * 64
    padded = f" {text} "
    for k in range(len(padded) - 2):
        a, b, c = (ord(x) for x in padded[k : k + 3])
        h = (a * 961 + b * 31 + c) * 2654435761 % 2**32
        sums[(h >> 16) % 64] += 1 if (h >> 8) & 1 else -1
    size = sum(x * x for x in sums) ** 0.5
    assert all(abs(x / size - y) < 1e-12 for x, y in zip(sums, models.hashed_vector(text)))


def test_a_reply_that_is_no_json_is_asked_for_once_more():
    asked, replies = [], iter(["Sorry, here: {broken", '```json\n{"facts": [{"subject": "s"}]}\n```', "no", "no again", '{"facts": 3}'])

    def model(prompt):
        asked.append(prompt)
        return next(replies)

    extract = models.repaired(model)
    facts, issues = extract("text")
    assert facts == [{"subject": "s"}] and [x["issue_type"] for x in issues] == ["malformed_json"] and issues[0]["preview"] == "Sorry, here: {broken"
    assert asked == ["text", f"text\n\n{models.AGAIN}"]
    with pytest.raises(ValueError):
        extract("text")
    assert len(asked) == 4
    with pytest.raises(ValueError, match="array of facts"):  # JSON of another shape is not asked for again
        extract("text")
    assert len(asked) == 5


def test_rounds_retry_what_failed(spark):
    chunks_ = spark.createDataFrame([("d", 1, "c1", "one", "pending"), ("d", 1, "c2", "two!", "failed"), ("d", 2, "c3", "skip", "skipped"), ("d", 2, "c4", "done", "done"), ("e", 1, "c5", "two!", "pending")], "document_id string, page_number int, chunk_id string, text string, status string")

    def extract(text):
        if "!" in text:
            raise RuntimeError("no reply\nsecond line")
        return [{"subject": text}], []

    found = models.extraction_round(chunks_, extract)
    rows = {r.chunk_id: r for r in found.collect()}
    assert {k: r.status for k, r in rows.items()} == {"c1": "done", "c2": "failed", "c5": "failed"}
    assert rows["c2"].issues[0].issue_type == "chunk_failed" and rows["c2"].issues[0].message == "no reply" and rows["c1"].facts[0].subject == "one"
    after = models.after_round(chunks_, found)
    assert {r.chunk_id: (r.status, r.n_facts) for r in after.collect()} == {"c1": ("done", 1), "c2": ("failed", 0), "c3": ("skipped", 0), "c4": ("done", 0), "c5": ("failed", 0)}
    runs = {r.document_id: (r.status, r.error) for r in models.document_runs(chunks_, found).collect()}
    assert runs == {"d": ("processed", "Fact extraction skipped 1 of 4 chunks"), "e": ("failed", "Fact extraction failed for all 1 pending chunks")}
    assert {r.chunk_id for r in models.extraction_round(after, lambda text: ([], [])).collect()} == {"c2", "c5"}


def test_retries():
    waits, replies = [], iter([RuntimeError("[429] retry in 1s"), RuntimeError("status 503"), "ok"])

    def call(prompt):
        reply = next(replies)
        if isinstance(reply, Exception):
            raise reply
        return reply

    assert models.with_retries(call, sleep=waits.append)("x") == "ok" and waits == [1.5, 4.0]
    with pytest.raises(ValueError):
        models.with_retries(lambda p: (_ for _ in ()).throw(ValueError("bad input")), sleep=waits.append)("x")
    assert models.delay_seconds(9) == 60


def test_a_judge_is_called_once_for_each_request_and_failures_stay_apart(spark, tmp_path):
    """Calls are counted by files, as they happen on the workers."""
    folder = str(tmp_path)

    def judge(prompt):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if "fails" in prompt:
            raise RuntimeError("status: 500\nmore")
        return "no JSON" if "babbles" in prompt else '```json\n{"verdicts": [{"pair": 1, "same": true, "reason": "alike"}, {"pair": 99, "same": true}]}\n```'

    n = 45
    rows = [("d", i // 20, i % 20 + 1, f"k{i}", f"{i % 20 + 1}. {['fine', 'fails', 'babbles'][i // 20]}") for i in range(n)]
    listing = spark.createDataFrame(rows, "document_id string, request int, place int, pair_key string, line string")
    replies, issues = models.judged(listing, judge)
    got = [(r.pair_key, r.same, r.reason) for r in documents.verdicts_of(replies, listing).collect()]
    assert got == [("k0", True, "alike")]
    assert [(r.request, r.issue_type, r.message) for r in issues.orderBy("request").collect()][0] == (1, "adjudication_failed", "status: 500")
    assert issues.count() == 2 and len(os.listdir(folder)) == -(-n // 20)
    assert all("different metrics" in r.handling for r in issues.collect())

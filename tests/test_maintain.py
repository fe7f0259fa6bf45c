"""Relationships that follow pages: like one run over everything, at the cost of what changed, and whole after failures."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.plans.catalog import balance_statements
from factloom.sources.keyed import KeyedTable
from factloom.streaming.maintain import PAGE, Maintained, followed


def pages(spark, documents):
    rows = []
    for document, clients in documents.items():
        owner = "w" + document[-1]
        for page, part in enumerate((clients[::2], clients[1::2]) if clients is not None else (None,), 1):
            text = None if part is None else " ".join(f"Client {c:03d} balance in FY{y} was {v:.2f} USD." for c, y, v in part)
            rows.append((document, owner, page, text))
    return spark.createDataFrame(rows, PAGE)


def first(n=60):
    return {
        "a-1": [(c, 2024, 10.0 * c) for c in range(n)],
        "b-1": [(c, 2024, 10.0 * c + 50 * (c % 3 == 0)) for c in range(n)],
        "c-1": [(c, 2023 + c % 2, 10.0 * c) for c in range(0, n, 2)],
        "d-2": [(c, 2024, 10.0 * c) for c in range(n)],
    }


COLUMNS = ["owner", "fact_a", "fact_b", "document_a", "document_b", "relationship_type", "context", "confidence", "similarity"]


def state_of(found):
    rels = sorted(tuple(r) for r in found.relationships().select(*COLUMNS).collect())
    near = sorted(tuple(r) for r in found.tables["matches"].read().collect())
    facts = sorted(r.fact_id for r in found.tables["facts"].read().collect())
    chunks = sorted((r.chunk_id, r.text) for r in found.tables["chunks"].read().collect())
    return rels, near, facts, chunks


CHANGES = {
    "b-1": [(c, 2024, 10.0 * c + 50 * (c % 3 == 0) + 7000 * (c == 5)) for c in range(60)],  # one value restated
    "c-1": None,  # withdrawn
    "e-1": [(c, 2024, 10.0 * c) for c in (1, 2, 99)],  # new
}


@pytest.mark.parametrize("k", [20, 2])
def test_two_deliveries_give_what_one_run_over_the_last_versions_gives(spark, tmp_path, k):
    config = Maintained.__dataclass_fields__["config"].default
    config = config.__class__(match_top_k=k)
    before = first()
    how = {"extractor": balance_statements, "config": config, "buckets": 4}
    twice = followed(spark, str(tmp_path / "two"), [lambda: pages(spark, before), lambda: pages(spark, CHANGES)], **how)
    last = {d: p for d, p in (before | CHANGES).items() if p is not None}
    once = followed(spark, str(tmp_path / "one"), [lambda: pages(spark, last)], **how)
    got, want = state_of(twice), state_of(once)
    assert got == want and len(got[0]) > 60
    log = [{r.kind: r.n for r in twice.log().where(F.col("batch") == b).collect()} for b in (0, 1)]
    assert log[0]["fresh"] == 210 and log[0]["gone"] == 0
    # One value, a withdrawn book of 30 and three new facts: only these and their groups are looked at.
    assert [log[1][x] for x in ("documents", "fresh", "gone")] == [3, 4, 31]
    assert log[1]["groups"] == 30 + 3 and log[1]["members"] <= 3 * 33 and log[1]["searched"] < log[0]["searched"]


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    found = Maintained(spark, str(tmp_path / "s"), balance_statements, buckets=4)
    found.step(pages(spark, first(12)), 0)
    found.step(pages(spark, {"b-1": [(1, 2024, 1.0)]}), 1)
    want = state_of(found)
    found.step(pages(spark, {"b-1": [(1, 2024, 1.0)]}), 1)
    assert state_of(found) == want


@pytest.mark.parametrize("dies_at", ["matches"])
def test_a_failure_between_tables_is_made_good_by_the_retry(spark, tmp_path, monkeypatch, dies_at):
    change = {"b-1": [(1, 2024, 1.0), (2, 2024, 20.0)], "a-1": None}
    whole, broken = (Maintained(spark, str(tmp_path / x), balance_statements, buckets=4) for x in ("whole", "broken"))
    for state in (whole, broken):
        state.step(pages(spark, first(12)), 0)
    whole.step(pages(spark, change), 1)
    put = KeyedTable.put

    def dies(self, folder):
        if self.path.endswith(dies_at):
            raise OSError("executor lost")
        put(self, folder)

    monkeypatch.setattr(KeyedTable, "put", dies)
    with pytest.raises(OSError):
        broken.step(pages(spark, change), 1)
    monkeypatch.setattr(KeyedTable, "put", put)
    broken.step(pages(spark, change), 1)
    assert state_of(broken) == state_of(whole)


def test_a_write_leaves_other_buckets_files_alone(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), "k string, n long", ["k"], ["k", "n"], 8)
    rows = spark.range(100).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("n"))
    held.staged(str(tmp_path / "s0"), rows, rows.select("k").limit(0))
    held.put(str(tmp_path / "s0"))

    def files():
        return {b: sorted(os.listdir(tmp_path / "t" / b)) for b in os.listdir(tmp_path / "t") if b.startswith("bucket=")}

    before = files()
    change = spark.createDataFrame([("k7", 700)], "k string, n long")
    touched = held.staged(str(tmp_path / "s1"), change, spark.createDataFrame([("k7",), ("k8",)], "k string"))
    for _ in range(2):
        held.put(str(tmp_path / "s1"))
    after = files()
    assert {b for b in after if after[b] != before[b]} == {f"bucket={b}" for b in touched} and len(touched) <= 2
    got = {r.k: r.n for r in held.read().collect()}
    assert got == {f"k{i}": i for i in range(100) if i != 8} | {"k7": 700}
    # A bucket from which all goes is empty, not as it was.
    gone = held.read().select("k")
    held.staged(str(tmp_path / "s2"), rows.limit(0), gone)
    held.put(str(tmp_path / "s2"))
    assert held.read().count() == 0 and held.having(rows).count() == 0


def test_the_last_of_several_versions_in_one_delivery_counts(spark, tmp_path):
    both = pages(spark, {"a-1": [(1, 2024, 1.0)]}).withColumn("version", F.lit(1)).unionByName(pages(spark, {"a-1": [(2, 2024, 2.0)]}).withColumn("version", F.lit(2)))
    state = Maintained(spark, str(tmp_path / "v"), balance_statements, buckets=2)
    state.step(both, 0)
    assert [r.subject for r in state.tables["facts"].read().collect()] == ["Client 002"]
    state.step(spark.createDataFrame([], PAGE), 1)
    assert state.tables["facts"].read().count() == 1

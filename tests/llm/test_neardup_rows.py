"""Near-duplicates among rows that share ids, in crowded keys, and by each way of comparing a bucket."""

import random

import pytest

from factloom.llm import common, neardup
from factloom.llm.components import connected_components
from tests.llm.test_llm_operators import components_by_force, make_docs, sample_texts


def near_copies(n, seed=5):
    draw, base, texts = random.Random(seed), [f"w{i}" for i in range(60)], []
    for _ in range(n):
        copy = list(base)
        for k in draw.sample(range(60), 3):
            copy[k] = f"c{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts


def test_rows_of_one_id_stay_apart(spark):
    rows = [(7, "one text of its own kind"), (7, "quite another text than that"), (7, "quite another text than that"), (3, "Quite another TEXT than that"), (8, None), (8, ""), (None, "x y"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS node", "1 AS key")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 2).collect()), key=str)
    assert got == sorted([(7, 7, True), (7, 3, False), (7, 3, False), (3, 3, True), (8, 8, True), (8, 8, True), (None, None, True), (None, None, True)], key=str)
    stays = neardup.without_near_duplicates(docs, 2)
    assert stays.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in stays.collect()), key=str) == sorted([(7, rows[0][1]), (3, rows[3][1]), (8, None), (8, ""), (None, "x y")], key=str)


def test_crowded_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    """A large group of near copies around one least member, and very many equal rows of one id."""
    texts = near_copies(150)
    docs = make_docs(spark, texts)
    many = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(300)).drop("id"))
    want = components_by_force(texts, 2, 80)
    monkeypatch.setattr(common, "CROWD", 40)
    got = neardup.near_duplicates(many, 2, 80).collect()
    assert len(got) == 450 and {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, *x) for i, x in want.items()}
    stays = [r.doc_id for r in neardup.without_near_duplicates(many, 2, 80).collect()]
    assert sorted(stays) == [i for i, x in want.items() if x[2]]


@pytest.mark.parametrize("few", [1, 10**6])
def test_both_ways_to_compare_a_bucket_find_the_same(spark, monkeypatch, few):
    texts = [*sample_texts(60, seed=8), *near_copies(60, seed=3), *near_copies(30, seed=9)]
    monkeypatch.setattr(neardup, "FEW", few)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(make_docs(spark, texts), 2, 80).collect()}
    assert got == components_by_force(texts, 2, 80)


def test_components_of_crowded_nodes(spark, monkeypatch):
    """Hubs that are the least, the largest and a middle node of their component, chains and random links."""
    draw = random.Random(4)
    links = [(1, k) for k in range(2, 90)] + [(500, k) for k in range(100, 190)] + [(250, k) for k in range(200, 300)]
    links += [(k, k + 1) for k in range(600, 640)] + [(draw.randrange(700, 900), draw.randrange(700, 900)) for _ in range(120)] + [(90, 89), (600, 189)]
    least = {x: x for pair in links for x in pair}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least[a], least[b])
            moved = moved or (least[a], least[b]) != (low, low)
            least[a] = least[b] = low
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    monkeypatch.setattr(common, "CROWD", 25)
    got = connected_components(spark.createDataFrame(links, "src long, dst long")).collect()
    assert len(got) == len(least) - len(alone) and {r.node: r.component for r in got} == {k: v for k, v in least.items() if k not in alone}

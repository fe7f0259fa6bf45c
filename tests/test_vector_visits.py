"""What a search by pivots hands on: each query once, however many clusters it visits."""

import numpy as np

from factloom.operators import vectors
from tests.test_vectors import by_force, clustered, table


def test_a_query_leaves_the_step_that_finds_its_visits_once(spark, monkeypatch):
    """Far-apart vectors visit nearly all clusters; tiles, blocks and steps of a visit give what all pairs give."""
    for name, value in {"WHOLE": 100, "BLOCK": 64, "CLUSTER": 20, "TILE": 4, "VISIT": 128}.items():
        monkeypatch.setattr(vectors, name, value)
    x = clustered(500, 12, 5, 2.0)
    x[300:305] = x[5]
    rows = table(spark, x, ["w"] * 500)
    both = vectors._unit(rows, 0).unionByName(vectors._unit(rows, 1))
    held = vectors.Clusters.of(both, spark.createDataFrame([("w", 500, 500)], "owner string, candidates long, queries long"))
    near = held.near(5)
    opened = held.opened(near, 5).cache()
    assert opened.count() == 500 < held.visits(near, 5).count() / 5
    got = {(r.fact_id, r.candidate_id, r["rank"]) for r in vectors.ranked(held.searched(5), 5).collect()}
    assert got == by_force(x, ["w"] * 500, range(500), 5)
    opened.unpersist()


def test_small_owners_share_a_product():
    left, right = np.array([0, 0, 1, 3, 3, 4]), np.array([0, 2, 3, 4, 4, 4])
    assert list(vectors._runs(left, right, 4)) == [(0, 2, 0, 1, True), (3, 6, 2, 6, False)]
    assert list(vectors._runs(left, right, 8)) == [(0, 6, 0, 6, False)]

"""A large workspace that is asked little is searched whole; offline vectors are those of plain counting."""

import numpy as np

from factloom import models
from factloom.operators import vectors
from tests.test_vectors import by_force, clustered, table


def test_few_queries_need_no_clusters(spark, monkeypatch):
    for name, value in {"WHOLE": 100, "BLOCK": 64, "CLUSTER": 20}.items():
        monkeypatch.setattr(vectors, name, value)
    monkeypatch.setattr(vectors, "Clusters", None)
    x = clustered(500, 12, 5, 2.0)
    rows = table(spark, x, ["w"] * 500)
    asked = rows.where(rows.fact_id.isin([r.fact_id for r in rows.orderBy("fact_id").limit(40).collect()]))
    got = {(r.fact_id, r.candidate_id, r["rank"]) for r in vectors.similar(asked, rows, 5).collect()}
    assert len(got) == 200 and got == by_force(x, ["w"] * 500, range(40), 5)


def test_vectors_of_several_texts_are_those_of_each():
    texts = ["", "é", "ab", None, "net sales 😀 \ud800", "x" * 300, " "]
    for dimension in (64, 10):
        for text, found in zip(texts, models.hashed_vectors(texts, dimension), strict=True):
            padded, sums = f" {text.strip()} " if text and text.strip() else "   ", np.zeros(dimension)
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                h = (ord(a) * 961 + ord(b) * 31 + ord(c)) * 2654435761 % 2**32
                sums[(h >> 16) % dimension] += 1 if h >> 8 & 1 else -1
            if not sums.any():
                sums[0] = 1
            assert np.array_equal(found, sums / np.sqrt((sums * sums).sum()))

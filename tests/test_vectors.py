"""The search by pivots finds what a comparison of all pairs finds, and compares few pairs where vectors cluster."""

import numpy as np
import pytest

from factloom.operators import vectors


def table(spark, x, owners, prefix="f"):
    rows = [(f"{prefix}{i:06d}", owners[i], [float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, "fact_id string, owner string, embedding array<double>")


def by_force(x, owners, asked, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in asked:
        own = [j for j in range(len(x)) if owners[j] == owners[i]]
        scores = np.round(unit[own] @ unit[i], 6)
        best = sorted(zip((-scores).tolist(), own, strict=True))[:k]
        out |= {(f"f{i:06d}", f"f{j:06d}", rank) for rank, (_, j) in enumerate(best, 1)}
    return out


def clustered(n, dim, centers, noise, seed=0):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centers, dim))
    return middle[draw.integers(0, centers, n)] + noise * draw.normal(size=(n, dim))


@pytest.mark.parametrize("noise", [0.05, 2.0])
def test_clusters_find_what_all_pairs_do(spark, monkeypatch, noise):
    """One large owner, some small ones, repeated vectors; few and many clusters left to visit."""
    monkeypatch.setattr(vectors, "WHOLE", 300)
    monkeypatch.setattr(vectors, "BLOCK", 128)
    monkeypatch.setattr(vectors, "CLUSTER", 40)
    x = clustered(900, 12, 15, noise)
    x[700:710] = x[5]
    owners = ["large" if i < 750 else f"o{i % 40}" for i in range(900)]
    rows = table(spark, x, owners)
    asked = [i for i in range(900) if i % 3 == 0]
    queries = rows.where("cast(substr(fact_id, 2) AS int) % 3 = 0")
    got = {(r.fact_id, r.candidate_id, r["rank"]) for r in vectors.similar(queries, rows, 7).collect()}
    assert got == by_force(x, owners, asked, 7)


def test_pairs_compared_are_few_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CLUSTER", 50)
    x = clustered(3000, 16, 40, 0.02)
    rows = vectors._unit(table(spark, x, ["w"] * 3000), 0).unionByName(vectors._unit(table(spark, x, ["w"] * 3000), 1))
    sizes = spark.createDataFrame([("w", 3000, 3000)], "owner string, candidates long, queries long")
    held = vectors.Clusters.of(rows, sizes)
    near = held.near(5)
    visits = held.visits(near, 5)
    sizes = {r.cluster: r.candidates for r in held.held.collect()}
    compared = sum(n * n for n in sizes.values()) + sum(sizes[r.cluster] * r["count"] for r in visits.groupBy("cluster").count().collect())
    assert compared < 3000 * 3000 / 5


def test_no_rows_on_a_side(spark):
    rows = table(spark, np.eye(3), ["a", "a", "b"])
    assert vectors.similar(rows.limit(0), rows, 2).collect() == [] == vectors.similar(rows, rows.limit(0), 2).collect()
    assert vectors.similar(rows.where("owner = 'b'"), rows.where("owner = 'a'"), 2).collect() == []


def test_a_kept_table_answers_like_a_fresh_one_and_reads_few_buckets(spark, tmp_path, monkeypatch):
    """Vectors come, move to other clusters, change owners and go; searches are exact throughout."""
    from factloom.sources.vector_table import VectorTable

    monkeypatch.setattr(vectors, "CLUSTER", 25)
    x = clustered(800, 16, 20, 0.02)
    owners = ["large" if i % 8 else "small" for i in range(800)]
    kept = VectorTable(spark, str(tmp_path / "kept"), buckets=16)
    rows = table(spark, x, owners)
    kept.change(rows.where("fact_id < 'f000600'"), rows.limit(0).select("fact_id"), 0)
    moved = x.copy()
    moved[100:140] = x[300:340]
    later = table(spark, moved, ["small" if 200 <= i < 210 else o for i, o in enumerate(owners)])
    change = later.where("fact_id >= 'f000600' OR fact_id BETWEEN 'f000100' AND 'f000139' OR fact_id BETWEEN 'f000200' AND 'f000209'")
    gone = rows.where("fact_id LIKE '%7'").select("fact_id")
    kept.change(change.where("fact_id NOT LIKE '%7'"), gone, 1)
    kept.change(change.where("fact_id NOT LIKE '%7'"), gone, 1)  # a retry
    final = later.where("fact_id NOT LIKE '%7'")
    queries = later.where("fact_id LIKE '%3'")
    want = sorted(map(tuple, vectors.similar(queries, final, 5).collect()))
    assert sorted(map(tuple, kept.search(queries, 5).collect())) == want and len(want) == 400
    assert kept.tables["rows"].read().count() == final.count() == kept.tables["places"].read().count()
    assert sum(r.candidates for r in kept.tables["clusters"].read().collect()) == final.count()
    one = queries.where("fact_id = 'f000003'")
    assert sorted(map(tuple, kept.search(one, 5).collect())) == [w for w in want if w[0] == "f000003"]
    assert len(kept.read) <= 4

"""What the two searches prune, and that their bounds hold."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann, tiles, topk
from factloom.llm.tiles import Bucket, meet


def frame(vectors, ids=None, **columns):
    return pd.DataFrame({"vec_id": np.arange(len(vectors)) if ids is None else ids, "vector": list(vectors), **columns})


def best_by_force(queries, candidates, k):
    return {(q, v) for q, x in zip(queries.vec_id, queries.vector) for _, v in sorted((-int(x @ w), v) for v, w in zip(candidates.vec_id, candidates.vector) if v != q)[:k]}


def test_both_prunings_run_and_lose_nothing():
    draw, k, made = np.random.default_rng(3), 3, {}
    centers = draw.normal(size=(6, 16))
    tile = np.floor(256 * (centers[draw.integers(0, 6, 3000)] + draw.normal(size=(3000, 16)) * 0.1) * draw.choice([0.2, 1, 2], 3000)[:, None])
    queries, candidates = frame(tile[:40], ids=np.arange(40)), frame(tile)
    scores = topk.products(tile[:40], tile)
    scores[np.arange(40), np.arange(40)] = -(2**62)
    for share, name in ((1.0, "by_coordinates"), (0.4, "by_length")):
        kth = np.sort(scores, axis=1)[:, -k]
        queries["beat"] = (kth * share).astype(np.int64)
        calls, whole = [], getattr(topk, name)

        def counted(*args, whole=whole, calls=calls):
            calls.append((len(args[1]), whole(*args)))
            return calls[-1][1]

        setattr(topk, name, counted)
        try:
            found = topk.search_tile(queries, candidates, k)
        finally:
            setattr(topk, name, whole)
        got = {(r.query_id, r.vec_id) for r in found.itertuples()}
        assert got == best_by_force(queries, candidates, k)
        made[name] = sum(n for n, _ in calls), sum(m for _, m in calls)
    assert made["by_coordinates"][0] > 30 and made["by_coordinates"][1] < made["by_coordinates"][0] * 1000
    assert made["by_length"][0] > 5 and made["by_length"][1] < made["by_length"][0] * 3000


def test_buckets_too_short_are_never_visited(spark):
    queries = spark.createDataFrame([(0, [3.0, 4.0], 100, 5.0), (50, [3.0, 4.0], 10, 5.0)], "vec_id long, vector array<double>, beat long, norm double")
    candidates = spark.createDataFrame([(i, [1.0, float(i % 2) * 20], None, 1.0) for i in range(40)], "vec_id long, vector array<double>, beat long, norm double")
    dealt = meet(queries, candidates, (F.col("vec_id") % 2).cast("int"), {0: Bucket(20, 1.0), 1: Bucket(20, 21.0)}, 2, 2, worth=lambda longest: F.col("beat") <= F.col("norm") * longest)
    assert sorted((r.vec_id, r.tile) for r in dealt.where("side = 0").collect()) == [(0, 1), (50, 1)]
    assert dealt.where("side = 1").count() == 40


def test_int8_bounds_hold_with_many_components():
    draw = np.random.default_rng(1)
    for dim in (3, 64, 4096):
        for make in (lambda n: draw.choice([-1.0, 1.0], (n, dim)), lambda n: draw.normal(size=(n, dim)), lambda n: draw.normal(size=(n, dim)) ** 5):
            left, right = make(20), make(30)
            right[0] = left[0]
            near, error = ann.bounds(ann.rounded(left), ann.rounded(right))
            p, q = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in (left, right))
            assert (np.abs(p @ q.T - near) <= error).all()
            a, b = ann.rounded(left)[0], ann.rounded(right)[0]
            assert (ann.whole_products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_a_first_score_cuts_survivors_and_loses_nothing():
    draw, k = np.random.default_rng(5), 5
    vectors = draw.normal(size=(2000, 32))
    queries, candidates = frame(vectors[:60], ids=np.arange(60)), frame(vectors)
    beat = ann.first_scores(queries.vec_id.to_numpy(), vectors[:60], candidates.vec_id.to_numpy()[:500], vectors[:500], k)
    _, without = ann.tile_best(queries.assign(beat=-2.0), candidates[1000:], k)
    found, survived = ann.tile_best(queries.assign(beat=beat), candidates[1000:], k)
    assert survived < without
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    for q in range(60):
        score = unit @ unit[q]
        score[q] = -2
        best = {int(v) for v in np.argsort(-score)[:k] if v >= 1000}
        assert best <= {int(v) for x, v, _ in found if x == q}


@pytest.mark.parametrize("dim", [2, 8, 64])
def test_a_full_group_stays_small(dim):
    """As many rows as a group may have: neither search holds more than 500 MB beside them."""
    rows, asked = (min(tiles.MOST_ROWS, values // dim) for values in (tiles.TILE_VALUES, tiles.QUERY_VALUES))
    draw = np.random.default_rng(dim)
    candidates, queries = draw.normal(size=(rows, dim)), draw.normal(size=(min(asked, 2000), dim))
    c = frame(candidates, beat=np.nan)
    tracemalloc.start()
    ann.tile_best(frame(queries, ids=np.arange(len(queries)) + 10**6, beat=-2.0), c, 5)
    topk.search_tile(frame(np.floor(256 * queries), ids=np.arange(len(queries)) + 10**6, beat=-(2**62)), frame(np.floor(256 * candidates), beat=0), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20


def test_runs_of_queries_prune_by_their_own_lengths():
    draw = np.random.default_rng(5)
    tile = np.floor(draw.normal(size=(500, 4)) * np.linspace(1, 400, 500)[:, None])
    queries = np.floor(draw.normal(size=(600, 4)) * 100)
    lengths, whole = np.sqrt((tile * tile).sum(axis=1)), topk.products(queries, tile)
    beat = np.sort(whole, axis=1)[:, -3].astype(float) - 0.5
    beat[::2] = 1.0  # half of them ask for nearly nothing
    out = {"query_id": [], "vec_id": [], "score": []}
    made = topk.by_length(out, np.arange(600) + 1000, queries, beat, np.arange(500), tile, lengths, 3)
    got = {(q, s) for q, s in zip(out["query_id"], out["score"], strict=True)}
    assert {(q + 1000, int(s)) for q in range(600) for s in np.sort(whole[q])[-3:]} <= got and made < 600 * 500

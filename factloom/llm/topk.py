"""Exact top-k search by inner product over whole numbers, with buckets by length.

Candidates are grouped by length and, within a length bucket, dealt to tiles. A first score to beat comes for
each query from the longest vectors; buckets too short for it are never visited. In each tile the score to beat turns
into a cosine threshold: beyond 1 the tile is skipped; if it is high, only candidates whose coordinates at the
query's strongest positions are near enough are verified (coordinate pruning); else all that are long enough
(length pruning).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import discard, materialize
from factloom.llm.tiles import Bucket, finite_vectors, meet

BUCKETS = 16
#: The longest vectors from which queries get their first scores to beat.
SEEDS = 2048
#: Queries whose products with a tile are held at a time.
RUN = 256
#: Local cosine thresholds from which coordinates prune better than lengths, and the coordinates of a query that are looked at.
STEEP, FOCUS = 0.5, 8


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whole-number inner products of all rows: exact, and held to the range of a long."""
    bound = left.shape[1] * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if bound < 2**53:
        return (left @ right.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in left], dtype=object) @ np.array([[int(x) for x in row] for row in right], dtype=object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, of equal ones the first."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, ties = np.flatnonzero(scores > kth), np.flatnonzero(scores == kth)
        kept = np.sort(np.concatenate([above, ties[: k - len(above)]]))
    else:
        kept = np.arange(len(scores))
    return kept[np.argsort(-scores[kept], kind="stable")][:k]


def once(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Marks rows, sorted by id, of which rows that repeat wholly are marked once."""
    new, rows = np.ones(len(ids), dtype=bool), set()
    near = np.flatnonzero(ids[1:] == ids[:-1])
    for i in sorted({*near.tolist(), *(near + 1).tolist()}):
        row = (int(ids[i]), vectors[i].tobytes())
        new[i] = row not in rows
        rows.add(row)
    return new


def by_length(out: dict, asked: np.ndarray, queries: np.ndarray, beat: np.ndarray, ids: np.ndarray, tile: np.ndarray, lengths: np.ndarray, k: int) -> int:
    """Length pruning: in runs of queries that ask for like lengths, verifies the candidates long enough for any of them; gives the products made."""
    long_q, made = np.sqrt((queries * queries).sum(axis=1)), 0
    least = np.where(beat > 0, beat / np.maximum(long_q, 1e-300), -1.0)
    order = np.argsort(least, kind="stable")
    for low in range(0, len(order), RUN):
        own = order[low : low + RUN]
        kept = np.flatnonzero(lengths >= least[own[0]] * (1 - 1e-9))
        for query, row in zip(asked[own], products(queries[own], tile[kept]), strict=True):
            _take(out, int(query), ids[kept], row, k)
        made += len(own) * len(kept)
    return made


def by_coordinates(out: dict, asked: np.ndarray, queries: np.ndarray, local: np.ndarray, ids: np.ndarray, tile: np.ndarray, lengths: np.ndarray, k: int) -> int:
    """Coordinate pruning: of the candidates near enough at the query's strongest coordinate, verifies those whose
    cosine can still reach the local threshold given all of its FOCUS strongest; gives the products made."""
    unit = tile / np.maximum(lengths, 1e-300)[:, None]
    made, sorted_by = 0, {}
    for i, query in enumerate(asked):
        direction = queries[i] / np.sqrt(queries[i] @ queries[i])
        strong = np.argsort(-np.abs(direction))[:FOCUS]
        f, t = int(strong[0]), min(1.0, float(local[i]))
        if f not in sorted_by:
            order = np.argsort(unit[:, f])
            sorted_by[f] = order, unit[order, f]
        order, column = sorted_by[f]
        reach = np.sqrt(max(0.0, (1 - t * t) * (1 - direction[f] ** 2))) + 1e-9
        low = -np.inf if direction[f] < -t else direction[f] * t - reach
        high = np.inf if direction[f] > t else direction[f] * t + reach
        kept = np.sort(order[np.searchsorted(column, low) : np.searchsorted(column, high, side="right")])
        part = unit[kept][:, strong]
        rest = np.sqrt(np.maximum(0.0, 1 - (part * part).sum(axis=1)) * max(0.0, 1 - (direction[strong] ** 2).sum()))
        kept = kept[part @ direction[strong] + rest >= t - 1e-9]
        made += len(kept)
        if len(kept):
            _take(out, int(query), ids[kept], products(queries[i : i + 1], tile[kept])[0], k)
    return made


def search_tile(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, vec_id and score of a tile's k best for each query, without those that can't reach its score to beat."""
    c = c.sort_values("vec_id")
    out = {"query_id": [], "vec_id": [], "score": []}
    for dim in set(q.vector.str.len()) & set(c.vector.str.len()) if len(q) and len(c) else ():
        qd, cd = q[q.vector.str.len() == dim], c[c.vector.str.len() == dim]
        asked, qv, cv, ids = qd.vec_id.to_numpy(), np.stack(qd.vector.to_numpy()), np.stack(cd.vector.to_numpy()), cd.vec_id.to_numpy()
        new = once(ids, cv)
        ids, cv = ids[new], cv[new]
        long_c, long_q = np.sqrt((cv * cv).sum(axis=1)), np.sqrt((qv * qv).sum(axis=1))
        beat, most = qd.beat.to_numpy(dtype=float) - 0.5, long_q * long_c.max()
        local = np.where(most > 0, beat / np.where(most > 0, most, 1), np.where(beat > 0, np.inf, -np.inf))
        alive = local <= 1 + 1e-9
        steep = alive & (local > STEEP)
        flat = alive & ~steep
        if flat.any():
            by_length(out, asked[flat], qv[flat], beat[flat], ids, cv, long_c, k)
        if steep.any():
            by_coordinates(out, asked[steep], qv[steep], local[steep], ids, cv, long_c, k)
    return pd.DataFrame(out, dtype="int64")


def _take(out: dict, query: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    others = ids != query
    ids, scores = ids[others], scores[others]
    best = best_rows(scores, k)
    out["query_id"] += [query] * len(best)
    out["vec_id"] += ids[best].tolist()
    out["score"] += scores[best].tolist()


def top_k_products(table: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x) components.

    Queries are the rows for which ``is_query`` holds (it may use vec_id), candidates all rows but those with the
    query's own id; ties go to the smaller vec_id. Exact. Null and empty vectors and such with null or not
    finite components take no part; vectors meet only those of as many components. Rows that repeat wholly
    count once, rows that share only an id each for itself as candidates, and as a query the least of them
    counts. Scores beyond the range of a long are held to its ends. Further columns are ignored; an empty
    table gives an empty result.
    """
    rows = finite_vectors(table, id_column, vector_column)
    rows = rows.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
    rows = materialize(rows, "vectors")
    marks = rows.agg(F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 1000)).first()[0]
    cuts = sorted(set(marks or []))
    bucket = sum((F.when(F.col("norm") >= x, 1).otherwise(0) for x in cuts), F.lit(0))
    held = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.max("norm").alias("longest"), F.max(F.size("vector")).alias("width")).collect()
    buckets = {r["b"]: Bucket(r["n"], r["longest"]) for r in held}

    seeds = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).dropDuplicates(["vec_id"]).toPandas()
    by_size = {n: (g.vec_id.to_numpy(), np.stack(g.vector.to_numpy())) for n, g in seeds.groupby(seeds.vector.str.len())} if len(seeds) else {}

    @F.pandas_udf("long")
    def first_score(ids: pd.Series, vectors: pd.Series) -> pd.Series:
        out = np.full(len(ids), -(2**62), dtype=np.int64)
        for n, at in vectors.groupby(vectors.str.len()).groups.items():
            at = vectors.index.get_indexer(at)
            if n in by_size and len(by_size[n][0]) > k:
                scores = products(np.stack(vectors.to_numpy()[at]), by_size[n][1])
                scores[by_size[n][0][None, :] == ids.to_numpy()[at][:, None]] = -(2**62)
                out[at] = np.partition(scores, -k, axis=1)[:, -k]
        return pd.Series(out)

    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = queries.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
    queries = materialize(queries.withColumn("beat", first_score("vec_id", "vector")), "queries")
    candidates = rows.withColumn("beat", F.lit(None).cast("long"))
    dealt = meet(
        queries, candidates.select("vec_id", "vector", "beat", "norm"), bucket, buckets, queries.count(), max((r["width"] for r in held), default=0),
        # A product is at most the product of the lengths; a bucket whose longest is too short is passed by.
        worth=lambda longest: F.col("beat") - 0.5 <= F.col("norm") * longest * (1 + 1e-9),
    ).drop("norm")
    found = dealt.groupBy("tile", "block").applyInPandas(
        lambda g: search_tile(g[g.side == 0], g[g.side == 1], k), "query_id long, vec_id long, score long"
    )
    found = materialize(found, "found")
    discard(rows, queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

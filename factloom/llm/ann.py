"""Nearest neighbours by cosine: a block matrix join of int8 tiles with error bounds.

Unit vectors are rounded to int8 steps of their own. The whole-number product of two rounded tiles gives every
cosine of the block pair to within a bound made of the two rounding errors. Each query has a first score to beat from
a fixed number of candidates; pairs whose upper bound reaches it and the tile's k-th best lower bound survive.
Their cosines are computed anew in double precision from the original vectors, and heaps merge the best of all
tiles. As no bound is ever exceeded, the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column_or, discard, materialize
from factloom.llm.tiles import Bucket, finite_vectors, meet

#: The candidates (of the least hashes of their ids) from which queries get their first scores to beat.
SEEDS = 1024
#: Rounding of the double arithmetic around a bound, for vectors of up to some hundred thousand components.
ROUNDING = 1e-9


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values of the unit vectors, the step of each, and the length of each rounding error."""
    high = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / high
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    step = np.abs(unit).max(axis=1, keepdims=True) / 127
    values = np.rint(unit / step)
    return values.astype(np.int8), step[:, 0], np.sqrt(((unit - step * values) ** 2).sum(axis=1))


def whole_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two int8 matrices, exactly: of 1024 components each is below 2 ** 24, which a float holds."""
    total = np.zeros((len(left), len(right)), dtype=np.int32)
    for k in range(0, left.shape[1], 1024):
        total += (left[:, k : k + 1024].astype(np.float32) @ right[:, k : k + 1024].astype(np.float32).T).astype(np.int32)
    return total


def bounds(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The estimated cosines of all rows of two rounded matrices, and by how much each may be off."""
    (li, ls, le), (ri, rs, re) = left, right
    near = whole_products(li, ri) * (ls[:, None] * rs)
    return near, le[:, None] + (1 + le[:, None]) * re + ROUNDING


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of corresponding rows, summed from the first component to the last."""
    dot, a, b = (np.zeros(len(left)) for _ in range(3))
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        for k in range(left.shape[1]):
            dot += left[:, k] * right[:, k]
            a += left[:, k] * left[:, k]
            b += right[:, k] * right[:, k]
        score = dot / (np.sqrt(a) * np.sqrt(b))
        odd = ~(np.isfinite(score) & (a > 1e-290) & (b > 1e-290))
    if odd.any():  # out of a double's range: scaled first
        p, q = (x[odd] / np.abs(x[odd]).max(axis=1, keepdims=True) for x in (left, right))
        score[odd] = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1)) / np.sqrt((q * q).sum(axis=1))
    return np.clip(score, -1.0, 1.0)


def first_scores(ids: np.ndarray, vectors: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th nearest reaches: its k-th lower bound among the seeds, without its own id."""
    if len(seeds) <= k:
        return np.full(len(ids), -2.0)
    near, error = bounds(rounded(vectors), rounded(seeds))
    low = np.where(seed_ids[None, :] == ids[:, None], -2.0, near - error)
    return np.partition(low, -k, axis=1)[:, -k]


def tile_best(q: pd.DataFrame, c: pd.DataFrame, k: int) -> tuple[list, int]:
    """(query, candidate, score) of the k best of a tile for each query that may still be among its best, and the number of survivors."""
    out, survived = [], 0
    for dim in set(q.vector.str.len()) & set(c.vector.str.len()) if len(q) and len(c) else ():
        qd, cd = q[q.vector.str.len() == dim], c[c.vector.str.len() == dim]
        again = cd.vec_id.duplicated(keep=False)
        if again.any():  # rows that repeat wholly count once
            same = pd.DataFrame({"i": cd.vec_id[again], "v": cd.vector[again].map(lambda x: x.tobytes())}).duplicated()
            cd = cd.drop(index=same[same].index)
        qv, cv, ids, asked = np.stack(qd.vector.to_numpy()), np.stack(cd.vector.to_numpy()), cd.vec_id.to_numpy(), qd.vec_id.to_numpy()
        beat, right = qd.beat.to_numpy(dtype=float), rounded(cv)
        for at in range(0, len(qd), 256):
            own = slice(at, at + 256)
            near, error = bounds(rounded(qv[own]), right)
            high, low = near + error, near - error
            mine = ids[None, :] == asked[own, None]
            cut = beat[own]
            if len(ids) > k:
                low[mine] = -2.0
                cut = np.maximum(cut, np.partition(low, -k, axis=1)[:, -k])
            rows, columns = np.nonzero((high >= cut[:, None]) & ~mine)
            survived += len(rows)
            scores = np.concatenate([cosines(qv[at + rows[i : i + 8192]], cv[columns[i : i + 8192]]) for i in range(0, len(rows), 8192)] or [np.zeros(0)])
            ends = np.searchsorted(rows, np.arange(len(cut) + 1))
            for i in np.flatnonzero(np.diff(ends)):
                some = slice(ends[i], ends[i + 1])
                best = heapq.nsmallest(k, zip((-scores[some]).tolist(), ids[columns[some]].tolist(), strict=True))
                out += [(asked[at + i], v, -s) for s, v in best]
    return out, survived


def nearest_neighbours(table: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest cosines, in double precision.

    Queries are the rows for which ``is_query`` holds (it may use vec_id), candidates all rows but those with the
    query's own id; ties go to the smaller vec_id. Null, empty and zero vectors and such with null or not
    finite components take no part; vectors meet only those of as many components. Rows that repeat wholly
    count once, rows that share only an id each for itself as candidates, and as a query the least of them
    counts. Further columns are ignored; an empty table gives an empty result.
    """
    rows = finite_vectors(table, id_column, vector_column).where(F.exists("vector", lambda x: x != 0))
    rows = materialize(rows, "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).dropDuplicates(["vec_id"]).toPandas()
    by_size = {m: (g.vec_id.to_numpy(), np.stack(g.vector.to_numpy())) for m, g in seeds.groupby(seeds.vector.str.len())} if len(seeds) else {}

    @F.pandas_udf("double")
    def first(ids: pd.Series, vectors: pd.Series) -> pd.Series:
        out = np.full(len(ids), -2.0)
        for m, at in vectors.groupby(vectors.str.len()).groups.items():
            at = vectors.index.get_indexer(at)
            if m in by_size:
                out[at] = first_scores(ids.to_numpy()[at], np.stack(vectors.to_numpy()[at]), *by_size[m], k)
        return pd.Series(out)

    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = materialize(queries.withColumn("beat", first("vec_id", "vector")), "queries")
    dealt = meet(queries, rows.withColumn("beat", F.lit(None).cast("double")), F.lit(0), {0: Bucket(n)} if n else {}, queries.count(), width)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        found, _ = tile_best(group[group.side == 0], group[group.side == 1], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = materialize(dealt.groupBy("tile", "block").applyInPandas(search, "query_id long, vec_id long, score double"), "found")
    discard(rows, queries)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[float, int]] = []
        current = None

        def close() -> Iterator[pa.RecordBatch]:
            if heap:
                best = sorted(heap, reverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([current] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([-v for _, v in best], pa.int64()), pa.array([s for s, _ in best], pa.float64())],
                    names=["query_id", "rank", "vec_id", "score"],
                )

        for batch in batches:
            for query, vec_id, score in zip(*(column_or(batch, c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if query != current:
                    yield from close()
                    current, heap = query, []
                # The worst is on top: of equal scores the larger id.
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec_id))
        yield from close()

    ordered = found.repartition("query_id").sortWithinPartitions("query_id")
    return ordered.mapInArrow(merged, "query_id long, rank int, vec_id long, score double")

"""Blocks of queries against tiles of vectors: the dealing that both vector searches share.

A row (of either side) is copied only to the groups in which it meets the other side, so a group holds one
tile of candidates and one block of queries and its size is bounded; no side is broadcast. A query goes only to
tiles of buckets that can hold something better than its score to beat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of the candidates of a tile and of the queries of a block.
TILE_VALUES, QUERY_VALUES = 1 << 21, 1 << 20
#: The most candidates of a tile and queries of a block, however few components they have.
MOST_ROWS = 1 << 14
#: Tiles are made smaller than that, down to so many candidates, to have some for each core.
TILE_LEAST, TILES_LEAST = 4096, 64


@dataclass
class Bucket:
    """Candidates that are dealt to tiles of their own: how many, and the largest length among them."""

    rows: int
    longest: float = float("inf")


def finite_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Rows (vec_id, vector as doubles); null, empty and not wholly finite vectors take no part."""
    vector = F.col(vector_column).cast("array<double>")
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
    good = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & good)


def meet(queries: DataFrame, candidates: DataFrame, bucket: Column, buckets: dict[int, Bucket], query_count: int, width: int, worth: object = None) -> DataFrame:
    """Both sides dealt to groups (tile, block): side 0 are queries, side 1 candidates.

    ``buckets`` has each value of ``bucket``, a column over candidates; a bucket has as many tiles as its size asks for,
    and vec_id's hash deals its rows to them. ``worth(longest)`` tells, as a column over queries, whether a bucket's
    tiles are worth a visit. ``width`` is the largest number of components. Rows keep their own columns; both sides
    must have the same ones.
    """
    if not buckets:
        return queries.select(F.lit(0).alias("tile"), F.lit(0).alias("block"), F.lit(0).alias("side"), "*").limit(0)
    total = sum(b.rows for b in buckets.values())
    size = max(1, min(MOST_ROWS, TILE_VALUES // max(width, 1), max(TILE_LEAST, -(-total // TILES_LEAST))))
    blocks = max(1, -(-query_count // max(1, min(MOST_ROWS, QUERY_VALUES // max(width, 1)))))
    tiles, places = 0, {}
    for b, held in sorted(buckets.items()):
        places[b] = (tiles, -(-held.rows // size))
        tiles += places[b][1]
    base = F.create_map(*[F.lit(x) for b, (k, _) in places.items() for x in (b, k)])
    wide = F.create_map(*[F.lit(x) for b, (_, n) in places.items() for x in (b, n)])
    tile = base[bucket] + F.pmod(F.xxhash64("vec_id"), wide[bucket]).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    visits = [
        F.when(worth(F.lit(buckets[b].longest)) if worth else F.lit(True), F.sequence(F.lit(k), F.lit(k + n - 1))).otherwise(F.array().cast("array<int>"))
        for b, (k, n) in places.items()
    ]
    own = queries.columns
    left = queries.withColumn("block", block).select(F.explode(F.flatten(F.array(*visits))).alias("tile"), "block", F.lit(0).alias("side"), *own)
    right = candidates.withColumn("tile", tile).select("tile", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), *own)
    return left.unionByName(right)

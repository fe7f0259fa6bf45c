"""A kept table of vectors, laid out by owner and cluster, whose searches read only clusters that a distance bound leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import vectors
from factloom.sources.keyed import KeyedTable, exists, removed
from factloom.sources.tables import scratch, stored


class VectorTable:
    """Unit vectors under ``root`` by owner and nearest pivot.

    An owner's pivots are drawn from its first rows and stay. ``clusters`` has each cluster's size and a radius: the largest angle of
    any row it ever had, which deletions may leave too large, never too small, so searches stay exact. ``places`` tells
    where an id lies. Changes touch only the buckets of these tables that they must.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root = spark, root
        make = {
            "pivots": ("owner string, fact_id string, embedding array<double>", ["owner"], ["owner", "fact_id"]),
            "rows": ("owner string, cluster int, fact_id string, embedding array<double>, angle double", ["owner", "cluster"], ["owner", "cluster", "fact_id"]),
            "places": ("fact_id string, owner string, cluster int", ["fact_id"], ["fact_id"]),
            "clusters": ("owner string, cluster int, candidates long, radius double", ["owner"], ["owner", "cluster"]),
        }
        self.tables = {name: KeyedTable(spark, f"{root}/{name}", *how, buckets) for name, how in make.items()}
        #: Buckets of rows that the last search read.
        self.read: set[int] = set()

    def _pivots(self, sizes: DataFrame) -> DataFrame:
        parts = sizes.select("owner", F.ceil(F.col("n") / (4 * vectors.BLOCK)).alias("parts"))
        return self.tables["pivots"].having(sizes).join(parts, "owner").select("owner", "parts", "fact_id", "embedding")

    def change(self, rows: DataFrame, gone: DataFrame, number: int = 0) -> None:
        """Puts ``rows`` (fact_id, owner, embedding) in place of those of their ids, and takes the ids ``gone`` (fact_id) out.

        Repeated with the same ``number`` after a failure, it goes on from what was staged. Null, zero and not finite vectors are none:
        a row with one only takes its id out.
        """
        folder = f"{self.root}/staged/{number}"
        if not exists(self.spark, f"{folder}/ready/_SUCCESS"):
            self._stage(rows, gone, folder)
        for name, keyed in self.tables.items():
            keyed.put(f"{folder}/{name}")
        if number:
            removed(self.spark, f"{self.root}/staged/{number - 1}")

    def _stage(self, rows: DataFrame, gone: DataFrame, folder: str) -> None:
        t = self.tables
        ids = stored(rows.select("fact_id").union(gone.select("fact_id")).distinct(), "ids")
        fresh = stored(vectors._unit(vectors.usable(rows.where("owner IS NOT NULL AND fact_id IS NOT NULL")), 1).dropDuplicates(["fact_id"]), "fresh")
        sizes = stored(fresh.groupBy("owner").agg(F.count("*").alias("n")), "sizes")
        known = t["pivots"].having(sizes).select("owner").distinct()
        first = fresh.join(sizes.join(known, "owner", "left_anti"), "owner")
        clusters = F.least(F.ceil(F.col("n") / vectors.CLUSTER), F.lit(vectors.MOST_CLUSTERS))
        chosen = first.where(F.pmod(F.xxhash64("fact_id", F.lit(2)), F.col("n")) < clusters)
        # Where chance chose none, the owner's least id is its pivot.
        least = first.groupBy("owner").agg(F.min_by("embedding", "fact_id").alias("embedding"), F.min("fact_id").alias("fact_id"))
        least = least.join(chosen.select("owner").distinct(), "owner", "left_anti")
        drawn = stored(chosen.select("owner", "fact_id", "embedding").unionByName(least.select("owner", "fact_id", "embedding")), "drawn")
        parts = sizes.select("owner", F.ceil(F.col("n") / (4 * vectors.BLOCK)).alias("parts"))
        pivots = stored(self._pivots(sizes).unionByName(drawn.join(parts, "owner").select("owner", "parts", "fact_id", "embedding")), "pivots")
        placed = stored(vectors.Clusters.assigned(fresh.join(parts, "owner"), pivots).drop("side"), "placed")
        old = stored(t["places"].having(ids), "old")
        came = placed.groupBy("owner", "cluster").agg(F.count("*").alias("more"), F.max("angle").alias("reach"))
        went = old.groupBy("owner", "cluster").agg(F.count("*").alias("less"))
        moved = came.join(went, ["owner", "cluster"], "full")
        was = t["clusters"].having(moved.select("owner"))
        now = moved.join(was, ["owner", "cluster"], "left").select(
            "owner", "cluster",
            (F.coalesce("candidates", F.lit(0)) + F.coalesce("more", F.lit(0)) - F.coalesce("less", F.lit(0))).alias("candidates"),
            F.greatest(F.coalesce("radius", F.lit(0.0)), F.coalesce("reach", F.lit(0.0))).alias("radius"),
        )
        now = stored(now, "now")
        t["pivots"].staged(f"{folder}/pivots", drawn, drawn.select("owner").limit(0))
        t["rows"].staged(f"{folder}/rows", placed, old.select("owner", "cluster", "fact_id"))
        t["places"].staged(f"{folder}/places", placed, ids)
        t["clusters"].staged(f"{folder}/clusters", now, now.select("owner", "cluster").limit(0))
        self.spark.range(1).write.mode("overwrite").parquet(f"{folder}/ready")

    def _candidates(self, keys: DataFrame) -> DataFrame:
        keys = stored(keys, "keys")
        buckets = self.tables["rows"].touched(keys)
        self.read |= set(buckets)
        return self.tables["rows"].having(keys, buckets)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """fact_id, candidate_id, similarity, rank: the k nearest kept vectors of each query (fact_id, owner, embedding), as ``vectors.similar``
        finds them among all."""
        self.read = set()
        asked = stored(vectors._unit(vectors.usable(queries.where("owner IS NOT NULL")), 0), "asked")
        sizes = stored(asked.groupBy("owner").agg(F.count("*").alias("n")), "sizes")
        pivots = stored(self._pivots(sizes), "pivots")
        rows = stored(vectors.Clusters.assigned(asked.join(pivots.select("owner", "parts").distinct(), "owner"), pivots), "queries")
        held = stored(self.tables["clusters"].having(sizes), "held")
        found = stored(vectors.Clusters(rows, pivots, held, self._candidates).searched(k), "found")
        return vectors.ranked(found, k)


def kept(spark: SparkSession, **how: object) -> VectorTable:
    """An empty table in a new shared folder."""
    return VectorTable(spark, scratch(spark, "vectors"), **how)

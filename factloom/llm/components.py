"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import copied, crowded, dealt, discard, materialize


def _with_least(edges: DataFrame, least: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The edges with the ``m`` of their u; edges of a crowded u are dealt to several tasks."""
    if hot is None:
        return edges.join(least, "u")
    return dealt(edges, hot, ["u"], F.xxhash64("v")).join(copied(least, hot, ["u"]), ["u", "_salt"])


def large_star(edges: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Every node links its larger neighbours to the least of itself and its neighbours."""
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.union(larger).groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return _with_least(larger, least, hot).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least, hot).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row (node, component) for every node of ``links``; component is the least node reachable.

    Nodes may have any type that can be ordered. A node with very many neighbours is dealt to several tasks; as the
    large star gives no node more neighbours than it had, those found before it serve both steps. Each round writes its edges to the shared folder and deletes
    those of the round before; the rounds end when the number of edges and the sum
    of their hashes no longer change. Links with a null end and self-links are left out; an empty input
    gives an empty result.
    """
    edges = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    edges = materialize(edges.distinct(), "edges")
    state = None
    while True:
        listed = crowded(edges.union(edges.select("v", "u")), ["u"])
        hot = listed if listed.head(1) else None
        earlier, edges = edges, materialize(small_star(large_star(edges, hot).distinct(), hot).distinct(), "edges")
        discard(earlier)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

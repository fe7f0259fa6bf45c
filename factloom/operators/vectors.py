"""Similarity search by cosine within a workspace, exact.

Small workspaces, and larger ones that are asked little, are searched whole, many small ones in one task. In others candidates are dealt to the nearest of some
pivots, which gives clusters with a radius. A query first searches the cluster it falls into; from then on it visits
only clusters that the triangle inequality of angles leaves: those whose pivot is no farther away than their radius and the
angle to the query's k-th best so far together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.config import DEFAULTS
from factloom.functions.text import let
from factloom.sources.tables import stored

#: Queries and candidates that meet in one step; a workspace of at most WHOLE candidates is not clustered.
BLOCK, WHOLE = 2048, 8192
#: Candidates to a cluster, and the most clusters of a workspace.
CLUSTER, MOST_CLUSTERS = 512, 4096
#: Clusters that a query visits together, and queries and candidates that meet in one step of such a visit.
TILE, VISIT = 16, 8192
#: By how much a rounded similarity and the angles computed from it may be off.
MARGIN = 2e-6


def usable(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """Vectors without null, not finite or all-zero components, and of the given dimension."""
    numbers = F.col("embedding").cast("array<double>")
    good = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.withColumn("embedding", numbers).where(good)
    return rows.where(F.size("embedding") == dimension) if dimension else rows


def checked_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """``vectors`` as they are; reading one of another dimension than the index has fails."""
    wrong = F.concat(F.lit(f"the index has dimension {dimension}, a vector "), F.size("embedding").cast("string"))
    kept = F.when((F.size("embedding") == dimension) | F.col("embedding").isNull(), F.col("embedding")).otherwise(F.raise_error(wrong).cast(vectors.schema["embedding"].dataType))
    return vectors.withColumn("embedding", kept)


def best_matches(left: np.ndarray, right: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score (6 decimals) of each row's k highest inner products, of equal ones the first columns; those below ``least`` may be left out."""
    return best_scores(left @ right.T, k, least)


def best_scores(scores: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best_matches``, of given scores; those of pairs that do not count are minus infinity."""
    cut = np.full(len(scores), -np.inf) if least is None else least
    if scores.shape[1] > k:
        cut = np.maximum(cut, np.round(np.partition(scores, -k, axis=1)[:, -k], 6))
    # Only what may reach the cut is rounded.
    rows, columns = np.nonzero((scores >= (cut - 1e-6)[:, None]) & (scores > -np.inf))
    found = np.round(scores[rows, columns], 6)
    reached = found >= cut[rows]
    rows, columns, found = rows[reached], columns[reached], found[reached]
    order = np.lexsort((columns, -found, rows))
    rows, columns, found = rows[order], columns[order], found[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = place < k
    return rows[kept], columns[kept], found[kept]


_FOUND = "owner string, fact_id string, candidate_id string, similarity double"


def _runs(left: np.ndarray, right: np.ndarray, most: int = 256) -> Iterator[tuple[int, int, int, int, bool]]:
    """Where owners that both sides (sorted owners) have lie: from and to on the left, on the right, and whether it is one owner; small ones share a run."""
    own = np.intersect1d(left, right)
    ends = [np.searchsorted(side, own, which) for side in (left, right) for which in ("left", "right")]
    n, i = len(own), 0
    while i < n:
        j = i + 1
        while j < n and ends[1][j] - ends[0][i] <= most and ends[3][j] - ends[2][i] <= most:
            j += 1
        yield int(ends[0][i]), int(ends[1][j - 1]), int(ends[2][i]), int(ends[3][j - 1]), j == i + 1
        i = j


def _searched(q: pd.DataFrame, c: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k best of ``c`` for each row of ``q``, within each owner.

    A ``beat`` that q has is the least score that counts. An ``open`` of q has a bit for each part of c that a query visits; that of c is its part.
    """
    if q.empty or c.empty:
        return
    if len({len(e) for side in (q, c) for e in side.embedding}) > 1:  # owners of several dimensions: one owner at a time
        if q.owner.nunique() > 1 or c.owner.nunique() > 1:
            theirs = dict(iter(c.groupby("owner")))
            for owner, mine in q.groupby("owner"):
                yield from _searched(mine, theirs.get(owner, c.iloc[:0]), k)
            return
    q, c = q.sort_values("owner", kind="stable"), c.sort_values(["owner", "fact_id"])
    left, right, ids = np.stack(q.embedding.to_numpy()), np.stack(c.embedding.to_numpy()), c.fact_id.to_numpy()
    # Names as numbers, in the order of the names.
    code = np.unique(np.concatenate([q.owner.to_numpy(dtype=str), c.owner.to_numpy(dtype=str)]), return_inverse=True)[1]
    codes = code[: len(q)], code[len(q) :]
    parts = c.open.to_numpy(dtype=np.int64) if "open" in c else None
    for q_low, q_high, c_low, c_high, alone in _runs(*codes):
        for low in range(q_low, q_high, 512):
            rows = slice(low, min(low + 512, q_high))
            if parts is None:
                scores = left[rows] @ right[c_low:c_high].T
            else:
                scores = np.full((rows.stop - low, c_high - c_low), -np.inf)
                bits = q.open.to_numpy(dtype=np.int64)[rows]
                for part in np.unique(parts[c_low:c_high]):
                    mine, theirs = np.flatnonzero(bits >> part & 1), np.flatnonzero(parts[c_low:c_high] == part)
                    if len(mine):
                        scores[np.ix_(mine, theirs)] = left[rows][mine] @ right[c_low:c_high][theirs].T
            if not alone:
                scores[codes[0][rows][:, None] != codes[1][c_low:c_high][None, :]] = -np.inf
            least = q.beat.to_numpy(dtype=float)[rows] if "beat" in q else None
            i, j, found = best_scores(scores, k, least)
            yield pd.DataFrame({"owner": q.owner.to_numpy()[rows][i], "fact_id": q.fact_id.to_numpy()[rows][i], "candidate_id": ids[c_low:c_high][j], "similarity": found})


def _search(dealt: DataFrame, keys: list[str], k: int) -> DataFrame:
    def search(group: pd.DataFrame) -> pd.DataFrame:
        found = list(_searched(group[group.side == 0], group[group.side == 1], k))
        return pd.concat(found) if found else pd.DataFrame({"owner": [], "fact_id": [], "candidate_id": [], "similarity": []}, dtype=object).astype({"similarity": float})

    return dealt.groupBy(*keys).applyInPandas(search, _FOUND)


def _unit(rows: DataFrame, side: int) -> DataFrame:
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.select("owner", F.lit(side).alias("side"), "fact_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.withColumn("embedding", let(length, lambda n: F.transform("embedding", lambda x: x / n)))


def _dealt(rows: DataFrame, blocks: Column, tiles: Column, *keys: str) -> DataFrame:
    """Rows dealt to groups (keys, block, tile): a query to one block and all tiles, a candidate to one tile and all blocks."""
    block, tile = (F.pmod(F.xxhash64("fact_id", F.lit(x)), n).cast("int") for x, n in ((0, blocks), (1, tiles)))
    query = F.col("side") == 0
    rows = rows.withColumn("block", F.explode(F.when(query, F.array(block)).otherwise(F.sequence(F.lit(0), (blocks - 1).cast("int")))))
    return rows.withColumn("tile", F.explode(F.when(query, F.sequence(F.lit(0), (tiles - 1).cast("int"))).otherwise(F.array(tile))))


def _steps(n: Column, most: int | None = None) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / (most or BLOCK)))


class Clusters:
    """The clusters of large workspaces: rows with their cluster, and each cluster's pivot, size and radius (an angle)."""

    def __init__(self, rows: DataFrame, pivots: DataFrame, held: DataFrame, candidates: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """``rows`` are queries (and candidates) with their cluster, ``held`` the clusters; ``candidates`` gives those of some clusters (owner, cluster)."""
        self.rows, self.pivots, self.held = rows, pivots, held
        self.candidates = candidates or (lambda _: rows.where("side = 1"))

    @classmethod
    def of(cls, rows: DataFrame, sizes: DataFrame) -> Clusters:
        n = F.least(F.ceil(F.col("candidates") / CLUSTER), F.lit(MOST_CLUSTERS))
        placed = rows.join(sizes.select("owner", "candidates", n.alias("clusters"), F.ceil((F.col("candidates") + F.col("queries")) / (4 * BLOCK)).alias("parts")), "owner")
        chosen = (F.col("side") == 1) & (F.pmod(F.xxhash64("fact_id", F.lit(2)), F.col("candidates")) < F.col("clusters"))
        pivots = stored(placed.where(chosen).select("owner", "parts", "fact_id", "embedding"), "pivots")
        rows = stored(cls.assigned(placed, pivots), "clustered")
        held = rows.groupBy("owner", "cluster").agg(F.count_if(F.col("side") == 1).alias("candidates"), F.max(F.when(F.col("side") == 1, F.col("angle"))).alias("radius"))
        return cls(rows, pivots, stored(held, "clusters"))

    @classmethod
    def assigned(cls, rows: DataFrame, pivots: DataFrame) -> DataFrame:
        """Rows (owner, parts, side, fact_id, embedding) with their nearest pivot's number and the angle to it."""
        schema = "owner string, side int, fact_id string, embedding array<double>, cluster int, angle double"
        return cls._by_part(rows.withColumn("beat", F.lit(None).cast("double")), pivots.withColumn("radius", F.lit(0.0)), cls._assigned, schema)

    @staticmethod
    def _by_part(rows: DataFrame, pivots: DataFrame, step: object, schema: str) -> DataFrame:
        """Applies ``step`` to parts of an owner's rows of bounded size, each with all of the owner's pivots (side 2)."""
        columns = ["owner", "part", "side", "fact_id", "embedding", "beat", "radius"]
        own = rows.withColumns({"part": F.pmod(F.xxhash64("fact_id", F.lit(3)), "parts").cast("int"), "radius": F.lit(None).cast("double")})
        copies = pivots.withColumns({"side": F.lit(2), "part": F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)), "beat": F.lit(None).cast("double")})
        return own.select(*columns).unionByName(copies.select(*columns)).groupBy("owner", "part").applyInPandas(step, schema)

    @staticmethod
    def _assigned(group: pd.DataFrame) -> pd.DataFrame:
        rows, pivots = group[group.side < 2], group[group.side == 2].sort_values("fact_id")
        cluster, angle = np.zeros(len(rows), np.int32), np.full(len(rows), np.pi)
        if len(pivots) and len(rows):
            right = np.stack(pivots.embedding.to_numpy())
            for low in range(0, len(rows), 1024):
                near = np.stack(rows.embedding.iloc[low : low + 1024].to_numpy()) @ right.T
                cluster[low : low + 1024] = near.argmax(axis=1)
                angle[low : low + 1024] = np.arccos(np.clip(near.max(axis=1), -1, 1))
        return rows[["owner", "side", "fact_id", "embedding"]].assign(cluster=cluster, angle=angle)

    def _met(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best of queries (owner, cluster, fact_id, embedding, beat), each in its cluster."""
        counts = queries.groupBy("owner", "cluster").agg(F.count("*").alias("queries"))
        held = self.held.where("candidates > 0").select("owner", "cluster", "candidates").join(counts, ["owner", "cluster"])
        own = self.candidates(held.select("owner", "cluster")).select("owner", "cluster", F.lit(1).alias("side"), "fact_id", "embedding", F.lit(None).cast("double").alias("beat"))
        both = own.unionByName(queries.withColumn("side", F.lit(0)).select(*own.columns)).join(held, ["owner", "cluster"])
        return _search(_dealt(both, _steps(F.col("queries")), _steps(F.col("candidates")), "owner", "cluster"), ["owner", "cluster", "block", "tile"], k)

    def near(self, k: int) -> DataFrame:
        """The k best of each query within its own cluster."""
        return self._met(self.rows.where("side = 0").withColumn("beat", F.lit(-2.0)), k)

    def opened(self, found: DataFrame, k: int) -> DataFrame:
        """Queries (owner, fact_id, embedding, beat), each once, with the ``tiles`` that may hold something at least as good as their k-th best of ``found``.

        A tile is some clusters: ``tiles`` has its number and, in the lower bits, which of its clusters are meant. A query's own cluster is not.
        """
        order = Window.partitionBy("owner", "fact_id").orderBy(F.desc("similarity"), "candidate_id")
        kth = found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("owner", "fact_id", F.col("similarity").alias("beat"))
        queries = self.rows.where("side = 0").join(kth, ["owner", "fact_id"], "left").withColumn("beat", F.coalesce("beat", F.lit(-1.0)))
        queries = queries.join(self.pivots.select("owner", "parts").distinct(), "owner")
        # A pivot's number in its owner's sorted list is its cluster.
        number = F.row_number().over(Window.partitionBy("owner").orderBy("fact_id")) - 1
        pivots = self.pivots.withColumn("cluster", number).join(self.held.select("owner", "cluster", "radius"), ["owner", "cluster"], "left").withColumn("radius", F.coalesce("radius", F.lit(-1.0)))

        def opened(group: pd.DataFrame) -> pd.DataFrame:
            rows, ours = group[group.side == 0], group[group.side == 2].sort_values("fact_id")
            tiles = []
            if len(rows) and len(ours):
                right, radius = np.stack(ours.embedding.to_numpy()), ours.radius.to_numpy()
                count = -(-len(ours) // TILE)
                for low in range(0, len(rows), 1024):
                    some = rows.iloc[low : low + 1024]
                    near = np.stack(some.embedding.to_numpy()) @ right.T
                    reach = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - radius))
                    open_ = np.zeros((len(some), count * TILE), dtype=np.int64)
                    open_[:, : len(ours)] = (reach >= some.beat.to_numpy()[:, None] - MARGIN) & (radius >= 0)
                    open_[np.arange(len(some)), near.argmax(axis=1)] = 0
                    bits = open_.reshape(len(some), count, TILE) @ (1 << np.arange(TILE))
                    named = bits + (np.arange(count) << TILE)
                    tiles += [n[b > 0] for n, b in zip(named, bits, strict=True)]
            return rows[["owner", "fact_id", "embedding", "beat"]].assign(tiles=tiles or [np.zeros(0, np.int64)] * len(rows))

        schema = "owner string, fact_id string, embedding array<double>, beat double, tiles array<long>"
        return self._by_part(queries.select("owner", "parts", "side", "fact_id", "embedding", "beat"), pivots, opened, schema)

    @staticmethod
    def _clusters(opened: DataFrame, *columns: str) -> DataFrame:
        """``columns`` of the queries of ``opened`` with each cluster that they visit."""
        rows = opened.select(*columns, F.explode("tiles").alias("named"))
        rows = rows.select(*columns, "named", F.explode(F.sequence(F.lit(0), F.lit(TILE - 1))).alias("place")).where("shiftright(named, place) & 1 = 1")
        return rows.select(*columns, (F.shiftright("named", TILE) * TILE + F.col("place")).cast("int").alias("cluster"))

    def visits(self, found: DataFrame, k: int) -> DataFrame:
        """Queries (owner, fact_id, embedding, beat) with the other clusters that may hold something at least as good as their k-th best of ``found``."""
        return self._clusters(self.opened(found, k), "owner", "fact_id", "embedding", "beat")

    def visited(self, opened: DataFrame, k: int) -> DataFrame:
        """The k best of each query's visits that reach its ``beat``; a query moves once for each tile, not for each cluster."""
        part = F.lit((1 << TILE) - 1).cast("long")
        queries = opened.select("owner", F.lit(0).alias("side"), "fact_id", "embedding", "beat", F.explode("tiles").alias("named"))
        queries = queries.withColumns({"tiled": F.shiftright("named", TILE).cast("int"), "open": F.col("named").bitwiseAND(part)}).drop("named")
        tiled = (F.col("cluster") / TILE).cast("int")
        counts = opened.select("owner", F.explode("tiles").alias("named")).groupBy("owner", F.shiftright("named", TILE).cast("int").alias("tiled")).agg(F.count("*").alias("queries"))
        held = self.held.where("candidates > 0").groupBy("owner", tiled.alias("tiled")).agg(F.sum("candidates").alias("candidates"))
        own = self.candidates(self._clusters(opened, "owner").distinct()).select(
            "owner", F.lit(1).alias("side"), "fact_id", "embedding", F.lit(None).cast("double").alias("beat"), tiled.alias("tiled"), (F.col("cluster") % TILE).cast("long").alias("open")
        )
        both = own.unionByName(queries).join(stored(held.join(counts, ["owner", "tiled"]), "tiles"), ["owner", "tiled"])
        return _search(_dealt(both, _steps(F.col("queries"), VISIT), _steps(F.col("candidates"), VISIT), "owner", "tiled"), ["owner", "tiled", "block", "tile"], k)

    def searched(self, k: int) -> DataFrame:
        """owner, fact_id, candidate_id, similarity: the best of each query's own cluster and of those it visits; some may be more than its k best."""
        near = stored(self.near(k), "near")
        return near.unionByName(self.visited(stored(self.opened(near, k), "opened"), k))


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("owner", "fact_id").orderBy(F.desc("similarity"), "candidate_id")
    rows = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.select("fact_id", "candidate_id", "similarity", "rank")


def similar(queries: DataFrame, candidates: DataFrame, k: int = DEFAULTS.match_top_k) -> DataFrame:
    """Rows fact_id, candidate_id, similarity (6 decimals), rank: the k nearest candidates of each query, itself included.

    Both sides have fact_id, owner and embedding; only rows of one owner meet, in groups of bounded size, each of which leaves
    its own k best. Owners of more than WHOLE candidates are clustered. An owner without a name is none.
    """
    rows = _unit(queries, 0).unionByName(_unit(candidates, 1)).where("owner IS NOT NULL")
    sizes = rows.groupBy("owner").agg(F.count_if(F.col("side") == 1).alias("candidates"), F.count_if(F.col("side") == 0).alias("queries"))
    sizes = stored(sizes.where("candidates > 0 AND queries > 0"), "sizes")
    whole = (F.col("candidates") <= WHOLE) | (F.col("queries") <= BLOCK)
    small = sizes.where(whole)
    # Owners that fit together share a group; those of more than a block have groups of their own.
    totals = sizes.agg(F.sum(F.when(F.col("candidates") <= BLOCK, F.col("candidates") + F.col("queries"))).alias("few"), F.count_if(~whole).alias("many")).first()
    packs = max(1, -(-(totals["few"] or 0) // (2 * BLOCK)))
    alone = (F.col("candidates") > BLOCK) | (F.col("queries") > BLOCK)
    packed = rows.join(small, "owner").withColumn("pack", F.when(alone, F.col("owner")).otherwise(F.pmod(F.xxhash64("owner"), F.lit(packs)).cast("string")))
    found = _search(_dealt(packed, _steps(F.col("queries")), _steps(F.col("candidates")), "pack"), ["pack", "block", "tile"], k)
    if totals["many"]:
        found = found.unionByName(Clusters.of(rows, sizes.where(~whole)).searched(k))
    return ranked(found, k)


def document_matches(facts: DataFrame, k: int = DEFAULTS.match_top_k) -> DataFrame:
    """Matches across documents: the k nearest are counted first, then a fact's own document is left out.

    ``facts`` has fact_id, owner, document_id and embedding.
    """
    found = similar(facts, facts, k)
    owns = facts.select("fact_id", "document_id")
    other = owns.select(F.col("fact_id").alias("candidate_id"), F.col("document_id").alias("candidate_document"))
    return found.join(owns, "fact_id").join(other, "candidate_id").where("document_id <> candidate_document")

"""Near-duplicate documents: MinHash signatures, banding, verification, components.

1. Every document's set of word shingles becomes 112 minima of universal hashes, of which 28 bands of 4
   are keys, and one byte of each minimum is kept to estimate similarities.
2. Documents with equal sets form a class, and only one document of a class goes on. A document is named by
   its doc_id and the hash of its text (a node), so rows that share a doc_id alone stay apart.
3. In each band's bucket all members are paired with the least member (a star, never all pairs); pairs
   whose estimate is more than 5.5 standard deviations short of the threshold go, all others are confirmed
   on their full sets, and confirmed links are joined to components. The pairs of a member that stands in
   very many are dealt to several tasks, each of which gets that member's set once.
4. A bucket that still holds several components may hide links between them. In a small bucket members of
   different components are paired as before. In a larger one its members outside its largest component
   are compared with all others in blocks of bounded size: first estimates, then, for members with a
   likely partner, full sets. Only links that join something leave a block.

Links with a similarity of 0.8 share no band with a probability of 0.59 ** 28 < 4e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks_of, column_or, copied, crowded, dealt, discard, hash_filter, materialize, passing, utf8_views
from factloom.llm.components import connected_components
from factloom.llm.words import mix, shingle_hashes, word_hashes

BANDS, ROWS = 28, 4
MINIMA = BANDS * ROWS
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 5.5

_seeds = (mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
MULTIPLY, ADD = _seeds[:MINIMA, None] | np.uint32(1), _seeds[MINIMA:, None]
#: Members of a bucket that are compared with as many others in one group of rows.
BLOCK = 256
#: Buckets of at most so many members are compared as rows of pairs, at most 7.5 for a member.
FEW = 16


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over the shingles."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINIMA, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(best, (MULTIPLY * short[at : at + 512] + ADD).min(axis=1), out=best)
    return best


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The set of each row's shingles, as sorted hashes."""
    raw, offsets = utf8_views(column)
    for i, j in blocks_of(offsets):
        words, rows = word_hashes(raw, offsets[i : j + 1])
        for k in range(j - i):
            yield shingle_hashes(words[rows[k] : rows[k + 1]], width)


#: Stands for a null doc_id in a node, so that it comes last.
LAST = (1 << 63) - 1
NODE = "struct<id: bigint, h: bigint>"


def _node(doc_id: Column, text: Column) -> Column:
    return F.struct(F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("h"))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, node, n_shingles, fp (two longs that name the set), bands (keys), marks (a byte of each minimum)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, high, low, keys, marks = [], [], [], [], []
            for found in shingle_sets(column_or(batch, "text"), width):
                sizes.append(len(found))
                high.append(int(found.sum(dtype=np.uint64)) if len(found) else 0)
                low.append(int(mix(found).sum(dtype=np.uint64)) if len(found) else 0)
                if not len(found):
                    keys.append(None)
                    marks.append(None)
                    continue
                least = minima(found)
                band = np.arange(BANDS, dtype=np.uint64)
                for r in least.astype(np.uint64).reshape(BANDS, ROWS).T:
                    band = mix(band * np.uint64(0xD6E8FEB86659FD93) + r)
                keys.append(band.view(np.int64))
                marks.append(least.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    column_or(batch, "doc_id"),
                    column_or(batch, "node"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(high, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(low, dtype=np.uint64).view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(marks, pa.binary()),
                ],
                names=["doc_id", "node", "n_shingles", "fp1", "fp2", "bands", "marks"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), _node(F.col("doc_id"), F.col("text")).alias("node"), "text")
    return rows.mapInArrow(sketch, f"doc_id long, node {NODE}, n_shingles long, fp1 long, fp2 long, bands array<long>, marks binary")


def _distinct_sets(docs: DataFrame, needed: DataFrame, hot: DataFrame | None, width: int) -> DataFrame:
    """node and shingles (sorted hashes) of the nodes in ``needed``, one row each, however many rows a node has."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(column_or(batch, "text"), width)]
            yield pa.RecordBatch.from_arrays([column_or(batch, "node"), pa.array(found, pa.binary())], names=["node", "shingles"])

    words = hash_filter(needed.select("node.h"))
    # Most documents stand in no pair: their texts need not move.
    rows, keys = passing(docs.select(_node(F.col("doc_id"), F.col("text")).alias("node"), "text"), words, F.col("node.h")), ["node"]
    if hot is not None:
        rows, needed, keys = dealt(rows, hot, keys, F.monotonically_increasing_id()), copied(needed, hot, keys), ["node", "_salt"]
    rows = rows.join(needed, keys, "left_semi").dropDuplicates(keys)
    found = rows.select("node", "text").mapInArrow(sets, f"node {NODE}, shingles binary")
    return found if hot is None else found.dropDuplicates(["node"])


def _with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) with ``name`` of both nodes as va and vb; an a with very many pairs is dealt to several tasks."""
    hot = crowded(pairs, ["a"])
    both = pairs.join(values.select(F.col("node").alias("b"), F.col(name).alias("vb")), "b")
    left = copied(values.select(F.col("node").alias("a"), F.col(name).alias("va")), hot, ["a"])
    return dealt(both, hot, ["a"], F.xxhash64("b")).join(left, ["a", "_salt"]).select("a", "b", "va", "vb")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b), those whose estimated similarity is at least ``least``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(column_or(batch, c).to_pylist()), np.uint8).reshape(-1, MINIMA) for c in ("va", "vb")
            )
            same = (left == right).mean(axis=1)
            yield batch.filter(pa.array((same - 1 / 256) / (1 - 1 / 256) >= least)).select(["a", "b"])

    return _with_both(pairs, nodes, "marks").mapInArrow(keep, f"a {NODE}, b {NODE}")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Of the pairs, those with 100 * intersection >= similarity * union, by their full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(column_or(batch, "va"), column_or(batch, "vb"), strict=True):
                p, q = (np.frombuffer(x.as_buffer(), np.uint64) for x in (p, q))
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * shared >= similarity * (len(p) + len(q) - shared))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return _with_both(pairs, sets, "shingles").mapInArrow(confirm, f"a {NODE}, b {NODE}")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _mixed(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (key, node, part, n, main, wide, deep) of the buckets that hold several components.

    n: the bucket's members; main: its largest component; wide, deep: the blocks of members in it and outside.
    """
    placed = buckets.select("key", "node").join(parts, "node", "left")
    placed = materialize(placed.select("key", "node", F.coalesce("component", "node").alias("part")), "placed")
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k"))
    sizes = sizes.where("k > 1").select(
        "key",
        "n",
        F.col("top.part").alias("main"),
        F.ceil(F.col("top.n") / BLOCK).cast("int").alias("wide"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("deep"),
    )
    sizes = materialize(sizes, "sizes")
    mixed = materialize(placed.join(sizes, "key"), "mixed")
    discard(placed, sizes)
    return mixed


def _cells(mixed: DataFrame) -> DataFrame:
    """Rows (key, i, j, side, node, part) of the blocks in which members of different components meet.

    Side 0 holds members outside the bucket's largest component. Blocks (i, j) with j >= 0 set the i-th of
    these against the j-th block of the largest component; with j < 0, against block -1 - j of their own.
    """
    rows = mixed.where(F.col("n") > FEW).withColumn("h", F.xxhash64("node"))
    small = rows.where("part != main").withColumn("own", F.expr("cast(pmod(h, deep) as int)"))
    large = rows.where("part = main").withColumn("own", F.expr("cast(pmod(h, wide) as int)"))
    spread = F.expr("explode(sequence(0, deep - 1))")
    return (
        small.select("key", F.col("own").alias("i"), F.expr("explode(sequence(0, wide - 1))").alias("j"), F.lit(0).alias("side"), "node", "part")
        .unionByName(large.select("key", spread.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "node", "part"))
        .unionByName(
            small.select("key", "own", spread.alias("other"), "node", "part").where("own <= other")
            .select("key", F.col("own").alias("i"), F.expr("-1 - other").alias("j"), F.lit(0).alias("side"), "node", "part"))
        .unionByName(
            small.select("key", "own", spread.alias("other"), "node", "part").where("other <= own")
            .select("key", F.col("other").alias("i"), F.expr("-1 - own").alias("j"), F.lit(1).alias("side"), "node", "part"))
    )


#: A node and its component as plain columns, which pandas takes without objects.
_FLAT = ["key", "i", "j", "side", "node.id AS nid", "node.h AS nh", "part.id AS pid", "part.h AS ph"]
_FLAT_SCHEMA = "key long, i int, j int, side int, nid long, nh long, pid long, ph long"


def likely_block(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """The members of one block that have a likely partner of another component on the other side."""
    p, q = (group[group.side == s] for s in (0, 1))
    if p.empty or q.empty:
        return group.iloc[:0].drop(columns=["bands", "marks"])
    mp, mq = (np.frombuffer(b"".join(x.marks), np.uint8).reshape(len(x), MINIMA) for x in (p, q))
    bp, bq = (np.stack(x.bands.to_numpy()) for x in (p, q))
    same = np.zeros((len(p), len(q)), dtype=np.int16)
    for k in range(MINIMA):
        same += mp[:, k, None] == mq[:, k]
    apart = (p.pid.to_numpy()[:, None] != q.pid.to_numpy()) | (p.ph.to_numpy()[:, None] != q.ph.to_numpy())
    fit = ((same / MINIMA - 1 / 256) / (1 - 1 / 256) >= least) & apart
    for k in np.flatnonzero(bp[0] == group.key.iloc[0])[:1]:
        for earlier in range(k):  # such pairs meet in the earlier band's bucket
            fit &= bp[:, earlier, None] != bq[:, earlier]
    kept = pd.concat([p[fit.any(axis=1)], q[fit.any(axis=0)]])
    return kept.drop(columns=["bands", "marks"])


def linked_block(group: pd.DataFrame, similarity: int) -> pd.DataFrame:
    """Links between the sides of one block by full sets: of those that join the same components, the first."""
    p, q = (group[group.side == s] for s in (0, 1))
    out, root = [], {}

    def find(x: tuple) -> tuple:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    if len(p) and len(q):
        sets = [np.frombuffer(x, np.uint64) for x in q.shingles]
        sizes = np.array([len(x) for x in sets])
        flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        nodes, parts = list(zip(q.nid, q.nh, strict=True)), list(zip(q.pid, q.ph, strict=True))
        for nid, nh, pid, ph, raw in zip(p.nid, p.nh, p.pid, p.ph, p.shingles, strict=True):
            own = np.frombuffer(raw, np.uint64)
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            shared = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
            for k in np.flatnonzero(100 * shared >= similarity * (len(own) + sizes - shared)):
                u, v = find((pid, ph)), find(parts[k])
                if u != v:
                    root[u] = v
                    out.append((nid, nh, *nodes[k]))
    return pd.DataFrame(out, columns=["aid", "ah", "bid", "bh"]).astype("int64")


def _across(mixed: DataFrame, nodes: DataFrame, docs: DataFrame, hot: DataFrame | None, width: int, similarity: int, least: float) -> DataFrame:
    """Links (a, b) between components that still meet in a bucket of more than FEW members."""
    cells = materialize(_cells(mixed), "cells")
    rows = cells.join(nodes, "node").selectExpr(*_FLAT, "bands", "marks")
    kept = materialize(rows.groupBy("key", "i", "j").applyInPandas(lambda g: likely_block(g, least), _FLAT_SCHEMA), "open")
    node = F.struct(F.col("nid").alias("id"), F.col("nh").alias("h"))
    kept_nodes = kept.select(node.alias("node"), "*")
    full = _distinct_sets(docs, kept_nodes.select("node").distinct(), hot, width)
    found = kept_nodes.join(full, "node").drop("node").groupBy("key", "i", "j").applyInPandas(lambda g: linked_block(g, similarity), "aid long, ah long, bid long, bh long")
    links = materialize(found.selectExpr("named_struct('id', aid, 'h', ah) AS a", "named_struct('id', bid, 'h', bh) AS b"), "links")
    discard(cells, kept)
    return links


def _grouped(docs: DataFrame, width: int, similarity: int) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, node, n_shingles and component (a node, null without shingles) of every row, and the crowded nodes."""
    docs = docs.select("doc_id", "text")
    sketched = materialize(sketches(docs, width), "sketches")
    some = sketched.where("n_shingles > 0")
    hot = crowded(some, ["node"])
    hot = hot if hot.head(1) else None
    classes = materialize(some.groupBy("fp1", "fp2").agg(F.min("node").alias("rep")), "classes")
    nodes = materialize(
        some.join(classes.select(F.col("rep").alias("node")), "node", "left_semi").select("node", "bands", "marks").dropDuplicates(["node"]), "nodes"
    )
    rows = nodes.select(F.explode("bands").alias("key"), "node")
    full = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("center")).where("n > 1").select("key", "center")
    full = materialize(full, "keys")
    buckets = materialize(rows.join(full, "key"), "buckets")

    least = similarity / 100 - SLACK * (similarity / 100 * (1 - similarity / 100) / MINIMA) ** 0.5
    star = materialize(buckets.where("node > center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "star")
    tried = materialize(_likely(star, nodes, least), "likely")
    sets = materialize(_distinct_sets(docs, _ends(tried), hot, width), "sets")
    links = materialize(_confirmed(tried, sets, similarity), "links")
    discard(full, star, sets)
    parts = materialize(connected_components(links, "a", "b"), "parts")
    mixed = _mixed(buckets, parts)
    few = mixed.where(F.col("n") <= FEW).select("key", F.col("node").alias("x"), F.col("part").alias("px"))
    pairs = few.join(few.select("key", F.col("x").alias("y"), F.col("px").alias("py")), "key").where("px < py")
    pairs = materialize(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    again = materialize(_likely(pairs, nodes, least).join(tried, ["a", "b"], "left_anti"), "likely")
    sets = materialize(_distinct_sets(docs, _ends(again), hot, width), "sets")
    near = materialize(_confirmed(again, sets, similarity), "links")
    wide = _across(mixed, nodes, docs, hot, width, similarity, least)
    parts_now = connected_components(links.unionByName(near).unionByName(wide), "a", "b")
    named = materialize(
        classes.join(parts_now.withColumnRenamed("node", "rep"), "rep", "left")
        .select("fp1", "fp2", F.coalesce("component", "rep").alias("component")), "named",
    )
    discard(classes, nodes, buckets, tried, links, parts, mixed, pairs, again, sets, near, wide)
    rows = sketched.select("doc_id", "node", "n_shingles", "fp1", "fp2").join(named, ["fp1", "fp2"], "left")
    return rows.select("doc_id", "node", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component")), hot


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least doc_id that chains of links reach, itself included; ``kept`` marks the
    document that stays. ``width`` is the number of words of a shingle and ``similarity`` the Jaccard
    similarity in percent from which two documents are linked.

    Null, empty and blank texts have no shingles and are linked with nothing. A text with fewer words than
    ``width`` counts as one shingle. Rows that share a doc_id but not the text are documents of their own; a
    null doc_id counts as larger than all others: it is a component's id (null) and kept only where the component has no
    other. Of several rows with a component's least doc_id all are marked kept. Further columns are ignored;
    an empty table gives an empty result.
    """
    rows, _ = _grouped(docs, width, similarity)
    own = F.coalesce("component", "node")
    return rows.select(
        "doc_id", "n_shingles", F.nullif(own["id"], F.lit(LAST)).alias("component_id"), (F.col("node.id") == own["id"]).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each component, and all without words.

    Of a component the document with the least doc_id stays (null last), of several with it the one with the least
    hash of its text, of rows that agree in both the one with the least hash of all columns.
    """
    grouped, hot = _grouped(docs, width, similarity)
    grouped = materialize(grouped.where("n_shingles > 0").select("node", "component"), "grouped")
    # Documents that share their component with nothing stay where they are; only the others' rows meet.
    crowds = grouped.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    met = materialize(grouped.join(crowds, "component", "left_semi").select("node", "component"), "met")
    kept = met.where("node = component").select("node").distinct()
    words = hash_filter(met.select("node.h"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "text", _node(F.col("doc_id"), F.col("text")).alias("node"))
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    worded = keyed.where(~blank).drop("text")
    rows, keys = passing(worded, words, F.col("node.h")), ["node"]
    # What the filter passes by chance is in no crowd.
    chance = rows.join(met.select("node").distinct(), "node", "left_anti")
    alone = passing(worded, words, F.col("node.h"), pass_=False)
    if hot is not None:
        rows, kept, keys = dealt(rows, hot, keys, F.monotonically_increasing_id()), copied(kept, hot, keys), ["node", "_salt"]
    least = F.min_by("row", F.xxhash64("row")).alias("row")
    one = rows.join(kept, keys, "left_semi").groupBy(*keys).agg(least)
    one = one if hot is None else one.groupBy("node").agg(least)
    return one.select("row.*").unionByName(chance.select("row.*")).unionByName(alone.select("row.*")).unionByName(keyed.where(blank).select("row.*"))

"""Where quoted evidence occurs: every document that contains a passage, without comparing all pairs.

A passage is looked for by the rarest of its windows of twelve characters, spaces left out: documents first count, in a
sketch of fixed size, how often windows that some passage has occur in them. Counts in a sketch may be too high, never too low, so a
passage with a window that is counted nowhere occurs nowhere. If a passage has fewer than twelve characters without
spaces, they count: it occurs only as it stands, and its start is its anchor. Documents then offer the windows that may be
an anchor, which a bitmap of fixed size tells; what passes is joined on the hash, and the texts themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import normalize_evidence
from factloom.sources.tables import stored

WIDTH, BITS = 12, 20
#: Slots of the sketch.
SKETCH = 22
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided by
_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.cumprod(out, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def window_keys(data: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` bytes that lie within a row, and their rows; ``rows`` has the rows' n+1 offsets."""
    ends = np.maximum(rows[1:] - width + 1, rows[:-1])
    count = ends - rows[:-1]
    owner = np.repeat(np.arange(len(count)), count)
    starts = np.arange(len(owner)) + np.repeat(rows[:-1] - (np.cumsum(count) - count), count)
    up, down = _table(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(width)) * up[: len(data)], dtype=np.uint64)))
    out = (sums[starts + width] - sums[starts]) * down[starts]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return (out >> np.uint64(1)).view(np.int64), owner


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """ASCII texts as one buffer, and their n+1 offsets in it."""
    return np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)


def _tight(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buffer without spaces."""
    kept = data != 32
    return data[kept], np.concatenate(([0], np.cumsum(kept)))[rows]


def tight(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def _marked(keys: DataFrame, groups: list[str], log2: int) -> dict[tuple, np.ndarray]:
    """For each value of ``groups`` (few) a bitmap of the hashes ``key``, put together by an aggregate in pieces of 4 KB."""
    slot = F.pmod(F.col("key"), F.lit(1 << log2)) + 1
    pieces = keys.groupBy(*groups, F.bitmap_bucket_number(slot).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    marks: dict[tuple, np.ndarray] = {}
    for r in pieces.collect():
        bits = marks.setdefault(tuple(r[g] for g in groups), np.zeros(1 << log2, dtype=bool))
        found = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little").astype(bool)
        bits[(r["piece"] - 1) * len(found) : r["piece"] * len(found)] = found
    return marks


def _windows(items: DataFrame) -> DataFrame:
    """item_id, at and key of all windows of the passages ``es``; of shorter ones that of the start ``anchor`` of ``e``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                ids, anchors, texts = (c.slice(low, 256).to_pylist() for c in batch.columns)
                parts = [(WIDTH, [i for i, x in enumerate(texts) if len(x) >= WIDTH], texts)]
                for width in {len(x) for x, y in zip(anchors, texts, strict=True) if len(y) < WIDTH}:
                    parts.append((width, [i for i, x in enumerate(anchors) if len(texts[i]) < WIDTH and len(x) == width], anchors))
                for width, own, source in parts:
                    data, rows = _bytes([source[i] for i in own])
                    keys, owner = window_keys(data, rows, width)
                    at = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[own[k]] for k in owner], batch.schema.field(0).type), pa.array(at.astype(np.int32)), pa.array(keys)], names=["item_id", "at", "key"])

    return items.select("item_id", "anchor", "es").mapInArrow(cut, items.select("item_id").schema.add("at", "integer").add("key", "long"))


def _counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """slot and n: how often windows of the documents fall on a slot that some passage's window has."""
    bits = _marked(windows, [], SKETCH).get((), np.zeros(1 << SKETCH, dtype=bool))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = np.unpackbits(shared.value).astype(bool), np.zeros(1 << SKETCH, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                keys, _ = window_keys(*_tight(*_bytes(batch.column(1).slice(low, 256).to_pylist())), WIDTH)
                slots = keys & ((1 << SKETCH) - 1)
                np.add.at(counts, slots[wanted[slots]], 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["slot", "n"])

    return docs.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def likely_places(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, doc_id, e, es, c: passages and documents, normalised, that share the passage's rarest window; they may share no more."""
    spark = evidence.sparkSession
    items = evidence.where("item_id IS NOT NULL").select("item_id", normalize_evidence(F.col("text")).alias("e")).where("e <> ''").distinct().withColumn("es", tight(F.col("e")))
    items = items.withColumn("spaced", F.length("es") < WIDTH).withColumn("anchor", F.substring("e", 1, WIDTH))
    # A passage by itself, as rows may share an item_id.
    items = stored(items.withColumn("item_id", F.struct("item_id", F.xxhash64("e").alias("h"))), "passages")
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), normalize_evidence(F.col("text")).alias("c"))
    docs = stored(docs.where("c <> ''"), "normalized")

    windows = stored(_windows(items), "windows")
    slot = F.pmod(F.col("key"), F.lit(1 << SKETCH)).alias("slot")
    long_ = items.where("NOT spaced").select("item_id")
    counted = windows.join(long_, "item_id", "left_semi").select("item_id", "at", "key", slot)
    rarest = counted.join(_counts(docs, counted), "slot", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "key")).alias("w"))
    rarest = rarest.where("w.n > 0").select("item_id", "w.key").unionByName(windows.join(items.where("spaced"), "item_id", "left_semi").select("item_id", "key"))
    anchored = stored(items.join(rarest, "item_id").withColumn("width", F.when(F.col("spaced"), F.length("anchor")).otherwise(WIDTH)), "anchored")
    shared = spark.sparkContext.broadcast(_marked(anchored, ["width", "spaced"], BITS))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, batch.num_rows, 256):
                plain = _bytes(batch.column(1).slice(low, 256).to_pylist())
                forms = {True: plain, False: _tight(*plain)}
                for (width, spaced), bits in shared.value.items():
                    keys, owner = window_keys(*forms[spaced], width)
                    there = np.flatnonzero(bits[keys & ((1 << BITS) - 1)])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[low + owner[there]], pa.int64()), pa.array(keys[there])], names=["doc_id", "key"])

    spots = docs.mapInArrow(anchors, "doc_id long, key long").distinct()
    near = spots.join(anchored.select("key", "item_id", "e", "es"), "key").drop("key").distinct()
    return near.join(docs, "doc_id")


def occurrences(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs (item_id, doc_id) of ``evidence`` (item_id, text) grounded in ``documents`` (doc_id, text); blank texts are in none."""
    near = likely_places(evidence, documents)
    loose = (F.length("es") >= WIDTH) & F.contains(tight(F.col("c")), F.col("es"))
    return near.where(F.contains("c", "e") | loose).select("item_id.item_id", "doc_id").distinct()

"""Substring dedup by word windows: anchors at the positions of a difference cover, then windows around shared anchors.

A window of W words that occurs twice, at positions i and j, holds for one of the shifts s < P a pair of cover
positions i + s and j + s, whatever i and j are: that is what a difference cover modulo P does. So only the runs of
W - P + 1 words that start at cover positions (anchors) are hashed and counted; a window that occurs twice holds
an anchor that does. Around the anchors that occur more than once whole windows are hashed and counted in turn, which
extends each anchor in all the ways that a match may lie around it. Long windows are told apart by a second, longer kind of
anchor first, whose cover is denser: it is counted only where a window holds a shared anchor of the first kind, costs a hash and no place,
and leaves out most windows that occur once.

Nothing is paired. What is looked for after counting are the windows around shared anchors that occur only *once*:
there is one row of each, however hot a passage is, and these alone go back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks_of, column_or, copied, crowded, dealt, discard, has_bits, hash_bits, hash_filter, materialize, passing, utf8_views
from factloom.llm.words import Substrings, mix, word_spans

#: Slots of the bitmap of shared anchors (16 MB). Beyond a quarter of them shared anchors are joined instead.
BITS = 27


def difference_cover(period: int) -> list[int]:
    """The first of the smallest sets of residues whose differences are all residues modulo ``period``."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
        size += 1


def cover_of(window: int) -> tuple[int, list[int]]:
    """Period and cover for a window: of the periods with the sparsest covers, the longest that leaves anchors of two fifths of it."""
    period = max(p for p in (1, 3, 7, 13, 21) if 5 * (window - p + 1) >= 2 * window)
    return period, difference_cover(period)


#: The period of the second kind of anchors, for windows whose first kind has a longer one.
LONGER = 7


class Block:
    """The words of some rows, end to end: their hashes, each one's place in its row, and the number of words of its row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.words, self.starts, self.ends, self.rows = word_spans(raw, offsets, lower=False)
        counts = np.diff(self.rows)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.words)) - self.rows[self.owner]
        self.count = counts[self.owner]

    def runs(self, starts: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
        """Hashes of the runs of ``width`` words that begin at the words ``starts``."""
        return Substrings(mix(self.words + np.uint64(seed))).hashed(starts, starts + width)

    def anchors(self, window: int, period: int, cover: list[int]) -> np.ndarray:
        """The words at cover positions at which an anchor fits; none in rows without a whole window."""
        chosen = np.zeros(period, dtype=bool)
        chosen[cover] = True
        return np.flatnonzero(chosen[self.place % period] & (self.place <= self.count - (window - period + 1)) & (self.count >= window))

    def around(self, anchors: np.ndarray, window: int, period: int) -> np.ndarray:
        """The words at which the windows begin that hold one of the anchors."""
        n = len(self.words) + 1
        first = anchors - np.minimum(self.place[anchors], period - 1)
        open_ = np.cumsum(np.bincount(first, minlength=n) - np.bincount(anchors + 1, minlength=n))[: n - 1]
        return np.flatnonzero((open_ > 0) & (self.place <= self.count - window))

    def covered(self, starts: np.ndarray, window: int) -> np.ndarray:
        """Which words the windows at ``starts`` cover."""
        n = len(self.words) + 1
        return np.cumsum(np.bincount(starts, minlength=n) - np.bincount(starts + window, minlength=n))[: n - 1] > 0


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Rows of bounded size together (a longer text alone), and their words."""
    raw, offsets = utf8_views(column_or(batch, "text"))
    for i, j in blocks_of(offsets):
        yield batch.slice(i, j - i), Block(raw, offsets[i : j + 1])


def _positions(column: pa.Array, block: Block) -> np.ndarray:
    """Positions in rows, as lists of a column, as words of the block."""
    lists = [np.array(column[i].as_py(), dtype=np.int64) + block.rows[i] for i in np.flatnonzero(column.is_valid())]
    return np.concatenate(lists) if lists else np.zeros(0, np.int64)


KEYS = ["ref"]


class Search:
    """The steps of the search in one table with doc_id, ``ref`` and ``text``."""

    def __init__(self, docs: DataFrame, window: int) -> None:
        self.docs, self.window = docs, window
        self.kinds = [cover_of(window)]
        if self.kinds[0][0] > LONGER:
            self.kinds.append((LONGER, difference_cover(LONGER)))
        #: The bitmaps of the kinds of anchors known so far; None for one whose places are a column of the documents.
        self.known, self.hot = [], None
        hot = crowded(docs.where("text <> ''"), KEYS)
        if hot.head(1):
            self.hot = hot

    def anchors(self, places: bool) -> DataFrame:
        """``h`` of all anchors of the next kind with ``n`` (equal ones of some rows counted together) or, with ``places``, ref and at.

        Those that lie in no window with a shared anchor of each kind known are left out.
        """
        window, (period, cover), first = self.window, self.kinds[len(self.known)], not self.known
        starts = self.starts()

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, block in _blocks(batch):
                    at = block.anchors(window, period, cover)
                    if not first:
                        at = at[block.covered(starts(rows, block), period)[at]]
                    keys = block.runs(at, window - period + 1)
                    if places:
                        own = [column_or(rows, c).take(pa.array(block.owner[at])) for c in KEYS]
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *own, pa.array(block.place[at].astype(np.int32))], names=["h", *KEYS, "at"])
                    else:
                        keys, n = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

        return self.docs.mapInArrow(found, "h long, ref long, at int" if places else "h long, n int")

    def joined(self, rows: DataFrame, lists: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``lists``, one row to a ref at most; refs with very many rows are dealt to several tasks."""
        if self.hot is None:
            return rows.join(lists, KEYS, "left")
        spread = dealt(rows, self.hot, KEYS, F.monotonically_increasing_id())
        return spread.join(copied(lists, self.hot, KEYS), [*KEYS, "_salt"], "left").drop("_salt")

    def mark(self, shared: DataFrame, most: int) -> None:
        """From now on the anchors of the next kind among the hashes ``shared`` are known: by a bitmap, or as a column of the documents."""
        spark = self.docs.sparkSession
        if shared.count() <= most:
            self.known.append(spark.sparkContext.broadcast(hash_bits(shared, BITS)))
            return
        column = f"shared{len(self.known)}"
        places = materialize(self.anchors(places=True), "anchors")
        hot = crowded(places, ["h"])
        kept = dealt(places, hot, ["h"], F.xxhash64(*KEYS, "at")).join(copied(shared, hot, ["h"]), ["h", "_salt"])
        self.docs = materialize(self.joined(self.docs, kept.groupBy(*KEYS).agg(F.collect_set("at").alias(column))), "shared")
        self.known.append(None)
        discard(places)

    def starts(self) -> object:
        """A function of rows and their block that gives the words at which windows begin that hold a shared anchor of each kind known."""
        window, known = self.window, list(zip(self.kinds, self.known))

        def of(rows: pa.RecordBatch, block: Block) -> np.ndarray:
            found = np.zeros(0, np.int64)
            for k, ((period, cover), bits) in enumerate(known):
                if bits is None:
                    at = _positions(column_or(rows, f"shared{k}"), block)
                else:
                    at = block.anchors(window, period, cover)
                    at = at if k == 0 else at[block.covered(found, period)[at]]
                    at = at[has_bits(bits.value, block.runs(at, window - period + 1), BITS)]
                around = block.around(at, window, period)
                found = around if k == 0 else np.intersect1d(found, around, assume_unique=True)
            return found

        return of


def without_repeats(docs: DataFrame, window: int = 35, id_column: str = "doc_id", text_column: str = "text", most_shared: int = 1 << (BITS - 2)) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of ``docs``: its text without words covered by a window that occurs elsewhere.

    A word is a run of characters other than white space (space, tab, LF, VT, FF, CR), kept as written; a window is ``window``
    consecutive words of one text. All occurrences of a repeated window go, in the same text, in others and in
    rows that repeat wholly; which windows repeat is judged on the input. ``kept_text`` has the words left, joined
    by one space.

    Null, empty and blank texts have no words and an empty kept_text; texts of fewer words than a window keep all. A null
    doc_id stays null, rows that share a doc_id are texts of their own, further columns are ignored, and an empty table gives
    an empty result. Windows are told apart by 96-bit hashes, texts by 64-bit hashes of doc_id and text.

    Up to ``most_shared`` anchors of a kind that occur more than once are broadcast as a bitmap of fixed size; more are joined.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    search = Search(named.withColumn("ref", F.xxhash64("doc_id", "text")), window)
    while len(search.known) < len(search.kinds):
        shared = materialize(search.anchors(places=False).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "shared")
        search.mark(shared, most_shared)
        discard(shared)
    starts = search.starts()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in _blocks(batch):
                at = starts(rows, block)
                keys = [pa.array(block.runs(at, window, 1).view(np.int64)), pa.array((block.runs(at, window, 2) >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                own = [column_or(rows, c).take(pa.array(block.owner[at])) for c in KEYS]
                yield pa.RecordBatch.from_arrays([*keys, *own, pa.array(block.place[at].astype(np.int32))], names=["k1", "k2", *KEYS, "at"])

    held = search.docs.mapInArrow(windows, "k1 long, k2 int, ref long, at int")
    once = held.groupBy("k1", "k2").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in (*KEYS, "at")]).where("n = 1")
    lone = materialize(once.groupBy(*KEYS).agg(F.collect_list("at").alias("lone")), "lone")
    # Texts with windows that only share an anchor meet the lists of these; most others stay where they are.
    refs = hash_filter(lone.select("ref"))
    met = search.joined(passing(search.docs, refs, F.col("ref")), lone)
    rest = passing(search.docs, refs, F.col("ref"), pass_=False).withColumn("lone", F.lit(None).cast("array<int>"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in _blocks(batch):
                at = np.setdiff1d(starts(rows, block), _positions(column_or(rows, "lone"), block), assume_unique=True)
                gone, kept = block.covered(at, window), []
                for i, text in enumerate(column_or(rows, "text").to_pylist()):
                    shown, out = (text or "").encode().split(), gone[block.rows[i] : block.rows[i + 1]]
                    kept.append(b" ".join([shown[k] for k in np.flatnonzero(~out)] if out.any() else shown).decode())
                removed = np.bincount(block.owner[gone], minlength=rows.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [column_or(rows, "doc_id"), pa.array(np.diff(block.rows)), pa.array(removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"]
                )

    return met.unionByName(rest).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")

"""Ranked lexical search with no random access (NRA) over impact-sorted lists.

Documents are dealt to shards of bounded size, each a run of rows of one task. A shard holds, for every term that a query
asks for, the list of its documents sorted by impact, the share that the term adds to a document's score. A query reads
its lists from the top, some entries at a time. What it has read of a document is the lower end of an interval for its score;
the upper end adds, for each list in which the document has not come up yet, the impact that list has come down to. When no
document outside can reach the k-th lower end, only the lists in which members are still open are read on, until
each of these intervals is a point: then membership, ties and scores are final. Shards leave their k best, and the best
of all are the result. A first shard of each task gives scores to beat to those after it.

Impacts are whole numbers made of corpus figures (documents, terms, documents of a term), which are counted first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import blocks_of, column_or, materialize, utf8_views
from factloom.llm.words import word_spans

#: Distinct pairs of a query and a term that are broadcast at a time; more queries take further passes.
PAIRS = 1 << 20
#: Postings after which a shard is searched.
SHARD = 1 << 22
#: Entries of a list that are read in the first step; each step reads twice as many.
STEP = 64

_INK = np.zeros(256, dtype=bool)
_INK[48:58] = _INK[65:91] = _INK[97:123] = _INK[128:] = True


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, hashes of the terms and n+1 offsets of rows in them, for rows of bounded size together."""
    raw, offsets = utf8_views(column)
    for i, j in blocks_of(offsets):
        words, _, _, at = word_spans(raw, offsets[i : j + 1], _INK)
        yield i, words, at


def document_weight(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a document's length adds to the divisor: 100 - 50 + (50 * n * documents) div terms."""
    if len(n) and 50 * int(n.max()) * documents >= 2**63:
        return np.array([50 + 50 * int(x) * documents // terms for x in n], dtype=np.int64)
    return 50 + 50 * n.astype(np.int64) * documents // max(terms, 1)


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Lists:
    """The impact-sorted lists of one shard: documents (numbers within the shard) and impacts, largest first."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, values: np.ndarray, size: int) -> None:
        order = np.lexsort((docs, -values, terms))
        self.docs, self.values, self.size = docs[order], values[order], size
        self.found, first = np.unique(terms[order], return_index=True)
        self.edges = np.append(first, len(order))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        k = int(np.searchsorted(self.found, term))
        if k == len(self.found) or self.found[k] != term:
            return None
        part = slice(self.edges[k], self.edges[k + 1])
        return self.docs[part], self.values[part]


def best_documents(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, beat: int = 0, read: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents and exact scores of the k best by NRA, with all that tie with the k-th; those below ``beat`` may be missing.

    ``read`` gets the number of entries read.
    """
    none = np.zeros(0, np.int64)
    if not lists:
        return none, none
    lower, seen = np.zeros(size, np.int64), np.zeros((len(lists), size), dtype=bool)
    at, front = np.zeros(len(lists), np.int64), np.array([v[0] for _, v in lists], dtype=np.int64)
    touched, step, entries = np.zeros(size, dtype=bool), STEP, 0

    def advance(which: np.ndarray) -> None:
        nonlocal entries
        for t in which:
            docs, values = lists[t]
            part = slice(at[t], at[t] + step)
            lower[docs[part]] += values[part]
            seen[t, docs[part]] = touched[docs[part]] = True
            entries += len(docs[part])
            at[t] = min(at[t] + step, len(docs))
            front[t] = values[at[t]] if at[t] < len(docs) else 0

    while True:
        advance(np.flatnonzero(front > 0))
        step *= 2
        come = np.flatnonzero(touched)
        low = lower[come]
        kth = int(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else 0
        cut = max(kth, beat)
        if front.any() and int(front.sum()) >= cut:
            continue
        # No document that has not come up reaches the cut any more.
        high = low + front @ ~seen[:, come]
        members = come[high >= cut]
        if len(members) <= k or not front.any():
            break
    while True:
        still = np.flatnonzero((front > 0) & ~seen[:, members].all(axis=1))
        if not len(still):
            break
        advance(still)
        step *= 2
    if read is not None:
        read.append(entries)
    members = members[lower[members] > 0]
    return members, lower[members]


def corpus_figures(docs: DataFrame, wanted: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L and the df of each wanted term (a table of hashes ``h``, of bounded size)."""
    asked = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["h"] for r in wanted.toLocalIterator()], dtype=np.int64).view(np.uint64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = asked.value
        df, n_docs, n_terms = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for _, words, at in _terms(column_or(batch, "text")):
                sizes = np.diff(at)
                n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + len(words)
                number, owner = _known(words, np.repeat(np.arange(len(sizes)), sizes), terms)
                df += np.bincount(np.unique(owner * max(len(terms), 1) + number) % max(len(terms), 1), minlength=len(df)) if len(number) else 0
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["k", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2]), pa.array([n_docs, n_terms])], names=["k", "n"])

    sums = {r["k"]: r["n"] for r in docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return sums.pop(-1, 0), sums.pop(-2, 0), {int(asked.value[k].astype(np.int64)): n for k, n in sums.items()}


def _known(words: np.ndarray, owner: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (places among the sorted ``terms``) and owners of the words that are terms."""
    if not len(terms) or not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    there = terms[at] == words
    return at[there].astype(np.int64), owner[there]


def query_terms(items: DataFrame) -> DataFrame:
    """item_id and h, the hashes of an item's distinct terms."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words, at in _terms(column_or(batch, "text")):
                ids = column_or(batch, "item_id").slice(i, len(at) - 1).take(pa.array(np.repeat(np.arange(len(at) - 1), np.diff(at))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(words.view(np.int64))], names=["item_id", "h"])

    return items.mapInArrow(split, items.select("item_id").schema.add("h", "long")).distinct()


def _search(docs: DataFrame, pairs: pd.DataFrame, weights: dict[int, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """number, doc_id, score: the k best of each shard for the queries (numbered) of ``pairs`` (number, h)."""
    terms = np.sort(np.array([h for h, w in weights.items() if w > 0], dtype=np.int64).view(np.uint64))
    weight = np.array([weights[int(h)] for h in terms.view(np.int64)], dtype=np.int64)
    places = {int(h): i for i, h in enumerate(terms.view(np.int64))}
    asked: dict[int, list[int]] = {}
    for number, h in zip(pairs.number.tolist(), pairs.h.tolist(), strict=True):
        if h in places:
            asked.setdefault(number, []).append(places[h])
    shared = docs.sparkSession.sparkContext.broadcast((terms, weight, asked))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, asked = shared.value
        beat, parts, held, size = dict.fromkeys(asked, 0), [], 0, 0

        def shard() -> pa.RecordBatch:
            ids = pa.concat_arrays([p[0] for p in parts]).cast(pa.int64())
            term, doc, tf, lengths = (np.concatenate([p[x] for p in parts]) for x in (1, 2, 3, 4))
            m = document_weight(lengths, n_docs, n_terms)
            values = impacts(weight[term], tf, m[doc])
            there = values > 0
            lists = Lists(term[there], doc[there], values[there], size)
            out = []
            for number, own in asked.items():
                found, scores = best_documents([x for x in map(lists.of, own) if x], size, k, beat[number])
                if len(found) > k:  # all that tie with the last: the least ids
                    names = np.array([(1 << 63) - 1 if x is None else x for x in ids.take(pa.array(found)).to_pylist()])
                    kept = np.lexsort((names, -scores))[:k]
                    found, scores = found[kept], scores[kept]
                if len(found) == k:
                    beat[number] = max(beat[number], int(scores.min()))
                out.append((np.full(len(found), number), found, scores))
            number, found, scores = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(number), ids.take(pa.array(found)), pa.array(scores)], names=["number", "doc_id", "score"])

        for batch in batches:
            ids = column_or(batch, "doc_id")
            for i, words, at in _terms(column_or(batch, "text")):
                sizes = np.diff(at)
                number, owner = _known(words, np.repeat(np.arange(len(sizes)), sizes), terms)
                keys, tf = np.unique(owner * max(len(terms), 1) + number, return_counts=True)
                own, rows = np.divmod(keys, max(len(terms), 1)), len(sizes)
                with_terms = np.zeros(rows, dtype=bool)
                with_terms[own[0]] = True
                to = np.cumsum(with_terms) - 1 + size
                parts.append((ids.slice(i, rows).filter(pa.array(with_terms)), own[1], to[own[0]], tf.astype(np.int64), sizes[with_terms]))
                size, held = size + int(with_terms.sum()), held + len(keys)
                if held >= SHARD:
                    yield shard()
                    parts, held, size = [], 0, 0
        if size:
            yield shard()

    return docs.mapInArrow(search, "number long, doc_id long, score long")


def ranked_documents(items: DataFrame, docs: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents that score highest for each item, of equal scores the least doc_id (null last).

    ``items`` has item_id and text, ``docs`` doc_id and text. Terms are the runs of ASCII letters, digits and of any characters
    beyond ASCII, with A-Z lowered. Of N documents with a term and L terms in all, a document with n terms, tf of them equal to
    a term that df documents hold, gets for that term w * ((10 ** 9 * tf) div (1000 * tf + 20 * m)), where w is
    floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m is 100 - 50 + ((50 * n * N) div L). An item's terms count once each.

    Only scores above 0 count, so items without terms, with null or empty text or whose terms no document holds give no rows.
    Null and empty documents are in no result, nor are items without an id. Rows of ``docs`` that share a doc_id are documents of their own; rows of
    ``items`` that share an item_id are one item with the terms of all. Further columns are ignored, empty tables
    give an empty result.

    Queries are broadcast in blocks of at most ``PAIRS`` terms (an item with more stands alone), each of which reads ``docs`` twice.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = materialize(query_terms(items.where("item_id IS NOT NULL").select("item_id", "text")), "queries")
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("n"))
    n_blocks = -(-pairs.count() // PAIRS)
    # Blocks of about half of what one may hold, so that their hash deals none more.
    block: Column = F.pmod(F.xxhash64("item_id"), F.lit(2 * n_blocks if n_blocks > 1 else 1))
    numbered = sizes.select("item_id", block.alias("block")).withColumn("number", F.row_number().over(Window.partitionBy("block").orderBy("item_id")).cast("long"))
    numbered = materialize(numbered, "items")
    results = None
    for r in numbered.select("block").distinct().orderBy("block").collect():
        own = numbered.where(F.col("block") == r["block"]).drop("block")
        asked = pairs.join(own, "item_id")
        n_docs, n_terms, df = corpus_figures(docs, asked.select("h").distinct())
        weights = {h: term_weight(n_docs, n) for h, n in df.items()}
        found = _search(docs, asked.select("number", "h").toPandas(), weights, n_docs, n_terms, k)
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.join(own, "number").select("item_id", "rank", "doc_id", "score")
        results = best if results is None else results.unionByName(best)
    if results is None:
        return numbered.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return results

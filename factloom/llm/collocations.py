"""Phrase collocations: count streams in prefix and in suffix order, read in lockstep.

Phrases are counted level by level: a phrase of m words is counted only where both phrases of m - 1 words in it may be
frequent, which a bitmap of fixed size tells without missing any. Phrases below the least count are in no result
and in no part of one, so all that follows works on frequent phrases alone.

The counts of all lengths form one stream. In prefix order (by first word, then second ..., shorter first) a phrase comes
right behind its own beginnings and ahead of its extensions to the right: one pass that keeps the open beginnings gives
each phrase their counts and the largest count of its extensions. The stream is then put into suffix order (by last
word, then the one before ...), and the same pass gives the counts of its endings and its extensions to the left. No
table of phrases is hashed or held, and nothing is joined but adjacent rows of a sorted stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import blocks_of, column_or, copied, crowded, dealt, discard, has_bits, hash_bits, materialize, utf8_views
from factloom.llm.words import mix, word_spans

BITS = 27
#: Bytes of text whose phrases are counted together before they leave a task, and phrases written at a time.
BLOCK, SLICE = 1 << 21, 1 << 15
#: Parts of a language among which its phrases are ranked before the whole language is.
PARTS = 64

_INK = np.ones(256, dtype=bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
_INK[[ord(c) for c in ".,;:!?"]] = False
_END = np.zeros(256, dtype=bool)
_END[[10, 11, 12, 13]] = True
_END[[ord(c) for c in ".,;:!?"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The words of some rows: hashes, spans in the lowered bytes, and for each the number of words before it in its piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.words, self.starts, self.ends, self.rows = word_spans(raw, offsets, _INK)
        self.data = _LOWER[raw[int(offsets[0]) : int(offsets[-1])]]
        self.owner = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))
        stops = np.concatenate(([0], np.cumsum(_END[self.data])))[self.starts] if len(self.words) else self.starts
        first = np.ones(len(self.words), dtype=bool)
        first[1:] = (stops[1:] != stops[:-1]) | (self.owner[1:] != self.owner[:-1])
        at = np.arange(len(self.words))
        self.before = at - np.maximum.accumulate(np.where(first, at, 0)) if len(at) else at

    def joined(self, last: np.ndarray, length: int) -> pa.Array:
        """The phrases of ``length`` words that end with the words ``last``, joined by one space."""
        sizes = self.ends - self.starts
        total = sum(sizes[last - k] for k in range(length)) + length - 1
        edges = np.concatenate(([0], np.cumsum(total)))
        out = np.full(int(edges[-1]), 32, dtype=np.uint8)
        at = edges[:-1].copy()
        for k in range(length - 1, -1, -1):
            own = sizes[last - k]
            within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            out[np.repeat(at, own) + within] = self.data[np.repeat(self.starts[last - k], own) + within]
            at += own + 1
        return pa.LargeStringArray.from_buffers(len(last), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out))


def phrase_keys(words: np.ndarray, last: np.ndarray, length: int, group: np.ndarray) -> np.ndarray:
    """Hashes of phrases within their group; they only serve the bitmap, which may let others pass."""
    out = group
    for k in range(length - 1, -1, -1):
        out = mix(out * _STEP + words[last - k])
    return out


def _group_keys(groups: list[str]) -> np.ndarray:
    """A hash of each group's name."""
    raw = "".join(groups).encode()
    offsets = np.concatenate(([0], np.cumsum([len(g.encode()) for g in groups]))).astype(np.int64)
    out = np.zeros(len(groups), dtype=np.uint64)
    for i in range(len(groups)):
        for b in raw[offsets[i] : offsets[i + 1]]:
            out[i] = mix(out[i : i + 1] * _STEP + np.uint64(b + 1))[0]
    return out


def counted(docs: DataFrame, length: int, least: int, bits: object = None) -> DataFrame:
    """lang, phrase and f of the phrases of ``length`` words; with ``bits``, a bitmap of the frequent phrases of one word less, of those that may be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_views(column_or(batch, "text"))
            names = column_or(batch, "lang").dictionary_encode()
            langs, own = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keys = _group_keys(langs)
            for i, j in blocks_of(offsets, BLOCK):
                pieces = Pieces(raw, offsets[i : j + 1])
                last = np.flatnonzero(pieces.before >= length - 1)
                group = own[i:j][pieces.owner]
                if bits is not None:
                    for shift in (1, 0):  # its first words, then its last
                        last = last[has_bits(bits.value, phrase_keys(pieces.words, last - shift, length - 1, keys[group[last]]), BITS)]
                if not len(last):
                    continue
                # Equal numbers are equal phrases: each step numbers the distinct pairs of what there is and one more word.
                ids = np.unique(pieces.words, return_inverse=True)[1].astype(np.int64)
                number = group[last]
                for k in range(length - 1, -1, -1):
                    number = np.unique(number * (int(ids.max()) + 1) + ids[last - k], return_inverse=True)[1].astype(np.int64)
                _, at, n = np.unique(number, return_index=True, return_counts=True)
                last, group = last[at], group[last[at]]
                for low in range(0, len(last), SLICE):
                    some = slice(low, low + SLICE)
                    phrases = pieces.joined(last[some], length).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(group[some])), phrases, pa.array(n[some])], names=["lang", "phrase", "f"])

    rows = docs.mapInArrow(count, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= (least if length > 1 else 1))


def _marks(frequent: DataFrame, length: int) -> DataFrame:
    """The hashes by which the bitmap knows the phrases."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_views(column_or(batch, "phrase"))
            words, _, _, rows = word_spans(raw, offsets, _INK)
            names = column_or(batch, "lang").dictionary_encode()
            group = _group_keys(names.dictionary.to_pylist())[names.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(phrase_keys(words, rows[1:] - 1, length, group).view(np.int64))], names=["h"])

    return frequent.mapInArrow(hashed, "h long")


_STREAM = "lang string, words array<string>, f long, heads array<long>, tails array<long>, longer long"


def lockstep(batches: Iterator[pa.RecordBatch], side: str) -> Iterator[pa.RecordBatch]:
    """One pass over phrases sorted by ``key`` (the words, from the side that is looked at), shorter first.

    The beginnings of a phrase stand open when it comes. ``side`` gets their counts, shortest first, and ``longer`` the
    largest count of its extensions by one word, if that is above what it had. Rows marked ``again`` only serve as beginnings.
    """
    open_: list[list] = []  # lang, key, f, row, longest extension
    columns = ["lang", "key", "words", "f", "heads", "tails", "longer", "again"]
    out: list[dict] = []

    def close(depth: int) -> None:
        while len(open_) > depth:
            lang, _, f, row, most = open_.pop()
            if open_:
                open_[-1][4] = max(open_[-1][4], f)
            if not row["again"]:
                out.append({"lang": lang, "words": row["words"], "f": f, "heads": row["heads"], "tails": row["tails"], "longer": max(row["longer"], most)})

    types = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64())), ("longer", pa.int64())])
    for batch in batches:
        for lang, key, words, f, heads, tails, longer, again in zip(*(column_or(batch, c).to_pylist() for c in columns), strict=True):
            depth = 0
            while depth < len(open_) and open_[depth][0] == lang and depth < len(key) - 1 and open_[depth][1][-1] == key[depth]:
                depth += 1
            close(depth)
            row = {"words": words, "heads": heads, "tails": tails, "longer": longer, "again": again}
            row[side] = [x[2] for x in open_]
            open_.append([lang, key, f, row, 0])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)
            out.clear()
    close(0)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=types)


def _read(stream: DataFrame, key: Column, side: str) -> DataFrame:
    """The stream in the order of ``key``, passed by ``lockstep``.

    It is dealt to tasks by ranges of first words, so that beginnings and extensions stand together. The extensions of a
    very common word are dealt to several ranges by their second word, and each gets a copy of the word's own row.
    """
    rows = stream.withColumn("key", key).withColumn("first", F.get("key", F.lit(0)))
    hot, own = crowded(rows, ["lang", "first"]), F.size("key") == 1
    more = dealt(rows.where(~own), hot, ["lang", "first"], F.xxhash64(F.get("key", F.lit(1))))
    both = copied(rows.where(own), hot, ["lang", "first"]).unionByName(more).withColumn("again", (F.size("key") == 1) & (F.col("_salt") > 0))
    ordered = both.repartitionByRange("lang", "first", "_salt").sortWithinPartitions("lang", "first", "_salt", "key")
    columns = ["lang", "key", "words", "f", "heads", "tails", "longer", "again"]
    return ordered.select(*columns).mapInArrow(lambda batches: lockstep(batches, side), _STREAM)


def phrase_counts(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """lang and n, the words of each language; and the stream of frequent phrases with the counts of their parts and extensions."""
    levels, bits = [], None
    ones = materialize(counted(docs, 1, least), "words")
    totals = ones.groupBy("lang").agg(F.sum("f").alias("n"))
    levels.append(ones.where(F.col("f") >= least))
    for length in range(2, longest + 1):
        bits = docs.sparkSession.sparkContext.broadcast(hash_bits(_marks(levels[-1], length - 1), BITS))
        levels.append(materialize(counted(docs, length, least, bits), f"phrases{length}"))
    stream = levels[0]
    for level in levels[1:]:
        stream = stream.unionByName(level)
    none = F.array().cast("array<long>")
    stream = stream.select("lang", F.split("phrase", " ").alias("words"), "f", none.alias("heads"), none.alias("tails"), F.lit(0).cast("long").alias("longer"))
    once = materialize(_read(stream, F.col("words"), "heads"), "prefixes")
    twice = materialize(_read(once, F.reverse("words"), "tails"), "suffixes")
    discard(once, *levels[1:])
    return totals, twice


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, shown: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``shown`` phrases of 2 to ``longest`` words that score highest.

    ``docs`` has lang (null: ``und``) and text (null: empty). Texts end A-Z lowered, in pieces between any of ``.,;:!?`` and
    line breaks (LF, VT, FF, CR), of which words are the runs other than spaces and tabs. A phrase's count is that of all
    its places within pieces, overlaps included; phrases below ``least`` count as none. n is the number of a language's words.

    A phrase cut after its first words has a, l and r, its own count and those of both parts, and the score
    floor(1000000 * a * a / (l * r)), in whole numbers of any size; its lowest-scoring cut counts, of equal ones the first.
    Phrases that stand inside a longer one with at least ``covered`` hundredths of their count are left out, whether that
    one stays or not. Order: score, then a, largest first, then the phrase by its UTF-8 bytes.

    Further columns are ignored and rows that repeat count each; a language without such phrases, as an empty table, gives no
    rows. Counts may reach 10 ** 15.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have at least two words and a count of at least 1")
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text"))
    totals, stream = phrase_counts(slim, longest, least)
    size = F.size("words")
    rows = stream.where((size > 1) & (F.lit(100) * F.col("longer") < F.lit(covered) * F.col("f")))
    cuts = """array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
        'score', CAST((1000000 * a * a) div (CAST(heads[k - 1] AS DECIMAL(15,0)) * CAST(tails[size(words) - k - 1] AS DECIMAL(15,0))) AS LONG),
        'k', k, 'l', heads[k - 1], 'r', tails[size(words) - k - 1])))"""
    best = rows.withColumn("a", F.col("f").cast("decimal(15,0)")).withColumn("b", F.expr(cuts))
    phrases = best.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that no task ranks all of its phrases.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    few = phrases.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= shown)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= shown)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Best-fit packing of documents into sequences of a fixed number of tokens.

Tokenising gives pieces; only a histogram of their lengths (at most ``limit`` rows) reaches the driver.
There gaps are filled by exact complements: a sequence is opened by the longest length left, and single
lengths, pairs and triples that fill its gap exactly are taken as often as their counts allow. What finds no
complement is packed by best fit. The plan, runs of ranks within a length, is as small as the histogram; the
executors number the pieces of each length and look their places up in it.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import column_or, materialize, texts_of

#: Pieces of one length that one task numbers.
ALIKE = 4_000
#: Stands between words that are encoded together, and after a document's words for its last id.
MARK = "\x01"
#: Texts with these go through the tokenizer whole: white space to one side only, special tokens, MARK.
_APART = (MARK, "\x1c", "\x1d", "\x1e", "\x1f", "<|")


def word_by_word(path: str) -> bool:
    """Whether a tokenizer file encodes white-space delimited words one by one, whatever stands around them.

    So it does if it composes, evens out white space and lowers, then drops white space and marks the ends of words;
    of other files texts are encoded whole.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [(x.get("type"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in cuts]
    return (
        spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"]
        and kinds == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]
    )


class WordIds:
    """The ids of white-space delimited words, each encoded once, if the tokenizer never joins two words; else of whole texts."""

    def __init__(self, path: str, last_id: int, most: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.last_id, self.most = last_id, most
        self.wordwise = word_by_word(path)
        if not self.wordwise:
            return
        # For words of letters only, lowered and composed: no more to normalise, each is one unit.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        self.clear()

    def clear(self) -> None:
        self.index = {MARK: 0}
        self.flat, self.lengths = np.array([self.last_id], np.uint32), np.ones(1, np.int64)
        self.starts = np.zeros(1, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        at = len(self.index)
        self.index.update(zip(words, range(at, at + len(words)), strict=True))
        self.flat, self.lengths = np.concatenate([self.flat, ids]), np.concatenate([self.lengths, lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _coded(self, tokenizer: object, words: list[str], between: str, size: int) -> np.ndarray:
        groups = [between.join(words[k : k + size]) for k in range(0, len(words), size)]
        found = [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        if between != " ":
            found = [y for x in found for y in (x, [self.mark])]
        return np.concatenate(found).astype(np.uint32)

    def learn(self, words: set[str]) -> None:
        """Words of letters in one go; a sign after such a word is a unit of its own; all others one by one."""
        letters, signed, others = [], [], []
        for word in words:
            if word.isalpha():
                letters.append(word)
            elif word[-1] in ",.!?;:" and word[:-1].isalpha():
                signed.append(word)
            else:
                others.append(word)
        signs = {word[-1] for word in signed}
        others += [x for x in signs if x not in self.index and x not in words]
        stems = {word[:-1] for word in signed}.difference(self.index, letters)
        letters += stems
        if letters:
            ids = self._coded(self.letters, letters, " ", 200)
            ends = np.flatnonzero(self.ends[ids])
            self._add(letters, ids, np.diff(ends, prepend=-1))
        if others:
            ids = self._coded(self.tokenizer, others, f" {MARK} ", 20)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(others):  # never seen: a word holds the mark's id
                ids = np.concatenate([np.array([*self.whole(x), self.mark], np.uint32) for x in others])
                marks = np.cumsum([len(self.whole(x)) + 1 for x in others]) - 1
            self._add(others, np.delete(ids, marks), np.diff(marks, prepend=-1) - 1)
        if signed:
            both = np.array([(self.index[x[:-1]], self.index[x[-1]]) for x in signed]).ravel()
            ids, lengths = self._gather(both)
            self._add(signed, ids, lengths.reshape(-1, 2).sum(axis=1))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.lengths[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(sizes.sum())], sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, and last_id after them."""
        if not self.wordwise:
            return [np.array([*x.ids, self.last_id], np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.index) > self.most:
            self.clear()
        words, apart, counts = [], {}, []
        for k, text in enumerate(texts):
            low = text.replace("Σ", "σ").lower()  # lower() alone writes a last sigma another way
            plain = text.isascii() or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low))
            before = len(words)
            if not plain or any(x in text for x in _APART):
                apart[k] = np.array([*self.whole(text), self.last_id], np.uint32)
            else:
                words += low.split()
                words.append(MARK)
            counts.append(len(words) - before)
        if missing := set(words).difference(self.index):
            self.learn(missing)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        ids, sizes = self._gather(at)
        cuts = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *counts])]
        return [apart[k] if k in apart else ids[cuts[k] : cuts[k + 1]] for k in range(len(texts))]


_encoders: dict[tuple[str, int], WordIds] = {}


def tokenized_pieces(docs: DataFrame, tokenizer: str, limit: int = 4096, last_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32 (and ids): every document's ids, cut only where over ``limit``.

    A column ``window`` (int) of ``docs`` goes with its pieces.
    """
    own = [c for c in docs.columns if c == "window"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, last_id) not in _encoders:
            _encoders[tokenizer, last_id] = WordIds(tokenizer, last_id)
        encoder = _encoders[tokenizer, last_id]
        for batch in batches:
            doc_ids, column = column_or(batch, "doc_id").cast(pa.int64()), column_or(batch, "text")
            for i, texts in texts_of(column, 1 << 19):
                rows, pieces, starts, lengths, sums, kept = [], [], [], [], [], []
                for k, ids in enumerate(encoder.encode(texts)):
                    for p, start in enumerate(range(0, len(ids), limit)):
                        part = ids[start : start + limit]
                        rows.append(i + k)
                        pieces.append(p)
                        starts.append(start)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.astype("<u4").tobytes()))
                        if with_ids:
                            kept.append(part)
                columns = [doc_ids.take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    flat = np.concatenate(kept).astype(np.int32) if kept else np.zeros(0, np.int32)
                    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                    columns, names = [*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*names, "ids"]
                for c in own:
                    columns, names = [*columns, column_or(batch, c).take(pa.array(rows, pa.int64()))], [*names, c]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", window int" * len(own)
    return docs.select("doc_id", "text", *own).mapInArrow(cut, schema)


@dataclass
class PackingPlan:
    """Runs of ranks of one length; run r gives rank first[r] + n the sequence base + n // each and its offset."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


def _exact(left: np.ndarray, gap: int, sums: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three lengths that are left and fill ``gap`` exactly; sums: which two lengths left add up to."""
    if gap < len(left) and left[gap]:
        return (gap,)

    def two(rest: int, spared: int = 0) -> tuple[int, int] | None:
        high = np.arange((rest + 1) // 2, rest)
        fit = high[(left[high] > (high == spared)) & (left[rest - high] > (rest - high == spared))]
        for b in fit[::-1]:
            if b != rest - b or left[b] > 1 + (b == spared):
                return int(b), int(rest - b)
        return None

    if gap > 1 and sums[gap] and (pair := two(gap)):
        return pair
    if gap > 2:
        third = np.arange(1, gap - 1)
        for a in third[(left[third] > 0) & sums[gap - third]][::-1]:
            if pair := two(gap - int(a), int(a)):
                return (int(a), *pair)
    return None


def _sums(left: np.ndarray) -> np.ndarray:
    there = (left > 0).astype(float)
    size = 2 * len(left)
    return np.fft.irfft(np.fft.rfft(there, size) ** 2, size)[: len(left)] > 0.5


def plan_packing(counts: dict[int, int], limit: int) -> PackingPlan:
    """Packs counts[length] pieces of each length; its work depends on the number of lengths, not of pieces."""
    left = np.zeros(limit + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    used, runs, base = np.zeros(limit + 1, dtype=np.int64), [], 0

    def take(lengths: list[int]) -> None:
        nonlocal base
        each = Counter(lengths)
        times = min(int(left[x]) // n for x, n in each.items())
        offset = 0
        for x, n in each.items():
            runs.append((x, int(used[x]), n, base, offset))
            used[x] += n * times
            left[x] -= n * times
            offset += n * x
        base += times

    if left[limit]:
        take([limit])
    sums = _sums(left)
    for opener in range(limit - 1, 0, -1):
        while left[opener]:
            left[opener] -= 1
            fill = _exact(left, limit - opener, sums)
            left[opener] += 1
            if fill is None:
                break
            take([opener, *fill])
            if any(not left[x] for x in (opener, *fill)):
                sums = _sums(left)
    for opener in range(limit - 1, 0, -1):
        while left[opener]:
            chosen, gap = [opener], limit - opener
            spare = left.copy()
            spare[opener] -= 1
            while gap and (fits := np.flatnonzero(spare[1 : gap + 1])).size:
                best = int(fits[-1]) + 1
                n = int(min(spare[best], gap // best))
                chosen += [best] * n
                spare[best] -= n
                gap -= best * n
            take(chosen)
    columns = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5).T
    return PackingPlan(*columns, sequences=base)


def placed(pieces: DataFrame, limit: int = 4096) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset; it is read twice.

    Pieces of one ``window`` (if there is such a column, of few values) share sequences only with each other, and the
    sequences of an earlier window come first. ``spread`` (a long, if there is such a column) deals pieces of equal
    length to tasks, else a hash of the piece does.
    """
    extra = {"window": F.lit(0), "spread": F.xxhash64("doc_id", "start", "ids_crc32")}
    names = [c for c in pieces.columns if c not in extra]
    held = pieces.select(*names, *[(F.col(c) if c in pieces.columns else x).alias(c) for c, x in extra.items()])
    counts: dict[int, dict[int, int]] = {}
    for r in held.groupBy("window", "length").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["window"], {})[r["length"]] = r["n"]
    plans, first = {}, 0
    for window in sorted(counts):
        plans[window] = plan_packing(counts[window], limit)
        plans[window].base += first
        first += plans[window].sequences
    # Only a length of very many pieces needs more than one task.
    salts = max([1, *(-(-n // ALIKE) for by in counts.values() for n in by.values())])
    salted = held.withColumn("salt", F.pmod("spread", F.lit(salts)).cast("int"))
    before = Window.partitionBy("window", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("window", "length", "salt").agg(F.count("*").alias("n"))
    offsets = offsets.select("window", "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("window", "length", "salt").orderBy("doc_id", "start", "spread")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["window", "length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead"))
    keys = {w: p.length * (1 << 44) + p.first for w, p in plans.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, window = (column_or(batch, c).to_numpy(zero_copy_only=False) for c in ("length", "rank", "window"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for w in np.unique(window):
                at, plan = np.flatnonzero(window == w), plans[int(w)]
                r = np.searchsorted(keys[int(w)], length[at] * (1 << 44) + rank[at], side="right") - 1
                n = rank[at] - plan.first[r]
                sequence[at], offset[at] = plan.base[r] + n // plan.each[r], plan.offset[r] + n % plan.each[r] * length[at]
            yield pa.RecordBatch.from_pydict({x: column_or(batch, x) for x in names} | {"sequence_id": sequence, "offset": offset})

    fields = ", ".join(f"{c} {t}" for c, t in pieces.dtypes if c in names)
    return ranked.select(*names, "window", "rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 4096, last_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text), placed in sequences of ``limit`` ids.

    Columns: doc_id, piece, start, length, ids_crc32 (and ids, if asked for), sequence_id, offset. A sequence
    is gapless from offset 0. A null or empty text is the piece of ``last_id`` alone. Repeated rows and repeated
    or null doc_ids are packed row by row, and very many of one length are dealt to several tasks. With a column
    ``window`` (int, of few values) sequences hold pieces of one window only and follow the windows' order. Further
    columns are ignored; an empty table gives an empty result.
    """
    pieces = tokenized_pieces(docs, tokenizer, limit, last_id, with_ids)
    pieces = pieces.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))  # stored, so it is read alike twice
    return placed(materialize(pieces, "pieces"), limit)


def windows_of_files(docs: DataFrame, windows: int) -> DataFrame:
    """``docs``, read from files in whose numbers their order lies, with ``window``: which of so many runs of files a row is in.

    Rows that come from no file are all in window 0.
    """
    try:
        parts = docs.withColumn("window", F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).try_cast("int"))
    except AnalysisException:
        return docs.withColumn("window", F.lit(0))
    last = parts.agg(F.max("window")).first()[0] or 0
    return parts.withColumn("window", F.floor(F.coalesce("window", F.lit(0)) * windows / (last + 1)).cast("int"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from pieces packed with their ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))

"""Language identification with a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes, its byte 2- and 3-grams, and itself where it stands in the
lexicon of words seen more than once in training. Weights and transitions are learned together on
sequences in which stretches of documents of different languages follow each other, so the chain learns when
text switches. Forward-backward gives every word its label probabilities; a text's are their mean.

Long sequences are cut into stretches that are worked on side by side: a first pass multiplies each stretch's
transfer matrices, which gives the exact messages at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import blocks_of, column_or, discard, materialize, texts_of
from factloom.llm.words import Substrings, mix, spans

BITS = 18
#: Documents of each language that a model is fitted on: those with the least hashes of their ids.
SAMPLE = 150
#: Stretches of these documents, of each language, that reach the driver.
STRETCHES = 4000
STRETCH = 256
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.3, 1e-5
UNKNOWN = "und"
#: How many standard errors are added to a text's mean evidence: few words prove little against a language.
DOUBT = 1.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Model:
    labels: list[str]
    emit: np.ndarray
    move: np.ndarray
    lexicon: np.ndarray
    #: For each label the median, over the stretches learned, of the mean points of their words' best labels.
    usual: np.ndarray | None = None
    #: For each label the standard deviation of its words' points within a stretch, relative to ``usual``.
    spread: np.ndarray | None = None


def _text_buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    coded = [x.lower().encode("utf-8", "replace") for x in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in coded]))).astype(np.int64)


def word_features(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray | None]], np.ndarray, np.ndarray]:
    """Feature slots of all words, the words' hashes, and the texts' n+1 offsets in the words.

    Slots come as arrays with one for each word, or (for n-grams) flat with each word's first.
    """
    data, rows = _text_buffer(texts)
    if not len(data):
        return [], np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    starts, ends, at = spans(data, rows, _LETTER[data])
    parts = Substrings(data.astype(np.uint64) + np.uint64(1))
    shift = np.uint64(64 - BITS)
    found: list[tuple[np.ndarray, np.ndarray | None]] = []

    def slots(hashes: np.ndarray, kind: int) -> np.ndarray:
        return (mix(hashes + np.uint64(kind)) >> shift).astype(np.int32)

    for n in (1, 2, 3, 4):
        found.append((slots(parts.hashed(starts, np.minimum(starts + n, ends)), n), None))
        found.append((slots(parts.hashed(np.maximum(ends - n, starts), ends), 10 + n), None))
    for n in (2, 3):
        count = np.maximum(ends - starts - n + 1, 1)
        first = np.cumsum(count) - count
        begin = np.repeat(starts - first, count) + np.arange(count.sum())
        end = np.minimum(begin + n, np.repeat(ends, count))
        found.append((slots(parts.hashed(begin, end), 20 + n), first))
    return found, parts.hashed(starts, ends), at


def emissions(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
    """A score for each word and label, the texts' offsets, and the slots used."""
    found, words, at = word_features(texts)
    scores = np.zeros((len(words), len(model.labels)), dtype=np.float32)
    if len(words):
        k = np.searchsorted(model.lexicon, words)
        known = np.append(model.lexicon, 0)[k] == words
        found.append((np.where(known, (1 << BITS) + k, (1 << BITS) + len(model.lexicon)).astype(np.int32), None))
        for slots, first in found:
            part = model.emit[slots]
            scores += part if first is None else np.add.reduceat(part, first, axis=0)
    return scores, at, found


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of each stretch and the text it belongs to, in order."""
    sizes = np.diff(at)
    count = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[:-1][owner] + number * STRETCH
    return begin, np.minimum(STRETCH, at[1:][owner] - begin), owner


def forward_backward(scores: np.ndarray, move: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's label probabilities, and what the expected transitions need: before, the words' factors, after."""
    n, size = scores.shape
    hot = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    step = np.exp(move - move.max())
    begin, length, owner = _stretches(at)
    order = np.argsort(-length, kind="stable")
    start, long = begin[order], length[order]
    alive = np.searchsorted(-long, -np.arange(1, STRETCH + 1), side="right")
    whole = np.tile(np.eye(size), (len(order), 1, 1))
    for t in range(int(long[0]) if len(long) else 0):
        m = alive[t]
        x = (whole[:m] @ step) * hot[start[:m] + t][:, None, :]
        whole[:m] = x / x.sum(axis=(1, 2), keepdims=True)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    enter, leave = np.empty((len(order), size)), np.empty((len(order), size))
    for s in range(len(owner)):
        if s == 0 or owner[s] != owner[s - 1]:
            a = np.full(size, 1 / size)
        enter[place[s]] = a
        a = a @ whole[place[s]]
        a /= a.sum()
    for s in range(len(owner) - 1, -1, -1):
        if s == len(owner) - 1 or owner[s] != owner[s + 1]:
            b = np.full(size, 1 / size)
        leave[place[s]] = b
        b = whole[place[s]] @ b
        b /= b.sum()
    before, ahead, after = np.empty((n, size)), np.empty((n, size)), np.empty((n, size))
    a = enter
    for t in range(int(long[0]) if len(long) else 0):
        m, k = alive[t], start[: alive[t]] + t
        before[k] = a[:m]
        x = (a[:m] @ step) * hot[k]
        a = x / x.sum(axis=1, keepdims=True)
        ahead[k] = a
    b = leave.copy()
    for t in range(int(long[0]) - 1 if len(long) else -1, -1, -1):
        m, k = alive[t], start[: alive[t]] + t
        after[k] = b[:m]
        x = (b[:m] * hot[k]) @ step.T
        b[:m] = x / x.sum(axis=1, keepdims=True)
    shares = ahead * after
    shares /= shares.sum(axis=1, keepdims=True)
    return shares, before, hot, after


def stretches_of(text: str, seed: int) -> list[str]:
    """The words of a text in stretches of 8 to 64, whose lengths follow from ``seed``."""
    words, draw, out, k = text.split(), np.random.default_rng(seed & (2**63 - 1)), [], 0
    while k < len(words):
        n = int(draw.integers(8, 65))
        out.append(" ".join(words[k : k + n]))
        k += n
    return out


def fit_languages(docs: DataFrame, usable: Column, sample: int = SAMPLE, stretches: int = STRETCHES) -> Model:
    """A model of the languages in ``lang``, from rows for which ``usable`` holds and text and lang are there.

    The sample is bounded: of each language at most ``sample`` distinct documents (rows that agree in doc_id, lang and
    text count once), those with the least md5 of their doc_id, then the least hash of their text; of these, cut on
    the executors into stretches of at most 64 words, at most ``stretches`` of each language, those with the least
    hashes. Only these stretches reach the driver.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(usable)
    rows = rows.where(F.length("text") > 0).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    key = ["doc_id", "lang", "h"]
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "h")
    chosen = rows.select(*key).distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)
    # As a table of known size it need not drag all texts through a shuffle.
    chosen = materialize(chosen.drop("k"), "chosen")
    taken = rows.join(chosen, key).dropDuplicates(key).select("lang", "h", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, h, text in zip(*(column_or(batch, c).to_pylist() for c in ("lang", "h", "text")), strict=True):
                found = stretches_of(text, h)
                columns = [pa.array([lang] * len(found), pa.string()), pa.array([h] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "h", "n", "piece"])

    pieces = taken.mapInArrow(cut, "lang string, h long, n long, piece string")
    least = Window.partitionBy("lang").orderBy(F.xxhash64("h", "n"), "h", "n")
    pieces = pieces.withColumn("k", F.row_number().over(least)).where(F.col("k") <= stretches).drop("k")
    data = pieces.toPandas().sort_values(["h", "lang", "n"])
    discard(chosen)
    labels = sorted(set(data.lang))
    return _fit(labels, data.piece.tolist(), [labels.index(x) for x in data.lang])


def slopes(model: Model, group: list[tuple[str, int]], chained: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The slopes of the negative log-likelihood, a mean over chains of ``chained`` stretches (text, label) each.

    Rows of ``emit`` with a slope, these slopes, and those of ``move``; None if no stretch has a word.
    """
    size = len(model.labels)
    scores, at, found = emissions(model, [x for x, _ in group])
    if not len(scores):
        return None
    truth = np.repeat([tag for _, tag in group], np.diff(at))
    chain = np.append(at[:-1][::chained], at[-1])
    shares, before, hot, after = forward_backward(scores, model.move, chain)
    chains = len(chain) - 1
    slope = shares.copy()
    slope[np.arange(len(truth)), truth] -= 1
    slope /= chains
    grad = np.zeros(model.emit.shape)
    for slots, first in found:
        rows = slope if first is None else slope[np.repeat(np.arange(len(first)), np.diff(first, append=len(slots)))]
        for label in range(size):
            grad[:, label] += np.bincount(slots, rows[:, label], minlength=len(grad))
    used = np.flatnonzero(grad.any(axis=1))
    step = np.exp(model.move - model.move.max())
    pair = before[:, :, None] * step * (hot * after)[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    # A chain's first word is entered from every label alike; given its label, from each by its share.
    inner = np.ones(len(truth), dtype=bool)
    inner[chain[:-1][chain[:-1] < len(truth)]] = False
    real = np.zeros((size, size))
    np.add.at(real, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    enter = step / step.sum(axis=0)
    for label, n in enumerate(np.bincount(truth[~inner], minlength=size)):
        real[:, label] += n * enter[:, label]
    return used, grad[used], (pair.sum(axis=0) - real) / chains


def _fit(labels: list[str], pieces: list[str], tags: list[int]) -> Model:
    size = len(labels)
    _, words, _ = word_features(pieces)
    lexicon, seen = np.unique(words, return_counts=True)
    lexicon = lexicon[seen > 1]
    model = Model(labels, np.zeros(((1 << BITS) + len(lexicon) + 1, size), dtype=np.float32), np.zeros((size, size)), lexicon, np.ones(size), np.zeros(size))
    if size < 2:
        return model
    # In an order that mixes the languages.
    draw, tagged = np.random.default_rng(7), list(zip(pieces, tags, strict=True))
    seen_emit, seen_move = np.full(model.emit.shape, 1e-6, np.float32), np.full((size, size), 1e-6)
    for _ in range(EPOCHS):
        draw.shuffle(tagged)
        for low in range(0, len(tagged), BATCH * 8):
            found = slopes(model, tagged[low : low + BATCH * 8])
            if found is None:
                continue
            used, grad, grad_move = found
            g = (grad + DECAY * model.emit[used]).astype(np.float32)
            seen_emit[used] += g * g
            model.emit[used] -= RATE * g / np.sqrt(seen_emit[used])
            g = grad_move + DECAY * model.move
            seen_move += g * g
            model.move -= RATE * g / np.sqrt(seen_move)
    model.usual, model.spread = _usual(model, pieces, tags)
    return model


def _usual(model: Model, pieces: list[str], tags: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The labels' ``usual`` and ``spread``, in one more pass over the stretches."""
    means, widths, tags = np.full(len(pieces), np.nan), np.full(len(pieces), np.nan), np.array(tags)
    for low in range(0, len(pieces), 1000):
        points, at, _ = emissions(model, pieces[low : low + 1000])
        if len(points):
            best, some = points.max(axis=1).astype(np.float64), np.diff(at) > 0
            sums, squares = (np.concatenate(([0.0], np.cumsum(x))) for x in (best, best * best))
            first, last, n = at[:-1][some], at[1:][some], np.diff(at)[some]
            mean = (sums[last] - sums[first]) / n
            means[low + np.flatnonzero(some)] = mean
            widths[low + np.flatnonzero(some)] = np.sqrt(np.maximum(0.0, (squares[last] - squares[first]) / n - mean * mean))
    own = [(tags == k) & ~np.isnan(means) for k in range(len(model.labels))]
    usual = np.array([max(1e-6, float(np.median(means[x]))) if x.any() else 1.0 for x in own])
    return usual, np.array([float(np.median(widths[x])) if x.any() else 0.0 for x in own]) / usual


def labelled(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
    """Each text's label, score and evidence; 'und', 0 and 0 for texts without a letter.

    The evidence is the mean, over the words, of the best label's points by the word's own features, relative to
    the median of the stretches of the label that were learned, and DOUBT standard errors of such a mean. Words of a
    language that was not learned leave it low, whatever their neighbours, and mixed texts of learned ones don't. The
    fewer words there are, the larger the error and so the benefit of the doubt.
    """
    names, scores, evidence = [], [], []
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    for i, j in blocks_of(sizes, 1 << 18):
        part = texts[i:j]
        points, at, _ = emissions(model, part)
        if not len(points) or not len(model.labels):
            points, sums = None, None
        else:
            shares = forward_backward(points, model.move, at)[0]
            sums = np.concatenate((np.zeros((1, shares.shape[1])), np.cumsum(shares, axis=0)))
            alone = np.concatenate(([0.0], np.cumsum(points.max(axis=1), dtype=np.float64)))
        for k, text in enumerate(part):
            if sums is None or at[k] == at[k + 1] or not any(map(str.isalpha, text)):
                names.append(UNKNOWN)
                scores.append(0.0)
                evidence.append(0.0)
                continue
            mean = (sums[at[k + 1]] - sums[at[k]]) / (at[k + 1] - at[k])
            best = int(mean.argmax())
            names.append(model.labels[best])
            scores.append(float(min(1.0, max(0.0, mean[best]))))
            n = at[k + 1] - at[k]
            mean = (alone[at[k + 1]] - alone[at[k]]) / n / model.usual[best]
            evidence.append(float(max(0.0, mean + DOUBT * model.spread[best] / n**0.5)))
    return names, scores, evidence


def label_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and evidence of every row; null texts and such without a letter are 'und' with 0 and 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, evidence = [], [], []
            for _, texts in texts_of(column_or(batch, "text")):
                for found, kept in zip(labelled(shared.value, texts), (names, scores, evidence), strict=True):
                    kept += found
            columns = [column_or(batch, "doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(label, "doc_id long, lang_pred string, score double, evidence double")


def keep_labelled(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text gets a label with evidence of ``least`` and more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for _, texts in texts_of(column_or(batch, "text")):
                names, _, evidence = labelled(shared.value, texts)
                good += [n != UNKNOWN and e >= least for n, e in zip(names, evidence, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify_languages(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and evidence of every row of ``docs`` (doc_id, text, lang).

    The model is fitted on rows for which ``held_out`` (a column over doc_id) is not true and text and lang are
    there. ``lang_pred`` is one of their languages, or 'und' (score 0) if text is null or has no letter, as it
    is for all rows if nothing can be learned. ``score`` is the mean probability of that label over the words.
    Repeated rows get equal results, further columns are ignored, an empty table gives an empty result.
    """
    model = fit_languages(docs, ~F.coalesce(held_out, F.lit(False)), sample)
    out = label_texts(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "evidence")

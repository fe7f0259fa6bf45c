"""Substring dedup, phrase collocations and ranked search against brute force, on tables with every odd case."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import collocations as coll
from factloom.llm import common, lexical
from factloom.llm.substrings import Block, cover_of, difference_cover, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = "doc_id long, text string, lang string, h string, at int, lone string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts_with_passages(seed=1, n=60):
    draw = random.Random(seed)
    passages = [" ".join(draw.choice("abcdefgh") + str(draw.randrange(30)) for _ in range(m)) for m in (9, 10, 11, 14, 40)]
    out = []
    for _ in range(n):
        parts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(0, 30)))]
        for _ in range(draw.randrange(3)):
            words = draw.choice(passages).split()
            a = draw.randrange(len(words))
            parts += [" \n".join(words[a:] if draw.random() < 0.5 else words), f"u{draw.randrange(10**6)}"]
        out.append("  ".join(parts))
    return [*out, None, "", " \t\n", "x", "same words " * 30, out[0], out[0].upper(), "é ü " * 12, "\x1c one\x00two " * 9, "z" * 30000]


def removed_by_force(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    places = defaultdict(list)
    for d, ws in enumerate(words):
        for i in range(len(ws) - window + 1):
            places[tuple(ws[i : i + window])].append((d, i))
    gone = [set() for _ in texts]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d].update(range(i, i + window))
    return [(len(ws), len(g), " ".join(w for k, w in enumerate(ws) if k not in g)) for ws, g in zip(words, gone, strict=True)]


@pytest.mark.parametrize("period", [1, 3, 7, 13, 21])
def test_any_two_positions_have_a_shift_in_the_cover(period):
    cover = set(difference_cover(period))
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))


def test_anchors_are_few_and_every_window_holds_one_it_shares():
    assert cover_of(35)[0] == 21 and len(cover_of(35)[1]) == 5
    text = " ".join(f"w{i}" for i in range(200))
    shifted = " ".join(f"v{i}" for i in range(11)) + " " + text
    period, cover = cover_of(35)
    found = []
    for t in (text, shifted):
        raw = np.frombuffer(t.encode(), np.uint8)
        block = Block(raw, np.array([0, len(raw)]))
        at = block.anchors(35, period, cover)
        assert len(at) <= len(block.words) * 5 / 21 + 5
        found.append((block, at, block.runs(at, 15)))
    shared = set(found[0][2].tolist()) & set(found[1][2].tolist())
    for block, at, keys in found:
        starts = block.around(at[[k in shared for k in keys.tolist()]], 35, period)
        assert set(range(len(block.words) - 200, len(block.words) - 34)) <= set(starts.tolist())


@pytest.mark.parametrize(("window", "most"), [(10, 1 << 25), (10, 0), (1, 1 << 25), (35, 1 << 25), (35, 0)])
def test_without_repeats(spark, window, most):
    """By the bitmap as by the join; extra columns have names of inner ones."""
    texts = texts_with_passages()
    rows = [(i, t, "en", "clash", 5, "clash") for i, t in enumerate(texts)]
    found = without_repeats(spark.createDataFrame(rows, ROWS).repartition(5), window, most_shared=most).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found}
    assert len(found) == len(texts) and got == dict(enumerate(removed_by_force(texts, window)))


@pytest.mark.parametrize("most", [1 << 25, 0])
def test_repeated_rows_and_null_ids_without_repeats(spark, most, monkeypatch):
    monkeypatch.setattr(common, "CROWD", 3)
    long_, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    texts = [long_] * 9 + [other, other + " end", long_ + " tail", "alone " * 3]
    ids = [None] * 5 + [-1] * 4 + [None, None, -1, 7]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in without_repeats(rows, 20, most_shared=most).collect()), key=str)
    assert got == sorted(((i, *x) for i, x in zip(ids, removed_by_force(texts, 20), strict=True)), key=str)
    assert without_repeats(rows.limit(0), 20, most_shared=most).collect() == []


def collocations_by_force(rows, longest, least, covered, shown):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang or "und"][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= least}
        found = []
        for p, a in frequent.items():
            longer = [b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if len(p) > 1 and not any(100 * b >= covered * a for b in longer):
                s, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:shown], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "covered", "shown"), [(3, 4, 50, 2000), (4, 3, 60, 2000), (2, 2, 50, 7), (3, 1, 100, 50)])
def test_collocations(spark, longest, least, covered, shown, monkeypatch):
    """Ties, null languages, empty texts, pieces, repeated rows; very common words are dealt to several tasks."""
    monkeypatch.setattr(common, "CROWD", 5)
    draw = random.Random(2)
    vocabulary = ["New", "york", "city", "of", "the", "A\x01b", "a", "é", "ÉCOLE", "\x1cx", "x-y", "中文"]
    rows = [(draw.choice(["en", "de", None, "und"]), " ".join(draw.choice(vocabulary) + draw.choice(["", "", ".", ",\t", "!\n"]) for _ in range(draw.randrange(40)))) for _ in range(90)]
    rows += [("en", None), ("xx", ""), ("fr", " \t\n"), ("en", "new york " * 40), ("de", rows[0][1]), ("de", rows[0][1]), ("en", "q" * 9000), ("zz", "once only")]
    table = spark.createDataFrame([(lang, text, "clash", 1) for lang, text in rows], "lang string, text string, phrase string, f int")
    found = coll.collocations(table.repartition(4), longest, least, covered, shown)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == collocations_by_force(rows, longest, least, covered, shown)
    assert coll.collocations(table.limit(0)).collect() == []


def test_scores_of_large_counts_are_exact(spark, monkeypatch):
    """Products beyond 64 bits."""
    a, left, right = 3 * 10**14 - 7, 9 * 10**14 + 1, 5 * 10**14 + 3
    stream = spark.createDataFrame([("en", ["x", "y"], a, [left], [right], 0)], "lang string, words array<string>, f long, heads array<long>, tails array<long>, longer long")
    monkeypatch.setattr(coll, "phrase_counts", lambda *_: (spark.createDataFrame([("en", 10**15)], "lang string, n long"), stream))
    found = coll.collocations(spark.createDataFrame([("en", "x")], "lang string, text string")).first()
    assert found.score == 10**6 * a * a // (left * right)


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def ranked_by_force(items, docs, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            scores += [(-s, float("inf") if i is None else i)] if s > 0 else []
        out += [(item, rank, None if i == float("inf") else i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "shard", "pairs"), [(5, 1 << 22, 1 << 20), (5, 40, 1 << 20), (200, 40, 20)])
def test_ranked_documents(spark, k, shard, pairs, monkeypatch):
    """Many ties, small shards, several blocks of queries; nulls, empty texts, repeated rows and ids, clashing columns."""
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "STEP", 2)
    draw = random.Random(4)
    words = [f"t{i}" for i in range(25)] + ["Éa", "x_y", "B2b", "中文"]
    docs = [(i, " ".join(draw.choice(words[: draw.randrange(1, 29)]) for _ in range(draw.randrange(60)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(20)] + [(5, "t1 t2"), (None, docs[3][1]), (300, None), (301, ""), (302, "-- ,"), (303, "t1 " * 3000), docs[7], docs[7]]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 9)))) for i in range(12)] + [(50, None), (51, ""), (52, "unheard of"), (3, "t9 t9"), (None, "t1")]
    documents = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, number long, score long").coalesce(2)
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h long")
    found = lexical.ranked_documents(queries, documents, k)
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)
    assert got == ranked_by_force([x for x in items if x[0] is not None], docs, k)
    assert lexical.ranked_documents(queries.limit(0), documents).collect() == []
    assert lexical.ranked_documents(queries, documents.limit(0)).collect() == []


def test_intervals_close_before_the_lists_end():
    """Few high impacts in long lists: most entries are never read, and what is found is exact."""
    draw = np.random.default_rng(0)
    size, lists = 50_000, []
    for _ in range(5):
        docs = np.arange(size)
        values = draw.integers(1, 100, size)
        values[:8] += draw.integers(1000, 2000, 8)
        order = np.lexsort((docs, -values))
        lists.append((docs[order], values[order]))
    read = []
    members, scores = lexical.best_documents(lists, size, 5, read=read)
    whole = sum(np.bincount(d, v, minlength=size) for d, v in lists)
    best = np.lexsort((np.arange(size), -whole))[:5]
    assert dict(zip(members.tolist(), scores.tolist(), strict=True)) == {int(i): int(whole[i]) for i in best}
    assert read[0] < 5 * size / 20
    none, _ = lexical.best_documents(lists, size, 5, beat=int(whole.max()) + 1, read=read)
    assert not len(none) and read[1] <= read[0]


def test_document_weight_beyond_64_bits():
    n = np.array([10**9, 7])
    assert lexical.document_weight(n, 10**11, 10**14).tolist() == [50 + 50 * int(x) * 10**11 // 10**14 for x in n]

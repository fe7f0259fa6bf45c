"""Each operator against a brute-force version on small tables, with nulls, empty and long texts, ties and repeats."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factloom.llm import pii
from factloom.llm.ann import nearest_neighbours
from factloom.llm.components import connected_components
from factloom.llm.langid import identify_languages
from factloom.llm.mixing import curriculum, mixed_documents, training_order
from factloom.llm.neardup import near_duplicates, without_near_duplicates
from factloom.llm.packing import pack_documents, plan_packing, sequences
from factloom.llm.quality import classify_quality
from factloom.llm.queries import op6_source_mixture
from factloom.llm.tokencount import CountTree, counts_after_edits, token_counter
from factloom.llm.topk import top_k_products
from factloom.llm.urlfilter import judge_captures

DOCS = "doc_id long, text string, lang string, source string, n_chars long, vec_id string"
WORDS = ["ab", "cd", "Ef", "gh", "ij,", "kl.", "mn", "op", "qr", "éa"]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def make_docs(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", {}).get(i, "en"), columns.get("source", {}).get(i, f"s{i % 3}"), len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sample_texts(n=120, seed=3):
    draw = random.Random(seed)
    base = [" ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(draw.randrange(1, 120))) for _ in range(n // 3)]
    texts = list(base)
    for t in base:
        words = t.split()
        for _ in range(2):
            copy = list(words)
            for _ in range(draw.randrange(0, 1 + len(words) // 12)):
                copy[draw.randrange(len(copy))] = "changed" + str(draw.randrange(99))
            texts.append(" \n".join(copy))
    return [*texts, None, "", "   \t", "one", "ONE", "x" * 5000, "two words", "Two  Words"]


def components_by_force(texts, width, percent):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    texts = sample_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make_docs(spark, texts), width, 80).collect()}
    assert got == components_by_force(texts, width, 80)


def test_near_duplicates_of_one_large_group(spark):
    """A bucket with many members on both sides of the threshold is compared in blocks."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(340):
        copy = list(base)
        for k in draw.sample(range(90), 5):
            copy[k] = f"c{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make_docs(spark, texts), 2, 80).collect()}
    assert got == components_by_force(texts, 2, 80)


def test_near_duplicates_edges(spark):
    empty = make_docs(spark, []).select("doc_id", "text")
    assert near_duplicates(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(rows, 2).collect()), key=str)
    assert got == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (9, 9, True)], key=str)
    assert sorted(map(str, [r.doc_id for r in without_near_duplicates(rows, 2).collect()])) == ["7", "9"]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    assert connected_components(links.limit(0)).collect() == []


def vectors_table(spark, n=330, dim=7, seed=1, extra=()):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(draw.normal(size=dim) * draw.choice([0.3, 1, 3]))], 1) for i in range(n)]
    rows[11] = (11, rows[10][1], 1)
    rows += [(n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [None] * dim, 1), (n + 3, [0.0] * dim, 1), (n + 4, [], 1), (n + 5, [float("inf")] * dim, 1)]
    rows += [rows[12], *extra]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def usable(rows):
    seen, out = set(), []
    for i, v, _ in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and (i, tuple(v)) not in seen:
            seen.add((i, tuple(v)))
            out.append((i, np.float32(v).astype(float)))
    return out


def test_top_k_products(spark):
    table, rows = vectors_table(spark)
    good = [(i, np.floor(256 * v).astype(int)) for i, v in usable(rows)]
    want = {}
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), c) for c, w in good if c != q)[:5]
            want.update({(q, r): (c, -s) for r, (s, c) in enumerate(best, 1)})
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k_products(table).collect()}
    assert got == want
    assert top_k_products(table.limit(0)).collect() == []
    few = {(r.query_id, r.rank): r.vec_id for r in top_k_products(table.where("vec_id in (0, 3)")).collect()}
    assert few == {(0, 1): 3}


def test_top_k_of_huge_components(spark):
    table = spark.createDataFrame([(0, [1e15, -1e15]), (1, [1e15, 0.0]), (2, [-3.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id) for r in top_k_products(table).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]


def test_nearest_neighbours(spark):
    table, rows = vectors_table(spark)
    good = [(i, v) for i, v in usable(rows) if v.any()]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest_neighbours(table).collect()}
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), c) for c, w in good if c != q)[:5]
            for r, (s, _) in enumerate(best, 1):
                assert abs(got[q, r][1] + s) < 1e-12
    assert len(got) == 5 * len({q for q, _ in good if q % 50 == 0})
    assert nearest_neighbours(table.limit(0)).collect() == []


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*sample_texts(60), "word " * 9000, "Σ İ don't <|endoftext|> a\x1cb ½"]
    packed = pack_documents(make_docs(spark, texts), TOKENIZER, with_ids=True).cache()
    tokenizer, ids = Tokenizer.from_file(TOKENIZER), {}
    for r in packed.collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length and r.start == 4096 * r.piece
        ids.setdefault(r.doc_id, {})[r.piece] = list(r.ids)
    for i, t in enumerate(texts):
        assert sum((ids[i][p] for p in sorted(ids[i])), []) == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts")).collect()
    for r in rows:
        ends = [0, *np.cumsum([p["length"] for p in r.parts])]
        assert [p["offset"] for p in r.parts] == ends[:-1] and r.n <= 4096
    assert len(rows) <= -(-sum(r.n for r in rows) // 4096) + 1
    assert {r.sequence_id: len(r.ids) for r in sequences(packed).collect()} == {r.sequence_id: r.n for r in rows}
    assert pack_documents(make_docs(spark, []), TOKENIZER).collect() == []


def test_packing_plan():
    draw = random.Random(2)
    for limit in (10, 100):
        counts = {draw.randrange(1, limit + 1): draw.randrange(1, 40) for _ in range(30)}
        plan = plan_packing(counts, limit)
        filled, used = {}, {}
        for length, first, each, base, offset in zip(plan.length, plan.first, plan.each, plan.base, plan.offset, strict=True):
            later = [f for n, f in zip(plan.length, plan.first, strict=True) if n == length and f > first]
            for k in range((min(later) if later else counts[int(length)]) - first):
                filled.setdefault(base + k // each, []).append((offset + k % each * length, length))
                used[int(length)] = used.get(int(length), 0) + 1
        assert used == counts and len(filled) == plan.sequences
        for parts in filled.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= limit


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_force(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_identifiers():
    draw = random.Random(8)
    pieces = ["a@b.c", "@", ".", "1", "25", "300", " ", "-", "+", "+49 (151) 2345-678", "4111 1111 1111 1111", "x", "é", "10.0.0.1", "_", "b-c.de", "@@", "0.0", "99999999999999"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(12)))
        assert [(k, a, b) for k, a, b, base in pii.personal_spans(text) if base] == base_by_force(text), text


def test_disguises_keep_offsets(spark):
    cases = {
        "write to john [at] example [dot] com today": ("email", "john [at] example [dot] com"),
        "mary at example dot org": ("email", "mary at example dot org"),
        "jоhn@exаmple.com": ("email", "jоhn@exаmple.com"),
        "call plus four nine one five one two three four five six seven eight now": ("phone", "plus four nine one five one two three four five six seven eight"),
        "card ４１１１ １１１１ １１１１ １１１１.": ("card", "４１１１ １１１１ １１１１ １１１１"),
    }
    for text, (kind, part) in cases.items():
        assert [(k, text[a:b], base) for k, a, b, base in pii.personal_spans(text)] == [(kind, part, False)]
    assert pii.personal_spans("we looked at one two of them. The dot was there at noon.") == []
    docs = make_docs(spark, [*cases, None, "", "mail a@b.co, a@b.co", "9" * 3000])
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[0].text == "write to [EMAIL] today" and out[0].n_chars == len(out[0].text) and out[5].text is None and out[6].text == ""
    assert out[7].text == "mail [EMAIL], [EMAIL]" and out[0].vec_id == "x"
    assert [len(r.spans) for r in pii.find_personal_data(docs).orderBy("doc_id").collect()] == [1, 1, 1, 1, 1, 0, 0, 2, 0]
    assert pii.find_personal_data(docs.limit(0)).collect() == []


@pytest.mark.parametrize("gone", ["\u00ad", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff"])
def test_removed_characters_alone_are_a_disguise(spark, gone):
    parts = [("card", f"4111{gone}1111{gone}1111{gone}1111"), ("email", f"john@exam{gone}ple.com"), ("ip", f"10.{gone}0.0.1"), ("phone", f"+49 30 {gone}1234567")]
    for kind, part in parts:
        text = f"so{gone}me {part}, then"
        assert [(k, text[a:b], base) for k, a, b, base in pii.personal_spans(text)] == [(kind, part, False)]
    assert pii.personal_spans(f"mail{gone} {gone}a@b.com{gone} and{gone}") == [("email", 7, 14, True)]
    docs = make_docs(spark, [f"card {parts[0][1]}."])
    assert [r.text for r in pii.redact(docs).collect()] == ["card [CARD]."]


def test_each_disguise_stands_alone():
    cases = {
        "mary at example.org": "email", "mary AT\tmail.example.org": "email", "mary[at]example.org": "email", "mary@example (dot) org": "email",
        "mary@example dot org": "email", "mary <arroba> example.org": "email", "ten dot 10 dot 0 dot 1": None, "10 dot 10 dot 0 dot 1": "ip", "10[.]10.0.1": "ip",
        "eight dot eight dot eight dot eight": "ip", "eight dot 8 dot eight dot 8": "ip", "8 dot 8 dot 8 dot eight": "ip",
        "plus 49 30 1234567": "phone", "plus four nine 30 1234567": "phone", "+49 30 1234 five six 7": "phone",
        "4111 1111 1111 one one one one": "card", "4111 one 111 1111 one 111": "card", "eins, zwei - drei": None, "one 2024 31": None,
    }
    other = " In four, five, six they [at] home looked , dot , on."
    for part, kind in cases.items():
        for text in (part, f"see {part}; ", f"see {part}; {other}"):
            found = [(k, text[a:b], base) for k, a, b, base in pii.personal_spans(text)]
            assert found == ([(kind, part, False)] if kind else []), text


def test_undone_spans_stand_beside_shorter_base_spans(spark):
    whole = {"mary [dot] jones@example.com": "email", "mary@mail.exam\u200bple.com": "email", "+49 30 123456788 five six": "phone"}
    for part, kind in whole.items():
        found = [(k, f"to {part}!"[a:b], base) for k, a, b, base in pii.personal_spans(f"to {part}!") if not base]
        assert found == [(kind, part, False)], part
    assert [s[1:] for s in pii.personal_spans("mary [dot] jones@example.com")] == [(0, 28, False), (11, 28, True)]
    assert pii.personal_spans("a [at] b. jones@example.com, c@d.org") == [("email", 10, 27, True), ("email", 29, 36, True)]
    docs = make_docs(spark, ["ask mary [dot] jones@example.com.", "at mary@mail.exam\u200bple.com or a@b.com"])
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["ask [EMAIL].", "at [EMAIL] or [EMAIL]"]


def test_hints_hold_wherever_a_step_writes():
    draw = random.Random(12)
    pieces = ["one", "Acht", "fünf", "two", "7", "4111", "dot", "at", "plus", "[at]", "(dot)", "x", "a.com", ",", "-", "[", "]", "@", "."]
    for _ in range(20000):
        text = "".join(draw.choice(pieces) + draw.choice([" ", "  ", "", "\n"]) for _ in range(draw.randrange(8)))
        if pii.Tracked(text).replaced(pii._RUN, pii._spelled).text != text:
            assert pii._HINT.search(text), text
        for step in (pii._DOT, pii._AT, pii._BARE_DOT, pii._BARE_AT):
            assert not step.search(text) or pii._DISGUISE.search(text), text


def test_languages(spark):
    draw = random.Random(4)
    vocabulary = {"xx": ["thun", "thor", "thalen", "othe"], "yy": ["éau", "queré", "leaux", "ment"], "zz": ["ción", "llado", "osque", "rrar"]}
    texts, langs = [], {}
    for i in range(240):
        lang = draw.choice(list(vocabulary))
        langs[i] = lang if i % 17 else None
        texts.append(" ".join(draw.choice(vocabulary[lang]) + draw.choice(["", "en", "a"]) for _ in range(draw.randrange(2, 60))))
    texts += ["123 !!", None, "", "thun " * 3000]
    docs = make_docs(spark, texts, lang=langs | {240: None, 241: None, 242: "xx", 243: None})
    held = F.expr("crc32(cast(doc_id AS string)) % 4 = 2")
    got = {r.doc_id: r for r in identify_languages(docs, held).collect()}
    for i in range(240):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
    right = [got[i].lang_pred == langs[i] for i in range(240) if langs[i] and got[i].held_out]
    assert sum(right) / len(right) > 0.97
    assert [got[i].lang_pred for i in (240, 241, 242, 243)] == ["und", "und", "und", "xx"]
    assert identify_languages(docs.limit(0), held).collect() == []
    mixed = make_docs(spark, ["thun thor", "éau queré"], lang={0: None, 1: None})
    assert {r.lang_pred for r in identify_languages(mixed, held).collect()} == {"und"}


def test_forward_backward_by_force():
    from itertools import product

    from factloom.llm import langid

    draw = np.random.default_rng(0)
    old, langid.STRETCH = langid.STRETCH, 2  # several stretches in five words
    try:
        scores, move, at = draw.normal(size=(8, 3)), draw.normal(size=(3, 3)), np.array([0, 5, 5, 8])
        shares = langid.forward_backward(scores.astype(np.float32), move, at)[0]
        for a, b in ((0, 5), (5, 8)):
            total = np.zeros((b - a, 3))
            for path in product(range(3), repeat=b - a):
                start = np.exp(move)[:, path[0]].sum()
                weight = start * np.exp(sum(scores[a + t, y] for t, y in enumerate(path)) + sum(move[x, y] for x, y in zip(path, path[1:])))
                for t, y in enumerate(path):
                    total[t, y] += weight
            assert np.allclose(shares[a:b], total / total.sum(axis=1, keepdims=True), atol=1e-5)
    finally:
        langid.STRETCH = old


def test_quality(spark):
    draw = random.Random(6)
    texts, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        words = [draw.choice(WORDS) for _ in range(30)]
        texts.append(" ".join(w if good or draw.random() < 0.3 else w.upper() + "!!" for w in words))
        labels.append((i, int(good)))
    docs = make_docs(spark, [*texts, None, "", "a" * 3000])
    table = spark.createDataFrame([*labels, (301, None), (None, 1), (5, 1)], "doc_id long, label int")
    held = F.expr("crc32(cast(doc_id AS string)) % 3 = 1")
    got = {r.doc_id: r for r in classify_quality(docs, table, held).collect()}
    right = [got[i].predicted == y for i, y in labels if got[i].held_out]
    assert sum(right) / len(right) > 0.95 and len(got) == 303
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert classify_quality(docs.limit(0), table, held).collect() == []


def test_mixture(spark):
    texts = ["w " * (i % 13) for i in range(400)] + [None, "", "w " * 4000]
    source = {i: None if i % 10 == 0 else ("big" if i % 3 else f"s{i % 4}") for i in range(403)}
    docs = make_docs(spark, texts, source=source).withColumn("size", F.lit("clash"))
    mixed = curriculum(docs).collect()
    assert len(mixed) == 403
    total, target, taken, sizes = 0, {}, {}, {}
    for r in mixed:
        assert r.size == len((texts[r.doc_id] or "").split()) and r.taken in (0, r.size, 2 * r.size) and len(r.positions) == r.passes
        assert all(0 <= p <= 1 for p in r.positions)
        total += r.size
        target[r.source], sizes[r.source] = r.target, r.source_size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 and all(target[s] <= 2 * sizes[s] + 1e-9 for s in target)
    for s in target:
        biggest = max(r.size for r in mixed if r.source == s)
        assert abs(taken[s] - target[s]) <= biggest
    again = {(r.doc_id, r.taken) for r in curriculum(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in mixed}
    order = [r.position for r in training_order(curriculum(docs)).collect()]
    assert order == sorted(order) and len(order) == sum(r.passes for r in mixed)
    assert mixed_documents(docs).columns == docs.columns
    odd = docs.unionByName(docs.where("doc_id IN (5, 6)")).unionByName(docs.where("doc_id > 390").withColumn("doc_id", F.lit(None).cast("long")))
    reads = {}
    for r in mixed_documents(odd).collect():
        reads[r.doc_id] = reads.get(r.doc_id, 0) + 1
    assert reads[None] > 5 and all(n <= 2 or k in (None, 5, 6) for k, n in reads.items()) and reads.get(5, 0) in (0, 2, 4)
    assert curriculum(docs.limit(0)).collect() == []


def test_mixture_query_comes_in_training_order(spark):
    folder = "/root/testdata/sf0.001"
    first = {r.doc_id: r.positions[0] if r.positions else 2.0 for r in curriculum(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    found = op6_source_mixture(spark, folder)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken", "passes", "position", "position_again"]
    order = [first[r.doc_id] for r in found.collect()]
    assert len(order) == len(first) and order == sorted(order)


def test_url_lists(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.b.example.com/x/y", "2024-03-01"), (2, "http://a.b.example.com/x/y", "2024-05-01"), (3, "https://u@B.example.com:80/z", "2024-03-01"),
         (4, None, "2024-03-01"), (5, "relative/path", "2024-03-01"), (6, "http://b.example.com/", None), (7, "http://q.org", "2024-03-01"), (7, "http://q.org", "2024-03-01")],
        "page_id long, url string, fetched_on string",
    ).withColumn("fetched_on", F.to_date("fetched_on")).withColumn("decision", F.lit("clash"))
    entries = spark.createDataFrame(
        [("example.com", "deny", "add", "2024-01-01"), ("example.com", "deny", "remove", "2024-04-01"), ("a.b.example.com/x", "allow", "add", "2024-02-01"),
         ("b.example.com", "deny", "add", "2024-03-02"), ("q.org", "deny", "add", "2024-03-01"), ("q.org", "allow", "add", "2024-03-01"), (None, "deny", "add", "2024-01-01")],
        "key string, list string, action string, dated string",
    ).withColumn("dated", F.to_date("dated"))
    got = sorted(((r.page_id, r.decision, r.matched_key) for r in judge_captures(captures, entries).collect()), key=str)
    want = [(1, "allow", "a.b.example.com/x"), (2, "allow", "a.b.example.com/x"), (3, "deny", "example.com"), (4, "none", None), (5, "none", None), (6, "none", None), (7, "deny", "q.org"), (7, "deny", "q.org")]
    assert got == want
    assert {r.decision for r in judge_captures(captures, entries.limit(0)).collect()} == {"none"}
    assert judge_captures(captures.limit(0), entries).collect() == []


def test_count_tree():
    count, draw, signs = token_counter(RANKS, public_tokenizers.PATTERN), random.Random(1), "ab c\n é1,.'s  \t\x1cxyz😀"
    for _ in range(60):
        text = "".join(draw.choice(signs) for _ in range(draw.choice([0, 1, 10, 600, 3000])))
        tree = CountTree(text, count)
        for _ in range(10):
            at, removed = draw.randrange(len(text) + 2), draw.choice([0, 1, 3, 50, 700])
            inserted = "".join(draw.choice(signs) for _ in range(draw.choice([0, 1, 5, 900])))
            start = min(at, len(text))
            text = text[:start] + inserted + text[start + removed :]
            tree.edit(at, removed, inserted)
            assert tree.text == text and tree.total == count(text)
    tree = CountTree("some words " * 5000, count)
    before = tree.encoded
    tree.edit(20_000, 3, "other")
    assert tree.encoded - before < 3000


def test_counts_after_edits(spark):
    texts = ["some words here", None, "x" * 3000, "unedited", ""]
    edits = spark.createDataFrame(
        [(0, 2, 0, 4, "a"), (0, 1, 4, None, " very new"), (1, 1, 0, 9, "now text"), (2, 1, 10, 5, None), (99, 1, 0, 1, "q"), (None, 1, 0, 1, "q"), (4, 1, -5, 2, "z z")],
        "doc_id long, edit_no int, at long, removed long, inserted string",
    )
    count = token_counter(RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: (r.tokens_before, r.tokens_after, r.n_edits) for r in counts_after_edits(make_docs(spark, texts), edits, RANKS, public_tokenizers.PATTERN).collect()}
    after = ["a very new words here", "now text", "x" * 2995, "unedited", "z z"]
    assert got == {i: (count(t or ""), count(a), n) for i, (t, a, n) in enumerate(zip(texts, after, [2, 1, 1, 0, 1], strict=True))}
    assert counts_after_edits(make_docs(spark, []), edits, RANKS, public_tokenizers.PATTERN).collect() == []

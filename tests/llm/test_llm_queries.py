"""The registered queries: against their SQL where there is some, else against brute force on the smallest tables."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factloom.llm import langid, pii, quality, queries
from factloom.llm.words import _BASE, mix
from tests.llm.test_llm_operators import base_by_force, components_by_force

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    got = sorted((tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()), key=repr)
    connection = duckdb.connect()
    for table in ("benchmark", "documents", "embeddings", "pages"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = connection.sql(queries.ORACLES[name])
    columns = sorted(result.columns)
    assert columns == sorted(found.columns)
    want = sorted((tuple(plain(dict(zip(result.columns, r, strict=True))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def test_op2_by_force(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.PACKING_TOKENIZER)
    want = set()
    for doc_id, text, *_ in documents:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(doc_id, k, k * 4096, len(part), zlib.crc32(part.tobytes())) for k in range(-(-len(ids) // 4096)) for part in (ids[k * 4096 : (k + 1) * 4096],)}
    rows = queries.op2_best_fit_packing(spark, FOLDER).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_op3_by_force(spark, documents):
    want = components_by_force([x[1] for x in documents], 2, 80)
    ids = [x[0] for x in documents]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op3_near_duplicates(spark, FOLDER).collect()}
    assert got == {ids[i]: (n, ids[c], k) for i, (n, c, k) in want.items()}


def test_op4_by_force(spark, documents):
    rows = {r.doc_id: r for r in queries.op4_personal_data(spark, FOLDER).collect()}
    assert len(rows) == len(documents)
    for doc_id, text, *_ in documents:
        base = base_by_force(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = rows[doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(spans)
        assert spans == sorted(spans, key=lambda x: (int(x[1]), pii.KINDS.index(x[0]), int(x[2])))
        assert [r[f"n_{k}_all"] for k in pii.KINDS] == [sum(x[0] == k for x in spans) for k in pii.KINDS]
        assert set(spans) == {(k, str(a), str(b)) for k, a, b, _ in pii.personal_spans(text)}


def hash_by_force(data):
    return int(mix(np.array([sum((b + 1) * pow(_BASE, i, 1 << 64) for i, b in enumerate(data)) % (1 << 64)], np.uint64))[0])


def slots_by_force(word, lexicon):
    def slot(data, kind):
        return int(mix(np.array([(hash_by_force(data) + kind) % (1 << 64)], np.uint64))[0]) >> (64 - langid.BITS)

    out = []
    for n in (1, 2, 3, 4):
        out += [slot(word[:n], n), slot(word[-n:], 10 + n)]
    for n in (2, 3):
        out += [slot(word[k : k + n], 20 + n) for k in range(max(1, len(word) - n + 1))]
    known = lexicon.get(hash_by_force(word))
    return [*out, (1 << langid.BITS) + (len(lexicon) if known is None else known)]


def test_op5_by_force(spark, documents):
    """Features, emissions and forward-backward of whole texts in plain loops, under the model that the query learns."""
    held = F.expr("crc32(cast(doc_id AS string)) % 4 = 2")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit_languages(docs, ~held)
    lexicon = {int(h): k for k, h in enumerate(model.lexicon)}
    got = {r.doc_id: r for r in queries.op5_language_id(spark, FOLDER).collect()}
    assert len(got) == len(documents)
    size, step, checked = len(model.labels), np.exp(model.move), 0
    for doc_id, text, *_ in documents:
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        if not text or len(text) > 1500 or checked > 25:
            continue
        checked += 1
        words = re.findall(rb"[a-z\x80-\xff]+", text.lower().encode("utf-8", "replace"))
        scores = [sum(model.emit[s].astype(float) for s in slots_by_force(w, lexicon)) for w in words]
        forward, backward = [], [np.ones(size)]
        for t, s in enumerate(scores):
            a = (np.ones(size) if t == 0 else forward[-1]) @ step * np.exp(s - s.max())
            forward.append(a / a.sum())
        for s in reversed(scores[1:]):
            b = step @ (np.exp(s - s.max()) * backward[-1])
            backward.append(b / b.sum())
        shares = [a * b / (a @ b) for a, b in zip(forward, reversed(backward))]
        mean = np.mean(shares, axis=0)
        assert got[doc_id].lang_pred == model.labels[int(mean.argmax())] and abs(got[doc_id].score - mean.max()) < 1e-3
    assert checked > 20
    right = [got[d].lang_pred == lang for d, text, lang, _ in documents if lang and text and got[d].held_out]
    assert sum(right) / len(right) > 0.95


def test_slopes_by_finite_differences():
    draw = np.random.default_rng(2)
    group = [(" ".join(draw.choice(["ab", "bc", "éa", "cab", "x"], int(draw.integers(1, 5)))), int(draw.integers(0, 3))) for _ in range(7)]
    pieces = [x for x, _ in group]
    lexicon = np.unique(langid.word_features(pieces)[1])[:3]
    model = langid.Model(list("pqr"), np.zeros(((1 << langid.BITS) + 4, 3), np.float32), draw.normal(size=(3, 3)), lexicon)
    used, grad, grad_move = langid.slopes(model, group, 3)
    model.emit[used] = draw.normal(size=(len(used), 3))
    used, grad, grad_move = langid.slopes(model, group, 3)

    def loss(move, emit):
        whole = 0.0
        scores, at, _ = langid.emissions(langid.Model(model.labels, emit, move, lexicon), pieces)
        tags, chains = np.repeat([t for _, t in group], np.diff(at)), [0, 3, 6, 7]
        for a, b in zip(chains, chains[1:]):
            rows, truth = scores[at[a] : at[b]].astype(float), tags[at[a] : at[b]]
            alpha = np.log(np.exp(move).sum(axis=0)) + rows[0]
            real = alpha[truth[0]]
            for t in range(1, len(rows)):
                alpha = np.log(np.exp(alpha[:, None] + move).sum(axis=0)) + rows[t]
                real += move[truth[t - 1], truth[t]] + rows[t][truth[t]]
            whole += np.log(np.exp(alpha).sum()) - real
        return whole / 3

    for x in range(3):
        for y in range(3):
            up, down = model.move.copy(), model.move.copy()
            up[x, y] += 1e-5
            down[x, y] -= 1e-5
            assert abs((loss(up, model.emit) - loss(down, model.emit)) / 2e-5 - grad_move[x, y]) < 1e-4
    for row, want in list(zip(used, grad))[::9]:
        for y in range(3):
            up, down = model.emit.copy(), model.emit.copy()
            up[row, y] += 1e-2
            down[row, y] -= 1e-2
            assert abs((loss(model.move, up) - loss(model.move, down)) / 2e-2 - want[y]) < 2e-3


def features_by_force(text):
    """Slot -> value: each word and each shape, alone and with the one before, and whether the word is said again."""
    words = [w.encode() for w in WORD.findall(text or "")]
    hashes = [hash_by_force(re.sub(rb"[A-Z]", lambda m: m[0].lower(), w)) for w in words]
    shapes = []
    for w in words:
        kinds = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in w)
        shapes.append(hash_by_force(bytes(b for k, b in enumerate(kinds) if k == 0 or kinds[k - 1] != b)))
    found = []
    for t in range(len(words)):
        own = [hashes[t], shapes[t]]
        for k, x in enumerate((hashes, shapes)):
            own.append(int(mix(np.array([(x[t] * 0xD6E8FEB86659FD93 + (x[t - 1] if t else 0) + k) % (1 << 64)], np.uint64))[0]))
        own.append(int(mix(np.array([1 if t and hashes[t] == hashes[t - 1] else 2], np.uint64))[0]))
        found += [h >> (64 - quality.BITS) for h in own]
    counts = {}
    for slot in found:
        counts[slot] = counts.get(slot, 0) + 1
    return {slot: n / math.sqrt(len(found)) for slot, n in counts.items()}


def test_op8_by_force(spark, documents):
    """Features, FTRL-proximal updates and sparse dot products in plain loops."""
    labels = duckdb.sql(f"SELECT DISTINCT doc_id, quality FROM '{FOLDER}/labels.parquet' WHERE quality IN (0, 1)").fetchall()
    texts = {d: t for d, t, *_ in documents}
    learned = [(d, y) for d, y in labels if d in texts and zlib.crc32(str(d).encode()) % 3 != 1]
    found = {d: features_by_force(texts[d]) for d in texts}
    z, n = {}, {}

    def weight(slot):
        v = z.get(slot, 0.0)
        return 0.0 if abs(v) <= quality.L1 else -(v - math.copysign(quality.L1, v)) / ((quality.BETA + math.sqrt(n[slot])) / quality.ALPHA + quality.L2)

    bias = 1 << quality.BITS
    learned.sort(key=lambda x: (int(mix(np.array([x[0]], np.uint64))[0]), x[1]))
    for _ in range(quality.EPOCHS):
        for d, y in learned:
            x = found[d] | {bias: 1.0}
            w = {s: weight(s) for s in x}
            p = 1 / (1 + math.exp(-sum(w[s] * v for s, v in x.items())))
            for s, v in x.items():
                g, old = (p - y) * v, n.get(s, 0.0)
                z[s] = z.get(s, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * w[s]
                n[s] = old + g * g
    got = {r.doc_id: r for r in queries.op8_quality(spark, FOLDER).collect()}
    assert len(got) == len(documents)
    for d in texts:
        score = 1 / (1 + math.exp(-(weight(bias) + sum(weight(s) * v for s, v in found[d].items()))))
        r = got[d]
        assert abs(r.score - score) < 1e-4 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)


def test_op9_by_force(spark, documents):
    import tiktoken

    ranks = {k: v for k, v in _ranks()}
    encoding = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op9_token_counts(spark, FOLDER).collect()}
    assert len(got) == len(documents)
    for d, text, lang, source in documents:
        text = text or ""
        size, now = len(text), text
        insert = " ".join(x for x in ("\n", source, lang, "\n") if x is not None)
        for at, removed, inserted in ((size // 4, 7, " revised"), (size // 2, 0, insert), (size * 3 // 4, 40, "")):
            at = min(at, len(now))
            now = now[:at] + inserted + now[at + removed :]
        r = got[d]
        assert (r.tokens_before, r.tokens_after, r.n_edits, r.chars_encoded) == (len(encoding.encode_ordinary(text)), len(encoding.encode_ordinary(now)), 3, size)
        assert r.chars_again <= 3 * 4 * 1100 + len(insert)


def _ranks():
    import base64

    with open(queries.COUNTING_TOKENIZER, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines)]

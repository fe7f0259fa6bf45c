"""The fit of the language model reads its whole sample in every epoch; its evidence has no step at any length."""

import numpy as np

from factloom.llm import langid


def test_every_epoch_reads_the_whole_sample(monkeypatch):
    read, last = [], []

    def counted(model, texts):
        read.append(sum(len(x.split()) for x in texts))
        return np.zeros((0, len(model.labels)), np.float32), np.zeros(1, np.int64), []

    def after(model, pieces, tags):
        last.append((sum(read), sum(len(x.split()) for x in pieces)))
        return np.ones(2), np.zeros(2)

    monkeypatch.setattr(langid, "emissions", counted)
    monkeypatch.setattr(langid, "_usual", after)
    pieces = ["ab " * 45] * 10_000 + ["cd " * 45] * 10_000
    langid._fit(["xx", "yy"], pieces, [0] * 10_000 + [1] * 10_000)
    assert last == [(langid.EPOCHS * 900_000, 900_000)] and sum(read) == langid.EPOCHS * 900_000


def test_evidence_tightens_with_the_number_of_words_without_a_step():
    draw = np.random.default_rng(1)
    known = [[f"{a}{b}{'aeiou'[k]}" for a in "bcdfgklm" for b in ("an", "ir", "ost")] for k in (0, 1)]
    pieces = [" ".join(draw.choice(known[k], 60)) for k in (0, 1) for _ in range(80)]
    model = langid._fit(["xx", "yy"], pieces, [0] * 80 + [1] * 80)
    lengths = [1, 2, 5, 19, 20, 21, 400]
    _, _, other = langid.labelled(model, [" ".join(["zqxwyv"] * n) for n in lengths])
    _, _, mine = langid.labelled(model, [" ".join(["banos"[:3] + "a"] * n) for n in lengths])
    assert other[-1] < 0.5 < mine[-1] and other == sorted(other, reverse=True) and other[0] > other[-1]
    assert other[3] - other[5] < (other[0] - other[1]) / 5

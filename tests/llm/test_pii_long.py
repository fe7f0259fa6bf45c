"""Long runs of one sign take time in proportion, beside disguises that make every step run; spans are the same."""

import time

import pytest

from factloom.llm import pii

AROUND = "x at y dot z [at] q one two three ", " end at x.com ( dot ) a"


@pytest.mark.parametrize("sign", [" ", "1", ".", "[", "]", "-", ",", "a", "1 ", "\n", "( "])
def test_time_in_proportion(sign):
    took = []
    for n in (30_000, 240_000):
        text = AROUND[0] + sign * (n // len(sign)) + AROUND[1]
        began = time.process_time()
        pii.personal_spans(text)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)


def test_white_space_around_disguises():
    for gap in ("", " ", "  ", "\n\t "):
        for shape in ("mary{g}[at]{g}example{g}(dot){g}org", "mary{g}[{g}at{g}]{g}example{g}({g}dot{g}){g}org"):
            text = "so " + shape.format(g=gap) + " it is"
            assert [text[a:b] for kind, a, b, _ in pii.personal_spans(text) if kind == "email"] == [shape.format(g=gap)]
    assert pii._AT.sub("@", "a [at] [at] b") == "a@@b" and pii._DOT.sub(".", "a  (dot)(dot) b") == "a..b"

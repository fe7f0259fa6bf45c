"""Patterns that pass over plain characters first replace what the plain classes replace, and leave plain text alone."""

import random
import re

from pyspark.sql import functions as F

from factloom.functions import text as t

SIGNS = "ab z09%-‐—−―_ ,.\u00a0\n\t\u2003\ufeff“é"


def test_plain_text_needs_no_replacement():
    # Java's \\s is ASCII, as is all that this text has.
    for pattern in (t._RUN, t._DASHED, t._SIGNS):
        assert not re.findall(pattern, "plain words of 5 single spaced lines")
    assert t.SPACE + "+" in t._RUN and "[^a-z0-9%]+" in t._SIGNS


def test_random_texts_come_out_as_by_the_plain_classes(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choices(SIGNS, k=draw.randrange(12))) for _ in range(3000)] + ["  a  ", " -  a", "a - b", "%  %", "- ", " "]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    joined = F.regexp_replace(F.lower("x"), f"[-‐-―−]{t.SPACE}+", "")
    plain = F.trim(F.regexp_replace(joined, "[^a-z0-9%]+", " "))
    tidy = F.trim(F.regexp_replace("x", t.SPACE + "+", " "))
    wrong = rows.where((t.normalize_evidence(F.col("x")) != plain) | (t.collapse_space(F.col("x")) != tidy))
    assert [r.x for r in wrong.collect()] == []

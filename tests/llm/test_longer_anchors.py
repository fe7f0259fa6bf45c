"""Windows that share only a short anchor are left out before windows are counted."""

import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm.substrings import Search, _blocks


def left(spark, texts, most):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ref", F.xxhash64("doc_id", "text"))
    search = Search(docs, 35)
    for _ in search.kinds:
        search.mark(search.anchors(places=False).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), most)
    rows = pa.RecordBatch.from_pylist([r.asDict() for r in search.docs.orderBy("doc_id").collect()])
    return sum(len(search.starts()(some, block)) for some, block in _blocks(rows))


def test_a_short_match_leaves_no_window_and_a_long_one_its_own(spark):
    short, long = ([f"s{i}" for i in range(26)], [f"l{i}" for i in range(40)])
    texts = [" ".join([f"{x}{i}" for i in range(30 + k)] + passage + [f"{x}{i}" for i in range(50, 90)]) for k, x in enumerate("ab") for passage in (short, long)]
    for most in (1 << 20, 0):
        assert left(spark, texts[::2], most) == 0
        assert 12 <= left(spark, texts[1::2], most) <= 40

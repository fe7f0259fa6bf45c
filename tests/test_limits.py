"""The streamed rate limiter against the batch form, with windows kept between micro-batches and rows in parts."""

import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from factloom.operators.stateful import rate_limited
from factloom.streaming import limits

EVENTS = "user string, at timestamp, event long"


def test_parts_of_one_key_are_not_gathered():
    read = []

    def batches():
        for n in range(5):
            read.append(n)
            columns = [["k"] * 100, list(range(n * 100, n * 100 + 100)), list(range(n * 100, n * 100 + 100)), [None] * 100, [None] * 100]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["user", "event", "_at", "opened", "hits"])

    parts = limits.admitted_parts(batches(), 50, 3)
    assert next(parts).num_rows == 100 and read == [0]
    rest = list(parts)
    assert [p.num_rows for p in rest] == [100] * 4 + [1] and rest[-1].to_pylist()[0]["opened"] == 450


def test_stream_equals_batch(spark, tmp_path):
    draw = random.Random(4)
    rows = sorted((1_700_000_000 + draw.randrange(4000), draw.choice("aaaabc"), i) for i in range(900))
    rows = [(user, at, i) for at, user, i in rows] + [(None, rows[-1][0], 1), ("a", None, 2)]
    path = str(tmp_path / "events")
    for n in range(4):
        part = spark.createDataFrame(rows[n * 226 : (n + 1) * 226], "user string, s long, event long").withColumn("at", F.timestamp_seconds("s")).drop("s")
        part.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet") and not os.path.exists(f"{tmp_path}/{name}"):
                open(f"{tmp_path}/{name}", "w").close()
                os.utime(f"{path}/{name}", (1_600_000_000 + n, 1_600_000_000 + n))
    events = spark.read.parquet(path)
    want = sorted(map(tuple, rate_limited(events, "user", "at", "event", 600, 3).collect()))
    assert len(want) == 900
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for most_bytes in (None, 1):
            found = limits.limited_files(spark, path, "user", "at", "event", 600, 3, most_bytes)
            assert found.columns == ["user", "event", "admitted", "remaining", "reset_us"]
            assert sorted(map(tuple, found.collect())) == want
            batches = {r[0] for r in found.select(F.regexp_extract(F.input_file_name(), "limit_batch(?:=|%3D)([0-9]+)", 1)).distinct().collect()}
            assert len(batches) == (4 if most_bytes else 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    none = str(tmp_path / "none")
    events.limit(0).coalesce(1).write.parquet(none)
    assert limits.limited_files(spark, none, "user", "at", "event", 600, 3).collect() == []


def test_tokens_wait_for_room_and_oversize_for_an_empty_window():
    from factloom.operators.stateful import TokenWindow

    window = TokenWindow(60_000_000, 100, 250_000)
    assert window.reserve(0, 60) == 0 and window.reserve(1_000_000, 40) == 1_000_000
    assert window.reserve(2_000_000, 50) == 60_000_000  # when the first 60 have left
    assert window.reserve(60_500_000, 30) == 61_000_000  # the 40 leave a minute after they came
    fresh = TokenWindow(60_000_000, 100, 250_000)
    assert fresh.reserve(5, 500) == 5  # too large, but the window is empty
    assert fresh.reserve(6, 1) == 60_000_005
    near = TokenWindow(60_000_000, 100, 250_000)
    near.reserve(0, 100)
    assert near.reserve(59_900_000, 1) == 60_150_000  # never waits for less than a quarter of a second


def test_closed_windows_are_not_kept(spark, tmp_path):
    """Keys that come once, and one that comes all the time: what is kept has the keys of late, and verdicts are those of one go."""
    from factloom.streaming.limits import limited_batch

    def events(hour):
        rows = [(f"once-{hour}-{i}", 1000 * hour + i, hour * 3600 + i) for i in range(20)] + [("always", 1000 * hour + 500 + i, hour * 3600 + 2 * i) for i in range(30)]
        return spark.createDataFrame(rows, "who string, n long, s long").selectExpr("who", "n", "timestamp_seconds(s) AS at")

    parts, whole = (limited_batch(str(tmp_path / x), "who", "at", "n", 60, 10) for x in ("parts", "whole"))
    for hour in range(3):
        parts(events(hour), hour)
    whole(events(0).unionByName(events(1)).unionByName(events(2)), 0)

    def verdicts(folder):
        found = spark.read.parquet(str(tmp_path / folder)).where("limit_part = 'event'")
        return sorted((r.n, r.admitted, r.remaining, r.reset_us) for r in found.collect())

    assert verdicts("parts") == verdicts("whole")
    kept = spark.read.parquet(str(tmp_path / "parts" / "limit_batch=2")).where("limit_part = 'window'")
    assert kept.count() == 21 and kept.where("who like 'once-0%'").count() == 0

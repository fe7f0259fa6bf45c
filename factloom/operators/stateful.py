"""Limits over time, leases and progress, in batch form."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.config import DEFAULTS, Config
from factloom.functions.text import stage_fraction


class FixedWindow:
    """A limit of ``most`` hits in a window that opens with its first hit; refused hits are not counted."""

    def __init__(self, width_us: int, most: int, opened: int | None = None, hits: int = 0) -> None:
        self.width, self.most, self.opened, self.hits = width_us, most, opened, hits

    def hit(self, at: int) -> tuple[bool, int, int]:
        """Whether it is admitted, the hits left, and the microseconds until the window closes."""
        if self.opened is None or at >= self.opened + self.width:
            self.opened, self.hits = at, 0
        admitted = self.hits < self.most
        self.hits += admitted
        return admitted, self.most - self.hits, self.opened + self.width - at


def rate_limited(events: DataFrame, key: str, at: str, tie: str, width_seconds: int, most: int) -> DataFrame:
    """Rows key, tie, admitted, remaining, reset_us of every event, in the order of ``at`` and ``tie`` for each key.

    Keys are dealt to tasks and sorted there; a task holds one window at a time, however many events a key has.
    """
    rows = events.select(key, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("_at")).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    rows = rows.repartition(key).sortWithinPartitions(key, "_at", tie)

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, window = object(), FixedWindow(0, 0)
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != current:
                    current, window = k, FixedWindow(width_seconds * 1_000_000, most)
                out.append(window.hit(t))
            admitted, left, reset = zip(*out, strict=True) if out else ((), (), ())
            columns = [batch.column(0), batch.column(1), pa.array(admitted, pa.bool_()), pa.array(left, pa.int32()), pa.array(reset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, tie, "admitted", "remaining", "reset_us"])

    types = dict(events.dtypes)
    return rows.mapInArrow(admit, f"{key} {types[key]}, {tie} {types[tie]}, admitted boolean, remaining int, reset_us long")


def window_spend(events: DataFrame, key: str, at: str, cost: str, seconds: int = 60) -> DataFrame:
    """``events`` with ``spent``: the key's costs in the ``seconds`` up to each event, itself included."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    span = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("_at", micros).withColumn("spent", F.sum(cost).over(span)).drop("_at")


class TokenWindow:
    """A budget of ``most`` tokens in any ``width_us``; what does not fit waits, and what is too large waits for an empty window."""

    def __init__(self, width_us: int, most: int, least_wait_us: int = 250_000) -> None:
        self.width, self.most, self.least = width_us, most, least_wait_us
        self.spent: deque[tuple[int, int]] = deque()
        self.used, self.last = 0, 0

    def reserve(self, at: int, tokens: int) -> int:
        """The moment at which a request that comes ``at`` a moment is let through, after those before it."""
        now = max(at, self.last)
        while True:
            while self.spent and self.spent[0][0] <= now - self.width:
                self.used -= self.spent.popleft()[1]
            if self.used + tokens <= self.most or not self.spent:
                self.spent.append((now, tokens))
                self.used, self.last = self.used + tokens, now
                return now
            now += max(self.least, self.spent[0][0] + self.width - now)


def token_limited(requests: DataFrame, key: str, at: str, tie: str, cost: str, most: int, seconds: int = 60, least_wait_us: int = 250_000) -> DataFrame:
    """Rows key, tie, admitted_us, waited_us of every request, in the order of ``at`` and ``tie`` for each key.

    Keys are dealt to tasks and sorted there; a task holds what one key spent in one window.
    """
    rows = requests.select(key, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col(cost).cast("long").alias("_cost"))
    rows = rows.where(F.col(key).isNotNull() & F.col("_at").isNotNull() & F.col("_cost").isNotNull()).repartition(key).sortWithinPartitions(key, "_at", tie)

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, window = object(), TokenWindow(0, 0)
        for batch in batches:
            keys, times, costs = (batch.column(k).to_pylist() for k in (0, 2, 3))
            out = []
            for k, t, c in zip(keys, times, costs, strict=True):
                if k != current:
                    current, window = k, TokenWindow(seconds * 1_000_000, most, least_wait_us)
                out.append(window.reserve(t, c))
            waited = [a - t for a, t in zip(out, times, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64()), pa.array(waited, pa.int64())], names=[key, tie, "admitted_us", "waited_us"])

    types = dict(requests.dtypes)
    return rows.mapInArrow(admit, f"{key} {types[key]}, {tie} {types[tie]}, admitted_us long, waited_us long")


def leases(heartbeats: DataFrame, key: str, at: str, now: str | None = None, config: Config = DEFAULTS) -> DataFrame:
    """Rows key, last_beat, stale: whether a lease's last heartbeat is older than the lease (as of ``now`` or the last beat of all)."""
    moment = F.lit(now if now else heartbeats.agg(F.max(at)).first()[0]).cast("timestamp")
    silent = F.unix_micros(moment) - F.unix_micros(F.col("last_beat").cast("timestamp"))
    last = heartbeats.groupBy(key).agg(F.max(at).alias("last_beat"))
    return last.withColumn("stale", silent > config.lease_seconds * 1_000_000)


# Parts of the progress bar by the stage's name, the first that fits.
STAGES = (
    ("waiting", 0, 2, "queued"), ("parsing", 2, 6, "parsing"), ("embedding chunks", 6, 12, "embedding"), ("primary entity", 12, 14, "identifying"),
    ("extracting", 14, 86, "extracting"), ("embedding facts", 86, 91, "embedding facts"), ("matching", 91, 99, "matching"),
)


def progress(documents: DataFrame, now: str) -> DataFrame:
    """``documents`` (status, stage, chunk_count, processed, started_at, finished_at) with percent, stage_key, elapsed and ETA in seconds."""
    total = F.coalesce("chunk_count", F.lit(0))
    done = F.least(F.coalesce("processed", F.lit(0)), total)
    stage = F.lower(F.coalesce("stage", F.lit("")))
    share = F.try_divide(done.cast("double"), total.cast("double"))
    percent, key = F.lit(2.0), F.lit("processing")
    for pattern, low, high, name in reversed(STAGES):
        part = F.coalesce(stage_fraction(F.col("stage")), F.lit(0.0))
        part = F.coalesce(share, part) if name == "extracting" else part
        fits = stage.contains(pattern)
        percent = F.when(fits, F.floor(low + (high - low) * part + 0.5)).otherwise(percent)
        key = F.when(fits, name).otherwise(key)
    status = F.col("status")
    moment = F.unix_micros(F.lit(now).cast("timestamp"))
    started = F.unix_micros(F.col("started_at").cast("timestamp"))
    ended = F.coalesce(F.unix_micros(F.col("finished_at").cast("timestamp")), moment)
    rows = documents.withColumns({
        "processed_chunks": done,
        "remaining_chunks": F.greatest(F.lit(0), total - done),
        "stage_key": F.when(status == "processed", "done").when(status == "failed", "failed").when(status == "processing", key).otherwise("queued"),
        "percent": F.when(status == "processed", 100.0).when(status == "failed", F.coalesce(F.floor(share * 86 + 0.5), F.lit(0))).when(status == "processing", percent).otherwise(0.0).cast("int"),
        "elapsed_seconds": F.greatest(F.lit(0), F.floor((ended - started) / 1e6 + 0.5)).cast("long"),
    })
    eta = F.floor((moment - started) / 1e6 / F.col("processed_chunks") * F.col("remaining_chunks") + 0.5).cast("long")
    going = (F.col("stage_key") == "extracting") & (F.col("processed_chunks") > 0) & (F.col("remaining_chunks") > 0) & F.col("started_at").isNotNull()
    return rows.withColumn("eta_seconds", F.when(going, eta))

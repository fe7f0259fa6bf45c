"""The rate limiter as a stream that keeps each key's open window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.stateful import FixedWindow
from factloom.sources.tables import scratch

FOUND = ["admitted", "remaining", "reset_us", "opened", "hits", "limit_part"]


def admitted_parts(batches: Iterator[pa.RecordBatch], width_us: int, most: int) -> Iterator[pa.RecordBatch]:
    """Events with their verdicts, and each key's window after its last event, for rows key, tie, at, opened, hits by key and ``at``.

    A key's row without ``at`` comes first and holds the window that is open already. One part is written for each
    one read, before the next is asked for; only one window is held.
    """
    window: FixedWindow | None = None
    current, types = None, None

    def part(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*types, pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*names, *FOUND])

    def kept() -> tuple:
        return current, None, None, None, None, window.opened, window.hits, "window"

    for batch in batches:
        types, names = [batch.schema.field(0).type, batch.schema.field(1).type], batch.schema.names[:2]
        rows = []
        for key, tie, at, opened, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if window is None or key != current:
                if window is not None:
                    rows.append(kept())
                current, window = key, FixedWindow(width_us, most)
            if at is None:
                window.opened, window.hits = opened, hits
            else:
                rows.append((key, tie, *window.hit(at), None, None, "event"))
        yield part(rows)
    if window is not None:
        yield part([kept()])


def limited_batch(target: str, key: str, at: str, tie: str, width_seconds: int, most: int) -> Callable[[DataFrame, int], None]:
    """What writes one micro-batch: its events with admitted, remaining and reset_us, and all keys' windows after it.

    Windows come from the folder of the micro-batch before, and a micro-batch repeated after a failure overwrites
    its own. Windows that closed before the earliest event of the micro-batch are left out, so what is kept has the keys
    seen of late, not all that were ever seen. Spark sorts, and spills, the rows of a task; Python sees them in parts,
    however many a key has.
    """

    def write(batch: DataFrame, number: int) -> None:
        types = dict(batch.dtypes)
        rows = batch.select(key, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.lit(None).cast("long").alias("opened"), F.lit(None).cast("int").alias("hits"))
        rows = rows.where(F.col(key).isNotNull() & F.col("_at").isNotNull())
        written = f"{key} {types[key]}, {tie} {types[tie]}, admitted boolean, remaining int, reset_us long, opened long, hits int, limit_part string"
        if number:
            least = rows.agg(F.min("_at")).first()[0]
            before = batch.sparkSession.read.schema(written).parquet(f"{target}/limit_batch={number - 1}").where("limit_part = 'window'")
            if least is not None:
                before = before.where(F.col("opened") + width_seconds * 1_000_000 > least)
            rows = rows.unionByName(before.select(key, tie, F.lit(None).cast("long").alias("_at"), "opened", "hits"))
        rows = rows.repartition(F.col(key)).sortWithinPartitions(F.col(key), F.col("_at").asc_nulls_first(), F.col(tie))
        out = rows.mapInArrow(lambda batches: admitted_parts(batches, width_seconds * 1_000_000, most), written)
        out.write.mode("overwrite").partitionBy("limit_part").parquet(f"{target}/limit_batch={number}")

    return write


def limited_files(
    spark: SparkSession, source: str, key: str, at: str, tie: str, width_seconds: int, most: int, most_bytes: int | None = None
) -> DataFrame:
    """The limiter over all event files under ``source``, as one available-now run.

    Within a micro-batch events go by ``at`` and ``tie``, across micro-batches in the order of arrival. With
    ``most_bytes`` a micro-batch takes files, oldest first, up to that size, which is right only if no event is
    earlier than those of older files; without, one takes all files, whatever their order.
    """
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    if most_bytes:
        reader = reader.option("maxBytesPerTrigger", str(most_bytes))
    stream = reader.parquet(f"{source[:-1]}[{source[-1]}]").select(key, at, tie)
    target, checkpoint = scratch(spark, "limited"), scratch(spark, "stream")
    query = stream.writeStream.foreachBatch(limited_batch(target, key, at, tie, width_seconds, most))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    types = dict(stream.dtypes)
    written = f"{key} {types[key]}, {tie} {types[tie]}, admitted boolean, remaining int, reset_us long, limit_batch int, limit_part string"
    found = spark.read.schema(written).parquet(target)
    return found.where("limit_part = 'event'").select(key, tie, "admitted", "remaining", "reset_us")

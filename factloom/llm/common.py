"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more rows than this are spread over several tasks.
CROWD = 10_000
#: The most rows of a list of crowded keys that is broadcast; a longer one is joined by a shuffle.
LISTED = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Where the session names none, a local session (one machine, as in tests) gets a temporary folder; on a cluster it
    is an error, as executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("factloom.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("factloom.shared.dir", named)
    return named.rstrip("/")


#: The most bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Holds the Arrow batches of the session to BATCH_BYTES, unless it has a lower bound of its own: workers copy a batch several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "2147483646b").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage: a lost executor never causes more than the current step to be recomputed.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` from which nothing will be read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crowded(rows: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """keys and ``salts``: the keys with more than ``most`` (CROWD) rows, and over how many parts to spread each.

    It comes with a broadcast hint only if it was counted and found short.
    """
    most = most or CROWD
    hot = rows.groupBy(*keys).agg(F.count("*").alias("salts")).where(F.col("salts") > most)
    hot = materialize(hot.select(*keys, F.ceil(F.col("salts") / most).cast("int").alias("salts")), "crowded")
    return F.broadcast(hot) if hot.count() <= LISTED else hot


def dealt(rows: DataFrame, hot: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """``rows`` with ``_salt``: rows of a crowded key are dealt to its parts by ``spread`` (a long), others to part 0."""
    salts = F.coalesce("salts", F.lit(1))
    return rows.join(hot, keys, "left").withColumn("_salt", F.pmod(spread, salts).cast("int")).drop("salts")


def copied(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, few to a key, once for each part of their key, as ``_salt``."""
    parts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    return rows.join(hot, keys, "left").withColumn("_salt", F.explode(parts)).drop("salts")


#: Slots of a filter by hashes; it is a table of at most 2 ** (SLOTS - 6) words of 64, whatever is put into it.
SLOTS = 24


def hash_filter(hashes: DataFrame) -> DataFrame:
    """``_word`` and ``_bits`` of a filter that all hashes of ``hashes`` (one long column) pass; of bounded size, so it is broadcast."""
    slot = F.pmod(F.col(hashes.columns[0]), F.lit(1 << SLOTS))
    words = hashes.select(F.shiftright(slot, 6).cast("int").alias("_word"), F.expr("1L").alias("one"), F.pmod(slot, F.lit(64)).cast("int").alias("place"))
    return materialize(words.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(one, place)")).alias("_bits")), "filter")


def passing(rows: DataFrame, words: DataFrame, h: Column, pass_: bool = True) -> DataFrame:
    """The rows whose hash ``h`` may be in the filter; or (not ``pass_``) those whose hash is surely not."""
    slot = F.pmod(h, F.lit(1 << SLOTS))
    marked = rows.withColumn("_word", F.shiftright(slot, 6).cast("int")).join(F.broadcast(words), "_word", "left")
    there = F.coalesce(F.expr("bit_get(_bits, _place)"), F.lit(0).cast("tinyint")) == 1
    marked = marked.withColumn("_place", F.pmod(slot, F.lit(64)).cast("int")).where(there if pass_ else ~there)
    return marked.drop("_word", "_bits", "_place")


def hash_bits(hashes: DataFrame, log2: int) -> np.ndarray:
    """A bitmap of ``2 ** log2`` slots in which all hashes of ``hashes`` (one long column) are marked.

    It is put together by an aggregate in pieces of 4 KB; its size is fixed, whatever is put into it.
    """
    slot = F.pmod(F.col(hashes.columns[0]), F.lit(1 << log2)) + 1
    pieces = hashes.groupBy(F.bitmap_bucket_number(slot).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(max(4096, 1 << (log2 - 3)), dtype=np.uint8)
    for r in pieces.toLocalIterator():
        at = (r["piece"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def has_bits(bits: np.ndarray, hashes: np.ndarray, log2: int) -> np.ndarray:
    """Which of the hashes (as unsigned) may be in a bitmap of ``hash_bits``; all that are in it, and some others."""
    slot = hashes & np.uint64((1 << log2) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_or(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n+1 offsets; nulls have length 0."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def texts_of(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """The texts of a string column (null: empty) in runs of rows with at most ``limit`` bytes together, and each run's first row."""
    for i, j in blocks_of(utf8_views(column)[1], limit):
        yield i, [x or "" for x in column.slice(i, j - i).to_pylist()]


def blocks_of(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes together; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)

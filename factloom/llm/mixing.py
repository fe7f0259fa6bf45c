"""Mixing sources to target weights along a time-varying curriculum.

A source's share of the mixture may rise or fall over the training run t in [0, 1]: its rate is its target
times 1 + slope * (2t - 1). The integral, (1 - slope) * t + slope * t * t times the target, is its cumulative
demand; a document takes the position at which the demand reaches the words ahead of it in its source's
order (by a hash of doc_id). A source whose target exceeds its size is read again from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import copied, crowded, dealt, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a range of training positions that one task sorts, and the most ranges.
RANGE_WORDS, MOST_RANGES = 4_000_000, 100_000


def source_targets(sized: DataFrame, weights: tuple[int, ...], total: float, most: float) -> DataFrame:
    """One row for each source: source, source_size, rows, number (from 0, by code point, null last), target.

    Targets share ``total`` times all sizes by weight; none exceeds ``most`` times its source's size. With
    sources in the order of size to weight, the level of the others follows from running sums.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("number", F.row_number().over(order) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    full = Window.orderBy("ratio", "number")
    ahead = F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    by = by.withColumn("level", (total * everything - ahead) / rest).withColumn("at", F.row_number().over(full))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(Window.partitionBy())["level"]
    target = F.least("cap", F.coalesce(first * F.col("weight"), "cap"))
    return by.select("source", "source_size", "rows", "number", target.alias("target"))


def curriculum(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    slopes: tuple[float, ...] = (0.0, 0.5, -0.5),
    total: float = 1.5,
    most: int = 2,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, passes, taken, positions.

    ``size`` counts words; sources take ``weights`` and ``slopes`` in turn by code point, null last. The mix
    reads a document ``passes`` times (at most ``most``): pass p is read if the middle of the document, p
    source sizes on, lies before the source's target. ``taken`` is size times passes, ``positions`` has the
    position of each pass, from 0 to 1.

    Null, empty and blank texts have size 0 and are read with what stands around them. Rows that share a doc_id (or
    have none) stand next to each other, the shorter ones first; rows that agree in doc_id, source and size take
    places of their own, counted in the parts of the table that hold them, so that very many of them never meet in one
    task. Further columns are ignored, also such with the names of results. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    slim = docs.select("doc_id", "source", size.alias("size"), order.alias("order"), F.spark_partition_id().alias("part"))
    slim = materialize(slim, "sizes")
    targets = materialize(source_targets(slim, weights, total, most), "targets")
    few = F.greatest(F.lit(256), F.ceil(F.sum("rows").over(Window.partitionBy()) / 20_000))
    buckets = targets.withColumn("buckets", F.ceil(F.col("rows") / few)).withColumnRenamed("source", "_source").drop("rows")
    rows = slim.join(buckets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # Equal rows as one: how many there are in each part, and in the parts before it.
    alike, earlier = ["number", "order", "size"], (Window.unboundedPreceding, -1)
    runs = rows.groupBy(*alike, "buckets", "part").agg(F.count("*").alias("n"))
    runs = runs.withColumn("prior", F.coalesce(F.sum("n").over(Window.partitionBy(*alike, "buckets").orderBy("part").rowsBetween(*earlier)), F.lit(0)))
    # Words before each group of equal rows: of the buckets before its own (by the share of its hash), and in it.
    share = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    groups = runs.groupBy(*alike, "buckets").agg((F.sum("n") * F.col("size")).alias("words"))
    groups = groups.withColumn("bucket", F.floor(share * F.col("buckets"))).drop("buckets")
    ahead = groups.groupBy("number", "bucket").agg(F.sum("words").alias("w"))
    ahead = ahead.select("number", "bucket", F.coalesce(F.sum("w").over(Window.partitionBy("number").orderBy("bucket").rowsBetween(*earlier)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("number", "bucket").orderBy("order", "size").rowsBetween(*earlier)
    groups = groups.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(ahead, ["number", "bucket"])
    starts = runs.join(groups.select(*alike, (F.col("ahead") + F.col("inside")).alias("start")), alike)
    starts = starts.select(*alike, "part", (F.col("start") + F.col("prior") * F.col("size")).alias("start"))

    own = F.row_number().over(Window.partitionBy(*alike, "part").orderBy("doc_id")) - 1
    placed = rows.withColumn("own", own).join(starts, [*alike, "part"])
    placed = placed.withColumn("middle", F.col("start") + F.col("own") * F.col("size") + F.col("size") / 2)
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("number") % len(slopes) + 1).cast("int"))
    reads = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.col("middle") + p * F.col("source_size")),
        lambda x: x < F.col("target"),
    )
    placed = placed.withColumn("slope", slope).withColumn("reads", reads).withColumn("passes", F.size("reads"))
    # The demand (1 - slope) * t + slope * t * t, solved for t without a division by a slope of 0.
    flat = 1 - F.col("slope")
    positions = F.transform(
        "reads",
        lambda x: 2 * (x / F.col("target")) / (flat + F.sqrt(flat * flat + 4 * F.col("slope") * (x / F.col("target")))),
    )
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "passes",
        (F.col("size") * F.col("passes")).alias("taken"), positions.alias("positions"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each pass of each document, with its ``position``, range-sorted by it."""
    reads = mixed.withColumn("position", F.explode("positions")).drop("positions", "passes", "taken")
    return reads.orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame, **mixture: object) -> DataFrame:
    """The rows of ``docs``, all columns, once for each pass of the mixture, range-sorted by training position.

    Rows that agree in all columns share the passes of all of them, so each is read as often as the mixture says; a null
    doc_id does no harm. Positions lie in [0, 1] with nearly even density, so that partition p of the result holds the
    p-th of equal ranges of positions, and its rows are sorted.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "source", "text").withColumn("key", F.xxhash64("row"))
    mixed = curriculum(keyed.select(F.col("key").alias("doc_id"), "source", "text"), **mixture)
    reads = materialize(mixed.select(F.col("doc_id").alias("key"), "size", F.explode("positions").alias("position")), "reads")
    words = reads.agg(F.sum("size")).first()[0] or 0
    hot = crowded(reads, ["key"])
    one, keys = keyed.select("key", "row").dropDuplicates(["key"]), ["key"]
    if hot.head(1):
        one, reads, keys = copied(one, hot, keys), dealt(reads, hot, keys, F.xxhash64("position")), ["key", "_salt"]
    ranges = max(1, min(MOST_RANGES, words // RANGE_WORDS))
    rows = one.join(reads, keys).select("row", "key", "position")
    at = F.least(F.floor(F.col("position") * ranges), F.lit(ranges - 1)).cast("int")
    return rows.repartitionById(ranges, at).sortWithinPartitions("position", "key").select("row.*")

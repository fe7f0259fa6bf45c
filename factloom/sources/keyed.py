"""Parquet tables laid out by the hash of a key, of which a write touches only the buckets it must."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def removed(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


class KeyedTable:
    """Rows of ``schema`` under ``path``, in folders by the hash of their ``layout`` columns.

    A row is named by its ``identity`` columns. A change is first staged: the buckets it touches are written whole, as they
    will be, to a folder of its own. Putting it in place then overwrites just these buckets, and may be repeated after a failure
    at any point, as it only copies. All other files stay as they are. A touched bucket keeps a row of nulls, so that
    one from which all else is gone is overwritten like any other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, layout: list[str], identity: list[str], buckets: int = 32) -> None:
        self.spark, self.path, self.layout, self.identity, self.buckets = spark, path, layout, identity, buckets
        self.schema = f"{schema}, bucket int"
        self.columns = spark.createDataFrame([], schema).columns

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.layout), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        if exists(self.spark, self.path):
            return self.spark.read.schema(self.schema).parquet(self.path)
        return self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._stored().where(F.col(self.layout[0]).isNotNull()).select(*self.columns)

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets of these keys; there are at most ``buckets``."""
        found = keys[0].select(self.bucket().alias("b"))
        for rows in keys[1:]:
            found = found.union(rows.select(self.bucket()))
        return sorted(r["b"] for r in found.distinct().collect())

    def _within(self, buckets: list[int]) -> DataFrame:
        rows = self._stored().where(F.col("bucket").isin(buckets))
        return rows.where(F.col(self.layout[0]).isNotNull()).select(*self.columns)

    def having(self, keys: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """The rows whose layout columns are among ``keys``; only their buckets (if known, given) are read."""
        return self._within(self.touched(keys) if buckets is None else buckets).join(keys.select(*self.layout).distinct(), self.layout, "left_semi")

    def staged(self, folder: str, rows: DataFrame, gone: DataFrame, buckets: list[int] | None = None) -> list[int]:
        """Writes to ``folder`` what the touched buckets hold once ``rows`` have replaced those of their identity and ``gone`` (layout
        and some identity columns) are no more. Gives these buckets; ``rows`` and ``gone`` are read more than once."""
        touched = self.touched(rows, gone) if buckets is None else buckets
        rows = rows.select(*self.columns)
        kept = self._within(touched).join(gone.distinct(), gone.columns, "left_anti").join(rows.select(*self.identity).distinct(), self.identity, "left_anti")
        marks = self.spark.createDataFrame([(x,) for x in touched], "bucket int")
        whole = kept.unionByName(rows).withColumn("bucket", self.bucket()).unionByName(marks, allowMissingColumns=True)
        # One file to a bucket, more where a bucket is very large.
        whole.hint("rebalance", F.col("bucket")).write.mode("overwrite").parquet(folder)
        return touched

    def put(self, folder: str) -> None:
        """Puts what was staged in ``folder`` in place."""
        rows = self.spark.read.schema(self.schema).parquet(folder)
        out = rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("bucket").parquet(self.path)

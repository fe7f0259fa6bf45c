"""Reading pages from files and tables; keyed replacement and deletion on plain Parquet."""

from __future__ import annotations

import html
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_FILES = 200 << 20, 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files give fewer tasks than there are cores, dealt to as many; others stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share, under the session's spark.checkpoint.dir; a local session without it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("factloom.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("factloom.scratch.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows written to a new shared folder and read back, so that what follows starts from a table."""
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def admitted_files(files: DataFrame) -> DataFrame:
    """PDF files of 1 byte to 200 MiB, by name, length and (where there is one) mimetype."""
    rows = files.where(F.lower("path").endswith(".pdf") & F.col("length").between(1, MOST_BYTES))
    return rows.where("mimetype = 'application/pdf'") if "mimetype" in files.columns else rows


def admitted_requests(files: DataFrame) -> DataFrame:
    """Admitted files of requests (request_id, path, length, mimetype) of at most 20 files; a larger request is refused whole."""
    sizes = files.groupBy("request_id").agg(F.count("*").alias("_n")).where(F.col("_n") <= MOST_FILES)
    return admitted_files(files.join(sizes.drop("_n"), "request_id", "left_semi"))


def pages_from_files(spark: SparkSession, path: str, parse: Callable[[bytes], list[tuple[int, str]]], pattern: str = "*.pdf") -> DataFrame:
    """Rows path, page_number, text of the files under ``path``, by a parser of one file's bytes."""
    files = admitted_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, t.strip()) for p, c in zip(batch.path, batch.content, strict=True) for n, t in parse(c)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, page_number int, text string")


_PDF_TEXT = re.compile(rb"\(((?:\\.|[^()\\])*)\)\s*Tj|\[((?:\\.|[^\]\\])*)\]\s*TJ")
_PDF_PIECE = re.compile(rb"\(((?:\\.|[^()\\])*)\)")


def plain_pdf_pages(content: bytes) -> list[tuple[int, str]]:
    """Pages of uncompressed PDFs only (shown strings of each content stream); others need a parser plugged in."""
    pages = []
    for stream in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", content, re.DOTALL):
        shown = []
        for one, many in _PDF_TEXT.findall(stream):
            parts = [one] if one else _PDF_PIECE.findall(many)
            shown.append("".join(re.sub(rb"\\([()\\])", rb"\1", x).decode("latin-1") for x in parts))
        if shown:
            pages.append((len(pages) + 1, " ".join(shown)))
    return pages or [(1, "")]


def html_text(column: Column) -> Column:
    """The readable text of a web page: no scripts, styles, comments or tags."""
    bare = F.regexp_replace(column, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name in ("lt", "gt", "quot", "#39", "nbsp", "amp"):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(html.unescape(f"&{name};").replace("\xa0", " ")))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def replaced_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys that ``new`` has, and ``new``: an upsert, or a replacement of a key's rows."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def without_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of documents that are not among ``gone`` (document_id)."""
    return rows.join(gone.select("document_id").distinct(), "document_id", "left_anti").select(*rows.columns)


def without_facts(relationships: DataFrame, gone: DataFrame) -> DataFrame:
    """Relationships with neither end among ``gone`` (fact_id)."""
    ids, columns = gone.select("fact_id").distinct(), relationships.columns
    for end in ("fact_a", "fact_b"):
        relationships = relationships.join(ids.withColumnRenamed("fact_id", end), end, "left_anti")
    return relationships.select(*columns)

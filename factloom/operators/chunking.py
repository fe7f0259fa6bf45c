"""Pages cut into chunks of whole words, and batches of chunks for a model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import DEFAULTS, Config
from factloom.functions.text import collapse_space, estimated_tokens


def cut_words(text: str, most: int) -> list[str]:
    """As many whole words as fit ``most`` characters, again and again; a longer word stands alone."""
    out, start, size = [], 0, len(text)
    while start < size:
        if size - start <= most:
            end = size
        else:
            end = text.rfind(" ", start, start + most + 1)
            if end <= start:
                end = text.find(" ", start + most)
                end = size if end < 0 else end
        out.append(text[start:end])
        start = end + 1
    return out


def chunk_pattern(most: int) -> str:
    """What ``cut_words`` cuts, as a pattern over text with single spaces: as many whole words as fit, or one that is longer."""
    return rf"(?s)[^ ].{{0,{most - 1}}}(?= |\z)|[^ ]+"


def chunks(pages: DataFrame, document: str = "document_id", page: str = "page_number", text: str = "text", most: int | None = None) -> DataFrame:
    """Rows document_id, page_number, chunk_index, chunk_id, text, n_chars, token_count, status of all pages.

    White space is collapsed first; blank pages have no chunk. Short chunks without a digit are 'skipped', others
    'pending'. One row becomes its chunks in place, without a shuffle.
    """
    limit = most or DEFAULTS.max_chunk_characters
    tidy = collapse_space(F.coalesce(F.col(text), F.lit("")))
    rows = pages.select(F.col(document).alias("document_id"), F.col(page).alias("page_number"), tidy.alias("_text"))
    rows = rows.select("document_id", "page_number", F.posexplode(F.regexp_extract_all("_text", F.lit(chunk_pattern(limit)), F.lit(0))).alias("chunk_index", "text"))
    return rows.select(
        "document_id",
        "page_number",
        "chunk_index",
        F.concat_ws("_", F.lit("chunk"), "document_id", "page_number", "chunk_index").alias("chunk_id"),
        "text",
        F.length("text").alias("n_chars"),
        F.size(F.split("text", " ")).alias("token_count"),
        F.when(is_trivial(F.col("text")), "skipped").otherwise("pending").alias("status"),
    )


def is_trivial(text: Column, config: Config = DEFAULTS) -> Column:
    return (F.length(text) < config.min_extraction_characters) & ~text.rlike("[0-9]")


def fill_batches(costs: np.ndarray, most_items: int, most_tokens: int) -> np.ndarray:
    """The batch of each item in turn; a batch closes when it is full or the next item would burst it. One step a batch, not an item."""
    ends, out, start, batch = np.cumsum(costs), np.zeros(len(costs), dtype=np.int32), 0, 0
    while start < len(costs):
        before = int(ends[start - 1]) if start else 0
        stop = min(start + most_items, int(np.searchsorted(ends, before + most_tokens, side="right")))
        stop = max(stop, start + 1)  # an item that bursts any batch stands alone
        out[start:stop] = batch
        start, batch = stop, batch + 1
    return out


def token_batches(pages: DataFrame, document: str, text: str, most: int, config: Config = DEFAULTS) -> DataFrame:
    """Rows document_id, chunk_index, cost, batch: a document's chunks of ``most`` characters in batches for embedding.

    Spark cuts the chunks and counts their tokens; only these numbers go to Python.
    """

    @F.pandas_udf("array<int>")
    def filled(costs: pd.Series) -> pd.Series:
        return costs.map(lambda x: fill_batches(np.asarray(x), config.embedding_batch_size, config.embedding_batch_tokens))

    tidy = collapse_space(F.coalesce(F.col(text), F.lit("")))
    pieces = F.regexp_extract_all(tidy, F.lit(chunk_pattern(most)), F.lit(0))
    rows = pages.select(F.col(document).alias("document_id"), F.transform(pieces, lambda x: (F.ceil(F.length(x) / 4) + 8).cast("long")).alias("costs"))
    rows = rows.withColumn("batches", filled("costs"))
    return rows.select("document_id", F.posexplode(F.arrays_zip("costs", "batches")).alias("chunk_index", "x")).select(
        "document_id", "chunk_index", F.col("x.costs").alias("cost"), F.col("x.batches").alias("batch")
    )


def numbered_batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """``rows`` with ``batch``: runs of ``size`` rows of a group in order."""
    from pyspark.sql import Window

    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size).cast("int"))


def token_totals(pages: DataFrame, group: str, text: str) -> DataFrame:
    return pages.groupBy(group).agg(F.sum(estimated_tokens(F.col(text))).alias("tokens"), F.count("*").alias("items"))

"""Reconciled relationships kept up to date as page files come in: one stream from new pages to what they change.

State lies in five keyed tables: chunks and an index of facts by document, facts, their nearest facts and relationships by
group. A group is a workspace, a normalised subject and a normalised metric: facts are only ever related within one. A
micro-batch takes the last version of each document it holds, cuts and extracts it, and compares the facts found with the
index: facts that are as they were drop out. Of the groups that the others touch,

- new facts, and stored ones that have lost one of their nearest, meet all facts of their group;
- all other stored facts meet the new ones only, and merge what they find into the nearest they had;
- relationships are decided anew from the nearest facts.

The result is that of one run over all documents in their last version. Groups that nothing touches are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.config import DEFAULTS, Config
from factloom.functions.text import blank_to_null, normalize_evidence
from factloom.models import Extractor, embed, extract_facts, rule_extractor
from factloom.operators import chunking, facts, pairs, reconcile, vectors
from factloom.sources.keyed import KeyedTable, exists, removed
from factloom.sources.tables import stored

PAGE = "document_id string, owner string, page_number int, text string"
_KINDS = {"page_number": "int", "value_num": "double", "confidence": "double", "normalized_value": "double", "normalized_percentage": "double"}
_FACT = ", ".join(f"{c} {_KINDS.get(c, 'string')}" for c in reconcile.FACT_COLUMNS)
SCHEMAS = {
    "chunks": "document_id string, page_number int, chunk_index int, chunk_id string, text string, status string",
    "known": "document_id string, fact_id string, fact_group string, digest long",
    "facts": f"fact_group string, owner string, {_FACT}, embedding array<double>",
    "matches": "fact_group string, fact_id string, candidate_id string, similarity double, rank int",
    "relationships": "fact_group string, owner string, fact_a string, fact_b string, document_a string, document_b string, relationship_type string, reason string, context string,"
    " confidence double, similarity double, percentage_difference double",
}


def page_facts(chunks: DataFrame, owners: DataFrame, extractor: Extractor = rule_extractor) -> DataFrame:
    """Valid, normalised facts of chunks with their group and vector; ``owners`` has each document's owner."""
    # Chunks are few rows with much work each, so files alone would give too few tasks.
    found = extract_facts(chunks.repartition(chunks.sparkSession.sparkContext.defaultParallelism), extractor).withColumns({c: F.lit(None).cast("string") for c in ("object", "value_type", "page_id")})
    found = found.withColumn("value_num", F.lit(None).cast("double"))
    place = F.concat_ws("\x1f", "chunk_id", "subject", "predicate", "value_text", "period", "scope", "source_text")
    found = found.withColumn("fact_id", F.concat(F.lit("fact-"), F.md5(place))).dropDuplicates(["fact_id"])
    # A chunk is normalised once, not once for each of its facts.
    texts = chunks.select("chunk_id", normalize_evidence(F.col("text")).alias("chunk_text"))
    candidates = found.join(texts, "chunk_id").join(owners, "document_id")
    valid, _ = facts.split_candidates(candidates, plain=True)
    rows = facts.normalize_facts(valid)
    named = blank_to_null(F.col("normalized_subject")).isNotNull() & blank_to_null(F.col("normalized_predicate")).isNotNull()
    group = F.when(named, F.concat_ws("\x1f", "owner", "normalized_subject", "normalized_predicate")).otherwise(F.concat(F.lit("\x1f"), "fact_id"))
    return rows.withColumns({"fact_group": group, "embedding": embed(facts.match_text())})


@dataclass
class Maintained:
    """The state under ``root`` and the steps that keep it up to date."""

    spark: SparkSession
    root: str
    extractor: Extractor = rule_extractor
    config: Config = DEFAULTS
    most_characters: int = DEFAULTS.max_chunk_characters
    buckets: int = 32
    tables: dict[str, KeyedTable] = field(init=False)

    def __post_init__(self) -> None:
        by = {"chunks": (["document_id"], ["document_id", "chunk_id"]), "known": (["document_id"], ["document_id", "fact_id"]), "facts": (["fact_group"], ["fact_group", "fact_id"]),
              "matches": (["fact_group"], ["fact_group", "fact_id", "candidate_id"]), "relationships": (["fact_group"], ["fact_group", "fact_a", "fact_b"])}
        self.tables = {name: KeyedTable(self.spark, f"{self.root}/{name}", SCHEMAS[name], *by[name], self.buckets) for name in SCHEMAS}

    def _nearest(self, queries: DataFrame, candidates: DataFrame) -> DataFrame:
        """fact_group, fact_id, candidate_id, similarity of the nearest of a fact's own group."""
        q, c = (x.select("fact_id", F.col("fact_group").alias("owner"), "embedding") for x in (queries, candidates))
        found = vectors.similar(q, c, self.config.match_top_k)
        return found.join(queries.select("fact_id", "fact_group"), "fact_id").select("fact_group", "fact_id", "candidate_id", "similarity")

    def _ranked(self, found: DataFrame) -> DataFrame:
        order = Window.partitionBy("fact_group", "fact_id").orderBy(F.desc("similarity"), "candidate_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.config.match_top_k)

    def _decided(self, matches: DataFrame, rows: DataFrame) -> DataFrame:
        """The relationships that follow from nearest facts."""
        near = pairs.candidate_pairs(matches.select("fact_id", "candidate_id", "similarity", "rank"), rows, self.config)
        out = reconcile.reconciled(near, self.config).join(rows.select(F.col("fact_id").alias("fact_a"), "fact_group", "owner"), "fact_a")
        return out.select(
            "fact_group", "owner", "fact_a", "fact_b", F.col("a.document_id").alias("document_a"), F.col("b.document_id").alias("document_b"),
            "relationship_type", "reason", "context", "confidence", "similarity", "percentage_difference",
        )

    def stage(self, pages: DataFrame, folder: str) -> None:
        """Writes to ``folder`` all buckets that ``pages`` change, as they will be, and how many rows of each kind that took.

        ``pages`` has one version of each document, whole; null texts stand for pages that are gone, and a document of only
        such pages is gone with all that came from it.
        """
        t = self.tables
        pages = stored(pages, "pages")
        changed = pages.select("document_id").distinct()
        chunks = stored(chunking.chunks(pages.where("text IS NOT NULL"), most=self.most_characters), "chunks")
        found = page_facts(chunks, pages.groupBy("document_id").agg(F.min("owner").alias("owner")), self.extractor)
        own = [c for c in t["facts"].columns if c != "embedding"]
        found = stored(found.select(*t["facts"].columns).withColumn("digest", F.xxhash64(*own)), "found")
        by_document = t["known"].touched(changed)
        before = stored(t["known"].having(changed, by_document), "before")
        same = ["document_id", "fact_id", "digest"]
        fresh = stored(found.join(before.select(*same), same, "left_anti"), "fresh")
        gone = stored(before.join(found.select(*same), same, "left_anti"), "gone")
        groups = stored(fresh.select("fact_group").union(gone.select("fact_group")).distinct(), "groups")

        by_group = t["facts"].touched(groups)
        held = t["facts"].having(groups, by_group).join(gone.select("fact_group", "fact_id"), ["fact_group", "fact_id"], "left_anti")
        members = stored(held.unionByName(fresh.select(*held.columns)), "members")
        old = t["matches"].having(groups, by_group).join(gone.select("fact_group", "fact_id"), ["fact_group", "fact_id"], "left_anti")
        old = stored(old, "old")
        lost = old.join(gone.select("fact_group", F.col("fact_id").alias("candidate_id")), ["fact_group", "candidate_id"], "left_semi")
        whole = stored(fresh.select("fact_group", "fact_id").union(lost.select("fact_group", "fact_id")).distinct(), "whole")
        searched = members.join(whole, ["fact_group", "fact_id"], "left_semi")
        others = members.join(whole, ["fact_group", "fact_id"], "left_anti")
        kept = old.join(whole, ["fact_group", "fact_id"], "left_anti").select("fact_group", "fact_id", "candidate_id", "similarity")
        merged = kept.unionByName(self._nearest(others, fresh))
        matches = stored(self._ranked(merged.unionByName(self._nearest(searched, members))), "matches")
        decided = stored(self._decided(matches, members), "decided")

        t["chunks"].staged(f"{folder}/chunks", chunks, changed, by_document)
        t["known"].staged(f"{folder}/known", found, changed, by_document)
        t["facts"].staged(f"{folder}/facts", fresh, gone.select("fact_group", "fact_id"), by_group)
        t["matches"].staged(f"{folder}/matches", matches, groups, by_group)
        t["relationships"].staged(f"{folder}/relationships", decided, groups, by_group)
        counted = {"documents": changed, "found": found, "fresh": fresh, "gone": gone, "groups": groups, "members": members, "searched": whole}
        log = [rows.agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name, rows in counted.items()]
        reduce(DataFrame.unionByName, log).write.mode("overwrite").parquet(f"{folder}/ready")

    def step(self, pages: DataFrame, number: int) -> None:
        """One micro-batch. Repeated after a failure, it goes on from what was staged, or stages anew from the state before it."""
        folder = f"{self.root}/staged/batch={number}"
        if not exists(self.spark, f"{folder}/ready/_SUCCESS"):
            self.stage(last_versions(pages), folder)
        for name, keyed in self.tables.items():
            keyed.put(f"{folder}/{name}")
        self.spark.read.parquet(f"{folder}/ready").write.mode("overwrite").parquet(f"{self.root}/log/batch={number}")
        if number:
            removed(self.spark, f"{self.root}/staged/batch={number - 1}")

    def follow(self, source: str) -> None:
        """Takes in the deliveries that have come to ``source`` since the last time.

        A delivery is a folder of page files (columns ``PAGE``) under ``source``, with all pages of each of its documents, and the names of
        deliveries sort by time. All that is new is one micro-batch, so no document is seen in parts.
        """
        files = self.spark.readStream.schema(PAGE).parquet(f"{source}/*")
        rows = files.withColumn("version", F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1))
        stream = rows.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.root}/checkpoint")
        stream.trigger(availableNow=True).start().awaitTermination()

    def relationships(self) -> DataFrame:
        return self.tables["relationships"].read()

    def log(self) -> DataFrame:
        """What each micro-batch read and searched: batch, kind of rows, n."""
        return self.spark.read.parquet(f"{self.root}/log").orderBy("batch", "kind")


def last_versions(pages: DataFrame) -> DataFrame:
    """Of each document the pages of its last ``version``; without such a column, all."""
    if "version" not in pages.columns:
        return pages
    last = pages.groupBy("document_id").agg(F.max("version").alias("version"))
    return pages.join(last, ["document_id", "version"]).drop("version")


def followed(spark: SparkSession, root: str, versions: list[Callable[[], DataFrame]], **how: object) -> Maintained:
    """A state that has taken in some deliveries of pages one after the other."""
    state = Maintained(spark, root, **how)
    for number, pages in enumerate(versions):
        pages().write.mode("overwrite").parquet(f"{root}/incoming/{number:09d}")
        state.follow(f"{root}/incoming")
    return state

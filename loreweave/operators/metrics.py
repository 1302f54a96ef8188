"""Counts and rates of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.functions.lineage import written
from loreweave.functions.ranking import ranked


def stats(obliged: DataFrame, named: DataFrame) -> DataFrame:
    """total, open, entities, high_confidence (above 0.8)."""
    o = obliged.agg(F.count("*").alias("total"), F.count_if(~F.col("is_resolved")).alias("open"), F.count_if(F.col("confidence") > 0.8).alias("high_confidence"))
    return o.crossJoin(named.agg(F.count("*").alias("entities"))).select("total", "open", "entities", "high_confidence")


def metrics(passages: DataFrame, obliged: DataFrame, named: DataFrame, findings: DataFrame) -> DataFrame:
    """evidence_rate (1 if there are no obligations), contradiction_rate per 10,000 words (null without words), totals. One row each is joined."""
    o = obliged.agg(F.count("*").alias("total_obligations"), F.coalesce(F.avg((F.size("evidence_anchor_ids") > 0).cast("double")), F.lit(1.0)).alias("evidence_rate"))
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    p = passages.agg(F.count("*").alias("total_passages"), F.coalesce(F.sum(words), F.lit(0)).alias("words"))
    c = findings.agg(F.count_if(F.col("category") == "contradiction").alias("found"))
    e = named.agg(F.count("*").alias("total_entities"))
    return o.crossJoin(p).crossJoin(c).crossJoin(e).select("total_passages", "total_entities", "total_obligations", F.round("evidence_rate", 6).alias("evidence_rate"), F.lit(0.0).alias("ambiguity_rate"), F.when(F.col("words") > 0, F.round(F.col("found") * 10000 / F.greatest("words", F.lit(1)), 6)).alias("contradiction_rate"))


def by_category(obliged: DataFrame) -> DataFrame:
    return obliged.groupBy("category").agg(F.count("*").alias("n"))


#: Rows of a range, and ranges of a range above it.
RANGE = 1024


def content_ranges(docs: DataFrame, *order: str) -> DataFrame:
    """range, rows, hash: a SHA-256 over each RANGE neighbours in order (order_hint, source_id), from 0. A row's own hash is over
    its source_id and raw_text, each behind its size in bytes, or - for null."""
    row = F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in ("source_id", "raw_text")]), 256)
    order = order or ("order_hint", "source_id")
    placed = ranked(docs.select(*order, row.alias("hash")), *order, "hash")
    return _above(placed.select(F.col("rank").cast("long").alias("at"), "hash", F.lit(1).cast("long").alias("rows")))


def _above(level: DataFrame) -> DataFrame:
    """RANGE rows at most meet in a group."""
    held = level.groupBy(F.expr(f"at div {RANGE}").alias("range")).agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("h"))
    return held.select("range", "rows", F.sha2(F.array_join(F.transform("h", lambda x: x["hash"]), ""), 256).alias("hash"))


def content_hash(docs: DataFrame) -> DataFrame:
    """content_hash: the root of a tree over all rows in order: the same however they are dealt to partitions, another one if two
    rows change places. Null without rows."""
    level = written(content_ranges(docs))
    while level.count() > 1:
        level = written(_above(level.select(F.col("range").alias("at"), "hash", "rows")))
    return level.agg(F.max("hash").alias("content_hash"))


def dataset_manifest(docs: DataFrame) -> DataFrame:
    """documents, characters, sources and content_hash. One row each is joined."""
    told = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length("raw_text")), F.lit(0)).cast("long").alias("characters"), F.countDistinct("source_id").alias("sources"))
    return told.crossJoin(content_hash(docs))

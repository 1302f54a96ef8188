"""Raw documents to packed token sequences, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loreweave.llm.common import written
from loreweave.llm.decontaminate import decontaminate
from loreweave.llm.line_dedup import dedup_lines
from loreweave.llm.packing import pack_documents
from loreweave.llm.quality import quality_filter
from loreweave.llm.simhash import one_of_each_group


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; null and empty texts are such. An empty table stays empty, here and below."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in five documents or more stay in that with the largest doc_id alone."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs with a Jaccard similarity of 0.8 or more, by shingles of five words, join stays, that
    with the smallest doc_id. Texts without words are alike. Fingerprints link them first, as in operator 5; rare shingles bring together what these leave apart."""
    return one_of_each_group(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. Null and empty texts stay, and all stay where the benchmark is empty."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 ids at most, a row per piece of a document."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Components of near-duplicates and tokenization have no SQL form; tests hold the operator of each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

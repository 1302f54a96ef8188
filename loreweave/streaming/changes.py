"""Changed documents as a stream of files: each micro-batch is a changed set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loreweave.operators.entities import mentions
from loreweave.operators.obligations import obligation_matches, with_ids
from loreweave.operators.segment import BLANK_LINE, segment
from loreweave.sources.documents import TEXT_SUFFIXES, stem, suffix
from loreweave.sources.stores import Stores


def watch(spark: SparkSession, folder: str, root: str, checkpoint: str, delimiter: str = BLANK_LINE, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Reads files that appear in folder and overwrites their sources in the stores passages, mentions and matches.

    A micro-batch that is run again overwrites the same sources with the same rows, so what is stored is exactly once.
    Files that are not UTF-8 go to the store quarantine, by source too; a source's place in the order of first sight is the
    microsecond of its file. Runs over what is there and ends (available now).
    """
    stores = Stores(spark, root)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).where(suffix(F.col("path")).isin(*TEXT_SUFFIXES))

    def take(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(stem(F.col("path")).alias("source_id")).agg(F.max_by(F.struct("content", "modificationTime", "path"), F.struct("modificationTime", "path")).alias("f")).select("source_id", "f.*")
        readable = F.is_valid_utf8("content")
        stores.write_sources("quarantine", newest.where(~readable).select("source_id", F.col("path").alias("source_path"), F.lit(number).alias("batch")))
        docs = newest.where(readable).select("source_id", F.unix_micros("modificationTime").alias("order_hint"), F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n").alias("raw_text"))
        passages = segment(docs, delimiter).persist()
        stores.write_sources("passages", passages)
        stores.write_sources("mentions", mentions(passages))
        stores.write_sources("matches", with_ids(obligation_matches(passages)).drop("text"))
        if after:
            after(docs.select("source_id"), number)
        passages.unpersist()

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

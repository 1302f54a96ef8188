"""Token-ID output (operator 1): ids of documents in ascending order, in files of patched frame-of-reference segments."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm import pfor
from loreweave.llm.common import parts
from loreweave.llm.tokens import encoder

#: Ids of a segment, at which the next document starts a new one; documents encoded at a time.
SEGMENT_IDS, BATCH = 1 << 19, 2048


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", shards: int | None = None, special_as_text: bool = False) -> None:
    """Writes the ids of every whole text, each followed by end_id, in ascending doc_id order.

    Strings of the vocabulary's special tokens become these tokens, as the library has it, unless special_as_text.

    The folder holds a Parquet file per shard: a row per segment with shard, segment, first (ids of this shard before
    it), doc_ids, lengths and payload (see pfor). Shards are ranges of doc_id, ascending by number. Spark's committer
    writes them, so a lost or repeated task leaves one copy, and any store that Spark reaches will do. Null and empty
    texts have the end id alone; a null doc_id comes first; rows that share a doc_id follow each other, ordered by
    their texts' hashes; an empty table gives an empty folder.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange(shards or parts(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    id_type = d.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        encode = encoder(tokenizer, special_as_text)
        end = encode.packed([end_id])
        ids: list[pa.Array] = []
        runs: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            lengths = [len(x) // encode.width for x in runs]
            held = pa.concat_arrays(ids)
            payload = pfor.encode(np.frombuffer(b"".join(runs), encode.kind))
            kinds = (pa.int32(), pa.int32(), pa.int64(), None, pa.list_(pa.int64()), pa.binary())
            ids_array = pa.ListArray.from_arrays([0, len(held)], held)
            values = ([shard], [segment], [first], ids_array, [lengths], [payload])
            return pa.RecordBatch.from_arrays([v if k is None else pa.array(v, k) for v, k in zip(values, kinds)], schema.names)

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                own, begun = encode.encode(batch.column("text").to_pylist()), 0
                for i, x in enumerate(own):
                    runs.append(x + end)
                    size += len(x) // encode.width + 1
                    if size >= SEGMENT_IDS:
                        ids.append(batch.column("doc_id").slice(begun, i + 1 - begun))
                        yield closed()
                        segment, first, size, ids, runs, begun = segment + 1, first + size, 0, [], [], i + 1
                ids.append(batch.column("doc_id").slice(begun))
        if runs:
            yield closed()

    d.mapInArrow(segments, schema).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids (array of longs), from the files alone."""
    told = spark.read.parquet(path)
    totals = {r["shard"]: r["n"] for r in told.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).collect()}  # a row per shard
    before, so_far = {}, 0
    for shard in sorted(totals):
        before[shard] = so_far
        so_far += totals[shard]
    id_type = told.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), *[T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = pfor.decode(batch.column("payload")[i].as_buffer()).astype("<u4", copy=False)
                lengths = np.asarray(batch.column("lengths")[i].values)
                ends = np.cumsum(lengths)
                start = before[batch.column("shard")[i].as_py()] + batch.column("first")[i].as_py() + ends - lengths
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - lengths, ends)]
                columns = [batch.column("doc_ids")[i].values, pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return told.select("shard", "first", "doc_ids", "lengths", "payload").mapInArrow(documents, schema)

"""Line dedup (operator 9): two Bloom filters name the lines that may repeat; only those are shuffled and counted exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm.common import dropped, parts, power_of_two, written

BLANK_BYTES = b" \t\n\x0b\x0c\r"
#: Bits of a filter for each hash that goes into it, and bits that one hash sets.
BITS_EACH, PROBES = 16, 4
#: The filter of twice-seen hashes that every task gets has so many bytes at most: past that it lets more lines
#: through to the exact count, and the result stays the same.
FILTER_BYTES = 64 << 20
#: Bytes of text whose lines share a segment of the hash space; a task has the filter of one segment at a time.
SEGMENT_BYTES = 64 << 20
#: Lines to drop are sent to every task up to so many bytes, and joined to the documents beyond.
DROP_BYTES = 32 << 20


def line_keys(body: bytes) -> list[bytes]:
    """The key of each line: blanks stripped at both ends, A-Z lower-cased."""
    return [x.strip(BLANK_BYTES) for x in body.lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of each hash in a filter of a power of two of bits."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(j) * b) & np.uint64(bits - 1)).astype(np.int64) for j in range(PROBES)]


class Bloom:
    """A filter with a byte per bit while it is filled; packed() has the bits."""

    def __init__(self, bits: int) -> None:
        self.bits, self.on = bits, np.zeros(bits, dtype=bool)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for at in probes(h, self.bits):
            out &= self.on[at]
        return out

    def add(self, h: np.ndarray) -> None:
        for at in probes(h, self.bits):
            self.on[at] = True

    def packed(self) -> bytes:
        return np.packbits(self.on, bitorder="little").tobytes()


def packed_has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    for at in probes(h, 8 * len(table)):
        out &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
    return out


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (h >> np.uint64(20)) % np.uint64(segments)


def _bodies(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _document_keys(body: bytes, least: int) -> list[bytes]:
    """Keys that count, once for each document."""
    return [k for k in dict.fromkeys(line_keys(body)) if long_enough(k, least)]


def _suspects(docs: DataFrame, least: int) -> tuple[int, dict[int, bytes]]:
    """For each segment of the hash space the filter of the hashes seen twice or more."""
    spark = docs.sparkSession
    held = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    segments = max(4 * parts(spark), power_of_two(held / SEGMENT_BYTES))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.fromiter((xxhash.xxh3_64_intdigest(k) for body in _bodies(batch, "text") for k in _document_keys(body, least)), dtype=np.uint64)
            if not len(h):
                continue
            h, n = np.unique(h, return_counts=True)  # a line that a third of the documents share is sent once a batch
            seg = segment_of(h, segments)
            order = np.argsort(seg, kind="stable")
            h, n, seg = h[order], n[order], seg[order]
            at = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            ends = np.r_[at[1:], len(seg)]
            yield pa.RecordBatch.from_arrays([
                pa.array(seg[at].astype(np.int32)),
                pa.array([h[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()),
                pa.array([h[i:j][n[i:j] > 1].tobytes() for i, j in zip(at, ends)], pa.binary()),
            ], ["segment", "seen", "again"])

    told = written(docs.mapInArrow(hashed, "segment int, seen binary, again binary"), "line-hashes")
    total = told.agg(F.coalesce(F.sum(F.octet_length("seen")), F.lit(0))).collect()[0][0] // 8
    if not total:
        return segments, {}
    once_bits = power_of_two(BITS_EACH * total / segments)
    most_bits = max(64, power_of_two(FILTER_BYTES * 8 / segments + 1) // 2)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by segment, so one pair of filters is alive at a time."""
        own, once, twice = None, Bloom(64), []

        def closed() -> Iterator[pa.RecordBatch]:
            found = np.unique(np.concatenate(twice)) if twice else []
            if len(found):
                out = Bloom(min(most_bits, max(64, power_of_two(BITS_EACH * len(found)))))
                out.add(found)
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([out.packed()], pa.binary())], ["segment", "filter"])

        for batch in batches:
            for seg, seen, again in zip(*(c.to_pylist() for c in batch.columns)):
                if seg != own:
                    yield from closed()
                    own, once, twice = seg, Bloom(once_bits), []
                h = np.frombuffer(seen, dtype=np.uint64)
                twice += [h[once.has(h)], np.frombuffer(again, dtype=np.uint64)]
                if len(twice) > 1000:
                    twice = [np.unique(np.concatenate(twice))]
                once.add(h)
        yield from closed()

    tasks = max(parts(spark), segments // 64)
    rows = told.repartition(tasks, "segment").sortWithinPartitions("segment").mapInArrow(filtered, "segment int, filter binary").collect()
    dropped(told)
    return segments, {r["segment"]: bytes(r["filter"]) for r in rows}  # FILTER_BYTES in all


def _suspected_rows(docs: DataFrame, least: int, with_mark: bool) -> DataFrame:
    """doc_id, (mark,) key of each distinct line of a document that may repeat elsewhere."""
    segments, filters = _suspects(docs.select("text"), least)
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField("mark", T.StringType())] * with_mark, T.StructField("key", T.BinaryType())])

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.frombuffer(v, dtype=np.uint8) for k, v in sent.value.items()}
        for batch in batches:
            keys = [_document_keys(body, least) for body in _bodies(batch, "text")]
            flat = [k for own in keys for k in own]
            if not flat or not tables:
                continue
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), dtype=np.uint64, count=len(flat))
            row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            seg, keep = segment_of(h, segments).astype(np.int64), np.zeros(len(h), dtype=bool)
            order = np.argsort(seg, kind="stable")
            bounds = np.flatnonzero(np.r_[True, np.diff(seg[order]) != 0, True])
            for i, j in zip(bounds[:-1], bounds[1:]):
                at = order[i:j]
                if (table := tables.get(int(seg[at[0]]))) is not None:
                    keep[at] = packed_has(table, h[at])
            at = np.flatnonzero(keep)
            took = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(took), *([batch.column("mark").take(took)] if with_mark else []), pa.array([flat[i] for i in at], pa.binary())], ["doc_id", *["mark"] * with_mark, "key"])

    return docs.mapInArrow(suspected, schema)


def repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """key, n, keeper: each line key found in least_docs rows or more, and the largest doc_id that holds it (null if none
    has one). A row counts once for a key, however often it has it; null texts hold one empty line; no rows, no keys."""
    found = _suspected_rows(docs.select("doc_id", "text"), least_chars, False)
    return found.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least_docs)


def _kept(body: bytes, gone) -> tuple[bytes, int, int]:
    """The text without the lines whose key gone() names; lines before and lines dropped."""
    lines, keys = body.split(b"\n"), line_keys(body)
    left = [x for x, k in zip(lines, keys) if not gone(k)]
    return (b"\n".join(left), len(lines), len(lines) - len(left)) if len(left) < len(lines) else (body, len(lines), 0)


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, doc_id: str = "doc_id", text: str = "text", counts: bool = False, drop_bytes: int = DROP_BYTES) -> DataFrame:
    """docs with every line dropped whose key (blanks stripped at both ends, A-Z lower-cased) has least_chars code points
    or more and stands in least_docs rows or more, but for the row with the largest doc_id that holds it.

    All columns of docs stay as they are but the text; with counts=True the columns are doc_id, text, n_lines and
    n_dropped alone. A null or empty text is one empty line: null stays null (empty with counts=True). Rows count as
    documents, also where they repeat a doc_id; all rows with the largest doc_id keep their lines; a null doc_id is
    smaller than any. Repeats within the row that keeps a line stay. An empty table stays empty.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    drops = written(repeated_lines(d, least_chars, least_docs), "repeated-lines")
    size = drops.agg(F.coalesce(F.sum(F.octet_length("key") + 100), F.lit(0))).collect()[0][0]
    id_type, id_name, text_name = d.schema["doc_id"].dataType, doc_id, text
    if counts:
        docs = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        id_name, text_name = "doc_id", "text"
        schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    else:
        schema = docs.schema
    n_columns = len(schema.names) - 2 * counts

    def rebuilt(batch: pa.RecordBatch, gone_of) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_name)
        ids, bodies = batch.column(id_name).to_pylist(), batch.column(at).cast(pa.binary()).to_pylist()
        done = [_kept(b or b"", gone_of(i, k)) for i, (k, b) in enumerate(zip(ids, bodies))]
        texts = pa.array([None if b is None else x[0] for b, x in zip(bodies, done)], pa.binary()).cast(batch.schema.field(at).type)
        columns = [texts if i == at else batch.column(i) for i in range(n_columns)]
        return pa.RecordBatch.from_arrays(columns + [pa.array([x[k] for x in done], pa.int64()) for k in (1, 2)] * counts, schema.names)

    if size <= drop_bytes:
        sent = docs.sparkSession.sparkContext.broadcast({bytes(r["key"]): r["keeper"] for r in drops.collect()})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keepers = sent.value
            for batch in batches:
                yield rebuilt(batch, lambda _, me: lambda k: k in keepers and keepers[k] != me)

        return docs.mapInArrow(apply, schema)

    # Too many to send: the keys that each text loses come to it by a join on what the text is, not on where its row lies.
    mark = F.sha2(F.coalesce(F.col(text_name), F.lit("")), 256)
    own = _suspected_rows(d.withColumn("mark", F.sha2(F.coalesce("text", F.lit("")), 256)), least_chars, True)
    lost = own.join(drops, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "mark").agg(F.collect_set("key").alias("lost"))
    lost = lost.select(F.struct("doc_id", "mark").alias("of"), "lost")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col(id_name).alias("doc_id"), mark.alias("mark")).alias("of"))
    whole = whole.join(lost, whole["of"].eqNullSafe(lost["of"]), "left").select(*[F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], "lost")

    def apply_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [{bytes(x) for x in v or ()} for v in batch.column(batch.num_columns - 1).to_pylist()]
            named = pa.RecordBatch.from_arrays(batch.columns[:-1], schema.names[:n_columns])
            yield rebuilt(named, lambda i, _: lists[i].__contains__)

    return whole.mapInArrow(apply_joined, schema)

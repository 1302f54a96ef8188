"""Target-distribution importance resampling (operator 11): the n-gram strings of all texts are counted in a dictionary of
distinct features, dealt by string; each is hashed once; bucket totals give gains, which return to each document's counts."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm.common import dropped, numbered, parts, written

#: Words of UTF-8 bytes after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A posting is a document's place in its block, and a count less one above that; larger counts take several postings.
PLACE_BITS = 13
MOST_COUNT = 1 << (16 - PLACE_BITS)
#: Documents and bytes of text that are indexed together, and bytes of text for each share of the dictionary.
BLOCK_DOCS, BLOCK_BYTES, SHARE_BYTES = 1 << PLACE_BITS, 8 << 20, 10 << 20


#: Sums of documents that a task holds before it sends them on.
HELD_SUMS = 1 << 21


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of a fixed width as all their first bytes, then all their second ones, and so on, which packs better."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


class _Numbers(dict):
    """Words by number, in the order in which they are first seen."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Block:
    """Texts as an index: features in order, the share of the dictionary that each belongs to, and its postings."""

    def __init__(self, bodies: list[bytes], longest: int, shares: int) -> None:
        known = _Numbers()
        each = [np.fromiter(map(known.__getitem__, WORD.findall(b.lower())), np.int32) for b in bodies]
        self.n_words = np.array([len(x) for x in each], np.int64)
        self.n_features = sum(np.maximum(self.n_words - n + 1, 0) for n in range(1, longest + 1))
        row = np.repeat(np.arange(len(each), dtype=np.int32), self.n_words)
        names = sorted(known)
        place = np.empty(len(names), np.int32)  # words are numbered in their order, so features come sorted and pack well
        place[[known[w] for w in names]] = np.arange(len(names))
        flat = place[np.concatenate(each)] if len(row) else np.zeros(0, np.int32)
        del known, each
        word_hash = np.fromiter((zlib.crc32(w) for w in names), np.uint64, len(names))
        words = pa.array(names, pa.binary())
        run, strings, hashes = flat.copy(), words, word_hash  # the feature that starts at each place, -1 for none
        found = []
        for n in range(1, longest + 1):
            if n > 1:
                last = max(0, len(flat) - n + 1)
                at = np.flatnonzero((run[:last] >= 0) & (row[:last] == row[n - 1 :][:last]))
                distinct, own = np.unique(run[at].astype(np.int64) * len(names) + flat[at + n - 1], return_inverse=True)
                head, tail = distinct // max(1, len(names)), distinct % max(1, len(names))
                strings = pc.binary_join_element_wise(strings.take(pa.array(head)), words.take(pa.array(tail)), pa.scalar(b" ", pa.binary()))
                hashes = hashes[head] * np.uint64(0x9E3779B97F4A7C15) + word_hash[tail]
                run = np.full(len(flat), -1, np.int32)
                run[at] = own
            held = run >= 0
            key, count = np.unique(run[held].astype(np.int64) << PLACE_BITS | row[held], return_counts=True)
            again = 1 + (count - 1) // MOST_COUNT
            nth = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
            key, count = np.repeat(key, again), np.minimum(np.repeat(count, again) - nth * MOST_COUNT, MOST_COUNT)
            found.append((strings, hashes, np.bincount(key >> PLACE_BITS, minlength=len(strings)), (key & (BLOCK_DOCS - 1) | (count - 1) << PLACE_BITS).astype("<u2")))
        self.strings = pa.concat_arrays([x[0] for x in found])
        self.hashes, self.sizes, self.postings = (np.concatenate([x[i] for x in found]) for i in (1, 2, 3))
        mixed = self.hashes ^ (self.hashes >> np.uint64(29))
        self.share = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)) % np.uint64(shares)

    def dealt(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """For each share that has some: strings, their lengths, postings of each, and the postings."""
        z, quick = zstandard.ZstdCompressor(level=6), zstandard.ZstdCompressor(level=1)
        order = np.argsort(self.share, kind="stable")
        first = np.cumsum(self.sizes) - self.sizes
        bounds = np.flatnonzero(np.r_[True, np.diff(self.share[order].astype(np.int64)) != 0, True]) if len(order) else [0]
        for i, j in zip(bounds[:-1], bounds[1:]):
            at = order[i:j]
            own, sizes = self.strings.take(pa.array(at)), self.sizes[at]
            nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            lengths = pc.binary_length(own).to_numpy()
            text = own.buffers()[2][: int(lengths.sum())]  # taken anew, so it begins at the first
            numbers = (lengths.astype("<u4"), sizes.astype("<u4"), self.postings[np.repeat(first[at], sizes) + nth])
            yield int(self.share[at[0]]), z.compress(text), *[quick.compress(_planes(x)) for x in numbers]


class Dictionary:
    """Distinct features of many blocks with their counts. Each is hashed once, when all have come."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.features, self.counts = buckets, [], []

    def add(self, features: pa.Array, counts: np.ndarray) -> None:
        """Features that are distinct among themselves, and how often each came."""
        self.features.append(features)
        self.counts.append(counts)

    def told(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The buckets of the features of each add(), and how many features fall into each bucket."""
        met = pa.chunked_array(self.features, pa.binary()).combine_chunks().dictionary_encode()
        number, distinct = met.indices.to_numpy(), met.dictionary
        bucket = np.concatenate([np.zeros(0, np.int64), *[np.fromiter((zlib.crc32(f) for f in distinct.slice(i, 1 << 16).to_pylist()), np.int64) % self.buckets for i in range(0, len(distinct), 1 << 16)]])
        count = np.bincount(number, np.concatenate(self.counts), minlength=len(distinct)).astype(np.int64)  # counts below 2**53 are exact
        totals = np.bincount(bucket, count, minlength=self.buckets).astype(np.int64)
        return np.split(bucket[number], np.cumsum([len(x) for x in self.features])[:-1]), totals


INDEX = "share int, block long, strings binary, lengths binary, sizes binary, postings binary, doc_ids array<{0}>, n_words array<long>, n_features array<long>"
COUNTED = "block long, buckets binary, sizes binary, postings binary, totals binary, doc_ids array<{0}>, n_words array<long>, n_features array<long>"


def _rows(schema: T.StructType, arrow: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in rows], arrow)


def _arrow(schema: T.StructType, id_type: pa.DataType) -> pa.Schema:
    kinds = {"share": pa.int32(), "block": pa.int64(), "doc_ids": pa.list_(id_type), "n_words": pa.list_(pa.int64()), "n_features": pa.list_(pa.int64())}
    return pa.schema([(k, kinds.get(k, pa.binary())) for k in schema.names])


def _bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _counted(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """The dictionary's work as a written table: a row per block and share with the bucket of each feature and its
    postings, a row per task with the totals of its share by bucket, and a row per block with its documents."""
    spark = docs.sparkSession
    held = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    shares = max(parts(spark), math.ceil(held / SHARE_BYTES))
    kind, wide = docs.schema["doc_id"].dataType.simpleString(), _bucket_type(buckets)
    index, counted = (T._parse_datatype_string(x.format(kind)) for x in (INDEX, COUNTED))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        bodies: list[bytes] = []
        size, id_type = 0, pa.int64()

        def closed() -> Iterator[pa.RecordBatch]:
            b = Block(bodies, longest, shares)
            arrow = _arrow(index, id_type)
            yield _rows(index, arrow, [{"share": number % shares, "block": number, "doc_ids": ids, "n_words": b.n_words.tolist(), "n_features": b.n_features.tolist()}])
            for share, strings, lengths, sizes, postings in b.dealt():
                yield _rows(index, arrow, [{"share": share, "block": number, "strings": strings, "lengths": lengths, "sizes": sizes, "postings": postings}])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                body = text.as_py() or b""
                if bodies and (len(bodies) == BLOCK_DOCS or size + len(body) > BLOCK_BYTES):
                    yield from closed()
                    number, ids, bodies, size = number + 1, [], [], 0
                ids.append(i)
                bodies.append(body)
                size += len(body)
        if bodies:
            yield from closed()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, z, un = Dictionary(buckets), zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        arrow, rows = None, []
        for batch in batches:
            arrow = _arrow(counted, batch.schema.field("doc_ids").type.value_type)
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["strings"] is None:
                    yield _rows(counted, arrow, [row])
                    continue
                lengths, sizes, postings = (_numbers(un.decompress(row[k]), d) for k, d in (("lengths", "<u4"), ("sizes", "<u4"), ("postings", "<u2")))
                offsets = np.r_[0, np.cumsum(lengths)].astype("<i4")
                counts = np.add.reduceat((postings >> PLACE_BITS).astype(np.int64) + 1, np.cumsum(sizes, dtype=np.int64) - sizes)
                known.add(pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(un.decompress(row["strings"]))]), counts)
                rows.append({k: row[k] for k in ("block", "sizes", "postings")})
        if rows:
            found, totals = known.told()
            for row, own in zip(rows, found):
                yield _rows(counted, arrow, [row | {"buckets": z.compress(_planes(own.astype(wide)))}])
            yield _rows(counted, arrow, [{"totals": z.compress(totals.tobytes())}])

    dealt = docs.mapInArrow(indexed, index).repartitionById(shares, F.col("share"))
    return written(dealt.mapInArrow(told, counted), "feature-index")


def _totals(counted: DataFrame, buckets: int) -> list[int]:
    """How many features fall into each bucket."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, un = np.zeros(buckets, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for x in batch.column("totals"):
                out += np.frombuffer(un.decompress(x.as_py()), np.int64)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at], pa.int64())], ["bucket", "n"])

    got = [0] * buckets
    for r in counted.where("totals is not null").select("totals").mapInArrow(summed, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        got[r["bucket"]] = r["n"]
    return got


def _gains(raw: list[int], target: list[int]) -> np.ndarray:
    s, t, b = sum(raw), sum(target), len(raw)
    return np.array([math.floor(1000 * math.log((t_ + 1) * (s + b) / ((s_ + 1) * (t + b)))) for s_, t_ in zip(raw, target)], np.int64)


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), where u in (0, 1) comes from the SHA-256 of seed:doc_id. A null doc_id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_scores(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs: how much more its word runs of 1 to longest words
    belong to the texts of target than to docs, and that with Gumbel noise, so that the highest scores are a sample.

    Null and empty texts have no features and weight 0. Rows count one by one, also where they repeat a doc_id. An empty
    target has no features; an empty docs gives no rows. Other columns are not looked at. docs should be read from files
    or a checkpoint: a task that runs again must meet its rows in the same order.
    """
    own = _counted(_plain(docs, doc_id, text), longest, buckets)
    aimed = _counted(target.select(F.lit(0).alias("doc_id"), F.col(f"`{text}`").alias("text")), longest, buckets)
    gains = docs.sparkSession.sparkContext.broadcast(_gains(_totals(own, buckets), _totals(aimed, buckets)))
    dropped(aimed)

    kind, wide = own.schema["doc_ids"].dataType.elementType, _bucket_type(buckets)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's sums by place over all shares of a task, without places that have none."""
        un, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        sums: dict[int, np.ndarray] = {}

        def closed() -> Iterator[pa.RecordBatch]:
            for block, held in sums.items():
                at = np.flatnonzero(held[0])
                yield pa.RecordBatch.from_pydict({"block": [block], "places": [z.compress(at.astype("<u2").tobytes())], "totals": [z.compress(held[1][at].tobytes())]})
            sums.clear()

        for batch in batches:
            for block, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                b, sizes, postings = (_numbers(un.decompress(x), d) for x, d in zip(packed, (wide, "<u4", "<u2")))
                place = postings & (BLOCK_DOCS - 1)
                total = np.bincount(place, np.repeat(gains.value[b], sizes) * ((postings >> PLACE_BITS).astype(np.int64) + 1), minlength=BLOCK_DOCS)  # sums below 2**53 are exact
                if block not in sums and len(sums) * BLOCK_DOCS >= HELD_SUMS:
                    yield from closed()
                held = sums.setdefault(block, np.zeros((2, BLOCK_DOCS), np.int64))
                held[0][place] = 1
                held[1] += total.astype(np.int64)
        yield from closed()

    out = T._parse_datatype_string(f"doc_id {kind.simpleString()}, n_words long, n_features long, total long")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, that with its documents first."""
        un, docs_of, block, sums = zstandard.ZstdDecompressor(), None, None, np.zeros(BLOCK_DOCS, np.int64)

        def closed() -> Iterator[pa.RecordBatch]:
            if docs_of is not None:
                ids, words, features = (docs_of.column(c)[0].values for c in ("doc_ids", "n_words", "n_features"))
                yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(sums[: len(ids)].copy())], out.names)

        for batch in batches:
            for i, (own_block, places, totals) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "places", "totals")))):
                if own_block != block:
                    yield from closed()
                    block, docs_of = own_block, batch.slice(i, 1)
                    sums[:] = 0
                if places is not None:
                    sums[np.frombuffer(un.decompress(places), "<u2")] += np.frombuffer(un.decompress(totals), np.int64)
        yield from closed()

    listed = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("doc_ids", "n_words", "n_features")]
    some = own.where("buckets is not null").select("block", "buckets", "sizes", "postings").mapInArrow(summed, "block long, places binary, totals binary").select("block", "places", "totals", *listed)
    each = own.where("doc_ids is not null").select("block", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("totals"), "doc_ids", "n_words", "n_features")
    met = each.unionByName(some).repartition(parts(docs.sparkSession), "block").sortWithinPartitions("block", F.col("places").isNotNull())
    told = met.mapInArrow(told, out)
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")).cast("long")
    return told.select("doc_id", "n_words", "n_features", mean.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, **options) -> DataFrame:
    """doc_id, n_features, weight, score and rank: 1, 2, 3, ... for the percent highest scores (rounded down) of the rows with
    least_words words or more, null for all others. Ties go to the smaller doc_id, null first; equal rows to either."""
    scored = written(importance_scores(docs, target, **options), "importance-scores")
    fit = scored.where(F.col("n_words") >= least_words)
    draw = fit.count() * percent // 100
    placed = numbered(fit, F.desc("score"), F.asc("doc_id"), name="importance-ranks")
    columns = ["doc_id", "n_features", "weight", "score"]
    some = placed.select(*columns, F.when(F.col("at") < draw, F.col("at") + 1).alias("rank"))
    return some.unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is drawn by importance_ranks. Rows that share a drawn doc_id all stay."""
    drawn = importance_ranks(docs, target, doc_id=doc_id, **options).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(drawn, F.col(f"`{doc_id}`").eqNullSafe(F.col("drawn_id")), "left_semi")

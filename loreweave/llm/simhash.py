"""SimHash near-duplicates (operator 5): pigeonring candidate search over fingerprints, then connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm.common import packed_row, parts, written
from loreweave.llm.components import connected_components

BITS = 64
#: Segments of the ring. With 4 differing bits, a chain of l segments may hold 4 l / 9 differences, rounded down.
SEGMENTS = 9
#: Runs of up to so many fingerprints are compared by offsets, larger ones by growing groups from a pivot.
SHORT_RUN = 64
#: Runs above this are dealt over tasks as pairs of blocks.
LONG_RUN = 4096


def shingle_hashes(body: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, repeats included, as they stand; of all its words where they are fewer. Empty without words."""
    words = body.lower().split()  # both know ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    n = min(shingle, len(words))
    begin, end = (end - size)[: len(words) - n + 1].tolist(), end[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], 42) for i, j in zip(begin, end)], dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Each bit set in more than half of the hashes. Zero without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(body: bytes, shingle: int) -> int:
    """Over the XXH64 (seed 42) of the shingles of a text, each bit set in more than half of them. Zero without words."""
    return fingerprint_of(shingle_hashes(body, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The columns of docs but text, and fp: the fingerprint as a signed long."""
    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("fp", T.LongType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x or b"", shingle) for x in batch.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fp.view(np.int64))], schema.names)

    return docs.mapInArrow(made, schema)


def _bounds(segments: int) -> list[tuple[int, int]]:
    """Where each segment's bits start and how many it has."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def ring_keys(distance: int, segments: int, depth: int) -> list[tuple[int, tuple[int, ...]]]:
    """(start, exact segments): every pair within the distance agrees on all exact segments of one of these.

    By the pigeonring principle some start has chains of every length l with l * distance / segments differences at
    most. Within its first depth segments that bounds which segments may differ; the others are exact.
    """
    most = depth * distance // segments
    out = []
    for differing in combinations(range(depth), most):
        if all(sum(x < length for x in differing) <= length * distance // segments for length in range(1, depth + 1)):
            exact = [x for x in range(depth) if x not in differing]
            out += [(start, tuple((start + x) % segments for x in exact)) for start in range(segments)]
    return out


def ring_depth(n: int, distance: int, segments: int) -> int:
    """The least depth, from two segments on, at which keys have bits enough to tell n random fingerprints apart; all depths are exact."""
    for depth in range(1, segments):
        exact = depth - depth * distance // segments
        if exact >= 3 and (1 << (BITS // segments) * exact) * 8 >= n:
            return depth
    return segments - 1


def _key(number: int, exact: tuple[int, ...], segments: int) -> Column:
    out, at = F.lit(number).cast("long"), _bounds(segments)
    for s in exact:
        start, size = at[s]
        out = F.shiftleft(out, size).bitwiseOR(F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
    return out


def _chains(segments: int) -> np.ndarray:
    """For each start and length the bits of that chain."""
    at = _bounds(segments)
    out = np.zeros((segments, segments), np.uint64)
    for start in range(segments):
        bits = 0
        for length in range(segments):
            first, size = at[(start + length) % segments]
            bits |= ((1 << size) - 1) << first
            out[start, length] = bits
    return out


def chained(x: np.ndarray, start: np.ndarray, distance: int, segments: int) -> np.ndarray:
    """Where differences x keep within the budget of every chain from start; the last chain is the full Hamming check."""
    masks, alive = _chains(segments), np.arange(len(x))
    for length in range(segments):
        few = np.bitwise_count(x[alive] & masks[start[alive], length]) <= (length + 1) * distance // segments
        alive = alive[few]
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out


def forest(fp: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that join what is linked among fp: each pivot takes those near it out of what is left to compare."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            pivot = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[pivot]) <= distance
            found = left[near].tolist()
            a += [pivot] * len(found)
            b += found
            queue += found
            left = left[~near]
    return a, b


def _links(distance: int, segments: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by run. The last run of a batch waits for the next."""
        waiting: pa.Table | None = None

        def compared(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            run, start = (table.column(c).to_numpy() for c in ("run", "start"))
            fp = table.column("fp").to_numpy().view(np.uint64)
            first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            size = np.diff(np.r_[first, len(run)])
            a, b = [], []
            short = np.repeat(size <= SHORT_RUN, size)
            for d in range(1, SHORT_RUN):
                i = np.flatnonzero((run[d:] == run[:-d]) & short[d:])
                if not len(i):
                    break
                i = i[chained(fp[i] ^ fp[i + d], start[i], distance, segments)]
                a.append(i)
                b.append(i + d)
            for k in np.flatnonzero(size > SHORT_RUN):
                x, y = forest(fp[first[k] : first[k] + size[k]], distance)
                a.append(first[k] + np.array(x, np.int64))
                b.append(first[k] + np.array(y, np.int64))
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b))
            node = table.column("node").combine_chunks()
            pick = [node.take(pa.array(x)) for x in (a, b)]
            return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in pick], ["u", "v"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if waiting is not None:
                table = pa.concat_tables([waiting, table])
            run = table.column("run").to_numpy()
            if not len(run):
                continue
            cut = int(np.searchsorted(run, run[-1]))
            waiting = table.slice(cut)
            if cut:
                yield compared(table.slice(0, cut))
        if waiting is not None and waiting.num_rows:
            yield compared(waiting)

    return found


def fingerprint_links(nodes: DataFrame, distance: int = 4, segments: int = SEGMENTS, depth: int | None = None, long_run: int = LONG_RUN) -> DataFrame:
    """(u, v): links between nodes (node, fp), distinct in fp, that join all whose fingerprints differ in up to distance bits.

    Candidates share a ring key; they are compared where they meet, and of a large group only links enough to hold it
    together are returned, so the rows grow with the nodes and not with pairs. Groups above long_run are dealt out as
    pairs of blocks: each pair of members meets in one of them.
    """
    spark = nodes.sparkSession
    keys = ring_keys(distance, segments, depth or ring_depth(nodes.count(), distance, segments))
    rows = nodes.select("node", "fp", F.explode(F.array(*[F.struct(_key(k, exact, segments).alias("run"), F.lit(start).alias("start")) for k, (start, exact) in enumerate(keys)])).alias("k")).select("k.run", "k.start", "fp", "node")
    large = written(rows.groupBy("run").count().where(F.col("count") > long_run).withColumnRenamed("count", "n"), "long-runs")
    if large.count():
        rows = rows.join(large, "run", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / long_run), F.lit(1)).cast("int"))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        rows = rows.select("run", "start", "fp", "node", "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        pair = F.xxhash64("run", F.least("own", "other"), F.greatest("own", "other"))
        rows = rows.select(F.when(F.col("blocks") == 1, F.col("run")).otherwise(pair).alias("run"), "start", "fp", "node")
    rows = rows.repartition(parts(spark), "run").sortWithinPartitions("run")
    kind = nodes.schema["node"].dataType
    return rows.mapInArrow(_links(distance, segments), T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def _grouped(docs: DataFrame, extra: dict[str, Column], shingle: int, distance: int) -> DataFrame:
    """doc_id, the extra columns, fp and root: the least (has no doc_id, doc_id, fp) that links reach."""
    told = written(fingerprints(docs.select("doc_id", *[c.alias(k) for k, c in extra.items()], "text"), shingle), "fingerprints")
    nodes = told.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    nodes = written(nodes.select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp").alias("node")), "fingerprint-nodes")
    # nothing is linked but distinct fingerprints, so copies meet here and are never paired
    roots = written(connected_components(fingerprint_links(nodes, distance)).select(F.col("node.fp").alias("fp"), F.col("root")), "roots")
    own = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "node").alias("root"))
    return told.join(written(own, "fingerprint-roots"), "fp", "left")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, a row per row of docs: rows whose fingerprints differ in up
    to distance bits are linked, and component_id is the smallest doc_id that links reach (null only if none has one).

    A null text is an empty one; texts without words have the fingerprint zero and are linked like any other. Equal
    rows and equal doc_ids are rows of their own. An empty table gives no rows; other columns play no part.
    """
    out = _grouped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), {}, shingle, distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("root.doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, shingle: int = 5, distance: int = 4, similarity: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with all columns, without the near-duplicates of others: of each component the row with the smallest doc_id
    stays (the smallest hash of its text, then any one of equal rows, where rows share that doc_id; nulls come last).

    Rows are linked by fingerprints that differ in up to distance bits. With similarity these links are kept where the
    sets of shingles have that Jaccard similarity, and sets that fingerprints leave apart meet by their rarest shingles
    too: at 0.8 two fingerprints differ in about 10 of 64 bits, and at any distance that reaches them the ring's keys
    hold too few bits to part texts that have nothing in common. So no pair of the similarity is passed over. Null and
    empty texts are texts without words, which are alike; an empty table stays empty.
    """
    if similarity is not None:
        from loreweave.llm.similar_sets import one_of_each_similar  # which takes fingerprints and their links from here

        return one_of_each_similar(docs, shingle, similarity, distance, doc_id, text)
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    told = _grouped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), {"mark": F.xxhash64(F.coalesce("text", F.lit("")))}, shingle, distance)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    told = written(told.select("root", rank.alias("rank")), "group-ranks")
    first = told.groupBy("root").agg(F.min("rank").alias("rank"))
    kept = written(first.select("rank"), "kept-ranks")
    rows = docs.select(packed_row(docs).alias("row"), F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), mark.alias("mark")).alias("rank"))
    left = rows.join(kept, rows["rank"].eqNullSafe(kept["rank"]), "left_semi")
    if told.join(kept, told["rank"].eqNullSafe(kept["rank"]), "left_semi").count() > kept.count():  # equal rows among the kept
        left = left.dropDuplicates(["rank"])
    return left.select("row.*")

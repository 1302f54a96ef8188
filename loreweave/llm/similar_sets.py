"""Near-duplicates by the Jaccard similarity of shingle sets: SimHash links and, for what they leave apart, an exact prefix-filter join; verified pairs, then connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm.common import dropped, packed_row, parts, power_of_two, sent_if_small, written
from loreweave.llm.components import connected_components
from loreweave.llm.simhash import fingerprint_links, fingerprint_of, shingle_hashes

#: Shingles in OFTEN documents of a sample come last in the order of shingles, so that they rarely bring documents together.
#: The sample has SAMPLE documents or this share of all, whichever is more, so that often means the same at every size.
SAMPLE, SHARE, OFTEN = 15_000, 0.25, 3
#: The bit tables that are sent to every task have so many bits at most. Fuller ones prune less; results stay.
MOST_BITS = 1 << 22
#: Bits of a set's parities: as many as it has shingles, rounded up to a power of two, between these. Two sets differ in as
#: many shingles as their parities in bits, or more. Parities of far larger sets than the upper bound only prune less.
PARITIES, MOST_PARITIES = 1 << 10, 1 << 17
#: Odd factors, each of which orders sets in its own way.
ORDERS = (1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Buckets of up to so many sets are paired by offsets, larger ones by root and parities.
SHORT_BUCKET = 64


def shingle_set(body: bytes, shingle: int) -> np.ndarray:
    """The distinct XXH64 (seed 42) of the shingles of a text, ascending; of all its words where they are fewer. Empty without words."""
    return np.unique(shingle_hashes(body, shingle).view(np.int64))


def parities(s: np.ndarray) -> bytes:
    """For each remainder of a shingle's hash by the number of bits, whether an odd number of the set's shingles have it."""
    bits = min(MOST_PARITIES, max(PARITIES, power_of_two(len(s))))
    return np.packbits((np.bincount((s.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits the parities of each pair differ. The longer ones fold to the length of the others: a remainder by half
    as many is that of two bits, whose parity is their exclusive or."""
    out = np.zeros(len(a), np.int64)
    width = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    for m, n in np.unique(width, axis=0).tolist():
        at = np.flatnonzero((width == (m, n)).all(axis=1))
        fold = min(m, n) // 8
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([held[i] for i in at]), np.uint64).reshape(len(at), -1, fold), axis=1) for held in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def _folded(odd: list[bytes]) -> np.ndarray:
    """Parities of any length as PARITIES bits each."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, PARITIES // 64), axis=0) for x in odd])


def _bits(hashes: DataFrame) -> np.ndarray:
    """A table of one bit by hash (a long h); a hash without its bit is none of these."""
    bits = min(MOST_BITS, max(64, power_of_two(16 * hashes.count())))
    low = hashes.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("b"))
    out = np.zeros(bits // 64, np.int64)
    for r in low.groupBy(F.shiftright("b", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.view(np.uint64)


def _known(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    b = h.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return (table[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)) == 1


def _often(docs: DataFrame, shingle: int) -> np.ndarray:
    """The bit table of shingles in many documents of a sample."""
    share = min(1.0, max(SHARE, SAMPLE / max(1, docs.count())))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(x or b"", shingle) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(1 << 20)) < share * (1 << 20)).select("text")
    often = written(some.mapInArrow(made, "h long").groupBy("h").count().where(F.col("count") >= OFTEN).select("h"), "often-shingles")
    out = _bits(often)
    dropped(often)
    return out


def _prefixes(docs: DataFrame, often: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """The columns of docs but text, own (hash of the set), n (its size), common (how many of its shingles are often ones), fp (its text's fingerprint), parities and first: as many of its first shingles, in an
    order that is the same for all sets, that two sets of the similarity share one of theirs."""
    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("own", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("common", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("parities", T.BinaryType()), T.StructField("first", T.ArrayType(T.LongType()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n, common, fp, odd, first = [], [], [], [], [], []
            for body in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(body or b"", shingle)
                fp.append(fingerprint_of(hashes))
                s = np.unique(hashes.view(np.int64))
                own.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                n.append(len(s))
                odd.append(parities(s))
                late = _known(often, s)
                common.append(int(late.sum()))
                first.append(np.r_[s[~late], s[late]][: len(s) - ceil(similarity * len(s) - 1e-9) + 1])
            ends = np.r_[0, np.cumsum([len(x) for x in first])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.array(own, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(common, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(odd, pa.binary()), lists], schema.names)

    return docs.mapInArrow(made, schema)


def _by_bucket(made):
    """made over whole buckets: rows come sorted by key, and the last bucket of a batch waits for the next."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("key").to_numpy()
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if not cut and waiting and waiting[-1].column("key")[-1].as_py() == key[-1]:
                waiting.append(batch)
                continue
            yield from made(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = [batch.slice(cut)]
        if waiting:
            yield from made(pa.Table.from_batches(waiting))

    return told


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return first, np.diff(np.r_[first, len(key)])


@_by_bucket
def _shared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of keys that two sets or more have, without those that copies repeat."""
    key, own = (table.column(c).to_numpy() for c in ("key", "own"))
    table = table.filter(pa.array(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])][: len(key)]))
    size = _runs(table.column("key").to_numpy())[1]
    yield from table.filter(pa.array(np.repeat(size > 1, size))).combine_chunks().to_batches()


def _pairs(similarity: float, star: bool, often: np.ndarray):
    """(u, v) of buckets, of sets that differ in root: in a star each set with one of about its size, and sizes with the next;
    otherwise all that may be similar by their sizes.

    A set's rare shingles come before its often ones, so one with an often one among its first has all its rare ones there.
    Two such sets meet in another bucket if they share a rare one; here they count as if they share no more than often ones.
    """

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, own, n = (table.column(c).to_numpy() for c in ("key", "own", "n"))
        near = lambda i, j: np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9

        def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["u", "v"])

        if star:
            # a middle is the least set, in one of some orders, of a size class in the bucket: near copies share most buckets and middles
            size = np.floor(np.log(n) / -np.log(similarity)).astype(np.int64) if similarity < 1 else n
            new = np.r_[True, (key[1:] != key[:-1]) | (size[1:] != size[:-1])][: len(key)]
            first, part = np.flatnonzero(new), np.cumsum(new) - 1
            edge = np.flatnonzero(new[1:] & (key[1:] == key[:-1]))
            edge = edge[near(edge, edge + 1)]
            left, right = [own[edge]], [own[edge + 1]]
            for k in ORDERS if len(key) else ():
                mixed = own.view(np.uint64) * np.uint64(k)  # odd, so that no two become one
                middle = (np.minimum.reduceat(mixed, first) * np.uint64(pow(k, -1, 1 << 64))).view(np.int64)[part]
                left += [own, middle[edge]]
                right += [middle, middle[edge + 1]]
            left, right = np.concatenate(left), np.concatenate(right)
            ids, at = np.unique(own, return_index=True)
            root = table.column("root").to_numpy()[at]
            apart = root[np.searchsorted(ids, left)] != root[np.searchsorted(ids, right)]
            yield told(left[apart], right[apart])
            return
        root, common, late = table.column("root").to_numpy(), table.column("common").to_numpy(), _known(often, key)
        first, size = _runs(key)

        def possible(i, j):
            shared = np.where(late[i], np.minimum(common[i], common[j]), np.minimum(n[i], n[j]))
            return shared >= similarity * (n[i] + n[j] - shared) - 1e-9

        short = np.repeat(size <= SHORT_BUCKET, size)
        for d in range(1, SHORT_BUCKET):
            i = np.flatnonzero((key[d:] == key[:-d]) & short[d:])
            if not len(i):
                break
            i = i[(root[i] != root[i + d]) & possible(i, i + d)]
            yield told(own[i], own[i + d])
        for k in np.flatnonzero(size > SHORT_BUCKET):
            at = np.argsort(root[first[k] : first[k] + size[k]], kind="stable") + first[k]
            odd = _folded(table.column("parities").take(pa.array(at)).to_pylist())
            begin, length = _runs(root[at])
            for b, e in zip(begin, begin + length):
                for p in range(b, e):
                    i, j = at[p], np.arange(e, len(at))
                    j = j[possible(np.full(len(j), i), at[j])]
                    differ, both = np.bitwise_count(odd[p] ^ odd[j]).sum(axis=1, dtype=np.int64), n[i] + n[at[j]].astype(np.int64)
                    j = at[j[(both - differ) / 2 >= similarity * (both + differ) / 2 - 1e-9]]
                    if len(j):
                        yield told(np.full(len(j), own[i]), own[j])

    return _by_bucket(made)


def _possible(similarity: float):
    """(u, v) of the pairs whose sizes and parities leave room for the similarity."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ, both = _differing(batch.column("a").to_pylist(), batch.column("b").to_pylist()), batch.column("n").to_numpy()
            good = (both - differ) / 2 >= similarity * (both + differ) / 2 - 1e-9
            yield batch.select(["u", "v"]).filter(pa.array(good))

    return made


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole sets have the similarity."""
    odd = nodes.select("own", "n", "parities")
    pairs = pairs.join(odd.toDF("u", "un", "a"), "u").join(odd.toDF("v", "vn", "b"), "v").select("u", "v", (F.col("un") + F.col("vn")).alias("n"), "a", "b")
    pairs = written(pairs.mapInArrow(_possible(similarity), "u long, v long"), "possible-pairs")
    ends = pairs.select(F.col("u").alias("own"), "u", "v").union(pairs.select(F.col("v").alias("own"), "u", "v"))
    asked = written(nodes.join(ends.select("own").distinct(), "own", "left_semi").select("own", "row"), "asked-sets")
    table = _bits(asked.select(F.col("row").alias("h")))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_known(table, batch.column("row").to_numpy())))
            sets = [shingle_set(x or b"", shingle) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            own = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(own), pa.array([s.tobytes() for s in sets], pa.binary())], ["row", "own", "held"])

    # one row holds a set, so each set is shuffled once for each pair that it is in, and nowhere else
    found = docs.select("row", "text").mapInArrow(made, "row long, own long, held binary").join(asked, ["own", "row"], "left_semi")
    met = found.join(ends, "own").select("u", "v", "own", "held").repartition(parts(docs.sparkSession), "u", "v").sortWithinPartitions("u", "v", "own")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first = None, None
        for batch in batches:
            good = []
            for u, v, own, held in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "own")), batch.column("held")):
                held = np.frombuffer(held.as_buffer(), np.int64)
                if pair != (u, v):
                    pair, first = (u, v), (own, held)
                elif first and own != first[0]:
                    same = len(np.intersect1d(first[1], held, assume_unique=True))
                    if same >= similarity * (len(first[1]) + len(held) - same) - 1e-9:
                        good.append(pair)
                    first = None  # rows that repeat a set are passed over
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in good], pa.int64()) for i in (0, 1)], ["u", "v"])

    out = written(met.mapInArrow(compared, "u long, v long"), "similar-sets")
    for x in (asked, pairs):
        dropped(x)
    return out


def fingerprint_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """(u, v), u < v: pairs that join all nodes (own, fp, n) whose fingerprints differ in up to distance bits, as operator 5
    links them; those with one fingerprint are a star. Sets without shingles are left out."""
    nodes = nodes.where("n > 0").select("own", "fp")
    heads = written(nodes.groupBy("fp").agg(F.min("own").alias("node")), "fingerprint-heads")
    met = fingerprint_links(heads, distance).unionByName(nodes.join(heads, "fp").select(F.col("node").alias("u"), F.col("own").alias("v")))
    pairs = written(met.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "fingerprint-pairs")
    dropped(heads)
    return pairs


def _apart(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of buckets whose sets links do not join, with root (where they lead) and size (the bucket's), as a written table."""
    roots_of = written(connected_components(links), "link-roots")
    rooted = buckets.join(roots_of.withColumnRenamed("node", "own"), "own", "left").select("key", "own", "n", "common", F.coalesce("root", "own").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size")).where("a <> b").select("key", "size")
    out = written(rooted.join(mixed, "key"), "apart")
    dropped(roots_of)
    return out


def similar_links(docs: DataFrame, told: DataFrame, nodes: DataFrame, often: np.ndarray, shingle: int, similarity: float, distance: int) -> DataFrame:
    """(u, v): links between nodes (own, row, n, fp, parities), the distinct sets of told, that join all whose sets have the similarity.

    Links of fingerprints come first and stay where the sets have the similarity. Fingerprints of similar sets may lie further
    apart than distance; such sets share one of their first shingles. Of each such bucket that is not joined yet first a star
    is verified, then what is still apart; so of a group of many near copies a few pairs are looked at, and none is passed over.
    """
    near = fingerprint_pairs(nodes, distance)
    links = _verified(docs, nodes, near, shingle, similarity)
    rows = told.where("n > 0").select(F.explode("first").alias("key"), "own", "n", "common")
    rows = rows.repartition(parts(docs.sparkSession), "key").sortWithinPartitions("key", "own")
    buckets = written(rows.mapInArrow(_shared, rows.schema), "buckets")
    some = _apart(buckets, links)
    dropped(buckets)
    ordered = some.drop("size").repartition(parts(docs.sparkSession), "key").sortWithinPartitions("key", "n", "own")
    pairs = written(ordered.mapInArrow(_pairs(similarity, True, often), "u long, v long").distinct().join(near, ["u", "v"], "left_anti"), "star-pairs")
    links = links.unionByName(_verified(docs, nodes, pairs, shingle, similarity))
    apart = _apart(some.drop("root", "size"), links)
    dropped(some)
    short, long = apart.where(F.col("size") <= SHORT_BUCKET), apart.where(F.col("size") > SHORT_BUCKET)
    both = short.withColumn("parities", F.lit(None).cast("binary")).unionByName(long.join(nodes.select("own", "parities"), "own").select(*long.columns, "parities"))
    both = both.drop("size").repartition(parts(docs.sparkSession), "key").sortWithinPartitions("key", "n", "own")
    rest = both.mapInArrow(_pairs(similarity, False, often), "u long, v long").distinct()
    rest = written(rest.join(pairs.unionByName(near), ["u", "v"], "left_anti"), "rest-pairs")
    for x in (near, pairs, apart):
        dropped(x)
    more = _verified(docs, nodes, rest, shingle, similarity)
    dropped(rest)
    return links.unionByName(more)


def one_of_each_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with all columns, without the near-duplicates of others: rows whose sets of shingles have the Jaccard
    similarity are linked, and of each component the row with the smallest doc_id stays (the smallest hash of its text,
    then any one of equal rows, where rows share that doc_id; nulls come last).

    Words are what ASCII white space parts, A-Z lower-cased. A text of fewer words than a shingle is one shingle; texts
    without words are alike. Links are sought by fingerprints within distance bits first; no similar pair is passed over. A null text is an empty one.
    """
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    plain = docs.select(F.col(doc_id).alias("doc_id"), mark.alias("mark"), F.xxhash64(F.col(doc_id), mark).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    often = _often(plain, shingle)
    told = written(_prefixes(plain, often, shingle, similarity), "shingle-prefixes")
    nodes = written(told.select("own", "row", "n", "fp", "parities").dropDuplicates(["own"]), "shingle-sets")
    roots = written(connected_components(similar_links(plain, told, nodes, often, shingle, similarity, distance)).select(F.col("node").alias("own"), "root"), "set-roots")
    dropped(nodes)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    ranks = written(told.select("own", rank.alias("rank")).join(roots, "own", "left").select(F.coalesce("root", "own").alias("root"), "rank"), "set-ranks")
    dropped(told)
    first = ranks.groupBy("root").agg(F.min("rank").alias("least"))
    ranks = written(ranks.join(first, "root").select("rank", F.col("rank").eqNullSafe(F.col("least")).alias("kept")), "kept-ranks")
    # a table of its own and of fewer rows than are kept, so that its size is known and texts need seldom be shuffled
    gone = sent_if_small(written(ranks.where(~F.col("kept")).select("rank").distinct(), "gone-ranks"), "rank")
    rows = docs.select(packed_row(docs).alias("row"), F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), mark.alias("mark")).alias("rank"))
    left = rows.join(gone, rows["rank"].eqNullSafe(gone["rank"]), "left_anti")
    if ranks.where("kept").groupBy("rank").count().where("count > 1").limit(1).count():  # equal rows among the kept
        left = left.dropDuplicates(["rank"])
    return left.select("row.*")

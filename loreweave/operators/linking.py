"""Entity links: all names in one index, which reads the bytes of each passage once, in step with their number."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of names in an index, which takes some six times as much. More names make more shards, and each reads the passages.
SHARD_BYTES = 64 << 20
#: Names with their ids are sent to the matches up to so many bytes, and joined beyond.
SENT_BYTES = 32 << 20
#: Bytes of text that are looked at together, and lengths of names that are tried together.
WINDOW, TRIED = 1 << 20, 1 << 20
#: A name's hash is the sum of its bytes by powers of BASE, without carry beyond 64 bits; equal hashes are compared byte by byte.
BASE, MIX, CLASS = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_built: dict[str, Index] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers from first[i] on, count[i] of them: which i, and which number."""
    i = np.repeat(np.arange(len(count)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count - first, count)


def _pieces(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes add up to about most."""
    part = np.cumsum(size) // most
    edge = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(size)] if len(size) else np.zeros(1, np.int64)
    yield from (slice(a, b) for a, b in zip(edge[:-1], edge[1:]))


def _words(held: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; beyond the end are zeros."""
    x = np.r_[held, np.zeros(7, np.uint8)].astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    return x


def _start(word: np.ndarray, c: int) -> np.ndarray:
    """The first c of eight bytes, mixed."""
    return (word & np.uint64((1 << 8 * c) - 1)) * np.uint64(MIX) + np.uint64(c * CLASS % (1 << 64))


class Index:
    """Names (bytes, none of them empty, all different) by what they begin with, by length and by hash."""

    def __init__(self, data: np.ndarray, end: np.ndarray) -> None:
        self.data, self.size = data, np.diff(np.r_[0, end])
        self.at, self.longest = end - self.size, int(self.size.max())
        self.power, self.inverse = _powers(BASE, WINDOW + self.longest), _powers(pow(BASE, -1, 1 << 64), WINDOW)
        own, start, few = np.zeros(len(end), np.uint64), np.zeros(len(end), np.uint64), np.minimum(self.size, 8)
        for s in _pieces(self.size, WINDOW):
            i, place = _spread(np.zeros(s.stop - s.start, np.int64), self.size[s])
            held = data[self.at[s.start] : end[s.stop - 1]]
            first = self.at[s] - self.at[s.start]
            own[s] = np.add.reduceat(held * self.power[place], first)
            word = _words(held)[first]
            for c in np.unique(few[s]).tolist():
                start[s] = np.where(few[s] == c, _start(word, c), start[s])
        self.classes = np.unique(few).tolist()
        order = np.argsort(own, kind="stable")
        self.own, self.name = own[order], order
        both = np.unique(np.stack([start, self.size.astype(np.uint64)]), axis=1)
        self.start, self.first, self.lengths = *np.unique(both[0], return_index=True), both[1].astype(np.int64)
        self.first = np.r_[self.first, len(self.lengths)]
        bits = max(6, (16 * len(self.start)).bit_length())
        self.shift, mark = np.uint64(64 - bits), self.start >> np.uint64(64 - bits)
        self.known = np.zeros(1 << bits - 6, np.uint64)
        np.bitwise_or.at(self.known, (mark >> np.uint64(6)).astype(np.int64), np.uint64(1) << (mark & np.uint64(63)))

    def _same(self, held: np.ndarray, at: np.ndarray, name: np.ndarray) -> np.ndarray:
        out, size = np.ones(len(at), bool), self.size[name]
        for s in _pieces(size, 4 * WINDOW):
            i, place = _spread(at[s], size[s])
            j = place - at[s][i] + self.at[name[s]][i]
            out[s.start + i[held[place] != self.data[j]]] = False
        return out

    def _within(self, held: np.ndarray, n: int, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(at, name) of what may begin in the first n bytes and ends at stop or before: hashes are equal."""
        word = _words(held)[:n]
        total = np.r_[np.uint64(0), np.cumsum(held * self.power[: len(held)], dtype=np.uint64)]
        for c in self.classes:
            start = _start(word, c)
            mark = start >> self.shift
            at = np.flatnonzero(self.known[(mark >> np.uint64(6)).astype(np.int64)] >> (mark & np.uint64(63)) & np.uint64(1))
            k = np.minimum(np.searchsorted(self.start, start[at]), len(self.start) - 1)
            good = self.start[k] == start[at]
            at, k = at[good], k[good]
            count = self.first[k + 1] - self.first[k]
            for s in _pieces(count, TRIED):
                i, j = _spread(self.first[k[s]], count[s])
                begin, end = at[s][i], at[s][i] + self.lengths[j]
                inside = end <= stop[begin]
                begin, end = begin[inside], end[inside]
                own = (total[end] - total[begin]) * self.inverse[begin]
                low, high = np.searchsorted(self.own, own), np.searchsorted(self.own, own, "right")
                i, j = _spread(low, high - low)
                yield begin[i], self.name[j]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, name, position) of the names in texts that lie one behind the other, each where it stands first (code points, from 1)."""
        out = [(np.zeros(0, np.int64),) * 3]
        for begin in range(offsets[0], offsets[-1], WINDOW):
            n = min(WINDOW, int(offsets[-1]) - begin)
            held = data[begin : min(begin + n + self.longest - 1, int(offsets[-1]))]
            rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, begin, begin + n)))
            for at, name in self._within(held, n, offsets[rows + 1] - begin):
                key, order = rows[at] * len(self.size) + name, np.argsort(at, kind="stable")
                while len(order):  # the first of a row and name; the next of them where it only has the hash
                    first = order[np.unique(key[order], return_index=True)[1]]
                    good = self._same(held, at[first], name[first])
                    out.append((rows[at[first[good]]], name[first[good]], at[first[good]] + begin))
                    order = order[~np.isin(key[order], key[first[good]]) & ~np.isin(order, first[~good])]
        row, name, at = map(np.concatenate, zip(*out))
        order = np.argsort(at, kind="stable")
        first = order[np.unique((row * len(self.size) + name)[order], return_index=True)[1]]
        row, name, at = row[first], name[first], at[first]
        points = np.r_[0, np.cumsum((data[offsets[0] : offsets[-1]] & 0xC0) != 0x80)]
        return row, name, points[at - offsets[0]] - points[offsets[row] - offsets[0]] + 1


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, and where each begins in them and the last ends."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def _index(key: str, sent: tuple[bytes, bytes]) -> Index:
    """Kept by a worker until it needs another."""
    if key not in _built:
        _built.clear()
        _built[key] = Index(np.frombuffer(sent[0], np.uint8), np.frombuffer(sent[1], np.int64))
    return _built[key]


def _shards(names: DataFrame, most: int) -> Iterator[pa.Array]:
    """Distinct names in shards of about most bytes; a name has its shard by hash."""
    size = F.octet_length("name") + 1
    n = max(1, ceil(names.agg(F.coalesce(F.sum(size), F.lit(0))).collect()[0][0] / most))
    for i in range(n):
        shard = names.where(F.pmod(F.xxhash64("name"), F.lit(n)) == i).select("name").toArrow().column("name").combine_chunks()
        if len(shard):
            yield pa.concat_arrays(shard.chunks) if isinstance(shard, pa.ChunkedArray) else shard


def links(passages: DataFrame, named: DataFrame, shard_bytes: int = SHARD_BYTES, sent_bytes: int = SENT_BYTES, carried: tuple[str, ...] = ()) -> DataFrame:
    """passage_id, entity_id, canonical_name, entity_type, position: entities whose name stands, in any case, in a passage,
    and where it stands first (code points, from 1). carried: more columns of the passages.

    A shard's names are searched together, so a passage costs its length and its matches, however many names there are.
    Nothing of a text is shuffled: what leaves a task is a row per passage and name. Null texts and empty names match nothing; names alike but for
    case are found together.
    """
    spark = passages.sparkSession
    heads = named.select("entity_id", "canonical_name", "entity_type", F.lower("canonical_name").alias("name")).where("name <> ''")
    kept = ["passage_id", *carried]
    low = passages.where(F.col("text").isNotNull()).select(*kept, F.lower("text").alias("low"))
    schema = ", ".join([*(f"{c} {passages.schema[c].dataType.simpleString()}" for c in kept), "name string, position int"])

    def search(names: pa.Array) -> DataFrame:
        data, offsets = _bytes(names)
        sent, key = spark.sparkContext.broadcast((data[offsets[0] : offsets[-1]].tobytes(), (offsets[1:] - offsets[0]).tobytes())), uuid.uuid4().hex

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(key, sent.value)
            end = np.frombuffer(sent.value[1], np.int64)
            held = pa.Array.from_buffers(pa.large_string(), len(end), [None, pa.py_buffer(np.r_[0, end].astype(np.int64)), pa.py_buffer(sent.value[0])])
            for batch in batches:
                row, name, at = index.search(*_bytes(batch.column("low")))
                for i in range(0, len(row), 1 << 16):
                    some, s = pa.array(row[i : i + (1 << 16)]), slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in kept), held.take(pa.array(name[s])).cast(pa.string()), pa.array(at[s], pa.int32())], [*kept, "name", "position"])

        return low.mapInArrow(found, schema)

    searched = [search(x) for x in _shards(heads.select("name").distinct(), shard_bytes)]
    if not searched:
        return low.select(*kept).crossJoin(named.select("entity_id", "canonical_name", "entity_type").limit(0)).withColumn("position", F.lit(0)).select("passage_id", "entity_id", "canonical_name", "entity_type", "position", *carried).where("false")
    size = heads.agg(F.sum(F.octet_length("canonical_name") * 2 + F.octet_length("entity_id") + 64)).collect()[0][0]
    met = reduce(DataFrame.unionByName, searched).join(F.broadcast(heads) if size <= sent_bytes else heads, "name")
    return met.select("passage_id", "entity_id", "canonical_name", "entity_type", "position", *carried)

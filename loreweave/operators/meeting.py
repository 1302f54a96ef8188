"""Rows with tokens in common: rare tokens bring them together, sizes, places and parities tell most unlike ones apart, blocks at a time."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.operators.linking import _pieces, _spread

#: Tokens whose counts are sent to the rows, the most frequent ones; all others come before them in the order of rarity.
COUNTED = 1 << 20
#: Tokens, and pairs of rows, that are looked at together.
WINDOW = 1 << 20
#: Rows of a block that meet in one task. Larger blocks are cut into parts, and each two of these meet apart.
SIDE = 1 << 13
#: Rows of a block from which on they are compared as tiles of so many with the others, in place of pairs.
TILED = 64
#: Longs of a row's parities: for each bit, whether an odd number of its tokens has it.
PARITIES = 4

_PARITY = [f"p{n}" for n in range(PARITIES)]
_KEYED = ", ".join(["id string, block long, cell int, side int, size int, pos int", *(f"{p} long" for p in _PARITY)])


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Tokens in order and their counts, by powers of two downwards as long as they are most at most; and whether all others stand alone."""
    level = F.length(F.bin("count"))
    by_level = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    least, total = max(by_level, default=1) + 1, 0
    while least > 2 and total + by_level.get(least - 1, 0) <= most:
        least -= 1
        total += by_level.get(least, 0)
    held = counts.where(level >= least).toArrow()
    token, count = held.column("token").to_numpy(), held.column("count").to_numpy()
    order = np.argsort(token)
    return token[order], count[order], least <= 2


def _keyed(rows: DataFrame, least: float, every: bool, most: int, side: int) -> DataFrame:
    """A row per id and rare token of it: the token's block, cell and side, the row's size, where the token stands in it, and its parities."""
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").count()
    n_zero = rows.count() if every else rows.where(F.size("tokens") == 0).count()
    token, count, alone = (np.zeros(0, np.int64), np.zeros(0, np.int64), False) if every else _frequent(counts, most)
    sent = rows.sparkSession.sparkContext.broadcast((token.tobytes(), count.tobytes()))

    def one(ids: pa.Array, salt: np.ndarray, size: np.ndarray, tok: np.ndarray, known: np.ndarray, known_count: np.ndarray) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(size)), size)
        start = np.cumsum(size) - size
        n = np.zeros(len(tok), np.int64)
        if len(known):
            k = np.minimum(np.searchsorted(known, tok), len(known) - 1)
            n = np.where(known[k] == tok, known_count[k], 0)
        order = np.lexsort((tok, n, row))
        tok, n, pos = tok[order], n[order], np.arange(len(tok)) - start[row]
        bits, some = tok.view(np.uint64), size > 0
        parity = np.zeros((PARITIES, len(size)), np.uint64)
        for p in range(PARITIES if len(tok) else 0):
            own = np.where(bits & np.uint64(PARITIES - 1) == p, np.uint64(1) << (bits >> np.uint64(8) & np.uint64(63)), np.uint64(0))
            parity[p, some] = np.bitwise_xor.reduceat(own, start[some])
        if every:
            at, pos, block, n = np.arange(len(size)), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.full(len(size), n_zero)
        else:
            keep = pos < (size - np.ceil(least * size - 1e-9).astype(np.int64) + 1)[row]
            if alone:
                keep &= n > 1
            none = np.flatnonzero(~some)
            at, pos, block, n = np.r_[row[keep], none], np.r_[pos[keep], 0 * none], np.r_[tok[keep], 0 * none], np.r_[n[keep], 0 * none + n_zero]
        parts = np.maximum(1, -(-n // side))
        part = salt[at] % parts
        i, other = _spread(np.zeros(len(at), np.int64), parts)
        low, high = np.minimum(part[i], other), np.maximum(part[i], other)
        sides = np.where(parts[i] == 1, 0, np.where(low == high, 0, np.where(part[i] == low, 1, 2)))
        cell, at, pos, block = low * parts[i] + high, at[i], pos[i], block[i]
        for s in range(0, len(at), 1 << 16):
            s = slice(s, s + (1 << 16))
            a = at[s]
            columns = [ids.take(pa.array(a)), pa.array(block[s]), pa.array(cell[s], pa.int32()), pa.array(sides[s], pa.int32()), pa.array(size[a], pa.int32()), pa.array(pos[s], pa.int32()), *(pa.array(parity[p, a].view(np.int64)) for p in range(PARITIES))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "block", "cell", "side", "size", "pos", *_PARITY])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_count = (np.frombuffer(x, np.int64) for x in sent.value)
        for batch in batches:
            size = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
            tok, end = batch.column("tokens").flatten().to_numpy(), np.cumsum(size)
            for s in _pieces(size, WINDOW):
                yield from one(batch.column("id").slice(s.start, s.stop - s.start), batch.column("salt").to_numpy()[s], size[s], tok[end[s.start] - size[s.start] : end[s.stop - 1]], known, known_count)

    return rows.select("id", "tokens", F.pmod(F.xxhash64("id"), F.lit(1 << 62)).alias("salt")).mapInArrow(keyed, _KEYED)


def _alike(x: dict[str, np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of the same block and cell, which lie together and by size, that may have a Jaccard of least or more."""
    n = len(x["block"])
    new = np.r_[True, (x["block"][1:] != x["block"][:-1]) | (x["cell"][1:] != x["cell"][:-1])] if n else np.zeros(0, bool)
    group, size, parity = np.cumsum(new), x["size"].astype(np.int64), [x[p].view(np.uint64) for p in _PARITY]
    wide, left, share = int(size.max(initial=0)) + 2, size - x["pos"], least / (1 + least)
    # the smaller of two rows has tokens enough from its place on for another of so many tokens at most
    longest = np.full(n, wide - 1) if not share else np.clip(np.floor(left / share + 1e-6).astype(np.int64) - size, 0, wide - 1)
    end = np.searchsorted(group * wide + size, group * wide + longest, "right")
    count = np.maximum(end - np.arange(n) - 1, 0)

    def left_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = size[a] + size[b]
        need = np.ceil(share * both - 1e-9).astype(np.int64)
        good = (np.minimum(left[a], left[b]) >= need) & ((x["side"][a] == 0) | (x["side"][a] != x["side"][b]))
        a, b, apart = a[good], b[good], (both - 2 * need)[good]
        for p in parity:
            apart = apart - np.bitwise_count(p[a] ^ p[b])
            good = apart >= 0
            a, b, apart = a[good], b[good], apart[good]
        return a, b

    edge = np.flatnonzero(np.r_[new, True])
    large = np.diff(edge) >= TILED
    many = np.repeat(large, np.diff(edge))
    few = np.where(many, 0, count)
    for s in _pieces(few, WINDOW):
        a, b = _spread(np.arange(s.start, s.stop) + 1, few[s])
        yield left_of(a + s.start, b)
    reach = ((1 - 2 * share) * size + 1e-3).astype(np.float32)  # more than the bits that are let through, by little
    for g in np.flatnonzero(large).tolist():
        own = np.arange(edge[g], edge[g + 1])
        own = own[count[own] > 0]
        for k in range(0, len(own), TILED):
            a = own[k : k + TILED]
            for begin in range(int(a[0]) + 1, int(end[a].max()), WINDOW // TILED):
                b = slice(begin, min(begin + WINDOW // TILED, int(end[a].max())))
                apart = np.bitwise_count(parity[0][a, None] ^ parity[0][b]).astype(np.uint16)
                for p in parity[1:]:
                    apart += np.bitwise_count(p[a, None] ^ p[b])
                i, j = np.nonzero(apart <= reach[a, None] + reach[b])
                i, j = a[i], j + begin
                after = (j > i) & (j < end[i])
                yield left_of(i[after], j[after])


def candidates(rows: DataFrame, least: float, most: int = COUNTED, side: int = SIDE) -> DataFrame:
    """i, j with i before j: all pairs of rows (id, tokens: hashes of a set) that have a Jaccard of least or more, and a few others. Null
    tokens meet nothing; rows without any meet each other.

    Such a pair shares one of the rarest tokens that prefix filtering keeps of each row. A block is what shares one; there a row is only
    its size, where the token stands in it and its parities: tokens from there on must suffice, and parities differ in no more
    bits than sets that alike can have tokens apart. Pairs are looked at as numbers, many blocks together, and only
    what is left of them leaves a task. Where nothing is excluded by tokens, every pair is a candidate.
    """
    every, least = least <= 1e-9, max(least, 0.0)
    keyed = _keyed(rows.where("tokens is not null"), least, every, most, side)
    names = ["block", "cell", "side", "size", "pos", *_PARITY]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: pa.Table) -> Iterator[pa.RecordBatch]:
            x, ids = {c: held.column(c).to_numpy() for c in names}, held.column("id").combine_chunks()
            for a, b in _alike(x, least):
                for s in range(0, len(a), 1 << 16):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[s : s + (1 << 16)])), ids.take(pa.array(b[s : s + (1 << 16)]))], ["a", "b"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            block, cell = held.column("block").to_numpy(), held.column("cell").to_numpy()
            change = np.flatnonzero((block[1:] != block[:-1]) | (cell[1:] != cell[:-1]))
            if len(change) and held.num_rows >= 1 << 15:  # the last block may go on
                yield from pairs(held.slice(0, change[-1] + 1))
                held = held.slice(change[-1] + 1).combine_chunks()
        if held is not None and held.num_rows:
            yield from pairs(held)

    met = keyed.repartition("block", "cell").sortWithinPartitions("block", "cell", "size").mapInArrow(meet, "a string, b string")
    return met.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).where("i < j").distinct()

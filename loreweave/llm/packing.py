"""Packing (operator 7): first-fit decreasing over a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm.tokens import encoder

#: Bytes of text of a group, about, and what a document counts besides its text: a group's ids are packed in one task.
GROUP, EACH = 4_000_000, 64
#: A gap of fewer tokens stays padding; larger ones are filled by cutting pieces of the emptiest sequences.
LEAST_CUT = 16


class Tournament:
    """The winner of each node is the largest room below it; the first bin with room enough is found from the root."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size, which it then loses."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bin_ = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Places of sizes in each bin. Every size is from 1 to capacity."""
    tree, bins = Tournament(max(1, len(sizes)), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if (at := tree.place(sizes[i])) == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack(sizes: list[int], capacity: int, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length). Items are cut to whole sequences first; what is left goes by first-fit
    decreasing; then gaps of least_cut or more are filled from the emptiest sequences, which are so used up."""
    whole = [[(i, s, capacity)] for i, n in enumerate(sizes) for s in range(0, n - capacity + 1, capacity)]
    rest = [(i, n - n % capacity, n % capacity) for i, n in enumerate(sizes) if n % capacity]
    bins = [[rest[k] for k in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    room = [capacity - sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (room[b], b))
    to, frm = 0, len(order) - 1
    while to < frm:
        a, b = order[to], order[frm]
        if room[a] < least_cut:
            to += 1
        elif not bins[b]:
            frm -= 1
        else:
            i, s, n = bins[b].pop()
            took = min(n, room[a])
            bins[a].append((i, s, took))
            room[a], room[b] = room[a] - took, room[b] + took
            if took < n:
                bins[b].append((i, s + took, n - took))
    return whole + [b for b in bins if b]


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", group: int = GROUP, seed: int = 0, with_ids: bool = True, special_as_text: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids (little-endian unsigned 32-bit):
    a row per piece; each id of each document, end_id after its last included, lies in one piece of one sequence.

    Groups of about group bytes of text are random, so that no key or source fills one; a document is in one group, which
    a longer document fills alone or nearly. Null and empty texts have the end id alone. Strings of the vocabulary's
    special tokens become these tokens, as the library has it, unless special_as_text. Repeated rows are packed each. An empty table gives no rows. Sequence ids are the same for the same
    input files and partitions.
    """
    held = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + EACH), F.lit(0))).collect()[0][0]
    groups = max(1, round(held / group))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_field = T.StructField("doc_id", d.schema["doc_id"].dataType)
    tokens = T.StructType([T.StructField("grp", T.LongType()), T.StructField("place", T.LongType()), id_field, T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())])

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row = encoder(tokenizer, special_as_text), TaskContext.get().partitionId(), 0
        end = encode.packed([end_id])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = [x + end for x in encode.encode(batch.column("text").to_pylist())]
                place = [part << 40 | row + i for i in range(len(ids))]
                row += len(ids)
                grp = [zlib.crc32(f"{seed}:{p}".encode()) % groups for p in place]
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(place, pa.int64()), batch.column("doc_id"), pa.array([encode.width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], tokens.names)

    out = T.StructType([id_field, *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], *[T.StructField("ids", T.BinaryType())] * with_ids])

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        width = table.column("width")[0].as_py() if table.num_rows else 4
        runs = [np.frombuffer(x.as_buffer(), f"<u{width}").astype("<u4") for x in table.column("ids")]
        grp = table.column("grp")[0].as_py()
        doc, rows, kept = [], [], []
        for k, sequence in enumerate(pack([len(r) for r in runs], capacity)):
            offset = 0
            for i, start, length in sequence:
                ids = runs[i][start : start + length].tobytes()
                doc.append(i)
                rows.append((start, length, zlib.crc32(ids), len(runs[i]), grp << 32 | k, offset))
                offset += length
                if with_ids:
                    kept.append(ids)
        columns = [table.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*rows))]
        return pa.Table.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, out.names)

    return d.mapInArrow(tokenized, tokens).groupBy("grp").applyInArrow(packed, out)

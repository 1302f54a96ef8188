"""Merkle dataset manifest (operator 12): blocks of leaves are reduced where they lie, the driver builds the small tree
above them and broadcasts its paths, executors append those to the paths inside their blocks."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import dropped, numbered, packed_row, parts, sent_if_small, written

#: Nodes above the blocks that the driver may hold, and the least height of a block.
TOP_NODES, LEAST_HEIGHT = 1 << 14, 5
#: Rows of a batch that leaves a block.
BATCH = 4096
PROOF = "array<struct<place:int,siblings:array<string>>>"


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the values one after another: - for null, else UTF-8 byte count, a colon, the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels(leaves: list[str], arity: int, height: int | None = None) -> list[list[str]]:
    """The nodes from the leaves up: so many steps, or until one node is left."""
    out = [leaves]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        below = out[-1]
        out.append([node(below[i : i + arity]) for i in range(0, len(below), arity)])
    return out


def path(tree: list[list[str]], at: int, arity: int) -> list[tuple[int, list[str]]]:
    """From a leaf up: its place in its run and the others of the run, for every level but the top."""
    out = []
    for below in tree[:-1]:
        first = at - at % arity
        run = below[first : first + arity]
        out.append((at - first, run[: at - first] + run[at - first + 1 :]))
        at //= arity
    return out


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    joined = lambda x, a, n: F.array_join(F.slice(x["siblings"], a, n), "")
    return F.aggregate(proof, leaf, lambda d, x: F.sha2(F.concat(joined(x, F.lit(1), x["place"]), d, joined(x, x["place"] + 1, F.size(x["siblings"]))), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda x: x["siblings"])), ""), 256)


def _forest(leaves: DataFrame, arity: int, top_nodes: int, least_height: int) -> DataFrame:
    """(grp, pos, leaf, row) to (grp, row, leaf, top, proof): a tree for each grp over its leaves by pos, which counts from 0.

    A block is arity ** height leaves. The height follows the number of leaves, so that the blocks of all trees with more
    than one, twice that ratio at most, are never more than top_nodes: these alone reach the driver.
    """
    spark = leaves.sparkSession
    total, height = leaves.count(), least_height
    while 2 * total > top_nodes * arity**height:
        height += 1
    wide = arity**height
    dealt = leaves.withColumn("block", F.expr(f"pos div {wide}")).repartition(parts(spark), "grp", "block").sortWithinPartitions("grp", "block", "pos")

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
        """Rows come sorted by block; one is held at a time."""
        own, held = None, []
        for batch in batches:
            grp, block, first = batch.column("grp").to_pylist(), batch.column("block").to_pylist(), 0
            for i in range(batch.num_rows):
                if (grp[i], block[i]) != own:
                    if own is not None:
                        yield *own, pa.Table.from_batches([*held, batch.slice(first, i - first)])
                    own, held, first = (grp[i], block[i]), [], i
            held.append(batch.slice(first))
        if own is not None:
            yield *own, pa.Table.from_batches(held)

    def tree_of(block: int, table: pa.Table) -> tuple[list[list[str]], bool]:
        """A block's levels; whether that is the whole tree."""
        own = table.column("leaf").to_pylist()
        alone = block == 0 and len(own) < wide
        return levels(own, arity, None if alone else height), alone

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, block, table in by_block(batches):
            tree, alone = tree_of(block, table)
            if not alone:
                yield pa.RecordBatch.from_pydict({"grp": [grp], "block": [block], "digest": tree[-1]})

    tops: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for r in dealt.select("grp", "block", "leaf").mapInArrow(roots, "grp long, block long, digest string").collect():  # top_nodes at most
        tops[r["grp"]].append((r["block"], r["digest"]))
    above = {grp: levels([d for _, d in sorted(blocks)], arity) for grp, blocks in tops.items()}
    sent = spark.sparkContext.broadcast({(grp, b): (path(tree, b, arity), tree[-1][0]) for grp, tree in above.items() for b in range(len(tree[0]))})

    kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, block, table in by_block(batches):
            tree, alone = tree_of(block, table)
            more, top = ([], tree[-1][0]) if alone else sent.value[grp, block]
            for first in range(0, table.num_rows, BATCH):
                part = table.slice(first, BATCH).combine_chunks()
                proofs = [[{"place": p, "siblings": s} for p, s in [*path(tree, first + i, arity), *more]] for i in range(part.num_rows)]
                columns = [part.column(k).combine_chunks() for k in ("grp", "leaf", "row")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([top] * part.num_rows), pa.array(proofs, kind)], ["grp", "leaf", "row", "top", "proof"])

    row = leaves.schema["row"].dataType.simpleString()
    return dealt.select("grp", "block", "leaf", "row").mapInArrow(paths, f"grp long, leaf string, row {row}, top string, proof {PROOF}")


def merkle_manifest(rows: DataFrame, group: str = "source", key: str = "doc_id", leaf: str = "leaf", arity: int = 3, top_nodes: int = TOP_NODES, least_height: int = LEAST_HEIGHT) -> DataFrame:
    """rows with subroot, root and proof: a tree over the leaves of each group in order of key, and one over the subroots.

    While more than one node remains, runs of arity neighbours become the digest of their digests; the last run may be
    shorter, also one node alone; a single leaf is its own subroot. Groups are ordered by their UTF-8 bytes, null first.
    proof has, from the leaf to the root, the place of the node in its run and the digests of the others in it.
    Keys in order, null first; rows that share a key are ordered by leaf, and equal ones stand side by side. rows may have
    any columns; those named like a result are replaced. An empty table gives no rows. Rows should be small: texts stay behind.
    """
    kept = [c for c in rows.columns if c not in ("subroot", "root", "proof")]
    plain = written(rows.select(*[F.col(f"`{c}`") for c in kept]).select(F.col(f"`{group}`").alias("g"), F.col(f"`{key}`").alias("k"), F.col(f"`{leaf}`").alias("leaf"), packed_row(rows.select(*[F.col(f"`{c}`") for c in kept])).alias("row")), "leaves")
    placed = numbered(plain, "g", "k", "leaf", name="leaves-in-order")
    dropped(plain)
    first = written(placed.groupBy("g").agg(F.min("at").alias("first")), "groups")
    known = written(numbered(first, "g", name="groups-in-order").select("g", "first", F.col("at").alias("grp")), "groups-by-number")
    of = sent_if_small(known, "g")
    met = placed.join(of, placed["g"].eqNullSafe(of["g"])).select("grp", (F.col("at") - F.col("first")).alias("pos"), "leaf", "row")
    trees = written(_forest(met, arity, top_nodes, least_height), "trees")
    tops = trees.groupBy("grp").agg(F.first("top").alias("leaf"))
    upper = written(_forest(tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), "leaf", F.struct("grp").alias("row")), arity, top_nodes, least_height), "tree-of-groups")
    upper = upper.select(F.col("row.grp").alias("grp"), F.col("top").alias("root"), F.col("proof").alias("more"))
    told = trees.join(sent_if_small(upper, "more"), "grp")
    return told.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("top").alias("subroot"), "root", F.concat("proof", "more").alias("proof"))

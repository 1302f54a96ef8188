"""The Merkle manifest against a plain tree, and on hard inputs."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loreweave.llm import merkle


def h(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain(groups: dict, arity: int):
    """(group, leaf): (subroot, root, proof), for leaves that are all different."""
    def tree(nodes):
        proofs, place = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, at in enumerate(place):
                run = nodes[at - at % arity : at - at % arity + arity]
                proofs[i].append((at % arity, run[: at % arity] + run[at % arity + 1 :]))
            nodes, place = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)], [at // arity for at in place]
        return nodes[0], proofs

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: tree(groups[g]) for g in names}
    root, upper = tree([tops[g][0] for g in names])
    return {(g, x): (tops[g][0], root, tops[g][1][i] + upper[names.index(g)]) for g in names for i, x in enumerate(groups[g])}


@pytest.mark.parametrize(("arity", "top_nodes"), [(3, merkle.TOP_NODES), (3, 4), (2, 8)])
def test_against_a_plain_tree(spark, arity, top_nodes):
    rng = random.Random(arity)
    sizes = {"hot": 400, None: 5, "": 1, "é": 27, "Z": 28, "a": 81, "b": 2, "c": 3}
    rows, groups = [], {}
    for g, n in sizes.items():
        ids = sorted(rng.sample(range(-5000, 5000), n))
        groups[g] = [leaf(i, g) for i in ids]
        rows += [(i, g, leaf(i, g), "t", "p", 1, 2) for i in ids]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string, top string, proof string, pos int, grp int").repartition(5)
    got = merkle.merkle_manifest(df, arity=arity, top_nodes=top_nodes, least_height=2)
    assert got.columns == ["doc_id", "source", "leaf", "top", "pos", "grp", "subroot", "root", "proof"]
    got = got.withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("other", merkle.folded(F.lit("0"), F.col("proof"))).withColumn("told", merkle.proof_digest(F.col("proof"))).collect()
    want = plain(groups, arity)
    assert len(got) == len(rows)
    for r in got:
        subroot, root, proof = want[r.source, r.leaf]
        assert (r.subroot, r.root, [(p.place, p.siblings) for p in r.proof]) == (subroot, root, proof)
        assert r.again == root != r.other and r.told == h(*[s for _, x in proof for s in x])


def test_leaves(spark):
    values = [(1, None, "é\n", ""), (None, 5, None, "x")]
    df = spark.createDataFrame(values, "a long, b int, c string, d string")
    assert [r[0] for r in df.select(merkle.leaf_digest(*map(F.col, "abcd"))).collect()] == [leaf(*v) for v in values]


def test_repeats_nulls_and_nothing(spark):
    one, two = leaf(1), leaf(2)
    df = spark.createDataFrame([(1, "s", one), (1, "s", one), (1, "s", two), (None, "s", one)], "doc_id long, source string, leaf string")
    got = merkle.merkle_manifest(df).collect()
    first = h(one, *sorted([one, one, two])[:2])
    assert len(got) == 4 and {r.root for r in got} == {h(first, h(sorted([one, one, two])[2]))}
    assert merkle.merkle_manifest(df.limit(0)).count() == 0
    alone = merkle.merkle_manifest(df.limit(1)).collect()[0]
    assert alone.subroot == alone.root == alone.leaf and alone.proof == []

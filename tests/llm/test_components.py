"""Connected components against union-find, with chains, a star and links of a node to itself."""

from __future__ import annotations

import random

import pytest

from loreweave.llm.components import connected_components


@pytest.mark.parametrize("nodes,links", [(1, 0), (300, 220), (400, 380)])
def test_components_are_those_of_union_find(spark, nodes, links):
    rng = random.Random(5)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)]
    if nodes == 400:
        edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + edges[:20]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    got = [(r.node, r.root) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert set(got) == want and len(got) == len(want)

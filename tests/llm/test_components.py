import random

import numpy as np
import pytest

from housemark.llm.components import connected_components, unite


def wanted(edges):
    root = {}

    def top(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return {v: top(v) for e in edges for v in e if e[0] != e[1]}


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(3, 3)],
        [(1, 2), (2, 1), (1, 2)],
        [(i, i + 1) for i in range(60)],
        [(-5, i) for i in range(40)],
        [(random.Random(i).randrange(80), random.Random(i + 99).randrange(80)) for i in range(60)],
    ],
)
def test_equals_union_find(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in connected_components(frame).collect()}
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in found.items() if k not in loops} == {
        k: v for k, v in wanted(edges).items() if k not in loops
    }


def test_unite_chains():
    a = np.arange(99)
    assert unite(np.arange(100), a, a + 1).tolist() == [0] * 100

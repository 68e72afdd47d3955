import math

import numpy as np
import pytest

from housemark.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, least):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.linalg.norm(v) if v.any() else None

    units = [unit(v) for _, v, _ in rows]
    n = len(rows)
    near = [
        [
            i != j
            and rows[i][2] is not None
            and rows[i][2] == rows[j][2]
            and units[i] is not None
            and units[j] is not None
            and len(units[i]) == len(units[j])
            and units[i] @ units[j] >= least
            for j in range(n)
        ]
        for i in range(n)
    ]
    found = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least_id = min(ids) if ids else None
        found.append((rows[i][0], sum(near[i]), least_id, rows[i][0] == least_id))
    return found


def rows_of(frame):
    return [(r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect()]


def ordered(rows):
    return sorted(rows, key=str)


def clusters(rng, n, size=16):
    rows = []
    for i in range(n):
        centre = rng.normal(size=size)
        for _ in range(rng.integers(1, 6)):
            v = centre + rng.normal(size=size) * rng.choice([0.0, 0.03, 0.06, 0.2])
            rows.append((len(rows), [float(x) for x in v * rng.uniform(0.5, 9)], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("pivots", [1, 5, 40, None])
@pytest.mark.parametrize("block", [6, 2048])
def test_equals_brute_force(spark, pivots, block):
    rows = clusters(np.random.default_rng(pivots or 7), 60)
    frame = spark.createDataFrame(rows, SCHEMA)
    found = embeddings.near_duplicates(frame, pivots=pivots, block=block)
    assert ordered(rows_of(found)) == ordered(slow(rows, 0.98))


def test_odd_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0]
    rows = [
        (1, a, 1), (2, a, 1), (2, a, 1), (3, [2.0, 0.0, 0.0], 1), (4, a, 2), (5, a, None),
        (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 0.0], 1),
        (10, [math.nan, 0.0, 0.0], 1), (11, [math.inf, 0.0, 0.0], 1), (12, b, 1), (13, b, 1),
        (None, a, 1), (None, b, 3), (14, [-0.0, 1.0], 1), (15, [1e-30, 0.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS kept")
    assert ordered(rows_of(embeddings.near_duplicates(frame))) == ordered(slow(rows, 0.98))


def test_hot_group_is_not_paired(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, *map(float, rng.normal(size=3) * 0.01)], 1) for i in range(400)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=50).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(399, 0)}


def tight(rng, n, size=32):
    """Vectors in clusters of about twenty that are far from each other."""
    centres = np.repeat(rng.normal(size=(n // 20, size)), 20, axis=0)
    return embeddings._unit(centres + 0.02 * rng.normal(size=centres.shape))


def cheapest(unit, weight=1.0):
    angle = math.acos(0.98)
    order = embeddings._apart(unit, embeddings.NUMBERS[-1])
    labels = np.zeros(len(unit), np.int64)
    costs = {
        n: embeddings._cost(unit, labels, unit[order[:n]], angle, embeddings.BLOCK, weight)
        for n in embeddings.NUMBERS
        if n <= len(order)
    }
    return min((rows * embeddings.ROW_COST + pairs, n, rows, pairs) for n, (rows, pairs) in costs.items())


def test_clustered_vectors_get_more_pivots_as_they_grow():
    """Rows sent stay below three for each vector; pairs grow far below the square."""
    rng = np.random.default_rng(3)
    found = {n: cheapest(tight(rng, n)) for n in (2_000, 20_000)}
    assert found[20_000][1] >= 256 > 1
    for n, (_, _, rows, pairs) in found.items():
        assert rows < 3 * n
    assert found[20_000][3] < 0.05 * 20_000**2
    assert found[20_000][3] / found[2_000][3] < 30


def test_vectors_that_no_pivot_parts_are_sent_once_for_each_block():
    rng = np.random.default_rng(4)
    unit = embeddings._unit(rng.normal(size=(3000, 64)))
    _, number, rows, pairs = cheapest(unit)
    assert number == 1 and rows == 2 * 3000 and pairs == 3000**2


def test_no_link_is_lost_whatever_the_pivots(spark):
    rng = np.random.default_rng(9)
    unit = tight(rng, 1200, 8)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(unit.astype(np.float32))]
    frame = spark.createDataFrame(rows, SCHEMA)
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = (v @ v.T >= 0.98).sum(axis=1) - 1
    for number in (None, 1, 64, 256):
        found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(frame, pivots=number).collect()}
        assert found == dict(enumerate(links.tolist()))


def test_a_sample_without_some_length(spark):
    rows = [(i, [1.0, i / 10], 1) for i in range(8)] + [(10 + i, [1.0, 0.0, i / 50], 1) for i in range(8)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), sample=1)
    assert ordered(rows_of(found)) == ordered(slow(rows, 0.98))


def test_no_rows(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_cosines_above_zero(spark):
    with pytest.raises(ValueError):
        embeddings.near_duplicates(spark.createDataFrame([], SCHEMA), least_cosine=0.0)

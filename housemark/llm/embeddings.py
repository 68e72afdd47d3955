"""Embedding near-dedup: an exact metric range join.

Vectors of one label are compared by the angle between them, which is a metric. Pivots
(vectors of the data) partition each label: a vector's home is its nearest pivot. By the
triangle inequality a vector within the angle t of another is no farther from that one's
home than from its own nearest pivot plus 2 t, so it is replicated to each such cell, unless
the plane halfway between that pivot and some other is farther than the chord of t: no
vector so near has its home beyond that plane. A vector also needs to be within t of the
widest home vector of the cell. A home vector then meets all its neighbours in its own cell,
and cells are compared independently.

How many pivots pay depends on the data: clusters fall apart under many, and vectors that are
all equally far from each other only go to more cells. Pivots far from each other are taken
from a bounded sample, on which the rows sent and the pairs compared are counted for several
numbers of them; the cheapest number for the size of the table is used.

Equal vectors are folded before; large cells are dealt out in blocks. A cell passes on, for
each vector, the number of its links and one tree edge at most, never its pairs.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from housemark.llm.blocks import meet_in_blocks
from housemark.llm.components import connected_components, unite
from housemark.sources.scratch import stage

LEAST_COSINE = 0.98
BLOCK = 2048
#: Vectors that pivots are taken from, and numbers of pivots that are tried on them.
SAMPLE = 4096
NUMBERS = (1, 4, 16, 64, 256, 1024)
#: Comparisons that cost as much as to send one row to a cell.
ROW_COST = 500

# Nearest pivots whose halfway planes are looked at, and values of a matrix in a task.
_PLANES = 16
_VALUES = 1 << 21

# Angles are computed with rounding errors far below this.
_SLACK = 1e-7


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    least_cosine: float = LEAST_COSINE,
    pivots: int | None = None,
    block: int = BLOCK,
    sample: int = SAMPLE,
) -> DataFrame:
    """A row for each vector: its id, ``n_links``, ``component_id`` and ``kept``.

    Rows link if their labels are equal and not null and the cosine of their vectors, in
    double precision, is at least ``least_cosine`` (above 0). A vector that is null, empty
    or zero, or that holds a null or non-finite component, links with nothing, nor do
    vectors of different lengths. Equal rows link with each other. ``component_id`` is the
    smallest id reachable, null ids passed over; ``kept`` is whether it is the row's own. Other
    columns are not read, and an empty table gives an empty one.
    ``pivots`` is the number of pivots for vectors of one length, chosen for the data unless
    given. They are all that is sent to every task, and the ``sample`` that they are taken from
    all that is sent to the driver. The result does not depend on them.
    """
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"),
        F.col(embedding).cast("array<double>").alias("vector"),
        F.col(label).alias("label"),
    )
    usable = F.col("label").isNotNull() & F.coalesce(_is_usable("vector"), F.lit(False))
    folded = stage(
        rows.where(usable)
        .groupBy("label", "vector")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    if not 0 < least_cosine <= 1:
        raise ValueError(f"not a cosine above 0: {least_cosine}")
    angle = math.acos(least_cosine) + _SLACK
    chosen = _chosen(folded, angle, pivots, block, sample)
    found = stage(_linked(folded, least_cosine, angle, chosen, block), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    known = stage(
        folded.join(links, "node", "left")
        .join(connected_components(edges), "node", "left")
        .select(
            "label",
            "vector",
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        ),
        "known",
    )
    classes = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(classes, "root").select("label", "vector", "n_links", "component_id")
    linked = rows.where(usable).join(known, ["label", "vector"])
    alone = rows.where(~usable).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return (
        linked.select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def _is_usable(vector: str) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < math.inf))
    return finite & F.exists(vector, lambda x: x != 0)


def _chosen(
    folded: DataFrame, angle: float, number: int | None, block: int, sample: int
) -> dict[int, np.ndarray]:
    """Pivots by length of vectors, from the vectors of smallest hash."""
    some = folded.orderBy(F.xxhash64("vector"), "vector").limit(sample)
    rows = some.select("vector", F.col("label").cast("string").alias("label")).collect()
    weight = folded.count() / max(len(rows), 1)
    chosen = {}
    for size in sorted({len(r.vector) for r in rows}):
        own = [r for r in rows if len(r.vector) == size]
        unit = _unit(np.array([r.vector for r in own]))
        labels = np.unique([r.label for r in own], return_inverse=True)[1]
        order = _apart(unit, number or NUMBERS[-1])
        numbers = [number] if number else [n for n in NUMBERS if n <= len(order)]
        costs = [_cost(unit, labels, unit[order[:n]], angle, block, weight) for n in numbers]
        best = min(range(len(numbers)), key=lambda i: costs[i][0] * ROW_COST + costs[i][1])
        chosen[size] = unit[order[: numbers[best]]]
    return chosen


def _apart(unit: np.ndarray, most: int) -> np.ndarray:
    """Places of vectors, each the farthest one from those before it."""
    found = [0]
    nearest = unit @ unit[0]
    while len(found) < min(most, len(unit)):
        found.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[found[-1]])
    return np.array(found)


def _cost(
    unit: np.ndarray, labels: np.ndarray, pivots: np.ndarray, angle: float, block: int, weight: float
) -> tuple[float, float]:
    """Rows sent to blocks of cells and pairs compared, if each vector stands for ``weight``."""
    cells = (int(labels.max()) + 1) * len(pivots)
    homes, all_rows = np.zeros(cells), np.zeros(cells)
    for part, _, home, near in _near_cells(unit, pivots, angle):
        first = labels[part] * len(pivots)
        homes += np.bincount(first + home, minlength=cells)
        owner, cell = np.nonzero(near)
        all_rows += np.bincount(first[owner] + cell, minlength=cells)
    homes, all_rows = homes * weight, all_rows * weight
    return float((all_rows * np.ceil(all_rows / block)).sum()), float((homes * all_rows).sum())


def _near_cells(
    unit: np.ndarray, pivots: np.ndarray, angle: float
) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For a part of the vectors: their angles to all pivots, their homes, and the cells they go to."""
    gaps = 2 * np.sin(np.arccos(np.clip(pivots @ pivots.T, -1, 1)) / 2)
    chord = 2 * math.sin(angle / 2)
    step = max(1, _VALUES // len(pivots))
    for at in range(0, len(unit), step):
        cosines = np.clip(unit[at : at + step] @ pivots.T, -1, 1)
        each = np.arange(len(cosines))
        away = np.arccos(cosines)
        home = away.argmin(axis=1)
        near = away <= away.min(axis=1, keepdims=True) + 2 * angle
        planes = min(_PLANES, len(pivots))
        for other in np.argpartition(away, planes - 1, axis=1)[:, :planes].T:
            # Beyond the halfway plane by more than the chord: no link with what is at home there.
            near &= cosines[each, other][:, None] - cosines <= chord * gaps[other] + _SLACK
        near[each, home] = True
        yield slice(at, at + len(cosines)), away, home, near


def _linked(
    folded: DataFrame, least_cosine: float, angle: float, chosen: dict[int, np.ndarray], block: int
) -> DataFrame:
    """Rows (node, links, root) of each cell; ``links`` are those of a home vector there."""
    to_pivots = folded.mapInArrow(
        lambda batches: _to_pivots(batches, chosen, angle),
        f"label {folded.schema['label'].dataType.simpleString()}, size int, pivot int, "
        "away double, home boolean, node long, copies long, vector array<double>",
    )
    cells = stage(to_pivots, "cells")
    cell = ["label", "size", "pivot"]
    widest = cells.where("home").groupBy(*cell).agg(F.max("away").alias("widest"))
    near = cells.join(widest, cell).where(F.col("away") <= F.col("widest") + angle)
    met = meet_in_blocks(near, cell, F.xxhash64("node"), block)

    def compare(group: pa.Table) -> pa.Table:
        return _compare(group, least_cosine)

    grouped = met.groupBy(*cell, "low", "high")
    return grouped.applyInArrow(compare, "node long, links long, root long")


def _to_pivots(
    batches: Iterator[pa.RecordBatch], chosen: dict[int, np.ndarray], angle: float
) -> Iterator[pa.RecordBatch]:
    """Each vector with the pivots whose cells it belongs to.

    Vectors of a length without pivots are all at home in a cell numbered 0.
    """
    for batch in batches:
        sizes = pc.list_value_length(batch.column("vector")).to_numpy()
        for size in np.unique(sizes):
            rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
            unit = _unit(_matrix(rows.column("vector")))
            pivots = chosen.get(int(size), unit[:0])
            if not len(pivots):
                whole, zero = slice(0, len(unit)), np.zeros(len(unit), np.int64)
                parts = [(whole, np.zeros((len(unit), 1)), zero, np.ones((len(unit), 1), bool))]
            else:
                parts = _near_cells(unit, pivots, angle)
            for part, away, home, near in parts:
                owner, cell = np.nonzero(near)
                taken = pa.array(owner + part.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("label").take(taken),
                        pa.array(np.full(len(owner), size, np.int32)),
                        pa.array(cell.astype(np.int32)),
                        pa.array(away[owner, cell]),
                        pa.array(home[owner] == cell),
                        rows.column("node").take(taken),
                        rows.column("copies").take(taken),
                        rows.column("vector").take(taken),
                    ],
                    ["label", "size", "pivot", "away", "home", "node", "copies", "vector"],
                )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _compare(group: pa.Table, least_cosine: float) -> pa.Table:
    group = group.combine_chunks()
    node, copies, home, block, low, high = (
        group.column(n).to_numpy() for n in ("node", "copies", "home", "block", "low", "high")
    )
    unit = _unit(_matrix(group.column("vector").combine_chunks()))
    across = low[0] != high[0]
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    for side in (low[0], high[0]) if across else (low[0],):
        at = np.flatnonzero(home & (block == side))
        others = np.flatnonzero(block != side) if across else np.arange(len(node))
        if not len(at) or not len(others):
            continue
        close = unit[at] @ unit[others].T >= least_cosine
        close &= at[:, None] != others[None, :]
        links[at] += close @ copies[others]
        first, second = np.nonzero(close)
        root = unite(root, at[first], others[second])
    kept = (links > 0) | (root != np.arange(len(node)))
    return pa.table({"node": node[kept], "links": links[kept], "root": node[root[kept]]})

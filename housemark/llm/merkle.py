"""Merkle manifest of a table, with a proof for every row by pointer jumping.

The rows of a part, ascending by id, are the leaves of a binary tree; the roots of the parts,
ascending by part, are the leaves of a tree above them. The trees are built ten levels at a
time: aligned blocks of 1024 nodes are hashed together, and one node of each goes on.

Nodes hold the siblings on the way towards an ancestor, at first their own one. A self-join
with the nodes at that ancestor appends what these hold, which doubles the distance, until
the leaves reach the root. Only nodes at multiples of the distance are met again, so the
nodes that are joined with the leaves thin out as fast as their segments grow.

Levels are counted alike in all parts: the root of a lower tree stands on every level up to
the height of the highest one, where the tree of the parts begins. On these levels it has no
sibling and is not hashed.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from housemark.operators.ordered import Running, running
from housemark.sources.scratch import stage

#: Levels that are built together, of blocks of two to this power.
BLOCK_LEVELS = 10
#: Part number of the nodes above all parts.
ABOVE = -1


def _no_bytes() -> Column:
    return F.lit(b"")


def _hash(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def _as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its length in bytes and its text, a null one as ``-``."""
    texts = [value.cast("string") for value in values]
    return _hash(
        *(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts)
    )


def _levels_of(count: Column) -> Column:
    """Levels between so many nodes and their root: the bits of the last node's number."""
    return F.when(count > 1, F.length(F.bin(count - 1))).otherwise(0).cast("int")


def _blocks(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Blocks of ``nodes`` (part, index, digest, count of the part) with their levels.

    ``levels`` has the digests of the block's nodes from its leaves to its root, ``rows`` the
    ``carried`` columns of its nodes. Of parts with more than one block a block's root is as
    many levels up as any other's, however few nodes the last one has.
    """
    digests = F.transform("nodes", lambda node: _as_text(node["digest"]))

    def above(below: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1)),
            lambda i: _hash(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit(""))),
        )

    several = F.col("count") > (1 << BLOCK_LEVELS)
    steps = F.when(several, BLOCK_LEVELS).otherwise(_levels_of(F.col("count")))
    climbed = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.array().cast("array<array<string>>"),
        lambda found, step: F.array_append(
            found, F.when(step == 0, digests).otherwise(above(F.get(found, step - 1)))
        ),
    )
    row = F.struct("index", "digest", *carried)
    return (
        nodes.groupBy("part", F.shiftright("index", BLOCK_LEVELS).alias("block"), "count")
        .agg(F.sort_array(F.collect_list(row)).alias("nodes"))
        .select(
            "part",
            "block",
            "count",
            F.transform("nodes", lambda node: node.dropFields("digest")).alias("rows"),
            F.transform(climbed, lambda level: F.transform(level, lambda x: F.unhex(x))).alias("levels"),
        )
    )


def _sibling(level: Column, place: Column) -> Column:
    return F.coalesce(F.get(level, place.bitwiseXOR(F.lit(1))), _no_bytes())


def _nodes(blocks: DataFrame, base: int, first: int) -> DataFrame:
    """Nodes of the blocks from level ``first`` of the block up to below its root."""
    inner = F.slice("levels", first + 1, F.greatest(F.size("levels") - 1 - first, F.lit(0)))
    found = blocks.select("part", "block", F.posexplode(inner).alias("up", "level_digests"))
    up = F.col("up") + first
    start = F.expr(f"shiftleft(block, {BLOCK_LEVELS - first} - up)")
    return found.select(
        "part",
        (up + base).cast("int").alias("level"),
        "level_digests",
        start.alias("start"),
        F.posexplode("level_digests").alias("place", "digest"),
    ).select(
        "part",
        "level",
        (F.col("start") + F.col("place")).alias("index"),
        _sibling(F.col("level_digests"), F.col("place")).alias("segment"),
    )


def _climb(nodes: DataFrame, base: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of all levels above ``nodes`` that have a parent, and the roots of their parts.

    ``nodes`` and the roots have the columns part, index, digest and count; ``most`` is the
    largest count.
    """
    found, roots = [], None
    while True:
        blocks = stage(_blocks(nodes), "blocks")
        found.append(_nodes(blocks, base, 0))
        tops = blocks.select(
            "part",
            F.col("block").alias("index"),
            F.element_at(F.element_at("levels", -1), 1).alias("digest"),
            (F.shiftright(F.col("count") - 1, BLOCK_LEVELS) + 1).alias("of_next"),
            "count",
        )
        done = tops.where(F.col("count") <= (1 << BLOCK_LEVELS)).select("part", "digest")
        roots = done if roots is None else roots.union(done)
        if most <= 1 << BLOCK_LEVELS:
            return found, roots
        nodes = tops.where(F.col("count") > (1 << BLOCK_LEVELS)).select(
            "part", "index", "digest", F.col("of_next").alias("count")
        )
        most = ((most - 1) >> BLOCK_LEVELS) + 1
        base += BLOCK_LEVELS


def _at(distance: int, level: Column, part: Column, index: Column, height: int) -> tuple[Column, Column]:
    """Part and index of the ancestor that is ``distance`` levels above a node."""
    above = level + distance
    crossing = (above >= height) & (level < height)
    number = F.when(crossing, part.cast("long")).otherwise(index)
    bits = F.when(crossing, above - height).otherwise(F.lit(distance)).cast("int")
    return F.when(above >= height, ABOVE).otherwise(part), F.call_function("shiftright", number, bits)


def _doubled(nodes: DataFrame, others: DataFrame, distance: int, height: int) -> DataFrame:
    """``nodes`` whose segments are continued by those of the ancestors among ``others``."""
    part, index = _at(distance, F.col("level"), F.col("part"), F.col("index"), height)
    keyed = nodes.withColumns(
        {"to_part": part, "to_index": index, "to_level": F.col("level") + distance}
    )
    met = others.select(
        F.col("part").alias("to_part"),
        F.col("index").alias("to_index"),
        F.col("level").alias("to_level"),
        F.col("segment").alias("more"),
    )
    whole = F.concat("segment", F.coalesce("more", _no_bytes()))
    return (
        keyed.join(met, ["to_part", "to_index", "to_level"], "left")
        .withColumn("segment", whole)
        .select(*nodes.columns)
    )


def _jumped(leaves: DataFrame, nodes: DataFrame, height: int, total: int) -> DataFrame:
    """``leaves`` with the siblings of all ``total`` levels as their ``segment``."""
    distance = 1
    while distance < total:
        leaves = _doubled(leaves, nodes.where(F.col("level") == distance), distance, height)
        if 2 * distance < total:
            kept = nodes.where(F.col("level") % (2 * distance) == 0)
            met = nodes.where(F.col("level") % (2 * distance) == distance)
            nodes = stage(_doubled(kept, met, distance, height), "jumped")
        distance *= 2
    return leaves


def folded(
    digest: Column, siblings: Column, part: Column, index: Column, count: Column, parts: int, height: int, total: int
) -> Column:
    """Root that a leaf and the siblings on its way, put behind each other, lead to."""

    def step(state: Column, level: Column) -> Column:
        inside = level < height
        up = F.when(inside, level).otherwise(level - height)
        place = F.call_function("shiftright", F.when(inside, index).otherwise(part.cast("long")), up)
        last = F.when(inside, count).otherwise(F.lit(parts).cast("long")) - 1
        last = F.call_function("shiftright", last, up)
        own, taken = state["digest"], state["taken"]
        sibling = _as_text(F.substring(siblings, taken + 1, F.lit(32)))
        right, left = place % 2 == 1, place < last
        up_one = (
            F.when(last == 0, own)
            .when(right, _hash(sibling, own))
            .when(left, _hash(own, sibling))
            .otherwise(_hash(own))
        )
        met = (last > 0) & (right | left)
        return F.struct(up_one.alias("digest"), (taken + F.when(met, 32).otherwise(0)).alias("taken"))

    start = F.struct(_as_text(digest).alias("digest"), F.lit(0).alias("taken"))
    levels = F.sequence(F.lit(0), F.lit(total - 1))
    return F.aggregate(levels, start, step, lambda state: state["digest"])


def manifest(
    docs: DataFrame,
    fields: Sequence[str],
    doc_id: str = "doc_id",
    part: str = "lang",
    tampered: Column | None = None,
    changes: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root``, ``verified`` by row.

    A leaf is the digest of ``fields``; digests are hexadecimal text but for ``proof``, the
    siblings on the way to the root as bytes behind each other, lowest first. ``folded_root``
    is what the proof makes of the leaf, or where ``tampered`` holds of the leaf with the
    fields of ``changes`` put in place; ``verified`` says whether that is the root.

    Null ids come first and null is the first part; rows of equal id are ordered by their leaf,
    and wholly equal rows are interchangeable. A null text differs from an empty one. Other
    columns are not read; an empty table gives an empty manifest. A part may hold any share of
    the rows: it is numbered by ranges and hashed by blocks, and no more than a block of 1024
    digests, or the rows of one ancestor that is too far up to be broadcast, is in a task.
    """
    named = {name: F.col(name) for name in fields}
    forged = leaf([*(named | dict(changes or {})).values()])
    tampered = F.lit(False) if tampered is None else tampered
    leaves = stage(
        docs.select(
            F.col(part).alias("name"),
            F.col(doc_id).alias("doc_id"),
            F.unhex(leaf([*named.values()])).alias("digest"),
            F.when(tampered, F.unhex(forged)).alias("forged"),
        ),
        "leaves",
    )
    counts = leaves.groupBy("name").agg(F.count("*").alias("count")).withColumn("all", F.lit(0))
    parts = stage(running(counts, ["all"], ["name"], Running(number="number")), "parts")
    parts = parts.select((F.col("number") - 1).cast("int").alias("part"), "name", "count")
    most, n_parts = parts.agg(F.max("count"), F.count("*")).first()
    height, total = _heights(most or 1, n_parts)
    placed = running(leaves, ["name"], ["doc_id", "digest"], Running(number="place"))
    placed = placed.join(parts, placed["name"].eqNullSafe(parts["name"])).select(
        "part", (F.col("place") - 1).alias("index"), "digest", "count", "doc_id", "forged"
    )
    blocks = stage(_blocks(placed, ["doc_id", "forged"]), "blocks")
    tops = blocks.select(
        "part",
        F.col("block").alias("index"),
        F.element_at(F.element_at("levels", -1), 1).alias("digest"),
        (F.shiftright(F.col("count") - 1, BLOCK_LEVELS) + 1).alias("count"),
    )
    inner, subroots = _climb(tops, BLOCK_LEVELS, ((most or 1) - 1 >> BLOCK_LEVELS) + 1)
    subroots = stage(subroots, "subroots")
    above = subroots.select(
        F.lit(ABOVE).alias("part"),
        F.col("part").cast("long").alias("index"),
        "digest",
        F.lit(n_parts).cast("long").alias("count"),
    )
    upper, roots = _climb(above, height, n_parts)
    root = roots.first()
    own_levels = _levels_of(F.col("count"))
    waiting = parts.where(own_levels < height).select(
        "part",
        F.explode(F.sequence(own_levels, F.lit(height - 1))).alias("level"),
        F.lit(0).cast("long").alias("index"),
        _no_bytes().alias("segment"),
    )
    nodes = _nodes(blocks, 0, 1)
    for more in (*inner, *upper, waiting):
        nodes = nodes.unionByName(more)
    nodes = stage(nodes, "nodes")
    first = blocks.select(
        "part", "count", F.element_at("levels", 1).alias("digests"), F.posexplode("rows").alias("place", "row")
    ).select(
        "part",
        "count",
        F.lit(0).alias("level"),
        F.col("row.index").alias("index"),
        F.col("row.doc_id").alias("doc_id"),
        F.get("digests", F.col("place")).alias("digest"),
        F.col("row.forged").alias("forged"),
        _sibling(F.col("digests"), F.col("place")).alias("segment"),
    )
    proved = _jumped(first, nodes, height, total).join(
        subroots.select("part", F.col("digest").alias("subroot")), "part"
    )
    root = F.lit(root["digest"].hex() if root else None).cast("string")
    reached = folded(
        F.coalesce("forged", "digest"),
        F.col("segment"),
        F.col("part"),
        F.col("index"),
        F.col("count"),
        n_parts,
        height,
        total,
    )
    return proved.select(
        "doc_id",
        _as_text(F.col("digest")).alias("leaf"),
        _as_text(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        F.col("segment").alias("proof"),
        reached.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _heights(most: int, n_parts: int) -> tuple[int, int]:
    """Levels below the roots of the parts, one at least, and below the root of all."""
    height = max((most - 1).bit_length(), 1)
    return height, height + max(n_parts - 1, 0).bit_length()

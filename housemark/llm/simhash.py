"""SimHash near-dedup by anchor-point covering.

Fingerprints with at most three differing bits of 64 differ in at most one bit of their
first or of their second 31 bits (the last two bits are left to the comparison). For each
of these halves the words of the perfect Hamming code of length 31 are the anchors: the
code covers every half within one bit, in exactly one way, its *home*. A half is replicated
to all anchors within covering radius plus threshold, 1 + 1 bits, which are 16 at most. Two
halves one bit apart then meet at the home of either, where all 64 bits are compared.
There are 2 x 2^26 anchors; each cell stands alone.

Equal fingerprints are folded before, and a cell of many fingerprints is compared in blocks.
A cell passes on a spanning forest of its links, never its pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from housemark.llm.blocks import meet_in_blocks
from housemark.llm.components import connected_components, unite
from housemark.sources.scratch import stage

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 3
BLOCK = 2048

_HALF = 31
_COVERED = 1
_CHUNK = 1 << 16
_LINKS_HELD = 1 << 19


def fingerprint(raw: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; 0 for one without words."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(shingle_words, len(words))
    starts, ends = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        pairs = zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(
    docs: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """``docs`` plus the column ``fingerprint`` (64 bits as a long).

    A null text counts as an empty one. An existing column of that name is replaced, repeated
    rows have equal fingerprints, an empty table gives an empty one. A text of any length is
    read whole; its task holds it and a part of its hashes at a time.
    """
    docs = docs.drop("fingerprint")
    names = docs.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(names.index(text)).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(x, shingle_words) for x in raw], np.uint64)
            values = pa.array(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(batch.columns + [values], names + ["fingerprint"])

    schema = T.StructType(docs.schema.fields + [T.StructField("fingerprint", T.LongType())])
    return docs.mapInArrow(add, schema)


def components(fingerprints: DataFrame, most_bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Columns ``node`` and ``root`` of each fingerprint that links with another.

    ``fingerprints`` has the long column ``fingerprint``; ``root`` is the smallest (as a
    signed long) that links of at most ``most_bits`` (up to three) bits reach.
    """
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"the anchors cover at most {MOST_BITS} differing bits, not {most_bits}")
    cells = fingerprints.select("fingerprint").distinct().mapInArrow(
        _to_anchors, "anchor long, fingerprint long, home boolean"
    )
    cells = stage(cells, "anchors")
    met = meet_in_blocks(cells, ["anchor"], F.xxhash64("fingerprint"), block)
    order = ["anchor", "low", "high", "fingerprint"]
    dealt = met.repartition("anchor", "low", "high").sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, most_bits)

    return connected_components(dealt.mapInArrow(compare, "a long, b long"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", most_bits: int = MOST_BITS
) -> DataFrame:
    """``docs``, which have a ``fingerprint``, plus ``component`` and ``component_id``.

    Linked rows have one ``component``, one of their fingerprints. ``component_id`` is the
    smallest id that links reach, the document's own included; null ids are passed over, and
    a component without another id has a null one. Rows are kept as they are, repeated ones
    too. Columns of these names are replaced. Reads ``docs`` twice: stage what is costly to
    compute.
    """
    docs = docs.drop("component", "component_id")
    least = stage(docs.groupBy("fingerprint").agg(F.min(doc_id).alias("least")), "fingerprints")
    roots = components(least, most_bits).withColumnRenamed("node", "fingerprint")
    rooted = stage(
        least.join(roots, "fingerprint", "left").withColumn(
            "root", F.coalesce("root", "fingerprint")
        ),
        "roots",
    )
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(classes, "root").select(
        "fingerprint", F.col("root").alias("component"), "component_id"
    )
    return docs.join(known, "fingerprint", "left")


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for half in (0, 1):
            yield _half_anchors(values, half)


def _half_anchors(values: np.ndarray, half: int) -> pa.RecordBatch:
    """Code words within two bits of each value's half; a half that is one has no other."""
    part = (values >> np.uint64(half * _HALF)) & np.uint64((1 << _HALF) - 1)
    wrong = np.zeros(len(values), np.int64)
    for place in range(1, _HALF + 1):
        is_one = ((part >> np.uint64(place - 1)) & np.uint64(1)).astype(np.int64)
        wrong ^= is_one * place
    bit = np.concatenate([[0], 1 << np.arange(_HALF)]).astype(np.uint64)
    anchors, owners, homes = [part ^ bit[wrong]], [values], [np.ones(len(values), bool)]
    for first in range(1, _HALF + 1):
        second = wrong ^ first
        chosen = (wrong != 0) & (first < second)
        anchors.append(part[chosen] ^ bit[first] ^ bit[second[chosen]])
        owners.append(values[chosen])
        homes.append(np.zeros(chosen.sum(), bool))
    keys = np.concatenate(anchors) | np.uint64(half << _HALF)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys.view(np.int64)),
            pa.array(np.concatenate(owners).view(np.int64)),
            pa.array(np.concatenate(homes)),
        ],
        ["anchor", "fingerprint", "home"],
    )


def _compare(batches: Iterator[pa.RecordBatch], most_bits: int) -> Iterator[pa.RecordBatch]:
    """Forest of the links in each run of equal (anchor, low, high) of sorted batches."""
    names = ["anchor", "low", "high", "block", "home", "fingerprint"]
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        starts = _run_starts(rows)
        cut = starts[-1]
        if cut:
            yield _forest([x[:cut] for x in rows], starts[:-1], most_bits)
        held = [x[cut:] for x in rows]
    if held is not None:
        yield _forest(held, np.array([0]), most_bits)


def _run_starts(rows: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(rows[0]), bool)
    new[:1] = True
    for x in rows[:3]:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _forest(rows: list[np.ndarray], starts: np.ndarray, most_bits: int) -> pa.RecordBatch:
    _, low, high, block, home, fingerprint = rows
    bits = fingerprint.view(np.uint64)
    ends = np.append(starts[1:], len(bits))
    end = np.repeat(ends, ends - starts)
    across = low != high
    root, left, step, links, held = np.arange(len(bits)), np.arange(len(bits)), 0, [], 0
    while True:
        step += 1
        left = left[left + step < end[left]]
        right = left + step
        close = np.bitwise_count(bits[left] ^ bits[right]) <= most_bits
        close &= home[left] | home[right]
        close &= ~across[left] | (block[left] != block[right])
        links.append((left[close], right[close]))
        held += len(links[-1][0])
        if not len(left) or held > _LINKS_HELD:
            root = unite(root, *(np.concatenate(x) for x in zip(*links)))
            links, held = [], 0
        if not len(left):
            break
    moved = root != np.arange(len(bits))
    found = [fingerprint[moved], fingerprint[root[moved]]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

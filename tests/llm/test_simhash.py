import random
import re

import numpy as np
import pytest
import xxhash

from housemark.llm import simhash


def slow_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(values, most):
    """Smallest member, as a signed long, of each value's component."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= most:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {v: top(v) for v in values}


def signed(x):
    return int(np.uint64(x).astype(np.int64))


@pytest.mark.parametrize(
    "text",
    ["", None, " \t\n", "a", "A b", "a B c", "É ÀB c d É ÀB c", "w " * 500, "x\x0by\x0cz q r s t"],
)
def test_fingerprint_is_that_of_the_definition(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=3000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 100)
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text.decode())


def planted(rng, groups, flips):
    values = set()
    for _ in range(groups):
        centre = rng.getrandbits(64)
        values.add(centre)
        for n in flips:
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), n)))
    return [signed(v) for v in values]


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_components_equal_brute_force(spark, most, block):
    rng = random.Random(most)
    values = planted(rng, 40, [1, 2, 3, 3, 4, 5]) + planted(rng, 1, [1, 2] * 40)
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = {r.node: r.root for r in simhash.components(frame, most, block).collect()}
    wanted = slow_roots(values, most)
    linked = {v for v in wanted.values() if list(wanted.values()).count(v) > 1}
    assert found == {v: r for v, r in wanted.items() if r in linked}


def test_every_half_has_one_home_and_meets_its_neighbours():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 200, np.uint64)
    for half in (0, 1):
        cells = {}
        for batch in [simhash._half_anchors(values, half)]:
            for anchor, value, home in zip(*(c.to_pylist() for c in batch.columns)):
                cells.setdefault(value, {})[anchor] = home
        assert all(sum(c.values()) == 1 and len(c) in (1, 16) for c in cells.values())
        for bit in range(31 * half, 31 * half + 31):
            near = simhash._half_anchors(values[:5] ^ np.uint64(1 << bit), half)
            for anchor, value, home in zip(*(c.to_pylist() for c in near.columns)):
                if home:
                    original = signed(np.uint64(value % 2**64) ^ np.uint64(1 << bit))
                    assert anchor in cells[original]


def test_more_bits_than_the_anchors_cover(spark):
    with pytest.raises(ValueError):
        simhash.components(spark.createDataFrame([(1,)], "fingerprint long"), 4)


def test_odd_rows(odd):
    marked = simhash.with_fingerprints(odd)
    assert marked.columns[-1] == "fingerprint" and marked.first()["size"] == "own size"
    rows = simhash.near_duplicates(marked.drop("text")).collect()
    assert len(rows) == 11
    empty = [r for r in rows if r.fingerprint == 0]
    assert sorted(str(r.doc_id) for r in empty) == ["3", "4", "5", "None"]
    assert {r.component_id for r in empty} == {3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {r.component_id for r in rows if r.doc_id is None and r.fingerprint} == {None}


def test_no_rows(none):
    marked = simhash.with_fingerprints(none)
    assert simhash.near_duplicates(marked).collect() == []

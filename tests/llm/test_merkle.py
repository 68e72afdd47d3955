"""Manifest and proofs against trees built in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from housemark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    values = [doc_id, source, lang, n_chars, text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def climb(levels, i, own):
    proof = ""
    for level in levels[:-1]:
        sibling = level[i ^ 1] if i ^ 1 < len(level) else ""
        proof += sibling
        own = digest(sibling + own if i % 2 else own + sibling)
        i //= 2
    return own, proof


def slow(rows):
    """For each row: leaf, subroot, root, proof, folded root; ids that 3 divides are tampered with."""
    parts = {}
    for row in rows:
        parts.setdefault(row[2], []).append(row)
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(r)))
        trees[name] = tree([slow_leaf(r) for r in parts[name]])
    top = tree([trees[name][-1][0] for name in names])
    found = []
    for p, name in enumerate(names):
        for i, row in enumerate(parts[name]):
            tampered = row[0] is not None and row[0] % 3 == 0
            own, low = climb(trees[name], i, slow_leaf(row, int(tampered)))
            own, high = climb(top, p, own)
            root = top[-1][0]
            found.append((row[0], slow_leaf(row), trees[name][-1][0], root, low + high, own, own == root))
    return sorted(found, key=str)


def manifest(frame):
    return merkle.manifest(
        frame, FIELDS, tampered=F.col("doc_id") % 3 == 0, changes={"n_chars": F.col("n_chars") + 1}
    )


def assert_manifest(rows, frame):
    found = [(*r[:4], r.proof.hex(), *r[5:]) for r in manifest(frame).collect()]
    assert sorted(found, key=str) == slow(rows)


def random_rows(count, langs, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * count), count)
    return [
        (i, rng.choice(["", "x", "täxt 😀", None]) , rng.choice(langs), rng.choice(["s", None]), rng.choice([None, i]))
        for i in ids
    ]


@pytest.mark.parametrize(
    "count, langs",
    [(1, ["en"]), (2, [None]), (3, ["en", None]), (9, "abcdefghi"), (130, ["en"] * 20 + ["de", None, "fr"])],
)
def test_equals_plain_trees(spark, count, langs):
    rows = random_rows(count, list(langs), count)
    assert_manifest(rows, spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_trees_of_many_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rows = random_rows(77, ["en"] * 30 + ["de"] * 5 + ["é", "fr", "ſ", "z", None], levels)
    assert_manifest(rows, spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_more_than_one_block(spark):
    rows = [(i, f"text {i}", "en" if i % 50 else "de", None, i) for i in range(2500)]
    assert_manifest(rows, spark.createDataFrame(rows, SCHEMA).repartition(7))


def test_equal_ids_and_nulls(spark):
    rows = [(1, "a", "en", None, 1), (1, "a", "en", None, 1), (1, "b", "en", None, 1), (None, None, None, None, None)]
    rows += [(None, "x", "en", "s", 3), (None, "", "en", "s", None), (3, None, "en", None, None), (6, "t", "en", "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert_manifest(rows, frame)
    # What cannot be changed is verified.
    verified = {r.doc_id: r.verified for r in manifest(frame).where("doc_id > 1").collect()}
    assert verified == {3: True, 6: False}


def test_odd_rows(odd):
    own = odd.selectExpr("*", *(f"'x' AS {c}" for c in "part index count level segment digest leaf root name".split()))
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert_manifest(rows, own)


def test_no_rows(none):
    found = manifest(none)
    assert found.collect() == []
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]


def test_nothing_tampered_with(spark):
    rows = random_rows(40, ["en", "de"], 8)
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), FIELDS)
    assert found.where("verified").count() == 40


def test_largest_number(spark):
    assert spark.range(1).select(merkle.leaf([F.lit((1 << 63) - 1)]).alias("x")).first().x == digest(
        "19:9223372036854775807"
    )

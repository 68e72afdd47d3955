"""The audit against a brute-force run of every order over every document."""

import random
from itertools import permutations

import pytest

from housemark.llm import filter_audit

LETTERS = filter_audit.FILTERS
SCHEMA = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def failed(text, is_copy):
    words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", text) if w]
    tests = [
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        any(c in "#$%&*|" for c in text),
        is_copy,
    ]
    return {letter for letter, fails in zip(LETTERS, tests) if fails}


def slow(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, source in docs:
        text = text or ""
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails.append((i, source or "", failed(text, copy)))
    out = {}
    for part in {p for _, p, _ in fails}:
        mine = [(i, f) for i, p, f in fails if p == part]
        removed_by = dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(x in f for _, f in mine) - len(gone),
                    sum(f == {x} for _, f in mine),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
                removed_by[x] += len(gone)
        for order in permutations(LETTERS):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(removed_by[x])
    return out


def assert_audit(spark, docs, labels, frame=None):
    frame = frame if frame is not None else spark.createDataFrame(docs, SCHEMA)
    counted = filter_audit.cells(frame, spark.createDataFrame(labels, LABELS))
    rows = filter_audit.audit(counted).collect()
    names = [*filter_audit.COUNTS, "shapley"]
    found = {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in rows}
    wanted = slow(docs, labels)
    assert len(rows) == len(found) and found == wanted


def test_random_documents_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(120):
        count = rng.choice([0, 1, 100, 199, 200, 201, 300])
        chosen = rng.choices(words[: rng.choice([20, 150, 400])], k=count)
        text = rng.choice([" ", "\n", " \t"]).join(chosen)
        text += rng.choice(["", "", " #", "|", " ÄÖ", " " + "A" * (count // 3)])
        docs.append((i, text, rng.choice(["a", "b", "", None])))
        if rng.random() < 0.3 and i:
            docs.append((1000 - i, docs[rng.randrange(len(docs))][1], "a"))
        if rng.random() < 0.6:
            labels.append((i, rng.choice([0, 1, None]), rng.choice([0, 1])))
    assert_audit(spark, docs, labels)


def test_edges_of_the_conditions(spark):
    words = " ".join(f"w{i}" for i in range(200))
    texts = [
        words,
        words.rsplit(" ", 1)[0],
        " ".join(f"w{i % 100}" for i in range(200)),
        " ".join(f"w{i % 99}" for i in range(200)),
        "A" * 2 + "é" * 98,
        "A" * 3 + "é" * 98,
        "a A",
        "word WORD Word",
        "no-break space and   \x1c\x85 stay in words",
    ]
    assert_audit(spark, [(i, t, "s") for i, t in enumerate(texts)], [(0, 1, 1), (4, 1, 0)])


def test_copies_nulls_and_repeated_rows(spark):
    docs = [(5, "x", "a"), (3, "x", "b"), (3, "x", "b"), (9, "x", None), (None, "x", "a"), (None, None, None)]
    docs += [(2, None, "a"), (7, "", "a"), (7, "other #", "c")]
    labels = [(5, 1, 0), (5, 0, 1), (3, 1, None), (None, 1, 1), (7, 1, 1), (99, 1, 1)]
    assert_audit(spark, docs, labels)


def test_long_texts(spark):
    docs = [(1, "word " * 600_000, "a"), (2, "x" * 2_500_000, "a"), (3, " " * 2_000_000, "a")]
    assert_audit(spark, docs, [])


def test_clashing_columns(spark, odd):
    own = odd.selectExpr("*", *(f"'x' AS {c}" for c in ("failed", "digest", "part", "mask", "n", "first")))
    docs = [(r.doc_id, r.text, r.source) for r in odd.select("doc_id", "text", "source").collect()]
    assert_audit(spark, docs, [(1, 1, 0)], own)


def test_no_rows(spark, none):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(filter_audit.cells(none, labels)).collect() == []


def test_fewer_filters_and_empty_steps(spark):
    counted = spark.createDataFrame([("p", 0, 4, 1, 0)], "part string, mask int, n long, good long, toxic long")
    rows = filter_audit.audit(counted, "AB").collect()
    assert [(r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in rows] == [
        ("AB", 1, 4, 0, 0), ("AB", 2, 4, 0, 0), ("BA", 1, 4, 0, 0), ("BA", 2, 4, 0, 0)
    ]


@pytest.mark.parametrize("text, points", [("", 0), ("é😀", 2)])
def test_empty_and_wide_texts(text, points):
    assert len(text) == points
    assert filter_audit._failed(text.encode()) == 1

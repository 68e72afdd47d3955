import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from housemark.llm import mixing


def drawn(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


def slow(rows, weights=(3, 1, 2), share=1.5, most=2):
    """(id, source, size, target, copies) of rows (id, source, text) with different ids."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = share * sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / whole >= most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    found = []
    for s in order:
        own = sorted(
            (n, hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest(), str(i))
            for i, x, n in sized
            if x == s
        )
        own = own[::2] + own[1::2][::-1]
        step = target[s] / sizes[s] if sizes[s] else 0.0
        at = drawn(f"{mixing.SEED}:offset:{s or ''}")
        for place, (n, _, i) in enumerate(own):
            copies = int(at + (place + 1) * step) - int(at + place * step)
            found.append((i, s, n, pytest.approx(target[s]), copies))
    return found


def measured(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return mixing.measured(frame)


def plain(frame):
    return [(str(r.doc_id), r.source, r.size, r.target, r.copies) for r in frame.collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0], str(r[1]), r[2]))


def some_rows():
    sources = ["a", "b", None, "é", "z", "hot"]
    rows = [(i, sources[i % 6], "w " * (i * 7 % 23)) for i in range(120)]
    return rows + [(1000 + i, "hot", "w " * 5) for i in range(200)]


@pytest.mark.parametrize("rows_per_piece", [3, 50, 100_000])
def test_equals_brute_force_however_it_is_cut(spark, rows_per_piece):
    rows = some_rows()
    found = mixing.with_copies(measured(spark, rows), rows_per_piece=rows_per_piece)
    assert by_id(plain(found)) == by_id(slow(rows))


def test_words_come_near_the_targets_and_no_copy_is_above_two(spark):
    found = mixing.with_copies(measured(spark, some_rows())).collect()
    words, targets = Counter(), {}
    for r in found:
        words[r.source] += r.copies * r.size
        targets[r.source] = r.target
        assert 0 <= r.copies <= 2 and r.target <= 2 * r.source_size
    assert all(abs(words[s] - t) <= max(23, 0.05 * t) for s, t in targets.items())
    assert sum(targets.values()) == pytest.approx(1.5 * sum(r.size for r in found))


def test_reruns_agree_whatever_the_partitions(spark):
    docs = measured(spark, some_rows())
    one = plain(mixing.with_copies(docs))
    two = plain(mixing.with_copies(docs.repartition(7)))
    assert by_id(one) == by_id(two)


def test_odd_rows(odd):
    found = mixing.with_copies(mixing.measured(odd)).collect()
    assert len(found) == 11 and found[0]["kept"] == "own kept"
    assert all(r.copies == 0 for r in found if not r.source_size)
    assert {r.size for r in found if r.doc_id in (3, 4, 5)} == {0}
    words = len(re.findall(r"[^\x20\x09-\x0D]+", next(r.text for r in found if r.text and "token" in r.text)))
    assert {r.source_size for r in found if r.source is None} == {words}


HELPERS = "_tie _source _slice _slices _number _of _before _expected _offset _rows _upto _name _text_hash own0 own2".split()


def test_helper_names_in_the_input(odd):
    own = odd.selectExpr("*", *(f"'own {c}' AS {c}" for c in HELPERS))
    found = mixing.with_copies(mixing.measured(own))
    made = ["size", "text_hash", "source_size", "target", "copies"]
    kept = [c for c in odd.columns if c not in made]
    assert sorted(found.columns) == sorted({*kept, *HELPERS, *made})
    plain = mixing.with_copies(mixing.measured(odd))
    assert found.select(*HELPERS).distinct().collect() == [tuple(f"own {c}" for c in HELPERS)]
    known = "doc_id IS NOT NULL"
    rows = [sorted(map(str, x.select("doc_id", "copies", "target").where(known).collect())) for x in (found, plain)]
    assert rows[0] == rows[1]


def test_rows_without_an_id_are_numbered_by_many_tasks(spark):
    """Equal sizes and null ids: the largest piece is a small part of the table."""
    rows = spark.range(60_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "'a' AS source", "concat('w', id) AS text")
    found = mixing.with_copies(mixing.measured(rows), rows_per_piece=1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 60_000 and max(sizes) < 6_000
    assert found.agg(F.sum("copies")).first()[0] == 90_000


def test_no_rows(none):
    assert mixing.with_copies(mixing.measured(none)).collect() == []

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from housemark.llm import lm_scoring
from housemark.llm.tables import remainder


def ways(word, pieces):
    """All cuts of a word into pieces."""
    if not word:
        yield []
    for end in range(1, len(word) + 1):
        if word[:end] in pieces:
            for rest in ways(word[end:], pieces):
                yield [word[:end], *rest]


@pytest.fixture(scope="module")
def lattice():
    pieces = {x: i for i, x in enumerate([b"a", b"b", b"c", b"ab", b"bc", b"abc", b"aa", b"cab"])}
    scores = np.log(np.array([0.2, 0.1, 0.1, 0.2, 0.1, 0.05, 0.05, 0.2]))
    return pieces, scores, lm_scoring.Lattice(pieces, scores)


@pytest.mark.parametrize("word", [b"a", b"abc", b"aabcab", b"cabcabaab", b"bbbb"])
def test_forward_sums_all_cuts(lattice, word):
    pieces, scores, own = lattice
    cuts = list(ways(word, pieces))
    weights = [math.exp(sum(scores[pieces[p]] for p in cut)) for cut in cuts]
    assert own.log_probability(word) == pytest.approx(math.log(sum(weights)))
    found = [0.0] * len(pieces)
    own.expected(word, 2.0, found)
    wanted = [0.0] * len(pieces)
    for cut, weight in zip(cuts, weights):
        for p in cut:
            wanted[pieces[p]] += 2.0 * weight / sum(weights)
    assert found == pytest.approx(wanted)


def test_long_words_do_not_underflow(lattice):
    assert -1e6 < lattice[2].log_probability(b"abc" * 20_000) < -1000


def held_out(doc_id, divisor=7, rest=2):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor == rest


def check(rows, texts):
    """Base figures by plain counting; ``texts`` are (id, text)."""
    words = [(i, (t or "").encode().lower().split()) for i, t in texts]
    counts, ends = Counter(), 0
    for i, own in words:
        if not held_out(i):
            counts.update(own)
            ends += 1
    n, kinds = sum(counts.values()) + ends, len(counts) + (ends > 0)
    wanted = []
    for i, own in words:
        base = sum(math.log10((counts[w] + 1) / (n + kinds + 1)) for w in own)
        base += math.log10((ends + 1) / (n + kinds + 1))
        known = sum(counts[w] > 0 for w in own) + (ends > 0)
        wanted.append((str(i), held_out(i), len(own) + 1, known, n, round(base, 5)))
    found = [
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
        for r in rows
    ]
    assert sorted(found) == sorted(wanted)


def scored(docs):
    return lm_scoring.score(docs, remainder(F.col("doc_id"), 7) == 2)


def test_base_and_lattice_over_a_whole_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = scored(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    by_id = {r.doc_id: r.score for r in rows}
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    path = public_tokenizers.path(lm_scoring.RANKS)
    counts = Counter(w for i, own in texts.items() if not held_out(i) for w in own)
    words = spark.createDataFrame(list(counts.items()), "word binary, train long")
    ends = sum(not held_out(i) for i in texts)
    scores, end = lm_scoring.train_scores(words, ends, path)
    assert math.exp(end) + np.exp(scores).sum() == pytest.approx(1)
    own = lm_scoring.Lattice(lm_scoring.read_pieces(path), scores)
    for i, mine in list(texts.items())[:40]:
        wanted = (end + sum(own.log_probability(b" " + w) for w in mine)) / math.log(10)
        assert by_id[i] == pytest.approx(wanted, rel=1e-9)


def test_expectation_maximisation_helps_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    split = remainder(F.col("doc_id"), 7) == 2

    def total(rounds):
        rows = lm_scoring.score(docs, split, rounds=rounds).where("held_out").agg(F.sum("score"))
        return rows.first()[0]

    assert total(1) > total(0)


def test_odd_rows(odd):
    rows = scored(odd).collect()
    assert len(rows) == 11
    check(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_slices_of_any_size_agree(spark, odd, monkeypatch):
    wanted = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in scored(odd).collect())
    for module, name, value in ((lm_scoring, "SLICE_BYTES", 50), (lm_scoring, "_MOST_TOGETHER", 3)):
        monkeypatch.setattr(module, name, value)
    found = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in scored(odd).collect())
    assert found == wanted


def test_no_training_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm_scoring.score(docs, F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == 0
    assert math.isfinite(row.score)


def test_no_rows(none):
    assert scored(none).collect() == []


def test_words_of_a_million_characters(spark):
    """White space that is no separator, and letters, in training and in held-out texts."""
    texts = ["\xa0" * 1_000_000, "x" * 1_000_000, "a b c"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lm_scoring.score(docs, F.col("doc_id") > 2).sort("doc_id").collect()
    assert [r.n_tokens for r in rows] == [2, 2, 4, 2, 2, 4]
    assert [r.score for r in rows[:3]] == [r.score for r in rows[3:]]
    assert all(math.isfinite(r.score) and r.score < -1 for r in rows)

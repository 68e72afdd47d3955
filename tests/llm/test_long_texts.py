"""Texts of a million characters of one kind through each operator on texts."""

import pytest

from housemark.llm import mixing, quality_classifier, quality_rules, secrets, simhash, token_counts

N = 1_000_000
TEXTS = {
    "spaces": " " * N,
    "lines": "\n" * N,
    "no-break": "\xa0" * N,
    "one word": "x" * N,
    "hexadecimal": "0123456789abcdef" * (N // 16),
    "keywords": "token " * (N // 6),
    "words": "a b c d e f g h " * (N // 16),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, "en", "s") for i, text in enumerate(TEXTS.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2)


def words(text):
    return len(text.encode().split())


def test_fingerprints_and_token_counts(docs):
    rows = token_counts.with_token_counts(simhash.with_fingerprints(docs)).collect()
    assert [r.n_words for r in rows] == [words(x) for x in TEXTS.values()]
    assert [r.fingerprint for r in rows[:2]] == [0, 0] and all(r.fingerprint for r in rows[2:])
    assert all((r.n_tokens > 0) == (r.n_words > 0) for r in rows)


def test_quality(docs):
    counted = quality_rules.with_statistics(docs)
    rows = quality_rules.with_verdict(counted).collect()
    for row, text in zip(sorted(rows), TEXTS.values()):
        letters = len(b"".join(text.encode().split()).decode())
        assert (row.n_words, row.word_chars, row.n_dup_lines, row.kept) == (words(text), letters, 0, False)
    described = quality_classifier.with_statistics(docs).collect()
    assert all(len(r.statistics) == quality_classifier.N_STATISTICS for r in described)


def test_secrets(docs):
    rows = secrets.with_spans(docs).collect()
    spans = [[tuple(s) for s in r.secrets] for r in rows]
    assert spans[4] == [("hex", 0, N // 16 * 16)]
    assert not any(spans[i] for i in (0, 1, 2, 5, 6))


def test_mixing(docs):
    rows = mixing.with_copies(mixing.measured(docs)).collect()
    assert {r.doc_id: r.size for r in rows} == {i: words(x) for i, x in enumerate(TEXTS.values())}

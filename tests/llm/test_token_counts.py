import random

import public_tokenizers
import pytest

from housemark.llm import token_counts


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_vocabulary(public_tokenizers.path(token_counts.RANKS))


def slow(text, pieces, longest):
    n = at = 0
    while at < len(text):
        at += next(k for k in range(min(longest, len(text) - at), 0, -1) if text[at : at + k] in pieces)
        n += 1
    return n


def test_small_vocabularies_equal_longest_match():
    rng = random.Random(1)
    single = [bytes([b]) for b in range(256)]
    for _ in range(60):
        more = {bytes(rng.choices(b"abc", k=rng.randrange(2, 7))) for _ in range(rng.randrange(25))}
        automaton = token_counts.Automaton([*single, *more])
        for _ in range(60):
            text = bytes(rng.choices(b"abcd", k=rng.randrange(40)))
            assert automaton.count(text) == slow(text, more | set(single), 7)


def test_public_vocabulary_equals_longest_match(vocabulary):
    rng = random.Random(2)
    automaton, pieces = token_counts.Automaton(vocabulary), set(vocabulary)
    longest = max(map(len, vocabulary))
    parts = [x for x in vocabulary if len(x) < 8]
    for _ in range(3000):
        text = b"".join(rng.choices(parts, k=rng.randrange(9)))
        assert automaton.count(text) == slow(text, pieces, longest)


def test_the_cache_does_not_change_counts(vocabulary, monkeypatch):
    automaton = token_counts.Automaton(vocabulary)
    words = [f"word{i % 50}".encode() for i in range(300)] + [b"y" * 500]
    wanted = [automaton.count(b" " + w) for w in words]
    monkeypatch.setattr(token_counts, "_CACHED", 7)
    lengths = token_counts.Lengths(automaton)
    assert [lengths[w] for w in words] == wanted and len(lengths) <= 7


def test_vocabulary_without_all_bytes():
    with pytest.raises(ValueError):
        token_counts.Automaton([b"a", b"b"])


def test_odd_rows(odd, vocabulary):
    found = token_counts.with_token_counts(odd).collect()
    pieces, longest = set(vocabulary), max(map(len, vocabulary))
    assert len(found) == 11 and found[0]["kept"] == "own kept"
    for r in found:
        words = (r.text or "").encode().split()
        assert (r.n_words, r.n_tokens) == (
            len(words),
            sum({w: slow(b" " + w, pieces, longest) for w in set(words)}[w] for w in words)
            if len(words) < 1000
            else r.n_tokens,
        )


def test_no_rows(none):
    assert token_counts.with_token_counts(none).collect() == []

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from housemark.llm import packing

TEXTS = [
    "", " ", "a", "hello  world\n\n\tit's I'LL", "<|endoftext|>", "a <|endoftext|>b<|endoftext|>",
    "x" * 4000, "é😀  ﬁ" * 50, "0123 456789 _-+=", "\x00\x01\x7f﻿",
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def same_ids(reference, texts):
    own = packing.tokenizer(public_tokenizers.path(packing.RANKS))
    for text in texts:
        wanted = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == wanted, text[:80]


def test_ids_are_those_of_the_other_library(spark, reference):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    same_ids(reference, TEXTS + [r.text for r in rows])


def test_ids_of_every_code_point(reference):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    parts = [points[i : i + 512] for i in range(0, len(points), 512)]
    same_ids(reference, ["".join(f"a{c}1 {c}b{c}  \n" for c in part) for part in parts])


WHITE = [chr(c) for c in range(0x110000) if chr(c).isspace() and not 0x1C <= c <= 0x1F]


@pytest.mark.parametrize("character", " \n\xa0", ids=lambda c: f"{ord(c):x}")
def test_a_million_white_characters(reference, character):
    same_ids(reference, [character * 1_000_000 + "x"])


def test_runs_of_every_white_character(reference):
    same_ids(reference, [x for c in WHITE for x in ("a" + c * 3000 + "x", c * 3000)])


def test_long_runs_among_other_text(reference):
    runs = ["".join(rng.choices(WHITE, k=rng.choice([1, 2, 999, 1000, 1001, 1500]))) for rng in [random.Random(7)] for _ in range(12)]
    ends = ["x", " x", "'s", "1", "-", "<|endoftext|>", "<|endoftext", "é", ""]
    same_ids(reference, ["a" + run + end + other for run in runs for end in ends for other in ("", runs[3] + "b")])


@pytest.mark.parametrize("letters", ["=", "日本", "abcdefghijklmnopqrstuvwxyz"])
def test_a_million_characters_without_space(reference, letters):
    rng = random.Random(letters)
    same_ids(reference, ["".join(rng.choices(letters, k=1_000_000))])


def test_long_white_space_in_a_table(spark, reference):
    texts = {1: " " * 1_000_000, 2: "\n" * 1_000_000 + "x", 3: "a b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(docs, with_ids=False).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] - 1 for r in rows} == {i: len(reference.encode(x).ids) for i, x in texts.items()}


def check_assigned(lengths, length):
    rows = packing.assign(np.array(lengths, np.int64), length)
    assert (rows[:, 2] > 0).all()
    documents, sequences = defaultdict(list), defaultdict(list)
    for document, start, size, sequence, offset in rows.tolist():
        documents[document].append((start, size))
        sequences[sequence].append((offset, size))
    for places in [*documents.values(), *sequences.values()]:
        at = 0
        for start, size in sorted(places):
            assert start == at
            at += size
    assert {d: sum(n for _, n in x) for d, x in documents.items()} == {
        d: n for d, n in enumerate(lengths) if n
    }
    filled = [sum(n for _, n in x) for x in sequences.values()]
    assert max(filled, default=0) <= length
    assert len(filled) == -(-sum(lengths) // length)
    return rows


@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 16))
def test_all_tokens_are_placed_once_without_gaps(lengths, length):
    check_assigned(lengths, length)


def test_descending_documents_go_to_the_lowest_cost():
    rows = check_assigned([6, 5, 4, 3, 2], 10)
    assert rows.tolist() == [[0, 0, 6, 0, 0], [1, 0, 5, 1, 0], [2, 0, 4, 1, 5], [3, 0, 3, 0, 6],
                             [4, 0, 1, 1, 9], [4, 1, 1, 0, 9]]


def test_round_trip_of_odd_rows(odd, reference):
    found = packing.pack(odd, length=64, group_tokens=500).collect()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append([*reference.encode(r.text or "", add_special_tokens=False).ids, 0])
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in found:
        assert len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.ids))
        sequences[r.sequence_id].append((r["offset"], r.length))
    for (doc_id, n), parts in pieces.items():
        wanted = [x for x in texts[doc_id] if len(x) == n]
        starts = defaultdict(list)
        for start, ids in parts:
            starts[start].append(ids)
        for start, own in starts.items():
            assert all(any(w[start : start + len(ids)] == ids for w in wanted) for ids in own)
        assert sum(len(ids) for _, ids in parts) == n * len(wanted)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_padding_is_less_than_a_sequence_a_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = packing.pack(docs, with_ids=False).groupBy("sequence_id").sum("length").collect()
    tokens = sum(r[1] for r in found)
    assert len(found) * 1024 - tokens < 0.01 * tokens


def test_no_rows(none):
    assert packing.pack(none).collect() == []

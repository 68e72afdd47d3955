"""Ids and texts against the sentencepiece library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
from housemark.llm import sentencepieces

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(sentencepieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.read_vocabulary(PATH)


def assert_equal(vocabulary, library, texts):
    ids, ends = sentencepieces.Encoder(vocabulary).encode(texts)
    decoded = vocabulary.decode(ids, ends[1:])
    for i, text in enumerate(texts):
        wanted = library.encode(text or "")
        assert ids[ends[i] : ends[i + 1]].tolist() == wanted, repr(text)[:80]
        assert decoded[i] == library.decode(wanted), repr(text)[:80]


def test_odd_texts(vocabulary, library):
    odd = ["", None, " ", "a", "  a  b ", "▁a", "▁ ▁", "\0", "\n", "<s>", "<0x41>", "é", "😀", "⁇ ", "�"]
    assert_equal(vocabulary, library, odd)


def test_every_character(vocabulary, library):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, codes[i : i + 4000])) for i in range(0, len(codes), 4000)]
    assert_equal(vocabulary, library, texts)


def test_runs_of_every_length(vocabulary, library):
    parts = [" ", "a", "=", "ab", "-", "\n", "\t", "aab", " ", " \n"]
    assert_equal(vocabulary, library, [p * n + end for p in parts for n in range(1, 70) for end in ("", "x")])


@pytest.mark.parametrize("letters", ["ab ", "aA ", "the ing", "=-_ ", "01a ", "ACGT", "日本語の中国 ", "éà😀 ﬁ "])
def test_random_texts(vocabulary, library, letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 150))) for _ in range(400)]
    assert_equal(vocabulary, library, texts)


def test_random_pieces(vocabulary, library):
    rng = random.Random(3)
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    for gap in (" ", "", "  "):
        texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 30))).replace("▁", gap) for _ in range(800)]
        assert_equal(vocabulary, library, texts)


@pytest.mark.parametrize("unit", [" ", "a", "\n", " ", "=", "ACGT", "0f", "word ", "Ünï"])
def test_a_million_characters(vocabulary, library, unit):
    assert_equal(vocabulary, library, [unit * (1_000_000 // len(unit))])


def test_long_text_without_spaces(vocabulary, library):
    rng = random.Random(4)
    pieces = [library.id_to_piece(i).strip("▁") for i in range(259, 32000)]
    assert_equal(vocabulary, library, ["".join(rng.choices(pieces, k=30_000))])


def test_ids_that_no_text_gives(vocabulary, library):
    some = [[], [3], [200, 3], [1, 264], [1, 28705, 264], [0, 264], [28705, 28705, 264]]
    some += [[242, 191, 264], [195, 164, 200], [243, 1, 243], [1, 3, 264]]
    ids = np.array([i for x in some for i in x])
    found = vocabulary.decode(ids, np.cumsum([len(x) for x in some]))
    assert found == [library.decode(x) for x in some]


def test_words_remembered_and_forgotten(vocabulary, library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "_REMEMBERED", 60)
    monkeypatch.setattr(sentencepieces, "_IDS", 7)
    encoder = sentencepieces.Encoder(vocabulary)
    rng = random.Random(6)
    for _ in range(60):
        texts = [" ".join(rng.choices(["one", "two", "three", "ﬁve", " "], k=9)) for _ in range(3)]
        ids, ends = encoder.encode(texts)
        wanted = [library.encode(x) for x in texts]
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == wanted
        assert vocabulary.decode(ids, ends[1:]) == library.decode(wanted)


def test_other_models_are_refused(tmp_path):
    model = sentencepieces.sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        sentencepieces.read_vocabulary(str(tmp_path / "m"))


def test_odd_rows(odd, library):
    own = odd.selectExpr("*", "'own ids' AS ids", "'own decoded' AS decoded")
    found = sentencepieces.with_decoded(sentencepieces.with_ids(own))
    assert found.columns == [*odd.columns, "ids", "decoded"]
    rows = found.collect()
    assert len(rows) == 11 and all(r["size"] == "own size" for r in rows)
    for row in rows:
        assert row.ids == library.encode(row.text or "")
        assert row.decoded == (row.text or "")
    at_once = sentencepieces.with_ids(own, decoded="decoded")
    assert at_once.columns == found.columns and sorted(at_once.collect(), key=str) == sorted(rows, key=str)


def test_null_ids_and_no_rows(spark, none):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [264])], "a int, ids array<int>")
    assert [r.decoded for r in sentencepieces.with_decoded(frame).sort("a").collect()] == ["", "", "a"]
    assert sentencepieces.with_decoded(sentencepieces.with_ids(none)).collect() == []


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = entry.queries()["op12_sentencepieces"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for row in rows:
        ids = library.encode(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()

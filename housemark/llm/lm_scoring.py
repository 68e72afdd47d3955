"""Language-model scores: the marginal likelihood of a text over a subword lattice.

Every word, with a space before it, is cut in all ways into pieces of an existing
vocabulary; each way has the product of its pieces' unigram probabilities, and a forward
recursion in log space adds up all ways. A text's probability is that of its words, one
after the other, and of the end.

The piece probabilities come from the training documents: first from the vocabulary's own
cut of each training word, then from expected counts over all ways (``ROUNDS`` rounds of
expectation maximisation). A plain add-one score of whole words stands
beside it.

Texts are read once and written as an inverted table: for each slice of a scan partition and
each word, in which documents of the slice it stands and how often. Each distinct word is
then counted and scored once, and joined back. A frequent word has a row for each slice, so
that adaptive execution can split it; sums for a document combine before the shuffle. What
every task gets is one number for each piece of the vocabulary.
"""

import base64
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from housemark.llm.byte_level import ByteLevel
from housemark.sources.scratch import stage

RANKS = "byte_bpe_50k.tiktoken"
ROUNDS = 1
SLICE_BYTES = 16 << 20

_MOST_TOGETHER = 1 << 21


def read_pieces(path: str) -> dict[bytes, int]:
    """Pieces of the vocabulary and their numbers; all single bytes are among them."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def inverted(docs: DataFrame, doc_id: str, text: str, held_out: Column) -> DataFrame:
    """Rows (slice, word, docs, counts, train, ids, held_out).

    ``docs`` are places in the slice; ``train`` is the word's count in documents that are
    not held out. The row without a word lists a slice's documents: their ids, whether they
    are held out, and their words in ``counts``.
    """
    rows = docs.select(doc_id, text, held_out.alias("held_out"))
    id_type = rows.schema[0].dataType
    schema = T.StructType(
        [
            T.StructField("slice", T.LongType()),
            T.StructField("word", T.BinaryType()),
            T.StructField("docs", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("train", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("held_out", T.ArrayType(T.BooleanType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        for ids, raw, held in _slices(batches):
            yield from _invert(number, ids, raw, held)
            number += 1

    return rows.mapInArrow(run, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Parts of batches with at most ``SLICE_BYTES`` of text, or of one document."""
    for batch in batches:
        raw = batch.column(1).cast(pa.binary())
        sizes = np.array([len(x) if x else 0 for x in raw.to_pylist()], np.int64)
        cut = np.cumsum(sizes) // SLICE_BYTES
        starts = np.flatnonzero(np.diff(cut, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.column(0).slice(a, b - a), raw.slice(a, b - a), batch.column(2).slice(a, b - a)


def _invert(
    number: int, ids: pa.Array, raw: pa.Array, held: pa.Array
) -> Iterator[pa.RecordBatch]:
    place: dict[bytes, int] = defaultdict(count().__next__)
    found, sizes = [], []
    for text in raw.to_pylist():
        words = (text or b"").lower().split()
        found.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
    keys = np.concatenate(found) * len(sizes) + np.repeat(np.arange(len(sizes)), sizes)
    keys, counts = np.unique(keys, return_counts=True)
    word, doc = np.divmod(keys, len(sizes))
    train = counts * ~held.to_numpy(zero_copy_only=False).astype(bool)[doc]
    starts = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
    names = ["slice", "word", "docs", "counts", "train", "ids", "held_out"]

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(
            pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32))
        )

    one = np.array([0, len(sizes)])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([None], pa.binary()),
            lists(np.arange(len(sizes)), one),
            lists(np.array(sizes), one),
            pa.array([0], pa.int64()),
            pa.ListArray.from_arrays(pa.array(one.astype(np.int32)), ids),
            pa.ListArray.from_arrays(pa.array(one.astype(np.int32)), held),
        ],
        names,
    )
    totals = np.add.reduceat(train, starts[:-1]) if len(word) else train
    words = list(place)
    first = 0
    while first < len(words):
        last = int(np.searchsorted(starts, starts[first] + _MOST_TOGETHER, "right")) - 1
        last = max(last, first + 1)
        a, b = starts[first], starts[last]
        n = last - first
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, number)),
                pa.array(words[first:last], pa.binary()),
                lists(doc[a:b], starts[first : last + 1] - a),
                lists(counts[a:b], starts[first : last + 1] - a),
                pa.array(totals[first:last].astype(np.int64)),
                pa.nulls(n, pa.list_(ids.type)),
                pa.nulls(n, pa.list_(pa.bool_())),
            ],
            names,
        )
        first = last


class Lattice:
    """All ways to cut a word into pieces, with a log probability for each piece."""

    def __init__(self, pieces: dict[bytes, int], scores: np.ndarray):
        self.root: dict = {}
        for piece, number in pieces.items():
            node = self.root
            for byte in piece:
                node = node.setdefault(byte, {})
            node[-1] = (number, float(scores[number]))

    def ways(self, word: bytes) -> list[float]:
        """The log probability of all ways to reach each place of the word."""
        size, root, log1p, exp = len(word), self.root, math.log1p, math.exp
        ways: list = [None] * (size + 1)
        ways[0] = 0.0
        for start in range(size):
            here, node = ways[start], root
            for end in range(start, size):
                node = node.get(word[end])
                if node is None:
                    break
                known = node.get(-1)
                if known is not None:
                    new, old = here + known[1], ways[end + 1]
                    if old is None:
                        ways[end + 1] = new
                    elif new > old:
                        ways[end + 1] = new + log1p(exp(old - new))
                    else:
                        ways[end + 1] = old + log1p(exp(new - old))
        return ways

    def log_probability(self, word: bytes) -> float:
        return self.ways(word)[-1]

    def expected(self, word: bytes, weight: float, into: list[float]) -> None:
        """Add ``weight`` times the expected number of each piece in the word.

        Pieces are looked up again on the way back: kept, those of a long word fill the memory.
        """
        before = self.ways(word)
        after = [0.0] * len(before)
        size, root, whole, exp = len(word), self.root, before[-1], math.exp
        for start in range(size - 1, -1, -1):
            node, pieces, terms = root, [], []
            for end in range(start, size):
                node = node.get(word[end])
                if node is None:
                    break
                known = node.get(-1)
                if known is not None:
                    pieces.append(known[0])
                    terms.append(known[1] + after[end + 1])
            most = max(terms)
            shares = [exp(x - most) for x in terms]
            total = sum(shares)
            after[start] = most + math.log(total)
            reached = weight * exp(before[start] + after[start] - whole) / total
            for piece, share in zip(pieces, shares):
                into[piece] += reached * share


def train_scores(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> tuple:
    """Natural log probability of each piece, and of the end, from words and their counts.

    ``words`` has ``word`` and ``train``; ``ends`` is the number of training documents. Every
    piece and the end count once more. One number for each piece comes to the driver.
    """
    words = words.where("train > 0").select("word", "train")
    size = max(read_pieces(path).values()) + 1

    def to_scores(counted: DataFrame) -> tuple:
        totals = np.zeros(size)
        for row in counted.groupBy("piece").agg(F.sum("n").alias("n")).collect():
            totals[row.piece] = row.n
        whole = totals.sum() + ends + size + 1
        return np.log((totals + 1) / whole), math.log((ends + 1) / whole)

    def summed(add, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0.0] * size
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                add(b" " + word, n, totals)
        found = np.array(totals)
        piece = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(piece), "n": pa.array(found[piece])})

    def plainly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ByteLevel(path)

        def add(word: bytes, n: int, totals: list[float]) -> None:
            for piece in vocabulary.encode(word.decode(errors="replace")):
                totals[piece] += n

        yield from summed(add, batches)

    scores, end = to_scores(words.mapInArrow(plainly, "piece long, n double"))
    for _ in range(rounds):

        def expecting(
            batches: Iterator[pa.RecordBatch], scores: np.ndarray = scores
        ) -> Iterator[pa.RecordBatch]:
            yield from summed(Lattice(read_pieces(path), scores).expected, batches)

        scores, end = to_scores(words.mapInArrow(expecting, "piece long, n double"))
    return scores, end


def score(
    docs: DataFrame,
    held_out: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """A row for each document: id, ``held_out``, counts, and log10 scores of the whole text.

    Words are runs without white space, A-Z in lower case; the end counts as a token.
    ``n_tokens``, ``n_known`` (seen in training), ``train_tokens`` (all of them),
    ``base_score`` (add-one unigrams of words) and ``score`` (subword lattice). Null text is
    empty. Without training documents all pieces are equally likely. Repeated rows are
    documents of their own, an empty table gives an empty one, other columns are not read. A
    text is read whole, in one slice; a word of any length needs a number for each of its bytes.
    The id column keeps its name and type.
    """
    path = path or public_tokenizers.path(RANKS)
    table = stage(inverted(docs, doc_id, text, held_out), "inverted")
    documents = table.where("word is null").select(
        "slice", F.explode(F.arrays_zip("docs", "ids", "held_out", "counts")).alias("d")
    )
    documents = documents.select(
        "slice",
        F.col("d.docs").alias("doc"),
        F.col("d.ids").alias("id"),
        F.col("d.held_out").alias("held_out"),
        (F.col("d.counts") + 1).cast("long").alias("n_tokens"),
    )
    occurrences = table.where("word is not null")
    words = stage(occurrences.groupBy("word").agg(F.sum("train").alias("train")), "words")
    ends = documents.where(~F.col("held_out")).count()
    seen, kinds = words.agg(F.sum("train"), F.count_if(F.col("train") > 0)).first()
    tokens, kinds = (seen or 0) + ends, kinds + (ends > 0)
    scores, end = train_scores(words, ends, path, rounds)
    ten = math.log(10)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(read_pieces(path), scores)
        for batch in batches:
            found = [lattice.log_probability(b" " + w) / ten for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], ["word", "train", "lattice"]
            )

    scored_words = stage(
        words.mapInArrow(scored, "word binary, train long, lattice double"), "scored"
    )

    def base(train) -> Column:
        return F.log10((train + 1) / F.lit(float(tokens + kinds + 1)))

    sums = (
        occurrences.select("slice", "word", "docs", "counts")
        .join(
            scored_words.select("word", "lattice", base(F.col("train")).alias("base"), "train"),
            "word",
        )
        .select(
            "slice",
            "lattice",
            "base",
            (F.col("train") > 0).alias("known"),
            # Only here: structs take four times the room of two arrays of integers.
            F.explode(F.arrays_zip("docs", "counts")).alias("d"),
        )
        .groupBy("slice", F.col("d.docs").alias("doc"))
        .agg(
            F.sum(F.col("d.counts") * F.col("base")).alias("base"),
            F.sum(F.col("d.counts") * F.col("lattice")).alias("lattice"),
            F.sum(F.when(F.col("known"), F.col("d.counts")).otherwise(0)).alias("known"),
        )
    )
    zero = F.lit(0.0)
    return documents.join(sums, ["slice", "doc"], "left").select(
        F.col("id").alias(doc_id),
        "held_out",
        "n_tokens",
        (F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.coalesce("base", zero) + base(F.lit(ends))).alias("base_score"),
        (F.coalesce("lattice", zero) + F.lit(end / ten)).alias("score"),
    )

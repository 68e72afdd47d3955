"""Cost-balanced packing of tokenised documents into sequences of one length.

A document costs a linear part and, for attention, a part that is quadratic in the length of
each of its pieces. Whole sequences are cut off a long document first; the rests, in
descending order, go each to the sequence of lowest cost with room for it, and a rest that
fits nowhere is cut over the sequences of lowest cost with any room. As many sequences are
opened as the tokens need, so that a group wastes less than one sequence.

Groups are consecutive documents of a scan partition with at least ``GROUP_TOKENS`` tokens.
They are packed as they are tokenised: nothing is shuffled, a task holds one group, and a
lost task repeats the same groups.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from housemark.llm.byte_level import ByteLevel

RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's one special token.
SPECIAL = {"<|endoftext|>": 50256}
LENGTH = 1024
END = 0
GROUP_TOKENS = 1 << 20
#: Cost of a token, and of a pair of tokens of one piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 512

_ROWS = 64


def tokenizer(path: str) -> ByteLevel:
    """The byte-level vocabulary at ``path``, read from its ranks.

    ``byte_bpe_50k.json`` is the same vocabulary; a test holds the ids of whole tables and
    of every code point against it. Its own library takes four times the CPU time.
    """
    return ByteLevel(path, SPECIAL)


def pack(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    path: str | None = None,
    length: int = LENGTH,
    end: int = END,
    group_tokens: int = GROUP_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence.

    Columns: the id, ``start`` and ``length`` of the piece in its document's ids,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, and with
    ``with_ids`` the ``ids`` themselves. Each document ends with the id ``end``, so that an
    empty or null text is a piece of one id. Sequences are gapless from offset 0 and hold
    ``length`` ids at most. Repeated rows are documents of their own, an empty table gives no
    pieces, other columns are not read. A text of any length and shape is read whole; its task
    holds its ids. The id column keeps its name and type.
    """
    rows = docs.select(doc_id, text)
    schema = (
        f"`{doc_id}` {rows.schema[0].dataType.simpleString()}, start long, length long, "
        "ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
    ) + ", ids array<int>" * with_ids
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        group = (task.partitionId() if task else 0) << 32
        for ids, documents in _groups(batches, path, end, group_tokens):
            yield _pieces(doc_id, ids, documents, group, length, with_ids)
            group += -(-sum(map(len, documents)) // length)

    return rows.mapInArrow(run, schema)


def _groups(
    batches: Iterator[pa.RecordBatch], path: str, end: int, group_tokens: int
) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    held: list[pa.Array] = []
    documents: list[np.ndarray] = []
    tokens = 0
    encode = tokenizer(path).encode
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            for x in part.column(1).to_pylist():
                found = encode(x or "")
                documents.append(np.array([*found, end], "<u4"))
                tokens += len(documents[-1])
            held.append(part.column(0))
            if tokens >= group_tokens:
                yield pa.concat_arrays(held), documents
                held, documents, tokens = [], [], 0
    if documents:
        yield pa.concat_arrays(held), documents


def assign(lengths: np.ndarray, length: int) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that place all tokens of a group."""
    count = -(-int(lengths.sum()) // length)
    whole = lengths // length
    owners = np.repeat(np.arange(len(lengths)), whole)
    firsts = np.arange(len(owners)) - np.repeat(np.cumsum(whole) - whole, whole)
    full = np.column_stack(
        [owners, firsts * length, np.full(len(owners), length), np.arange(len(owners)), 0 * owners]
    )
    rests = lengths - whole * length
    order = np.argsort(-rests, kind="stable")[: np.count_nonzero(rests)]
    room = np.full(count - len(owners), length)
    cost = np.zeros(len(room))
    placed = []
    for document in order.tolist():
        start, left = int(whole[document]) * length, int(rests[document])
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            s = int(np.where(fits, cost, np.inf).argmin())
            size = min(int(room[s]), left)
            placed.append((document, start, size, s + len(owners), length - int(room[s])))
            start, left = start + size, left - size
            room[s] -= size
            cost[s] += LINEAR * size + QUADRATIC * size * size
    return np.concatenate([full, np.array(placed, np.int64).reshape(-1, 5)])


def _pieces(
    doc_id: str,
    ids: pa.Array,
    documents: list[np.ndarray],
    group: int,
    length: int,
    with_ids: bool,
) -> pa.RecordBatch:
    lengths = np.fromiter(map(len, documents), np.int64, len(documents))
    owner, start, size, sequence, offset = assign(lengths, length).T
    parts = [documents[d][a : a + n] for d, a, n in zip(owner, start, size)]
    sums = np.array([zlib.crc32(x.tobytes()) for x in parts], np.int64)
    columns = {
        doc_id: ids.take(pa.array(owner)),
        "start": pa.array(start),
        "length": pa.array(size),
        "ids_crc32": pa.array(sums),
        "doc_tokens": pa.array(lengths[owner]),
        "sequence_id": pa.array(sequence + group),
        "offset": pa.array(offset),
    }
    if with_ids:
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        values = np.concatenate(parts).astype(np.int32)
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
    return pa.RecordBatch.from_pydict(columns)

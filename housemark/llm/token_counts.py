"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie. Where a node has no child for the next byte, its failure link leads
to the node of what remains after the longest pieces before it are taken off, and the number
of these pieces is stored with the link. So every byte is read once, nothing is matched
again, and a word's number of pieces is added up without building a piece.

Words are runs without white space, each with one space before it: pieces that begin with a
space open a word, all others continue one.
"""

import base64
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

RANKS = "byte_bpe_50k.tiktoken"

_CACHED = 300_000
_LONGEST_CACHED = 64


class Automaton:
    """Trie of ``pieces``, which have to hold every single byte.

    ``children`` has the node that a node (times 256) and a byte lead to, ``failures`` each
    node's link and ``popped`` the number of pieces that following it takes off.
    """

    def __init__(self, pieces: list[bytes]):
        if len({x for x in pieces if len(x) == 1}) < 256:
            raise ValueError("the vocabulary lacks single bytes")
        self.children: dict[int, int] = {}
        ends = [False]
        layers: dict[int, list[tuple[int, int, int]]] = {}
        for piece in pieces:
            node = 0
            for depth, byte in enumerate(piece):
                child = self.children.get(node << 8 | byte)
                if child is None:
                    child = self.children[node << 8 | byte] = len(ends)
                    ends.append(False)
                    layers.setdefault(depth, []).append((child, node, byte))
                node = child
            ends[node] = True
        self.failures = [0] * len(ends)
        self.popped = [0] * len(ends)
        for depth in sorted(layers):
            for node, parent, byte in layers[depth]:
                if ends[node]:
                    self.popped[node] = 1
                    continue
                taken, link = self.popped[parent], self.failures[parent]
                while (child := self.children.get(link << 8 | byte)) is None:
                    taken += self.popped[link]
                    link = self.failures[link]
                self.popped[node], self.failures[node] = taken, child

    def count(self, text: bytes) -> int:
        """Number of pieces that the longest match from the left cuts a text into."""
        children, failures, popped = self.children, self.failures, self.popped
        node = total = 0
        for byte in text:
            while (child := children.get(node << 8 | byte)) is None:
                total += popped[node]
                node = failures[node]
            node = child
        while node:
            total += popped[node]
            node = failures[node]
        return total


class Lengths(dict):
    """Number of pieces by word, looked up or counted."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self._automaton = automaton

    def __missing__(self, word: bytes) -> int:
        found = self._automaton.count(b" " + word)
        if len(word) <= _LONGEST_CACHED:
            if len(self) >= _CACHED:
                self.clear()
            self[word] = found
        return found


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file]


def with_token_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` plus ``n_words`` and ``n_tokens`` of the whole text; both 0 for a null one.

    Columns of these names are replaced. Repeated rows have equal counts, an empty table gives an
    empty one, a text of any length is counted whole and byte by byte. The automaton, whose size is that of the
    vocabulary, goes to every task.
    """
    docs = docs.drop("n_words", "n_tokens")
    names = docs.columns
    automaton = Automaton(read_vocabulary(path or public_tokenizers.path(RANKS)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(automaton)
        for batch in batches:
            n_words, n_tokens = [], []
            for raw in batch.column(names.index(text)).cast(pa.binary()).to_pylist():
                words = (raw or b"").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(lengths.__getitem__, words)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                [*names, "n_words", "n_tokens"],
            )

    added = [T.StructField(x, T.LongType()) for x in ("n_words", "n_tokens")]
    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, *added]))
